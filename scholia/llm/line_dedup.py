"""Line deduplication: repeated runs of lines, found by a suffix array over line-ID sequences.

A document is its sequence of lines that hold a word; lines between them do not break a run. A run is a stretch of such lines of
one document. A run that occurs earlier too (by document id, then text hash, then line; lines compare whole) and has at least
``min_words`` words is a copy, and its lines are deleted. So a line goes if and only if it lies in such a run.

The suffix array is built by prefix doubling: every position has the rank of its first 2 ** k lines, and a round ranks pairs
(rank here, rank 2 ** k lines on). Ranks keep the order: a pair's rank is its class's rank plus the number of the class's
positions with smaller seconds, which distinct pairs with their counts give, so that a line or pair that a third of all positions
share is one row there. Only lines that occur twice are positions, and a class of one position is left. Depth min_words is enough, since each
line has a word: positions whose ranks agree on the shortest stretch of min_words words from them form one longest-common-prefix
interval; its first position stays, and the later ones start copies. The shortest stretches that end at each position are looked
up likewise; copies are unions of the two kinds, so every maximal run is covered to its last line (see the tests' brute force).

Rows: a null text stays null; lines without a word stay; rows that repeat an id and a text are one document, each row of which
gets its result; ids of any type, null ids sort last (with the largest long, if that is an id); empty tables give no rows; columns other than doc_id and text are carried along by
``dedup_lines`` and not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scholia.llm.common import WORD, cut

_LAST = (1 << 63) - 1


def _keys(docs: DataFrame) -> tuple[Column, Column]:
    """The document's place, null ids behind all others, and the hash of its text. Ids that are no whole numbers are ordered as texts."""
    own = docs["doc_id"]
    if isinstance(docs.schema["doc_id"].dataType, T.IntegralType):
        place = F.coalesce(own.cast("long"), F.lit(_LAST))
    else:
        place = F.struct(own.isNull().alias("none"), F.coalesce(own.cast("string"), F.lit("")).alias("id"))
    return place.alias("d"), F.xxhash64(docs["text"]).alias("t")


def positions(docs: DataFrame) -> DataFrame:
    """d, t, seq, line_no, words, r: the lines that occur at least twice; r is the rank of the line among all these lines."""
    numbered = F.transform(F.split("text", "\n", -1), lambda x, i: F.struct(x.alias("line"), i.alias("line_no")))
    held = F.filter(numbered, lambda s: s["line"].rlike(WORD))
    lines = docs.where("text is not null").select(*_keys(docs), F.posexplode(held).alias("seq", "x"))
    lines = lines.select("d", "t", "seq", "x.line_no", F.xxhash64("x.line").alias("h1"), F.xxhash64(F.lit(1), F.col("x.line")).alias("h2"), F.regexp_count("x.line", F.lit(WORD)).alias("words"))
    seen = cut(lines.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
    # ranks in the order of the hashes: the leading ten bits cut them into buckets, whose sums (1,024 rows) give each one's first rank
    part = F.shiftright("h1", 54).alias("part")
    within = Window.partitionBy("part").orderBy("h1", "h2")
    sums = seen.groupBy(part).agg(F.sum("n").alias("all")).withColumn("before", F.sum("all").over(Window.orderBy("part")) - F.col("all"))
    ranked = seen.select("*", part).withColumn("at", F.sum("n").over(within) - F.col("n")).join(F.broadcast(sums), "part")
    ranked = ranked.select("h1", "h2", (F.col("before") + F.col("at")).alias("r"))
    return lines.join(ranked, ["h1", "h2"]).select("d", "t", "seq", "line_no", "words", "r")


def double(at: DataFrame, k: int) -> DataFrame:
    """``at`` with ``r{k + 1}``, the rank of the 2 ** (k + 1) lines from each position; null where they end or are unique."""
    step, here = 1 << k, f"r{k}"
    doc = Window.partitionBy("d", "t").orderBy("seq")
    follows = F.lead("seq", step).over(doc) == F.col("seq") + step
    paired = at.withColumn("second", F.when(follows, F.lead(here, step).over(doc)))
    pairs = paired.where(f"{here} is not null and second is not null").groupBy(F.col(here).alias("a"), F.col("second").alias("b")).agg(F.count(F.lit(1)).alias("n"))
    # a line that very many others follow has as many pairs: they are numbered within ranges of b, and the ranges' sums give where each begins
    pairs = pairs.withColumn("range", F.shiftright("b", 20))
    inside = F.sum("n").over(Window.partitionBy("a", "range").orderBy("b")) - F.col("n")
    sums = pairs.groupBy("a", "range").agg(F.sum("n").alias("all"))
    before = sums.select("a", "range", (F.sum("all").over(Window.partitionBy("a").orderBy("range")) - F.col("all")).alias("before"))
    ranks = pairs.withColumn("inside", inside).where("n > 1").join(before, ["a", "range"]).select("a", "b", (F.col("a") + F.col("before") + F.col("inside")).alias("r"))
    joined = paired.join(ranks, (F.col(here) == F.col("a")) & (F.col("second") == F.col("b")), "left")
    return joined.withColumnRenamed("r", f"r{k + 1}").drop("a", "b", "second")


def copies(docs: DataFrame, min_words: int = 10) -> DataFrame:
    """d, t, line_no: the lines to delete; keys of documents as in ``dedup_lines``."""
    found = positions(docs).withColumnRenamed("r", "r0").dropDuplicates(["d", "t", "seq"])
    levels = 0
    while 2 << levels <= min_words:
        found = cut(double(found, levels))
        levels += 1
    # a run has no gap; words before each position of its run
    doc = Window.partitionBy("d", "t").orderBy("seq")
    found = found.withColumn("run", F.col("seq") - F.row_number().over(doc))
    run = Window.partitionBy("d", "t", "run")
    found = found.withColumn("c", F.sum("words").over(run.orderBy("seq")).cast("long")).withColumn("p", F.col("c") - F.col("words"))
    ahead, back = run.orderBy("p").rangeBetween(0, min_words - 1), run.orderBy("c").rangeBetween(1 - min_words, 0)
    found = found.withColumn("to", F.when(F.max("c").over(ahead) >= F.col("p") + min_words, F.max("seq").over(ahead)))
    found = found.withColumn("from", F.when(F.min("p").over(back) <= F.col("c") - min_words, F.min("seq").over(back)))
    ranks = F.array(*[F.col(f"r{k}") for k in range(levels + 1)])
    runs = found.groupBy("d", "t", "run").agg(F.sort_array(F.collect_list(F.struct("seq", "line_no", ranks.alias("r"), "to", "from"))).alias("at"))
    first = F.col("at")[0]["seq"]

    def stretch(begin: Column, end: Column) -> Column:
        size = end - begin + 1
        level = F.floor(F.log2(size.cast("double"))).cast("int")
        ranks_of = lambda seq: F.element_at(F.element_at(F.col("at"), (seq - first + 1).cast("int"))["r"], level + 1)
        return F.struct(begin.alias("s"), size.alias("size"), ranks_of(begin).alias("a"), ranks_of(end - F.pow(F.lit(2), level).cast("long") + 1).alias("b"))

    both = F.array_distinct(
        F.concat(
            F.transform(F.filter("at", lambda x: x["to"].isNotNull()), lambda x: stretch(x["seq"], x["to"])),
            F.transform(F.filter("at", lambda x: x["from"].isNotNull()), lambda x: stretch(x["from"], x["seq"])),
        )
    )
    stretches = cut(runs.select("d", "t", F.explode(both).alias("x"), F.col("at.line_no").alias("numbers"), first.alias("first")).where("x.a is not null and x.b is not null").select("d", "t", "x.*", F.slice("numbers", F.col("x.s") - F.col("first") + 1, F.col("x.size").cast("int")).alias("numbers")))
    interval = ["size", "a", "b"]
    # written down, so that the join reads two plain exchanges: then a stretch that very many documents share can be split between tasks
    firsts = cut(stretches.groupBy(*interval).agg(F.min(F.struct("d", "t", "s")).alias("kept"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"))
    later = stretches.join(firsts, interval).where(F.struct("d", "t", "s") != F.col("kept"))
    return later.select("d", "t", F.explode("numbers").alias("line_no")).distinct()


def dedup_lines(docs: DataFrame, min_words: int = 10) -> DataFrame:
    """``docs`` with the copies' lines deleted from ``text``, and n_lines and n_removed (of the text as it was; columns of ``docs`` of these names are replaced)."""
    gone = copies(docs, min_words).groupBy("d", "t").agg(F.collect_list("line_no").alias("gone"))
    # a row travels as one struct, so that its columns' names clash with none here
    rows = docs.select(F.struct("*").alias("row"), *_keys(docs)).alias("rows")
    met = rows.join(gone.alias("gone"), (F.col("rows.d") == F.col("gone.d")) & (F.col("rows.t") == F.col("gone.t")), "left")
    # the split text is a column of its own: inside the lambda it would be split again for each line
    met = met.select("row", "gone.gone", F.split("row.text", "\n", -1).alias("lines"))
    left = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("gone"))
    text = F.when(F.col("gone").isNull(), F.col("row.text")).otherwise(F.array_join(F.transform(left, lambda i: F.col("lines")[i]), "\n"))
    kept = [F.col(f"row.`{c}`") for c in docs.columns if c not in ("text", "n_lines", "n_removed")]
    return met.select(*kept, text.alias("text"), F.greatest(F.size("lines"), F.lit(0)).alias("n_lines"), F.greatest(F.size("gone"), F.lit(0)).alias("n_removed"))
