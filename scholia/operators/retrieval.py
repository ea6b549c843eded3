"""Ranking and retrieval over chunks: BM25 probes, vectors, rank fusion, deduplication, diversity, evidence gates.

A query's terms are literals, so a probe is one scan: term counts are taken in the row, no posting is exploded or shuffled, and
corpus statistics are one partial aggregate of a few numbers. Every limit ends in a unique key.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scholia.functions.cleaning import let
from scholia.functions.definitions import role
from scholia.functions.query import any_of
from scholia.functions.text import is_contents, matching, tokens

# Words of a definition in a passage that is tied to no concept.
CUES = ["định nghĩa", "khái niệm", "được định nghĩa là", "là giới hạn", "công thức", "tính chất", "nguyên lý"]
K1, B = 1.2, 0.75


def _count(tokens_: Column, phrase: list[str], prefix: bool) -> Column:
    """Instances of the phrase among the tokens; with ``prefix`` a single word matches whatever begins with it."""
    if len(phrase) == 1:
        return F.size(F.filter(tokens_, lambda t: t.startswith(phrase[0]) if prefix else t == phrase[0]))
    # each token between spaces of its own; a look-ahead counts instances that overlap
    return F.regexp_count(F.concat(F.lit(" "), F.array_join(tokens_, "  "), F.lit(" ")), F.lit("(?= " + "  ".join(phrase) + " )"))


def bm25_probes(chunks: DataFrame, probes: list[tuple[list[list[str]], bool, bool]], key: str = "doc_id", text: str = "text") -> list[DataFrame]:
    """For each probe (phrases, prefix, every): key, score (lower is better; 6 places) of chunks that hold any phrase, or all with ``every``.

    All probes' statistics come from one pass; each probe's scores read only its own counts.
    """
    toks = chunks.select(key, tokens(F.col(text)).alias("toks"))
    tf = [[f"tf{p}_{i}" for i in range(len(phrases))] for p, (phrases, _, _) in enumerate(probes)]
    columns = [_count(F.col("toks"), phrase, prefix).alias(tf[p][i]) for p, (phrases, prefix, _) in enumerate(probes) for i, phrase in enumerate(phrases)]
    counts = toks.select(key, F.size("toks").alias("dl"), *columns)
    stats = counts.agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl"), *[F.count_if(F.col(c) > 0).alias(c) for names in tf for c in names]).first()
    total, avgdl = stats["n"], stats["avgdl"] or 1.0
    out = []
    for names, (_, _, every) in zip(tf, probes, strict=True):
        score, hit = F.lit(0.0), F.lit(every)
        for c in names:
            idf = F.log((F.lit(float(total)) - stats[c] + 0.5) / (F.lit(float(stats[c])) + 0.5))
            idf = F.when(idf <= 0, F.lit(1e-6)).otherwise(idf)
            n = F.col(c).cast("double")
            score = score - idf * (n * (K1 + 1.0)) / (n + K1 * (1.0 - B + B * F.col("dl") / F.lit(float(avgdl))))
            hit = (hit & (n > 0)) if every else (hit | (n > 0))
        out.append(counts.where(hit).select(key, F.round(score, 6).alias("score")))
    return out


def bm25(chunks: DataFrame, phrases: list[list[str]], key: str = "doc_id", text: str = "text", prefix: bool = True, every: bool = False) -> DataFrame:
    """One probe's scores."""
    return bm25_probes(chunks, [(phrases, prefix, every)], key, text)[0]


def top(scored: DataFrame, k: int, key: str = "doc_id", by: str = "score", descending: bool = False) -> DataFrame:
    order = F.col(by).desc() if descending else F.col(by).asc()
    return scored.orderBy(order, key).limit(k)


def ranked(scored: DataFrame, k: int, key: str = "doc_id", by: str = "score", descending: bool = False) -> DataFrame:
    """The best k rows with ``rank`` from 1: numbered after the limit, so the single window sees k rows."""
    order = F.col(by).desc() if descending else F.col(by).asc()
    return top(scored, k, key, by, descending).withColumn("rank", F.row_number().over(Window.orderBy(order, key)))


def first_seen(probes: list[DataFrame], key: str = "doc_id") -> DataFrame:
    """Union of ranked probes: a key keeps the score of the first probe that found it."""
    rows = None
    for number, p in enumerate(probes, 1):
        one = p.select(key, "score", F.lit(number).alias("probe"), "rank")
        rows = one if rows is None else rows.unionByName(one)
    return rows.groupBy(key).agg(F.min(F.struct("probe", "rank", "score")).alias("x")).select(key, F.col("x.probe").alias("probe"), F.col("x.score").alias("score"))


def contains_any(chunks: DataFrame, words: list[str], k: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Fallback scan: chunks that hold any word of over two characters, whatever the case."""
    hit = F.lit(False)
    for w in words:
        if len(w) > 2:
            hit = hit | F.contains(F.lower(F.col(text)), F.lit(w.lower()))
    return chunks.where(hit).select(key).orderBy(key).limit(k)


def cosine(vectors: DataFrame, query: list[float], key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """key, score of vectors of the query's length and of non-zero norm, in doubles."""
    queries = vectors.sparkSession.createDataFrame([(0, [float(x) for x in query])], "query_id int, query array<double>")
    return cosine_all(vectors, queries, key, vector).select(key, "score")


def cosine_all(vectors: DataFrame, queries: DataFrame, key: str = "vec_id", vector: str = "embedding", block: int = 2048, least: float | None = None, best: int | None = None) -> DataFrame:
    """query_id, key, score of every query (query_id, query) with every vector of its length; zero norms and nulls have none.

    ``least``: scores of at least that only. ``best``: at least each query's best so many, with all ties of the last; ``best_for_each``
    ranks them. Blocks of some ``block`` queries meet parts of the vectors, each pair a job: it holds one block of queries while the part's vectors pass,
    multiplies matrices to see which pairs can count, and computes the scores of these in the order of the dimensions. Vectors whose squares
    would leave the doubles are taken times a power of two first, which changes no score.
    """
    most = lambda c: F.array_max(F.transform(c, lambda x: F.abs(x.cast("double"))))
    by = lambda c: F.when(most(c) > 1e100, 2.0**-700).when(most(c) < 1e-100, 2.0**700).otherwise(1.0)
    double = lambda c: let(by(c), lambda b: F.transform(c, lambda x: x.cast("double") * b))
    size = lambda c: F.sqrt(F.aggregate(c, F.lit(0.0), lambda a, x: a + x * x))
    asked = queries.select("query_id", double(F.col("query")).alias("v")).withColumn("norm", size(F.col("v"))).where("norm > 0")
    rows = vectors.where(F.col(vector).isNotNull()).select(key, double(F.col(vector)).alias("v")).withColumn("norm", size(F.col("v"))).where("norm > 0")
    blocks = max(1, -(-queries.count() // block))
    parts = max(1, -(-vectors.count() // (8 * block)), -(-vectors.sparkSession.sparkContext.defaultParallelism // blocks))
    id_type, key_type = queries.schema["query_id"].dataType, vectors.schema[key].dataType
    hashed, each = (lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")), (lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    left = asked.select(F.lit(0).alias("side"), hashed("query_id", blocks).alias("block"), each(parts).alias("part"), F.col("query_id").alias("_query"), F.lit(None).cast(key_type).alias("_key"), "v", "norm")
    right = rows.select(F.lit(1).alias("side"), each(blocks).alias("block"), hashed(key, parts).alias("part"), F.lit(None).cast(id_type).alias("_query"), F.col(key).alias("_key"), "v", "norm")
    job = ["length", "block", "part"]
    dealt = left.unionByName(right).withColumn("length", F.size("v")).repartition(blocks * parts, *job).sortWithinPartitions(*job, "side")
    met = dealt.mapInArrow(lambda batches: _scored(batches, key, least, best), T.StructType([T.StructField("query_id", id_type), T.StructField(key, key_type), T.StructField("score", T.DoubleType())]))
    scores = met.where(~F.isnan("score")).select("query_id", key, F.round("score", 6).alias("score"))
    return scores if least is None else scores.where(F.col("score") >= least)


def _scored(batches: Iterator[pa.RecordBatch], key: str, least: float | None, best: int | None, strip: int = 1024) -> Iterator[pa.RecordBatch]:
    """Scores of the jobs (length, block, part) of sorted rows, queries (side 0) before vectors. Pairs within 2e-6 of the limit stay, so that rounded ties do."""
    job, held, top_ = None, [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        marks = np.stack([batch.column(c).to_numpy() for c in ("length", "block", "part", "side")], axis=1)
        starts = [0, *(np.flatnonzero((marks[1:] != marks[:-1]).any(axis=1)) + 1).tolist()]
        for s, e in zip(starts, [*starts[1:], batch.num_rows], strict=True):
            *now, side = marks[s].tolist()
            if now != job:
                job, held, top_ = now, [], None
            piece = batch.slice(s, e - s)
            matrix, norms = piece.column("v").flatten().to_numpy().reshape(e - s, -1), piece.column("norm").to_numpy()
            if side == 0:
                held.append((piece.column("_query"), matrix, norms))
                continue
            if not held:
                continue
            if top_ is None:
                ids, asked, asked_norms = pa.concat_arrays([h[0] for h in held]), np.concatenate([h[1] for h in held]), np.concatenate([h[2] for h in held])
                top_ = np.full((best or 0, len(asked)), -np.inf)
            for at in range(0, e - s, strip):
                v, n = matrix[at : at + strip], norms[at : at + strip]
                with np.errstate(all="ignore"):
                    near = v @ asked.T / (n[:, None] * asked_norms)
                    odd = ~np.isfinite(near)
                    if best is not None:
                        ranked_ = np.concatenate([top_, np.where(odd, -np.inf, near)])
                        top_ = np.partition(ranked_, len(ranked_) - best, axis=0)[-best:]
                        i, j = np.nonzero((near >= top_.min(axis=0) - 2e-6) | odd)
                    else:
                        i, j = np.nonzero((near >= least - 2e-6) | odd) if least is not None else np.nonzero(np.ones_like(odd))
                    dot = np.zeros(len(i))
                    for d in range(v.shape[1]):
                        dot += v[i, d] * asked[j, d]
                    score = dot / (n[i] * asked_norms[j])
                if len(i):
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array(j)), piece.column("_key").take(pa.array(i + at)), pa.array(score)], ["query_id", key, "score"])


def best_for_each(scored: DataFrame, k: int, key: str, parts: int = 64) -> DataFrame:
    """Each query's best ``k`` with ``rank``: the best of each of ``parts`` parts first, so no task ranks a query's every row."""
    part = F.pmod(F.xxhash64(key), F.lit(parts))
    few = scored.withColumn("_p", part).withColumn("_r", F.row_number().over(Window.partitionBy("query_id", "_p").orderBy(F.desc("score"), key))).where(F.col("_r") <= k)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), key))
    return few.withColumn("rank", rank).where(F.col("rank") <= k).drop("_p", "_r")


def fuse(lists: list[tuple[DataFrame, float]], key: str | list[str] = "doc_id", offset: int = 60) -> DataFrame:
    """Reciprocal rank fusion: each list's weight / (offset + rank), summed for each key."""
    keys = [key] if isinstance(key, str) else key
    rows = None
    for ranking, weight in lists:
        one = ranking.select(*keys, (F.lit(float(weight)) / (F.lit(float(offset)) + F.col("rank"))).alias("part"))
        rows = one if rows is None else rows.unionByName(one)
    return rows.groupBy(*keys).agg(F.round(F.sum("part"), 9).alias("score"))


def dedupe_text(hits: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One hit for each text in its form for comparison: the best score, then the smallest key."""
    w = Window.partitionBy(F.sha2(matching(F.col(text)).cast("binary"), 256)).orderBy(F.desc("score"), key)
    return hits.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def diversify(hits: DataFrame, group: str, cap: int, k: int, key: str = "doc_id") -> DataFrame:
    """The best k hits with ``cap`` a group at most, filled up from the rest in order if that leaves room.

    Only a group's best k can be among them: that bound on the rank lets the planner keep k rows a group before the shuffle.
    """
    inside = Window.partitionBy(group).orderBy(F.desc("score"), key)
    placed = hits.withColumn("place", F.row_number().over(inside)).where(F.col("place") <= k).withColumn("spare", F.col("place") > cap)
    best = placed.orderBy("spare", F.desc("score"), key).limit(k)
    return best.withColumn("position", F.row_number().over(Window.orderBy("spare", F.desc("score"), key)))


def content_relevance(text: Column, concepts: list[str], contents: Column | None = None) -> Column:
    """What a passage's form adds to its rank: contents pages and catalogues less, definitions and explanations more."""
    low = F.lower(text)
    names = any_of(low, [c.lower() for c in concepts]) if concepts else F.lit(True)
    cue = names & any_of(low, CUES)
    form = let(role(text, concepts), lambda r: F.when(r["attached"], F.when(r["explained"], 0.6).otherwise(0.4)).when(r["catalogue"], -0.5).when(cue, 0.15).otherwise(0.0))
    return F.when(is_contents(text) if contents is None else contents, -0.8).otherwise(0.0) + form + F.when((F.length(text) > 100) & text.rlike(r"[.!?;\n]"), 0.1).otherwise(0.0)


def by_content(fused: DataFrame, concepts: list[str], text: str = "text", keyword_only: bool = False) -> DataFrame:
    """Fused hits with ``hybrid``: the fused score times 1 + relevance (no less than 0.2); of keyword hits alone the score plus ten times it."""
    c = content_relevance(F.col(text), concepts)
    out = F.col("score") + c * 10.0 if keyword_only else F.col("score") * (1.0 + F.greatest(F.lit(-0.8), c))
    return fused.withColumn("hybrid", F.round(out, 9))


def one_each(hits: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The first hit of each key (file, page, chunk): an aggregate, so repeats are merged before the shuffle."""
    rest = [c for c in hits.columns if c not in keys and c != order]
    return hits.groupBy(*keys).agg(F.min(F.struct(order, *rest)).alias("x")).select(*keys, f"x.{order}", *[f"x.{c}" for c in rest])


# What a page of a file is called, by extension.
UNITS = [("docx|txt|md|markdown", "Đoạn"), ("png|jpg|jpeg", "Hình")]


def label(title: Column, file: Column, page: Column) -> Column:
    """A citation's label: [title, unit page]."""
    unit = F.lit("Trang")
    for endings, name in UNITS:
        unit = F.when(F.lower(file).rlike(rf"\.(?:{endings})$"), name).otherwise(unit)
    return F.concat(F.lit("["), title, F.lit(", "), unit, F.lit(" "), page.cast("string"), F.lit("]"))


def page_passages(chunks: DataFrame, doc: object, page: int, limit: int = 12, doc_column: str = "doc_id", page_column: str = "page_num", order: tuple[str, ...] = ("chunk_index",), text: str = "text") -> DataFrame:
    """The first chunks of one page that hold anything: the filter comes before the limit."""
    return chunks.where((F.col(doc_column) == doc) & (F.col(page_column) == page)).orderBy(*order).limit(limit).where(F.trim(text) != "")


def relevant(hits: DataFrame, terms: list[str], group: str, text: str = "text", cosine_column: str = "cosine", least: float = 0.52) -> DataFrame:
    """group, covered, relevant: whether a question's hits hold three quarters of its terms together, or one is near enough by vector."""
    wanted = F.array(*[F.lit(t) for t in dict.fromkeys(terms)])
    held = F.transform(wanted, lambda t: F.array_contains(tokens(F.col(text)), t).cast("int"))
    maxima = [F.max(F.get("_h", i)).alias(f"_t{i}") for i in range(len(set(terms)))]
    per = hits.select(group, cosine_column, held.alias("_h")).groupBy(group).agg(F.max(F.coalesce(cosine_column, F.lit(0.0))).alias("_c"), *maxima)
    share = sum((F.col(f"_t{i}") for i in range(len(set(terms)))), F.lit(0)) / float(max(1, len(set(terms))))
    return per.select(group, F.round(share, 6).alias("covered"), ((share >= 0.75) | (F.col("_c") >= least)).alias("relevant"))


def reason(found: Column, page_scope: Column, generic: Column, sides: Column, relevant_: Column) -> Column:
    """Why a question gets no answer, by the first rule that holds; null where it gets one. ``sides``: how many of two compared concepts are held, null for no comparison."""
    return (
        F.when(~found & page_scope, "page_empty")
        .when(~found, "no_results")
        .when(page_scope, F.when(~generic & ~relevant_, "page_scope_too_narrow"))
        .when(sides.isNotNull(), F.when(sides == 0, "low_relevance").when(sides == 1, "partial_evidence"))
        .when(~relevant_, "low_relevance")
    )


def interleave(left: DataFrame, right: DataFrame, key: str = "doc_id") -> DataFrame:
    """Two ranked lists in turn, each key where it comes first: key, position."""
    rows = left.select(key, "rank", F.lit(0).alias("side")).unionByName(right.select(key, "rank", F.lit(1).alias("side")))
    first = rows.groupBy(key).agg(F.min(F.struct("rank", "side")).alias("x"))
    return first.select(key, F.row_number().over(Window.orderBy("x.rank", "x.side")).alias("position"))


def coverage(hits: DataFrame, terms: list[str], key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, covered: the share of the query's terms that a hit holds; weak below 0.75."""
    wanted = F.array(*[F.lit(t) for t in terms])
    share = F.size(F.array_intersect(wanted, tokens(F.col(text)))) / F.lit(float(max(1, len(set(terms)))))
    return hits.select(key, F.round(share, 6).alias("covered")).withColumn("weak", F.col("covered") < 0.75)


def holds_concept(text: Column, concept: str) -> Column:
    """True where the whole concept stands in the text between non-word characters, or all its words do."""
    words = concept.lower().split()
    joined = F.concat(F.lit(" "), F.array_join(tokens(text), " "), F.lit(" "))
    whole = F.contains(joined, F.lit(" " + " ".join(words) + " "))
    each = F.lit(True)
    for w in words:
        each = each & F.contains(joined, F.lit(f" {w} "))
    return whole | each


def one_side_only(hits: DataFrame, left: str, right: str, text: str = "text") -> DataFrame:
    """One row: how many hits hold each concept, and whether exactly one of the two is held at all."""
    a, b = holds_concept(F.col(text), left), holds_concept(F.col(text), right)
    found = hits.agg(F.count_if(a).alias("left_hits"), F.count_if(b).alias("right_hits"))
    return found.withColumn("partial", (F.col("left_hits") > 0) != (F.col("right_hits") > 0))
