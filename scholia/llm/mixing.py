"""Mixing sources to target weights by Sainte-Lague apportionment of equal-token blocks.

1. Targets: sources share all words by weight; a target stops at ``most`` times its source, and the excess is shared again by
   weight until none is above.
2. Each source's words, its documents in a seeded order, form one sequence that is cut into blocks of equal size and shards of
   ``shard_blocks`` blocks. The blocks of the whole mix go to sources by highest quotients (target / odd numbers), and a
   source's blocks to its shards likewise, which gives each shard an integer quota.
3. A shard whose quota is q of n blocks takes q // n whole passes and q % n more blocks, those with the lowest seeded hash.

A document's ``taken`` is the number of its words in blocks taken, repeats counted.

Rows: a null text has size 0 and takes nothing; null source is a source of its own, last in order; documents of one id are
ordered by text checksum, and rows that are the same in both are interchangeable; empty tables and tables without a word give
targets of 0; a long document spans many blocks; only doc_id, text and source are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scholia.llm.common import WORD, cut, unit

WEIGHTS = (5, 2, 1)


def words_in(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: float = 3.0) -> DataFrame:
    """source, source_size, weight, target from (source, source_size), one row a source.

    The table has a row for each source and the loop runs on its sums: a round fixes every source whose share is above its
    limit, so there are as many rounds at most as there are limits to reach.
    """
    order = Window.orderBy(F.col("source").isNull(), F.col("source"))
    ranked = sizes.withColumn("_r", F.row_number().over(order) - 1)
    ranked = cut(ranked.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("_r") % len(weights) + 1).cast("int"))).drop("_r"))
    total = float(ranked.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0])
    limit, share = F.col("source_size") * F.lit(most), F.lit(0.0)
    rate, fixed = None, -1
    while True:  # fixed sources: those whose limit is below rate * weight
        full = F.lit(False) if rate is None else F.col("weight") * F.lit(rate) >= limit
        row = ranked.agg(F.sum(F.when(full, limit)), F.sum(F.when(~full, F.col("weight"))), F.count(F.when(full, 1))).first()
        if not row[1] or row[2] == fixed:
            break
        fixed, rate = row[2], max(0.0, total - (row[0] or 0.0)) / row[1]
    if rate is not None:
        share = F.least(F.col("weight") * F.lit(rate), limit)
    return ranked.withColumn("target", share.cast("double"))


def apportion(df: DataFrame, group: list[str], weight: str, seats: Column, name: list[str]) -> DataFrame:
    """``df`` with ``quota``: each group's seats, given to its rows by highest quotients weight / (2k + 1).

    Rounding weight * seats / total is at most half a seat a row away from the result; so only the few quotients that could be
    given or taken back are ranked, not one for each seat.
    """
    of = Window.partitionBy(*group)
    start = df.withColumn("_seats", seats).withColumn("_w", F.sum(weight).over(of)).withColumn("_n", F.count(F.lit(1)).over(of))
    exact = F.when(F.col("_w") > 0, F.col(weight) * F.col("_seats") / F.col("_w")).otherwise(F.lit(0.0))
    start = start.withColumn("_q", F.floor(exact + 0.5)).withColumn("_off", F.col("_seats") - F.sum("_q").over(of))
    reach = F.when(F.col("_w") > 0, F.ceil(F.col(weight) / F.col("_w") * (F.col("_n") / 2 + 1))).otherwise(0).cast("long") + 1
    more = F.when(F.col("_off") > 0, F.transform(F.sequence(F.lit(0).cast("long"), reach), lambda i: F.struct(F.lit(1).alias("d"), (-F.col(weight) / (2 * (F.col("_q") + i) + 1)).alias("by"), i.alias("i"))))
    less = F.transform(F.filter(F.sequence(F.lit(0).cast("long"), reach), lambda i: F.col("_q") - i > 0), lambda i: F.struct(F.lit(-1).alias("d"), (F.col(weight) / (2 * (F.col("_q") - i) - 1)).alias("by"), i.alias("i")))
    tried = start.where("_off <> 0").select(*group, *name, "_off", F.explode(more.otherwise(less)).alias("t"))
    ranked = tried.withColumn("_k", F.row_number().over(of.orderBy(F.col("t.by"), *[F.col(c) for c in name], F.col("t.i"))))
    change = ranked.where("_k <= abs(_off)").groupBy(*group, *name).agg(F.sum("t.d").alias("_change"))
    keys = [F.col(f"s.{c}").eqNullSafe(F.col(f"c.{c}")) for c in dict.fromkeys([*group, *name])]
    on = keys[0]
    for k in keys[1:]:
        on = on & k
    joined = start.alias("s").join(change.alias("c"), on, "left")
    return joined.select(*[F.col(f"s.{c}") for c in df.columns], (F.col("_q") + F.coalesce(F.col("_change"), F.lit(0))).cast("long").alias("quota"))


def running(rows: DataFrame, group: str, order: str, tie: list[str], size: str, per_bucket: int = 50_000) -> DataFrame:
    """``rows`` with ``start``: the sum of ``size`` of the group's rows before each, in the order of ``order`` (0 to 1), then ``tie``.

    Buckets of the order hold some ``per_bucket`` rows of all; a window runs inside a bucket, and the buckets' sums give where each
    begins, so that no task sorts a whole group and the number of buckets changes no result.
    """
    buckets = max(1, -(-rows.count() // per_bucket))
    bucket = F.least(F.floor(F.col(order) * buckets), F.lit(buckets - 1)).cast("int").alias("bucket")
    inside = Window.partitionBy(group, "bucket").orderBy(order, *tie)
    placed = rows.select("*", bucket).withColumn("within", F.sum(size).over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col(size))
    sums = rows.groupBy(group, bucket).agg(F.sum(size).alias("n"))
    offsets = sums.withColumn("before", F.sum("n").over(Window.partitionBy(group).orderBy("bucket")) - F.col("n")).drop("n")
    met = placed.alias("p").join(offsets.alias("o"), F.col(f"p.{group}").eqNullSafe(F.col(f"o.{group}")) & (F.col("p.bucket") == F.col("o.bucket")))
    return met.select(*[F.col(f"p.{c}") for c in rows.columns], (F.col("within") + F.col("before")).alias("start"))


def mixed(docs: DataFrame, seed: str = "mix", **options) -> DataFrame:
    """The rows of ``docs`` as often as the mix takes them; documents stay whole.

    A document is taken once for each whole pass over it. What passes leave over in part is made up, source by source, by whole
    documents in the order of a seeded draw over the part of them that is left over, up to the source's left-over words: so a
    source gives the words of its integer quotas to within half a document. One without a word is not taken.
    """
    keys = ["doc_id", "source", "check"]
    taken = mix(docs, seed=seed, keep_check=True, **options).where("taken > 0").select(*keys, "size", "taken")
    taken = cut(taken.withColumn("passes", F.floor(F.col("taken") / F.col("size"))).withColumn("over", F.col("taken") - F.col("passes") * F.col("size")))
    left = taken.groupBy("source").agg(F.sum("over").alias("room"))
    drawn = taken.where("over > 0").withColumn("draw", unit(seed + "-copy", F.col("doc_id"), F.col("check")) * F.col("size") / F.col("over"))
    placed = running(drawn.withColumn("order", F.col("draw") / (1 + F.col("draw"))), "source", "order", ["doc_id", "check", "size"], "size")
    more = placed.alias("p").join(F.broadcast(left).alias("l"), F.col("p.source").eqNullSafe(F.col("l.source"))).where("2 * start + size <= 2 * room")
    times = taken.where("passes > 0").select(*keys, "passes").unionByName(more.select(*[F.col(f"p.{k}") for k in keys], F.lit(1).cast("long").alias("passes")))
    # rows of one id, source and text stand for one another: one of them is given as often as all are taken
    key = lambda check: F.struct("doc_id", "source", check.alias("check")).alias("key")
    share = times.select(key(F.col("check")), "passes").groupBy("key").agg(F.sum("passes").cast("int").alias("times"))
    rows = docs.select(key(F.crc32(F.coalesce(docs["text"], F.lit("")).cast("binary"))), F.struct("*").alias("row")).groupBy("key").agg(F.first("row").alias("row"))
    again = rows.join(share, "key").select("row", F.explode(F.sequence(F.lit(1), F.col("times"))))
    return again.select(*[F.col(f"row.`{c}`") for c in docs.columns])


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = 3, block: int = 64, shard_blocks: int = 4096, seed: str = "mix", keep_check: bool = False) -> DataFrame:
    """doc_id, source, size, source_size, target, taken (and the text's checksum, ``check``) for each row of ``docs``.

    A block has ``block`` words, at any size of the table.
    """
    rows = cut(docs.select("doc_id", "source", words_in(F.col("text")).alias("size"), F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("check")))
    by_source = targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, most)
    by_source = cut(by_source)
    words = block

    # every document's first word in its source's sequence
    placed = running(rows.withColumn("order", unit(seed + "-order", F.col("doc_id"))), "source", "order", ["doc_id", "check", "size"], "size")

    # quotas: a source's last block is shorter, so its claim is its target in blocks of its own mean size
    count = F.ceil(F.col("source_size") / words)
    claims = by_source.withColumn("all", F.lit(0)).withColumn("claim", F.when(F.col("source_size") > 0, F.col("target") * count / F.col("source_size")).otherwise(0.0))
    seats = round(claims.agg(F.coalesce(F.sum("claim"), F.lit(0.0))).first()[0])
    quotas = apportion(claims, ["all"], "claim", F.lit(seats), ["source"])
    shards = quotas.select("source", "quota", F.ceil(F.col("source_size") / words).cast("long").alias("blocks"), "source_size").where("blocks > 0")
    shards = shards.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("blocks") - 1) / shard_blocks).cast("long"))).alias("shard"))
    shards = shards.withColumn("n", F.least(F.lit(shard_blocks), F.col("blocks") - F.col("shard") * shard_blocks).cast("long"))
    shards = apportion(shards.withColumnRenamed("quota", "seats"), ["source"], "n", F.col("seats"), ["shard"])
    shards = shards.withColumn("quota", F.least(F.col("quota"), F.col("n") * most))

    # blocks taken, and how often
    chosen = Window.partitionBy("source", "shard").orderBy("draw", "block")
    blocks = shards.select("source", "shard", "n", "quota", F.explode(F.sequence(F.col("shard") * shard_blocks, F.col("shard") * shard_blocks + F.col("n") - 1)).alias("block"))
    blocks = blocks.withColumn("draw", unit(seed, F.col("source"), F.col("block"))).withColumn("rank", F.row_number().over(chosen))
    times = blocks.select("source", "block", (F.floor(F.col("quota") / F.col("n")) + F.when(F.col("rank") <= F.col("quota") % F.col("n"), 1).otherwise(0)).alias("times")).where("times > 0")

    end = F.col("start") + F.col("size")
    parts = placed.where("size > 0").withColumn("block", F.explode(F.sequence(F.floor(F.col("start") / words), F.floor((end - 1) / words))))
    parts = parts.withColumn("part", F.least(end, (F.col("block") + 1) * words) - F.greatest(F.col("start"), F.col("block") * words))
    met = parts.alias("d").join(times.alias("b"), F.col("d.source").eqNullSafe(F.col("b.source")) & (F.col("d.block") == F.col("b.block")), "left")
    # a start is one document's alone where its size is above 0
    taken = met.groupBy("d.source", "d.start").agg(F.first("d.doc_id").alias("doc_id"), F.first("d.check").alias("check"), F.first("d.size").alias("size"), F.sum(F.col("part") * F.coalesce(F.col("times"), F.lit(0))).alias("taken"))
    every = taken.select("doc_id", "source", "check", "size", "taken").unionByName(rows.where("size = 0").select("doc_id", "source", "check", "size", F.lit(0).cast("long").alias("taken")))
    out = every.alias("e").join(by_source.alias("s"), F.col("e.source").eqNullSafe(F.col("s.source")))
    return out.select("e.doc_id", "e.source", *["e.check"] * keep_check, F.col("e.size").cast("long").alias("size"), F.col("s.source_size").cast("long").alias("source_size"), F.col("s.target").alias("target"), F.col("e.taken").cast("long").alias("taken"))
