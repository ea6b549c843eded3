"""SimHash near-deduplication: fingerprints, and exact links between all of them.

Fingerprints: each bit is the majority over the XXH64 of a document's word shingles. Links: two fingerprints within ``radius``
differing bits. Documents with one fingerprint are one node, so copies never multiply.

Links are found exactly. Cut into ``blocks`` parts, fingerprints within ``radius`` bits agree on at least ``blocks - radius``
parts, so all links lie inside the buckets of equal values of some such choice of parts. The more fingerprints there are, the more
parts are taken (``parts``), so that buckets stay small: the links are the same with any number. A bucket is compared by tiles: numpy
exclusive-or and bit counts of one tile against another, tile pairs being skipped whose population counts differ by more than
the radius. A bucket of at most ``tile`` fingerprints is one tile; a larger one is cut by population count, and by hash within
a count, and each pair of its tiles is a job of its own, so no task holds a bucket. A job gives a spanning forest of its
links, never all pairs. Components are then joined by alternating large-star and small-star rounds.

Rows: a null text counts as empty and has fingerprint zero, linked like any other; null ids sort after all others, and a
component of null ids only has component_id null; repeated rows all appear; empty tables give no rows; a text of any length
is one row and is taken whole; columns other than doc_id and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scholia.llm.common import cut, hex16, salted_join

SEED = 42


def shingle_hashes(text: str | None, words: int) -> np.ndarray:
    """XXH64 of each shingle, repeats included; of the whole sequence where there are fewer words."""
    import xxhash

    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z only, ASCII white space only
    if not parts:
        return np.empty(0, np.uint64)
    joined = b" ".join(parts)
    if len(parts) <= words:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64)
    gaps = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
    starts = [0, *(gaps + 1).tolist()]
    ends = [*gaps.tolist(), len(joined)]
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[i:j], SEED) for i, j in zip(starts[: len(starts) - words + 1], ends[words - 1 :], strict=True)), np.uint64, len(starts) - words + 1)


def fingerprint(hashes: np.ndarray) -> int:
    """Bit i is 1 if set in over half the hashes."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):  # bounded memory for texts of any length
        part = np.ascontiguousarray(hashes[at : at + (1 << 16)]).astype("<u8")
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0]) if len(hashes) else 0


def fingerprints(docs: DataFrame, words: int = 4) -> DataFrame:
    """doc_id, fp (the fingerprint as a signed long)."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = np.fromiter((fingerprint(shingle_hashes(t.as_py(), words)) for t in b.column("text")), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(found.view(np.int64))], ["doc_id", "fp"])

    return docs.select("doc_id", "text").mapInArrow(each, T.StructType([docs.schema["doc_id"], T.StructField("fp", T.LongType())]))


def forest(a: np.ndarray, b: np.ndarray | None, radius: int, strip: int = 256) -> tuple[np.ndarray, np.ndarray]:
    """Edges (member, root) of a spanning forest of the links within ``a``, or between ``a`` and ``b``."""
    other = a if b is None else b
    # strips of the tile pair: rows without a neighbour, most of all, are done
    near = np.concatenate([(np.bitwise_count(a[i : i + strip, None] ^ other) <= radius).sum(axis=1) for i in range(0, len(a), strip)])
    sides = [a, other]
    left = [np.ones(len(a), bool)] * 2 if b is None else [np.ones(len(a), bool), np.ones(len(b), bool)]
    members, roots = [], []
    for i in np.flatnonzero(near > (b is None)).tolist():
        if not left[0][i]:
            continue
        left[0][i] = False
        todo = [(0, i)]
        while todo:
            side, k = todo.pop()
            far = 1 - side
            rest = np.flatnonzero(left[far])
            hit = rest[np.bitwise_count(sides[far][rest] ^ sides[side][k]) <= radius]
            if len(hit):
                left[far][hit] = False
                todo.extend((far, h) for h in hit.tolist())
                members.append(sides[far][hit])
                roots.append(np.full(len(hit), a[i]))
    return (np.concatenate(members), np.concatenate(roots)) if members else (a[:0], a[:0])


def _jobs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray | None]]:
    """Tiles (a, b) from rows sorted by job; b is None where a tile is compared with itself."""
    key, parts = None, []

    def tiles(rows: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray | None]:
        fp, side = (np.concatenate(x) for x in zip(*rows, strict=True))
        return (fp, None) if side.max() == 0 else (fp[side == 1], fp[side == 2])

    for batch in batches:
        if not batch.num_rows:
            continue
        jobs = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in ("choice", "bucket", "first", "second")], axis=1)
        fp, side = batch.column("fp").to_numpy().view(np.uint64), batch.column("side").to_numpy()
        starts = [0, *(np.flatnonzero((jobs[1:] != jobs[:-1]).any(axis=1)) + 1).tolist()]
        for s, e in zip(starts, [*starts[1:], len(fp)], strict=True):
            if key is not None and tuple(jobs[s]) != key:
                yield tiles(parts)
                parts = []
            key = tuple(jobs[s])
            parts.append((fp[s:e], side[s:e]))
    if parts:
        yield tiles(parts)


def _buckets(fp: Column, radius: int, blocks: int) -> Column:
    """Array of (choice, bucket): the values of each choice of ``blocks - radius`` parts."""
    edges = [64 * i // blocks for i in range(blocks + 1)]
    masks = [((1 << edges[i + 1]) - 1) ^ ((1 << edges[i]) - 1) for i in range(blocks)]
    out = []
    for number, chosen in enumerate(combinations(range(blocks), blocks - radius)):
        mask = sum(masks[i] for i in chosen)
        out.append(F.struct(F.lit(number).alias("choice"), fp.bitwiseAND(F.lit(mask - (1 << 64) if mask >> 63 else mask)).alias("bucket")))
    return F.array(*out)


def parts(fingerprints_: int, radius: int, bucket: int = 4096) -> int:
    """The fewest parts of 64 bits for which an average bucket of so many fingerprints has at most ``bucket``."""
    blocks = radius + 1
    while blocks < 16 and fingerprints_ >> (64 // blocks) * (blocks - radius) > bucket:
        blocks += 1
    return blocks


def links(fps: DataFrame, radius: int = 4, blocks: int = 5, tile: int = 4096) -> DataFrame:
    """Edges (a, b) that connect the distinct fingerprints ``fps.fp`` just as all links within ``radius`` bits do."""
    placed = fps.select("fp", F.bit_count("fp").alias("ones"), F.explode(_buckets(F.col("fp"), radius, blocks)).alias("x")).select("fp", "ones", "x.choice", "x.bucket")
    counted = placed.groupBy("choice", "bucket", "ones").agg(F.count(F.lit(1)).alias("n"))
    large = counted.groupBy("choice", "bucket").agg(F.sum("n").alias("total"), F.collect_list(F.struct("ones", F.ceil(F.col("n") / tile).cast("int").alias("cuts"))).alias("tiles")).where(F.col("total") > tile)
    rows = placed.join(large.select("choice", "bucket", "tiles"), ["choice", "bucket"], "left")
    whole = F.array(F.struct(F.lit(0).alias("first"), F.lit(0).alias("second"), F.lit(0).alias("side")))
    # a tile is named by its population count and its cut, in one number
    own = F.expr("ones * 1048576 + pmod(xxhash64(fp), element_at(filter(tiles, t -> t.ones = ones), 1).cuts)").cast("int")
    partners = F.expr(f"flatten(transform(filter(tiles, t -> abs(t.ones - ones) <= {radius}), t -> transform(sequence(0, t.cuts - 1), c -> cast(t.ones * 1048576 + c as int))))")
    pairs = F.transform(
        F.col("partners"),
        lambda p: F.struct(F.least(p, F.col("own")).alias("first"), F.greatest(p, F.col("own")).alias("second"), F.when(p == F.col("own"), 0).when(F.col("own") < p, 1).otherwise(2).alias("side")),
    )
    jobs = rows.withColumn("own", F.when(F.col("tiles").isNotNull(), own)).withColumn("partners", F.when(F.col("tiles").isNotNull(), partners))
    jobs = jobs.select("fp", "choice", "bucket", F.explode(F.when(F.col("tiles").isNull(), whole).otherwise(pairs)).alias("j")).select("fp", "choice", "bucket", "j.*")
    dealt = jobs.repartition("choice", "bucket", "first", "second").sortWithinPartitions("choice", "bucket", "first", "second")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for a, b in _jobs(batches):
            member, root = forest(a, b, radius)
            if len(member):
                yield pa.RecordBatch.from_arrays([pa.array(member.view(np.int64)), pa.array(root.view(np.int64))], ["a", "b"])

    return dealt.mapInArrow(compare, "a long, b long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, root (the smallest node of its component) for each node of the undirected ``edges`` (a, b).

    Large-star hangs each node's larger neighbours on its smallest, small-star its smaller ones; a round ends in a checkpoint,
    and the rounds, of which there are about log squared of the longest chain, end when each node hangs on one that hangs on none.
    Edges point from the larger node to the smaller and stay one row each: a node's smallest is among its smaller ones or itself, so
    large-star moves an edge's smaller end there, and small-star turns each edge but the smallest of its larger end.
    """
    edges = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    while True:
        ends = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select("b", F.lit(None).cast("long")))
        each = ends.groupBy("u").agg(F.coalesce(F.min("v"), F.col("u")).alias("m"), F.count("v").alias("up"), F.count_if(F.col("v").isNull()).alias("n"))
        total, up, most, moving = each.agg(*[F.coalesce(x, F.lit(0)) for x in (F.sum("up"), F.max("up"), F.max("n"))], F.count_if(F.expr("up > 1 or (up = 1 and n > 0)"))).first()
        if not moving:
            break
        large = salted_join(edges, each.where("n > 0").select(F.col("u").alias("b"), "m", "n"), "b", F.col("a"), total, most).select("a", F.col("m").alias("b"))
        if up <= max(1000, total // 1000):  # no node has more smaller neighbours than a window may hold
            small = large.withColumn("m", F.min("b").over(Window.partitionBy("a")))
        else:
            small = salted_join(large, large.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n")), "a", F.col("b"), total, up)
        edges = cut(small.select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b")).distinct())
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(edges.select("b", "b").distinct())


def components_of(docs: DataFrame, nodes: DataFrame, roots: DataFrame, node: str) -> DataFrame:
    """``docs`` (which has ``node``) with component_id, the least id of the nodes of one root; ``nodes``: node, least, n documents."""
    grouped = nodes.join(roots.select(F.col("node").alias(node), "root"), node, "left").withColumn("root", F.coalesce("root", node))
    least = grouped.groupBy("root").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("n"), F.sum("n").alias("all"), F.max("n").alias("largest"))
    sizes = least.agg(*[F.coalesce(x, F.lit(0)) for x in (F.sum("n"), F.max("n"), F.sum("all"), F.max("largest"))]).first()
    of = cut(salted_join(grouped.select(node, "root", F.col("n").alias("_rows")), least.drop("all", "largest"), "root", F.col(node), sizes[0], sizes[1]).select(node, "component_id", F.col("_rows").alias("n")))
    return salted_join(docs, of, node, F.col("doc_id"), sizes[2], sizes[3])


def near_dedup(docs: DataFrame, words: int = 4, radius: int = 4, blocks: int | None = None) -> DataFrame:
    """doc_id, fingerprint, component_id for each row of ``docs``."""
    prints = cut(fingerprints(docs, words))
    distinct = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n")))
    roots = components(links(distinct.select("fp"), radius, blocks or parts(distinct.count(), radius)))
    return components_of(prints, distinct, roots, "fp").select("doc_id", hex16(F.col("fp")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, words: int = 4, radius: int = 4) -> DataFrame:
    """The rows of ``docs`` without those that a smaller doc_id of their component stands for.

    Rows that repeat one doc_id stay together; rows of null id stay only where no other is in their component.
    """
    found = near_dedup(docs.select("doc_id", "text"), words, radius)
    dropped = found.where(F.coalesce(F.col("doc_id") != F.col("component_id"), F.col("doc_id").isNull() & F.col("component_id").isNotNull())).select(F.col("doc_id").alias("_gone")).distinct()
    return docs.join(dropped, docs["doc_id"].eqNullSafe(dropped["_gone"]), "left_anti")
