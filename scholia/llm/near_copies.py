"""Near copies: documents whose word shingles have a Jaccard similarity of ``least`` or more, as connected components.

Documents with one set of shingles are one node. Candidates are, first, nodes whose SimHash fingerprints operator 5's tiles link,
and, as few pairs of similarity 0.8 lie within ``RADIUS`` bits, nodes that share a MinHash band: of ``BANDS`` bands of ``ROWS`` minima
each, a pair of similarity 0.8 shares at least one with probability 0.9999. Each link is verified on both whole sets (of XXH64).

A band's value shared by many nodes is compared as ``STARS`` stars around nodes of it, others in each band; nodes that
are then in one component need no more comparisons. Nodes of values that still reach over several components, such as those of
texts that share a long passage and little else, get ``SHARP`` bands of ``SHARP_ROWS`` minima: a pair of similarity 0.8 shares at
least one with probability 0.99998, one of 0.5 with probability 0.09. Sharp values of several components are joined to groups, and
each group is compared by tiles of about ``TILE`` nodes or ``TILE_BYTES`` of text: a pair of tiles is a job, which compares its
sets in place and gives links only. It verifies on whole sets the pairs of which at least ``FIRST`` of the first 192 and ``SECOND``
of all minima agree, which a pair of similarity 0.8 fails with a probability of some two in a million. So candidates do not
become rows, and a node's text is shipped once for each tile of its group.

Rows: null and wordless texts have the empty set and are copies of each other; null ids sort after all others, and a component of
null ids only has component_id null; repeated rows all appear; empty tables give no rows; columns other than doc_id and text are
not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scholia.llm.common import cut
from scholia.llm.simhash import components, components_of, fingerprint, links, parts, shingle_hashes

#: Bits in which fingerprints of a pair may differ.
RADIUS = 4
BANDS, ROWS = 32, 6
STARS = 2
#: Members that are compared with one copy of a hub's text in one task.
TOGETHER = 256
SHARP, SHARP_ROWS = 96, 10
#: Nodes, and bytes of text, of a group that are compared with those of another tile in one job.
TILE, TILE_BYTES = 1024, 1 << 25
#: Of the first 192 and of all 960 sharp minima, how many of a pair's have to agree: 4.6 and 5 standard deviations under 0.8 of them.
FIRST, SECOND = 128, 706


def _functions(seed: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Salts and odd factors of ``n`` random functions."""
    r = np.random.default_rng(seed)
    return r.integers(1, 1 << 63, n, dtype=np.uint64), r.integers(1, 1 << 63, n, dtype=np.uint64) | np.uint64(1)


_WIDE_FUNCTIONS, _SHARP_FUNCTIONS = _functions(17, BANDS * ROWS), _functions(18, SHARP * SHARP_ROWS)


def shingles(text: str | None, words: int) -> np.ndarray:
    return np.unique(shingle_hashes(text, words))


def node(found: np.ndarray) -> int:
    """A signed 64-bit name of a set of shingles."""
    import xxhash

    x = xxhash.xxh3_64_intdigest(found.tobytes())
    return x - (1 << 64) if x >> 63 else x


def minima(found: np.ndarray, functions: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The least value of each function over a set."""
    salts, odd = functions
    least = np.full(len(salts), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(found), 256):  # bounded memory for texts of any length
        np.minimum(least, ((found[at : at + 256, None] ^ salts) * odd).min(axis=0), out=least)
    return least


def keys_of(least: np.ndarray, rows: int) -> np.ndarray:
    """One signed value for each ``rows`` minima."""
    key = np.zeros(len(least) // rows, np.uint64)
    for column in least.reshape(-1, rows).T:
        key = (key ^ column) * np.uint64(0xD6E8FEB86659FD93)
        key ^= key >> np.uint64(31)
    return key.view(np.int64)


def bands(found: np.ndarray) -> np.ndarray:
    """One signed value for each band; none for the empty set."""
    return keys_of(minima(found, _WIDE_FUNCTIONS), ROWS) if len(found) else np.empty(0, np.int64)


def signature(found: np.ndarray) -> np.ndarray:
    """A byte of each sharp minimum."""
    return (minima(found, _SHARP_FUNCTIONS) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(56)).astype(np.uint8)


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both) if len(a) or len(b) else 1.0


def _prints(docs: DataFrame, words: int) -> DataFrame:
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = (shingles(t.as_py(), words) for t in b.column("text"))
            rows = [(node(s), bands(s), fingerprint(s)) for s in sets]
            prints = pa.array(np.array([r[2] for r in rows], np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("copy"), pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.list_(pa.int64())), prints], ["doc_id", "copy", "node", "keys", "fp"])

    return docs.select("doc_id", "text", F.xxhash64("text").alias("copy")).mapInArrow(each, T.StructType([docs.schema["doc_id"], T.StructField("copy", T.LongType()), T.StructField("node", T.LongType()), T.StructField("keys", T.ArrayType(T.LongType())), T.StructField("fp", T.LongType())]))


def _texts(docs: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """node, text of the wanted nodes, one row each."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([node(shingles(t.as_py(), words)) for t in b.column("text")], pa.int64()), b.column("text")], ["node", "text"])

    return docs.select("text").mapInArrow(each, "node long, text string").join(wanted, "node", "left_semi").groupBy("node").agg(F.any_value("text").alias("text"))


def _verified(pairs: DataFrame, texts: DataFrame, words: int, least: float) -> DataFrame:
    """The pairs (a, b) whose sets are at least so similar; b's text is dealt once for each ``TOGETHER`` of its pairs."""
    dealt = pairs.join(pairs.groupBy("b").agg(F.ceil(F.count(F.lit(1)) / TOGETHER).alias("parts")), "b").select("a", "b", F.pmod(F.xxhash64("a"), "parts").alias("part"))
    dealt = cut(dealt)
    hubs = dealt.select("b", "part").distinct().join(texts.withColumnRenamed("node", "b"), "b").select("b", "part", F.lit(None).cast("long").alias("a"), "text")
    members = dealt.join(texts.withColumnRenamed("node", "a"), "a").select("b", "part", "a", "text")
    rows = hubs.unionByName(members).repartition("b", "part").sortWithinPartitions("b", "part", F.col("a").asc_nulls_first())

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hub = np.empty(0, np.uint64)
        for batch in batches:
            found = []
            for b, a, text in zip(batch.column("b").to_pylist(), batch.column("a").to_pylist(), batch.column("text"), strict=True):
                own = shingles(text.as_py(), words)
                if a is None:
                    hub = own
                elif similarity(own, hub) >= least:
                    found.append((a, b))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*found, strict=True)], ["a", "b"])

    return rows.mapInArrow(each, "a long, b long")


def _sharp(nodes: DataFrame, texts: DataFrame, words: int) -> DataFrame:
    """node, root, size (bytes of text), keys (an array: a value for each sharp band) of ``nodes`` (node, root)."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = [keys_of(minima(shingles(t.as_py(), words), _SHARP_FUNCTIONS), SHARP_ROWS) for t in b.column("text")]
            sizes = pa.array([len(t.as_buffer()) for t in b.column("text")], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("node"), b.column("root"), sizes, pa.array(keys, pa.list_(pa.int64()))], ["node", "root", "size", "keys"])

    return nodes.join(texts, "node").select("node", "root", "text").mapInArrow(each, "node long, root long, size long, keys array<long>")


def links_of(sets: list[np.ndarray], roots: list[int], split: int, least: float) -> list[tuple[int, int]]:
    """Pairs of sets that connect ``roots`` just as all links between the first ``split`` sets and the others do (or, if ``split`` is 0, among all)."""
    parent = {root: root for root in roots}

    def top(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    marks = np.array([signature(s) for s in sets], np.uint8)
    early, own, sizes = np.ascontiguousarray(marks[:, :192]), np.array(roots, np.int64), np.array([len(s) for s in sets])
    out = []
    for i in range(split or len(sets)):
        begin = split or i + 1
        some = begin + np.flatnonzero((own[begin:] != own[i]) & (np.minimum(sizes[begin:], sizes[i]) >= least * np.maximum(sizes[begin:], sizes[i])))
        some = some[np.count_nonzero(early[some] == early[i], axis=1) >= FIRST]
        some = some[np.count_nonzero(marks[some] == marks[i], axis=1) >= SECOND]
        for j in some.tolist():
            a, b = top(roots[i]), top(roots[j])
            if a != b and similarity(sets[i], sets[j]) >= least:
                parent[a] = b
                out.append((i, j))
    return out


def _tiled(left: DataFrame, texts: DataFrame, words: int, least: float) -> DataFrame:
    """Pairs (a, b) of different roots with a link between their nodes among ``left`` (band, key, node, root), found within groups of shared sharp values."""
    nodes = cut(_sharp(left.select("node", "root").distinct(), texts, words))
    placed = nodes.select("node", "root", F.posexplode("keys").alias("band", "key"))
    hubs = placed.groupBy("band", "key").agg(F.min("node").alias("hub"), F.min("root").alias("x"), F.max("root").alias("y")).where("x <> y").select("band", "key", "hub")
    groups = components(placed.join(hubs, ["band", "key"]).select(F.col("node").alias("a"), F.col("hub").alias("b")))
    members = cut(nodes.select("node", "root", "size").join(groups.select("node", F.col("root").alias("group")), "node"))
    sizes = members.groupBy("group").agg(F.ceil(F.greatest(F.count(F.lit(1)) / TILE, F.sum("size") / TILE_BYTES)).cast("int").alias("tiles"))
    own = F.pmod(F.xxhash64("node"), F.col("tiles")).cast("int")
    dealt = members.join(sizes, "group").withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    jobs = dealt.select("group", F.least("own", "other").alias("first"), F.greatest("own", "other").alias("second"), "own", "node", "root")
    rows = jobs.join(texts, "node").repartition("group", "first", "second").sortWithinPartitions("group", "first", "second", "own")

    def linked(job: list[tuple[int, int, np.ndarray]]) -> list[tuple[int, int]]:
        if len({root for _, root, _ in job}) < 2:
            return []
        own, roots, sets = (list(x) for x in zip(*job, strict=True))
        split = own.index(own[-1])  # 0 where a tile is compared with itself, or where the other tile is empty
        return [(roots[i], roots[j]) for i, j in links_of(sets, roots, split, least)]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, job = None, []
        for batch in batches:
            found = []
            columns = [batch.column(c).to_pylist() for c in ("group", "first", "second", "own", "root")]
            for (group, first, second, own, root), text in zip(zip(*columns, strict=True), batch.column("text"), strict=True):
                if (group, first, second) != key:
                    found += linked(job)
                    key, job = (group, first, second), []
                job.append((own, root, shingles(text.as_py(), words)))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*found, strict=True)], ["a", "b"])
        if found := linked(job):
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*found, strict=True)], ["a", "b"])

    return rows.mapInArrow(each, "a long, b long")


def _fingerprint_pairs(nodes: DataFrame) -> DataFrame:
    """Pairs (a, b) that connect the nodes just as all pairs of fingerprints (``nodes.fp``) within ``RADIUS`` bits do, by operator 5's tiles."""
    distinct = cut(nodes.groupBy("fp").agg(F.min("node").alias("hub")))
    near = links(distinct.select("fp"), RADIUS, parts(distinct.count(), RADIUS))
    hub = lambda c: distinct.select(F.col("fp").alias(c), F.col("hub").alias(f"{c}_hub"))
    between = near.join(hub("a"), "a").join(hub("b"), "b").select(F.col("a_hub").alias("a"), F.col("b_hub").alias("b"))
    return between.unionByName(nodes.join(distinct, "fp").select(F.col("node").alias("a"), F.col("hub").alias("b")))


def _roots(nodes: DataFrame, docs: DataFrame, words: int, least: float) -> DataFrame:
    """node, root for each node that is linked to another."""
    placed = nodes.select("node", F.posexplode("keys").alias("band", "key"))
    shared = placed.groupBy("band", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    live = cut(placed.join(shared.select("band", "key"), ["band", "key"], "left_semi"))
    pairs = _fingerprint_pairs(nodes)
    if STARS:
        draws = [F.min_by("node", F.xxhash64(F.lit(number), "band", "node")) for number in range(STARS)]
        centres = live.groupBy("band", "key").agg(F.array_distinct(F.array(*draws)).alias("hubs"))
        pairs = pairs.unionByName(live.join(centres, ["band", "key"]).select(F.col("node").alias("a"), F.explode("hubs").alias("b")))
    pairs = cut(pairs.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    wanted = live.select("node").unionByName(pairs.select(F.explode(F.array("a", "b")).alias("node"))).distinct()
    texts = cut(_texts(docs, wanted, words))
    first = components(_verified(pairs, texts, words, least))
    now = live.join(first, "node", "left").withColumn("root", F.coalesce("root", "node"))
    now = cut(now)
    apart = now.groupBy("band", "key").agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x <> y")
    now = cut(now.join(apart.select("band", "key"), ["band", "key"], "left_semi"))
    later = components(_tiled(now, texts, words, least)).select(F.col("node").alias("root"), F.col("root").alias("later"))
    both = first.unionByName(later.select(F.col("root").alias("node"), "root")).distinct()
    return both.join(later, "root", "left").select("node", F.coalesce("later", "root").alias("root"))


def near_copies(docs: DataFrame, words: int = 5, least: float = 0.8) -> DataFrame:
    """doc_id, node, component_id for each row of ``docs``."""
    prints = cut(_prints(docs, words))
    nodes = cut(prints.groupBy("node").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n"), F.any_value("keys").alias("keys"), F.any_value("fp").alias("fp")))
    roots = _roots(nodes.select("node", "keys", "fp"), docs, words, least)
    return components_of(prints.select("doc_id", "copy", "node"), nodes.select("node", "least", "n"), roots, "node").select("doc_id", "node", "component_id", "copy")


def keep_one(docs: DataFrame, words: int = 5, least: float = 0.8) -> DataFrame:
    """The rows of ``docs`` without those that a smaller doc_id of their component stands for.

    Rows that repeat one doc_id and text stay or go together, those of one id and different texts each by their own component; rows
    of null id stay only where no other is in their component.
    """
    found = near_copies(docs.select("doc_id", "text"), words, least)
    gone = F.coalesce(F.col("doc_id") != F.col("component_id"), F.col("doc_id").isNull() & F.col("component_id").isNotNull())
    dropped = found.where(gone).select(F.col("doc_id").alias("_gone"), F.col("copy").alias("_copy")).distinct()
    return docs.join(dropped, docs["doc_id"].eqNullSafe(dropped["_gone"]) & (F.xxhash64(docs["text"]) == dropped["_copy"]), "left_anti")
