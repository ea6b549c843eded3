"""Merkle manifest of a dataset: a log of tree nodes in the order in which they are finished, and proofs read from it.

Each group (a language) has a tree over its rows' digests, in the order of their ids; the groups' roots have one tree above. A
node is the SHA-256 of its children's hexadecimal digests; a last node without a partner becomes the digest of itself alone.

Builders. Rows are numbered in their group without a task that holds a group: a range partitioning by group and id, places within
partitions, and the partitions' counts. A builder then takes an aligned run of 2**HEIGHT rows, whatever the group's size, and
appends its nodes to a log as they are finished: after each leaf, all nodes that this leaf completes, lowest first. That is the
tree's postorder. Runs' roots are the leaves of the next tier, until one run of a group is left.

Addresses. In a log of n leaves a full node (height h, index i) lies at ``2 s - popcount(s) + h`` with s = (i + 1) 2**h - 1, the
leaves before its last one: a subtree of 2**j leaves has 2**(j+1) - 1 nodes, and s is a sum of such. Nodes with too few leaves
come last, by height. So siblings are read by position, without search. Proofs go down the tiers: a run's path to the root is known
before its leaves', and a leaf's path is its siblings in its run, then the run's path.

Rows: a null id comes first, equal ids are ordered by their digests and equal rows are interchangeable; a null group is a group; null
fields are written ``-``; a text counts whole; groups of any size, one row too; an empty table gives no rows; columns other than the
fields are not read. A run has 2**HEIGHT rows at most, so no task holds a group, and logs are tables in the shared folder.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scholia.llm.common import scratch

HEIGHT = 8
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]
LEFT, RIGHT, ALONE = b"L", b"R", b"A"
STEP = 33


def node(*children: bytes) -> bytes:
    """The digest of one or two children, as hexadecimal text."""
    return hashlib.sha256("".join(c.hex() for c in children).encode()).digest()


def height(leaves: int) -> int:
    """Levels above the leaves until one node is left."""
    return max(leaves - 1, 0).bit_length()


def position(h: int, i: int, leaves: int) -> int:
    """Where the node of height ``h`` and index ``i`` lies in the log of a tree of so many leaves."""
    if (i + 1) << h <= leaves:
        last = ((i + 1) << h) - 1
        return 2 * last - last.bit_count() + h
    full = 2 * leaves - leaves.bit_count()
    lowest = (leaves & -leaves).bit_length()  # the first height at which the last node has too few leaves
    return full + h - lowest


def append_all(leaves: list[bytes], top: int) -> bytes:
    """The log of a tree over ``leaves`` up to height ``top``: nodes as they are finished."""
    log: list[bytes] = []
    waiting: list[list[bytes]] = [[] for _ in range(top + 1)]

    def finish(h: int, digest: bytes) -> None:
        log.append(digest)
        if h < top:
            waiting[h].append(digest)
            if len(waiting[h]) == 2:
                pair = waiting[h][:]
                waiting[h].clear()
                finish(h + 1, node(*pair))

    for leaf in leaves:
        finish(0, leaf)
    for h in range(top):
        if waiting[h]:
            alone = waiting[h].pop()
            finish(h + 1, node(alone))
    return b"".join(log)


def path(log: bytes, leaf: int, leaves: int, top: int) -> bytes:
    """Steps from a leaf to the top: a side (L, R, or A for alone) and the sibling's 32 bytes (none are zeros)."""
    steps, i, n = [], leaf, leaves
    for h in range(top):
        sibling = i ^ 1
        if sibling < n:
            at = 32 * position(h, sibling, leaves)
            steps.append((LEFT if sibling < i else RIGHT) + log[at : at + 32])
        else:
            steps.append(ALONE + bytes(32))
        i, n = i // 2, (n + 1) // 2
    return b"".join(steps)


def steps(path: bytes) -> Iterator[tuple[bytes, bytes]]:
    for at in range(0, len(path), STEP):
        yield path[at : at + 1], path[at + 1 : at + STEP]


def fold(leaf: bytes, path: bytes) -> bytes:
    """The root that a leaf and its path lead to."""
    for side, other in steps(path):
        leaf = node(other, leaf) if side == LEFT else node(leaf, other) if side == RIGHT else node(leaf)
    return leaf


def proof_digest(path: bytes) -> bytes:
    """SHA-256 of the siblings' hexadecimal digests, lowest first."""
    return hashlib.sha256("".join(other.hex() for side, other in steps(path) if side != ALONE).encode()).digest()


def written(*fields: Column) -> Column:
    """Fields as text: ``-`` for null, else the count of UTF-8 bytes, a colon and the value."""
    texts = [f.cast("string") for f in fields]
    return F.concat(*[F.when(t.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t)) for t in texts])


def leaf_digest(*fields: Column) -> Column:
    return F.unhex(F.sha2(written(*fields).cast("binary"), 256))


def _saved(df: DataFrame, label: str) -> DataFrame:
    """``df`` as a table in the shared folder: a lost executor costs no rows, and numbers given to rows stay."""
    where = scratch(df.sparkSession, label)
    df.write.parquet(where)
    return df.sparkSession.read.parquet(where)


def numbered(rows: DataFrame, group: str, order: list[str], most_broadcast: int = 200_000) -> tuple[DataFrame, int]:
    """``rows`` with ``_i``, their place in their group by ``order``, and ``_n``, the group's rows; and the most rows of a group.

    Rows are dealt to ranges of (group, order) with a row number as the last key, so that equal rows part too. Within a range
    the places run on; counts of ranges (one row for each range and group in it) give where each begins. ``group`` holds no nulls.
    """
    frozen = _saved(rows.withColumn("_row", F.monotonically_increasing_id()), "leaves")
    keys = [F.col(group).asc(), *[F.col(c).asc_nulls_first() for c in order], F.col("_row").asc()]
    ranged = frozen.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_at", F.monotonically_increasing_id())
    ranged = _saved(ranged.withColumn("_part", F.shiftright("_at", 33)).drop("_row"), "ranged")
    part = _saved(ranged.groupBy(group, "_part").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_c")), "ranges")
    of = Window.partitionBy(group)  # a row for each range that the group touches
    offsets = part.select(group, "_part", "_first", (F.sum("_c").over(of.orderBy("_part")) - F.col("_c")).alias("_before"), F.sum("_c").over(of).alias("_n"))
    ranges, most = part.groupBy(group).agg(F.count(F.lit(1)).alias("_r"), F.sum("_c").alias("_c")).agg(F.coalesce(F.sum("_r"), F.lit(0)), F.coalesce(F.max("_c"), F.lit(0))).first()
    met = ranged.join(F.broadcast(offsets) if ranges <= most_broadcast else offsets, [group, "_part"])
    return met.withColumn("_i", F.col("_before") + F.col("_at") - F.col("_first")).drop("_part", "_at", "_first", "_before"), most


def build(leaves: DataFrame) -> DataFrame:
    """One row for each aligned run of leaves (_group, _i, _n, _digest): _group, _run, _leaves, _top, _log, _root, and _n, the group's runs."""

    def builder(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        digests, n = rows.sort_values("_i")["_digest"].tolist(), int(rows["_n"].iloc[0])
        top = height(n) if n <= 1 << HEIGHT else HEIGHT
        log = append_all(digests, top)
        return pd.DataFrame({"_group": [key[0]], "_run": [key[1]], "_leaves": [len(digests)], "_top": [top], "_log": [log], "_root": [log[-32:]], "_n": [(n + (1 << HEIGHT) - 1) >> HEIGHT]})

    kept = leaves.select("_group", F.shiftright("_i", HEIGHT).alias("_run"), "_i", "_n", "_digest")
    return _saved(kept.groupBy("_group", "_run").applyInPandas(builder, "_group string, _run long, _leaves int, _top int, _log binary, _root binary, _n long"), "runs")


def tiers(leaves: DataFrame, most: int) -> list[DataFrame]:
    """Tables of runs, the lowest first, until one run is left in each group. A group that is done stays one run of one leaf, whose log is its root."""
    out = [build(leaves)]
    while most > 1 << HEIGHT:
        most = (most + (1 << HEIGHT) - 1) >> HEIGHT
        out.append(build(out[-1].select("_group", F.col("_run").alias("_i"), "_n", F.col("_root").alias("_digest"))))
    return out


def descend(built: list[DataFrame], above: DataFrame) -> DataFrame:
    """``above`` (_group, _run = 0, _path and more for each group) carried down to the runs of the lowest tier."""
    more = [c for c in above.columns if c not in ("_group", "_run", "_path")]

    def extract(runs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in runs:
            rows = [(r["_group"], (r["_run"] << HEIGHT) + i, path(r["_log"], i, r["_leaves"], r["_top"]) + r["_path"], *(r[c] for c in more)) for r in batch.to_dict("records") for i in range(r["_leaves"])]
            yield pd.DataFrame(rows, columns=["_group", "_run", "_path", *more])

    for tier in reversed(built[1:]):
        above = _saved(tier.join(above, ["_group", "_run"]).mapInPandas(extract, above.select("_group", "_run", "_path", *more).schema), "paths")
    return above


@dataclass(frozen=True)
class Manifest:
    """``leaves``: the rows with _group, _run, _i and _digest. ``runs``: the lowest tier with each run's _path to the root of all, _subroot and _all, the root."""

    leaves: DataFrame
    runs: DataFrame
    #: _group, _root and _path of each group.
    groups: DataFrame


def manifest(docs: DataFrame, fields: list[str] | None = None, group: str = "lang", order: str = "doc_id", more: dict[str, Column] | None = None) -> Manifest:
    """The logs over all rows of ``docs``; ``more`` columns are carried beside the leaves."""
    named = F.when(F.col(group).isNull(), F.lit("-")).otherwise(F.concat(F.lit("="), F.col(group).cast("string")))
    rows = docs.select(named.alias("_group"), F.col(order).alias("_order"), leaf_digest(*[F.col(c) for c in fields or FIELDS]).alias("_digest"), *[c.alias(n) for n, c in (more or {}).items()])
    leaves, most = numbered(rows, "_group", ["_order", "_digest"])
    leaves = _saved(leaves.withColumn("_run", F.shiftright("_i", HEIGHT)), "placed")
    built = tiers(leaves, most)
    roots = built[-1].select(F.lit("").alias("_group"), F.col("_group").alias("_name"), F.col("_root").alias("_digest"))
    subroots, groups = numbered(roots, "_group", ["_name"])
    upper = tiers(subroots.withColumn("_run", F.shiftright("_i", HEIGHT)), groups)
    top = upper[-1].select("_group", F.lit(0).cast("long").alias("_run"), F.lit(b"").alias("_path"), F.col("_root").alias("_all"))
    runs = upper[0].join(descend(upper, top), ["_group", "_run"])
    placed = subroots.select("_name", "_digest", "_i")

    def extract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [((r["_run"] << HEIGHT) + i, path(r["_log"], i, r["_leaves"], r["_top"]) + r["_path"], r["_all"]) for r in batch.to_dict("records") for i in range(r["_leaves"])]
            yield pd.DataFrame(rows, columns=["_i", "_path", "_all"])

    known = _saved(placed.join(runs.mapInPandas(extract, "_i long, _path binary, _all binary"), "_i").select(F.col("_name").alias("_group"), F.lit(0).cast("long").alias("_run"), "_path", F.col("_digest").alias("_subroot"), "_all"), "groups")
    return Manifest(leaves, built[0].join(descend(built, known), ["_group", "_run"]), known)


def proofs(made: Manifest, more: dict[str, str], candidate: str | None = None) -> DataFrame:
    """For each row: leaf, subroot, root, proof_sha256, folded_root and the carried columns ``more`` (name to type).

    ``folded_root`` is what the column ``candidate`` (a digest, the leaf's own where null) and the siblings in the logs lead to.
    """
    carried = list(more)

    def extract(leaves: pd.DataFrame, run: pd.DataFrame) -> pd.DataFrame:
        r = run.to_dict("records")[0]
        out = []
        for row in leaves.to_dict("records"):
            steps_up = path(r["_log"], row["_i"] & ((1 << HEIGHT) - 1), r["_leaves"], r["_top"]) + r["_path"]
            claimed = row[candidate] if candidate and row[candidate] is not None else row["_digest"]
            out.append((*(row[c] for c in carried), row["_digest"].hex(), r["_subroot"].hex(), r["_all"].hex(), proof_digest(steps_up).hex(), fold(claimed, steps_up).hex()))
        return pd.DataFrame(out, columns=[*carried, "leaf", "subroot", "root", "proof_sha256", "folded_root"])

    schema = ", ".join([*(f"{n} {t}" for n, t in more.items()), *(f"{c} string" for c in ("leaf", "subroot", "root", "proof_sha256", "folded_root"))])
    rows = made.leaves.select("_group", "_run", "_i", "_digest", *dict.fromkeys([*carried, *([candidate] if candidate else [])]))
    runs = made.runs.select("_group", "_run", "_log", "_leaves", "_top", "_path", "_subroot", "_all")
    return rows.groupBy("_group", "_run").cogroup(runs.groupBy("_group", "_run")).applyInPandas(extract, schema)


def audit(docs: DataFrame, tampered: Column, changed: dict[str, Column]) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root and verified for each row: rows that are ``tampered`` prove themselves with ``changed`` fields."""
    claim = F.when(tampered, leaf_digest(*[changed.get(c, F.col(c)) for c in FIELDS]))
    made = manifest(docs, more={"id": F.col("doc_id").cast("string"), "claim": claim})
    rows = proofs(made, {"id": "string"}, candidate="claim")
    return rows.select(F.col("id").cast(docs.schema["doc_id"].dataType).alias("doc_id"), "leaf", "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def audit_documents(docs: DataFrame) -> DataFrame:
    """``audit`` with one added to n_chars where 7 divides the checksum of the id."""
    return audit(docs, F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0, {"n_chars": F.col("n_chars").cast("decimal(20,0)") + 1})
