"""Sharding by a hierarchical weighted hash tree.

A tree has regions, racks and shards, each shard with a weight. A row descends from the root; at each level every child draws
-ln(u) / weight, u being a hash of the row's key and the child's name, and the lowest draw wins. So a child gets rows in
proportion to its weight, and when weights change only rows that the changed subtree wins or loses move.

A shard that is added to a finished tree (``added``) draws beside the regions, with its own weight: exponential draws of
parts of a subtree have the same law as one draw of the subtree, so this is its rack's and region's weight growing by just that
shard, and each row that moves goes to the new shard itself.

Rows: key null hashes as the text 'null' (all such rows share a shard); equal keys share a shard; an empty table gives no rows;
input columns other than the key and the text are not read, so clashing names don't matter.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scholia.llm.common import unit


@dataclass(frozen=True)
class Shard:
    shard: int
    region: int
    rack: int
    weight: float = 1.0
    #: Joined after the tree was finished.
    added: bool = False


def tree(shards: int, base: int = 40, racks: int = 4, size: int = 2) -> list[Shard]:
    """The first ``base`` shards in racks of ``size`` and regions of ``racks`` racks; later ones added, each to the region whose turn it is."""
    finished = [Shard(n, n // (size * racks), n // size) for n in range(min(base, shards))]
    regions = max(1, -(-min(base, shards) // (size * racks)))
    return finished + [Shard(n, (n - base) % regions, (n - base) % regions * racks, added=True) for n in range(base, shards)]


def _levels(shards: list[Shard]) -> list[list[tuple[str, float, int]]]:
    """Children (name, weight, node) of each inner node, the root first. A leaf's node is -1 - shard."""
    inner: list[list[tuple[str, float, int]]] = [[]]

    def hang(parent: int, members: list[Shard], levels: list[str]) -> None:
        groups: dict[int, list[Shard]] = {}
        for s in members:
            groups.setdefault(getattr(s, levels[0]), []).append(s)
        for number, group in groups.items():
            weight = float(sum(s.weight for s in group))
            if len(levels) == 1:
                inner[parent].append((f"shard{number}", weight, -1 - number))
            else:
                inner.append([])
                inner[parent].append((f"{levels[0]}{number}", weight, len(inner) - 1))
                hang(len(inner) - 1, group, levels[1:])

    hang(0, [s for s in shards if not s.added], ["region", "rack", "shard"])
    inner[0].extend((f"shard{s.shard}", float(s.weight), -1 - s.shard) for s in shards if s.added)
    return inner


def descend(key: Column, shards: list[Shard]) -> Column:
    """The shard that the key falls to. One expression; the tree is a cluster's layout, not data, so its size is bounded."""
    child = "named_struct('name', '{}', 'weight', {}D, 'node', {})"
    children = F.expr("array(" + ", ".join("array(" + ", ".join(child.format(*c) for c in node) + ")" for node in _levels(shards)) + ")")

    def draw(c: Column) -> Column:
        return F.struct((-F.log(unit("tree", key, c["name"])) / c["weight"]).alias("draw"), c["node"].alias("node"))

    def down(node: Column, _: Column) -> Column:
        return F.when(node < 0, node).otherwise(F.array_min(F.transform(F.element_at(children, node + 1), draw))["node"])

    return -1 - F.aggregate(F.sequence(F.lit(1), F.lit(3)), F.lit(0), down)


def assign(df: DataFrame, shards: list[Shard], key: str = "doc_id", to: str = "shard") -> DataFrame:
    """``df`` with the column ``to``; no shuffle."""
    return df.withColumn(to, descend(F.col(key), shards))


def slots(df: DataFrame, key: str = "doc_id", tie: list[str] | None = None, shard: str = "shard", buckets: int = 512) -> DataFrame:
    """``df`` with ``slot``: its rows' places in their shard, from 0 without gaps.

    A shard is cut into hash buckets. Counts of buckets (shards x buckets rows at most: a bound that data can't exceed, so they
    are broadcast) give each bucket's first slot; a window numbers the rows inside a bucket. No task sorts a whole shard.
    """
    drawn = F.md5(F.concat(F.lit("slot:"), F.coalesce(F.col(key).cast("string"), F.lit("null"))).cast("binary"))
    cut = df.withColumn("_b", (F.conv(F.substring(drawn, 1, 6), 16, 10).cast("int") % buckets).cast("int"))
    counts = cut.groupBy(shard, "_b").agg(F.count(F.lit(1)).alias("_n"))
    first = counts.select(shard, "_b", (F.sum("_n").over(Window.partitionBy(shard).orderBy("_b")) - F.col("_n")).alias("_first"))
    inside = Window.partitionBy(shard, "_b").orderBy(F.col(key), *[F.col(c) for c in tie or []])
    numbered = cut.withColumn("_i", F.row_number().over(inside) - 1)
    return numbered.join(F.broadcast(first), [shard, "_b"]).withColumn("slot", (F.col("_first") + F.col("_i")).cast("long")).drop("_b", "_i", "_first")


def shard_documents(docs: DataFrame, shards: int = 40) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard, region, rack for each row of documents, by the law ``key``.

    A null text counts as no bytes: its size is 16 and its checksum 0.
    """
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    now, grown = tree(shards), tree(shards + 1)
    rows = docs.select("doc_id", (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    rows = assign(rows, now)
    rows = rows.withColumn("grown_shard", descend(F.col("doc_id"), grown))
    placed = {s.shard: s for s in now}
    region = F.element_at(F.array(*[F.lit(placed[n].region) for n in range(shards)]), F.col("shard") + 1)
    rack = F.element_at(F.array(*[F.lit(placed[n].rack) for n in range(shards)]), F.col("shard") + 1)
    return slots(rows, tie=["text_crc32", "size"]).select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard", region.alias("region"), rack.alias("rack"))
