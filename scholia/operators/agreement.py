"""How far two readings of a page agree: longest matching blocks, the edits between them, and their ratio."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

DIFFERENCE = "struct<operation: string, left_begin: int, left_end: int, right_begin: int, right_end: int, left: string, right: string>"
#: Pairs of characters up to which a range is scanned.
SCANNED = 1 << 24
#: Misses of the strings' own search before a set is made.
FEW = 16
#: Pairs of readings whose differences a task holds at once.
SLICE = 256
_BASE = np.uint64(0x9E3779B97F4A7C15)


def compact(text: str) -> str:
    """Composed, without layout: spelling, case, digits and punctuation stay."""
    return re.sub(r"\s+", "", unicodedata.normalize("NFC", text))


class Matcher:
    """Longest common blocks of two strings by sums of powers: equal blocks have equal sums, and a found block is compared in full.

    Memory is a few numbers for each character; a search for one block sorts the windows of a length some 17 times, instead of
    following every pair of equal characters. Ranges of at most ``SCANNED`` pairs of characters are searched by the strings' own
    search instead, once for each begin.
    """

    def __init__(self, a: str, b: str):
        self.left, self.right = a, b
        if len(a) * len(b) > SCANNED:
            self._summed(a, b)

    def _summed(self, a: str, b: str) -> None:
        self.a, self.b = (np.frombuffer(s.encode("utf-32-le", "surrogatepass"), np.uint32) for s in (a, b))
        n = max(len(self.a), len(self.b)) + 1
        self.powers = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, _BASE)]), dtype=np.uint64)
        self.sums = [np.concatenate([[np.uint64(0)], np.cumsum((x.astype(np.uint64) + np.uint64(1)) * self.powers[: len(x)], dtype=np.uint64)]) for x in (self.a, self.b)]
        self.last = n

    def _windows(self, side: int, low: int, high: int, size: int) -> np.ndarray:
        at = np.arange(low, high - size + 1)
        return (self.sums[side][at + size] - self.sums[side][at]) * self.powers[self.last - at]

    def _first(self, a0: int, a1: int, b0: int, b1: int, size: int) -> tuple[int, int] | None:
        """The earliest window of a (and for it of b) of that size that both ranges hold."""
        left, right = self._windows(0, a0, a1, size), self._windows(1, b0, b1, size)
        hits = np.flatnonzero(np.isin(left, right))
        for i in hits:
            for j in np.flatnonzero(right == left[i]):
                if np.array_equal(self.a[a0 + i : a0 + i + size], self.b[b0 + j : b0 + j + size]):
                    return a0 + int(i), b0 + int(j)
        return None

    def _scanned(self, a0: int, a1: int, b0: int, b1: int, most: int) -> tuple[int, int, int]:
        """As ``longest``: each begin in a is tried once, for a block longer than the best so far; after a few misses among the set of b's blocks of that size."""
        a, b, i, best, grams, missed = self.left, self.right[b0:b1], a0, (a0, b0, 0), None, 0
        while i + best[2] < a1 and best[2] < most:
            size = best[2] + 1
            piece = a[i : i + size]
            if (piece not in b) if grams is None else (piece not in grams):
                i, missed = i + 1, missed + 1
                if missed == FEW and len(b) <= a1 - i and len(b) * size <= SCANNED:
                    grams = {b[k : k + size] for k in range(len(b) - size + 1)}
                continue
            j, grams, missed = b.find(piece), None, 0
            while i + size < a1 and j + size < len(b) and a[i + size] == b[j + size]:
                size += 1
            best = (i, b0 + j, size)
        return best

    def longest(self, a0: int, a1: int, b0: int, b1: int, most: int | None = None) -> tuple[int, int, int]:
        """Begin in a, begin in b and size of the longest common block: the earliest in a, then in b; size 0 if there is none, ``most`` at most."""
        low, high, best = 0, min(a1 - a0, b1 - b0, *([] if most is None else [most])), None
        if (a1 - a0) * (b1 - b0) <= SCANNED:
            return self._scanned(a0, a1, b0, b1, high)
        while low < high:
            size = (low + high + 1) // 2
            found = self._first(a0, a1, b0, b1, size)
            if found:
                low, best = size, found
            else:
                high = size - 1
        return (*best, low) if best else (a0, b0, 0)

    def blocks(self) -> list[tuple[int, int, int]]:
        """All matching blocks in order, adjoining ones joined: the longest, then those before and behind it, which are no longer."""
        open_, found = [(0, len(self.left), 0, len(self.right), None)], []
        while open_:
            a0, a1, b0, b1, most = open_.pop()
            if a0 < a1 and b0 < b1:
                i, j, size = self.longest(a0, a1, b0, b1, most)
                if size:
                    found.append((i, j, size))
                    open_ += [(a0, i, b0, j, size), (i + size, a1, j + size, b1, size)]
        out: list[tuple[int, int, int]] = []
        for i, j, size in sorted(found):
            if out and out[-1][0] + out[-1][2] == i and out[-1][1] + out[-1][2] == j:
                out[-1] = (out[-1][0], out[-1][1], out[-1][2] + size)
            else:
                out.append((i, j, size))
        return out


def compared(left: str, right: str) -> tuple[bool, float, list[tuple]]:
    """Whether both are equal but for layout, twice the matched share of both, and what differs: replace, delete or insert, with offsets in the compact texts."""
    a, b = compact(left), compact(right)
    if a == b:
        return True, 1.0, []
    blocks = Matcher(a, b).blocks()
    differences, i, j = [], 0, 0
    for x, y, size in [*blocks, (len(a), len(b), 0)]:
        if i < x or j < y:
            kind = "replace" if i < x and j < y else "delete" if i < x else "insert"
            differences.append((kind, i, x, j, y, a[i:x], b[j:y]))
        i, j = x + size, y + size
    return False, 2 * sum(size for _, _, size in blocks) / (len(a) + len(b)), differences


def agreement(pairs: DataFrame, key: str, left: str, right: str) -> DataFrame:
    """key, exact, agreement, differences for each pair of readings. A null reading counts as empty; two empty ones agree.

    Pairs are dealt by key and texts to four tasks a core or more: they cost more time than their bytes tell, and pairs often lie together.
    """

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("operation", pa.string()), *((c, pa.int32()) for c in ("left_begin", "left_end", "right_begin", "right_end")), ("left", pa.string()), ("right", pa.string())]))
        names = [f.name for f in kind.value_type]
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                b = batch.slice(at, SLICE)
                rows = [compared(x.as_py() or "", y.as_py() or "") for x, y in zip(b.column(1), b.column(2), strict=True)]
                found = [[dict(zip(names, d, strict=True)) for d in r[2]] for r in rows]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([r[0] for r in rows]), pa.array([r[1] for r in rows], pa.float64()), pa.array(found, kind)], [key, "exact", "agreement", "differences"])

    read = pairs.select(key, F.col(left).cast("string").alias("_left"), F.col(right).cast("string").alias("_right"))
    spark = pairs.sparkSession
    dealt = read.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism), F.xxhash64(*read.columns))
    more = T.StructType.fromDDL(f"exact boolean, agreement double, differences array<{DIFFERENCE}>")
    return dealt.mapInArrow(each, T.StructType([pairs.schema[key], *more.fields]))
