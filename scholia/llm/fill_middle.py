"""Fill-in-middle: a text is cut in prefix, middle and suffix at token boundaries and written with the middle last.

The cuts are found in a wavelet matrix over the classes of a text's bytes. A token is a word with the white space before it, or the
white space at the end, so a boundary lies before each white space that follows a word. Ranks of the classes combine into counts:
words begun (FIRST), boundaries passed (ENDING), code points (all but MORE). A cut after k tokens is the k-th ENDING, found by
bisection on its rank, or the end of the text. The matrix keeps three bit rows with a running count for every 64 bits, so a text of
n bytes needs about n bytes beside itself and a rank reads three words.

Sizes of the cuts are drawn from a hash of seed and id, so that they do not depend on partitions or reruns. The parts are marked by
sentinels; a text that holds one already stays plain, so ``restore`` gives back every text exactly.

Rows: a null or empty text is plain; texts of any length are cut whole; a null id is drawn as the text 'null'; equal ids draw alike;
repeated rows stay; an empty table gives no rows; only id and text are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
#: Classes of bytes: white space after white space (or at the start); white space after a word; first byte of a word; first byte of a later code point of a word; a byte that continues a code point.
BLANK, ENDING, FIRST, LATER, MORE = range(5)
LEVELS = 3


def classes(text: bytes) -> np.ndarray:
    data = np.frombuffer(text, np.uint8)
    space = (data == 32) | ((data >= 9) & (data <= 13))
    before = np.ones(len(data), bool)
    before[1:] = space[:-1]
    out = np.where(space, np.where(before, BLANK, ENDING), np.where(before, FIRST, LATER)).astype(np.uint8)
    out[(data & 0xC0) == 0x80] = MORE
    return out


class WaveletMatrix:
    """Rows of bits, the highest of the class first; after each row classes are parted stably into zeros and ones."""

    def __init__(self, values: np.ndarray, levels: int = LEVELS):
        self.n, self.levels = len(values), levels
        self.words: list[np.ndarray] = []
        self.before: list[np.ndarray] = []
        self.zeros: list[int] = []
        for level in reversed(range(levels)):
            bit = (values >> level & 1).astype(bool)
            packed = np.packbits(bit, bitorder="little")
            words = np.zeros(len(bit) // 64 + 1, np.uint64)
            words.view(np.uint8)[: len(packed)] = packed
            self.words.append(words)
            self.before.append(np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.int64)]))
            self.zeros.append(int(len(bit) - self.before[-1][-1]))
            values = np.concatenate([values[~bit], values[bit]])

    def _ones(self, row: int, p: int) -> int:
        word = int(self.words[row][p >> 6]) & ((1 << (p & 63)) - 1)
        return int(self.before[row][p >> 6]) + word.bit_count()

    def rank(self, value: int, p: int) -> int:
        """How many of the first ``p`` are ``value``."""
        low, high = 0, p
        for row in range(self.levels):
            a, b = self._ones(row, low), self._ones(row, high)
            one = value >> (self.levels - 1 - row) & 1
            low, high = (self.zeros[row] + a, self.zeros[row] + b) if one else (low - a, high - b)
        return high - low

    def select(self, value: int, k: int) -> int:
        """Where the ``k``-th (from 1) ``value`` is; n if there are fewer."""
        low, high = 0, self.n
        while low < high:
            middle = (low + high) // 2
            if self.rank(value, middle + 1) >= k:
                high = middle
            else:
                low = middle + 1
        return low

    def code_points(self, p: int) -> int:
        return p - self.rank(MORE, p)

    def tokens(self) -> int:
        """Words, and one more if white space ends the text."""
        open_end = self.rank(FIRST, self.n) == self.rank(ENDING, self.n)
        return self.rank(FIRST, self.n) + int(self.n > 0 and open_end)

    def cut_after(self, k: int) -> int:
        """The byte at which ``k`` tokens are over."""
        if k <= 0:
            return 0
        return self.select(ENDING, k)


@dataclass(frozen=True)
class Rates:
    """Percentages of texts that are rewritten, and of those that put the suffix first."""

    rewritten: int = 50
    suffix_first: int = 80
    seed: int = 42


def draws(seed: int, key: str) -> list[int]:
    digest = hashlib.sha256(f"{seed}:{key}".encode()).hexdigest()
    return [int(digest[i : i + 8], 16) for i in range(0, 32, 8)]


@dataclass(frozen=True)
class Rewritten:
    n: int
    form: str
    prefix_chars: int | None
    middle_chars: int | None
    output: bytes


def rewrite(text: bytes, key: str, rates: Rates = Rates()) -> Rewritten:
    """One text in its form: ``plain``, ``psm`` (prefix, suffix, middle) or ``spm`` (suffix, prefix, middle)."""
    matrix = WaveletMatrix(classes(text))
    n = matrix.tokens()
    first, second, whether, which = draws(rates.seed, key)
    if not text or any(s in text for s in (PREFIX, SUFFIX, MIDDLE)) or whether % 100 >= rates.rewritten:
        return Rewritten(n, "plain", None, None, text)
    i, j = (matrix.cut_after(k) for k in sorted((first % (n + 1), second % (n + 1))))
    at_i, at_j = matrix.code_points(i), matrix.code_points(j)
    prefix, middle, suffix = text[:i], text[i:j], text[j:]
    if which % 100 < rates.suffix_first:
        return Rewritten(n, "spm", at_i, at_j - at_i, SUFFIX + suffix + PREFIX + prefix + MIDDLE + middle)
    return Rewritten(n, "psm", at_i, at_j - at_i, PREFIX + prefix + SUFFIX + suffix + MIDDLE + middle)


def restore(output: bytes, form: str) -> bytes:
    """The text that ``rewrite`` was given. Parts hold no sentinel, so the first of each kind is the one written."""
    if form == "plain":
        return output
    lead, inner = (PREFIX, SUFFIX) if form == "psm" else (SUFFIX, PREFIX)
    one, rest = output.removeprefix(lead).split(inner, 1)
    two, middle = rest.split(MIDDLE, 1)
    return one + middle + two if form == "psm" else two + middle + one


def fill_middle(docs: DataFrame, rates: Rates = Rates(), text: str = "text") -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars and ``output`` (binary) for each row of ``docs``."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [rewrite(t.as_py() or b"", "null" if k is None else k, rates) for t, k in zip(b.column("_text"), b.column("_id").to_pylist(), strict=True)]
            numbers = [pa.array([getattr(m, c) for m in made], pa.int64()) for c in ("n", "prefix_chars", "middle_chars")]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), numbers[0], pa.array([m.form for m in made], pa.string()), *numbers[1:], pa.array([m.output for m in made], pa.binary())], ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    schema = T.StructType([docs.schema["doc_id"], T.StructField("n", T.LongType()), T.StructField("form", T.StringType()), T.StructField("prefix_chars", T.LongType()), T.StructField("middle_chars", T.LongType()), T.StructField("output", T.BinaryType())])
    return docs.select("doc_id", F.col("doc_id").cast("string").alias("_id"), F.col(text).cast("string").cast("binary").alias("_text")).mapInArrow(each, schema)


def restored(rows: DataFrame) -> DataFrame:
    """``rows`` of ``fill_middle`` with ``restored`` (binary), the text rebuilt from output and form alone."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [restore(o.as_py(), f) for o, f in zip(b.column("output"), b.column("form").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(texts, pa.binary())], [*b.schema.names, "restored"])

    return rows.mapInArrow(each, T.StructType([*rows.schema.fields, T.StructField("restored", T.BinaryType())]))
