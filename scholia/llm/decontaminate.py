"""Benchmark decontamination: benchmark items found in documents in spite of edits.

Texts are lower-cased and reduced to words (runs of ASCII letters and digits and of all bytes above ASCII) with one space after
each. The CGK embedding walks over a text's bytes: at each step it writes the class of the byte it stands on (a space, a letter or one
of three of digits; beyond ASCII one of 32 that the whole character and the byte's place in it give), and a random function of step and class says whether it moves on; texts at a small edit distance then differ in few steps, as the walks fall in step again soon
after an edit. Under one edit in five bytes the far end of a walk over a whole item agrees no more than by chance, so each of
``REPETITIONS`` repetitions, with its own random function, embeds an item-sized window by walks of ``STEPS`` steps that begin all
along it: wherever the repetition's random set of byte pairs, a quarter of them all, says so. ``SAMPLED`` steps of each walk are
sampled; where they are those of an item's walk, a window of the item's size is proposed, by the two walks' places. A window
that walks from ``VOTES`` cells of ``CELL`` bytes of the item propose (one, for items of under four cells), with places within
``BAND`` of the item's size, is a candidate: so one stretch that two texts share by chance is none.

Each candidate is then verified exactly: Myers' bit-vector edit distance of the item's characters against any stretch of the
window and its surroundings. A document holds an item if at most ``most`` (0.2) of the item's characters have to be edited; items
of under ``SHORT`` bytes have to be there as they are. tests/llm/test_decontaminate.py measures recall at 5, 10, 15 and 20% of
characters or words edited, at random places and evenly spread.

The items are a stated query set, taken in blocks of about ``block`` characters: a block's texts are broadcast, and each task
builds the index of their walks (some 60 bytes a character).

Rows: a null or wordless text holds nothing, a null or wordless item is nowhere; very long texts are cut into overlapping pieces;
repeated documents and items each count; several hits of one item in one document give the best one, then the first; empty
tables give no rows; other columns are not read. Ids may be of any type.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scholia.llm.common import ship, shipped

REPETITIONS, STEPS, SAMPLED, OPEN, VOTES, EARLY, CELL, BAND, SHORT = 8, 36, 8, 0.25, 3, 4, 16, 0.3, 32
PIECE = 1 << 18
#: Walks that are taken together, so that they stay in a core's cache.
TOGETHER = 1 << 15
#: Hits of walks that are expanded together.
HITS = 1 << 21
#: A band's number and a cell's fit in 36 bits: bands have 9 bytes or more, and an item fewer than 2 ** 20.
FAR = np.int64(1) << 19
MIX = np.uint64(0x9E3779B97F4A7C15)

_WORD_BYTE = np.zeros(256, bool)
_WORD_BYTE[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True


def words(low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The words' bytes with one space after each, and where each byte was."""
    inside = _WORD_BYTE[low]
    keep = inside.copy()
    keep[1:] |= inside[:-1]
    return np.where(inside, low, np.uint8(32))[keep], np.flatnonzero(keep)


def plain(text: str | None) -> bytes:
    """A text's words, single-spaced."""
    low = (text or "").lower().encode("utf-8", "surrogatepass")
    return words(np.frombuffer(low, np.uint8))[0].tobytes().rstrip(b" ")


#: Classes of bytes, of five bits: a space, each letter, three of digits. Bytes above ASCII have classes of their characters.
_CLASS = np.zeros(256, np.uint16)
_CLASS[97:123] = np.arange(1, 27)
_CLASS[48:58] = 27 + np.arange(10) % 3


def classes(text: np.ndarray) -> np.ndarray:
    """Each byte's class. A character beyond ASCII gives each of its bytes another, so a walk's bits do not depend on the script."""
    out = _CLASS.take(text)
    where = np.flatnonzero(text >= 128)
    if len(where):
        own = text[where]
        begins = (own & 0xC0) != 0x80
        begins[1:] |= where[1:] - where[:-1] > 1
        begins[0] = True  # a piece may begin within a character
        first = np.flatnonzero(begins)
        character = np.cumsum(begins) - 1
        place = (np.arange(len(own)) - first[character]).astype(np.uint64) & np.uint64(3)
        codes = np.bitwise_xor.reduceat(own.astype(np.uint64) << np.uint64(8) * place, first)
        mixed = ((codes[character] << np.uint64(2) | place) + np.uint64(1)) * MIX
        out[where] = ((mixed ^ mixed >> np.uint64(29)) * MIX >> np.uint64(59)).astype(np.uint16)
    return out


@dataclass
class Repetition:
    """The byte pairs that walks begin at; for each three steps how far a walk moves, by the three classes ahead; which threes are sampled."""

    opens: np.ndarray
    moves: np.ndarray
    sampled: np.ndarray

    def walks(self, pairs: np.ndarray, threes: np.ndarray, early: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Where walks begin in a text (as ``ahead`` gives it), and each one's samples as one number.

        ``early``: which slots the first ``EARLY`` samples of some item's walk have; other walks are given up there.
        """
        every = np.flatnonzero(self.opens.take(pairs))
        begins, keys = [every[:0]], [np.empty(0, np.int64)]
        for first in range(0, len(every), TOGETHER):
            begin = every[first : first + TOGETHER]
            at, key, samples = begin.copy(), np.zeros(len(begin), np.int64), 0
            seen, far = np.empty(len(at), np.uint16), np.empty(len(at), np.intp)
            for moves, sampled in zip(self.moves, self.sampled, strict=True):
                threes.take(at, out=seen, mode="clip")
                moves.take(seen, out=far, mode="clip")
                at += far
                if sampled:
                    key <<= 5
                    key |= seen >> np.uint16(10)
                    samples += 1
                    if samples == EARLY and early is not None:
                        stay = np.flatnonzero(early.take(_slot(key)))
                        begin, at, key = begin[stay], at[stay], key[stay]
                        seen, far = seen[: len(stay)], far[: len(stay)]
            begins.append(begin)
            keys.append(key)
        return np.concatenate(begins), np.concatenate(keys)


def _slot(key: np.ndarray) -> np.ndarray:
    return ((key.view(np.uint64) * MIX) >> np.uint64(44)).astype(np.intp)


def ahead(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """At each place of the text two bytes and, with room for walks to end in, three classes."""
    longer = np.concatenate([text, np.zeros(STEPS + 4, np.uint8)])
    pairs = longer[: len(text)].astype(np.uint16) << np.uint16(8) | longer[1 : len(text) + 1]
    c = classes(longer)
    return pairs, c[:-2] << np.uint16(10) | c[1:-1] << np.uint16(5) | c[2:]


def repetitions(seed: int = 3) -> list[Repetition]:
    """Random functions of step and class, three steps of which make one table: the walk's places are at most two classes ahead."""
    r = np.random.default_rng(seed)
    three = np.arange(1 << 15)
    classes = np.stack([three >> 10, three >> 5 & 31, three & 31])
    out = []
    for _ in range(REPETITIONS):
        moves = []
        for _ in range(STEPS // 3):
            far = np.zeros(1 << 15, np.intp)
            for step in r.integers(0, 2, (3, 32)):
                far += step[classes[far, three]]
            moves.append(far)
        sampled = np.zeros(STEPS // 3, bool)
        sampled[[0, *(1 + r.choice(STEPS // 3 - 1, SAMPLED - 1, replace=False))]] = True
        out.append(Repetition(r.random(1 << 16) < OPEN, np.array(moves), sampled))
    return out


@dataclass
class Index:
    """The items' walks. ``keys``: for each repetition sorted samples; ``items`` and ``places``: whose walk, and from which byte."""

    texts: list[str]
    sizes: np.ndarray
    repetitions: list[Repetition]
    keys: list[np.ndarray]
    items: list[np.ndarray]
    places: list[np.ndarray]
    filters: list[np.ndarray]
    votes: np.ndarray
    short: list[tuple[int, bytes]]
    longest: int


def index(items: list[str | None]) -> Index:
    """The items' samples in all repetitions; wordless items are in none."""
    kept = [plain(t) for t in items]
    texts = [k.decode("utf-8", "replace") for k in kept]
    sizes = np.array([len(k) for k in kept], np.int64)
    reps = repetitions()
    keys, owners, places, filters = [], [], [], []
    for rep in reps:
        found = [rep.walks(*ahead(np.frombuffer(k, np.uint8))) if len(k) >= SHORT else (np.empty(0, np.intp), np.empty(0, np.int64)) for k in kept]
        counts = np.array([len(b) for b, _ in found], np.int64)
        key = np.concatenate([k for _, k in found]) if found else np.empty(0, np.int64)
        order = np.argsort(key, kind="stable")
        keys.append(key[order])
        owners.append(np.repeat(np.arange(len(kept)), counts)[order])
        places.append((np.concatenate([b for b, _ in found]) if found else np.empty(0, np.intp))[order])
        known = np.zeros((2, 1 << 20), bool)
        known[0, _slot(keys[-1] >> 5 * (SAMPLED - EARLY))] = True
        known[1, _slot(keys[-1])] = True
        filters.append(known)
    votes = np.where(sizes < 4 * CELL, 1, VOTES)
    short = [(i, k) for i, k in enumerate(kept) if 0 < len(k) < SHORT]
    return Index(texts, sizes, reps, keys, owners, places, filters, votes, short, int(sizes.max(initial=0)))


def _distinct(parts: list[np.ndarray]) -> np.ndarray:
    """The sorted distinct numbers of all parts."""
    rows = np.sort(np.concatenate([np.empty(0, np.int64), *parts]))
    return rows[np.diff(rows, prepend=rows[:1] - 1) != 0]


def _width(ix: Index, pair: np.ndarray) -> np.ndarray:
    """The width of the bands of places, by the pair's item."""
    return np.maximum((BAND * ix.sizes[pair % len(ix.texts)]).astype(np.int64), 1)


def candidates(ix: Index, text: np.ndarray, starts: np.ndarray) -> list[tuple[int, int, int, int]]:
    """(document, item, lowest and highest place where it would begin); ``starts``: where each document of the text begins."""
    votes, size = [[], []], [0, 0]
    pairs, threes = ahead(text)
    with np.errstate(over="ignore"):
        for rep, keys, items, places, known in zip(ix.repetitions, ix.keys, ix.items, ix.places, ix.filters, strict=True):
            if not len(keys):
                continue
            begin, key = rep.walks(pairs, threes, known[0])
            maybe = np.flatnonzero(known[1].take(_slot(key)))
            begin, key = begin[maybe], key[maybe]
            lo, hi = np.searchsorted(keys, key, "left"), np.searchsorted(keys, key, "right")
            hit = np.flatnonzero(hi > lo)
            ends = np.cumsum((hi - lo)[hit])
            while len(hit):  # at most ``HITS`` at a time, or those of one walk; of many votes the distinct ones stay
                some = max(1, int(np.searchsorted(ends, HITS, "right")))
                now, hit, ends = hit[:some], hit[some:], ends[some:] - ends[some - 1]
                many = (hi - lo)[now]
                entry = np.repeat(lo[now], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
                own = np.repeat(begin[now], many)
                document = np.searchsorted(starts, own, "right") - 1
                pair, at, cell = document * len(ix.texts) + items[entry], own - places[entry], places[entry] // CELL
                width = _width(ix, pair)
                for half in (0, 1):  # bands that overlap by half
                    votes[half].append(pair << 36 | (at + width // 2 * half) // width + FAR << 16 | cell)
                    size[half] += len(pair)
                    if size[half] > 2 * HITS:
                        votes[half], size[half] = [_distinct(votes[half])], 0
    spans = []
    for half in (0, 1):
        rows = _distinct(votes[half])
        first = np.flatnonzero(np.r_[True, rows[1:] >> 16 != rows[:-1] >> 16]) if len(rows) else rows
        good = rows[first[np.diff(np.r_[first, len(rows)]) >= ix.votes[(rows[first] >> 36) % len(ix.texts)]]]
        width = _width(ix, good >> 36)
        low = ((good >> 16 & 0xFFFFF) - FAR) * width - width // 2 * half
        spans += list(zip((good >> 36).tolist(), low.tolist(), (low + width).tolist(), strict=True))
    out: list[tuple[int, int, int, int]] = []
    for pair, low, high in sorted(spans):  # bands that touch are verified together
        doc, item = divmod(pair, len(ix.texts))
        if out and out[-1][:2] == (doc, item) and low <= out[-1][3]:
            out[-1] = (doc, item, out[-1][2], max(high, out[-1][3]))
        else:
            out.append((doc, item, low, high))
    return out


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def distances(items: list[str], texts: list[str], together: int = 64) -> np.ndarray:
    """For each pair the fewest edits that turn the item into some stretch of the text.

    Bit-parallel over pairs too: in one long integer each pair has a lane of bits, so that some integer operations a character
    serve ``together`` pairs.
    """
    out = np.zeros(len(items), np.int64)
    order = sorted(range(len(items)), key=lambda i: (len(items[i]), len(texts[i])))
    for first in range(0, len(order), together):
        some = order[first : first + together]
        width = (len(items[some[-1]]) + 2 + 7) // 8
        join = lambda parts: int.from_bytes(b"".join(parts), "little")
        full = join(((1 << len(items[i])) - 1).to_bytes(width, "little") for i in some)
        tops = join((1 << len(items[i]) >> 1).to_bytes(width, "little") for i in some)
        columns = max(len(texts[i]) for i in some)
        # for each lane the places of each character of the items; 0 stands for all others
        known = np.unique(np.concatenate([_codes(items[i]) for i in some]))
        places = np.zeros((len(some), len(known) + 1, width * 8), np.uint8)
        chars = np.zeros((columns, len(some)), np.intp)
        for lane, i in enumerate(some):
            own, text = _codes(items[i]), _codes(texts[i])
            places[lane, np.searchsorted(known, own) + 1, np.arange(len(own))] = 1
            at = np.minimum(np.searchsorted(known, text), len(known) - 1)
            chars[: len(text), lane] = np.where(known[at] == text, at + 1, 0)
        equal = np.packbits(places, axis=2, bitorder="little")[np.arange(len(some)), chars]
        up, down, ups, downs = full, 0, [], []
        for column in equal:
            eq = int.from_bytes(column.tobytes(), "little")
            x = eq | down
            d = ((((x & up) + up) ^ up) | x) & full
            plus = down | full & ~(d | up)
            minus = d & up
            ups.append((plus & tops).to_bytes(width * len(some), "little"))
            downs.append((minus & tops).to_bytes(width * len(some), "little"))
            plus = plus << 1 & full
            up = (minus << 1 & full) | full & ~(d | plus)
            down = plus & d
        bits = lambda rows: np.frombuffer(b"".join(rows), np.uint8).reshape(columns, len(some), width).any(axis=2).astype(np.int64)
        sizes = np.array([len(items[i]) for i in some])
        lowest = np.cumsum(bits(ups) - bits(downs), axis=0).min(axis=0, initial=0) if columns else 0
        out[some] = sizes + lowest
    return out


def find(ix: Index, texts: list[bytes], most: float) -> list[tuple[int, int, int, int]]:
    """(text, item, edits, first byte) for each verified hit in the lower-cased texts; not yet one for each text and item."""
    offsets = np.cumsum([0, *(len(t) + 1 for t in texts)])
    text, where = words(np.frombuffer(b"\n".join([*texts, b""]), np.uint8))
    if not len(text) or not ix.texts:
        return []
    starts = np.searchsorted(where, offsets)  # also the end of the last
    out = []
    for item, literal in ix.short:
        for doc, part in enumerate(texts):
            at = (b" " + (whole := text[starts[doc] : starts[doc + 1]].tobytes())).find(b" " + literal + b" ") if len(part) >= len(literal) else -1
            if at >= 0 and whole:
                out.append((doc, item, 0, int(where[starts[doc] + at] - offsets[doc])))
    tried = []
    for doc, item, low, high in candidates(ix, text, starts[:-1]):
        slack = int(most * ix.sizes[item]) + 4
        lo, hi = max(low - slack, int(starts[doc])), min(high + int(ix.sizes[item]) + slack, int(starts[doc + 1]))
        while starts[doc] < lo < hi and text[lo] & 0xC0 == 0x80:  # whole characters
            lo -= 1
        while lo < hi < starts[doc + 1] and text[hi] & 0xC0 == 0x80:
            hi += 1
        if lo < hi:
            tried.append((doc, item, int(where[min(max((low + high) // 2, lo), hi - 1)] - offsets[doc]), text[lo:hi].tobytes().decode("utf-8", "replace")))
    edits = distances([ix.texts[item] for _, item, _, _ in tried], [region for *_, region in tried])
    out.extend((doc, item, int(e), at) for (doc, item, at, _), e in zip(tried, edits, strict=True) if e <= most * len(ix.texts[item]))
    return out


def _pieces(low: bytes, longest: int) -> Iterator[tuple[int, bytes]]:
    """(first byte, part) of a text; parts overlap by more than any item's window."""
    overlap = 4 * longest + 1024
    step = max(PIECE, overlap)
    for at in range(0, max(1, len(low)), step):
        yield at, low[at : at + step + overlap]


def hits(ix: Index, texts: Iterator[str | None], most: float) -> Iterator[tuple[int, int, int, int]]:
    """(text, item, edits, first byte) for each verified hit; texts are taken together up to a piece's size."""
    queue, size = [], 0
    for i, t in enumerate(texts):
        for first, part in _pieces((t or "").lower().encode("utf-8", "surrogatepass"), ix.longest):
            if queue and (size + len(part) > PIECE or len(queue) == 1024):
                yield from ((queue[q][0], item, edits, queue[q][1] + at) for q, item, edits, at in find(ix, [x[2] for x in queue], most))
                queue, size = [], 0
            queue.append((i, first, part))
            size += len(part)
    if queue:
        yield from ((queue[q][0], item, edits, queue[q][1] + at) for q, item, edits, at in find(ix, [x[2] for x in queue], most))


def _blocks(benchmark: DataFrame, block: int) -> Iterator:
    """A broadcast of each block of items: ids (an Arrow array) and texts."""
    items = benchmark.select("item_id", "text").where("text is not null")
    blocks = max(1, -(-(items.agg(F.sum(F.length("text"))).first()[0] or 0) // block))
    for number in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == number).toArrow()
        yield ship(benchmark.sparkSession, (rows["item_id"].combine_chunks(), rows["text"].to_pylist()))


def contaminated(docs: DataFrame, benchmark: DataFrame, most: float = 0.2, block: int = 1 << 20) -> DataFrame:
    """doc_id, item_id, edits, similarity, first_byte for each document and benchmark item that it holds."""
    found = None
    for shared in _blocks(benchmark, block):
        part = _search(docs, benchmark.schema["item_id"].dataType, shared, most)
        found = part if found is None else found.unionByName(part)
    best = F.min(F.struct("edits", "first_byte", "similarity")).alias("x")
    return found.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "x.edits", "x.similarity", "x.first_byte")


def _search(docs: DataFrame, item_type: T.DataType, shared, most: float) -> DataFrame:
    out = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("item_id", item_type), T.StructField("edits", T.IntegerType()), T.StructField("similarity", T.DoubleType()), T.StructField("first_byte", T.LongType())])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, texts = shipped(shared)
        ix = index(texts)
        for b in batches:
            rows = [(i, item, edits, round(1 - edits / len(ix.texts[item]), 6), at) for i, item, edits, at in hits(ix, (t.as_py() for t in b.column("text")), most)]
            if rows:
                doc, item, *rest = zip(*rows, strict=True)
                arrays = [b.column("doc_id").take(pa.array(doc)), ids.take(pa.array(item)), *(pa.array(c, kind) for c, kind in zip(rest, (pa.int32(), pa.float64(), pa.int64()), strict=True))]
                yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "item_id", "edits", "similarity", "first_byte"])

    return docs.select("doc_id", "text").mapInArrow(each, out)


def clean(docs: DataFrame, benchmark: DataFrame, most: float = 0.2, block: int = 1 << 20) -> DataFrame:
    """The rows of ``docs`` whose text holds no benchmark item; no shuffle."""
    for shared in _blocks(benchmark, block):

        def each(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            ix = index(shipped(shared)[1])
            for b in batches:
                keep = np.ones(b.num_rows, bool)
                for i, *_ in hits(ix, (t.as_py() for t in b.column("text")), most):
                    keep[i] = False
                yield b.filter(pa.array(keep))

        docs = docs.mapInArrow(each, docs.schema)
    return docs
