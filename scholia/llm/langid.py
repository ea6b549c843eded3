"""Language identification by interpolated Kneser-Ney character models, one for each language.

Text is lower-cased; letters stay, each run of anything else becomes one space. The models of all languages share sorted arrays
of n-gram hashes: for each order, the n-grams that any language has seen with every language's interpolated log probability,
and the contexts with every language's back-off weight. One binary search for a character then serves all languages, and lower
orders are looked at only for the few n-grams that none has seen. The language with the lowest cross-entropy a character wins.

Calibration, on learned languages' texts that were kept out of the counts, whole and in stretches of 20 to 1,000 characters from
all over them: the sharpness of the score (a posterior), and for each language the cross-entropy above which a text is marked
``rejected``.

Training takes a bounded sample of rows: at most ``each`` documents a language, whole. Counting and scoring take texts in pieces
of bounded size; a piece goes on from the characters before it, so pieces change nothing.

Rows: a null text, or one without a letter, gives ``und`` and score 0; so does every text where nothing can be learned; equal
texts get equal results; ties go to the language first in order; empty tables give no rows; only doc_id, text and lang are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scholia.llm.common import held_out, sample_ids

ORDER, DISCOUNT, PIECE = 4, 0.75, 1 << 20
#: Odd multipliers of the n-gram hash, one for each place.
PLACES = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64)

_letters: np.ndarray | None = None


def letters() -> np.ndarray:
    """Which code points below 0x40000 are letters; there are none above."""
    global _letters
    if _letters is None:
        _letters = np.fromiter((chr(c).isalpha() for c in range(0x40000)), bool, 0x40000)
    return _letters


def characters(parts: list[str], before: list[str] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The lower-cased parts' characters, ORDER - 1 ones before each (spaces, or those given); where each begins; which characters count."""
    pads = before or [" " * (ORDER - 1)] * len(parts)
    raw = np.frombuffer("".join(x for pair in zip(pads, parts, strict=True) for x in pair).encode("utf-32-le", "surrogatepass"), np.uint32)
    starts = np.concatenate([[0], np.cumsum([ORDER - 1 + len(t) for t in parts])[:-1]]).astype(np.int64)
    is_letter = letters()[np.minimum(raw, 0x3FFFF)]
    keep = is_letter.copy()
    keep[1:] |= is_letter[:-1]
    padding = (starts[:, None] + np.arange(ORDER - 1)).ravel()
    keep[padding] = True
    counts = np.ones(len(raw), bool)
    counts[padding] = False
    at = np.cumsum(keep) - 1
    return np.where(is_letter, raw, np.uint32(32))[keep].astype(np.uint64), at[starts], counts[keep]


def pieces(texts: list[str]) -> Iterator[tuple[list[int], np.ndarray, np.ndarray, np.ndarray]]:
    """(owners, characters, starts, which count) of the texts, taken together up to PIECE characters; longer ones piece by piece."""
    batch, owners, size = [], [], 0
    for i, t in enumerate(texts):
        low = t.lower()
        if len(low) > PIECE:
            before = " " * (ORDER - 1)
            for at in range(0, len(low), PIECE):
                c, starts, counted = characters([low[at : at + PIECE]], [before])
                before = "".join(map(chr, c[1 - ORDER :].tolist()))
                yield [i], c, starts, counted
            continue
        if batch and size + len(low) > PIECE:
            yield owners, *characters(batch)
            batch, owners, size = [], [], 0
        batch.append(low)
        owners.append(i)
        size += len(low)
    if batch:
        yield owners, *characters(batch)


def hashes(c: np.ndarray) -> list[np.ndarray]:
    """For k = 1 to ORDER: the hash of the k characters that end at each place."""
    out, h = [], np.zeros(len(c), np.uint64)
    for k in range(ORDER):
        h = h.copy()
        h[k:] += c[: len(c) - k] * PLACES[k]
        out.append(h)
    return out


def contexts(c: np.ndarray, h: list[np.ndarray]) -> list[np.ndarray]:
    """For k = 1 to ORDER: the hash of the k-gram's context, its first k - 1 characters, in the k-gram's own places."""
    return [x - c * PLACES[0] for x in h]


class Table:
    """Sorted hashes with a row of values each."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.keys, self.values = keys, values.astype(np.float32)

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row of each hash, and whether it is there."""
        if not len(self.keys):
            return np.zeros(len(h), np.int64), np.zeros(len(h), bool)
        at = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
        return at, self.keys[at] == h


def _hash(grams: np.ndarray) -> np.ndarray:
    """Hashes of n-grams, given as rows of characters."""
    n = grams.shape[1]
    return sum((grams[:, n - 1 - k] * PLACES[k] for k in range(n)), np.zeros(len(grams), np.uint64))


def _counts(texts: list[str]) -> list[dict[str, np.ndarray]]:
    """For each order: unique n-grams with count, context hash and the hash of what is left without the oldest character."""
    grams, n = np.empty((0, ORDER), np.uint64), np.empty(0, np.int64)
    for _, c, _, counted in pieces(texts):
        where = np.flatnonzero(counted)
        if not len(where):
            continue
        found = np.lib.stride_tricks.sliding_window_view(c, ORDER)[where - ORDER + 1]
        _, first, many = np.unique(_hash(found), return_index=True, return_counts=True)
        grams, n = np.concatenate([grams, found[first]]), np.concatenate([n, many])
        _, first, row = np.unique(_hash(grams), return_index=True, return_inverse=True)
        grams, n = grams[first], np.bincount(row, weights=n, minlength=len(first)).astype(np.int64)
    out: list[dict[str, np.ndarray]] = []
    for k in range(ORDER, 0, -1):
        keys = _hash(grams)
        shorter = grams[:, 1:]
        none = np.zeros(len(grams), np.uint64)
        out.append({"keys": keys, "n": n, "context": keys - grams[:, -1] * PLACES[0], "shorter": _hash(shorter) if k > 1 else none, "shorter_context": _hash(shorter) - grams[:, -1] * PLACES[0] if k > 1 else none})
        # Kneser-Ney: in how many different longer n-grams
        _, first, n = np.unique(_hash(shorter), return_index=True, return_counts=True)
        grams = shorter[first]
    return out[::-1]


class Models:
    def __init__(self, languages: list[str]):
        self.languages, self.grams, self.backoff = languages, [], []
        self.unseen = 0.0
        self.sharpness, self.limit = 1.0, np.full(len(languages), np.inf)

    def log_probabilities(self, c: np.ndarray, where: np.ndarray) -> np.ndarray:
        """Each language's log probability of the characters at ``where``, given those before."""
        out = np.zeros((len(where), len(self.languages)), np.float32)
        h, left = hashes(c), np.arange(len(where))
        for k in range(ORDER, 0, -1):
            at = where[left]
            row, seen = self.grams[k - 1].find(h[k - 1][at])
            out[left[seen]] += self.grams[k - 1].values[row[seen]]
            left, at = left[~seen], at[~seen]
            if not len(left):
                break
            row, known = self.backoff[k - 1].find(h[k - 1][at] - c[at] * PLACES[0])
            out[left[known]] += self.backoff[k - 1].values[row[known]]
            if k == 1:
                out[left] += self.unseen
        return out

    def totals(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Each text's log probability in every language, and its number of characters."""
        total, n = np.zeros((len(texts), len(self.languages))), np.zeros(len(texts), np.int64)
        for owners, c, starts, counted in pieces(texts):
            where = np.flatnonzero(counted)
            logs = self.log_probabilities(c, where)
            sums = np.concatenate([np.zeros((1, logs.shape[1])), np.cumsum(logs, axis=0, dtype=np.float64)])
            ends = np.searchsorted(where, [*starts[1:], len(c)])
            begins = np.searchsorted(where, starts)
            total[owners] += sums[ends] - sums[begins]
            # a text without a letter has no character that counts
            n[owners] += ends - begins
        return total, n

    def posterior(self, total: np.ndarray, n: np.ndarray) -> np.ndarray:
        entropy = -total / np.maximum(n, 1)[:, None]
        z = -self.sharpness * np.sqrt(n)[:, None] * (entropy - entropy.min(axis=1, keepdims=True))
        return np.exp(z) / np.exp(z).sum(axis=1, keepdims=True)

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
        """Language, score, cross-entropy in nats a character, whether rejected."""
        total, n = self.totals([t or "" for t in texts])
        best = total.argmax(axis=1)
        score = self.posterior(total, n)[np.arange(len(texts)), best]
        entropy = -total[np.arange(len(texts)), best] / np.maximum(n, 1)
        none = n == 0
        return [("und" if e else self.languages[b]) for b, e in zip(best, none, strict=True)], np.where(none, 0.0, score), np.where(none, 0.0, entropy), none | (entropy > self.limit[best])


def train(texts: dict[str, list[str]], slack: float = 6.0) -> Models:
    """Models of the languages from their texts; a fifth of each language's texts calibrates."""
    languages = sorted(texts)
    m = Models(languages)
    kept = {x: [t for i, t in enumerate(texts[x]) if i % 5 == 4] for x in languages}
    counts = [_counts([t for i, t in enumerate(texts[x]) if i % 5 != 4]) for x in languages]
    alphabet = max(1, len(np.unique(np.concatenate([c[0]["keys"] for c in counts])))) + 1
    m.unseen = float(np.log(1 / alphabet))
    for k in range(1, ORDER + 1):
        own = [c[k - 1] for c in counts]
        # contexts: how often each language has seen them, and with how many different characters
        keys = np.unique(np.concatenate([x["context"] for x in own]))
        seen, kinds = np.zeros((len(keys), len(languages))), np.zeros((len(keys), len(languages)))
        for j, x in enumerate(own):
            at = np.searchsorted(keys, x["context"])
            np.add.at(seen[:, j], at, x["n"])
            np.add.at(kinds[:, j], at, 1)
        weight = np.where(seen > 0, DISCOUNT * kinds / np.maximum(seen, 1), 1.0)
        m.backoff.append(Table(keys, np.log(weight)))
        # n-grams of any language: discounted share, plus the back-off weight times the shorter n-gram's probability
        grams, first = np.unique(np.concatenate([x["keys"] for x in own]), return_index=True)
        context = np.concatenate([x["context"] for x in own])[first]
        shorter = np.concatenate([x["shorter"] for x in own])[first]
        shorter_context = np.concatenate([x["shorter_context"] for x in own])[first]
        at = np.searchsorted(keys, context)
        share = np.zeros((len(grams), len(languages)))
        for j, x in enumerate(own):
            to = np.searchsorted(grams, x["keys"])
            share[to, j] = np.maximum(x["n"] - DISCOUNT, 0) / seen[np.searchsorted(keys, x["context"]), j]
        if k == 1:
            lower = np.full((len(grams), len(languages)), 1 / alphabet)
        else:
            row, there = m.grams[k - 2].find(shorter)
            lower = np.where(there[:, None], np.exp(m.grams[k - 2].values[row].astype(np.float64)), 0)
            if (~there).any():  # cannot be: whatever has a longer n-gram has the shorter; kept for hashes that collide
                brow, known = m.backoff[k - 2].find(shorter_context)
                lower[~there] = np.where(known[~there, None], np.exp(m.backoff[k - 2].values[brow[~there]]), 1) / alphabet
        m.grams.append(Table(grams, np.log(share + weight[at] * lower)))
    _calibrate(m, kept, slack)
    return m


def _calibrate(m: Models, kept: dict[str, list[str]], slack: float) -> None:
    samples, truth = [], []
    for j, x in enumerate(m.languages):
        for i, t in enumerate(kept[x]):
            size = (20, 60, 200, 1000)[i % 4]
            at = (i * 2654435761) % max(1, len(t) - size)
            samples += [t, t[at : at + size]]
            truth += [j, j]
    if not samples:
        return
    total, n = m.totals(samples)
    truth, use = np.array(truth), n > 0
    best = min((0.25, 0.5, 1.0, 2.0, 4.0, 8.0, 16.0), key=lambda s: _loss(m, s, total[use], n[use], truth[use]))
    m.sharpness = best
    entropy = -total[np.arange(len(truth)), truth] / np.maximum(n, 1)
    for j in range(len(m.languages)):
        own = entropy[(truth == j) & (n >= 40)]
        if len(own) >= 5:
            m.limit[j] = own.mean() + slack * max(own.std(), 0.05)


def _loss(m: Models, sharpness: float, total: np.ndarray, n: np.ndarray, truth: np.ndarray) -> float:
    m.sharpness = sharpness
    return float(-np.log(np.maximum(m.posterior(total, n)[np.arange(len(truth)), truth], 1e-12)).mean()) if len(truth) else 0.0


def learn(docs: DataFrame, each: int = 300) -> Models | None:
    """Models of the languages of the documents that are not held out; None where there are none."""
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id"))).select("doc_id", "lang")
    picked = sample_ids(known, "lang", each)
    # at most ``each`` rows a language are broadcast, and their whole texts brought here
    rows = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").select("doc_id", "lang", "text").where("text is not null").collect()
    texts: dict[str, list[str]] = {}
    for _, lang, text in sorted({(r["doc_id"], r["lang"], r["text"]) for r in rows}):
        texts.setdefault(lang, []).append(text)
    texts = {x: t for x, t in texts.items() if any(c.isalpha() for i, s in enumerate(t) if i % 5 != 4 for c in s)}
    return train(texts) if texts else None


def identify(docs: DataFrame, models: Models | None) -> DataFrame:
    """doc_id, held_out, lang_pred, score, cross_entropy, rejected for each row of ``docs``."""
    columns = T.StructType([docs.schema["doc_id"], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("cross_entropy", T.DoubleType()), T.StructField("rejected", T.BooleanType())])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = models.predict([t.as_py() for t in b.column("text")])
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(x) for x in found)], ["doc_id", "lang_pred", "score", "cross_entropy", "rejected"])

    if models is None:
        found = docs.select("doc_id", F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(0.0).alias("cross_entropy"), F.lit(True).alias("rejected"))
    else:
        found = docs.select("doc_id", "text").mapInArrow(each, columns)
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "cross_entropy", "rejected")
