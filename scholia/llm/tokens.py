"""Token counts: lengths in greedy word pieces by a linear longest-match automaton.

A word is a run of non-space bytes; its text is a space and the word, and it is cut from the left into the longest pieces of
the vocabulary. The automaton is the vocabulary's trie with failure links: where the trie has no edge for the next byte, the
link leads to the state in which matching goes on, and a number says how many pieces the link has finished. So a word's count is
the sum of those numbers along its bytes; pieces are never built and no byte is read twice.

The vocabulary is a file of base64 tokens with ranks, as public byte-level tokenizers have; its path is a parameter and it is
read on the driver. The automaton's arrays (some MB, whatever the data) are broadcast. A batch's distinct words run through the
automaton side by side in numpy, words of one length together; a very long word alone.

Rows: a null or empty text has no words and no tokens; a text is whole whatever its length; repeated rows get equal counts;
empty tables give no rows; columns other than the id and text are not read. Bytes that the vocabulary lacks count as one piece.
"""

from __future__ import annotations

import base64
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scholia.llm.common import ship, shipped

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Longer words run through the automaton one by one.
SIDE_BY_SIDE = 64


def vocabulary(path: str = VOCABULARY) -> list[bytes]:
    with open(path, "rb") as f:
        return [base64.b64decode(line.split()[0]) for line in f if line.strip()]


@dataclass
class Automaton:
    """Edges as sorted keys state * 256 + byte; for each state its failure link and the pieces that link or end finishes."""

    edges: np.ndarray
    to: np.ndarray
    fail: np.ndarray
    popped: np.ndarray


def build(tokens: list[bytes]) -> Automaton:
    """The trie of the tokens and of all single bytes, with failure links."""
    children: list[dict[int, int]] = [{}]
    token = [False]
    for t in [*(t for t in tokens if t), *(bytes([b]) for b in range(256))]:
        at = 0
        for b in t:
            if b not in children[at]:
                children.append({})
                token.append(False)
                children[at][b] = len(children) - 1
            at = children[at][b]
        token[at] = True
    fail, popped = [0] * len(children), [0] * len(children)
    queue = deque([0])
    while queue:  # by depth: a link leads to a shallower state
        u = queue.popleft()
        for b, v in children[u].items():
            if token[v]:
                fail[v], popped[v] = 0, 1  # the whole is a piece; matching starts anew
            else:
                z, n = fail[u], popped[u]
                while b not in children[z]:
                    n += popped[z]
                    z = fail[z]
                fail[v], popped[v] = children[z][b], n
            queue.append(v)
    keys = np.array([(u * 256 + b, v) for u, c in enumerate(children) for b, v in c.items()], np.int64)
    keys = keys[keys[:, 0].argsort()]
    return Automaton(keys[:, 0].copy(), keys[:, 1].astype(np.int32), np.array(fail, np.int32), np.array(popped, np.int32))


def _step(a: Automaton, state: np.ndarray, byte: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The next state of every word; adds to ``count`` what its failure links finish."""
    out = np.empty_like(state)
    left = np.arange(len(state))
    while len(left):
        key = state[left].astype(np.int64) * 256 + byte[left]
        at = np.minimum(np.searchsorted(a.edges, key), len(a.edges) - 1)
        there = a.edges[at] == key
        out[left[there]] = a.to[at[there]]
        left = left[~there]
        count[left] += a.popped[state[left]]
        state[left] = a.fail[state[left]]
    return out


def count_words(a: Automaton, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Pieces of each word, a space before it: data[start : start + length]."""
    count = np.zeros(len(starts), np.int64)
    order = np.argsort(-lengths, kind="stable")
    lengths = lengths[order]
    short = order[np.searchsorted(-lengths, -SIDE_BY_SIDE) :]
    n = lengths[len(order) - len(short) :]
    got = np.zeros(len(short), np.int64)
    state = _step(a, np.zeros(len(short), np.int32), np.full(len(short), 32, np.int64), got)
    for i in range(int(n[0]) if len(n) else 0):
        live = np.searchsorted(-n, -i)  # words longer than i come first
        part = got[:live]
        state[:live] = _step(a, state[:live], data[starts[short[:live]] + i].astype(np.int64), part)
    while (live := np.flatnonzero(state)).size:
        got[live] += a.popped[state[live]]
        state[live] = a.fail[state[live]]
    count[short] = got
    edges = None
    for w, size in zip(order[: len(order) - len(short)].tolist(), lengths.tolist(), strict=False):
        edges = edges if edges is not None else dict(zip(a.edges.tolist(), a.to.tolist(), strict=True))
        count[w] = _alone(a, edges, memoryview(data)[starts[w] : starts[w] + size])
    return count


def _alone(a: Automaton, edges: dict[int, int], word: memoryview) -> int:
    n, u = 0, edges[32]
    for b in word:
        while (v := edges.get(u * 256 + b)) is None:
            n += int(a.popped[u])
            u = int(a.fail[u])
        u = v
    while u:
        n += int(a.popped[u])
        u = int(a.fail[u])
    return n


def count_texts(a: Automaton, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Words and pieces of each text."""
    data = np.frombuffer(b" ".join([b"", *texts, b""]), np.uint8)
    offsets = np.cumsum([1, *(len(t) + 1 for t in texts)])
    space = (data == 32) | ((data >= 9) & (data <= 13))
    change = np.flatnonzero(space[1:] != space[:-1]) + 1
    starts, ends = change[::2], change[1::2]
    lengths = ends - starts
    owner = np.searchsorted(offsets, starts, side="right") - 1
    # distinct words: by length, then by content, so that equal hashes alone never merge two words
    pieces = np.zeros(len(starts), np.int64)
    first, kind = _distinct(data, starts, lengths)
    pieces = count_words(a, data, starts[first], lengths[first])[kind] if len(starts) else pieces
    return np.bincount(owner, minlength=len(texts))[: len(texts)], np.bincount(owner, weights=pieces, minlength=len(texts))[: len(texts)].astype(np.int64)


def _distinct(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the first word of each content, and each word's content. Words over 32 bytes each count as their own."""
    first, kind, n = [], np.empty(len(starts), np.int64), 0
    for size in np.unique(lengths):
        at = np.flatnonzero(lengths == size)
        if size <= 32:
            width = -(-int(size) // 8) * 8
            block = np.zeros((len(at), width), np.uint8)
            block[:, :size] = data[starts[at][:, None] + np.arange(size)]
            keys = block.view(np.uint64) if width == 8 else block.view(f"V{width}")
            _, one, inverse = np.unique(keys.ravel(), return_index=True, return_inverse=True)
        else:
            one, inverse = np.arange(len(at)), np.arange(len(at))
        first.append(at[one])
        kind[at] = inverse + n
        n += len(one)
    return (np.concatenate(first) if first else np.empty(0, np.int64)), kind


def token_counts(docs: DataFrame, path: str = VOCABULARY, batch_bytes: int = 4 << 20) -> DataFrame:
    """doc_id, n_bytes, n_words, n_tokens for each row of ``docs``."""
    shared = ship(docs.sparkSession, build(vocabulary(path)))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = shipped(shared)
        for b in batches:
            texts = [(t.as_py() or "").encode("utf-8", "surrogatepass") for t in b.column("text")]
            words, tokens = [], []
            at = 0
            while at < len(texts):
                end, size = at, 0
                while end < len(texts) and (end == at or size + len(texts[end]) <= batch_bytes):
                    size += len(texts[end])
                    end += 1
                w, t = count_texts(a, texts[at:end])
                words.append(w)
                tokens.append(t)
                at = end
            arrays = [b.column("doc_id"), pa.array([len(t) for t in texts], pa.int64()), *(pa.array(np.concatenate(x) if x else np.empty(0, np.int64), pa.int64()) for x in (words, tokens))]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "n_bytes", "n_words", "n_tokens"])

    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(each, T.StructType([docs.schema["doc_id"], *(T.StructField(c, T.LongType()) for c in ("n_bytes", "n_words", "n_tokens"))]))
