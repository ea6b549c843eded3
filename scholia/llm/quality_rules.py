"""Quality rules: counts within a document, and lines that too many documents of a host share.

Base rules look at one document: words, symbols, repeated lines, and words in 8-word windows that the text holds twice or more.
Cross-document rule: lines are normalised and hashed; for each host the distinct documents that hold a line are counted; lines of
more than ``share`` of a host's documents (and more than ``least``) are removed, and a document is rejected when that leaves it
depleted: under ``words`` words, or under ``left`` (a share) of its words. Copies of a text on one host are one document, so a group of
copies does not make its own lines frequent.

A line is normalised by lower-casing A-Z, writing each run of digits as 0, and each run of white space as one space, none at the ends.
Line and host are hashed together (MD5, 128 bits), so that counts and joins move 16 bytes a line. Both counting steps combine
before their shuffle, so a line that every document holds costs one row a task. Frequent lines are broadcast up to
``most_broadcast`` of them (their number is taken first); beyond that lines and frequent lines are joined with hot lines salted.

Rows: a null or empty text has no words and fails the base rules; a null source is the host of the empty name; a text counts whole
whatever its length; repeated rows and copies get equal results, one for each row; any type of id, null too; an empty table gives no
rows; columns other than the id, source and text are not read by ``judge`` and kept by ``clean``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scholia.llm.common import SPACE, cut, salted_join

SYMBOLS = b"#*$%&|<>"
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def repeated_words(words: list[bytes], width: int = 8) -> int:
    """Words in windows of ``width`` (a power of two) words that occur twice or more. Windows are numbered exactly, by doubling."""
    n = len(words) - width + 1
    if n < 2:
        return 0
    number: dict[bytes, int] = {}
    kind = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
    if len(number) == len(words):
        return 0
    span = 1
    while span < width:
        pair = kind[:-span] * (int(kind.max()) + 1) + kind[span:]
        kind = np.unique(pair, return_inverse=True)[1]
        span *= 2
    twice = np.bincount(kind)[kind] > 1
    edge = np.zeros(len(words) + 1, np.int64)
    edge[:n] += twice
    edge[width : width + n] -= twice
    return int((np.cumsum(edge[:-1]) > 0).sum())


def counts(text: bytes) -> tuple[int, int, int, int, int]:
    """The columns BASE of one text. Bytes suffice: white space and symbols are ASCII, and a code point has one byte that does not continue another."""
    data = np.frombuffer(text, np.uint8)
    words = text.split()
    seen: set[bytes] = set()
    again = 0
    for line in text.split(b"\n"):
        if line in seen:
            again += 1
        elif line.strip():
            seen.add(line)
    chars = int(((data > 32) & ((data & 0xC0) != 0x80)).sum() + ((data < 32) & ((data < 9) | (data > 13))).sum())
    return len(words), chars, int(np.isin(data, np.frombuffer(SYMBOLS, np.uint8)).sum()), again, repeated_words(words)


def _keyed(docs: DataFrame, *more: str) -> DataFrame:
    """Host, text and ``key``, the digest of both; with the columns ``more``."""
    host, text = F.coalesce(F.col("source").cast("string"), F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit(""))
    keyed = docs.select(*more, host.alias("_host"), text.alias("_text"))
    return keyed.withColumn("_key", F.unhex(F.md5(F.concat("_host", F.lit("\n"), "_text").cast("binary"))))


def normal_line(line: Column) -> Column:
    lower = F.translate(line, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.trim(F.regexp_replace(F.regexp_replace(lower, SPACE, " "), "[0-9]+", "0"))


def _lines(keyed: DataFrame) -> DataFrame:
    """Each line that has a word: _host, _key, _at (its number in the text), _words, _line (the digest of host and normalised line)."""
    raw = keyed.select("_host", "_key", F.posexplode(F.split("_text", "\n")).alias("_at", "_raw"))
    normal = raw.select("_host", "_key", "_at", normal_line(F.col("_raw")).alias("_normal")).where(F.col("_normal") != "")
    digest = F.unhex(F.md5(F.concat("_host", F.lit("\n"), "_normal").cast("binary")))
    return normal.select("_host", "_key", "_at", F.size(F.split("_normal", " ")).alias("_words"), digest.alias("_line"))


def frequent_lines(docs: DataFrame, share: float = 0.01, least: int = 10) -> DataFrame:
    """_line (digest of host and normalised line) and n, the host's distinct documents that hold it, where n exceeds both limits."""
    keyed = _keyed(docs)
    hosts = keyed.select("_host", "_key").distinct().groupBy("_host").agg(F.count(F.lit(1)).alias("_texts"))
    held = _lines(keyed).select("_host", "_line", "_key").distinct().groupBy("_host", "_line").agg(F.count(F.lit(1)).alias("n"))
    return held.where(F.col("n") > least).join(hosts, "_host").where(F.col("n") > share * F.col("_texts")).select("_line", "n")


def _gone(docs: DataFrame, share: float, least: int, most_broadcast: int) -> tuple[DataFrame, int, int]:
    """What is removed from each text that holds frequent lines: _key, _gone_words, _gone_at (line numbers), n (its rows); with the rows of ``docs`` and the most of one text."""
    total = docs.count()
    frequent = cut(frequent_lines(docs, share, least))
    found, most = frequent.agg(F.count(F.lit(1)), F.coalesce(F.max("n"), F.lit(0))).first()
    lines = _lines(_keyed(docs)).drop("_host")
    if found <= most_broadcast:
        hits = lines.join(F.broadcast(frequent.select("_line")), "_line")
    else:
        hits = salted_join(lines, frequent, "_line", F.struct("_key", "_at"), total, most)
    each = hits.groupBy("_key", "_at", "_words").agg(F.count(F.lit(1)).alias("_rows"))
    gone = cut(each.groupBy("_key").agg(F.sum("_words").alias("_gone_words"), F.collect_list("_at").alias("_gone_at"), F.max("_rows").alias("n")))
    return gone, total, gone.agg(F.coalesce(F.max("n"), F.lit(0))).first()[0]


def base(docs: DataFrame) -> DataFrame:
    """doc_id, _key, the columns BASE and base_failed (under 20 words, or over 30 % of them in repeated windows) for each row."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = np.array([counts(t.as_py()) for t in b.column("_text")], np.int64).reshape(-1, len(BASE))
            n, again = found[:, 0], found[:, 4]
            failed = (n < 20) | (100 * again > 30 * n)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("_key"), *(pa.array(c) for c in found.T), pa.array(failed)], ["doc_id", "_key", *BASE, "base_failed"])

    keyed = _keyed(docs, "doc_id").select("doc_id", "_key", F.col("_text").cast("binary").alias("_text"))
    schema = T.StructType([docs.schema["doc_id"], T.StructField("_key", T.BinaryType()), *(T.StructField(c, T.LongType()) for c in BASE), T.StructField("base_failed", T.BooleanType())])
    return keyed.mapInArrow(each, schema)


def _verdict(rows: DataFrame, words: int, left: float) -> DataFrame:
    stay = F.col("n_words") - F.coalesce(F.col("_gone_words"), F.lit(0))
    depleted = (stay < words) | (stay < left * F.col("n_words"))
    return rows.withColumn("n_frequent_words", F.coalesce(F.col("_gone_words"), F.lit(0)).cast("long")).withColumn("kept", ~F.col("base_failed") & ~depleted)


def judge(docs: DataFrame, share: float = 0.01, least: int = 10, words: int = 10, left: float = 0.3, most_broadcast: int = 250_000) -> DataFrame:
    """doc_id, the columns BASE, base_failed, kept and n_frequent_words (words in the lines that go) for each row of ``docs``."""
    gone, total, most = _gone(docs, share, least, most_broadcast)
    met = salted_join(base(docs), gone.drop("_gone_at"), "_key", F.col("doc_id"), total, most, how="left")
    return _verdict(met, words, left).select("doc_id", *BASE, "base_failed", "kept", "n_frequent_words")


def clean(docs: DataFrame, share: float = 0.01, least: int = 10, words: int = 10, left: float = 0.3, most_broadcast: int = 250_000) -> DataFrame:
    """The rows of ``docs`` that are kept, all their columns, their texts without the frequent lines."""
    gone, total, _ = _gone(docs, share, least, most_broadcast)
    texts = base(docs).groupBy("_key").agg(F.first("n_words").alias("n_words"), F.first("base_failed").alias("base_failed"), F.count(F.lit(1)).alias("n"))
    kept = cut(_verdict(texts.join(gone.drop("n"), "_key", "left"), words, left).where("kept").select("_key", F.col("_gone_at").alias("_gone_at"), "n"))
    most = kept.agg(F.coalesce(F.max("n"), F.lit(0))).first()[0]
    host, text = F.coalesce(F.col("source").cast("string"), F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit(""))
    own = docs.withColumn("_key", F.unhex(F.md5(F.concat(host, F.lit("\n"), text).cast("binary"))))
    met = salted_join(own, kept, "_key", F.col("doc_id"), total, most)
    lines = F.filter(F.split("text", "\n"), lambda _, i: ~F.array_contains("_gone_at", i))
    return met.withColumn("text", F.when(F.size("_gone_at") > 0, F.array_join(lines, "\n")).otherwise(F.col("text"))).select(*docs.columns)
