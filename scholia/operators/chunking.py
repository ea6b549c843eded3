"""Splitting texts: overlapping chunks, paragraphs, sentences with offsets."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scholia.functions import spans
from scholia.functions.text import paragraphs

#: Characters of pages whose chunks leave a task together.
HELD = 1 << 20
_SPACE = " \t\n\r\f\v "


def chunk_bounds(text: str, size: int = 1200, overlap: int = 200) -> list[tuple[int, int]]:
    """(start, end) of the windows: each ends after the last white space of its back half, and the next begins ``overlap`` earlier."""
    if not size > overlap >= 0:
        raise ValueError("size > overlap >= 0 is needed")
    out, start, n = [], 0, len(text)
    while start < n:
        end = min(start + size, n)
        if end < n:
            floor = start + max(overlap + 1, size // 2)
            end = next((i + 1 for i in range(end - 1, floor - 1, -1) if text[i] in _SPACE), end)
        out.append((start, end))
        if end >= n:
            break
        start = end - overlap
    return out


def chunk(pages: DataFrame, key: str = "doc_id", text: str = "text", size: int = 1200, overlap: int = 200) -> DataFrame:
    """key, chunk_index, char_start, char_end, text: one row a chunk of the trimmed page. The scan is sequential, so it runs on Arrow batches; a task holds the chunks of ``HELD`` characters of pages, or of one page."""
    fields = [T.StructField("chunk_index", T.IntegerType()), T.StructField("char_start", T.IntegerType()), T.StructField("char_end", T.IntegerType()), T.StructField("text", T.StringType())]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(batch: pa.RecordBatch, rows: list[tuple[int, int, int, int, str]]) -> pa.RecordBatch:
            of, *columns = zip(*rows, strict=True)
            return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(of)), *[pa.array(c, pa.int32()) for c in columns[:3]], pa.array(columns[3], pa.string())], [key, *[f.name for f in fields]])

        for batch in batches:
            rows, held = [], 0
            for n in range(batch.num_rows):
                t = batch.column(1)[n].as_py()
                if t:
                    rows += [(n, i, a, b, t[a:b]) for i, (a, b) in enumerate(chunk_bounds(t, size, overlap))]
                    held += len(t)
                if held >= HELD:
                    yield out(batch, rows)
                    rows, held = [], 0
            if rows:
                yield out(batch, rows)

    trimmed = F.regexp_replace(F.col(text), r"^\s+|\s+$", "")
    return pages.select(key, trimmed.cast("string").alias("_text")).mapInArrow(cut, T.StructType([pages.schema[key], *fields]))


def paragraph_rows(pages: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, paragraph (from 1), text of each paragraph that holds anything."""
    return pages.select(key, F.posexplode(paragraphs(F.col(text))).alias("n", "text")).select(key, (F.col("n") + 1).alias("paragraph"), "text")


def sentences(pages: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, sentence (from 0), char_start, char_end, text: offsets hold in the text as given."""
    rows = pages.select(key, F.posexplode(spans.sentences(F.col(text))).alias("sentence", "s"))
    return rows.select(key, "sentence", F.col("s.begin").alias("char_start"), F.col("s.end").alias("char_end"), F.col("s.text").alias("text"))
