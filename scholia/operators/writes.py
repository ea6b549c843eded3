"""Changes of an index of documents and chunks. Each takes both tables and returns what they become; a store makes them visible.

documents: filename, total_pages, is_scanned, file_hash, pages (with chunks), status. chunks: filename, page, chunk_index, text.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scholia.operators.chunking import chunk

DOCUMENT = ["filename", "total_pages", "is_scanned", "file_hash", "pages", "status"]
CHUNK = ["filename", "page", "chunk_index", "text"]
PAGE = ["filename", "page"]


def recounted(documents: DataFrame, chunks: DataFrame, touched: DataFrame) -> DataFrame:
    """Documents with pages and status set anew for the ``touched`` filenames: indexed once all pages have chunks or if it was never scanned."""
    pages = chunks.join(touched.select("filename").distinct(), "filename", "left_semi").groupBy("filename").agg(F.countDistinct("page").alias("_pages"))
    marked = documents.join(touched.select("filename").distinct().withColumn("_touched", F.lit(True)), "filename", "left").join(pages, "filename", "left")
    n = F.coalesce(F.col("_pages"), F.lit(0)).cast(documents.schema["pages"].dataType)
    status = F.when((n >= F.col("total_pages")) | ~F.col("is_scanned"), "indexed").otherwise("ocr_partial_reviewed")
    return marked.select("filename", "total_pages", "is_scanned", "file_hash", F.when(F.col("_touched"), n).otherwise(F.col("pages")).alias("pages"), F.when(F.col("_touched"), status).otherwise(F.col("status")).alias("status"))


def cut_pages(pages: DataFrame, size: int = 1200, overlap: int = 200) -> DataFrame:
    """Chunks of pages (filename, page, text)."""
    keyed = pages.withColumn("_k", F.struct(*PAGE))
    return chunk(keyed, key="_k", text="text", size=size, overlap=overlap).select("_k.filename", "_k.page", F.col("chunk_index").cast("long").alias("chunk_index"), "text")


def replace_pages(documents: DataFrame, chunks: DataFrame, pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pages (filename, page, text) take the place of the stored ones; counts and states follow. A page with a blank text loses its chunks. One row a page."""
    kept = chunks.select(*CHUNK).join(pages.select(*PAGE).distinct(), PAGE, "left_anti")
    after = kept.select(*CHUNK).unionByName(cut_pages(pages).select(*[F.col(c).cast(chunks.schema[c].dataType).alias(c) for c in CHUNK]))
    return recounted(documents, after, pages), after


def delete_obsolete(documents: DataFrame, chunks: DataFrame, present: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Documents that are no longer ``present`` (filename) go, and their chunks with them."""
    names = present.select("filename").distinct()
    return documents.join(names, "filename", "left_semi"), chunks.join(names, "filename", "left_semi")


def insert_chunks(documents: DataFrame, chunks: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All new chunks or none: what is wrong with them shows in ``faults`` of the tables that come out."""
    after = chunks.select(*CHUNK).unionByName(new.select(*CHUNK))
    return recounted(documents, after, new), after


def faults(documents: DataFrame, chunks: DataFrame) -> DataFrame:
    """kind, filename, page of what an index may not hold: places held twice, chunks of no document, pages out of range, blank texts, wrong counts, filenames twice."""
    row = lambda kind, page: (F.lit(kind).alias("kind"), F.col("filename"), page.cast("long").alias("page"))
    none = F.lit(None)
    met = chunks.join(documents.select("filename", "total_pages"), "filename", "left")
    outside = F.when(F.col("total_pages").isNull(), "unknown_document").when(~F.coalesce(F.col("page").between(1, F.col("total_pages")), F.lit(False)), "page_out_of_range").when(F.coalesce(F.trim("text"), F.lit("")) == "", "blank_chunk")
    parts = [
        chunks.groupBy(*PAGE, "chunk_index").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(*row("place_held_twice", F.col("page"))),
        met.select(outside.alias("kind"), "filename", F.col("page").cast("long").alias("page")).where("kind is not null"),
        documents.groupBy("filename").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(*row("document_held_twice", none)),
        documents.join(chunks.groupBy("filename").agg(F.countDistinct("page").alias("n")), "filename", "left").where(F.coalesce(F.col("n"), F.lit(0)) != F.col("pages")).select(*row("wrong_page_count", none)),
    ]
    return reduce(DataFrame.unionByName, parts)


def review_faults(documents: DataFrame, reviews: DataFrame) -> DataFrame:
    """kind, filename, page of reviews (filename, page, text, source_hash, completeness, unresolved) that keep their batch from being applied: the first fault of each."""
    met = reviews.join(documents.select("filename", "file_hash", "total_pages"), "filename", "left")
    twice = reviews.groupBy(*PAGE).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.lit("reviewed_twice").alias("kind"), "filename", F.col("page").cast("long").alias("page"))

    def unless(c: Column) -> Column:
        return ~F.coalesce(c, F.lit(False))

    kind = (
        F.when(F.col("file_hash").isNull(), "unknown_document")
        .when(unless(F.col("file_hash") == F.col("source_hash")), "source_changed")
        .when(unless(F.col("page").between(1, F.col("total_pages"))), "page_out_of_range")
        .when(unless(F.col("completeness") == "complete"), "incomplete")
        .when(F.coalesce(F.col("unresolved"), F.lit(0)) > 0, "unresolved")
        .when(F.coalesce(F.trim("text"), F.lit("")) == "", "blank_text")
    )
    return met.select(kind.alias("kind"), "filename", F.col("page").cast("long").alias("page")).where("kind is not null").unionByName(twice)
