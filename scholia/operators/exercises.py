"""Exercises as they stand in their sources: a predicate and a table function that SQL and DataFrames share, and a list without copies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scholia.functions.query import words
from scholia.functions.cleaning import cleaned

# Words that mark a page with exercises, the pattern of an exercise's heading, and signs that a formula may have suffered.
MARKERS = ["bài tập", "câu hỏi", "ví dụ", "bài ", "câu ", "exercise", "example", "practice", "review questions", "problem"]
HEADING = r"^\s*(?:[-*•]\s*)?(?:bài\s+tập(?:\s+(?:vận\s+dụng|mẫu))?|câu\s+hỏi(?:\s+(?:ôn\s+tập|thảo\s+luận|luyện\s+tập))?|(?:bài|câu)\s+\d+(?:[.:]\d+)*|ví\s+dụ(?:\s+\d+(?:[.:]\d+)*)?|worked\s+examples?|examples?|exercises?|practice\s+questions|review\s+questions|problems?)\b"
DAMAGED = "[�□▯√∫∑∂≤≥≠≈]"
PARTIAL = ["scanned_unocred", "ocr_partial_reviewed"]
_LINES = r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x85\x{2028}\x{2029}]"


def has_heading(text: Column) -> Column:
    return F.exists(F.split(text, _LINES), lambda line: line.rlike("(?iU)" + HEADING))


def is_candidate(text: Column) -> Column:
    """True where a passage has a marker or the heading of an exercise; false for null and empty."""
    low = F.lower(F.regexp_replace(text, r"(?U)\s+", " "))
    marked = F.exists(F.array(*[F.lit(m) for m in MARKERS]), lambda m: F.contains(low, m))
    return F.coalesce(marked | has_heading(text), F.lit(False))


def register(spark: SparkSession) -> None:
    """``is_exercise_candidate(text)`` and the table function ``exercise_parts(text)`` (n, heading, body) for SQL of this session.

    Both are SQL functions over built-in ones, which the optimiser sees through; nothing leaves the JVM.
    """
    quoted = lambda s: "r'" + s + "'"
    marks = ", ".join(f"'{m}'" for m in MARKERS)
    heading = quoted("(?iU)" + HEADING)
    spark.sql(
        f"CREATE OR REPLACE TEMPORARY FUNCTION is_exercise_candidate(t STRING) RETURNS BOOLEAN RETURN "
        f"coalesce(exists(array({marks}), m -> contains(lower(regexp_replace(t, r'(?U)\\s+', ' ')), m)) OR exists(split(t, {quoted(_LINES)}), l -> l RLIKE {heading}), false)"
    )
    begins = quoted("(?iUm)(?=" + HEADING.replace(r"^\s*", r"^[^\S\n]*") + ")")
    spark.sql(
        "CREATE OR REPLACE TEMPORARY FUNCTION exercise_parts(t STRING) RETURNS TABLE (n INT, heading STRING, body STRING) RETURN "
        f"SELECT p.pos, trim(split(p.part, '\\n')[0]), regexp_replace(substr(p.part, length(split(p.part, '\\n')[0]) + 2), r'^\\s+|\\s+$', '') FROM (SELECT posexplode(filter(split(t, {begins}), x -> x RLIKE {heading})) AS (pos, part)) p"
    )


def parts(pages: DataFrame, key: str, text: str) -> DataFrame:
    """key, n (from 0), heading, body: a page cut before each line that is a heading; what stands before the first is no exercise."""
    begins = "(?iUm)(?=" + HEADING.replace(r"^\s*", r"^[^\S\n]*") + ")"
    found = F.filter(F.split(text, begins), lambda x: x.rlike("(?iU)" + HEADING))
    rows = pages.select(key, F.posexplode(found).alias("n", "_part"))
    first = F.get(F.split("_part", "\n"), 0)
    return rows.select(key, "n", F.trim(first).alias("heading"), F.regexp_replace(F.substring("_part", F.length(first) + 2, F.length("_part")), r"^\s+|\s+$", "").alias("body"))


def examples(chunks: DataFrame, document: Column, pages: tuple[int, int], topic: str = "", limit: int = 20, order: list[str] | None = None) -> DataFrame:
    """The first ``limit`` passages of a document's pages that have an exercise's heading and all words of the topic, copies once, with
    needs_source_check. chunks: filename, page, chunk_index, text, is_scanned, status.

    Passages are equal if they are but for layout and case; the first in the order of page and chunk stays, and its text as it is.
    """
    order = order or ["page", "chunk_index"]
    inside = chunks.where(document & F.col("page").between(*pages) & is_candidate(F.col("text")) & has_heading(F.col("text")))
    spark = chunks.sparkSession
    wanted = [w for w in spark.range(1).select(words(F.lower(cleaned(F.lit(topic))))).first()[0] if len(w) > 1] if topic.strip() else []
    searchable = F.lower(cleaned(F.col("text")))
    for w in wanted:
        inside = inside.where(F.contains(searchable, F.lit(w)))
    mark = F.lower(F.trim(F.regexp_replace("text", r"(?U)\s+", " ")))
    check = F.coalesce(F.col("is_scanned"), F.lit(False)) | F.coalesce(F.col("status").isin(PARTIAL), F.lit(False)) | F.col("text").rlike(DAMAGED)
    once = inside.groupBy(F.sha2(mark.cast("binary"), 256).alias("_mark")).agg(F.min(F.struct(*order, "filename", "text", check.alias("needs_source_check"))).alias("x"))
    return once.select("x.*").orderBy(*order, "filename").limit(limit)
