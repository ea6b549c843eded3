"""Re-scoring of keyword hits: additive terms on the BM25 score."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scholia.functions.cleaning import let
from scholia.functions.definitions import content_words, role
from scholia.functions.query import any_of
from scholia.functions.text import fold_marks, is_contents


# Cues of a definition, and of conditions and properties, in a passage that holds the concept.
DEFINITIONS = ("định nghĩa", "khái niệm", "được định nghĩa là", "là giới hạn", "công thức", "definition")
CONDITIONS = ("hai điều kiện", "tính chất", "thỏa", "f(u + v)", "f(αu)", "nguyên lý", "đặc điểm")


def relevance(score: Column, text: Column, file: Column, concepts: list[str], scope: list[str] | None = None, definition: bool = False, cues: tuple[str, ...] = DEFINITIONS, conditions: tuple[str, ...] = CONDITIONS) -> Column:
    """10|s| / (1 + |s|), plus scope, minus contents pages and catalogues, plus concepts held, definitions and explanations; 4 places."""
    s = F.abs(score)
    out = 10.0 * s / (1.0 + s)
    low = F.lower(text)
    if scope:
        met = sum((F.contains(fold_marks(file), fold_marks(F.lit(t))).cast("int") for t in scope), F.lit(0))
        out = out + met / float(len(scope)) * 30.0
    out = out - F.when(is_contents(text), 50.0).otherwise(0.0)
    held = [F.contains(low, F.lit(c.lower())) for c in concepts]
    count = sum((h.cast("int") for h in held), F.lit(0))
    if len(concepts) >= 2:
        out = out + F.when(count >= 2, 25.0).when(count == 1, 12.0).otherwise(0.0)
    elif concepts:
        out = out + F.when(count == 1, 25.0).otherwise(0.0)
    words = F.lit(False)
    for c in concepts:
        if len(content_words(c)) >= 2:
            each = F.lit(True)
            for w in content_words(c):
                each = each & F.contains(low, F.lit(w))
            words = words | each
    out = out + F.when((count == 0) & words, 10.0).otherwise(0.0)
    loose = F.when(any_of(low, list(cues)), 8.0).otherwise(0.0) + F.when(any_of(low, list(conditions)), 5.0).otherwise(0.0) if definition else F.lit(0.0)

    def form(r: Column) -> Column:
        attached = (25.0 if definition else 15.0) + F.when(r["explained"], 15.0).otherwise(0.0)
        return F.when(r["attached"], attached).when(r["catalogue"], -35.0).when(count > 0, loose).otherwise(0.0)

    return F.round(out + let(role(text, concepts), form), 4)


def rerank(hits: DataFrame, k: int, key: str = "doc_id", file: str = "source", **terms) -> DataFrame:
    scored = hits.withColumn("relevance", relevance(F.col("score"), F.col("text"), F.col(file), **terms))
    return scored.orderBy(F.desc("relevance"), key).limit(k)
