"""Study material: exercises and answers in texts, generated questions, quizzes by rule, ranked passages, training samples."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scholia.functions.text import matching

QUESTION = "struct<question: string, choices: array<string>, answer: string, quote: string>"
_ITEMS = "array<struct<section: string, number: int, text: string>>"


def numbered_items(text: str) -> list[tuple[str, int, str]]:
    """(section, number, text) of numbered items below headings of exercises or answers; an item ends at the next item or heading."""
    out: list[tuple[str, int, str]] = []
    section, number, body = "", None, []

    def close() -> None:
        if section and number is not None and " ".join(body).strip():
            out.append((section, number, " ".join(body).strip()))

    for line in text.split("\n"):
        head = re.match(r"(?i)^\s*#{0,4}\s*(exercises?|bài tập|answers?|solutions?|đáp án|lời giải)\s*:?\s*$", line)
        item = re.match(r"^\s*(?:[-*]\s*)?(?:bài|câu|question|exercise)?\s*(\d{1,3})[.):]\s+(.*)$", line, re.I)
        if head or re.match(r"^\s*#{1,4}\s+\S", line):
            close()
            number, body = None, []
            word = head.group(1).lower() if head else ""
            section = "" if not head else "exercise" if word.startswith(("exercise", "bài")) else "answer"
        elif item and section:
            close()
            number, body = int(item.group(1)), [item.group(2).strip()]
        elif number is not None:
            body.append(line.strip())
    close()
    return out


def items(pages: DataFrame, key: str, text: str) -> DataFrame:
    """key, section, number, text: a sequential scan of lines, so a vectorised UDF."""

    @F.pandas_udf(_ITEMS)
    def scan(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: numbered_items(t) if t else [])

    return pages.select(key, F.explode(scan(F.col(text))).alias("x")).select(key, "x.*")


def question_problem(raw: Column, passage: Column) -> Column:
    """Why a generated question is not taken, by the first rule that holds; null where it is."""
    q = F.from_json(F.regexp_replace(raw, r"(?s)^\s*```(?:json)?\s*|\s*```\s*$", ""), QUESTION)
    choices = F.transform(q["choices"], lambda c: matching(c))
    return (
        F.when(q.isNull() | q["question"].isNull(), "no_question")
        .when(~F.length(F.trim(q["question"])).between(10, 500), "question_length")
        .when(F.coalesce(F.size(F.array_distinct(choices)), F.lit(0)) != 4, "choices")
        .when(F.size(q["choices"]) != 4, "choices")
        .when(~F.coalesce(q["answer"], F.lit("")).rlike("^[A-D]$"), "answer")
        .when(~F.coalesce(F.contains(matching(passage), matching(q["quote"])) & (F.length(F.trim(q["quote"])) >= 10), F.lit(False)), "quote")
    )


def gaps(pages: DataFrame, key: str, text: str, limit: int) -> DataFrame:
    """key, question, answer: the first sentence of eight words or more with its longest word taken out; at most ``limit``."""
    parts = F.filter(F.split(text, r"(?<=[.!?])\s+"), lambda s: F.regexp_count(s, F.lit(r"\S+")) >= 8)
    first = pages.select(key, F.get(parts, 0).alias("s")).where("s is not null").orderBy(key).limit(limit)
    words = F.regexp_extract_all("s", F.lit(r"[\p{L}]+"), F.lit(0))
    longest = F.array_max(F.transform(words, lambda w, i: F.struct(F.length(w).alias("n"), (-i).alias("i"), w.alias("w"))))["w"]
    return first.withColumn("answer", longest).select(key, F.replace("s", F.col("answer"), F.lit("____")).alias("question"), "answer")


def passages(chunks: DataFrame, topic: list[str], weak: list[str], key: str, text: str, k: int = 6) -> DataFrame:
    """key, points of the best k chunks: 100 for the whole topic, 10 a topic word, 5 a weaker one; those under half of the best go (under 50 where the best has 100)."""
    low = F.lower(F.col(text))
    points = F.when(F.contains(low, F.lit(" ".join(topic))), 100).otherwise(0)
    for words, each in ((topic, 10), (weak, 5)):
        for w in words:
            points = points + F.when(F.contains(low, F.lit(w)), each).otherwise(0)
    best = chunks.select(key, points.alias("points")).where("points > 0").orderBy(F.desc("points"), key).limit(k)
    top = F.max("points").over(Window.partitionBy(F.lit(1)))  # k rows
    return best.withColumn("_top", top).where(F.col("points") >= F.when(F.col("_top") >= 100, F.greatest(F.lit(50), F.col("_top") / 2)).otherwise(F.col("_top") / 2)).drop("_top")


def chat_samples(rows: DataFrame, key: str, question: Column, answer: Column, system: str) -> DataFrame:
    """key, messages: one training sample a row."""
    said = lambda role, text: F.struct(F.lit(role).alias("role"), text.alias("content"))
    return rows.select(key, F.array(said("system", F.lit(system)), said("user", question), said("assistant", answer)).alias("messages"))


def zipped(left: DataFrame, right: DataFrame, group: str, order: str) -> DataFrame:
    """Rows of both by place within the group: group, place, left, right; a side that is too short is null."""
    w = Window.partitionBy(group).orderBy(order)
    number = lambda df, name: df.select(group, F.row_number().over(w).alias("place"), F.col(order).alias(name))
    return number(left, "left").join(number(right, "right"), [group, "place"], "full_outer")
