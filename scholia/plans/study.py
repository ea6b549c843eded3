"""Queries on study material and positional pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scholia.operators import study, timetable
from scholia.sources.tables import table


def question_validation(spark: SparkSession, d: str) -> DataFrame:
    """Questions made from documents; some lack a choice, an answer or a quote of the text."""
    n = F.col("doc_id") % 6
    said = F.to_json(F.struct(F.when(n == 1, F.lit("Short")).otherwise(F.lit("What does the passage say?")).alias("question"), F.when(n == 2, F.array(F.lit("a"), F.lit("b"), F.lit("A "), F.lit("d"))).otherwise(F.array(F.lit("a"), F.lit("b"), F.lit("c"), F.lit("d"))).alias("choices"), F.when(n == 3, F.lit("E")).otherwise(F.lit("B")).alias("answer"), F.when(n == 4, F.lit("not in the passage at all")).otherwise(F.substring("text", 1, 20)).alias("quote")))
    rows = table(spark, d, "documents")
    return rows.select("doc_id", F.coalesce(study.question_problem(F.when(n == 5, F.lit("no json")).otherwise(said), F.col("text")), F.lit("")).alias("problem"))


def gap_quiz(spark: SparkSession, d: str) -> DataFrame:
    return study.gaps(table(spark, d, "documents"), "doc_id", "text", 200)


def topic_passages(spark: SparkSession, d: str) -> DataFrame:
    return study.passages(table(spark, d, "documents"), ["of", "the"], ["onsh", "eron"], "doc_id", "text")


def turn_zip(spark: SparkSession, d: str) -> DataFrame:
    turns = table(spark, d, "conversations")
    pairs = study.zipped(turns.where("role = 'user'"), turns.where("role = 'assistant'"), "conv_id", "turn")
    return pairs.select("conv_id", F.col("place").cast("int").alias("place"), "left", "right")


def chat_samples(spark: SparkSession, d: str) -> DataFrame:
    rows = study.chat_samples(table(spark, d, "documents"), "doc_id", F.concat(F.lit("Language of: "), F.substring("text", 1, 40)), F.col("lang"), "Answer with a code.")
    return rows.select("doc_id", F.to_json("messages").alias("messages"))


def weekday_names(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", timetable.weekday(F.date_format("ts", "EEEE")).alias("day"), timetable.clock(F.date_format("ts", "HHmm")).alias("time"))


ORACLES = {
    "chat_samples": r"""SELECT doc_id, '[{"role":"system","content":"Answer with a code."},{"role":"user","content":' || to_json('Language of: ' || text[1:40])::VARCHAR || '},{"role":"assistant","content":"' || lang || '"}]' AS messages FROM documents""",
    "gap_quiz": r"""WITH s AS (SELECT doc_id, list_filter(string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: len(regexp_extract_all(x, '\S+')) >= 8)[1] AS s FROM documents),
f AS (SELECT * FROM s WHERE s IS NOT NULL ORDER BY doc_id LIMIT 200), w AS (SELECT *, regexp_extract_all(s, '\p{L}+') AS w FROM f),
l AS (SELECT *, list_filter(w, lambda x: length(x) = list_max(list_transform(w, lambda y: length(y))))[1] AS answer FROM w) SELECT doc_id, replace(s, answer, '____') AS question, answer FROM l""",
    "question_validation": r"""WITH r AS (SELECT doc_id, text, CASE doc_id % 6 WHEN 5 THEN NULL WHEN 1 THEN 'Short' ELSE 'What does the passage say?' END AS q, CASE doc_id % 6 WHEN 2 THEN ['a', 'b', 'A ', 'd'] ELSE ['a', 'b', 'c', 'd'] END AS c, CASE doc_id % 6 WHEN 3 THEN 'E' ELSE 'B' END AS a, CASE doc_id % 6 WHEN 4 THEN 'not in the passage at all' ELSE text[1:20] END AS quote FROM documents),
m AS (SELECT *, list_transform(c, lambda x: lower(trim(x))) AS lc, lower(trim(regexp_replace(text, '[\s\x{00A0}]+', ' ', 'g'))) AS mt, lower(trim(regexp_replace(quote, '[\s\x{00A0}]+', ' ', 'g'))) AS mq FROM r)
SELECT doc_id, CASE WHEN q IS NULL THEN 'no_question' WHEN length(trim(q)) NOT BETWEEN 10 AND 500 THEN 'question_length' WHEN len(list_distinct(lc)) <> 4 OR len(c) <> 4 THEN 'choices' WHEN NOT regexp_matches(a, '^[A-D]$') THEN 'answer' WHEN NOT (contains(mt, mq) AND length(trim(quote)) >= 10) THEN 'quote' ELSE '' END AS problem FROM m""",
    "topic_passages": "WITH p AS (SELECT doc_id, CASE WHEN contains(lower(text), 'of the') THEN 100 ELSE 0 END + 10 * contains(lower(text), 'of')::INT + 10 * contains(lower(text), 'the')::INT + 5 * contains(lower(text), 'onsh')::INT + 5 * contains(lower(text), 'eron')::INT AS points FROM documents), b AS (SELECT * FROM p WHERE points > 0 ORDER BY points DESC, doc_id LIMIT 6), m AS (SELECT max(points) AS t FROM b) SELECT doc_id, points::INT AS points FROM b, m WHERE points >= CASE WHEN t >= 100 THEN greatest(50, t / 2) ELSE t / 2 END",
    "turn_zip": "WITH u AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS place FROM conversations WHERE role = 'user'), a AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS place FROM conversations WHERE role = 'assistant') SELECT conv_id, place::INT AS place, u.turn AS \"left\", a.turn AS \"right\" FROM u FULL JOIN a USING (conv_id, place)",
    "weekday_names": "SELECT event_id, isodow(ts)::INT AS day, strftime(ts, '%H:%M') AS time FROM events",
}
QUERIES = {f.__name__: f for f in (question_validation, gap_quiz, topic_passages, turn_zip, chat_samples, weekday_names)}
