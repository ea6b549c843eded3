"""Queries on what may be trained on, proofs of samples, exercises and curricula."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scholia.operators import curricula as C
from scholia.operators import exercises as E
from scholia.operators import gates as G
from scholia.operators import provenance as V
from scholia.sources.tables import table


def training_gate(spark: SparkSession, d: str) -> DataFrame:
    """Documents as chunks of their own pages: the chunk is the second 40 characters; files, hashes, pages and transcripts lack something by the document's number."""
    docs = table(spark, d, "documents").select("doc_id", "text", F.concat_ws("/", "source", F.concat(F.lit("f"), "doc_id")).alias("filename"), F.sha2(F.col("text").cast("binary"), 256).alias("h"))
    n = F.col("doc_id") % 20
    part = F.when(n == 3, "  ").when(n == 4, "words that no page of any file holds, surely").otherwise(F.regexp_replace(F.substring("text", 41, 40), r"\s+", "  "))
    chunks = docs.select(F.col("doc_id").alias("chunk_id"), "filename", F.lit(1).alias("page"), part.alias("text"), F.when(n == 2, "0123").when(n == 5, F.sha2("filename", 256)).otherwise(F.col("h")).alias("file_hash"))
    files = docs.where(n != 1).select("filename", F.col("h").alias("current_hash"), n.between(8, 15).alias("is_scanned"))
    pages = docs.select("filename", F.lit(1).alias("page"), F.col("text").alias("native_text"))
    region = F.array(F.struct(F.when(n == 13, "pending").otherwise("verified").alias("status"), F.when(n == 14, F.lit(None)).otherwise(F.col("text")).alias("text")))
    reviews = docs.select(
        F.col("h").alias("source_hash"), F.lit(1).alias("page"), (n != 9).alias("is_verified"), F.lit(False).alias("handwriting_suspected"), F.when(n != 10, "someone").alias("verified_by"), F.lit("2024-01-01").alias("verified_at"),
        F.when(n >= 12, "ocr-region-review-v2").alias("review_schema"), region.alias("regions"), F.when(n == 15, F.concat("text", F.lit("x"))).when(n >= 12, F.regexp_replace("text", r"^\s+|\s+$", "")).otherwise(F.col("text")).alias("text"),
    )
    excluded = docs.where(n == 6).select("filename", F.lit(1).alias("page"))
    return G.gate(chunks, files, pages, reviews.unionByName(reviews.where(n == 11)), excluded, ["src3/"]).withColumnRenamed("chunk_id", "doc_id")


def sample_proof(spark: SparkSession, d: str) -> DataFrame:
    """Samples of documents, sealed and then changed in one link by the document's number."""
    docs = table(spark, d, "documents").select("doc_id", "text")
    n = F.col("sample_id") % 13
    made = docs.select(F.col("doc_id").alias("sample_id"), F.col("doc_id").alias("source_id"), F.col("text").alias("source_text"), F.concat(F.lit("What does text "), "doc_id", F.lit(" say?")).alias("question"), F.concat(F.lit("Answer from: "), F.substring("text", 1, 50)).alias("prompt"), F.substring("text", 51, 80).alias("target"), F.concat(F.lit('{"supported": '), (F.col("doc_id") % 13 != 9).cast("string"), F.lit("}")).alias("verdict"))
    sealed = V.sealed(made)
    for k, column in enumerate(["question", "prompt", "target", "verdict"]):
        sealed = sealed.withColumn(column, F.when(n == k + 1, F.concat(column, F.lit(" "))).otherwise(F.col(column)))
    sealed = sealed.withColumn("target_digest", F.when(n != 5, F.col("target_digest"))).withColumn("source_digest", F.when(n != 6, F.col("source_digest")))
    sealed = sealed.unionByName(sealed.where(n == 10))
    k = F.col("doc_id") % 13
    live = docs.where(k != 7).select(F.col("doc_id").alias("source_id"), F.when(k == 8, F.concat("text", F.lit("."))).otherwise(F.col("text")).alias("text"), F.when(k == 11, "ocr_pending_review").otherwise("text_verified").alias("state"))
    return V.proof(sealed, live).select(F.col("sample_id").alias("doc_id"), F.array_join("faults", ",").alias("faults"))


def exercise_candidates(spark: SparkSession, d: str) -> DataFrame:
    """The predicate as SQL calls it, and the parts that the table function cuts, over documents whose every third has exercises put in."""
    E.register(spark)
    n = F.col("doc_id")
    body = F.when(n % 3 == 0, F.concat(F.lit("Intro\n  Bài tập "), n, F.lit(": "), F.substring("text", 1, 30), F.lit("\nmore\n- Example\n"), F.substring("text", 31, 30))).when(n % 3 == 1, F.concat(F.lit("practice makes  perfect "), "text")).otherwise(F.col("text"))
    table(spark, d, "documents").select("doc_id", body.alias("text")).createOrReplaceTempView("exercise_pages")
    return spark.sql(
        "WITH p AS (SELECT e.doc_id, count(*) AS parts, max(length(p.heading)) AS heading_chars FROM exercise_pages e, LATERAL exercise_parts(e.text) p GROUP BY e.doc_id) "
        "SELECT e.doc_id, is_exercise_candidate(e.text) AS candidate, coalesce(parts, 0) AS parts, coalesce(heading_chars, 0) AS heading_chars FROM exercise_pages e LEFT JOIN p ON p.doc_id = e.doc_id"
    )


def example_exercises(spark: SparkSession, d: str) -> DataFrame:
    """The first twenty exercises of a source's pages; every sixth document repeats one text in other layout."""
    n = F.col("doc_id")
    text = F.when(n % 6 == 0, F.concat(F.lit("Ví dụ 1\nthe  SAME "), (n % 2).cast("string"))).when(n % 6 == 1, F.concat(F.lit("Problem\n"), n, F.lit(" ≤ the same"))).otherwise(F.col("text"))
    chunks = table(spark, d, "documents").select(F.col("source").alias("filename"), (n % 10).alias("page"), n.alias("chunk_index"), text.alias("text"), F.lit(False).alias("is_scanned"), F.lit("indexed").alias("status"))
    return E.examples(chunks, F.col("filename").isin("src1", "src2", "src3"), (0, 8), topic="The  same").select("filename", "page", "chunk_index", "needs_source_check")


def curriculum(spark: SparkSession, d: str) -> DataFrame:
    """An exercise for every document, made from its number."""
    rows = table(spark, d, "documents").select("doc_id", (F.col("doc_id") * 7919 + 13).alias("number"))
    return C.enumerated(rows, "number", C.arithmetic()).drop("number")


ORACLES = {
    "training_gate": r"""WITH d AS (SELECT doc_id, doc_id % 20 AS n, source, text, substr(text, 41, 40) AS part FROM documents),
c AS (SELECT *, CASE WHEN n = 3 THEN '' ELSE trim(regexp_replace(part, '\s+', ' ', 'g')) END AS p FROM d),
r AS (SELECT doc_id, CASE WHEN source = 'src3' THEN 'forbidden_source' WHEN n = 1 THEN 'source_missing' WHEN n = 2 THEN 'invalid_hash' WHEN n <> 4 AND p = '' THEN 'blank_text' WHEN n = 5 THEN 'source_changed' WHEN n = 6 THEN 'page_excluded'
WHEN n = 4 THEN 'no_verified_text' WHEN n NOT BETWEEN 8 AND 15 AND length(trim(regexp_replace(text, '^\s+|\s+$', '', 'g'))) >= 30 THEN 'native' WHEN text IN (SELECT text FROM d WHERE n NOT IN (9, 10, 13, 14, 15)) THEN 'verified_transcript' ELSE 'no_verified_text' END AS reason FROM c)
SELECT doc_id, reason IN ('native', 'verified_transcript') AS allowed, reason FROM r""",
    "sample_proof": """SELECT doc_id, CASE doc_id % 13 WHEN 1 THEN 'question_changed' WHEN 2 THEN 'prompt_changed' WHEN 3 THEN 'target_changed' WHEN 4 THEN 'verdict_changed' WHEN 5 THEN 'target_digest_missing' WHEN 6 THEN 'source_digest_missing'
WHEN 7 THEN 'source_missing' WHEN 8 THEN 'source_changed' WHEN 9 THEN 'verdict_negative' WHEN 10 THEN 'key_repeated' WHEN 11 THEN 'source_not_verified' ELSE '' END AS faults FROM documents""",
    "exercise_candidates": r"""WITH d AS (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'Intro' || chr(10) || '  Bài tập ' || doc_id || ': ' || substr(text, 1, 30) || chr(10) || 'more' || chr(10) || '- Example' || chr(10) || substr(text, 31, 30) WHEN 1 THEN 'practice makes  perfect ' || text ELSE text END AS t FROM documents),
l AS (SELECT doc_id, t, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(lower(x), '^\s*(?:[-*•]\s*)?(?:bài\s+tập|câu\s+hỏi|(?:bài|câu)\s+\d+|ví\s+dụ|worked\s+examples?|examples?|exercises?|practice\s+questions|review\s+questions|problems?)(?:$|[^\pL\pN_])')) AS hs FROM d)
SELECT doc_id, len(hs) > 0 OR list_bool_or(list_transform(['bài tập', 'câu hỏi', 'ví dụ', 'bài ', 'câu ', 'exercise', 'example', 'practice', 'review questions', 'problem'], lambda m: contains(lower(regexp_replace(t, '\s+', ' ', 'g')), m))) AS candidate, len(hs) AS parts, coalesce(list_max(list_transform(hs, lambda h: length(trim(h)))), 0) AS heading_chars FROM l""",
    "example_exercises": """WITH c AS (SELECT source AS filename, doc_id % 10 AS page, doc_id AS chunk_index, CASE WHEN doc_id % 6 = 0 THEN 'x' || doc_id % 2 ELSE 'p' || doc_id END AS mark, doc_id % 6 = 1 AS needs_source_check FROM documents WHERE source IN ('src1', 'src2', 'src3') AND doc_id % 10 <= 8 AND doc_id % 6 <= 1),
o AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY mark ORDER BY page, chunk_index, filename) = 1) SELECT filename, page, chunk_index, needs_source_check FROM o ORDER BY page, chunk_index, filename LIMIT 20""",
    "curriculum": """WITH d AS (SELECT doc_id, (doc_id * 7919 + 13) % (50000 + 10000 + 2000 + 1900) AS k, ['pages', 'books', 'exercises', 'chapters', 'notes'] AS th FROM documents),
v AS (SELECT doc_id, k, CASE WHEN k < 50000 THEN 'sum' WHEN k < 60000 THEN 'product' WHEN k < 62000 THEN 'share' ELSE 'percent' END AS template, th[k % 5 + 1] AS x, CASE WHEN k < 50000 THEN k // 500 + 2 WHEN k < 60000 THEN (k - 50000) // 500 + 2 WHEN k < 62000 THEN (k - 60000) // 100 + 2 ELSE ((k - 62000) // 100 + 1) * 5 END AS a, CASE WHEN k < 60000 THEN k // 5 % 100 + 2 ELSE k % 100 + 2 END AS b FROM d)
SELECT doc_id, template, CASE template WHEN 'sum' THEN 'A shelf holds ' || a || ' ' || x || ' and another ' || b || '. How many ' || x || ' are there?' WHEN 'product' THEN a || ' boxes hold ' || b || ' ' || x || ' each. How many ' || x || ' are there?'
WHEN 'share' THEN (a * b) || ' pages are read in ' || a || ' equal parts. How long is a part?' ELSE 'What is ' || a || ' % of ' || (b * 20) || '?' END AS text, (CASE template WHEN 'sum' THEN a + b WHEN 'product' THEN a * b WHEN 'share' THEN b ELSE a * b // 5 END)::VARCHAR AS answer FROM v""",
}

QUERIES = {f.__name__: f for f in (training_gate, sample_proof, exercise_candidates, example_exercises, curriculum)}
