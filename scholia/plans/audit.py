"""Audit, status and streaming queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scholia.operators import audit as A
from scholia.operators import stores as S
from scholia.sources.tables import table
from scholia.streaming import runs


def latest_per_key(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").select("user_id", "event_type", "ts", "event_id", "value")
    return A.latest(rows, ["user_id", "event_type"], ["ts", "event_id"]).select("user_id", "event_type", "event_id", "value")


def corpus_audit(spark: SparkSession, d: str) -> DataFrame:
    """The index lacks every seventh document, has one that is gone for every eleventh, and old text for every fifth."""
    docs = table(spark, d, "documents").select("doc_id", F.md5(F.col("text").cast("binary")).alias("digest"))
    expected = docs.where("doc_id % 11 <> 3")
    indexed = docs.where("doc_id % 7 <> 2").withColumn("digest", F.when(F.col("doc_id") % 5 == 1, F.md5(F.col("digest").cast("binary"))).otherwise(F.col("digest")))
    vectors = table(spark, d, "embeddings").withColumnRenamed("vec_id", "doc_id")
    return A.failures(expected, indexed, vectors, "doc_id", "digest", 64)


def incremental_skip(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", F.md5(F.col("text").cast("binary")).alias("digest"), F.lit(2).alias("version"))
    stored = docs.where("doc_id % 3 <> 0").withColumn("version", F.when(F.col("doc_id") % 4 == 0, 1).otherwise(2))
    return A.changed(docs, stored, "doc_id", "digest", "version").select("doc_id")


def upsert_quality(spark: SparkSession, d: str) -> DataFrame:
    old = table(spark, d, "labels").select("doc_id", "quality", F.lit(1).alias("version"))
    new = table(spark, d, "documents").where("doc_id % 9 = 0").select("doc_id", (F.col("n_chars") > 1000).cast("int").alias("quality"), F.lit(2).alias("version"))
    return S.upsert(old, new, "doc_id", "version")


def replace_page_chunks(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("source", (F.col("doc_id") % 10).alias("page"), "n_chars")
    new = docs.where("source = 'src4' and page = 4").groupBy("source", "page").agg(F.sum("n_chars").alias("n_chars"))
    return A.replace_pages(docs, new, ["source", "page"]).groupBy("source", "page").agg(F.count(F.lit(1)).alias("chunks"), F.sum("n_chars").alias("chars"))


def last_accepted(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").select("user_id", "event_id", F.when(F.col("value") > 50, "accepted").otherwise("rejected").alias("state"))
    return A.last_accepted(rows, "user_id", "event_id", "state")


def status_report(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "n_chars").join(table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), F.lit(1).alias("has")), "doc_id", "left")
    return docs.agg(F.count(F.lit(1)).alias("documents"), F.count_if(F.col("has") == 1).alias("embedded"), F.count_if(F.col("has").isNull()).alias("pending"), F.coalesce(F.sum("n_chars"), F.lit(0)).alias("chars"))


def telemetry_upsert(spark: SparkSession, d: str) -> DataFrame:
    steps = table(spark, d, "events").select("user_id", F.hour("ts").alias("step"), F.struct("ts", "event_id").alias("at"), "value")
    return A.telemetry(steps, "user_id", "step", "at", "value")


def page_state(spark: SparkSession, d: str) -> DataFrame:
    n = F.length(F.trim(F.regexp_replace("html", r"<[^>]*>", "")))
    images = F.regexp_count("html", F.lit("(?i)<img")) > 0
    state = F.when(n >= 30, "text_verified").when(images, "visual_content_pending").when(n == 0, "blank_verified").otherwise("ocr_pending_review")
    return table(spark, d, "pages").select("page_id", state.alias("state"))


def stream_dedupe(spark: SparkSession, d: str) -> DataFrame:
    return runs.deduplicated(spark, f"{d}/events.parquet", ["user_id", "event_type"], "ts")


def stream_windows(spark: SparkSession, d: str) -> DataFrame:
    return runs.tumbling(spark, f"{d}/events.parquet", "ts", "1 day", "event_type")


def stream_sessions(spark: SparkSession, d: str) -> DataFrame:
    return runs.sessions(spark, f"{d}/events.parquet", "ts", "1 hour", "user_id")


ORACLES = {
    "latest_per_key": "SELECT user_id, event_type, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1",
    "corpus_audit": """WITH d AS (SELECT doc_id, md5(text) AS h FROM documents), e AS (SELECT * FROM d WHERE doc_id % 11 <> 3), i AS (SELECT doc_id, CASE WHEN doc_id % 5 = 1 THEN md5(h) ELSE h END AS h FROM d WHERE doc_id % 7 <> 2)
SELECT 'missing' AS kind, doc_id FROM e WHERE doc_id NOT IN (SELECT doc_id FROM i) UNION ALL SELECT 'obsolete', doc_id FROM i WHERE doc_id NOT IN (SELECT doc_id FROM e)
UNION ALL SELECT 'source_changed', doc_id FROM e JOIN i USING (doc_id) WHERE e.h <> i.h UNION ALL SELECT CASE WHEN embedding IS NULL THEN 'vector_missing' ELSE 'wrong_dimension' END, doc_id FROM i LEFT JOIN embeddings ON vec_id = doc_id WHERE embedding IS NULL OR len(embedding) <> 64""",
    "incremental_skip": "SELECT doc_id FROM documents WHERE doc_id % 3 = 0 OR doc_id % 4 = 0",
    "upsert_quality": "SELECT doc_id, quality, 1 AS version FROM labels WHERE doc_id % 9 <> 0 UNION ALL SELECT doc_id, (n_chars > 1000)::INT, 2 FROM documents WHERE doc_id % 9 = 0",
    "replace_page_chunks": "SELECT source, doc_id % 10 AS page, CASE WHEN source = 'src4' AND doc_id % 10 = 4 THEN 1 ELSE count(*) END AS chunks, sum(n_chars)::BIGINT AS chars FROM documents GROUP BY 1, 2",
    "last_accepted": "SELECT user_id, max(event_id) AS event_id FROM events WHERE value > 50 GROUP BY 1",
    "status_report": "SELECT count(*) AS documents, count(vec_id) AS embedded, count(*) - count(vec_id) AS pending, sum(n_chars)::BIGINT AS chars FROM documents LEFT JOIN embeddings ON vec_id = doc_id",
    "telemetry_upsert": "WITH n AS (SELECT user_id, hour(ts)::INT AS step, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, hour(ts) ORDER BY ts DESC, event_id DESC) = 1) SELECT *, min(value) OVER (PARTITION BY user_id ORDER BY step) AS best FROM n",
    "page_state": "WITH p AS (SELECT page_id, length(trim(regexp_replace(html, '<[^>]*>', '', 'g'))) AS n, regexp_matches(html, '(?i)<img') AS i FROM pages) SELECT page_id, CASE WHEN n >= 30 THEN 'text_verified' WHEN i THEN 'visual_content_pending' WHEN n = 0 THEN 'blank_verified' ELSE 'ocr_pending_review' END AS state FROM p",
    "stream_dedupe": "SELECT DISTINCT user_id, event_type FROM events",
    "stream_windows": "SELECT date_trunc('day', ts)::TIMESTAMP AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2",
    "stream_sessions": "WITH s AS (SELECT user_id, ts, (ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 1 HOUR) IS NOT TRUE AS fresh FROM events), g AS (SELECT *, sum(fresh::INT) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM s) SELECT min(ts)::TIMESTAMP AS start, user_id, count(*) AS n FROM g GROUP BY user_id, k",
}
QUERIES = {f.__name__: f for f in (latest_per_key, corpus_audit, incremental_skip, upsert_quality, replace_page_chunks, last_accepted, status_report, telemetry_upsert, page_state, stream_dedupe, stream_windows, stream_sessions)}
