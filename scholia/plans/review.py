"""Queries on reviews, evidence, admission and queues."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scholia.operators import review as V
from scholia.sources.tables import table


def _verdicts(spark: SparkSession, d: str, shift: int) -> DataFrame:
    """Verdicts made from labelled documents: some reject, some are no JSON, some quote what the source lacks."""
    rows = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id")
    n = (F.col("doc_id") + shift) % 10
    quote = F.when(n == 3, F.lit("never in any text, surely")).otherwise(F.trim(F.regexp_replace(F.substring("text", 1, 12), r'[\\"\n]', " ")))
    said = F.to_json(F.struct((F.col("quality") == 1).alias("supported"), F.lit("S1").alias("source"), quote.alias("quote")))
    raw = F.when(n == 0, F.lit("not json")).when(n == 1, F.concat(F.lit("```json\n"), said, F.lit("\n```"))).otherwise(said)
    return rows.select("doc_id", V.verdict(raw, F.regexp_replace("text", r'[\\"\n]', " ")).alias("v")).select("doc_id", "v.state")


def verdict_parse(spark: SparkSession, d: str) -> DataFrame:
    return _verdicts(spark, d, 0)


def judge_consensus(spark: SparkSession, d: str) -> DataFrame:
    return V.consensus(_verdicts(spark, d, 0), _verdicts(spark, d, 4), "doc_id")


def page_inspection(spark: SparkSession, d: str) -> DataFrame:
    images = F.regexp_count("html", F.lit("(?i)<img"))
    drawings = F.regexp_count("html", F.lit("(?i)<(svg|path|td)"))
    return table(spark, d, "pages").select("page_id", F.array_join(V.inspection(F.col("html"), images, drawings), ",").alias("warnings"))


def evidence_catalog(spark: SparkSession, d: str) -> DataFrame:
    return V.evidence(table(spark, d, "documents"), "doc_id", "text").select("doc_id", "evidence", F.md5(F.col("sentence").cast("binary")).alias("sentence_md5"))


def passage_pack(spark: SparkSession, d: str) -> DataFrame:
    turns = table(spark, d, "conversations").select("conv_id", F.struct("turn", F.octet_length("text").cast("long").alias("size")).alias("x"))
    per = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list("x"))["size"].alias("sizes"))
    return per.select("conv_id", F.array_join(V.pack_passages(F.col("sizes"), 900).cast("array<string>"), ",").alias("taken"))


def live_admission(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", F.md5(F.col("text").cast("binary")).alias("digest"))
    samples = docs.withColumn("digest", F.when(F.col("doc_id") % 6 == 2, F.lit("old")).otherwise(F.col("digest")))
    live = docs.where("doc_id % 8 <> 5").withColumn("state", F.when(F.col("doc_id") % 9 == 4, "ocr_pending_review").otherwise("text_verified"))
    return V.admission(samples, live, "doc_id", "digest", "state").select("doc_id", F.coalesce("reason", F.lit("")).alias("reason"))


def page_chunk_diff(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").select("source", F.col("doc_id").alias("chunk"), F.md5(F.col("text").cast("binary")).alias("digest"))
    new = rows.where("chunk % 7 <> 1").withColumn("digest", F.when(F.col("chunk") % 5 == 2, F.lit("new")).otherwise(F.col("digest")))
    return V.page_diff(rows.where("chunk % 4 <> 3"), new, "source", "chunk", "digest")


def split_conflict(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").select("source", F.when(F.col("lang") == "es", "valid").otherwise("train").alias("part"))
    return V.split_conflicts(rows, "source", "part")


def review_queue(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").select("user_id", (F.col("event_id") % 40).alias("item"), F.col("event_id").alias("at"))
    return V.queue(rows, "user_id", "item", "at", 10).select("user_id", "item", F.col("place").cast("int").alias("place"))


def summary_update(spark: SparkSession, d: str) -> DataFrame:
    turns = table(spark, d, "conversations").groupBy("conv_id").agg(F.count(F.lit(1)).alias("revision"))
    sessions = turns.select("conv_id", "revision", F.lit("old").alias("summary"), F.lit("old title").alias("title"), F.when(F.col("conv_id") % 2 == 0, "auto").otherwise("manual").alias("title_kind"))
    updates = turns.select("conv_id", (F.col("revision") - F.col("conv_id") % 3).alias("revision"), F.lit("new").alias("summary"), F.lit("new title").alias("title"))
    return V.set_summary(sessions, updates, "conv_id")


def page_digest(spark: SparkSession, d: str) -> DataFrame:
    return V.ordered_digest(table(spark, d, "conversations"), "conv_id", "turn", "text")


def flash_cards(spark: SparkSession, d: str) -> DataFrame:
    return V.cards(table(spark, d, "documents"), "doc_id", "text", 50)


def token_limits(spark: SparkSession, d: str) -> DataFrame:
    """Least, most, mean and total words by language, and how many texts are over a limit."""
    words = table(spark, d, "documents").select("lang", F.regexp_count("text", F.lit(r"\S+")).cast("long").alias("n"))
    return words.groupBy("lang").agg(F.min("n").alias("least"), F.max("n").alias("most"), F.round(F.avg("n"), 6).alias("mean"), F.sum("n").alias("total"), F.count_if(F.col("n") > 1024).alias("over"))


def error_gain(spark: SparkSession, d: str) -> DataFrame:
    """Pass rates before and after by kind of event, as one pivoted aggregate."""
    rows = table(spark, d, "events").select("event_type", (F.col("user_id") % 2 == 0).alias("after"), (F.col("value") > 50).cast("double").alias("ok"))
    rate = lambda c: F.round(F.avg(F.when(c, F.col("ok"))), 6)
    return rows.groupBy("event_type").agg(rate(~F.col("after")).alias("rate_before"), rate(F.col("after")).alias("rate_after"), F.round(F.avg(F.when(F.col("after"), F.col("ok"))) - F.avg(F.when(~F.col("after"), F.col("ok"))), 6).alias("gain"))


def _state(shift: int) -> str:
    n = f"(doc_id + {shift}) % 10"
    return f"CASE WHEN {n} = 0 THEN 'invalid' WHEN quality <> 1 THEN 'rejected' WHEN {n} = 3 OR length(trim(regexp_replace(text[1:12], '[\\\\\"\\n]', ' ', 'g'))) = 0 THEN 'uncertain' ELSE 'supported' END"


ORACLES = {
    "flash_cards": r"""WITH f AS (SELECT doc_id, regexp_extract(text, '(?m)^\s*([\p{Lu}][\p{L} ]{2,40}?)\s+(?:is|are|means|là|ist|est|es)\s+([^.\n]{10,200})\.', ['term', 'meaning']) AS c FROM documents)
SELECT doc_id, c.term AS term, c.meaning AS meaning FROM f WHERE c.term <> '' ORDER BY doc_id LIMIT 50""",
    "verdict_parse": f"SELECT doc_id, {_state(0)} AS state FROM documents JOIN labels USING (doc_id)",
    "judge_consensus": f"SELECT doc_id, {_state(0)} = 'supported' AND {_state(4)} = 'supported' AS kept FROM documents JOIN labels USING (doc_id)",
    "evidence_catalog": r"""WITH l AS (SELECT doc_id, n, trim(line) AS line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS n FROM documents)),
s AS (SELECT doc_id, n, k, trim(ps[k]) AS p FROM (SELECT doc_id, n, ps, unnest(range(1, len(ps) + 1)) AS k FROM (SELECT doc_id, n, string_split(regexp_replace(regexp_replace(line, '([^\n]\.)\s+', '\1' || chr(1), 'g'), '[!?]+\s+|;\s+', chr(1), 'g'), chr(1)) AS ps FROM l))),
e AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY n, k) AS i, p FROM s WHERE length(p) >= 3)
SELECT doc_id, 'E' || i AS evidence, md5(p) AS sentence_md5 FROM e WHERE i <= 30 UNION ALL SELECT doc_id, 'E1', md5(trim(text)) FROM documents WHERE trim(text) <> '' AND doc_id NOT IN (SELECT doc_id FROM e)""",
    "live_admission": "SELECT doc_id, CASE WHEN doc_id % 8 = 5 THEN 'document_missing' WHEN doc_id % 9 = 4 THEN 'page_not_verified' WHEN doc_id % 6 = 2 THEN 'text_changed' ELSE '' END AS reason FROM documents",
    "page_chunk_diff": "SELECT source, count(*) FILTER (doc_id % 4 <> 3 AND doc_id % 7 <> 1 AND doc_id % 5 <> 2) AS same, count(*) FILTER (doc_id % 4 <> 3 AND doc_id % 7 <> 1 AND doc_id % 5 = 2) AS changed, count(*) FILTER (doc_id % 4 = 3 AND doc_id % 7 <> 1) AS added, count(*) FILTER (doc_id % 4 <> 3 AND doc_id % 7 = 1) AS removed FROM documents GROUP BY 1",
    "split_conflict": "SELECT source FROM documents GROUP BY 1 HAVING count(DISTINCT lang = 'es') > 1",
    "review_queue": "WITH o AS (SELECT user_id, event_id % 40 AS item, min(event_id) AS newest FROM events GROUP BY 1, 2) SELECT user_id, item, (row_number() OVER (PARTITION BY user_id ORDER BY newest DESC, item))::INT AS place FROM o QUALIFY place <= 10",
    "summary_update": "WITH s AS (SELECT conv_id, count(*) AS n FROM conversations GROUP BY 1) SELECT conv_id, CASE WHEN conv_id % 3 = 0 THEN n + 1 ELSE n END AS revision, CASE WHEN conv_id % 3 = 0 THEN 'new' ELSE 'old' END AS summary, CASE WHEN conv_id % 6 = 0 THEN 'new title' ELSE 'old title' END AS title FROM s",
    "page_digest": "SELECT conv_id, sha256(string_agg(sha256(text), chr(10) ORDER BY turn)) AS digest FROM conversations GROUP BY 1",
    "token_limits": r"WITH w AS (SELECT lang, len(regexp_extract_all(text, '\S+')) AS n FROM documents) SELECT lang, min(n) AS least, max(n) AS most, round(avg(n), 6) AS mean, sum(n)::BIGINT AS total, count(*) FILTER (n > 1024) AS over FROM w GROUP BY 1",
    "error_gain": "WITH r AS (SELECT event_type, avg((value > 50)::INT) FILTER (user_id % 2 <> 0) AS b, avg((value > 50)::INT) FILTER (user_id % 2 = 0) AS a FROM events GROUP BY 1) SELECT event_type, round(b, 6) AS rate_before, round(a, 6) AS rate_after, round(a - b, 6) AS gain FROM r",
    "passage_pack": """WITH RECURSIVE t AS (SELECT conv_id, strlen(text) AS size, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i FROM conversations),
g AS (SELECT DISTINCT conv_id, -1::BIGINT AS i, 0::BIGINT AS used, ''::VARCHAR AS taken FROM t UNION ALL
SELECT g.conv_id, t.i, CASE WHEN used + size <= 900 THEN used + size ELSE used END, CASE WHEN used + size <= 900 THEN taken || CASE WHEN taken = '' THEN '' ELSE ',' END || t.i ELSE taken END FROM g JOIN t ON g.conv_id = t.conv_id AND t.i = g.i + 1)
SELECT conv_id, taken FROM g QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY i DESC) = 1""",
}
QUERIES = {f.__name__: f for f in (verdict_parse, judge_consensus, page_inspection, evidence_catalog, passage_pack, live_admission, page_chunk_diff, split_conflict, review_queue, summary_update, page_digest, flash_cards, token_limits, error_gain)}
