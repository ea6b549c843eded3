"""Queries on stores that change by commits, stages that resume, and readings that are compared."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scholia.functions.text import hash_mod
from scholia.operators import agreement as A
from scholia.operators import resume as R
from scholia.operators import writes as W
from scholia.sources.tables import table
from scholia.sources.versions import Rejected, Store
from scholia.streaming import logs as L
from scholia.streaming.practice import sessions
from scholia.streaming.runs import _folder, caught_up, drained, stateful


def reviewed_pages(spark: SparkSession, d: str) -> DataFrame:
    """An index of sources as files of 12 pages: page 3 of each is replaced after review, a batch with one bad review is refused whole, files ending in 7 are gone."""
    rows = table(spark, d, "documents").select(F.col("source").alias("filename"), (F.col("doc_id") % 12 + 1).cast("int").alias("page"), F.col("doc_id").alias("chunk_index"), "text").where("length(trim(text)) > 0")
    files = rows.groupBy("filename").agg(F.countDistinct("page").cast("int").alias("pages"))
    scanned = F.substring("filename", -1, 1).cast("int") % 2 == 1
    docs = files.select("filename", F.lit(12).alias("total_pages"), scanned.alias("is_scanned"), F.md5(F.col("filename").cast("binary")).alias("file_hash"), "pages", F.lit("indexed").alias("status"))
    store = Store(spark, _folder(spark))
    store.commit({"documents": docs, "chunks": rows})

    def rules(t: dict[str, DataFrame]) -> DataFrame:
        return W.faults(t["documents"], t["chunks"])

    def apply(reviews: DataFrame) -> None:
        bad = W.review_faults(store.read("documents"), reviews)
        now, chunks = W.replace_pages(store.read("documents"), store.read("chunks"), reviews)
        store.commit({"documents": now, "chunks": chunks}, check=lambda t: rules(t).unionByName(bad))

    review = store.read("documents").select("filename", F.lit(3).alias("page"), F.concat(F.lit("reviewed "), "filename").alias("text"), F.col("file_hash").alias("source_hash"), F.lit("complete").alias("completeness"), F.lit(0).alias("unresolved"))
    apply(review)
    try:
        apply(review.withColumn("page", F.lit(4)).withColumn("completeness", F.when(F.col("filename") == "src1", "part").otherwise("complete")))
        raise AssertionError("an incomplete review was applied")
    except Rejected:
        pass
    left = store.read("documents").where(~F.col("filename").endswith("7"))
    now, chunks = W.delete_obsolete(store.read("documents"), store.read("chunks"), left)
    store.commit({"documents": now, "chunks": chunks}, check=rules)
    held = store.read("chunks").groupBy("filename").agg(F.count(F.lit(1)).alias("chunks"), F.sum(F.length("text")).alias("chars"))
    return store.read("documents").join(held, "filename").select("filename", "pages", "status", "chunks", "chars")


def resumed_stages(spark: SparkSession, d: str) -> DataFrame:
    """Three stages over documents, broken in the second and then in the third, and resumed each time."""
    source = table(spark, d, "documents").select("doc_id", "source", "text")
    broken: list[str] = []

    def stage(name, body):
        def run(rows: DataFrame) -> DataFrame:
            if name in broken:
                raise InterruptedError(name)
            return body(rows)

        return name, run

    stages = [
        stage("long", lambda r: r.where(F.length("text") > 300)),
        stage("once", lambda r: r.groupBy("source", F.md5(F.col("text").cast("binary")).alias("digest")).agg(F.min("doc_id").alias("doc_id"))),
        stage("split", lambda r: r.withColumn("part", F.when(hash_mod(F.col("digest"), 100) < 15, "valid").otherwise("train"))),
    ]
    run = R.Resumable(spark, _folder(spark))
    for name in ("once", "split"):
        broken[:] = [name]
        try:
            run.run(source, stages, {"least": 300})
        except InterruptedError:
            continue
    broken.clear()
    rows, did = run.run(source, stages, {"least": 300})
    if did != ["split"]:
        raise AssertionError(f"stages done again: {did}")
    return rows.select("doc_id", "source", "part")


def ocr_agreement(spark: SparkSession, d: str) -> DataFrame:
    """Every document that begins as the one before it of its source does, compared with that one."""
    docs = table(spark, d, "documents").select("doc_id", "source", F.substring("text", 1, 24).alias("head"), "text")
    of = Window.partitionBy("source", "head").orderBy("doc_id")
    pairs = docs.withColumn("before", F.lag("text").over(of)).where("before is not null")
    found = A.agreement(pairs, "doc_id", "before", "text")
    return found.select("doc_id", "exact", F.round("agreement", 9).alias("agreement"), F.size("differences").alias("differences"), F.array_join(F.transform("differences", lambda x: F.concat_ws(":", x["operation"], x["left_begin"], x["right_begin"])), ",").alias("places"))


def stream_log_tail(spark: SparkSession, d: str) -> DataFrame:
    """Events written as 16 runs' training logs (a file for each range of a run, steps repeat, some values are none), read as a stream of whole lines: the first loss of each step."""
    events = table(spark, d, "events").select((F.col("user_id") % 16).alias("run"), "event_id", "value")
    step = (F.col("event_id") % 97).cast("string")
    loss = F.when(F.col("event_id") % 13 == 5, "1e999").otherwise(F.col("value").cast("decimal(18,2)").cast("string"))
    peak = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit(", Peak mem "), (F.col("event_id") % 1000).cast("string"), F.lit(" MB"))).otherwise("")
    line = F.concat(F.lit("Iter "), step, F.lit(": Train loss "), loss, peak)
    folder = _folder(spark)
    ranged = events.withColumn("line", line).repartitionByRange("run", "event_id").sortWithinPartitions("run", "event_id")
    ranged.select("run", "line").write.partitionBy("run").text(folder)
    run = F.regexp_extract("file", r"run=(\d+)", 1).cast("long")
    return drained(spark, L.first_losses(L.reports(L.tail(spark, folder)), run), "complete")


def stream_session_store(spark: SparkSession, d: str) -> DataFrame:
    """Events as requests to their user's store, every third one making a session: seven days to live, three a store."""

    def requests(s: DataFrame) -> DataFrame:
        return s.select(F.col("user_id").alias("store"), F.col("event_id").alias("id"), F.col("event_type").alias("session"), F.col("ts").cast("timestamp").alias("at"), (F.col("event_id") % 3 == 0).alias("creates"))

    out = caught_up(stateful(spark), f"{d}/events.parquet", lambda s: sessions(requests(s), 7 * 86400, 3))
    return out.select(F.col("store").cast("long").alias("user_id"), F.col("id").alias("event_id"), "outcome", "alive")


ORACLES = {
    "stream_log_tail": """WITH e AS (SELECT user_id % 16 AS run, event_id % 97 AS step, event_id, value::DECIMAL(18,2) AS loss, event_id % 3 = 0 AND event_id % 1000 > 0 AS peak FROM events WHERE event_id % 13 <> 5)
SELECT run, step, loss::DOUBLE AS loss, CASE WHEN peak THEN (event_id % 1000) / 1000.0::DOUBLE END AS peak_gb FROM e QUALIFY row_number() OVER (PARTITION BY run, step ORDER BY event_id) = 1""",
    "stream_session_store": """WITH RECURSIVE e AS (SELECT user_id, event_id, event_type AS s, event_id % 3 = 0 AS creates, epoch_ms(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
r AS (SELECT user_id, 0::BIGINT AS n, NULL::BIGINT AS event_id, '' AS outcome, []::STRUCT(s VARCHAR, made BIGINT)[] AS live FROM (SELECT DISTINCT user_id FROM events)
UNION ALL SELECT user_id, n, event_id, CASE WHEN creates THEN 'created' WHEN len(own) > 0 THEN 'used' ELSE 'unknown' END,
  CASE WHEN creates THEN list_append(others, {s: s, made: t})[-3:] WHEN len(own) > 0 THEN list_append(others, own[1]) ELSE others END
  FROM (SELECT e.user_id, e.n, e.event_id, e.s, e.creates, e.t, list_filter(r.live, lambda x: x.s <> e.s AND e.t - x.made <= 604800000) AS others, list_filter(r.live, lambda x: x.s = e.s AND e.t - x.made <= 604800000) AS own FROM r JOIN e ON e.user_id = r.user_id AND e.n = r.n + 1))
SELECT user_id, event_id, outcome, len(live)::INT AS alive FROM r WHERE n > 0""",
    "reviewed_pages": """WITH r AS (SELECT source AS filename, doc_id % 12 + 1 AS page, text FROM documents WHERE trim(text) <> ''), f AS (SELECT DISTINCT filename FROM r WHERE NOT filename LIKE '%7'),
a AS (SELECT filename, page, text FROM r JOIN f USING (filename) WHERE page <> 3 UNION ALL SELECT filename, 3, 'reviewed ' || filename FROM f)
SELECT filename, count(DISTINCT page)::INT AS pages, CASE WHEN count(DISTINCT page) >= 12 OR right(filename, 1)::INT % 2 = 0 THEN 'indexed' ELSE 'ocr_partial_reviewed' END AS status, count(*) AS chunks, sum(length(text))::BIGINT AS chars FROM a GROUP BY 1""",
    "resumed_stages": """WITH o AS (SELECT source, md5(text) AS digest, min(doc_id) AS doc_id FROM documents WHERE length(text) > 300 GROUP BY 1, 2)
SELECT doc_id, source, CASE WHEN list_reduce(list_transform(string_split(sha256(digest), ''), lambda c: strpos('0123456789abcdef', c) - 1), lambda a, x: (a * 16 + x) % 100) < 15 THEN 'valid' ELSE 'train' END AS part FROM o""",
}

QUERIES = {f.__name__: f for f in (reviewed_pages, resumed_stages, ocr_agreement, stream_log_tail, stream_session_store)}
