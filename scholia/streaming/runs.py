"""Streams: idempotent appends, telemetry, sessions with a time limit. Each reads a parquet table as a stream until it is caught up."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _folder(spark: SparkSession) -> str:
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
    return f"{named.rstrip('/') if named else tempfile.mkdtemp(prefix='spark-stream-')}/stream-{uuid.uuid4().hex}"


def caught_up(spark: SparkSession, path: str, build: Callable[[DataFrame], DataFrame], mode: str = "append", files: int = 1000) -> DataFrame:
    """The rows that ``build`` of the stream of ``path`` has put out once all present files are read, ``files`` a batch.

    In complete mode each batch puts out everything anew, so the last one holds.
    """
    schema = spark.read.parquet(path).schema
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(f"{path[:-1]}[{path[-1]}]")  # a pattern may name one file
    return drained(spark, build(source), mode)


def stateful(spark: SparkSession) -> SparkSession:
    """A session like this one, whose streams keep state in RocksDB, which timers, maps and values of keyed state need."""
    session = spark.newSession()
    for k, v in spark.conf.getAll.items():
        if k.startswith("spark.sql.") and spark.conf.isModifiable(k):
            session.conf.set(k, v)
    session.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    session.conf.set("spark.sql.streaming.stateStore.unloadOnCommit", "true")
    return session


def drained(spark: SparkSession, out: DataFrame, mode: str = "append") -> DataFrame:
    """The rows that a stream has put out once all that is there has been read."""
    folder = _folder(spark)
    numbers: list[int] = []

    def put(batch: DataFrame, number: int) -> None:
        numbers.append(number)
        batch.withColumn("_batch", F.lit(number)).write.mode("overwrite").parquet(f"{folder}/out/part={number}")

    out.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).foreachBatch(put).start().awaitTermination()
    if not numbers:
        return spark.createDataFrame([], out.schema)
    return spark.read.schema(out.schema).parquet(f"{folder}/out/part={max(numbers)}" if mode == "complete" else f"{folder}/out/*")


def deduplicated(spark: SparkSession, path: str, keys: list[str], at: str, delay: str = "365 days") -> DataFrame:
    """One row of each key, the first to arrive; keys older than the watermark are forgotten."""
    return caught_up(spark, path, lambda s: s.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, delay).dropDuplicatesWithinWatermark(keys).select(*keys))


def tumbling(spark: SparkSession, path: str, at: str, width: str, group: str) -> DataFrame:
    """Counts of windows and groups; all windows, as they are complete once the stream is."""
    return caught_up(spark, path, lambda s: s.groupBy(F.window(at, width), group).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), group, "n"), "complete")


def sessions(spark: SparkSession, path: str, at: str, gap: str, group: str) -> DataFrame:
    """Sessions that end after ``gap`` without a row of the group."""
    return caught_up(spark, path, lambda s: s.groupBy(F.session_window(at, gap), group).agg(F.count(F.lit(1)).alias("n")).select(F.col("session_window.start").alias("start"), group, "n"), "complete")
