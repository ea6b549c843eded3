"""Exact deduplication by a streaming query with keyed state.

The documents arrive as a file stream. The state is disk-backed (RocksDB), keyed by the digest of the normalised text, has no
expiry, and keeps for each digest the smallest row so far (its stable identifier and its content locator, the file it came
from) and the count. Counting and taking the minimum are partial aggregates, so a digest that holds a third of all rows
reaches its key's task as one row from each map task. With a ``state`` folder the stream resumes: a later run reads new files only.

A second pass joins every row with its digest's state and, for each hit, compares all bytes of its text with those of the row
that stays, which is found by identifier and locator. Hot digests are salted there: their state rows and the texts of the rows
that stay are repeated once for each ``per_salt`` copies. Should texts with one digest differ, those rows are grouped again by
digest and text.

Rows: a null text counts as empty; null ids sort last, so a null id stays only where no other row has the text; equal ids with
equal texts are copies of each other, one of which (any, they are the same) is kept; empty tables give no rows; other columns
are not read. Ids may be of any type that sorts. A file whose content changes under its old name is not read again by a resumed run.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scholia.llm.common import SPACE, cut, scratch


def normalised(text: Column) -> Column:
    """The text with each run of ASCII white space as one space; null as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, " ")


def sha256(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def _identity(doc_id: Column) -> Column:
    """Sorts like the id, nulls last."""
    return F.struct(doc_id.isNull().alias("missing"), doc_id.alias("id"))


def _one_path(path: str) -> str:
    """The path as a pattern, as which it may name one file as well as a folder; its own special characters are escaped."""
    path = path.rstrip("/")
    return re.sub(r"([{}\[\]*?\\])", r"\\\1", path[:-1]) + (f"[{path[-1]}]" if path[-1].isalnum() else "\\" + path[-1])


def digest_state(spark: SparkSession, path: str, digest=sha256, batch_bytes: int = 64 << 30, state: str | None = None) -> DataFrame:
    """digest, keep (missing, id), locator, copies: the state after all files of ``path``, read by a streaming query.

    Each micro-batch takes ``batch_bytes`` of files, and each digest that it touches is written with its state to a table in
    ``state`` (by default a new folder below the shared checkpoint folder); the newest state of a digest has its largest count, so
    repeated batches do no harm.
    """
    fields = {f.name: f for f in spark.read.parquet(path).schema}
    schema = T.StructType([fields[c] for c in ("doc_id", "text")])
    folder = state or scratch(spark, "dedup")
    # a session of its own, for its settings; stores are closed once a batch has committed: a store keeps some MB of local files open
    session = spark.newSession()
    for k, v in spark.conf.getAll.items():
        if k.startswith("spark.sql.") and spark.conf.isModifiable(k):
            session.conf.set(k, v)
    session.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    session.conf.set("spark.sql.streaming.stateStore.unloadOnCommit", "true")
    source = session.readStream.schema(schema).option("maxBytesPerTrigger", batch_bytes).parquet(_one_path(path))
    keyed = source.select(
        digest(normalised(F.col("text"))).alias("digest"),
        F.struct(_identity(F.col("doc_id")).alias("keep"), F.col("_metadata.file_path").alias("locator")).alias("row"),
    )
    counted = keyed.groupBy("digest").agg(F.min("row").alias("row"), F.count(F.lit(1)).alias("copies"))
    # so that there is a table where no file has a row
    written = T.StructType([T.StructField(f.name, f.dataType) for f in counted.schema])
    spark.createDataFrame([], written).write.mode("ignore").parquet(f"{folder}/state/batch=-1")

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/state/batch={number}")

    counted.writeStream.outputMode("update").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).foreachBatch(put).start().awaitTermination()
    batches = spark.read.schema(written).parquet(f"{folder}/state")
    newest = batches.groupBy("digest").agg(F.min("row").alias("row"), F.max("copies").alias("copies"))
    return newest.select("digest", "row.keep", "row.locator", "copies")


def exact_dedup(spark: SparkSession, path: str, digest=sha256, per_salt: int = 1000, batch_bytes: int = 64 << 30, state: str | None = None) -> DataFrame:
    """doc_id, keep_id, group_size, kept, digest for each row of the parquet table at ``path``."""
    found = cut(digest_state(spark, path, digest, batch_bytes, state))
    docs = spark.read.parquet(path).select("doc_id", normalised(F.col("text")).alias("body"), F.col("_metadata.file_path").alias("file"))
    # never null, and said to be so: else the joins' null filters would compute the digest once more
    docs = docs.withColumn("digest", F.coalesce(digest(F.col("body")), F.lit("")))
    total = found.agg(F.coalesce(F.sum("copies"), F.lit(0))).first()[0]
    # groups above a thousandth of all rows: fewer than a thousand, so their digests can be broadcast
    hot = found.where(F.col("copies") > F.lit(max(per_salt, total // 1000))).select("digest", F.ceil(F.col("copies") / per_salt).cast("int").alias("salts"))
    spread = F.coalesce(F.col("salts"), F.lit(1))
    salted = docs.join(F.broadcast(hot), "digest", "left").withColumn("salt", F.coalesce(F.pmod(F.xxhash64("doc_id"), spread).cast("int"), F.lit(0))).drop("salts")
    states = found.join(F.broadcast(hot), "digest", "left").select("digest", "keep", "locator", "copies", F.explode(F.sequence(F.lit(0), spread - 1)).alias("salt"))
    rows = salted.join(states, ["digest", "salt"])
    # put so that the planner sees no further join key, and with the same columns below: both uses of ``rows`` then read one exchange of the texts
    same_id = F.when(F.col("doc_id").isNull(), F.col("keep.missing")).otherwise(~F.col("keep.missing") & (F.least("doc_id", "keep.id") == F.greatest("doc_id", "keep.id")))
    there = F.least("file", "locator") == F.greatest("file", "locator")
    stays = rows.where((F.col("copies") > 1) & same_id & there).groupBy("digest", "salt").agg(F.first("body").alias("kept_body"))
    stays = stays.join(F.broadcast(hot), "digest", "left").groupBy("digest", "salts").agg(F.first("kept_body").alias("kept_body"))
    stays = stays.select("digest", F.explode(F.sequence(F.lit(0), spread - 1)).alias("salt"), "kept_body")
    checked = rows.join(stays, ["digest", "salt"], "left").select(
        "doc_id", "digest", F.col("keep.id").alias("keep_id"), F.col("copies").alias("group_size"), F.coalesce(F.col("body") == F.col("kept_body"), F.col("copies") == 1).alias("same"), "keep", "file", "locator"
    )
    checked = cut(checked)
    if not checked.where(~F.col("same")).isEmpty():
        checked = _apart(checked, docs.drop("file"))
    # one of the rows that have the id that stays: found by partial aggregates and joined by its number, however many there are
    checked = cut(checked.withColumn("itself", _identity(F.col("doc_id")) == F.col("keep")).withColumn("at", F.monotonically_increasing_id()))
    first = checked.where("itself").groupBy("digest", "keep").agg(F.min("at").alias("at")).select("at", F.lit(True).alias("first"))
    same = checked.where("itself").join(first, "at", "left").withColumn("kept", F.coalesce("first", F.lit(False)))
    rest = checked.where("not itself").withColumn("kept", F.lit(False))
    out = ["doc_id", "keep_id", "group_size", "kept", "digest"]
    return same.select(*out).unionByName(rest.select(*out))


def _apart(checked: DataFrame, docs: DataFrame) -> DataFrame:
    """Where texts with one digest differ: those digests' rows, grouped again by digest and whole text."""
    mixed = checked.where(~F.col("same")).select("digest").distinct()
    bodies = docs.join(mixed, "digest", "left_semi")
    groups = bodies.groupBy("digest", "body").agg(F.min(_identity(F.col("doc_id"))).alias("keep"), F.count(F.lit(1)).alias("group_size"))
    again = bodies.join(groups, ["digest", "body"]).select("doc_id", "digest", F.col("keep.id").alias("keep_id"), "group_size", F.lit(True).alias("same"), "keep", F.lit(None).cast("string").alias("file"), F.lit(None).cast("string").alias("locator"))
    return checked.join(mixed, "digest", "left_anti").unionByName(again)
