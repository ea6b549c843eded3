"""What several operators share: reading, scratch space, bounded samples, words."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A word is a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"
#: Spark's setting by which a query's shuffle files go when it ends.
FILES_GO = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names in spark.checkpoint.dir; one of our own only where none is named and all runs in one process."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named
    if spark.sparkContext.getCheckpointDir() is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-checkpoint-"))
    return spark.sparkContext.getCheckpointDir()


def scratch(spark: SparkSession, label: str) -> str:
    """A new path below the checkpoint folder."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """The rows, written to the checkpoint folder: lineage ends there, and a lost executor costs no recomputation.

    The shuffle files that led to them go at once, not when the driver happens to collect its garbage.
    """
    spark = df.sparkSession
    folder = checkpoint_dir(spark)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)
    before = spark.conf.get(FILES_GO, None)
    spark.conf.set(FILES_GO, "true")
    try:
        return df.select("*").checkpoint()  # the setting holds for what is selected under it
    finally:
        spark.conf.unset(FILES_GO) if before is None else spark.conf.set(FILES_GO, before)


def held_out(doc_id: Column) -> Column:
    """True for rows that no model may learn from: crc32 of the id's text, mod 5, is 0. A null id counts as held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def lowest(rows: DataFrame, of: str, draw: str, each: int, tie: list[str]) -> DataFrame:
    """At most ``each`` rows for each value of ``of``: those of the lowest ``draw`` (a 64-bit hash), then of ``tie``.

    Counts by the leading 12 bits of the draw give the bits up to which a value's rows can be among them, so that the last window
    reads little more than ``each`` rows of a value, though the value may hold most of all rows. The values have to be few.
    """
    lead = F.shiftright(draw, 52)
    counts = rows.groupBy(of, lead.alias("_lead")).agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(of).orderBy("_lead")) - F.col("_n")
    last = counts.withColumn("_before", before).where(F.col("_before") < each).groupBy(F.col(of).alias("_of")).agg(F.max("_lead").alias("_last"))
    few = rows.join(F.broadcast(last), F.col(of) == F.col("_of")).where(lead <= F.col("_last")).drop("_of", "_last")
    rank = F.row_number().over(Window.partitionBy(of).orderBy(draw, *tie))
    return few.withColumn("_rank", rank).where(F.col("_rank") <= each).drop("_rank")


def sample_ids(df: DataFrame, of: str, each: int, key: str = "doc_id", seed: int = 7) -> DataFrame:
    """At most ``each`` rows (key, of) for each value of ``of``, the same at each run: those with the lowest seeded hash."""
    rows = df.select(key, of).where(F.col(of).isNotNull() & F.col(key).isNotNull()).withColumn("_draw", F.xxhash64(F.lit(seed), F.col(key)))
    return lowest(rows, of, "_draw", each, [key]).select(key, of)


def salted_join(rows: DataFrame, values: DataFrame, key: str, spread: Column, total: int, most: int, per: int = 1000, how: str = "inner") -> DataFrame:
    """``rows`` with the columns of the one row that ``values`` has for their ``key``; ``values.n`` says for how many rows, ``most`` at most.

    Keys of more than a thousandth of the ``total`` rows (so fewer than a thousand keys, which are broadcast) are salted: their rows
    are spread over parts of some ``per`` rows by ``spread``, and their values repeated for each part. Without any it is a plain join.
    """
    limit = max(per, total // 1000)
    if most <= limit:
        return rows.join(values.drop("n"), key, how)
    hot = values.where(F.col("n") > limit).select(key, F.ceil(F.col("n") / per).cast("int").alias("_parts"))
    part = F.coalesce(F.pmod(F.xxhash64(spread), F.col("_parts")).cast("int"), F.lit(0))
    salted = rows.join(F.broadcast(hot), key, "left").withColumn("_part", part).drop("_parts")
    repeated = values.drop("n").join(F.broadcast(hot), key, "left").withColumn("_part", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("_parts"), F.lit(1)) - 1))).drop("_parts")
    return salted.join(repeated, [key, "_part"], how).drop("_part")


def ship(spark: SparkSession, value: object):
    """A broadcast of a model or index, with its classes, for workers that lack this package. Its size must not grow with the data."""
    from pyspark import cloudpickle

    return spark.sparkContext.broadcast(cloudpickle.dumps(value))


def shipped(shared) -> object:
    from pyspark import cloudpickle

    return cloudpickle.loads(shared.value)


def hex16(value: Column) -> Column:
    """16 lowercase hexadecimal digits of a long, read as unsigned."""
    return F.lower(F.lpad(F.hex(value), 16, "0"))


def unit(seed: str, *parts: Column) -> Column:
    """A number in (0, 1) from the MD5 of the seed and the parts: 52 bits, the same in any engine that has MD5."""
    digits = F.substring(F.md5(F.concat_ws(":", F.lit(seed), *[F.coalesce(p.cast("string"), F.lit("null")) for p in parts]).cast("binary")), 1, 13)
    return (F.conv(digits, 16, 10).cast("double") + 0.5) / F.lit(float(16**13))

