"""Audits: completeness of a corpus against its index, latest states, status reports, ledgers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def latest(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The newest row of each key, by the columns of ``order``."""
    w = Window.partitionBy(*key).orderBy(*[F.desc(c) for c in order])
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def failures(expected: DataFrame, indexed: DataFrame, vectors: DataFrame, key: str, digest: str, size: int) -> DataFrame:
    """kind, key of everything that keeps an index from being complete: one row a fault, as a union of narrow checks."""
    e, i = expected.select(key, F.col(digest).alias("_e")), indexed.select(key, F.col(digest).alias("_i"))
    both = e.join(i, key, "full_outer")
    kind = F.when(F.col("_i").isNull(), "missing").when(F.col("_e").isNull(), "obsolete").when(F.col("_e") != F.col("_i"), "source_changed")
    faults = both.select(kind.alias("kind"), key).where("kind is not null")
    shape = i.select(key).join(vectors.select(key, F.size("embedding").alias("n")), key, "left")
    wrong = F.when(F.col("n").isNull(), "vector_missing").when(F.col("n") != size, "wrong_dimension")
    return faults.unionByName(shape.select(wrong.alias("kind"), key).where("kind is not null"))


def changed(found: DataFrame, stored: DataFrame, key: str, digest: str, version: str) -> DataFrame:
    """Files to index: those whose (key, hash, pipeline version) is not stored yet."""
    return found.join(stored.select(key, digest, version), [key, digest, version], "left_anti")


def replace_pages(chunks: DataFrame, new: DataFrame, page: list[str]) -> DataFrame:
    """Chunks with the pages of ``new`` replaced."""
    return chunks.join(new.select(*page).distinct(), page, "left_anti").unionByName(new)


def last_accepted(revisions: DataFrame, key: str, revision: str, state: str) -> DataFrame:
    """The newest accepted revision of each key."""
    return revisions.where(F.col(state) == "accepted").groupBy(key).agg(F.max(revision).alias(revision))


def telemetry(steps: DataFrame, run: str, step: str, at: str, loss: str) -> DataFrame:
    """Each step's last loss and the run's lowest loss so far."""
    newest = steps.groupBy(run, step).agg(F.max(F.struct(at, loss)).alias("x")).select(run, step, F.col(f"x.{loss}").alias(loss))
    return newest.withColumn("best", F.min(loss).over(Window.partitionBy(run).orderBy(step)))
