"""Parquet tables of one data folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The parquet table ``name`` of the folder; a local path or any Hadoop file-system URI."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
