"""Table readers, and small literal tables that Spark and the oracle read from one text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def literal(spark: SparkSession, values: str) -> DataFrame:
    """``values``: ``(VALUES ...) AS t(columns)``, read alike by both engines (no backslashes)."""
    return spark.sql(f"SELECT * FROM {values}")
