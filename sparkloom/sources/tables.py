"""Readers for the star schema and corpus tables a data folder holds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table; Spark prunes its columns and pushes its filters into the Parquet scan."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def register(spark: SparkSession, sf_dir: str, *names: str) -> None:
    """Make tables known to spark.sql() under their own names."""
    for name in names or TABLES:
        table(spark, sf_dir, name).createOrReplaceTempView(name)
