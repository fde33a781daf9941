"""Keeping results up to date from changes: signed rows (_sign 1 for an insert, -1 for a delete) through joins and groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def changes(inserts: DataFrame | None = None, deletes: DataFrame | None = None) -> DataFrame:
    """Signed rows from inserted and deleted ones; an update is the old row deleted and the new one inserted."""
    parts = [df.withColumn("_sign", F.lit(sign)) for df, sign in ((inserts, 1), (deletes, -1)) if df is not None]
    if not parts:
        raise ValueError("changes need inserts or deletes")
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def delta_join(left: DataFrame, left_changes: DataFrame, right: DataFrame, right_changes: DataFrame, on: list[str]) -> DataFrame:
    """The signed change of left JOIN right, both as they were before: (dL x R) + (L x dR) + (dL x dR).

    Only changed rows are joined with the tables, so the work follows the changes, not the result.
    """
    first = left_changes.join(right, on)
    second = left.join(right_changes, on)
    both = left_changes.withColumnRenamed("_sign", "_a").join(right_changes.withColumnRenamed("_sign", "_b"), on).withColumn("_sign", F.col("_a") * F.col("_b")).drop("_a", "_b")
    return first.unionByName(second).unionByName(both)


def apply_changes(view: DataFrame, signed: DataFrame) -> DataFrame:
    """The stored rows after signed changes, repeats counted. A delete of a row that is not there is an error."""
    counted = view.withColumn("_sign", F.lit(1)).unionByName(signed).groupBy(*view.columns).agg(F.sum("_sign").cast("int").alias("_n"))
    lacking = F.raise_error(F.lit("a deleted row is not in the view")).cast("int")
    return counted.withColumn("_n", F.when(F.col("_n") < 0, lacking).otherwise(F.col("_n"))).where("_n > 0").withColumn("_n", F.explode(F.array_repeat(F.lit(1), F.col("_n")))).drop("_n")


def delta_groups(stored: DataFrame, signed: DataFrame, keys: list[str], sums: dict[str, Column]) -> DataFrame:
    """(keys, n, sums) after signed changes, from the stored (keys, n, sums): counts and sums take changes, so that no old
    row is read again; groups without a row go."""
    fresh = signed.groupBy(*keys).agg(F.sum("_sign").alias("n"), *[F.sum(c * F.col("_sign")).alias(name) for name, c in sums.items()])
    both = stored.select(*keys, "n", *sums).unionByName(fresh).groupBy(*keys).agg(F.sum("n").alias("n"), *[F.sum(name).alias(name) for name in sums])
    return both.where("n > 0")
