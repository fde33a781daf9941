"""Operators over nested documents: lookup into arrays, filters inside arrays, buckets of equal size, change feeds."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.operators import ordering


def lookup(df: DataFrame, other: DataFrame, local: str, foreign: str, name: str) -> DataFrame:
    """Each row with the array of other rows whose `foreign` equals its `local`, sorted; null equals null, and without any
    match the array is empty. An array is a row's value, so that the matches of one key have to fit into a row: join instead
    where they may not."""
    arrays = other.groupBy(F.col(foreign).alias("_f")).agg(F.array_sort(F.collect_list(F.struct(*other.columns))).alias("_a"))
    found = df.join(arrays, F.col(local).eqNullSafe(F.col("_f")), "left")
    return found.select(*df.columns, F.coalesce("_a", F.array().cast(arrays.schema["_a"].dataType)).alias(name))


def kept_elements(df: DataFrame, array: str, condition: Callable[[Column], Column], name: str) -> DataFrame:
    """df with the elements of an array for which the condition is true, in their order; null stays null."""
    return df.withColumn(name, F.filter(array, condition))


def with_element(df: DataFrame, array: str, condition: Callable[[Column], Column]) -> DataFrame:
    """Rows of which some element of the array meets the whole condition."""
    return df.where(F.coalesce(F.exists(array, condition), F.lit(False)))


def equal_buckets(df: DataFrame, value: str, n: int) -> DataFrame:
    """(bucket, lo, hi, n) of at most n buckets with about as many rows each; equal values share a bucket, nulls are left out.

    Values are counted first, and the counts are summed up in ranges, so that nothing is sorted in one task.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(F.col(value).alias("_v")).agg(F.count(F.lit(1)).alias("_c"))
    upto = ordering.running_sum(counts, [F.col("_v")], "_c", "_upto")
    total = upto.agg(F.sum("_c").alias("_total"))
    bucket = F.floor((F.col("_upto") - F.col("_c")) * n / F.col("_total")).cast("long")
    placed = upto.join(F.broadcast(total)).withColumn("bucket", bucket)  # one row
    return placed.groupBy("bucket").agg(F.min("_v").alias("lo"), F.max("_v").alias("hi"), F.sum("_c").alias("n"))


def change_feed(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """(key, change, fields): rows inserted, deleted and updated between two states with one row a key, and which columns an
    update changed, in their order. One join; nulls equal nulls."""
    names = [c for c in old.columns if c != key]
    a, b = (df.select(F.col(key).alias(f"_k{side}"), F.struct(*names).alias(f"_{side}")) for df, side in ((old, "a"), (new, "b")))
    both = a.join(b, F.col("_ka") == F.col("_kb"), "full")
    fields = F.array_compact(F.array(*[F.when(~F.col("_a")[c].eqNullSafe(F.col("_b")[c]), F.lit(c)) for c in names]))
    change = F.when(F.col("_ka").isNull(), "insert").when(F.col("_kb").isNull(), "delete").otherwise("update")
    found = both.select(F.coalesce("_ka", "_kb").alias(key), change.alias("change"), F.when(change == "update", fields).alias("fields"))
    return found.where((F.col("change") != "update") | (F.size("fields") > 0))
