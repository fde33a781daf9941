"""Time series: buckets, gap filling, carried and interpolated values, sessions, continuous aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.operators import ordering


def time_bucket(ts: Column, width: str) -> Column:
    """Start of the bucket of `width` (such as '1 hour') that a timestamp lies in, without a time zone."""
    return F.window(ts.cast("timestamp"), width)["start"].cast("timestamp_ntz")


def bucket_seconds(ts: Column, seconds: int) -> Column:
    """Start of the bucket in whole seconds since the epoch."""
    return (F.floor(F.unix_timestamp(ts.cast("timestamp")) / seconds) * seconds).cast("long")


def gap_fill(df: DataFrame, keys: list[str], bucket: str, step: int, values: list[str], carry: bool = False, interpolate: bool = False, ranged: bool = False) -> DataFrame:
    """One row for each key and each step from its first to its last bucket (whole numbers); missing values are null,
    the last one before (carry), or on the line between the neighbours (interpolate).

    The buckets of each key come from its own range, so that the number of rows made is that of the result. Values are
    carried in one task a key, or with ranged in ranges of keys and buckets, for keys with a large part of all rows.
    """
    spans = df.groupBy(*keys).agg(F.min(bucket).alias("_lo"), F.max(bucket).alias("_hi"))
    grid = spans.select(*keys, F.explode(F.sequence("_lo", "_hi", F.lit(step).cast("long"))).alias(bucket))
    filled = grid.join(df, [*keys, bucket], "left")
    if ranged and (carry or interpolate):
        return _filled_in_ranges(filled, keys, bucket, values, interpolate and not carry)
    back = Window.partitionBy(*keys).orderBy(bucket).rowsBetween(Window.unboundedPreceding, 0)
    ahead = Window.partitionBy(*keys).orderBy(bucket).rowsBetween(0, Window.unboundedFollowing)
    for v in values:
        if carry:
            filled = filled.withColumn(v, F.last(v, ignorenulls=True).over(back))
        elif interpolate:
            at = F.when(F.col(v).isNotNull(), F.struct(F.col(bucket).alias("t"), F.col(v).alias("v")))
            a, b = F.last(at, ignorenulls=True).over(back), F.first(at, ignorenulls=True).over(ahead)
            filled = filled.withColumns({"_a": a, "_b": b})
            filled = filled.withColumn(v, F.coalesce(v, _line(bucket))).drop("_a", "_b")
    return filled


def _line(bucket: str) -> Column:
    """The value at a bucket on the line from _a to _b, both (t, v)."""
    return F.col("_a.v") + (F.col("_b.v") - F.col("_a.v")) * (F.col(bucket) - F.col("_a.t")) / (F.col("_b.t") - F.col("_a.t"))


def _filled_in_ranges(filled: DataFrame, keys: list[str], bucket: str, values: list[str], interpolate: bool) -> DataFrame:
    names = filled.columns
    for v in values:
        if not interpolate:
            filled = ordering.carried_by(filled, keys, [bucket], v, v)
            continue
        at = F.when(F.col(v).isNotNull(), F.struct(F.col(bucket).alias("t"), F.col(v).alias("v")))
        before = ordering.carried_by(filled.withColumns({"_at": at, "_back": -F.col(bucket)}), keys, [bucket], "_at", "_a")
        both = ordering.carried_by(before, keys, ["_back"], "_at", "_b")
        filled = both.withColumn(v, F.coalesce(v, _line(bucket))).select(*names)
    return filled.select(*names)


def last_point(df: DataFrame, keys: list[str], ts: str, tie: str, values: list[str]) -> DataFrame:
    """The values of each key's latest row; a map-side maximum, not a sort."""
    return df.groupBy(*keys).agg(*[F.max_by(v, F.struct(ts, tie)).alias(v) for v in values])


def sessions(df: DataFrame, keys: list[str], ts: str, tie: str, gap: str, ranged: bool = False) -> DataFrame:
    """df with _session, a number that grows whenever more than `gap` passed since the key's previous row. A key is in one
    task, or with ranged in ranges of keys and times, for keys with a large part of all rows."""
    order = Window.partitionBy(*keys).orderBy(ts, tie)
    rows = ordering.previous_by(df, keys, [ts, tie], ts, "_before") if ranged else df.withColumn("_before", F.lag(ts).over(order))
    new = F.when(F.col("_before").isNull() | (F.col(ts) > F.col("_before") + F.expr(f"INTERVAL {gap}")), 1).otherwise(0)
    flagged = rows.withColumn("_new", new)
    if ranged:
        found = ordering.running_sum_by(flagged, keys, [ts, tie], "_new", "_session")
    else:
        found = flagged.withColumn("_session", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return found.select(*df.columns, F.col("_session").cast("long").alias("_session"))


def continuous_aggregate(stored: DataFrame, fresh: DataFrame, ts: str, bucket: str, upto: Column, aggregate) -> DataFrame:
    """Stored buckets before `upto` and, after it, aggregate(fresh rows); the filter on ts reaches the scan of fresh."""
    return stored.where(F.col(bucket) < upto).unionByName(aggregate(fresh.where(F.col(ts) >= upto)))
