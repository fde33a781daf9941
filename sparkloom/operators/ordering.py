"""Ranks, tiles, neighbours and running sums over a whole table, without a key and without sorting it in one task; and
earlier values, carried values and running sums by a key that may hold any part of the rows.

Rows are put into ranges of the order (a range partitioning, sampled by Spark) and stored with their range's number, so
that every later pass sees the same ranges. Windows work inside a range; one row a range, at most
spark.sql.shuffle.partitions of them, carries what a range needs from those before or after it.
The order has to end with a unique column, as for any repeatable ROW_NUMBER.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.session import kept


def _ranged(df: DataFrame, order: list[Column]) -> tuple[DataFrame, object]:
    rows = kept(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    return rows, Window.partitionBy("_part").orderBy(*order)


def _before(value: str) -> Column:
    return F.coalesce(F.sum(value).over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))


def numbered(df: DataFrame, order: list[Column], name: str = "row_number", total: str | None = None) -> DataFrame:
    """df with ROW_NUMBER() OVER (ORDER BY order), and with the number of rows where total names a column for it."""
    rows, inside = _ranged(df, order)
    sizes = rows.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    ahead = sizes.select("_part", _before("_n").alias("_ahead"), F.sum("_n").over(Window.partitionBy()).alias("_total"))
    out = rows.join(F.broadcast(ahead), "_part").withColumn(name, (F.row_number().over(inside) + F.col("_ahead")).cast("long"))
    return out.select(*df.columns, name, *([F.col("_total").alias(total)] if total else []))


def tiles(df: DataFrame, order: list[Column], n: int, name: str = "ntile") -> DataFrame:
    """df with NTILE(n) OVER (ORDER BY order): the first tiles are larger by one row where n does not divide the rows."""
    found = numbered(df, order, "_rn", "_rows")
    size, larger = F.floor(F.col("_rows") / n), F.col("_rows") % n
    edge = larger * (size + 1)
    first = F.ceil(F.col("_rn") / (size + 1))
    return found.withColumn(name, F.when(F.col("_rn") <= edge, first).otherwise(larger + F.ceil((F.col("_rn") - edge) / size)).cast("long")).select(*df.columns, name)


def following(df: DataFrame, order: list[Column], value: str, name: str = "lead") -> DataFrame:
    """df with LEAD(value) OVER (ORDER BY order): a range's last row takes the first of the next range."""
    rows, inside = _ranged(df, order)
    firsts = rows.withColumn("_rn", F.row_number().over(inside)).where("_rn = 1").select("_part", F.struct(value).alias("_f"))
    after = firsts.select("_part", F.lead("_f").over(Window.orderBy("_part")).alias("_f"))
    return rows.join(F.broadcast(after), "_part").withColumn(name, F.coalesce(F.lead(F.struct(value)).over(inside), F.col("_f"))[value]).select(*df.columns, name)


def running_sum(df: DataFrame, order: list[Column], value: str, name: str = "running") -> DataFrame:
    """df with SUM(value) OVER (ORDER BY order ROWS UNBOUNDED PRECEDING); nulls add nothing, and 0 stands before the first value."""
    rows, inside = _ranged(df, order)
    ahead = rows.groupBy("_part").agg(F.sum(value).alias("_v")).select("_part", _before("_v").alias("_ahead"))
    within = F.coalesce(F.sum(value).over(inside.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0))
    return rows.join(F.broadcast(ahead), "_part").withColumn(name, F.col("_ahead") + within).select(*df.columns, name)


def _by_key(df: DataFrame, keys: list[str], order: list[str], within: Callable, handed: str | None, across: Callable, joined: Callable, name: str) -> DataFrame:
    """A window over keys and order, in ranges of both, so that a hot key is in many of them.

    within(window) works inside a range. Only the last key of a range goes on in the next: its last row hands on `handed`
    (what within gave, if None), across(value, window) collects that over the ranges of a key, and joined(own, collected)
    is the result.
    """
    rows, _ = _ranged(df, [F.col(c) for c in (*keys, *order)])
    run = rows.withColumn("_own", within(Window.partitionBy("_part", *keys).orderBy(*order)))
    last = F.struct(F.struct(*keys).alias("k"), F.struct(handed or "_own").alias("v"))
    tails = run.groupBy("_part").agg(F.max_by(last, F.struct(*keys, *order)).alias("_t")).select("_part", "_t.k", F.col("_t.v")[handed or "_own"].alias("v"))
    upto = Window.partitionBy("k").orderBy("_part").rowsBetween(Window.unboundedPreceding, 0)
    heads = tails.select("_part", F.lag(F.struct("k", across(F.col("v"), upto).alias("v"))).over(Window.orderBy("_part")).alias("_h"))
    same = F.col("_h").isNotNull()
    for c in keys:  # a null key is a key
        same &= F.col(c).eqNullSafe(F.col("_h.k")[c])
    return run.join(F.broadcast(heads), "_part").withColumn(name, joined(F.col("_own"), F.when(same, F.col("_h.v")))).select(*[c for c in df.columns if c != name], name)


def previous_by(df: DataFrame, keys: list[str], order: list[str], value: str, name: str) -> DataFrame:
    """df with LAG(value) OVER (PARTITION BY keys ORDER BY order), both ascending; a null before stays a null."""
    wrapped = df.withColumn("_value", F.struct(value))
    found = _by_key(wrapped, keys, order, lambda w: F.lag("_value").over(w), "_value", lambda v, w: F.last(v).over(w), lambda own, before: F.coalesce(own, before), "_before")
    return found.withColumn(name, F.col("_before")[value]).select(*[c for c in df.columns if c != name], name)


def carried_by(df: DataFrame, keys: list[str], order: list[str], value: str, name: str) -> DataFrame:
    """df with LAST_VALUE(value IGNORE NULLS) OVER (PARTITION BY keys ORDER BY order), both ascending, the own row included."""
    upto = lambda w: w.rowsBetween(Window.unboundedPreceding, 0)
    return _by_key(df, keys, order, lambda w: F.last(value, True).over(upto(w)), None, lambda v, w: F.last(v, True).over(w), lambda own, before: F.coalesce(own, before), name)


def running_sum_by(df: DataFrame, keys: list[str], order: list[str], value: str, name: str) -> DataFrame:
    """df with SUM(value) OVER (PARTITION BY keys ORDER BY order ROWS UNBOUNDED PRECEDING), both ascending; nulls add nothing."""
    upto = lambda w: w.rowsBetween(Window.unboundedPreceding, 0)
    return _by_key(df, keys, order, lambda w: F.coalesce(F.sum(value).over(upto(w)), F.lit(0)), None, lambda v, w: F.sum(v).over(w), lambda own, before: own + F.coalesce(before, F.lit(0)), name)
