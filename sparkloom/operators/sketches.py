"""A count-min sketch as a small table: estimates of how often a value occurs, never too low."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A digest of 128 bits gives four independent cells of 32 bits.
DEPTH = 4


def _cells(value: Column, width: int) -> Column:
    digest = F.md5(value.cast("string").cast("binary"))
    return F.transform(F.sequence(F.lit(0), F.lit(DEPTH - 1)), lambda i: F.struct(i.alias("line"), (F.conv(F.substr(digest, i * 8 + 1, F.lit(8)), 16, 10).cast("long") % width).alias("cell")))


def count_min(df: DataFrame, column: str, width: int = 2048) -> DataFrame:
    """(line, cell, n): DEPTH * width rows at most, summed map-side; sketches of parts of a table add up. Null is no value.

    An estimate is over by more than e / width of all rows with a probability of e ** -DEPTH at most.
    """
    once = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    return once.select(F.explode(_cells(F.col(column), width)).alias("_x"), "n").groupBy("_x.line", "_x.cell").agg(F.sum("n").alias("n"))


def estimates(sketch: DataFrame, values: DataFrame, column: str, width: int = 2048) -> DataFrame:
    """values with the estimate of each: the least of its cells, 0 where one is empty. The sketch has a bound, so it is broadcast."""
    rows = values.select(column).distinct().select(column, F.explode(_cells(F.col(column), width)).alias("_x")).select(column, "_x.line", "_x.cell")
    return rows.join(F.broadcast(sketch), ["line", "cell"], "left").groupBy(column).agg(F.min(F.coalesce("n", F.lit(0))).alias("estimate"))
