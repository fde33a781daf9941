"""Window frames and row choices that Spark SQL does not parse: GROUPS, EXCLUDE, DISTINCT ON, WITH TIES."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def groups_frame(df: DataFrame, partition: list[str], order: list[Column], before: int, after: int, aggregates: dict[str, Column]) -> DataFrame:
    """Aggregates over GROUPS BETWEEN before PRECEDING AND after FOLLOWING: peer groups are numbered, then a range over the numbers."""
    numbered = df.withColumn("_g", F.dense_rank().over(Window.partitionBy(*partition).orderBy(*order)))
    frame = Window.partitionBy(*partition).orderBy("_g").rangeBetween(-before, after)
    return numbered.select("*", *[a.over(frame).alias(n) for n, a in aggregates.items()]).drop("_g")


def excluding(df: DataFrame, partition: list[str], order: list[Column], rows: tuple[int, int], value: str, exclude: str = "current row") -> DataFrame:
    """df with _sum, _count, _min and _max of value over a ROWS frame without the current row, its peer group, or its ties.

    The frame is gathered with each row's peer number, so its size bounds the work; an empty frame gives nulls
    and a count of 0.
    """
    numbered = df.withColumn("_g", F.dense_rank().over(Window.partitionBy(*partition).orderBy(*order)))
    ordered = Window.partitionBy(*partition).orderBy(*order)
    numbered = numbered.withColumn("_n", F.row_number().over(ordered))
    frame = F.collect_list(F.struct(F.col("_g").alias("g"), F.col("_n").alias("n"), F.col(value).alias("v"))).over(ordered.rowsBetween(*rows))
    keep = {
        "no others": lambda x: F.lit(True),
        "current row": lambda x: x["n"] != F.col("_n"),
        "group": lambda x: x["g"] != F.col("_g"),
        "ties": lambda x: (x["g"] != F.col("_g")) | (x["n"] == F.col("_n")),
    }[exclude]
    kept = numbered.withColumn("_f", frame).withColumn("_f", F.transform(F.filter("_f", keep), lambda x: x["v"]))
    kept = kept.withColumn("_f", F.filter("_f", lambda v: v.isNotNull()))
    total = F.when(F.size("_f") > 0, F.aggregate("_f", F.lit(0).cast("double"), lambda s, v: s + v))
    return kept.select(*df.columns, total.alias("_sum"), F.size("_f").cast("long").alias("_count"), F.array_min("_f").alias("_min"), F.array_max("_f").alias("_max"))


def distinct_on(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key by order, as DISTINCT ON does; order should end with a unique column."""
    first = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rn", first).where("_rn = 1").drop("_rn")


def top_per_group(df: DataFrame, keys: list[str], order: list[Column], n: int, ties: bool = False) -> DataFrame:
    """The first n rows of each key (QUALIFY); with ties also those that equal the n-th. Spark limits groups before the shuffle."""
    rank = (F.rank() if ties else F.row_number()).over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rn", rank).where(F.col("_rn") <= n).drop("_rn")


def limit_with_ties(df: DataFrame, order: list[tuple[str, bool]], n: int) -> DataFrame:
    """FETCH FIRST n ROWS WITH TIES; order holds (column, ascending), nulls last. The n-th row's key is found by a
    distributed top-n and compared with all rows, so that no single task sorts the table."""
    by = [F.col(c).asc_nulls_last() if up else F.col(c).desc_nulls_last() for c, up in order]
    last = df.orderBy(*by).limit(n).select(*[F.col(c).alias(f"_e{i}") for i, (c, _) in enumerate(order)])
    flip = [F.col(f"_e{i}").desc_nulls_first() if up else F.col(f"_e{i}").asc_nulls_first() for i, (_, up) in enumerate(order)]
    edge = last.orderBy(*flip).limit(1)
    up_to = F.lit(True)
    for i, (c, up) in reversed(list(enumerate(order))):
        a, b = F.col(c), F.col(f"_e{i}")
        before = F.when(b.isNull(), a.isNotNull()).when(a.isNull(), False).otherwise(a < b if up else a > b)
        up_to = before | (a.eqNullSafe(b) & up_to)
    return df.join(F.broadcast(edge), up_to).select(*df.columns)


def compare_all(df: DataFrame, value: str, op: str, others: DataFrame, other: str) -> DataFrame:
    """Rows where `value op ALL (others)` is true: over no rows it is true, with a null among them never.

    others is reduced to one row of bounds, which is all that is broadcast.
    """
    bounds = others.agg(F.min(other).alias("_lo"), F.max(other).alias("_hi"), F.count(F.lit(1)).alias("_n"), F.count(other).alias("_k"))
    v, whole = F.col(value), F.col("_n") == F.col("_k")
    holds = {">": v > F.col("_hi"), ">=": v >= F.col("_hi"), "<": v < F.col("_lo"), "<=": v <= F.col("_lo"), "=": (v == F.col("_lo")) & (v == F.col("_hi"))}
    if op == "<>":
        clear = others.where(F.col(other).isNotNull()).select(F.col(other).alias("_o")).distinct()
        return df.join(F.broadcast(bounds), (F.col("_n") == 0) | (whole & v.isNotNull())).join(clear, v == F.col("_o"), "left_anti").select(*df.columns)
    return df.join(F.broadcast(bounds), (F.col("_n") == 0) | (whole & holds[op])).select(*df.columns)


def compare_any(df: DataFrame, value: str, op: str, others: DataFrame, other: str) -> DataFrame:
    """Rows where `value op ANY (others)` is true; over no rows it is false."""
    v = F.col(value)
    if op == "=":
        return df.join(others.select(F.col(other).alias("_o")), v == F.col("_o"), "left_semi")
    bounds = others.agg(F.min(other).alias("_lo"), F.max(other).alias("_hi"))
    lo, hi = F.col("_lo"), F.col("_hi")
    holds = {">": v > lo, ">=": v >= lo, "<": v < hi, "<=": v <= hi, "<>": (v != lo) | (v != hi)}[op]
    return df.join(F.broadcast(bounds), holds).select(*df.columns)
