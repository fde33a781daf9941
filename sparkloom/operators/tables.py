"""Table functions: series, ordinality, parallel unnesting, JSON and XML tables, sampling, counting from metadata."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def series(lo: Column, hi: Column, step: Column) -> Column:
    """generate_series as an array: empty where the step leads away from the end, null where an input is null."""
    runs = F.when(step > 0, lo <= hi).when(step < 0, lo >= hi).otherwise(F.raise_error(F.lit("step must not be 0")).cast("boolean"))
    return F.when(lo.isNotNull() & hi.isNotNull() & step.isNotNull(), F.when(runs, F.sequence(lo, hi, F.when(runs, step).otherwise(F.lit(1)))).otherwise(F.slice(F.array(lo), 1, 0)))


def unnest(df: DataFrame, array: str, name: str, ordinality: str | None = None, outer: bool = False) -> DataFrame:
    """One row for each element. Null and empty arrays give no row, or one with null when outer; ordinality counts from 1."""
    if ordinality is None:
        return df.select("*", (F.explode_outer if outer else F.explode)(array).alias(name))
    found = df.select("*", (F.posexplode_outer if outer else F.posexplode)(array).alias("_p", name))
    return found.withColumn(ordinality, (F.col("_p") + 1).cast("long")).drop("_p")


def unnest_together(df: DataFrame, arrays: dict[str, str], ordinality: str | None = None) -> DataFrame:
    """Several arrays side by side (ROWS FROM), the shorter ones padded with null; ordinality counts from 1."""
    zipped = F.arrays_zip(*[F.col(a).alias(n) for n, a in arrays.items()])
    place = [(F.col("_p") + 1).cast("long").alias(ordinality)] if ordinality else []
    return df.select("*", F.posexplode(zipped).alias("_p", "_z")).select(*df.columns, *[F.col("_z")[n].alias(n) for n in arrays], *place)


def json_table(df: DataFrame, json: str, schema: str) -> DataFrame:
    """Columns of a JSON array of objects, a row each; text that is no such array gives no row."""
    return df.select("*", F.inline(F.from_json(F.col(json), f"array<struct<{schema}>>")))


def xml_values(df: DataFrame, xml: str, paths: dict[str, str]) -> DataFrame:
    """Lists of the values at XPaths of a well-formed document."""
    return df.select("*", *[F.xpath(F.col(xml), F.lit(p)).alias(n) for n, p in paths.items()])


def xml_table(df: DataFrame, xml: str, row: str, schema: str) -> DataFrame:
    """Columns of the elements `row` under the root of an XML document (XMLTABLE), a row each; a document without any gives none."""
    return df.select("*", F.from_xml(F.col(xml), f"`{row}` array<struct<{schema}>>").alias("_x")).select(*df.columns, F.inline(F.col("_x")[row]))


def sample(df: DataFrame, percent: float, seed: int) -> DataFrame:
    """TABLESAMPLE BERNOULLI (percent) REPEATABLE (seed)."""
    return df.sample(percent / 100, seed)


def sample_by_key(df: DataFrame, key: str, percent: float, seed: int) -> DataFrame:
    """All rows of about `percent` of the keys, chosen by a digest: the same on every run, layout and engine. Null keys are left out."""
    limit = min(round(percent / 100 * (1 << 32)), (1 << 32) - 1)
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")).cast("binary"))
    return df.where(F.col(key).isNotNull() if percent >= 100 else F.substr(digest, F.lit(1), F.lit(8)) < f"{limit:08x}")


def row_count(spark: SparkSession, path: str) -> DataFrame:
    """count(*) of Parquet files: no column is read, only row counts of the footers' row groups."""
    return spark.read.parquet(path).agg(F.count(F.lit(1)).alias("n"))
