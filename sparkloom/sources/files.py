"""COPY, CREATE TABLE AS and materialised views as files, and catalogue and metadata readers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.session import shared_folder

#: Options under which text formats give back what was written, nulls and times included.
TEXT_OPTIONS = {"header": "true", "nullValue": "\\N", "emptyValue": "", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}


def shared_path(spark: SparkSession) -> str:
    """A fresh path in the folder that driver and executors share."""
    return shared_folder(spark)


def copy_to(df: DataFrame, path: str, kind: str = "parquet", partition_by: tuple[str, ...] = (), **options: str) -> None:
    """COPY … TO: parquet, orc, json or csv; files are replaced as a whole."""
    writer = df.write.mode("overwrite").format(kind).options(**({**TEXT_OPTIONS, **options} if kind == "csv" else options))
    (writer.partitionBy(*partition_by) if partition_by else writer).save(path)


def copy_from(spark: SparkSession, path: str, like: DataFrame, kind: str = "parquet", **options: str) -> DataFrame:
    """COPY … FROM with the columns of `like`; nothing is inferred, so nothing is read twice."""
    return spark.read.schema(like.schema).format(kind).options(**({**TEXT_OPTIONS, **options} if kind == "csv" else options)).load(path)


def create_table_as(df: DataFrame, path: str, bucket: str | None = None) -> DataFrame:
    """CREATE TABLE AS without a catalogue: Parquet files, sorted by `bucket` inside each file if it is given, so that its
    minima and maxima prune row groups."""
    (df.sortWithinPartitions(bucket) if bucket else df).write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class MaterializedView:
    """The stored result of a function of base tables; refresh() makes it anew and swaps the path."""

    def __init__(self, spark: SparkSession, make):
        self.spark, self.make, self.path = spark, make, ""
        self.refresh()

    def refresh(self) -> None:
        path = shared_path(self.spark)
        self.make().write.parquet(path)
        self.path = path

    def read(self) -> DataFrame:
        return self.spark.read.parquet(self.path)


def file_listing(df: DataFrame) -> DataFrame:
    """(file, rows) of each file that a scan reads, by the hidden metadata column."""
    return df.groupBy(F.col("_metadata.file_path").alias("file")).agg(F.count(F.lit(1)).alias("rows"))


def columns_of(df: DataFrame) -> DataFrame:
    """(position, name, type, nullable) of a table, as information_schema.columns has them."""
    rows = [(i + 1, f.name, f.dataType.simpleString(), f.nullable) for i, f in enumerate(df.schema.fields)]
    return df.sparkSession.createDataFrame(rows, "position int, name string, type string, nullable boolean")


def statistics_of(df: DataFrame, columns: list[str]) -> DataFrame:
    """ANALYZE: rows, nulls, distinct values, minimum and maximum of columns, in one scan."""
    parts = []
    for c in columns:
        parts += [F.count_if(F.col(c).isNull()).alias(f"{c}__nulls"), F.approx_count_distinct(c).alias(f"{c}__distinct"), F.min(c).cast("string").alias(f"{c}__min"), F.max(c).cast("string").alias(f"{c}__max")]
    wide = df.agg(F.count(F.lit(1)).alias("rows"), *parts)
    each = [F.struct(F.lit(c).alias("name"), F.col(f"{c}__nulls").alias("nulls"), F.col(f"{c}__distinct").alias("distinct"), F.col(f"{c}__min").alias("min"), F.col(f"{c}__max").alias("max")) for c in columns]
    return wide.select("rows", F.inline(F.array(*each)))


def masked(df: DataFrame, allow, masks: dict) -> DataFrame:
    """A secured view: rows for which `allow` holds, columns replaced by their masks."""
    return df.where(allow).select(*[masks[c].alias(c) if c in masks else F.col(c) for c in df.columns])
