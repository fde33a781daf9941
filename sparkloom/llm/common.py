"""What several corpus operators share: words, hashes, local bindings, the shared folder."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkloom.session import shared_folder

#: The white space that separates words.
WHITE_SPACE = " \t\n\x0b\x0c\r"
WORD_PATTERN = r"[^\x20\x09-\x0D]+"


def bind(value: Column, body) -> Column:
    """body(value) with value worked out once for each row, however often body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words_of(text: Column) -> Column:
    """Array of the runs of characters other than white space; null text has none."""
    spaced = F.translate(F.coalesce(text, F.lit("")), WHITE_SPACE, " " * len(WHITE_SPACE))
    return F.array_remove(F.split(spaced, " "), "")


def without_space(text: Column) -> Column:
    return F.translate(text, WHITE_SPACE, "")


def lower_ascii(text: Column) -> Column:
    """Only A-Z change, so that every engine agrees on the result."""
    upper = "".join(map(chr, range(65, 91)))
    return F.translate(text, upper, upper.lower())


def whole_id(docs: DataFrame, name: str) -> Column:
    """The id column as whole numbers; ids of any other type are refused, as casts would lose them."""
    if not isinstance(docs.schema[name].dataType, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        raise TypeError(f"{name} must hold whole numbers, not {docs.schema[name].dataType.simpleString()}: number the rows, or hash their ids, first")
    return F.col(name).cast("long")


def stored(df: DataFrame, *, partitions: int | None = None) -> DataFrame:
    """The rows written to the shared folder and read again: computed once, lineage cut, safe from lost executors."""
    spark = df.sparkSession
    at = shared_folder(spark)
    (df.coalesce(partitions) if partitions else df).write.parquet(at)
    return spark.read.schema(df.schema).parquet(at)


#: Bytes of rows that a Python worker gets at once; Spark's own default is eight times as much.
BATCH_BYTES = 8 << 20


def small_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches of this session's Python functions, unless it has a bound of its own."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name) == "67108864b":
        spark.conf.set(name, str(BATCH_BYTES))


def shard_count(df: DataFrame, bytes_each: int, least: int) -> int:
    """Shards so that each stands for about bytes_each of input, by the planner's estimate; a partition each where it has none."""
    small_batches(df.sparkSession)
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if size > 1 << 60:
        return max(least, df.rdd.getNumPartitions())
    return max(least, size // bytes_each)


#: Most keys that are sent to every executor, 8 bytes each before hashing; beyond it both sides are shuffled.
BROADCAST_KEYS = 1_000_000


def if_small(keys: DataFrame, most: int = BROADCAST_KEYS) -> DataFrame:
    """keys, stored, with a broadcast hint if a count shows that there are few enough."""
    keys = stored(keys)
    return F.broadcast(keys) if keys.count() <= most else keys
