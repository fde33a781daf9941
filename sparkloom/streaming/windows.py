"""Structured Streaming operators: event-time windows, late rows, deduplication, joins and keyed state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.session import shared_folder


def source(spark: SparkSession, sf_dir: str, name: str = "events", ts: str = "ts") -> DataFrame:
    """A table's Parquet file or folder as a stream of files, its time column with the session's zone."""
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet")
    batch = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    folder = sf_dir if any(p.rstrip("/").rsplit("/", 1)[-1] == f"{name}.parquet" for p in batch.inputFiles()) else f"{sf_dir}/{name}.parquet"
    if folder == sf_dir:
        stream = stream.option("pathGlobFilter", f"{name}.parquet")
    return stream.parquet(folder).withColumn(ts, F.col(ts).cast("timestamp"))


def in_batches(parts: list[DataFrame]) -> DataFrame:
    """A stream that gives each of the parts as one micro-batch, in their order; they are written to the shared folder."""
    spark = parts[0].sparkSession
    at = f"{shared_folder(spark)}-parts"
    for k, part in enumerate(parts):
        part.write.parquet(f"{at}/part={k}")
    files = max(len(spark.read.parquet(f"{at}/part={k}").inputFiles()) for k in range(len(parts)))
    if any(len(spark.read.parquet(f"{at}/part={k}").inputFiles()) != files for k in range(len(parts))):
        for k, part in enumerate(parts):
            part.coalesce(1).write.mode("overwrite").parquet(f"{at}/part={k}")
        files = 1
    return spark.readStream.schema(parts[0].schema).option("maxFilesPerTrigger", files).parquet(f"{at}/part=*")


def top_of_each(stream: DataFrame, keys: list[str], order: list[tuple[str, bool]], names: list[str], n: int) -> DataFrame:
    """(keys, names, rank) of each key's first n rows, as ROW_NUMBER() <= n over the stream so far gives (complete mode).

    order holds (numeric column, ascending) and ends with a unique one. A key's rows are sorted in its aggregate, so they
    have to fit into one task.
    """
    parts = [(F.col(c) if up else -F.col(c)).alias(f"_o{k}") for k, (c, up) in enumerate(order)]
    rows = F.slice(F.sort_array(F.collect_list(F.struct(*parts, *names))), 1, n)
    found = stream.groupBy(*keys).agg(rows.alias("_r")).select(*keys, F.posexplode("_r").alias("_p", "_x"))
    return found.select(*keys, *[F.col("_x")[c].alias(c) for c in names], (F.col("_p") + 1).alias("rank"))


def drain(stream: DataFrame, mode: str = "append") -> DataFrame:
    """All that the stream gives for the input that is there now (trigger availableNow).

    Append and update results go to Parquet in the shared checkpoint folder, through foreachBatch in update mode
    with the batch number as _batch; complete results are the last batch's.
    """
    spark = stream.sparkSession
    at = f"{shared_folder(spark)}-stream"
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{at}/log").trigger(availableNow=True)
    if mode == "append":
        writer.format("parquet").option("path", f"{at}/rows").start().awaitTermination()
        return spark.read.schema(stream.schema).parquet(f"{at}/rows")

    def keep(batch: DataFrame, number: int) -> None:
        batch.withColumn("_batch", F.lit(number)).write.mode("overwrite").parquet(f"{at}/rows/batch={number}")

    writer.foreachBatch(keep).start().awaitTermination()
    rows = spark.read.parquet(f"{at}/rows/batch=*")
    if mode == "complete":
        last = rows.agg(F.max("_batch").alias("_batch"))
        rows = rows.join(F.broadcast(last), "_batch")
    return rows.drop("batch")


def tumbling(stream: DataFrame, ts: str, width: str, late: str, keys: list[str], slide: str | None = None) -> DataFrame:
    """Counts and sums of `value` for each window and key; a slide makes windows hop."""
    window = F.window(ts, width, slide) if slide else F.window(ts, width)
    grouped = stream.withWatermark(ts, late).groupBy(window.alias("w"), *keys).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("v"))
    return grouped.select(F.col("w.start").alias("start"), F.col("w.end").alias("stop"), *keys, "n", "v")


def session_windows(stream: DataFrame, ts: str, gap: str, late: str, keys: list[str]) -> DataFrame:
    grouped = stream.withWatermark(ts, late).groupBy(F.session_window(ts, gap).alias("w"), *keys).agg(F.count(F.lit(1)).alias("n"))
    return grouped.select(F.col("w.start").alias("start"), F.col("w.end").alias("stop"), *keys, "n")


def first_of_each(stream: DataFrame, ts: str, late: str, keys: list[str]) -> DataFrame:
    """Deduplication that keeps the first row of a key and forgets keys behind the watermark."""
    return stream.withWatermark(ts, late).dropDuplicatesWithinWatermark(keys)


def interval_join(left: DataFrame, right: DataFrame, ts_left: str, ts_right: str, late: str, key_left: str, key_right: str, within: str) -> DataFrame:
    """Stream-stream join: right rows of the same key from ts_left to `within` after it; state ends with the watermarks."""
    a, b = left.withWatermark(ts_left, late), right.withWatermark(ts_right, late)
    on = (F.col(key_left) == F.col(key_right)) & (F.col(ts_right) >= F.col(ts_left)) & (F.col(ts_right) <= F.col(ts_left) + F.expr(f"INTERVAL {within}"))
    return a.join(b, on)


def versioned_lookup(stream: DataFrame, versions: DataFrame, key: str, ts: str, version_key: str, valid_from: str, valid_to: str) -> DataFrame:
    """Each row of the stream with the version of its key that held at its time, from valid_from up to before valid_to (null: open).

    The table is read anew for each batch, so later versions are seen; no state is kept. Rows without a version keep nulls.
    """
    at = (F.col(ts) >= F.col(valid_from)) & (F.col(valid_to).isNull() | (F.col(ts) < F.col(valid_to)))
    return stream.join(versions, (F.col(key) == F.col(version_key)) & at, "left")


def running_totals(stream: DataFrame, key: str, value: str) -> DataFrame:
    """(key, n, total) after each batch, from state kept by key (update mode)."""
    kind = stream.schema[key].dataType.simpleString()

    def step(k: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        n, total = state.get if state.exists else (0, 0.0)
        for frame in frames:
            n, total = n + len(frame), total + float(frame[value].sum())
        state.update((n, total))
        yield pd.DataFrame({key: [k[0]], "n": [n], "total": [total]})

    return stream.select(key, value).groupBy(key).applyInPandasWithState(step, f"{key} {kind}, n long, total double", "n long, total double", "update", "NoTimeout")


def keep_last(stream: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Deduplication of a changelog that keeps the last row of a key, as a complete-mode aggregate."""
    others = [c for c in stream.columns if c not in keys]
    return stream.groupBy(*keys).agg(F.max(F.struct(*order, *[c for c in others if c not in order])).alias("_r")).select(*keys, "_r.*")
