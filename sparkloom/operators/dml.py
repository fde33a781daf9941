"""Changes as functions from an old table to a new one; each gives the whole new table, and the changed rows where asked."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def insert(table: DataFrame, rows: DataFrame, defaults: dict[str, Column] | None = None) -> DataFrame:
    """INSERT: rows by name; columns they lack get the default or null."""
    given = defaults or {}
    filled = rows.select(*[F.col(c) if c in rows.columns else given.get(c, F.lit(None)).cast(table.schema[c].dataType).alias(c) for c in table.columns])
    return table.unionByName(filled)


def insert_or_ignore(table: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """ON CONFLICT DO NOTHING: rows whose key is new; of several with one key any one, chosen by the smallest values."""
    one = rows.groupBy(*keys).agg(F.min(F.struct(*[c for c in table.columns if c not in keys])).alias("_v")).select(*keys, "_v.*").select(*table.columns)
    return table.unionByName(one.join(table.select(*keys), keys, "left_anti").select(*table.columns))


def upsert(table: DataFrame, rows: DataFrame, keys: list[str], update: dict[str, Column]) -> DataFrame:
    """ON CONFLICT DO UPDATE: update maps columns to expressions over t.<column> and s.<column>. rows has a key once."""
    return merge(table, rows, keys, matched_update=update, insert_new=True)


def update(table: DataFrame, where: Column, values: dict[str, Column]) -> DataFrame:
    """UPDATE: all values are worked out from the old row; rows for which the condition is null stay."""
    return table.select(*[F.when(where, values[c]).otherwise(F.col(c)).cast(table.schema[c].dataType).alias(c) if c in values else F.col(c) for c in table.columns])


def delete(table: DataFrame, where: Column) -> DataFrame:
    """DELETE: rows for which the condition is null stay."""
    return table.where(~F.coalesce(where, F.lit(False)))


def delete_using(table: DataFrame, others: DataFrame, on: Column) -> DataFrame:
    """DELETE ... USING."""
    return table.join(others, on, "left_anti")


def merge(table: DataFrame, source: DataFrame, keys: list[str], matched_update: dict[str, Column] | None = None, matched_delete: Column | None = None, insert_new: bool = False, missing_delete: Column | None = None) -> DataFrame:
    """MERGE by one full join: matched rows are deleted or updated, source rows without a match inserted, table rows
    without one kept or deleted. Conditions and expressions name columns as t.<column> and s.<column>. A table row that two
    source rows match is an error, as in SQL; null keys match nothing."""
    counted = source.withColumns({"_in": F.lit(True), "_k": F.count(F.lit(1)).over(Window.partitionBy(*keys))})
    t, s = table.withColumn("_in", F.lit(True)).alias("t"), counted.alias("s")
    on = None
    for k in keys:
        part = F.col(f"t.{k}") == F.col(f"s.{k}")
        on = part if on is None else on & part
    both = t.join(s, on, "full")
    in_t, in_s = F.coalesce(F.col("t._in"), F.lit(False)), F.coalesce(F.col("s._in"), F.lit(False))
    drop = F.lit(False)
    if matched_delete is not None:
        drop = drop | (in_t & in_s & F.coalesce(matched_delete, F.lit(False)))
    if missing_delete is not None:
        drop = drop | (in_t & ~in_s & F.coalesce(missing_delete, F.lit(False)))
    if not insert_new:
        drop = drop | ~in_t
    values = matched_update or {}
    out = []
    for c in table.columns:
        new = F.col(f"s.{c}") if c in source.columns else F.lit(None)
        kept = F.when(in_s, values[c]).otherwise(F.col(f"t.{c}")) if c in values else F.col(f"t.{c}")
        out.append(F.when(in_t, kept).otherwise(new).cast(table.schema[c].dataType).alias(c))
    twice = F.raise_error(F.lit("MERGE: two source rows match one row of the table")).cast("boolean")
    return both.where(F.when(in_t & in_s & (F.col("s._k") > 1), twice).otherwise(~drop)).select(*out)


def update_returning(table: DataFrame, where: Column, values: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """UPDATE ... RETURNING *: the whole new table, and the new rows that the condition picked, changed in value or not."""
    return update(table, where, values), update(table.where(where), F.lit(True), values)


def delete_returning(table: DataFrame, where: Column) -> tuple[DataFrame, DataFrame]:
    """DELETE ... RETURNING *: the rows that stay, and those that the condition picked."""
    return delete(table, where), table.where(where)


def changed(old: DataFrame, new: DataFrame) -> DataFrame:
    """Rows of the new table that the old one does not have, with repeats: a difference, for RETURNING see update_returning()."""
    return new.exceptAll(old)
