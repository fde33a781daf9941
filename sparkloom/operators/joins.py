"""Joins that SQL has no equality for: as-of, band, interval and overlap. All become equi-joins or one window."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.session import kept

#: Rows of a key that block_join() lets meet at once, on each side, and pairs for which it takes another partition.
BLOCK_ROWS, TASK_PAIRS, TASK_ROWS = 2048, 1 << 24, 1 << 20
#: Tiles into which pairs_within() cuts the pairs of all hot keys together, whatever their number: a row is sent about sqrt(2 * TILES) times at most.
TILES = 1024


def asof_join(
    left: DataFrame, right: DataFrame, on: str, by: list[str], values: list[str], direction: str = "backward", right_suffix: str = "_r", slices: Callable[[Column], Column] | None = None
) -> DataFrame:
    """Each left row with the nearest right row of the same `by` at or before it (backward) or at or after it (forward).

    Both sides are united and each left row takes the last right row before it in one window over `by`: one
    shuffle, a sort, and no pair is ever formed. Of right rows with equal times the one with the greatest values
    is taken. Left rows without a match keep nulls; null keys and times match nothing.

    With hot keys, slices (a function of the time that never falls, such as its day) divides each key: windows then
    cover a key and slice, and what a slice hands on to later ones comes from one aggregated row a key and slice.
    """
    forward = direction == "forward"
    payload = F.struct(F.col(on).alias(on), *[F.col(v).alias(v) for v in values])
    empty = F.lit(None).cast(right.select(payload.alias("p")).schema["p"].dataType)
    rows = F.struct(*left.columns)
    l_side = left.select(*[F.col(b).alias(f"_k{i}") for i, b in enumerate(by)], F.col(on).alias("_t"), F.lit(1).alias("_s"), rows.alias("_l"), empty.alias("_p"))
    none = F.lit(None).cast(left.select(rows.alias("l")).schema["l"].dataType)
    r_side = right.dropna(subset=[*by, on]).select(*[F.col(b).alias(f"_k{i}") for i, b in enumerate(by)], F.col(on).alias("_t"), F.lit(0).alias("_s"), none.alias("_l"), payload.alias("_p"))
    keys = [f"_k{i}" for i in range(len(by))]
    both = l_side.unionByName(r_side)
    if slices is not None:
        both = both.withColumn("_b", slices(F.col("_t")))
    inside = keys if slices is None else [*keys, "_b"]
    order = [F.col("_t").desc() if forward else F.col("_t"), F.col("_s"), F.col("_p")]
    window = Window.partitionBy(*inside).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("_p", F.last("_p", ignorenulls=True).over(window)).where("_l IS NOT NULL")
    if slices is not None:
        # the payload starts with the time: the greatest of a slice is its last; forward the first time's greatest is wanted
        ends = both.groupBy(*inside, "_t").agg(F.max("_p").alias("_p")).groupBy(*inside).agg(F.min_by("_p", F.when(F.col("_p").isNotNull(), F.col("_t"))).alias("_c")) if forward else both.groupBy(*inside).agg(F.max("_p").alias("_c"))
        earlier = Window.partitionBy(*keys).orderBy(F.col("_b").desc() if forward else F.col("_b")).rowsBetween(Window.unboundedPreceding, -1)
        handed = ends.withColumn("_c", F.last("_c", ignorenulls=True).over(earlier)).where("_c IS NOT NULL")
        found = found.join(handed, inside, "left").withColumn("_p", F.coalesce("_p", "_c"))
    found = found.withColumn("_p", F.when(F.col("_t").isNotNull(), F.col("_p")))
    return found.select("_l.*", F.col(f"_p.{on}").alias(on + right_suffix), *[F.col(f"_p.{v}").alias(v if v not in left.columns else v + right_suffix) for v in values])


def band_join(left: DataFrame, right: DataFrame, left_on: str, right_on: str, width: float, by: list[tuple[str, str]] = (), how: str = "inner") -> DataFrame:
    """Rows with abs(left_on - right_on) <= width: the axis is cut into buckets of that width, the right side is put
    into its own and both neighbouring buckets, and the buckets are joined by equality. how is inner, left, right or full;
    right rows without a match are found by a second join in which the left side is the one put into three buckets."""
    if how not in ("inner", "left", "right", "full"):
        raise ValueError(f"how must be inner, left, right or full, not {how}")
    bucket = lambda c: F.floor(F.col(c) / F.lit(width)).cast("long")
    three = lambda c: F.explode(F.array(bucket(c) - 1, bucket(c), bucket(c) + 1))
    on = (F.col("_b") == F.col("_rb")) & (F.abs(F.col(left_on) - F.col(right_on)) <= width)
    for x, y in by:
        on &= F.col(x) == F.col(y)
    found = left.withColumn("_b", bucket(left_on)).join(right.withColumn("_rb", three(right_on)), on, "left" if how in ("left", "full") else "inner").drop("_b", "_rb")
    if how in ("inner", "left"):
        return found
    alone = right.withColumn("_rb", bucket(right_on)).join(left.withColumn("_b", three(left_on)), on, "left_anti").drop("_rb")
    return found.unionByName(alone, allowMissingColumns=True)


def _buckets(start: Column, stop: Column, width: int) -> Column:
    return F.sequence(F.floor(start / width).cast("long"), F.floor(stop / width).cast("long"))


def interval_join(points: DataFrame, spans: DataFrame, at: str, start: str, stop: str, width: int, by: list[tuple[str, str]] = ()) -> DataFrame:
    """Points inside closed spans (start <= at <= stop), all whole numbers. Spans are put into every bucket of `width` they touch."""
    a = points.withColumn("_b", F.floor(F.col(at) / width).cast("long"))
    b = spans.where(F.col(start) <= F.col(stop)).withColumn("_rb", F.explode(_buckets(F.col(start), F.col(stop), width)))
    on = (F.col("_b") == F.col("_rb")) & F.col(at).between(F.col(start), F.col(stop))
    for x, y in by:
        on &= F.col(x) == F.col(y)
    return a.join(b, on).drop("_b", "_rb")


def overlap_join(left: DataFrame, right: DataFrame, left_span: tuple[str, str], right_span: tuple[str, str], width: int, by: list[tuple[str, str]] = ()) -> DataFrame:
    """Pairs of closed spans that overlap, each once: the pair is kept in the bucket where the later span starts."""
    (ls, le), (rs, re) = left_span, right_span
    a = left.where(F.col(ls) <= F.col(le)).withColumn("_b", F.explode(_buckets(F.col(ls), F.col(le), width)))
    b = right.where(F.col(rs) <= F.col(re)).withColumn("_rb", F.explode(_buckets(F.col(rs), F.col(re), width)))
    on = (F.col("_b") == F.col("_rb")) & (F.col(ls) <= F.col(re)) & (F.col(rs) <= F.col(le)) & (F.col("_b") == F.floor(F.greatest(F.col(ls), F.col(rs)) / width))
    for x, y in by:
        on &= F.col(x) == F.col(y)
    return a.join(b, on).drop("_b", "_rb")


def salted_join(large: DataFrame, small: DataFrame, on: list[str], salts: int = 16, how: str = "inner") -> DataFrame:
    """An equi-join with hot keys spread over `salts` partitions: the large side gets a salt, the small side all of them.

    how is inner, left, left_semi, left_anti, right or full. Each large row meets one copy of a small row, so the first four need
    no more; for the others, small rows whose key the large side lacks come from an anti join without copies. If there are many
    copies, both sides are counted and spread over partitions of TASK_ROWS, which AQE does not put together.
    """
    if how not in ("inner", "left", "left_semi", "left_anti", "right", "full"):
        raise ValueError(f"how must be inner, left, left_semi, left_anti, right or full, not {how}")
    a = large.withColumn("_salt", F.pmod(F.xxhash64(*large.columns), F.lit(salts)).cast("int"))
    b = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    copies, parts = small.count() * salts, 0
    if copies > TASK_ROWS:
        parts = -(-(large.count() + copies) // TASK_ROWS)
        a, b = a.repartition(parts, *on, "_salt"), b.repartition(parts, *on, "_salt")
    found = a.join(b, [*on, "_salt"], {"right": "inner", "full": "left"}.get(how, how)).drop("_salt")
    if how not in ("right", "full"):
        return found
    if parts:
        keys = a.select(*on, "_salt").distinct().select(*on).repartition(parts, *on).distinct()
        return found.unionByName(small.repartition(parts, *on).join(keys, on, "left_anti"), allowMissingColumns=True)
    return found.unionByName(small.join(large.select(*on).distinct(), on, "left_anti"), allowMissingColumns=True)


def near_join(left: DataFrame, right: DataFrame, left_at: tuple[str, str], right_at: tuple[str, str], distance: float) -> DataFrame:
    """Pairs of points in a plane at most `distance` apart, by an equi-join on cells of a grid: a left row is in one cell, a right
    row in its own and the eight around it, so that each pair meets once. Points without a coordinate match nothing; the rows of
    a crowded cell meet in blocks."""
    if not distance > 0:
        raise ValueError("distance must be over 0")
    cell = lambda c: F.floor(F.col(c) / F.lit(distance)).cast("long")
    around = lambda c: F.explode(F.array(cell(c) - 1, cell(c), cell(c) + 1))
    a = left.withColumns({"_cx": cell(left_at[0]), "_cy": cell(left_at[1])})
    b = right.withColumn("_rx", around(right_at[0])).withColumn("_ry", around(right_at[1]))
    dx, dy = F.col(left_at[0]) - F.col(right_at[0]), F.col(left_at[1]) - F.col(right_at[1])
    near = dx * dx + dy * dy <= distance * distance
    return block_join(a, b, [("_cx", "_rx"), ("_cy", "_ry")]).where(near).drop("_cx", "_cy", "_rx", "_ry")


def _partitions(counts: DataFrame, pairs: Column, most: int | None = None) -> int:
    """Partitions for a join of which counts has the rows (_n) and pairs of each key; AQE does not coalesce a given number."""
    found = counts.agg(F.sum(pairs.cast("double")), F.sum("_n")).first()
    return max(1, -(-int(found[0] or 0) // (most or TASK_PAIRS)), -(-(found[1] or 0) // TASK_ROWS))


def _sections(df: DataFrame, keys: list[str], hot: DataFrame) -> DataFrame:
    """df with the columns of hot, which has the keys (_h0, ...) that come in several blocks; there are few of them."""
    on = F.lit(True)
    for i, k in enumerate(keys):
        on &= F.col(k) == F.col(f"_h{i}")
    return df.join(F.broadcast(hot), on, "left").drop(*[f"_h{i}" for i in range(len(keys))])


def _block(names: list[str], blocks: Column) -> Column:
    return F.pmod(F.xxhash64(*names), blocks).cast("int")


def block_join(left: DataFrame, right: DataFrame, on: list[tuple[str, str]]) -> DataFrame:
    """An inner equi-join whose keys have many rows on both sides, so that its pairs grow as a product: rows of a key are dealt
    into blocks of BLOCK_ROWS, and each block of the left meets each of the right under a key of its own. Rows are copied
    once a block of the other side. Both sides are worked out twice, once to be counted. Null keys match nothing."""
    left_keys, right_keys = [x for x, _ in on], [y for _, y in on]
    left, right = left.dropna(subset=left_keys), right.dropna(subset=right_keys)
    side = lambda df, keys, l, r: df.select(*[F.col(k).alias(f"_h{i}") for i, k in enumerate(keys)], F.lit(l).alias("_l"), F.lit(r).alias("_r"))
    both = side(left, left_keys, 1, 0).unionByName(side(right, right_keys, 0, 1))
    each = [f"_h{i}" for i in range(len(on))]
    counts = kept(both.groupBy(*each).agg(F.sum("_l").alias("_l"), F.sum("_r").alias("_r"), F.count(F.lit(1)).alias("_n")))
    parts = _partitions(counts, F.col("_l").cast("double") * F.col("_r"))
    blocks = lambda c: F.ceil(F.col(c) / BLOCK_ROWS).cast("int")
    hot = counts.where((F.least("_l", "_r") > 0) & (F.greatest("_l", "_r") > BLOCK_ROWS)).select(*each, blocks("_l").alias("_bl"), blocks("_r").alias("_br"))
    mine = lambda c: F.coalesce(F.col(c), F.lit(1))
    every = lambda c: F.explode(F.sequence(F.lit(0), mine(c) - 1))
    a = _sections(left, left_keys, hot).select(*left.columns, _block(left.columns, mine("_bl")).alias("_i"), every("_br").alias("_j"))
    b = _sections(right, right_keys, hot).select(*right.columns, every("_bl").alias("_ri"), _block(right.columns, mine("_br")).alias("_rj"))
    meet = (F.col("_i") == F.col("_ri")) & (F.col("_j") == F.col("_rj"))
    for x, y in on:
        meet &= F.col(x) == F.col(y)
    return a.repartition(parts, *left_keys, "_i", "_j").join(b.repartition(parts, *right_keys, "_ri", "_rj"), meet).drop("_i", "_j", "_ri", "_rj")


def _tiled_pairs(rows: DataFrame, keys: list[str], hot: DataFrame) -> DataFrame:
    """pairs_within() for the keys of hot (_h0, ..., _n). Sorted values are packed in chunks, a key's chunks are dealt into groups, and
    each two groups meet in a tile. Groups do not grow in number with the rows, so what is sent grows as the rows and not as their pairs."""
    chunk, n = max(1, BLOCK_ROWS // 8), F.col("_n").cast("double")
    squares = hot.agg(F.sum(n * n)).first()[0]
    hot = hot.withColumn("_g", F.least(F.ceil(n / chunk), F.ceil(n * math.sqrt(2 * TILES / squares))).cast("int"))
    size, sent, tiles = hot.agg(F.sum("_n"), F.sum(n * (F.col("_g") + 1)), F.sum(F.col("_g") * (F.col("_g") + 1) / 2)).first()
    parts = max(1, min(-(-int(squares / 2) // TASK_PAIRS), int(tiles)), -(-int(sent) // TASK_ROWS))
    ranged = rows.repartitionByRange(-(-size // TASK_ROWS), *keys, "_v").sortWithinPartitions(*keys, "_v")
    packed = ranged.withColumn("_c", F.floor(F.monotonically_increasing_id() / chunk)).groupBy(*keys, "_c").agg(F.sort_array(F.collect_list("_v")).alias("_vs"))
    dealt = kept(_sections(packed, keys, hot).select(*keys, "_vs", "_c", "_g", F.pmod("_c", "_g").cast("int").alias("_o")))
    a = dealt.select(*keys, F.col("_vs").alias("_xs"), F.col("_c").alias("_p"), F.col("_o").alias("_i"), F.explode(F.sequence(F.col("_o"), F.col("_g") - 1)).alias("_j"))
    b = dealt.select(*keys, F.col("_vs").alias("_ys"), F.col("_c").alias("_q"), F.explode(F.sequence(F.lit(0), F.col("_o"))).alias("_i"), F.col("_o").alias("_j"))
    meet, in_order = [*keys, "_i", "_j"], F.col("_p") <= F.col("_q")
    met = a.repartition(parts, *meet).join(b.repartition(parts, *meet).hint("merge"), meet).where((F.col("_i") < F.col("_j")) | in_order)
    met = met.select(*[F.when(in_order, F.col(u)).otherwise(F.col(v)).alias(u) for u, v in (("_xs", "_ys"), ("_ys", "_xs"))])
    # coalesce() leaves the partitions as they are but ends the generated code, which else makes all rows of a tile before it hands on any
    return met.coalesce(parts).select(F.explode("_xs").alias("x"), "_ys").coalesce(parts).select("x", F.explode("_ys").alias("y")).where("x < y")


def pairs_within(df: DataFrame, on: list[str], by: str, counted: bool = False) -> DataFrame:
    """(x, y), x < y: values of `by` of each two rows that agree in `on`. Keys of over BLOCK_ROWS rows are cut into tiles. Nulls match
    nothing. If counted, (x, y, n) with how often each pair occurs, in partitions by their number, so that a task's groups stay few."""
    rows = df.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(on)], F.col(by).alias("_v"))
    rows = rows.where(" AND ".join(f"{c} IS NOT NULL" for c in rows.columns))  # dropna() would drop NaN too
    keys = [f"_k{i}" for i in range(len(on))]
    counts = kept(rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")))
    hot = counts.where(F.col("_n") > BLOCK_ROWS).withColumnsRenamed({k: f"_h{i}" for i, k in enumerate(keys)})
    tiled = not hot.isEmpty()
    plain = _sections(rows, keys, hot).where("_n IS NULL").drop("_n") if tiled else rows
    parts = _partitions(counts.where(F.col("_n") <= BLOCK_ROWS), F.col("_n").cast("double") * F.col("_n") / 2)
    a, b = (plain.withColumnRenamed("_v", v).repartition(parts, *keys) for v in ("x", "y"))
    found = a.join(b, keys).where("x < y").select("x", "y")
    if tiled:
        found = found.unionByName(_tiled_pairs(_sections(rows, keys, hot).where("_n IS NOT NULL").drop("_n"), keys, hot))
    if not counted:
        return found
    return found.repartition(_partitions(counts, F.col("_n").cast("double") * (F.col("_n") - 1) / 2, TASK_ROWS), "x", "y").groupBy("x", "y").agg(F.count(F.lit(1)).alias("n"))
