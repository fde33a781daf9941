"""Edge cases of the operators: nulls, empty sides, ties, cycles."""

from __future__ import annotations

import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from sparkloom.functions import scalar
from sparkloom.operators import dml, documents, graph, incremental, joins, ordering, rowpattern, search, sketches, tables, timeseries, windows
from sparkloom.plans.catalog import QUERIES


def rows(df, *names):
    return sorted((tuple(r[n] for n in names or df.columns) for r in df.collect()), key=lambda r: tuple((x is None, str(x)) for x in r))


def test_series_is_empty_where_the_step_leads_away(spark):
    df = spark.createDataFrame([(1, 3, 1), (3, 1, 1), (3, 1, -1), (None, 1, 1)], "a int, b int, s int")
    assert [r.x for r in df.select(tables.series(F.col("a"), F.col("b"), F.col("s")).alias("x")).collect()] == [[1, 2, 3], [], [3, 2, 1], None]


def test_unnest(spark):
    df = spark.createDataFrame([(1, [7, None]), (2, []), (3, None)], "k int, a array<int>")
    assert rows(tables.unnest(df, "a", "e", "ord"), "k", "e", "ord") == [(1, 7, 1), (1, None, 2)]
    assert rows(tables.unnest(df, "a", "e", outer=True), "k", "e") == [(1, 7), (1, None), (2, None), (3, None)]
    two = spark.createDataFrame([([1, 2, 3], ["x"])], "a array<int>, b array<string>")
    assert rows(tables.unnest_together(two, {"p": "a", "q": "b"}), "p", "q") == [(1, "x"), (2, None), (3, None)]


@pytest.mark.parametrize(("op", "others", "every", "some"), [(">", [1, 2], [3], [2, 3]), (">", [], [1, 2, 3], []), (">", [1, None], [], [2, 3]), ("<>", [2, 2], [1, 3], [1, 3]), ("<>", [1, 2], [3], [1, 2, 3])])
def test_quantified(spark, op, others, every, some):
    df = spark.createDataFrame([(1,), (2,), (3,)], "v int")
    o = spark.createDataFrame([(x,) for x in others], "o int")
    assert [r[0] for r in rows(windows.compare_all(df, "v", op, o, "o"))] == every
    assert [r[0] for r in rows(windows.compare_any(df, "v", op, o, "o"))] == some


def test_limit_with_ties_and_nulls(spark):
    df = spark.createDataFrame([(1, 5), (2, 5), (3, 4), (4, None)], "k int, v int")
    assert rows(windows.limit_with_ties(df, [("v", False)], 1), "k") == [(1,), (2,)]
    assert rows(windows.limit_with_ties(df, [("v", True)], 4), "k") == [(1,), (2,), (3,), (4,)]


def test_exclude_of_an_empty_frame_is_null(spark):
    df = spark.createDataFrame([(1, 1, 2.0), (2, 1, 3.0)], "k int, o int, v double")
    assert rows(windows.excluding(df, ["k"], [F.col("o")], (-1, 1), "v"), "k", "_sum", "_count") == [(1, None, 0), (2, None, 0)]


def test_asof_join_takes_equal_times_and_keeps_rows_without_a_match(spark):
    left = spark.createDataFrame([(1, "a", 10), (2, "a", 5), (3, "b", 10)], "id int, k string, t int")
    right = spark.createDataFrame([("a", 10, "x"), ("a", 6, "y")], "k string, t int, v string")
    assert rows(joins.asof_join(left, right, "t", ["k"], ["v"]), "id", "v") == [(1, "x"), (2, None), (3, None)]
    assert rows(joins.asof_join(left, right, "t", ["k"], ["v"], "forward"), "id", "v") == [(1, "x"), (2, "y"), (3, None)]


def test_overlap_join_gives_each_pair_once(spark):
    a = spark.createDataFrame([(1, 0, 100), (2, 50, 40)], "a int, s int, e int")
    b = spark.createDataFrame([(1, 10, 90), (2, 100, 200), (3, 101, 102)], "b int, u int, w int")
    assert rows(joins.overlap_join(a, b, ("s", "e"), ("u", "w"), 7), "a", "b") == [(1, 1), (1, 2)]


def test_outer_salted_and_band_joins(spark):
    a = spark.createDataFrame([(1, 10.0), (1, 11.0), (2, 50.0), (None, None)], "k int, x double")
    b = spark.createDataFrame([(1, 10.5), (3, 90.0), (None, 1.0)], "k int, y double")
    assert rows(joins.salted_join(a, b, ["k"], how="right"), "k", "x", "y") == [(1, 10.0, 10.5), (1, 11.0, 10.5), (3, None, 90.0), (None, None, 1.0)]
    assert joins.salted_join(a, b, ["k"], how="full").count() == 6
    assert rows(joins.salted_join(a, b, ["k"], how="left_anti"), "k") == [(2,), (None,)]
    right = b.withColumnRenamed("k", "j")
    assert rows(joins.band_join(a, right, "x", "y", 2.0, how="right"), "x", "y") == [(10.0, 10.5), (11.0, 10.5), (None, 1.0), (None, 90.0)]
    assert joins.band_join(a, right, "x", "y", 2.0, how="full").count() == 6
    for f in (lambda: joins.salted_join(a, b, ["k"], how="cross"), lambda: joins.band_join(a, right, "x", "y", 2.0, how="left_anti")):
        with pytest.raises(ValueError, match="how must be"):
            f()


def test_returning_and_duplicate_matches(spark):
    t = spark.createDataFrame([(1, 0), (2, 5)], "k int, v int")
    new, back = dml.update_returning(t, F.col("k") < 3, {"v": F.col("v") * 2})
    assert rows(back) == [(1, 0), (2, 10)] == rows(new)
    left, gone = dml.delete_returning(t, F.col("v") > 1)
    assert (rows(left), rows(gone)) == ([(1, 0)], [(2, 5)])
    twice = spark.createDataFrame([(2, 7), (2, 8), (3, 1), (3, 2)], "k int, v int")
    with pytest.raises(Exception, match="two source rows"):
        dml.merge(t, twice, ["k"], {"v": F.col("s.v")}, insert_new=True).collect()
    assert rows(dml.merge(t, twice.where("k = 3"), ["k"], {"v": F.col("s.v")}, insert_new=True)) == [(1, 0), (2, 5), (3, 1), (3, 2)]


def test_knn_join_in_blocks(spark, monkeypatch):
    e = spark.createDataFrame([(k, [float(k), 0.0]) for k in range(40)], "i int, v array<double>")
    want = rows(search.knn_join(e.where("i < 9"), e, "i", "v", "i", "v", 2), "query", "neighbour", "rank")
    monkeypatch.setattr(search, "BROADCAST_NUMBERS", 4)
    assert rows(search.knn_join(e.where("i < 9"), e, "i", "v", "i", "v", 2), "query", "neighbour", "rank") == want and len(want) == 18


def test_proximity(spark):
    df = spark.createDataFrame([("a x x b a",), ("a a",), (None,)], "t string")
    assert [r[0] for r in df.select(search.proximity(F.col("t"), "a", "b")).collect()] == [1, None, None]


def test_without_a_shared_folder_a_cluster_is_refused(spark):
    from types import SimpleNamespace

    from sparkloom.session import shared_folder

    nowhere = SimpleNamespace(isDefined=lambda: False)
    context = SimpleNamespace(getConf=lambda: {}, master="spark://host", _jsc=SimpleNamespace(sc=lambda: SimpleNamespace(getCheckpointDir=lambda: nowhere)))
    with pytest.raises(ValueError, match="checkpoint"):
        shared_folder(SimpleNamespace(conf={}, sparkContext=context))
    assert shared_folder(spark).startswith("file:")


def test_dml_conditions_that_are_null_leave_rows_alone(spark):
    t = spark.createDataFrame([(1, None), (2, 5)], "k int, v int")
    assert rows(dml.delete(t, F.col("v") > 1)) == [(1, None)]
    assert rows(dml.update(t, F.col("v") > 1, {"v": F.col("v") + 1})) == [(1, None), (2, 6)]
    s = spark.createDataFrame([(2, 7), (3, 8)], "k int, v int")
    assert rows(dml.merge(t, s, ["k"], {"v": F.col("s.v")}, insert_new=True)) == [(1, None), (2, 7), (3, 8)]
    assert rows(dml.insert(t, spark.createDataFrame([(9,)], "k int"), {"v": F.lit(4)})) == [(1, None), (2, 5), (9, 4)]


def test_hierarchy_reports_a_cycle_and_ends(spark):
    n = spark.createDataFrame([(1, 3), (2, 1), (3, 2)], "id int, parent int")
    found = graph.hierarchy(n, "id", "parent", n.where("id = 1"))
    assert rows(found, "node", "level", "is_cycle") == [(1, 1, False), (1, 4, True), (2, 2, False), (3, 3, False)]


def test_hierarchy_follows_a_chain_to_its_end(spark):
    n = spark.createDataFrame([(i, i - 1 if i else None) for i in range(90)], "id int, parent int").coalesce(1).cache()
    found = graph.hierarchy(n, "id", "parent", n.where("parent IS NULL"))
    assert sorted((r.node, r.level, len(r.path)) for r in found.collect()) == [(i, i + 1, i + 1) for i in range(90)]


def test_reachable_ends_on_cycles(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (4, 1)], "src int, dst int")
    assert rows(graph.reachable(e, spark.createDataFrame([(1,)], "node int")), "node", "hops") == [(1, 0), (2, 1), (3, 2)]


def test_reachable_stops_after_the_given_hops(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (4, 1)], "src int, dst int")
    start = spark.createDataFrame([(1,)], "node int")
    assert rows(graph.reachable(e, start, most=2), "node", "hops") == [(1, 0), (2, 1), (3, 2)]
    assert rows(graph.reachable(e, start, most=0), "node") == [(1,)]
    assert graph.reachable(e, start).count() == 4


def test_shortest_paths_go_on_from_nodes_nearer_than_the_bound(spark):
    e = spark.createDataFrame([(1, 2, 5.0), (2, 3, 1.0), (1, 4, 4.0), (4, 3, 5.0), (3, 5, 1.0)], "src int, dst int, w double")
    start = spark.createDataFrame([(1,)], "node int")
    assert rows(graph.shortest_paths(e, start, "w"), "node", "distance") == [(1, 0.0), (2, 5.0), (3, 6.0), (4, 4.0), (5, 7.0)]
    assert rows(graph.shortest_paths(e, start, "w", most=5.0), "node", "distance") == [(1, 0.0), (2, 5.0), (3, 9.0), (4, 4.0)]


def test_match_recognize(spark):
    df = spark.createDataFrame([("a", i, v) for i, v in enumerate([5, 4, 3, 6, 7, 2, 9])], "k string, t int, v int")
    from pyspark.sql import Window

    before = F.lag("v").over(Window.partitionBy("k").orderBy("t"))
    d = df.withColumn("_p", before)
    define = {"D": F.col("v") < F.col("_p"), "U": F.col("v") > F.col("_p")}
    found = rowpattern.match_recognize(d, ["k"], ["t"], define, "D+U+", "t")
    assert rows(found, "first", "last", "n", "symbols") == [(1, 4, 4, "DDUU"), (5, 6, 2, "DU")]
    with pytest.raises(ValueError, match="supported"):
        rowpattern.match_recognize(d, ["k"], ["t"], define, "D[U]", "t")


def test_rows_with_several_symbols(spark):
    d = spark.createDataFrame([("a", i, v) for i, v in enumerate([1, 5, 9, 9, 2, 7])] + [("b", 0, None)], "k string, t int, v int")
    define = {"L": F.col("v") > 0, "H": F.col("v") > 4}
    seek = lambda pattern, **more: rowpattern.match_recognize(d, ["k"], ["t"], define, pattern, "t", **more)
    assert rows(seek("L+?HH"), "match_number", "first", "last", "symbols") == [(1, 0, 2, "LHH")]
    assert rows(seek("L+H"), "first", "symbols") == [(0, "LLLLLH")]
    assert rows(seek("LH", skip="to last H"), "first", "symbols") == [(0, "LH"), (1, "LH"), (2, "LH"), (4, "LH")]
    assert rows(seek("LH", skip="to next row"), "first") == rows(seek("LH", skip="to first H"), "first")
    assert rows(seek("H{2}|L", all_rows=True), "match_number", "place", "symbol", "t") == [(1, 1, "L", 0), (2, 1, "H", 1), (2, 2, "H", 2), (3, 1, "L", 3), (4, 1, "L", 4), (5, 1, "L", 5)]
    assert rows(seek("X-?", all_rows=True).where("k = 'b'"), "symbol") == [("X",)] and rows(seek("-").where("k = 'b'"), "symbols") == [("-",)]
    with pytest.raises(Exception, match="not behind the first row"):
        seek("LH", skip="to first L").collect()
    with pytest.raises(ValueError, match="skip must be"):
        seek("LH", skip="over")


def test_distances(spark):
    df = spark.createDataFrame([([1.0, 2.0], [1.0, 0.0]), ([0.0, 0.0], [1.0, 1.0])], "a array<double>, b array<double>")
    got = [tuple(round(x, 6) for x in r) for r in df.select(*[search.distance(m, F.col("a"), F.col("b")).alias(m) for m in ("l2", "l1", "ip", "cosine", "hamming")]).collect()]
    assert got == [(2.0, 2.0, -1.0, round(1 - 1 / 5**0.5, 6), 1.0), (round(2**0.5, 6), 2.0, -0.0, 1.0, 2.0)]


def test_scalar_functions(spark):
    df = spark.createDataFrame([("a.c", '{"x": {"y": 1}, "z": "q"}')], "s string, j string")
    one = df.select(
        scalar.similar_to(F.col("s"), "a._").alias("a"), scalar.similar_to(F.col("s"), "a.").alias("b"), scalar.json_contains(F.col("j"), {"x": {"y": 1}}).alias("c"),
        scalar.json_contains(F.col("j"), {"x": {"y": 2}}).alias("d"), scalar.json_has_key(F.col("j"), "z").alias("e"), scalar.contains_all(F.array(F.lit(1), F.lit(2)), F.array(F.lit(2))).alias("f"),
    ).first()
    assert tuple(one) == (True, False, True, False, True, True)


def test_gap_fill(spark):
    df = spark.createDataFrame([("a", 0, 1.0), ("a", 3, 4.0), ("b", 5, 2.0)], "k string, b long, v double")
    assert rows(timeseries.gap_fill(df, ["k"], "b", 1, ["v"], interpolate=True), "k", "b", "v") == [("a", 0, 1.0), ("a", 1, 2.0), ("a", 2, 3.0), ("a", 3, 4.0), ("b", 5, 2.0)]


def test_entry_point_without_the_corpus_operators(tmp_path):
    root = Path(__file__).resolve().parent.parent
    code = f"""
import sys, shutil
shutil.copytree({str(root)!r}, {str(tmp_path / "repo")!r}, ignore=shutil.ignore_patterns("llm", ".git", "corpus_pipeline.py", "__pycache__"))
sys.path.insert(0, {str(tmp_path / "repo")!r})
import __spark_entry__ as e, os
os.makedirs({str(tmp_path / "repo/sparkloom/llm/__pycache__")!r})
assert not any(k.startswith("op") or k == "pipeline" for k in e.queries()), list(e.queries())
assert set(e.oracle_sql()) <= set(e.queries())
"""
    subprocess.run([sys.executable, "-c", code], check=True, cwd=tmp_path)


@pytest.mark.parametrize("direction", ["backward", "forward"])
def test_asof_join_in_slices_is_the_asof_join(spark, direction):
    times = [(k, t, f"{k}{t}{n}") for k in ("a", "b", None) for t in (None, 1, 4, 4, 19, 20, 55) for n in (0, 1)]
    left = spark.createDataFrame([(f"{k}{t}{n}", k, t) for n, (k, t) in enumerate((k, t) for k in ("a", "b", "c", None) for t in [None, *range(0, 70, 3)])], "id string, k string, t int")
    right = spark.createDataFrame(times, "k string, t int, v string")
    plain = rows(joins.asof_join(left, right, "t", ["k"], ["v"], direction), "id", "t_r", "v")
    sliced = joins.asof_join(left, right, "t", ["k"], ["v"], direction, slices=lambda t: F.floor(t / 10))
    assert rows(sliced, "id", "t_r", "v") == plain
    want = []
    for r in left.collect():
        near = [(t, v) for k, t, v in times if k == r.k and None not in (k, t, r.t) and (t <= r.t if direction == "backward" else t >= r.t)]
        sign = 1 if direction == "backward" else -1
        want.append((r.id, *max(near, key=lambda x: (sign * x[0], x[1]), default=(None, None))))
    assert plain == sorted(want, key=lambda r: tuple((x is None, str(x)) for x in r))


def test_order_of_a_whole_table(spark):
    df = spark.range(0, 1003, 1, 7).select(((F.col("id") * 7919) % 97).alias("v"), "id", F.when(F.col("id") % 5 > 0, F.col("id")).alias("w"))
    by = [F.col("v").desc(), F.col("id")]
    wanted = sorted(((r.v, r.id, r.w) for r in df.collect()), key=lambda r: (-r[0], r[1]))
    assert [r.n for r in ordering.numbered(df, by, "n").orderBy(*by).collect()] == list(range(1, 1004))
    size, larger = divmod(1003, 10)
    assert [r.n for r in ordering.tiles(df, by, 10, "n").orderBy(*by).collect()] == [k + 1 for k in range(10) for _ in range(size + (k < larger))]
    assert [r.n for r in ordering.tiles(df.limit(3), by, 5, "n").orderBy(*by).collect()] == [1, 2, 3]
    assert [r.n for r in ordering.following(df, by, "w", "n").orderBy(*by).collect()] == [w for _, _, w in wanted[1:]] + [None]
    sums = [r.n for r in ordering.running_sum(df, by, "w", "n").orderBy(*by).collect()]
    assert sums == [sum(w or 0 for _, _, w in wanted[: k + 1]) for k in range(1003)]
    for made in (ordering.numbered(df.limit(0), by), ordering.tiles(df.limit(0), by, 3), ordering.following(df.limit(0), by, "w"), ordering.running_sum(df.limit(0), by, "w")):
        assert made.count() == 0


def test_changes_keep_repeats_and_refuse_unknown_deletes(spark):
    schema = "k int, v string"
    old = spark.createDataFrame([(1, "a"), (1, "a"), (2, None)], schema)
    signed = incremental.changes(spark.createDataFrame([(3, "c"), (2, None)], schema), spark.createDataFrame([(1, "a")], schema))
    assert rows(incremental.apply_changes(old, signed)) == [(1, "a"), (2, None), (2, None), (3, "c")]
    assert rows(incremental.apply_changes(old, incremental.changes(old.limit(0)))) == rows(old)
    with pytest.raises(Exception, match="not in the view"):
        incremental.apply_changes(old, incremental.changes(deletes=spark.createDataFrame([(9, "z")], schema))).collect()
    stored = old.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("k") * 10).alias("t"))
    gone = incremental.changes(deletes=spark.createDataFrame([(1, "a"), (2, None)], schema))
    assert rows(incremental.delta_groups(stored, gone, ["k"], {"t": F.col("k") * 10})) == [(1, 1, 10)]


def test_count_min_is_never_too_low(spark):
    df = spark.range(5000).select((F.col("id") % 300).alias("x")).unionByName(spark.createDataFrame([(None,)] * 9, "x long"))
    first, second = sketches.count_min(df.where("x < 200"), "x", 64), sketches.count_min(df.where("x >= 200"), "x", 64)
    both = first.unionByName(second).groupBy("line", "cell").agg(F.sum("n").alias("n"))
    assert rows(both) == rows(sketches.count_min(df, "x", 64))
    true = dict(df.groupBy("x").count().collect())
    assert all(r.estimate >= true.get(r.x, 0) for r in sketches.estimates(both, spark.range(400).select(F.col("id").alias("x")), "x", 64).collect())
    assert rows(sketches.estimates(sketches.count_min(df.limit(0), "x", 64), spark.range(2).select(F.col("id").alias("x")), "x", 64)) == [(0, 0), (1, 0)]


def test_lookup_of_null_and_missing_keys(spark):
    a = spark.createDataFrame([(1,), (2,), (None,)], "k int")
    b = spark.createDataFrame([(1, "y"), (1, "x"), (None, "z")], "f int, v string")
    found = documents.lookup(a, b, "k", "f", "all")
    assert rows(found.select("k", F.array_join("all.v", "").alias("v")), "k", "v") == sorted([(1, "xy"), (2, ""), (None, "z")], key=str)
    assert documents.lookup(a, b.limit(0), "k", "f", "all").where("size(all) = 0").count() == 3
    assert rows(documents.with_element(found, "all", lambda x: x["v"] > "y"), "k") == [(None,)]
    assert rows(documents.kept_elements(found, "all", lambda x: x["v"] == "y", "some").where("size(some) = 1"), "k") == [(1,)]


def test_equal_buckets(spark):
    df = spark.createDataFrame([(v,) for v in [1, 1, 1, 1, 2, 3, 4, None]], "v int")
    assert rows(documents.equal_buckets(df, "v", 3), "bucket", "lo", "hi", "n") == [(0, 1, 1, 4), (1, 2, 2, 1), (2, 3, 4, 2)]
    assert documents.equal_buckets(df.limit(0), "v", 3).count() == 0


def test_change_feed(spark):
    old = spark.createDataFrame([(1, "a", None), (2, "b", 1), (3, "c", 1)], "k int, x string, y int")
    new = spark.createDataFrame([(1, "a", None), (2, None, 2), (4, "d", 1)], "k int, x string, y int")
    found = documents.change_feed(old, new, "k").withColumn("fields", F.array_join("fields", ","))
    assert rows(found, "k", "change", "fields") == [(2, "update", "x,y"), (3, "delete", None), (4, "insert", None)]


def test_points(spark):
    a = spark.createDataFrame([(1, 0.0, 0.0), (2, -0.5, 1.0), (3, None, 1.0)], "a int, x double, y double")
    b = spark.createDataFrame([(1, 3.0, 4.0), (2, -0.6, 0.9), (3, 0.0, 5.1)], "b int, u double, v double")
    assert rows(joins.near_join(a, b, ("x", "y"), ("u", "v"), 5.0), "a", "b") == [(1, 1), (1, 2), (2, 1), (2, 2), (2, 3)]
    with pytest.raises(ValueError, match="over 0"):
        joins.near_join(a, b, ("x", "y"), ("u", "v"), 0.0)
    square = F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in ((0, 0), (2, 0), (2, 2), (0, 2))])
    at = spark.createDataFrame([(1.0, 1.0), (3.0, 1.0), (None, 1.0), (2.0, 1.0), (0.0, 1.0)], "x double, y double")
    inside = [r[0] for r in at.select(scalar.in_polygon(F.col("x"), F.col("y"), square)).collect()]
    assert inside == [True, False, None, False, True]
    assert at.select(scalar.in_polygon(F.col("x"), F.col("y"), F.slice(square, 1, 0)).alias("p")).where("p").count() == 0


def test_four_cliques(spark):
    e = spark.createDataFrame([(a, b) for a in range(5) for b in range(5) if a < b] + [(4, 5), (5, 5), (1, 0)], "src int, dst int")
    assert rows(graph.four_cliques(e), "a", "b", "c", "d") == [(0, 1, 2, 3), (0, 1, 2, 4), (0, 1, 3, 4), (0, 2, 3, 4), (1, 2, 3, 4)]


def test_xml_table(spark):
    df = spark.createDataFrame([(1, "<r><i a='1'><n>x</n></i><i a='2'/></r>"), (2, "<r/>"), (3, None)], "k int, x string")
    assert rows(tables.xml_table(df, "x", "i", "_a int, n string"), "k", "_a", "n") == [(1, 1, "x"), (1, 2, None)]


def test_windows_by_hot_keys_in_ranges(spark):
    """One key with nine tenths of the rows, a null key and null values, over more ranges than keys."""
    import random

    from pyspark.sql import Window

    pick = random.Random(3)
    data = [(pick.choice(["hot"] * 27 + ["a", "b", None]), i, None if pick.random() < 0.6 else pick.randrange(100)) for i in range(600)]
    df = spark.createDataFrame(data, "k string, t int, v int")
    by = Window.partitionBy("k").orderBy("t")
    upto = by.rowsBetween(Window.unboundedPreceding, 0)
    want = df.select("k", "t", F.lag("v").over(by).alias("p"), F.last("v", True).over(upto).alias("c"), F.coalesce(F.sum("v").over(upto), F.lit(0)).alias("s"))
    got = ordering.running_sum_by(ordering.carried_by(ordering.previous_by(df, ["k"], ["t"], "v", "p"), ["k"], ["t"], "v", "c"), ["k"], ["t"], "v", "s")
    assert got.columns == ["k", "t", "v", "p", "c", "s"]
    assert rows(got, "k", "t", "p", "c", "s") == rows(want)
    assert ordering.carried_by(df.limit(0), ["k"], ["t"], "v", "c").count() == 0
    times = df.where("v IS NOT NULL").select("k", "t", F.timestamp_seconds(F.col("t") * 60 + F.col("v") * 60).alias("ts"))
    assert rows(timeseries.sessions(times, ["k"], "ts", "t", "20 MINUTES", ranged=True)) == rows(timeseries.sessions(times, ["k"], "ts", "t", "20 MINUTES"))


def test_pairs_within_a_hot_key_meet_in_several_tasks(spark, monkeypatch):
    monkeypatch.setattr(joins, "BLOCK_ROWS", 8)
    monkeypatch.setattr(joins, "TASK_PAIRS", 64)
    values = [(1, v) for v in range(50)] + [(1, 3), (1, None), (2, 5), (None, 6), (None, 7), (3, 1), (3, 2)]
    found = joins.pairs_within(spark.createDataFrame(values, "k int, v int"), ["k"], "v")
    want = [(a[1], b[1]) for a in values for b in values if None not in (*a, *b) and a[0] == b[0] and a[1] < b[1]]
    assert sorted((r.x, r.y) for r in found.collect()) == sorted(want)
    assert found.groupBy(F.spark_partition_id()).count().count() > 4


def test_pairs_within_a_hot_key_send_bytes_as_rows_and_not_as_pairs(spark, monkeypatch):
    monkeypatch.setattr(joins, "BLOCK_ROWS", 16)
    monkeypatch.setattr(joins, "TILES", 32, raising=False)
    sc = spark.sparkContext._jsc.sc()

    def sent(n):
        sc.listenerBus().waitUntilEmpty()
        stages = lambda: sc.statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)
        last = max((stages().apply(i).stageId() for i in range(stages().size())), default=-1)
        assert joins.pairs_within(spark.range(n).selectExpr("id div 10000 AS k", "id"), ["k"], "id").agg(F.count("x"), F.sum("x"), F.sum("y")).first() == (
            n * (n - 1) // 2,
            sum(x * (n - 1 - x) for x in range(n)),
            sum(y * y for y in range(n)),
        )
        sc.listenerBus().waitUntilEmpty()
        found = stages()
        return sum(found.apply(i).shuffleWriteBytes() for i in range(found.size()) if found.apply(i).stageId() > last)

    assert sent(4000) < 6 * sent(1000)


def test_pairs_within_hot_and_other_keys_of_many_kinds(spark, monkeypatch):
    monkeypatch.setattr(joins, "BLOCK_ROWS", 24)
    monkeypatch.setattr(joins, "TASK_ROWS", 90)
    made = [(k % 3, "abcdef"[k % 2 :], float(k * 7 % 50)) for k in range(400)] + [(9, "z", float(k)) for k in range(9)] + [(9, None, 1.0), (1, "abcdef", None), (7, "hot", float("nan"))]
    made += [(7, "hot", 5.0)] * 60 + [(7, "hot", -1.0), (7, "hot", float("inf"))]
    df = spark.createDataFrame(made, "k int, s string, v double")
    a, b = df.toDF("k", "s", "x"), df.toDF("k", "s", "y")
    want = a.join(b, ["k", "s"]).where("x < y").select("x", "y")
    assert rows(joins.pairs_within(df, ["k", "s"], "v").select(F.col("x").cast("string"), F.col("y").cast("string"))) == rows(want.select(F.col("x").cast("string"), F.col("y").cast("string")))
    assert rows(joins.pairs_within(df, ["k", "s"], "v", counted=True).selectExpr("string(x) AS x", "string(y) AS y", "n")) == rows(
        want.groupBy("x", "y").count().selectExpr("string(x) AS x", "string(y) AS y", "count AS n")
    )
    words = df.selectExpr("k", "concat(s, v) AS v")
    assert rows(joins.pairs_within(words, ["k"], "v")) == rows(words.toDF("k", "x").join(words.toDF("k", "y"), "k").where("x < y").select("x", "y"))


def test_near_points_of_one_crowded_cell_meet_in_several_tasks(spark, monkeypatch):
    monkeypatch.setattr(joins, "BLOCK_ROWS", 8)
    monkeypatch.setattr(joins, "TASK_PAIRS", 64)
    a = spark.range(60).selectExpr("id AS a", "id / 60.0D AS x", "0.5D AS y")
    b = spark.range(40).selectExpr("id AS b", "id / 40.0D AS u", "0.5D AS v").unionByName(spark.createDataFrame([(99, None, 0.5)], "b long, u double, v double"))
    found = joins.near_join(a, b, ("x", "y"), ("u", "v"), 0.7)
    want = [(i, j) for i in range(60) for j in range(40) if (i / 60 - j / 40) ** 2 <= 0.7 * 0.7]
    assert sorted((r.a, r.b) for r in found.collect()) == want
    assert found.groupBy(F.spark_partition_id()).count().count() > 4


def test_graph_match_passes_a_hub_in_several_tasks(spark, monkeypatch):
    monkeypatch.setattr(joins, "BLOCK_ROWS", 8)
    monkeypatch.setattr(joins, "TASK_PAIRS", 64)
    v = spark.range(0, 101).selectExpr("id", "CASE WHEN id = 0 THEN 'hub' WHEN id <= 40 THEN 'a' ELSE 'b' END AS label")
    e = spark.range(1, 101).selectExpr("id AS src", "0L AS dst")
    found = graph.match(v, e, [("->", None, "h", {"label": "hub"}), ("<-", None, "y", {"label": "b"})], ("x", {"label": "a"}))
    assert sorted((r.x_id, r.h_id, r.y_id) for r in found.collect()) == [(x, 0, y) for x in range(1, 41) for y in range(41, 101)]
    assert found.groupBy(F.spark_partition_id()).count().count() > 4


def test_no_sketch_is_kept_for_each_distinct_value(spark):
    plan = QUERIES["agg_approx_distinct"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    sketches_at = [line for line in plan.splitlines() if "approx_count_distinct" in line and "Aggregate" in line]
    assert sketches_at and not [line for line in sketches_at if "l_partkey" in line.split("functions=")[0]]


def test_knn_join_by_products_equals_pairs(spark, monkeypatch):
    monkeypatch.setattr(search, "CHUNK_DISTANCES", 64)
    monkeypatch.setattr(search, "TASK_PRODUCTS", 4000)
    made = [(k, [float(k * 7 % 11), float(k * 5 % 13) / 3, 1e-3 * (k % 4)]) for k in range(300)]
    odd = [(1000, None), (1001, [1.0]), (1002, [1.0, None, 2.0]), (1003, [float("nan"), 0.0, 0.0]), (1004, [1e200, 0.0, 0.0])]
    for data in (made, made + odd):
        e = spark.createDataFrame(data, "i long, v array<double>")
        q = e.where("i % 10 = 0")
        pairs = search._pairs(e, q.select(F.col("i").alias("_q"), F.col("v").alias("_v")), "i", "v", "l2")
        rank = F.row_number().over(search.Window.partitionBy("query").orderBy("_distance", "neighbour"))
        want = pairs.withColumn("rank", rank).where("rank <= 5")
        got = search.knn_join(q, e, "i", "v", "i", "v", 5)
        names = ("query", "neighbour", "rank")
        assert rows(got, *names) == rows(want, *names)
    plain = search.knn_join(spark.createDataFrame(made, "i long, v array<double>").where("i = 3"), spark.createDataFrame(made, "i long, v array<double>"), "i", "v", "i", "v", 5)
    assert "CartesianProduct" not in (text := plain._jdf.queryExecution().toString()) and "BroadcastNestedLoopJoin" not in text


def test_counted_pairs_are_grouped_in_partitions_by_their_number(spark, monkeypatch):
    monkeypatch.setattr(joins, "TASK_ROWS", 100)
    df = spark.range(600).selectExpr("id div 6 AS o", "id % 7 AS p").distinct()
    found = joins.pairs_within(df, ["o"], "p", counted=True)
    a, b = df.toDF("o", "x"), df.toDF("o", "y")
    assert rows(found, "x", "y", "n") == rows(a.join(b, "o").where("x < y").groupBy("x", "y").count().withColumnRenamed("count", "n"), "x", "y", "n")
    assert found.rdd.getNumPartitions() == 15


def test_salted_join_of_many_copies_is_spread_by_rows(spark, monkeypatch):
    large = spark.range(500).selectExpr("CASE WHEN id % 9 = 0 THEN NULL ELSE id % 40 END AS k", "id AS x")
    small = spark.range(60).selectExpr("CASE WHEN id = 59 THEN NULL ELSE id END AS k", "id AS y")
    for how in ("inner", "left", "left_semi", "left_anti", "right", "full"):
        want = rows(large.join(small, "k", how))
        monkeypatch.setattr(joins, "TASK_ROWS", 200)
        found = joins.salted_join(large, small, ["k"], how=how)
        assert rows(found, *large.join(small, "k", how).columns) == want
        assert found.rdd.getNumPartitions() >= 8
