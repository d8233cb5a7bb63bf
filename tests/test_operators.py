"""Partitioning, histograms, statistics and the pyramid against brute force."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from geoloom.functions.geometry import st_from_wkt, with_summary
from geoloom.geo import mercator, wkb
from geoloom.operators import histogram, partition, predicates, pyramid, similarity, stats

BOX = (0.0, 0.0, 100.0, 100.0)


@settings(max_examples=25, deadline=None)
@given(st.integers(0, 10_000), st.integers(2, 300), st.integers(1, 12))
def test_tree_covers_and_balances(seed, n, parts):
    p = np.random.default_rng(seed).uniform(0, 100, (n, 2))
    tree = partition.build_tree(p, BOX, parts)
    got = tree.search(p)
    assert got.min() >= 0 and got.max() < tree.partitions
    assert np.bincount(got).max() <= max(-(-n // parts), 1)
    for point, part in zip(p, got):
        b = tree.boxes(BOX)[part]
        assert b[0] <= point[0] <= b[2] and b[1] <= point[1] <= b[3]


def test_tree_of_equal_points_and_of_none():
    assert partition.build_tree(np.zeros((50, 2)), BOX, 8).partitions == 1
    assert partition.build_tree(np.zeros((0, 2)), BOX, 4).partitions >= 4


def test_tree_column_is_search(spark):
    p = np.random.default_rng(3).uniform(0, 100, (500, 2))
    df = spark.createDataFrame([(float(x), float(y)) for x, y in p], "x double, y double")
    for parts in (7, 400):
        tree = partition.build_tree(p, BOX, parts)
        got = [r[0] for r in df.select(tree.column(F.col("x"), F.col("y"))).collect()]
        assert got == tree.search(p).tolist()


def test_point_weights():
    h = np.array([[10, 0], [0, 7]])
    w = partition.point_weights(np.array([[1.0, 1], [2, 2], [90, 90]]), h, BOX)
    assert w.tolist() == [5, 5, 7]


@settings(max_examples=25, deadline=None)
@given(st.integers(0, 9999), st.integers(0, 4))
def test_prefix_sums(seed, z):
    grid = np.random.default_rng(seed).integers(0, 5, (16, 16)).astype(float)
    prefix = histogram.prefix_sum(grid)
    s = 16 >> z
    for y in range(1 << z):
        for x in range(1 << z):
            assert histogram.tile_value(prefix, z, x, y) == grid[y * s : (y + 1) * s, x * s : (x + 1) * s].sum()
    assert histogram.tile_value(prefix, 6, 13, 22) == grid[5, 3] / 16
    for t in (0, 3, 40):
        levels = [k for k in range(5) if any(histogram.tile_value(prefix, k, x, y) > t for x in range(1 << k) for y in range(1 << k))]
        want = max(levels, default=-1)
        got = histogram.deepest_level(prefix, t)
        assert got == want or (want == 4 and got > 4)


def test_estimate():
    prefix = histogram.prefix_sum(np.ones((8, 8)))
    assert histogram.estimate(prefix, (-180, -85, 180, 85)) == 64
    assert histogram.estimate(prefix, (1, 1, 2, 2)) == 1
    assert histogram.estimate(prefix, (3e7, 0, 4e7, 1), 3857) == 0


def mixed(spark):
    rows = [(1, "POINT(10 10)"), (2, "LINESTRING(-20 -20,30 30)"), (3, "POLYGON((-100 -60,100 -60,100 60,-100 60,-100 -60))"), (4, None), (5, "POINT EMPTY"), (6, "no shape"), (7, "MULTIPOINT(5 5,6 6)"), (7, "MULTIPOINT(5 5,6 6)")]
    return with_summary(spark.createDataFrame(rows, "id int, wkt string").withColumn("geometry", st_from_wkt("wkt")))


def test_summary_of_null_empty_and_bad(spark):
    got = {r["id"]: r for r in mixed(spark).collect()}
    assert [got[i]["_cx"] for i in (4, 5, 6)] == [None] * 3
    assert got[3]["_gtype"] == "Polygon" and got[3]["_npts"] == 5 and got[1]["_bbox_xmax"] == 10


def test_range_filter(spark):
    got = sorted(r["id"] for r in predicates.range_filter(mixed(spark), (4, 4, 7, 7)).collect())
    assert got == [2, 3, 7, 7]
    ring = {"type": "Polygon", "coordinates": [[[8, 9], [12, 9], [12, 12], [8, 9]]]}
    assert sorted(r["id"] for r in predicates.range_filter(mixed(spark), ring).collect()) == [1, 2, 3]
    assert predicates.range_filter(mixed(spark), ("Polygon", [])).count() == 0


def test_box_filter_reaches_the_scan(spark, tmp_path):
    mixed(spark).write.parquet(str(tmp_path / "t"))
    plan = predicates.range_filter(spark.read.parquet(str(tmp_path / "t")), (4, 4, 7, 7))._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(_bbox_xmax)" in plan


@pytest.mark.parametrize("buffer", [0.0, 0.0625])
def test_descent_is_fan_out_and_filter(spark, buffer):
    rng = np.random.default_rng(5)
    rows = [(i, int(rng.integers(1 << 32)), *(float(v) for v in (x, y, x + w, y + h))) for i, (x, y, w, h) in enumerate(zip(rng.uniform(-170, 100, 80), rng.uniform(-80, 40, 80), rng.exponential(8, 80), rng.exponential(8, 80)))]
    df = spark.createDataFrame(rows, "_fid long, _prio long, _bbox_xmin double, _bbox_ymin double, _bbox_xmax double, _bbox_ymax double")
    grid = rng.integers(0, 3, (16, 16)) * (rng.random((16, 16)) < 0.4)
    prefix = histogram.prefix_sum(grid.astype(float))
    for threshold in (0, 1):
        all_ = pyramid.fan_out(df, range(7), None, buffer, ["_fid", "_prio"]).collect()
        want = sorted((r["_fid"], r["z"], r["x"], r["y"]) for r in all_ if histogram.tile_value(prefix, r["z"], r["x"], r["y"]) > threshold)
        got = sorted((r["_fid"], r["z"], r["x"], r["y"]) for r in pyramid.descended(df, range(7), None, buffer, prefix, threshold).collect())
        assert got == want and got
        ids = {r["tile_id"] == mercator.encode_tile(r["z"], r["x"], r["y"]) for r in pyramid.descended(df, range(7), None, buffer, prefix, threshold).collect()}
        assert ids == {True}


def test_smallest_box_by_broadcast_and_by_grid(spark, monkeypatch):
    rng = np.random.default_rng(1)
    rows = spark.createDataFrame([(i, float(x), float(y), float(x + 2), float(y + 2)) for i, (x, y) in enumerate(rng.uniform(0, 50, (60, 2)))], "id int, _bbox_xmin double, _bbox_ymin double, _bbox_xmax double, _bbox_ymax double")
    index = spark.createDataFrame([(i, float(x), float(y), float(x + i % 5 + 3), float(y + 4)) for i, (x, y) in enumerate(rng.uniform(0, 50, (40, 2)))], "tile_id int, minx double, miny double, maxx double, maxy double")
    one = sorted(map(tuple, predicates.smallest_box(rows, "id", index).select("id", "tile_id").collect()))
    import inspect

    source = inspect.getsource(predicates.smallest_box).replace("50_001", "1").replace("50_000", "0")
    space = dict(vars(predicates))
    exec(source, space)  # noqa: S102  the same function with a lower bound
    two = sorted(map(tuple, space["smallest_box"](rows, "id", index).select("id", "tile_id").collect()))
    assert one == two and one


def test_statistics(spark):
    df = spark.createDataFrame([(1, 1.0, "a", None), (2, float("nan"), "bb", None), (3, 3.0, "a", None), (None, None, None, None)], "i int, d double, s string, v array<int>")
    got = {a["name"]: a["stats"] for a in stats.attribute_statistics(df, None)["attributes"]}
    assert got["d"]["non_null_count"] == 2 and got["d"]["mean"] == 2 and got["d"]["stddev"] == 1
    assert got["s"]["max_length"] == 2 and got["s"]["top_k"] == [{"value": "a", "count": 2}, {"value": "bb", "count": 1}]
    assert got["v"] == {"non_null_count": 0, "approx_distinct": 0, "top_k": []}
    empty = {a["name"]: a["stats"] for a in stats.attribute_statistics(df.limit(0), None)["attributes"]}
    assert empty["i"]["min"] is None and empty["i"]["stddev"] == 0


def test_top_values_need_their_share(spark):
    df = spark.range(100).select(F.col("id").cast("string").alias("s"))
    assert stats.top_values(df, ["s"]) == {}


def test_top_features_order_and_ties(spark):
    rows = spark.createDataFrame([(1, i, 7 if i < 4 else i) for i in range(8)], "tile_id long, _fid long, _prio long")
    got = [(r["_fid"], r["_rank"]) for r in pyramid.top_features(rows, 4).orderBy("_rank").collect()]
    assert got == [(0, 1), (1, 2), (2, 3), (3, 4)]
    assert "WindowGroupLimit" in pyramid.top_features(rows.repartition(3), 4)._jdf.queryExecution().toString()


def test_cosine(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 2.0]), (3, None), (4, [0.0, 0.0]), (5, [3.0, 0.0]), (6, [1.0])], "id int, embedding array<double>")
    assert [r["id"] for r in similarity.cosine_top_k(v, [2.0, 0.0], 3, "id").collect()] == [1, 5, 2]


def test_vertices_outside_the_world_count_in_edge_cells(spark):
    df = spark.createDataFrame([(bytes(wkb.encode(("Point", np.array([[0.0, 89.0]])))),), (None,), (b"bad",)], "geometry binary")
    assert [tuple(r) for r in histogram.vertex_cells(df, 8).collect()] == [(0, 4, 1)]
