"""What showed on larger tables: tiles with more features than a default tile holds, pixels at their edges, and steps whose memory followed the table."""

import json
import struct

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from geoloom.functions import geometry
from geoloom.functions.geometry import st_as_geojson, st_point, with_summary
from geoloom.geo import mercator as M
from geoloom.geo import mvt, wkb
from geoloom.plans import tiles as plans
from geoloom.sinks import features, geoparquet
from geoloom.sources import geojson


def test_layer_of_points_at_once_has_the_same_bytes():
    rng = np.random.default_rng(4)
    xy = rng.uniform(-3000, 9000, (500, 2))
    columns = {"id": list(range(-3, 497)), "name": [None if i % 3 else f"é{i % 5}" for i in range(500)], "same": [i % 4 for i in range(500)], "x": [0.0 if i % 2 else i / 4 for i in range(500)], "ok": [bool(i % 2) for i in range(500)], "none": [None] * 500}
    one, many = mvt.Layer(), mvt.Layer()
    for i, v in enumerate(xy):
        one.add(("Point", v[None]), {k: c[i] for k, c in columns.items()})
    kinds = {"name": pa.string(), "none": pa.string()}
    for lo in range(0, 500, 130):
        many.add_points(xy[lo : lo + 130], [(k, pa.array(c[lo : lo + 130], kinds.get(k))) for k, c in columns.items()])
    assert many.bytes() == one.bytes()
    assert mvt.count_features(one.bytes()) == 500 == len(mvt.decode(one.bytes())["layer0"]["features"])


def test_values_beyond_those_that_are_known(monkeypatch):
    monkeypatch.setattr(mvt, "KNOWN", 10)
    layer = mvt.Layer()
    layer.add_points(np.zeros((300, 2)), [("id", pa.array(range(300))), ("kind", pa.array(["a", "b", "c"] * 100))])
    assert [(f["properties"]["id"], f["properties"]["kind"]) for f in mvt.decode(layer.bytes())["layer0"]["features"]] == [(i, "abc"[i % 3]) for i in range(300)]


def test_tile_without_capacity_holds_all_features(spark):
    n = plans.CAPACITY + 500
    rows = spark.range(n).select("id", st_point(F.col("id") % 170 - 85, F.col("id") % 80 - 40).alias("geometry"))
    tiles = {c: plans.vector_tiles(with_summary(rows), range(1), capacity=c).first() for c in (None, 0, plans.CAPACITY)}
    got = {c: mvt.decode(t["mvt"])["layer0"]["features"] for c, t in tiles.items()}
    assert sorted(f["properties"]["id"] for f in got[None]) == list(range(n)) and got[0] == got[None]
    assert got[plans.CAPACITY] == got[None][: plans.CAPACITY]


def test_pixels_are_shares_of_the_world():
    lon, lat = (np.arange(-179_000, 179_000, 7) / 1e3, np.resize(np.arange(-84_000, 84_000, 11) / 1e3, 51_143))
    v = M.forward(np.column_stack([lon, lat]))
    share = (v + M.WORLD) / (2 * M.WORLD) * 64
    tile = np.floor(share).astype(int)
    for i in range(0, len(v), 97):
        x, y = tile[i]
        assert np.array_equal(M.tile_pixels(v[i : i + 1], 6, x, 63 - y, 4096)[0], (share[i] - tile[i]) * 4096)


def test_pixel_on_the_edge_of_a_tile():
    """A point that the tile arithmetic puts in a column has its pixel there, as in SQL; a corner in metres, rounded, put it beyond."""
    for lon, x, px in ((61.875, 42, 4096), (16.875, 35, 0), (-129.375, 8, 4095), (61.875, 43, 0)):
        share = (lon * M.WORLD / 180 + M.WORLD) / (2 * M.WORLD) * 64
        p = M.tile_pixels(M.forward(np.array([[lon, 0.0]])), 6, x, 31, 4096)[0, 0]
        assert np.floor(p) == px and p == (share - x) * 4096


def test_all_points():
    p = wkb.point_wkb(np.array([1.0, 2.0, 3.0]), np.array([4.0, 5.0, 6.0]))
    assert wkb.all_points(pa.array(p, pa.binary()).slice(1)).tolist() == [[2, 5], [3, 6]]
    for bad in ([*p, None], [*p, b"x" * 21], [*p, p[0][:20]], [], [wkb.encode(("Point", np.zeros((0, 2))))]):
        assert wkb.all_points(pa.array(bad, pa.binary())) is None


@pytest.mark.parametrize("sort", ["zorder", "columns", "none"])
def test_a_tile_is_sorted_in_pieces(spark, tmp_path, monkeypatch, sort):
    """A window and a sort of one task held all rows of a tile."""
    rows = with_summary(spark.range(900).select("id", (F.col("id") % 7).alias("k"), st_point(F.col("id") * 37 % 100 - 50, F.col("id") * 11 % 60).alias("geometry"))).withColumn("_tile_id", (F.col("id") % 3).cast("int"))
    got = {}
    for pieces in (1 << 40, 5_000):
        monkeypatch.setattr(geoparquet, "PIECE_BYTES", pieces)
        made = geoparquet.write_tiles(rows, str(tmp_path / f"{pieces}"), sort=sort, sort_keys=["-k", "id"], row_group=128)
        files = sorted((tmp_path / f"{pieces}" / "parquet_tiles").glob("*.parquet"))
        got[pieces] = ([(r["part"], r["name"], r["n_rows"]) for r in made.orderBy("part").collect()], [pq.read_table(f).to_pylist() for f in files])
        assert max(pq.ParquetFile(files[0]).metadata.row_group(i).num_rows for i in range(3)) <= 128
    (a, x), (b, y) = got.values()
    assert a == b and len(a) == 3
    if sort == "columns":
        assert x == y and [(-r["k"], r["id"]) for r in x[0]] == sorted((-r["k"], r["id"]) for r in x[0])
    else:
        assert [sorted(r["id"] for r in t) for t in x] == [sorted(r["id"] for r in t) for t in y]
    if sort == "zorder":
        assert [[r["geometry"] for r in t] for t in x] == [[r["geometry"] for r in t] for t in y]
        text = geoparquet.with_zorder(rows)._jdf.queryExecution().toString()
        assert "Window" not in text


def test_arcs_together_are_arcs_one_by_one():
    rng = np.random.default_rng(6)
    control = rng.uniform(-9, 9, (200, 3, 2))
    control[5, 2] = control[5, 0]
    control[6] = [[0, 0], [1, 1], [2, 2]]
    data = [struct.pack("<BII", 1, 8, 3) + c.tobytes() for c in control] + [None, wkb.encode(wkb.box(0, 0, 1, 1)), struct.pack("<BII4d", 1, 2, 2, 0, 0, 1, 1)]
    for one, many in zip(map(wkb.linearize, data), wkb.linearized(data)):
        if one is None:
            assert many is None
            continue
        (k, p), (m, q) = wkb.decode(one), wkb.decode(many)
        assert k == m and (np.allclose(p, q, rtol=0, atol=1e-6 * max(1, np.abs(p).max())) if k == "LineString" else one == many)


def test_geojson_of_points_is_that_of_the_codec(spark):
    rows = spark.createDataFrame([(1.5, -2.0), (1e-7, 1e22), (0.1, 33.0)], "x double, y double").select(st_point("x", "y").alias("g"))
    for g, text in rows.select("g", st_as_geojson("g")).collect():
        assert text == json.dumps(wkb.to_geojson(wkb.decode(g)))


def test_functions_are_spread_over_tasks(spark, monkeypatch):
    """A table in one small file was one task, whatever its rows."""
    monkeypatch.setattr(geometry, "SPREAD", 100)
    df = spark.range(0, 1000, 1, 1)
    assert geometry.spread(df, "id").rdd.getNumPartitions() == 10 and geometry.spread(df.limit(50), "id").rdd.getNumPartitions() == 1
    assert sorted(r[0] for r in geometry.spread(df, "id").collect()) == list(range(1000))


def test_small_ranges_read_little_more_than_themselves(tmp_path, monkeypatch):
    """A range of 4,000 bytes read a megabyte behind it."""
    p = tmp_path / "a.geojson"
    p.write_text(json.dumps({"type": "FeatureCollection", "features": [{"type": "Feature", "geometry": {"type": "Point", "coordinates": [i, 1]}, "properties": {"id": i, "text": "x" * (9_000 if i == 700 else 20)}} for i in range(4_000)]}))
    size, read, real = p.stat().st_size, [], geojson.read_bytes
    monkeypatch.setattr(geojson, "read_bytes", lambda path, at, n: read.append(n) or real(path, at, n))
    found = [json.loads(f)["properties"]["id"] for at in range(0, size, 4000) for f in geojson.features(str(p), at, 4000, size)]
    assert found == list(range(4_000)) and sum(read) < 4 * size


def test_many_small_ranges_are_few_tasks(spark, tmp_path):
    p = tmp_path / "a.geojson"
    p.write_text(" " * 2_000_000)
    assert geojson._ranges(spark, str(p), 1000).rdd.getNumPartitions() == 64


def test_geojson_stream_holds_no_partition(spark, monkeypatch):
    df = spark.createDataFrame([(i, f"a\n\u2028{i}", float(i), 2.0) for i in range(50)], "id int, t string, x double, y double").repartition(4).select("id", "t", st_point("x", "y").alias("geometry"))
    monkeypatch.setattr(type(df), "toLocalIterator", lambda *args: pytest.fail("rows come to the driver"))
    found = json.loads("".join(features.geojson_stream(df)))["features"]
    assert sorted((f["properties"]["id"], f["properties"]["t"], f["geometry"]["coordinates"][0]) for f in found) == [(i, f"a\n\u2028{i}", float(i)) for i in range(50)]
    assert json.loads("".join(features.geojson_stream(df.filter("id < 0"))))["features"] == []


def test_a_source_is_parsed_once_for_its_types_and_once_for_its_rows(spark, tmp_path, monkeypatch):
    """Places, tiles, statistics and the histogram each parsed it anew."""
    p = tmp_path / "a.geojson"
    p.write_text(json.dumps({"type": "FeatureCollection", "features": [{"type": "Feature", "geometry": {"type": "Point", "coordinates": [i, 1]}, "properties": {"id": i}} for i in range(40)]}))
    parsed = spark.sparkContext.accumulator(0)
    real = geojson._each

    def counted(batches):
        parsed.add(1)
        return real(batches)

    monkeypatch.setattr(geojson, "_each", counted)
    df, _ = geojson.read(spark, str(p))
    df.count()
    from geoloom.plans import build

    before = parsed.value
    build.tile(spark, str(p), str(tmp_path / "out"), grid_size=16, partitions=2)
    assert before and parsed.value == 2 * before
