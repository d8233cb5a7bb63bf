"""Codecs and kernels, by laws and by hand."""

import math
import struct

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from geoloom.geo import kernels, mercator, mvt, wkb
from geoloom.sinks import pmtiles

numbers = st.floats(-180, 180, allow_nan=False)
points = st.lists(st.tuples(numbers, numbers), min_size=1, max_size=8).map(lambda v: np.array(v))
simple = st.one_of(points.map(lambda v: ("Point", v[:1])), points.map(lambda v: ("LineString", v)), points.map(lambda v: ("Polygon", [np.vstack([v, v[:1]])])))
shapes = st.one_of(simple, st.lists(simple, max_size=4).map(lambda g: ("GeometryCollection", g)))


def same(a, b) -> bool:
    return wkb.to_geojson(a) == wkb.to_geojson(b)


@settings(max_examples=60, deadline=None)
@given(shapes)
def test_codecs_give_back_what_they_got(g):
    assert same(wkb.decode(wkb.encode(g)), g)
    assert same(wkb.from_geojson(wkb.to_geojson(g)), g)


def test_wkb_dialects():
    be = struct.pack(">BI2d", 0, 1, 1.5, 2.5)
    ewkb = struct.pack("<BII3d", 1, 0x80000001 | 0x20000000, 4326, 1.5, 2.5, 9.0)
    iso = struct.pack("<BI4d", 1, 3001, 1.5, 2.5, 9.0, 8.0)
    assert all(wkb.decode(b)[1].tolist() == [[1.5, 2.5]] for b in (be, ewkb, iso))
    assert wkb.is_empty(wkb.decode(struct.pack("<BI2d", 1, 1, math.nan, math.nan)))
    for bad in (b"", b"\x01", struct.pack("<BI", 1, 99), struct.pack("<BII", 1, 2, 1000)):
        with pytest.raises(wkb.GeometryError):
            wkb.decode(bad)


def test_arcs_become_segments():
    arc = struct.pack("<BII6d", 1, 8, 3, 0, 0, 1, 1, 2, 0)
    assert wkb.is_nonlinear(arc)
    kind, v = wkb.decode(wkb.linearize(arc))
    assert kind == "LineString" and len(v) == 17
    assert np.allclose(np.hypot(v[:, 0] - 1, v[:, 1]), 1)
    straight = struct.pack("<BII6d", 1, 8, 3, 0, 0, 1, 0, 2, 0)
    assert wkb.decode(straight)[1].tolist() == [[0, 0], [1, 0], [2, 0]]


@pytest.mark.parametrize(("text", "kind"), [("POINT(1 2)", "Point"), ("LINESTRING Z (0 0 1, 1 1 2)", "LineString"), ("POLYGON((0 0,1 0,1 1,0 0),(.1 .1,.2 .1,.2 .2,.1 .1))", "Polygon"), ("MULTIPOINT((1 2),(3 4))", "MultiPoint"), ("MULTIPOINT(1 2,3 4)", "MultiPoint"), ("MULTIPOLYGON(((0 0,1 0,1 1,0 0)))", "MultiPolygon"), ("GEOMETRYCOLLECTION(POINT(1 2),LINESTRING(0 0,1 1))", "GeometryCollection"), ("POINT EMPTY", "Point")])
def test_wkt(text, kind):
    assert wkb.from_wkt(text)[0] == kind


def test_wkt_errors():
    for bad in ("", "POINT", "POINT(1)", "CIRCLE(1 2)", "POINT(1 2) x"):
        with pytest.raises(wkb.GeometryError):
            wkb.from_wkt(bad)


def test_centroid_and_bounds():
    ring = wkb.from_wkt("POLYGON((0 0,4 0,4 4,0 4,0 0),(1 1,1 3,3 3,3 1,1 1))")
    assert wkb.centroid(ring) == (2, 2) and wkb.bounds(ring) == (0, 0, 4, 4)
    assert wkb.centroid(wkb.from_wkt("LINESTRING(0 0,2 0,2 0)")) == (1, 0)


@settings(max_examples=80, deadline=None)
@given(st.integers(-6, 6), st.integers(-6, 6), st.integers(1, 5), st.integers(1, 5), st.integers(-6, 6), st.integers(-6, 6), st.integers(1, 5), st.integers(1, 5))
def test_boxes_intersect_as_their_bounds(a, b, c, d, e, f, g, h):
    p, q = (a, b, a + c, b + d), (e, f, e + g, f + h)
    assert kernels.intersects(wkb.box(*p), wkb.box(*q)) == kernels.boxes_meet(p, q)


def test_intersection_cases():
    hole = wkb.from_wkt("POLYGON((0 0,9 0,9 9,0 9,0 0),(2 2,7 2,7 7,2 7,2 2))")
    for text, want in (("POINT(1 1)", True), ("POINT(4 4)", False), ("POINT(2 4)", True), ("LINESTRING(3 3,6 6)", False), ("LINESTRING(3 3,8 8)", True), ("POLYGON((3 3,6 3,6 6,3 6,3 3))", False), ("POLYGON((-1 -1,10 -1,10 10,-1 10,-1 -1))", True), ("GEOMETRYCOLLECTION(POINT(4 4),POINT(8 8))", True)):
        assert kernels.intersects(wkb.from_wkt(text), hole) is want, text
        assert kernels.intersects(hole, wkb.from_wkt(text)) is want, text


def test_simplify_and_clip():
    line = np.array([[0, 0], [1, 0.1], [2, 0], [3, 5], [4, 0]], float)
    assert kernels.douglas_peucker(line, 1).tolist() == [[0, 0], [2, 0], [3, 5], [4, 0]]
    assert kernels.clip(wkb.box(-5, -5, 5, 5), 0, 10)[1][0].max() == 5
    assert kernels.clip(wkb.box(20, 20, 30, 30), 0, 10) is None
    assert kernels.clip(("LineString", np.array([[-5.0, 5], [5, 5], [5, 50], [8, 50], [8, 5]])), 0, 10)[0] == "MultiLineString"


@settings(max_examples=50, deadline=None)
@given(st.integers(0, 29), st.data())
def test_tile_ids(z, data):
    x, y = (data.draw(st.integers(0, (1 << z) - 1)) for _ in range(2))
    assert mercator.decode_tile(mercator.encode_tile(z, x, y)) == (z, x, y)
    assert pmtiles.number_tile(pmtiles.tile_number(z, x, y)) == (z, x, y)


def test_projection():
    v = np.array([[0.0, 0.0], [180, 85.05112877980659], [-180, -85.05112877980659]])
    assert np.allclose(mercator.backward(mercator.forward(v)), v)
    assert np.allclose(np.abs(mercator.forward(v)[1:]), mercator.WORLD)
    with pytest.raises(mercator.UnsupportedCrsError):
        mercator.epsg("EPSG:2056")


def test_vector_tile_round_trip():
    g = [(("Point", np.array([[10.0, 20]])), {"a": 1, "b": "x", "c": None, "d": True, "e": -2, "f": 1.5}), (wkb.box(0, 0, 100, 50), {"a": 1}), (("LineString", np.array([[0.0, 0], [5, 5]])), {})]
    layer = mvt.decode(mvt.encode(g))["layer0"]
    assert layer["extent"] == 4096
    assert [f["type"] for f in layer["features"]] == ["Point", "Polygon", "LineString"]
    assert layer["features"][0]["properties"] == {"a": 1, "b": "x", "d": True, "e": -2, "f": 1.5}
    assert layer["features"][0]["parts"] == [[(10, 4076)]]
    ring = layer["features"][1]["parts"][0]
    assert sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, ring[1:])) > 0


@pytest.mark.parametrize("codec", ["gzip", "zstd", "none"])
def test_archive_round_trip(tmp_path, codec):
    tiles = {(z, x, y): bytes([z, x % 251, y % 251]) * 3 for z in range(7) for x in range(1 << z) for y in range(1 << z)}
    order = sorted(tiles, key=lambda t: pmtiles.tile_number(*t))
    assert pmtiles.write(tmp_path / "a.pmtiles", ((*t, tiles[t]) for t in order), codec) == len(tiles)
    reader = pmtiles.Reader(tmp_path / "a.pmtiles")
    assert all(reader.tile(*t) == tiles[t] for t in order[::7]) and set(reader.tiles()) == set(tiles)
    assert reader.tile(9, 1, 1) is None
    with pytest.raises(ValueError, match="no tiles"):
        pmtiles.write(tmp_path / "b.pmtiles", iter([]))
