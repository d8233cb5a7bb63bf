"""From sources to datasets, and what is asked of them."""

import io
import json
import struct
import zipfile

import numpy as np
import pytest

import geoloom
from geoloom import catalog, config
from geoloom.geo import mvt, wkb
from geoloom.serving import App, Cache
from geoloom.sources import geojson, read_source, source_kind


def collection(n=60):
    rng = np.random.default_rng(2)
    out = []
    for i in range(n):
        x, y = (float(v) for v in rng.uniform(-60, 60, 2))
        g = None if i % 20 == 7 else {"type": "Point", "coordinates": [x, y]} if i % 2 else wkb.to_geojson(wkb.box(x, y, x + 3, y + 2))
        out.append({"type": "Feature", "geometry": g, "properties": {"id": i, "name": f"é{i}" if i % 3 else None, "tags": {"b": 1, "a": [i]}, "note": '{"type":"Feature","geometry":null}', "mixed": i if i % 2 else i / 2}})
    return {"type": "FeatureCollection", "name": "t", "features": out}


@pytest.fixture(scope="module")
def source(tmp_path_factory):
    path = tmp_path_factory.mktemp("src") / "places.geojson"
    path.write_text(json.dumps(collection(), ensure_ascii=False))
    return str(path)


@pytest.fixture(scope="module")
def built(spark, source, tmp_path_factory):
    root = tmp_path_factory.mktemp("data")
    geoloom.add_dataset(source, root, name="places", spark=spark, partition_size=4000, zoom=3, grid_size=256)
    return root


@pytest.mark.parametrize("split", [50, 333, 1 << 20])
def test_geojson_by_any_ranges(spark, source, split):
    df, _ = geojson.read(spark, source, split)
    rows = sorted(df.collect(), key=lambda r: r["id"])
    assert [r["id"] for r in rows] == list(range(60))
    assert rows[1]["name"] == "é1" and rows[2]["tags"] == '{"a":[2],"b":1}' and rows[1]["mixed"] == 1.0 and rows[7]["geometry"] is None
    assert dict(df.dtypes)["mixed"] == "double"


def test_geojson_lines_types_behind_and_empty(spark, tmp_path):
    lines = [{"geometry": {"coordinates": [i, i], "type": "Point"}, "properties": {"inner": {"type": "Feature", "geometry": None}, "i": i}, "type": "Feature"} for i in range(9)]
    p = tmp_path / "x.geojsonl"
    p.write_text("\n".join(map(json.dumps, lines)))
    for split in (40, 10_000):
        assert sorted(r["i"] for r in geojson.read(spark, str(p), split)[0].collect()) == list(range(9))
    e = tmp_path / "e.geojson"
    e.write_text('{"type":"FeatureCollection","features":[]}')
    df, _ = geojson.read(spark, str(e))
    assert df.columns == ["geometry"] and df.count() == 0


def test_csv(spark, tmp_path):
    p = tmp_path / "p.tsv"
    p.write_text("id\tx\ty\n1\t2.5\t3\n2\tbad\t3\n3\t\t\n")
    rows = {r["id"]: r["geometry"] for r in read_source(spark, str(p), csv_x_col="x", csv_y_col="y").df.collect()}
    assert wkb.decode(rows[1])[1].tolist() == [[2.5, 3]] and rows[2] is None and rows[3] is None
    w = tmp_path / "w.csv"
    w.write_text('id,wkt\n1,"POLYGON((0 0,1 0,1 1,0 0))"\n2,nothing\n')
    assert [r["geometry"] is None for r in read_source(spark, str(w), csv_wkt_col="wkt").df.orderBy("id").collect()] == [False, True]
    for bad in ({}, {"csv_x_col": "x"}, {"csv_x_col": "x", "csv_y_col": "y", "csv_wkt_col": "w"}):
        with pytest.raises(ValueError, match="CSV needs"):
            read_source(spark, str(p), **bad)


def shapefile() -> dict[str, bytes]:
    ring = np.array([[0, 0], [0, 4], [4, 4], [4, 0], [0, 0]], "<f8")
    hole = np.array([[1, 1], [2, 1], [2, 2], [1, 2], [1, 1]], "<f8")
    content = struct.pack("<i4d2i2i", 5, 0, 0, 4, 4, 2, 10, 0, 5) + ring.tobytes() + hole.tobytes()
    records, shp, shx = [content, struct.pack("<i", 0)], b"", b""
    for i, c in enumerate(records):
        shx += struct.pack(">2i", (100 + len(shp)) // 2, len(c) // 2)
        shp += struct.pack(">2i", i + 1, len(c) // 2) + c
    head = lambda n: struct.pack(">7i", 9994, 0, 0, 0, 0, 0, (100 + n) // 2) + struct.pack("<2i8d", 1000, 5, *[0.0] * 8)
    columns = [(b"name", b"C", 6, 0), (b"n", b"N", 5, 0)]
    dbf = struct.pack("<4BI2H20x", 3, 0, 0, 0, 2, 32 + 64 + 1, 12) + b"".join(n.ljust(11, b"\0") + t + b"\0" * 4 + bytes([w, d]) + b"\0" * 14 for n, t, w, d in columns) + b"\r"
    dbf += b" alpha     7" + b" beta       "
    return {".shp": head(len(shp)) + shp, ".shx": head(len(shx)) + shx, ".dbf": dbf, ".prj": b'GEOGCS["GCS_WGS_1984"]'}


def test_shapefile_plain_and_zipped(spark, tmp_path):
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w") as z:
        for s, data in shapefile().items():
            (tmp_path / f"a{s}").write_bytes(data)
            z.writestr(f"a{s}", data)
    (tmp_path / "z.zip").write_bytes(packed.getvalue())
    for path in ("a.shp", "z.zip"):
        s = read_source(spark, str(tmp_path / path))
        rows = s.df.orderBy("name").collect()
        assert [(r["name"], r["n"]) for r in rows] == [("alpha", 7), ("beta", None)]
        kind, rings = wkb.decode(rows[0]["geometry"])
        assert kind == "Polygon" and len(rings) == 2 and rows[1]["geometry"] is None and s.crs == 4326


def test_kinds(tmp_path):
    (tmp_path / "a.csv").write_text("x")
    assert source_kind(str(tmp_path)) == "csv"
    (tmp_path / "b.geojson").write_text("{}")
    with pytest.raises(ValueError, match="one kind"):
        source_kind(str(tmp_path))
    with pytest.raises(ValueError, match="suffix"):
        source_kind(str(tmp_path / "a.txt"))


def test_build(built):
    root = built / "places"
    m = geoloom.get_dataset_metadata(root)
    assert m["missing"] == [] and m["parquet_tile_count"] > 1 and 0 in m["zoom_levels"]
    stats = {a["name"]: a["stats"] for a in json.loads((root / "stats" / "attributes.json").read_text())["attributes"]}
    assert stats["id"]["non_null_count"] == 60 and sum(stats["geometry"]["geom_types"].values()) == 57
    d = geoloom.Dataset(root)
    assert d.parquet_has_bbox and d.histogram_resolution == 256 and d.bbox == tuple(m["bbox"])
    layer = mvt.decode((root / "mvt" / "0" / "0" / "0.mvt").read_bytes())["layer0"]
    assert len(layer["features"]) == 57
    assert geoloom.estimate_range_count(root, (-180, -85, 180, 85)) == stats["geometry"]["total_points"]
    from geoloom.sources.geoparquet import file_schema

    one = next((root / "parquet_tiles").glob("*.parquet"))
    assert json.loads(file_schema(str(one)).metadata[b"geo"])["primary_column"] == "geometry"


def brute(box):
    q = wkb.box(*box)
    from geoloom.geo.kernels import intersects

    return sorted(f["properties"]["id"] for f in collection()["features"] if f["geometry"] and intersects(wkb.from_geojson(f["geometry"]), q))


def test_queries(spark, built):
    root, box = built / "places", (-30.0, -25.0, 22.0, 41.0)
    batches = list(geoloom.query_dataset(root, box, batch_size=5, spark=spark))
    assert sorted(i for b in batches for i in b["id"]) == brute(box) and max(map(len, batches)) == 5
    assert not any(c.startswith("_") for c in batches[0].columns)
    assert geoloom.query_dataset_count(root, wkb.to_geojson(wkb.box(*box)), spark=spark) == len(brute(box))
    assert geoloom.query_dataset_size(root, box, spark=spark) > 21 * len(brute(box))
    assert geoloom.get_sample_record(root, (170, 80, 171, 81), spark=spark) is None
    assert geoloom.get_sample_record(root, box, spark=spark)["id"] in brute(box)
    assert geoloom.get_dataset_summary(root)["geometry_attribute_count"] == 1


def test_archive_in_place_of_files(spark, built, tmp_path):
    import shutil

    root = tmp_path / "places"
    shutil.copytree(built / "places", root)
    want = {p.relative_to(root / "mvt").as_posix(): p.read_bytes() for p in (root / "mvt").glob("*/*/*.mvt")}
    geoloom.generate_mvt(str(root), spark=spark, zoom=3, pmtiles=True)
    from geoloom.sinks.pmtiles import Reader

    r = Reader(geoloom.Dataset(root).pmtiles_path)
    assert {f"{z}/{x}/{y}.mvt": r.tile(z, x, y) for z, x, y in r.tiles()} == want and not (root / "mvt").exists()
    info = {}
    assert geoloom.get_tile(root, 0, 0, 0, output=info) == want["0/0/0.mvt"] and info["source"] == "pmtiles"


def test_tiles_on_demand(built, tmp_path):
    root, info = built / "places", {}
    made = geoloom.get_tile(root, 5, 16, 15, output=info)
    assert info["source"] == "generated" and info["feature_count"] >= 0
    again = {}
    assert geoloom.get_tile(root, 5, 16, 15, output=again) == made and again["source"] == "memory"
    disk = {}
    geoloom.get_tile(root, 0, 0, 0, output=disk)
    assert disk["source"] == "disk"
    with pytest.raises(FileNotFoundError):
        geoloom.get_tile(root, 1, 5, 0)
    assert geoloom.generate_single_mvt_tile(root, (0, 0, 0)) == geoloom.get_tile(root, 0, 0, 0)


def test_metres(spark, tmp_path):
    from geoloom.functions.geometry import st_from_wkt

    rows = spark.createDataFrame([(i, f"POINT({(i + 0.5) * 1e5} {(i + 0.5) * 2e5})") for i in range(30)], "id int, wkt string")
    rows.select("id", st_from_wkt("wkt").alias("geom")).write.parquet(str(tmp_path / "m.parquet"))
    made = geoloom.tile(str(tmp_path / "m.parquet"), str(tmp_path / "m"), spark=spark, src_crs="EPSG:3857", grid_size=64)
    assert made.total_rows == 30 and geoloom.Dataset(tmp_path / "m").parquet_crs["id"]["code"] == 3857
    assert geoloom.query_dataset_count(tmp_path / "m", (-1e5, -1e5, 4.5e5, 1e6), geometry_crs=3857, spark=spark) == 5
    assert geoloom.query_dataset_count(tmp_path / "m", (-1, -1, 4.1, 20), spark=spark) == 5
    assert geoloom.generate_mvt(str(tmp_path / "m"), spark=spark, zoom=1).tile_count == 2


def ask(app, path, query="", body=None):
    status = []
    env = {"PATH_INFO": path, "QUERY_STRING": query, "REQUEST_METHOD": "POST" if body else "GET", "CONTENT_LENGTH": str(len(body or b"")), "wsgi.input": io.BytesIO(body or b"")}
    data = b"".join(app(env, lambda s, h: status.append((int(s[:3]), dict(h)))))
    return status[0][0], data, status[0][1]


def test_http(built):
    app, box = App(built), (-30.0, -25.0, 22.0, 41.0)
    mbr = "mbr=" + ",".join(map(str, box))
    assert json.loads(ask(app, "/api/datasets")[1]) == {"datasets": ["places"]}
    assert json.loads(ask(app, "/datasets.json", "q=PLA")[1])["datasets"][0]["name"] == "Places"
    assert ask(app, "/places/0/0/0.mvt")[0] == 200 and ask(app, "/none/0/0/0.mvt")[0] == 404
    got = json.loads(ask(app, "/datasets/places/features.geojson", mbr)[1])
    assert sorted(f["properties"]["id"] for f in got["features"]) == brute(box) and got["features"][0]["geometry"]
    body = json.dumps({"geometry": wkb.to_geojson(wkb.box(*box))}).encode()
    lines = ask(app, "/datasets/places/features.csv", "", body)[1].decode().splitlines()
    assert len(lines) == len(brute(box)) + 1 and lines[0].endswith("geometry_type,x,y")
    assert json.loads(ask(app, "/datasets/places/features/sample.json", mbr)[1])["id"] in brute(box)
    assert ask(app, "/datasets/places/features/sample.geojson", "mbr=170,80,171,81")[0] == 404
    assert ask(app, "/datasets/places/features/sample.json")[0] == 400
    assert ask(app, "/datasets/places/features.xml")[0] == 400 and ask(app, "/datasets/places/features.csv", "mbr=1,2")[0] == 400
    assert ask(app, "/api/datasets/places/stats")[0] == 200 and ask(app, "/datasets/places.html")[0] == 200 and ask(app, "/")[0] == 200
    assert json.loads(ask(app, "/datasets/places.json")[1])["bbox"]


def test_lifecycle(tmp_path):
    (tmp_path / "d" / "parquet_tiles").mkdir(parents=True)
    assert geoloom.list_datasets(tmp_path) == ["d"] and geoloom.list_datasets(tmp_path / "no") == []
    for bad in ("../d", "/d", "", "a/../../b"):
        with pytest.raises(ValueError, match="no name"):
            geoloom.delete_dataset(tmp_path, bad)
    assert geoloom.delete_dataset(tmp_path, "d") and not geoloom.delete_dataset(tmp_path, "d", missing_ok=True)
    with pytest.raises(FileNotFoundError):
        geoloom.delete_dataset(tmp_path, "d")


def test_async_handle():
    ok = geoloom.AsyncDatasetHandle(lambda: 5).start()
    assert ok.result(5) == 5 and ok.status == "succeeded" and not ok.cancel()
    bad = geoloom.AsyncDatasetHandle(lambda: 1 / 0).start()
    with pytest.raises(ZeroDivisionError):
        bad.result(5)
    assert bad.as_dict()["status"] == "failed"
    early = geoloom.AsyncDatasetHandle(lambda: 5)
    assert early.cancel() and early.status == "cancelled"


def test_config(tmp_path):
    assert [config.parse_size(v) for v in ("1kb", "1.5 MB", "7", 9, None)] == [1024, 1572864, 7, 9, None]
    (tmp_path / "pyproject.toml").write_text("[tool.geoloom.mvt]\nzoom = 9\n[tool.geoloom.global]\nlog_level = 'DEBUG'\n")
    assert config.resolve("mvt", "zoom", None, tmp_path) == 9 and config.resolve("build", "zoom", None, tmp_path) == 9
    assert config.resolve("mvt", "zoom", 3, tmp_path) == 3 and config.resolve("tile", "log_level", None, tmp_path) == "DEBUG"
    (tmp_path / "geoloom.toml").write_text("not toml [")
    assert config.resolve("mvt", "zoom", None, tmp_path) == 7


def test_cache():
    c = Cache(2)
    for k in "aba":
        c.put(k, k)
    c.get("b")
    c.put("c", "c")
    assert [c.get(k) for k in "abc"] == [None, "b", "c"]


def test_catalog(spark, built, tmp_path):
    assert catalog.build_catalog(built, tmp_path / "cat") == 1
    best = catalog.search(catalog.catalog_frame(spark, tmp_path / "cat"), "places with names", 3)
    assert best[0].dataset == "places" and best[0].score > 0 and "Geometry geometry" in best[0].descriptor_text


def test_cli_info(built, capsys):
    from geoloom.cli import main

    assert main(["info", "--dir", str(built / "places")]) == 0
    assert json.loads(capsys.readouterr().out)["name"] == "places"


def test_geodatabase_says_so(spark, tmp_path):
    (tmp_path / "x.gdb").mkdir()
    with pytest.raises(NotImplementedError):
        read_source(spark, str(tmp_path / "x.gdb"))


def test_reserved_column(spark, tmp_path):
    spark.createDataFrame([(1, b"x")], "_tile_id int, geometry binary").write.parquet(str(tmp_path / "a.parquet"))
    with pytest.raises(ValueError, match="reserved"):
        geoloom.tile(str(tmp_path / "a.parquet"), str(tmp_path / "o"), spark=spark)
