"""Shapefiles: .shp with its .dbf, plain or zipped, by ranges of records."""

from __future__ import annotations

import struct
import zipfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from geoloom.geo import wkb
from geoloom.geo.mercator import DEGREES, METRES, UnsupportedCrsError
from geoloom.sources.files import exists, file_system, files, read_bytes

RECORDS = 65_536


class _Zip:
    def __init__(self, path: str) -> None:
        # Opened in place: a range of a stored member is read alone, of a deflated one what comes before it is inflated and let go.
        fs, p = file_system(path)
        self.zip = zipfile.ZipFile(fs.open_input_file(p))
        self.names = {n.lower(): n for n in self.zip.namelist()}

    def layers(self) -> list[str]:
        return sorted(n[:-4] for k, n in self.names.items() if k.endswith(".shp"))

    def get(self, layer: str, suffix: str, offset: int = 0, length: int | None = None) -> bytes | None:
        name = self.names.get((layer + suffix).lower())
        if name is None:
            return None
        with self.zip.open(name) as f:
            f.seek(offset)
            return f.read() if length is None else f.read(length)


class _Folder:
    def get(self, layer: str, suffix: str, offset: int = 0, length: int | None = None) -> bytes | None:
        for s in (suffix, suffix.upper()):
            if exists(layer + s):
                return read_bytes(layer + s, offset, length)
        return None


def _store(path: str):
    return _Zip(path) if path.lower().endswith(".zip") else _Folder()


def _layers(path: str) -> list[tuple[str, str]]:
    """(container, layer without suffix) of all layers of a source."""
    if path.lower().endswith(".zip"):
        return [(path, n) for n in _Zip(path).layers()]
    return [(p[:-4], p[:-4]) for p, _ in files(path) if p.lower().endswith(".shp")]


def _rings(parts: list[np.ndarray]) -> wkb.Geometry:
    """Polygons of rings: clockwise ones are outer, the others holes of the outer ring they lie in."""
    from geoloom.geo.kernels import inside

    area = lambda r: float(np.sum((r[1:, 0] - r[:-1, 0]) * (r[1:, 1] + r[:-1, 1])))
    outer = [[r] for r in parts if area(r) >= 0]
    for hole in (r for r in parts if area(r) < 0):
        home = next((p for p in outer if inside(hole[:1], [p[0]])[0]), None)
        if home is None:
            outer.append([hole])
        else:
            home.append(hole)
    return ("Polygon", outer[0]) if len(outer) == 1 else ("MultiPolygon", [("Polygon", p) for p in outer])


def shape(record: bytes) -> bytes | None:
    """WKB of a record's content; Z and M are dropped."""
    kind = struct.unpack_from("<i", record)[0] % 10
    if kind == 1:
        return wkb.encode(("Point", np.frombuffer(record, "<f8", 2, 4).reshape(1, 2)))
    if kind == 8:
        n = struct.unpack_from("<i", record, 36)[0]
        return wkb.encode(("MultiPoint", [("Point", p[None]) for p in np.frombuffer(record, "<f8", 2 * n, 40).reshape(n, 2)]))
    if kind in (3, 5):
        n_parts, n = struct.unpack_from("<2i", record, 36)
        cut = [*struct.unpack_from(f"<{n_parts}i", record, 44), n]
        v = np.frombuffer(record, "<f8", 2 * n, 44 + 4 * n_parts).reshape(n, 2)
        parts = [v[a:b] for a, b in zip(cut, cut[1:]) if b > a]
        if not parts:
            return None
        if kind == 5:
            return wkb.encode(_rings(parts))
        return wkb.encode(("LineString", parts[0]) if len(parts) == 1 else ("MultiLineString", [("LineString", p) for p in parts]))
    return None


def fields(dbf: bytes) -> tuple[int, int, list[tuple[str, str, int, int]]]:
    """Header length, record length and (name, type, width, decimals) of the columns."""
    head, size = struct.unpack_from("<2H", dbf, 8)
    out, at = [], 32
    while at + 32 <= head and dbf[at] != 0x0D:
        out.append((dbf[at : at + 11].split(b"\0")[0].decode("latin-1"), chr(dbf[at + 11]), dbf[at + 16], dbf[at + 17]))
        at += 32
    return head, size, out


def _spark_type(kind: str, decimals: int, width: int) -> T.DataType:
    if kind in "NF":
        return T.LongType() if kind == "N" and not decimals and width < 19 else T.DoubleType()
    return T.BooleanType() if kind == "L" else T.StringType()


def _cell(raw: bytes, kind: T.DataType, encoding: str):
    text = raw.decode(encoding, "replace").strip(" \0")
    try:
        if isinstance(kind, T.LongType):
            return int(text) if text else None
        if isinstance(kind, T.DoubleType):
            return float(text) if text else None
    except ValueError:
        return None
    if isinstance(kind, T.BooleanType):
        return {"T": True, "Y": True, "F": False, "N": False}.get(text.upper()[:1])
    return text or None


def crs_of(prj: bytes | None) -> object:
    """4326 or 3857 from a .prj; None without one."""
    if not prj:
        return None
    text = prj.decode("latin-1").upper()
    if text.startswith("GEOGCS") and ("WGS_1984" in text or "WGS 84" in text or "NORTH_AMERICAN_1983" in text):
        return DEGREES
    if "MERCATOR_AUXILIARY_SPHERE" in text or "PSEUDO-MERCATOR" in text:
        return METRES
    raise UnsupportedCrsError(f"coordinate system of the .prj: {text[:60]}")


def read(spark: SparkSession, path: str) -> tuple[DataFrame, object]:
    """geometry and the .dbf's columns of all layers; records that can't be decoded have a null geometry."""
    splits, columns, crs = [], {}, None
    for container, layer in _layers(path):
        store = _store(container)
        index = store.get(layer, ".shx")
        if index is None:
            raise ValueError(f"{layer}.shx is missing")
        n = (len(index) - 100) // 8
        crs = crs or crs_of(store.get(layer, ".prj"))
        for name, kind, width, decimals in fields(store.get(layer, ".dbf", 0, 32 + 32 * 256) or b"\0" * 32)[2]:
            columns.setdefault("geometry_1" if name == "geometry" else name, _spark_type(kind, decimals, width))
        splits += [(container, layer, i, min(RECORDS, n - i)) for i in range(0, n, RECORDS)]
    schema = T.StructType([T.StructField("geometry", T.BinaryType())] + [T.StructField(n, t) for n, t in columns.items()])
    arrow = {T.LongType(): pa.int64(), T.DoubleType(): pa.float64(), T.BooleanType(): pa.bool_(), T.StringType(): pa.string()}

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                store, layer, first, n = _store(r["container"]), r["layer"], r["first"], r["n"]
                index = np.frombuffer(store.get(layer, ".shx", 100 + 8 * first, 8 * n), ">i4").reshape(n, 2).astype(np.int64) * 2
                low, high = int(index[:, 0].min()), int((index[:, 0] + index[:, 1]).max()) + 8
                data = store.get(layer, ".shp", low, high - low)
                shapes = []
                for at, size in index.tolist():
                    try:
                        shapes.append(shape(data[at - low + 8 : at - low + 8 + size]))
                    except (struct.error, ValueError):
                        shapes.append(None)
                cells: dict[str, list] = {}
                dbf = store.get(layer, ".dbf", 0, 32 + 32 * 256)
                if dbf:
                    head, width, about = fields(dbf)
                    rows = store.get(layer, ".dbf", head + width * first, width * n)
                    encoding = (store.get(layer, ".cpg") or b"latin-1").decode().strip() or "latin-1"
                    at = 1
                    for name, kind, w, decimals in about:
                        t = _spark_type(kind, decimals, w)
                        cells["geometry_1" if name == "geometry" else name] = [_cell(rows[i * width + at : i * width + at + w], t, encoding) for i in range(n)]
                        at += w
                yield pa.RecordBatch.from_arrays([pa.array(shapes, pa.binary()), *(pa.array(cells.get(c, [None] * n), arrow[t]) for c, t in columns.items())], schema.names)

    ranges = spark.createDataFrame(splits, "container string, layer string, first long, n long")
    return ranges.repartition(max(1, len(splits))).mapInArrow(run, schema), crs
