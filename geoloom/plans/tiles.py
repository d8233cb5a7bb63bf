"""Vector tiles: features fanned out to tiles, the top of each tile, encoded."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoloom.functions.geometry import BBOX, SUMMARY
from geoloom.geo import kernels, mvt, wkb
from geoloom.geo.mercator import DEGREES, METRES, decode_tile, epsg, map_geometry, tile_pixels, transform
from geoloom.operators import pyramid
from geoloom.shared import written

EXTENT, BUFFER, CAPACITY = 4096, 256, 10_000
LAYER = "layer0"


def _shapes(z: int, x: int, y: int, data: bytes, code: int, extent: int, buffer: int) -> list[wkb.Geometry]:
    """What a tile draws of a row's WKB."""
    try:
        g = wkb.decode(data)
    except wkb.GeometryError:
        return []
    if code != METRES:
        g = map_geometry(g, lambda v: transform(v, code, METRES))
    return kernels.tile_shapes(g, (z, x, y), extent, buffer)


def encode_features(z: int, x: int, y: int, rows: list[tuple[bytes, dict]], crs: object = DEGREES, extent: int = EXTENT, buffer: int = BUFFER, layer: str = LAYER) -> bytes | None:
    """A tile of (WKB, properties), the first drawn first; None if nothing is left to draw."""
    code = epsg(crs)
    drawn = [(s, properties) for data, properties in rows for s in _shapes(z, x, y, data, code, extent, buffer)]
    return mvt.encode(drawn, layer, extent) if drawn else None


def _plain_type(kind: pa.DataType) -> bool:
    return pa.types.is_integer(kind) or pa.types.is_floating(kind) or pa.types.is_string(kind) or pa.types.is_large_string(kind) or pa.types.is_boolean(kind)


class _Tile:
    """A tile that its rows come to in batches, in the order in which they are drawn."""

    def __init__(self, tile: int, names: list[str], code: int, extent: int, buffer: int, layer: str) -> None:
        self.at, self.names, self.code, self.extent, self.buffer = decode_tile(tile), names, code, extent, buffer
        self.layer, self.n, self.any = mvt.Layer(layer, extent), 0, False

    def add(self, batch: pa.RecordBatch) -> None:
        self.n += batch.num_rows
        geometry, columns = batch.column("_geometry"), [(n, batch.column(f"p_{i}")) for i, n in enumerate(self.names)]
        xy = wkb.all_points(geometry) if all(_plain_type(c.type) for _, c in columns) else None
        if xy is not None:
            self.any = True
            self.layer.add_points(tile_pixels(transform(xy, self.code, METRES), *self.at, self.extent), columns)
            return
        values = [c.to_pylist() for _, c in columns]
        for i, data in enumerate(geometry.to_pylist()):
            for s in _shapes(*self.at, data, self.code, self.extent, self.buffer):
                self.any = True
                self.layer.add(s, {n: v[i] for n, v in zip(self.names, values)})

    def row(self) -> pa.RecordBatch:
        kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip((*self.at, self.n, self.layer.bytes()), kinds)], ["z", "x", "y", "n_features", "mvt"])


def vector_tiles(df: DataFrame, zooms: range, crs: object = None, prefix: np.ndarray | None = None, threshold: float = 0.0, capacity: int | None = CAPACITY, extent: int = EXTENT, buffer: int = BUFFER, geom_col: str = "geometry", layer: str = LAYER) -> DataFrame:
    """z, x, y, n_features, mvt of every tile that passes the histogram and has something to draw.

    ``df`` has the summary's columns. Tiles are chosen by ids and priorities alone; geometry
    and properties are joined to the winners, so what is shuffled doesn't grow with the
    number of tiles that lose a feature. The table of features is written once, which
    fixes the ids that it is joined by. The rows of a tile come in order of priority, in
    batches: a task holds the bytes of one tile, not its rows. Without a ``capacity``
    (None or 0) a tile has all of its features.
    """
    code = epsg(crs)
    names = [c for c in df.columns if c not in SUMMARY and c not in (geom_col, "_tile_id")]
    features = written(df.filter("_cx is not null").withColumn("_fid", F.monotonically_increasing_id()), "features")
    light = features.select("_fid", "_prio", *BBOX)
    tiles = pyramid.descended(light, zooms, code, buffer / extent, prefix, threshold)
    top = (pyramid.top_features(tiles, capacity) if capacity else tiles).select("tile_id", "_prio", "_fid")
    full = top.join(features.select("_fid", F.col(geom_col).alias("_geometry"), *[F.col(f"`{c}`").alias(f"p_{i}") for i, c in enumerate(names)]), "_fid")

    def run(batches) -> Iterator[pa.RecordBatch]:
        held: _Tile | None = None
        at = None
        for batch in batches:
            tile = np.asarray(batch.column("tile_id"))
            cut = [0, *(np.flatnonzero(np.diff(tile)) + 1).tolist(), len(tile)]
            for a, b in zip(cut, cut[1:]):
                if a == b:
                    continue
                if held is None or at != tile[a]:
                    if held is not None and held.any:
                        yield held.row()
                    at, held = tile[a], _Tile(int(tile[a]), names, code, extent, buffer, layer)
                held.add(batch.slice(a, b - a))
        if held is not None and held.any:
            yield held.row()

    return full.repartition("tile_id").sortWithinPartitions("tile_id", F.desc("_prio"), "_fid").mapInArrow(run, "z int, x long, y long, n_features long, mvt binary")


def write_mvt(tiles: DataFrame, folder: str) -> int:
    """Files z/x/y.mvt of a table of tiles; their number."""
    from geoloom.sources.files import file_system

    def run(batches) -> Iterator[pa.RecordBatch]:
        fs, root = file_system(folder)
        n = 0
        for batch in batches:
            for z, x, y, data in zip(*(batch.column(c).to_pylist() for c in ("z", "x", "y", "mvt"))):
                fs.create_dir(f"{root}/{z}/{x}", recursive=True)
                with fs.open_output_stream(f"{root}/{z}/{x}/{y}.mvt") as f:
                    f.write(data)
                n += 1
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], ["n"])

    return tiles.select("z", "x", "y", "mvt").mapInArrow(run, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def write_pmtiles(tiles: DataFrame, path: str, compression: str = "gzip", bounds=None) -> int:
    """One archive of a table of tiles, written by the driver as they come in order; one partition is held at a time."""
    from geoloom.sinks import pmtiles

    @F.pandas_udf("long")
    def number(z: pd.Series, x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([pmtiles.tile_number(*v) for v in zip(z, x, y)], dtype="int64")

    rows = written(tiles, "tiles").withColumn("_n", number("z", "x", "y")).orderBy("_n").select("z", "x", "y", "mvt")
    return pmtiles.write(path, ((r.z, r.x, r.y, bytes(r.mvt)) for r in rows.toLocalIterator()), compression, **({"bounds": bounds} if bounds else {}))
