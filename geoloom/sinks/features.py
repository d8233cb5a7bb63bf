"""Features as CSV and GeoJSON: written by Spark, or streamed row by row to a reader."""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geoloom.functions.geometry import st_as_geojson
from geoloom.geo import wkb
from geoloom.shared import shared_path
from geoloom.sources.files import file_system, files


def _properties(df: DataFrame, geom_col: str) -> list[str]:
    return [c for c in df.columns if c != geom_col and not c.startswith(("_bbox_", "_tile_id"))]


def feature_column(df: DataFrame, geom_col: str = "geometry") -> Column:
    """A GeoJSON feature as text; null properties stay, as null."""
    names = _properties(df, geom_col)
    props = F.to_json(F.struct(*[F.col(f"`{c}`") for c in names]), {"ignoreNullFields": "false"}) if names else F.lit("{}")
    return F.concat(F.lit('{"type":"Feature","geometry":'), F.coalesce(st_as_geojson(F.col(geom_col)), F.lit("null")), F.lit(',"properties":'), props, F.lit("}"))


def _plain(v):
    return v if v is None or isinstance(v, (str, int, float, bool)) else v.isoformat() if hasattr(v, "isoformat") else str(v)


def geojson_stream(df: DataFrame, geom_col: str = "geometry") -> Iterator[str]:
    """A feature collection in pieces: written by all tasks to the shared folder, and read from there line by line; no partition is on the driver."""
    path = shared_path(df.sparkSession, "features")
    df.select(feature_column(df, geom_col).alias("value")).write.text(path)
    try:
        yield '{"type":"FeatureCollection","features":['
        first = True
        for name, _ in files(path):
            fs, p = file_system(name)
            with fs.open_input_stream(p, compression=None, buffer_size=1 << 20) as f:
                rest = b""
                while block := f.read(1 << 20):
                    *lines, rest = (rest + block).split(b"\n")
                    for line in lines:
                        yield line.decode() if first else "," + line.decode()
                        first = False
        yield "]}"
    finally:
        fs, p = file_system(path)
        fs.delete_dir(p)


def _quoted(v) -> str:
    text = "" if v is None else str(_plain(v))
    return '"' + text.replace('"', '""') + '"' if "," in text or '"' in text or "\n" in text else text


def csv_lines(rows: Iterator[dict], names: list[str], geom_col: str) -> Iterator[str]:
    """Properties, then the geometry's type and its centroid."""
    yield ",".join(map(_quoted, [*names, "geometry_type", "x", "y"])) + "\n"
    for r in rows:
        g = wkb.decode(r[geom_col]) if r[geom_col] is not None else None
        c = wkb.centroid(g) if g else None
        yield ",".join(map(_quoted, [*(r[n] for n in names), g[0] if g else None, *(c or (None, None))])) + "\n"


def csv_stream(df: DataFrame, geom_col: str = "geometry") -> Iterator[str]:
    names = _properties(df, geom_col)
    return csv_lines((r.asDict() for r in df.select(*names, geom_col).toLocalIterator()), names, geom_col)


def feature(row: dict, geom_col: str = "geometry") -> dict:
    """A GeoJSON feature of one row."""
    g = row.get(geom_col)
    return {"type": "Feature", "geometry": None if g is None else wkb.to_geojson(wkb.decode(g)), "properties": {k: _plain(v) for k, v in row.items() if k != geom_col and not k.startswith("_")}}


def dumps(row: dict, geom_col: str = "geometry") -> str:
    return json.dumps(feature(row, geom_col))
