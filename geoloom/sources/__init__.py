"""Geometry tables from files: GeoParquet, GeoJSON, CSV and Shapefile, told by their suffix."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geoloom.functions.geometry import st_from_wkt, st_point
from geoloom.session import prepare
from geoloom.sources import geojson, geoparquet, shapefile
from geoloom.sources.files import files, is_dir

SUFFIXES = {".parquet": "geoparquet", ".geoparquet": "geoparquet", ".geojson": "geojson", ".json": "geojson", ".geojsonl": "geojson", ".jsonl": "geojson", ".csv": "csv", ".tsv": "csv", ".shp": "shapefile", ".gdb": "gdb"}


@dataclass
class Source:
    """A table with one geometry column of WKB, and what is known of it."""

    df: DataFrame
    geometry: str
    crs: object
    kind: str
    path: str

    @property
    def size_bytes(self) -> int:
        return input_size(self.path)


def _suffix_kind(name: str) -> str | None:
    name = name.lower().rstrip("/")
    return next((k for s, k in SUFFIXES.items() if name.endswith(s)), None)


def source_kind(path: str) -> str:
    """The kind of a file, or of all files of a folder, which must be one."""
    kind = _suffix_kind(path)
    if kind:
        return kind
    if path.lower().endswith(".zip"):
        import zipfile

        if path.lower().endswith(".gdb.zip"):
            return "gdb"
        with zipfile.ZipFile(path) as z:
            return "gdb" if any(".gdb/" in n.lower() for n in z.namelist()) else "shapefile"
    if not is_dir(path):
        raise ValueError(f"{path}: the suffix names no known kind of source")
    kinds = {k for p, _ in files(path) if (k := _suffix_kind(p))}
    if len(kinds) != 1:
        raise ValueError(f"{path}: a folder must hold files of one kind, it has {sorted(kinds) or 'none'}")
    return kinds.pop()


def input_size(path: str) -> int:
    """Bytes of all files of a source."""
    return sum(n for _, n in files(path))


def read_source(spark: SparkSession, path: str, geom_col: str | None = None, csv_x_col: str | None = None, csv_y_col: str | None = None, csv_wkt_col: str | None = None, src_crs: object = None, geometry_only: bool = False, split_size: int | None = None, csv_multiline: bool = False) -> Source:
    """The table at ``path``. ``src_crs`` stands in for what the files say about their coordinates.

    CSV takes either x and y or WKT; coordinates and shapes that can't be read give a null geometry.
    ``csv_multiline`` is for quoted line ends; such a file can't be cut, so each is read by one task.
    """
    prepare(spark)
    kind = source_kind(path)
    if kind == "geoparquet":
        df, column, crs = geoparquet.read(spark, path, geom_col)
    elif kind == "geojson":
        df, crs = geojson.read(spark, path, split_size or geojson.SPLIT)
        column = "geometry"
    elif kind == "csv":
        df, column, crs = _csv(spark, path, geom_col or "geometry", csv_x_col, csv_y_col, csv_wkt_col, csv_multiline), geom_col or "geometry", None
    elif kind == "shapefile":
        df, crs = shapefile.read(spark, path)
        column = "geometry"
    else:
        raise NotImplementedError("File Geodatabases need a library that isn't here; convert them to GeoParquet")
    return Source(df.select(column) if geometry_only else df, column, src_crs or crs, kind, path)


def _csv(spark: SparkSession, path: str, geom_col: str, x: str | None, y: str | None, wkt: str | None, multiline: bool = False) -> DataFrame:
    points = x is not None and y is not None
    if points == (wkt is not None) or (x is None) != (y is None):
        raise ValueError("CSV needs either an x and a y column or a WKT column")
    first = files(path)
    sep = "\t" if first and first[0][0].lower().endswith(".tsv") else ","
    df = spark.read.option("header", True).option("inferSchema", True).option("sep", sep).option("multiLine", multiline).option("recursiveFileLookup", True).csv(path)
    number = lambda c: F.col(f"`{c}`").try_cast("double")
    return df.withColumn(geom_col, st_point(number(x), number(y)) if points else st_from_wkt(F.col(f"`{wkt}`")))


__all__ = ["Source", "input_size", "read_source", "source_kind"]
