"""GeoParquet: Spark's own scan, with the geometry column and coordinates that the footer names."""

from __future__ import annotations

import json

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession

from geoloom.sources.files import file_system, files

COMMON_NAMES = ("geometry", "geom", "wkb_geometry", "SHAPE")


def footer(path: str) -> pa.Schema:
    """The schema of a file, or of a folder's first file."""
    first = next((p for p, _ in files(path) if p.lower().endswith((".parquet", ".geoparquet"))), None)
    if first is None:
        raise ValueError(f"{path}: no Parquet file")
    return file_schema(first)


def file_schema(path: str) -> pa.Schema:
    """The schema of one file with all of the footer's key-value metadata."""
    fs, p = file_system(path)
    about = pq.read_metadata(p, filesystem=fs)
    schema = about.schema.to_arrow_schema()
    return schema.with_metadata({**(schema.metadata or {}), **(about.metadata or {})})


def geo_metadata(schema: pa.Schema) -> dict:
    """The footer's ``geo`` document; empty if there is none or it can't be read."""
    try:
        return json.loads((schema.metadata or {}).get(b"geo", b"{}"))
    except ValueError:
        return {}


def geometry_column(schema: pa.Schema, requested: str | None = None) -> str:
    """The requested name, the footer's primary column, any of its WKB columns, an extension type of WKB, or a common name."""
    if requested:
        if requested not in schema.names:
            raise ValueError(f"there is no column {requested!r}")
        return requested
    geo = geo_metadata(schema)
    columns = geo.get("columns") or {}
    if geo.get("primary_column") in schema.names:
        return geo["primary_column"]
    for name, about in columns.items():
        if str(about.get("encoding", "")).upper() == "WKB" and name in schema.names:
            return name
    for field in schema:
        if (field.metadata or {}).get(b"ARROW:extension:name") == b"geoarrow.wkb" or getattr(field.type, "extension_name", None) == "geoarrow.wkb":
            return field.name
    for name in COMMON_NAMES:
        if name in schema.names:
            return name
    raise ValueError("no geometry column: name one with geom_col")


def crs_of(schema: pa.Schema, column: str) -> object:
    """What the footer says of a column's coordinates; None if it says nothing."""
    return ((geo_metadata(schema).get("columns") or {}).get(column) or {}).get("crs")


def read(spark: SparkSession, path: str, geom_col: str | None = None) -> tuple[DataFrame, str, object]:
    schema = footer(path)
    column = geometry_column(schema, geom_col)
    df = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.{parquet,geoparquet}").parquet(path)
    return df, column, crs_of(schema, column)
