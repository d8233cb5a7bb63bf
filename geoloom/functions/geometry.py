"""Arrow-batched geometry functions, for DataFrames and (registered) for SQL.

``geom_summary`` is computed once after a scan; what follows works on its plain columns.
"""

from __future__ import annotations

import json

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from geoloom.geo import kernels, wkb
from geoloom.geo.mercator import map_geometry, transform

BBOX = ("_bbox_xmin", "_bbox_ymin", "_bbox_xmax", "_bbox_ymax")
SUMMARY = (*BBOX, "_cx", "_cy", "_npts", "_gtype", "_prio")
# Types are objects: a DDL string needs a session, and workers import this module.
_SUMMARY_TYPE = T.StructType([*(T.StructField(c, T.DoubleType()) for c in ("xmin", "ymin", "xmax", "ymax", "cx", "cy")), T.StructField("npts", T.IntegerType()), T.StructField("gtype", T.StringType())])


def _decoded(value):
    """A geometry, or None for null and for bytes that are none."""
    if value is None:
        return None
    try:
        return wkb.decode(value)
    except wkb.GeometryError:
        return None


@F.pandas_udf(_SUMMARY_TYPE)
def geom_summary(geometry: pd.Series) -> pd.DataFrame:
    """Box, centroid, vertex number and type; null for null, empty and undecodable geometry."""
    n = len(geometry)
    out = {c: np.full(n, np.nan) for c in ("xmin", "ymin", "xmax", "ymax", "cx", "cy")}
    npts, gtype = np.full(n, None, object), np.full(n, None, object)
    values = geometry.to_numpy()
    many, rest = wkb.stacked(values)
    rest = rest.tolist()
    for kind, at, xy in many:
        c = wkb.centroids(kind, xy)
        good = np.isfinite(c).all(1)
        rest += at[~good].tolist()
        at, xy = at[good], xy[good]
        out["cx"][at], out["cy"][at] = c[good].T
        (out["xmin"][at], out["ymin"][at]), (out["xmax"][at], out["ymax"][at]) = xy.min(1).T, xy.max(1).T
        npts[at], gtype[at] = xy.shape[1], kind
    for i in rest:
        g = _decoded(values[i])
        b = wkb.bounds(g) if g else None
        if b is None:
            continue
        for c, v in zip(("xmin", "ymin", "xmax", "ymax"), b):
            out[c][i] = v
        out["cx"][i], out["cy"][i] = wkb.centroid(g)
        npts[i], gtype[i] = len(wkb.vertices(g)), g[0]
    frame = pd.DataFrame(out)
    frame["npts"], frame["gtype"] = pd.array(npts, "Int32"), gtype
    # NaN becomes null on the way to Spark.
    return frame


#: Rows that one task has at most where functions in Python are to come.
SPREAD = 50_000


def spread(df: DataFrame, key: str) -> DataFrame:
    """``df`` in as many partitions as its rows take, by the hash of ``key``.

    A small file of many rows is one partition, whose functions one core would compute
    alone. Its rows are counted, which Parquet files say in their footers.
    """
    n = -(-df.count() // SPREAD)
    return df.repartition(n, key) if n > df.rdd.getNumPartitions() else df


def with_summary(df: DataFrame, geom_col: str = "geometry") -> DataFrame:
    """``df`` with the columns of ``SUMMARY``; NaN never appears in them."""
    s = df.withColumn("_s", geom_summary(F.col(geom_col)))
    clean = lambda c: F.when(F.isnan(f"_s.{c}"), None).otherwise(F.col(f"_s.{c}"))
    return s.withColumns({**{a: clean(b) for a, b in zip((*BBOX, "_cx", "_cy"), ("xmin", "ymin", "xmax", "ymax", "cx", "cy"))}, "_npts": F.col("_s.npts"), "_gtype": F.col("_s.gtype"), "_prio": priority(F.col(geom_col))}).drop("_s")


def priority(geometry: Column) -> Column:
    """CRC-32 of the source WKB: which features a full tile keeps."""
    return F.crc32(geometry)


@F.pandas_udf(T.BinaryType())
def st_point(x: pd.Series, y: pd.Series) -> pd.Series:
    return pd.Series(wkb.point_wkb(x.to_numpy(np.float64, na_value=np.nan), y.to_numpy(np.float64, na_value=np.nan)))


def _each(f):
    return lambda s: pd.Series([None if v is None else f(v) for v in s], dtype=object)


def _quiet(f):
    def run(v):
        try:
            return f(v)
        except (ValueError, KeyError, TypeError, IndexError):
            return None

    return run


@F.pandas_udf(T.BinaryType())
def st_from_wkt(text: pd.Series) -> pd.Series:
    return _each(_quiet(lambda v: wkb.encode(wkb.from_wkt(v))))(text)


@F.pandas_udf(T.StringType())
def st_as_geojson(geometry: pd.Series) -> pd.Series:
    values = geometry.to_numpy()
    out = np.full(len(values), None, object)
    many, rest = wkb.stacked(values)
    rest = rest.tolist()
    for kind, at, xy in many:
        if kind == "Point":
            for i, (x, y) in zip(at.tolist(), xy[:, 0].tolist()):
                out[i] = f'{{"type": "Point", "coordinates": [{x!r}, {y!r}]}}'
        else:
            rest += at.tolist()
    for i in rest:
        out[i] = json.dumps(wkb.to_geojson(wkb.decode(values[i])))
    return pd.Series(out, dtype=object)


def _geojson(v):
    g = wkb.from_geojson(v)
    return None if g is None else wkb.encode(g)


@F.pandas_udf(T.BinaryType())
def st_from_geojson(text: pd.Series) -> pd.Series:
    return _each(_quiet(_geojson))(text)


@F.pandas_udf(T.BinaryType())
def st_linearize(geometry: pd.Series) -> pd.Series:
    return pd.Series(wkb.linearized(geometry.to_numpy()), dtype=object)


@F.pandas_udf(T.StringType())
def st_type(geometry: pd.Series) -> pd.Series:
    return _each(_quiet(lambda v: wkb.wkb_type(v)))(geometry)


@F.pandas_udf(T.IntegerType())
def st_npoints(geometry: pd.Series) -> pd.Series:
    values = geometry.to_numpy()
    out = np.full(len(values), None, object)
    many, rest = wkb.stacked(values)
    for _, at, xy in many:
        out[at] = xy.shape[1]
    for i in rest:
        out[i] = None if (g := _decoded(values[i])) is None else len(wkb.vertices(g))
    return pd.Series(out, dtype="Int32")


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())])))
def st_vertices(geometry: pd.Series) -> pd.Series:
    return pd.Series([None if (g := _decoded(v)) is None else [{"x": x, "y": y} for x, y in wkb.vertices(g).tolist()] for v in geometry])


@F.pandas_udf(T.ArrayType(T.BinaryType()))
def st_dump(geometry: pd.Series) -> pd.Series:
    """The members of a collection, at any depth; other geometries alone."""
    return pd.Series([None if (g := _decoded(v)) is None else [wkb.encode(p) for p in kernels._opened(g)] for v in geometry])


def st_transform(geometry: Column, source: object, target: object) -> Column:
    """Between EPSG:4326 and EPSG:3857; the column itself if they are the same."""
    from geoloom.geo.mercator import epsg

    a, b = epsg(source), epsg(target)
    if a == b:
        return geometry

    @F.pandas_udf(T.BinaryType())
    def run(values: pd.Series) -> pd.Series:
        return pd.Series([None if v is None else wkb.encode(map_geometry(wkb.decode(v), lambda p: transform(p, a, b))) for v in values], dtype=object)

    return run(geometry)


def st_intersects(geometry: Column, region: wkb.Geometry) -> Column:
    """Whether a geometry meets one fixed region; its boundary counts."""
    shape = wkb.encode(region)

    @F.pandas_udf(T.BooleanType())
    def run(values: pd.Series) -> pd.Series:
        q = wkb.decode(shape)
        raw = values.to_numpy()
        out = np.zeros(len(raw), bool)
        many, rest = wkb.stacked(raw)
        rest = rest.tolist()
        for kind, at, xy in many:
            if kind == "Point" and q[0] == "Polygon":
                out[at] = kernels.inside(xy[:, 0], q[1])
            else:
                rest += at.tolist()
        for i in rest:
            out[i] = (g := _decoded(raw[i])) is not None and kernels.intersects(g, q)
        return pd.Series(out)

    return run(geometry)


@F.pandas_udf(T.BooleanType())
def st_intersects_pair(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([bool((g := _decoded(x)) is not None and (h := _decoded(y)) is not None and kernels.intersects(g, h)) for x, y in zip(a, b)], dtype=bool)


def register(spark: SparkSession) -> None:
    """Make the functions known to SQL."""
    for name, f in {"geom_summary": geom_summary, "st_geo_point": st_point, "st_geo_from_wkt": st_from_wkt, "st_geo_as_geojson": st_as_geojson, "st_geo_from_geojson": st_from_geojson, "st_geo_linearize": st_linearize, "st_geo_type": st_type, "st_geo_npoints": st_npoints, "st_geo_vertices": st_vertices, "st_geo_dump": st_dump, "st_geo_intersects": st_intersects_pair}.items():
        spark.udf.register(name, f)
