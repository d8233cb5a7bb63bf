"""Range predicates and range queries. Box tests are plain comparisons: they reach the Parquet scan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from geoloom.functions.geometry import BBOX, st_intersects
from geoloom.geo import kernels, wkb
from geoloom.geo.mercator import epsg, map_geometry, transform

INTERNAL = ("_tile_id", *BBOX, "_cx", "_cy", "_npts", "_gtype", "_prio")


def box_meets(box: tuple[float, float, float, float], columns: tuple[str, str, str, str] = BBOX) -> Column:
    """Closed: touching counts."""
    xmin, ymin, xmax, ymax = (F.col(c) for c in columns)
    return (xmax >= box[0]) & (xmin <= box[2]) & (ymax >= box[1]) & (ymin <= box[3])


def point_in_box(x: Column, y: Column, box: tuple[float, float, float, float]) -> Column:
    return x.between(box[0], box[2]) & y.between(box[1], box[3])


def region_in(region: object, region_crs: object, data_crs: object) -> wkb.Geometry:
    """A query region in the data's coordinates."""
    g = kernels.as_query(region)
    return g if epsg(region_crs) == epsg(data_crs) else map_geometry(g, lambda v: transform(v, region_crs, data_crs))


def range_filter(df: DataFrame, region: object, region_crs: object = None, data_crs: object = None, geom_col: str = "geometry") -> DataFrame:
    """Rows whose geometry meets the region: first by box, then exactly. A null geometry never does."""
    g = region_in(region, region_crs, data_crs)
    box = wkb.bounds(g)
    if box is None:
        return df.filter(F.lit(False))
    near = df.filter(box_meets(box))
    if g[0] == "Polygon" and len(g[1]) == 1 and len(g[1][0]) == 5 and wkb.to_geojson(wkb.box(*box)) == wkb.to_geojson(g):
        # Within a rectangle the box test is already exact for points and for boxes that lie inside.
        whole = F.col("_bbox_xmin").between(box[0], box[2]) & F.col("_bbox_xmax").between(box[0], box[2]) & F.col("_bbox_ymin").between(box[1], box[3]) & F.col("_bbox_ymax").between(box[1], box[3])
        # One scan: rows that lie inside send the function a null, which costs nothing.
        return near.filter(whole | st_intersects(F.when(~whole, F.col(geom_col)), g))
    return near.filter(st_intersects(F.col(geom_col), g))


def without_internal(df: DataFrame) -> DataFrame:
    return df.drop(*INTERNAL)


def estimated_size(df: DataFrame, geom_col: str = "geometry") -> DataFrame:
    """Bytes of WKB and of the other columns written as text: an estimate."""
    widths = [F.octet_length(F.col(f"`{c}`")) if c == geom_col else F.octet_length(F.col(f"`{c}`").cast("string")) for c, t in df.dtypes if not t.startswith(("array", "map", "struct"))]
    return df.agg(F.coalesce(F.sum(sum((F.coalesce(w, F.lit(0)) for w in widths[1:]), F.coalesce(widths[0], F.lit(0)))), F.lit(0)).alias("size_bytes"))


#: Boxes of an index that is broadcast (40 bytes each).
SMALL_INDEX = 50_000


def _cell_sizes(rows: DataFrame, index: DataFrame) -> tuple[float, float]:
    """Sides of the grid's cells, in the data's own units: the mean side of the boxes, and at least a 256th of the index's extent."""
    of = lambda df, lo, hi: (F.avg(F.col(hi) - F.col(lo)), F.max(hi) - F.min(lo))
    w, h = ((df.agg(*of(df, *x), *of(df, *y)).first()) for df, x, y in ((rows, ("_bbox_xmin", "_bbox_xmax"), ("_bbox_ymin", "_bbox_ymax")), (index, ("minx", "maxx"), ("miny", "maxy"))))
    side = lambda k: max(w[k] or 0.0, h[k] or 0.0, (h[k + 1] or 0.0) / 256) or 1.0
    return side(0), side(2)


def smallest_box(rows: DataFrame, row_id: str, index: DataFrame) -> DataFrame:
    """Each row with the smallest box of ``index`` (tile_id, minx, miny, maxx, maxy) that its own meets; the first of equals; rows without one go.

    The index is broadcast only while it is small; else the join is cut by a grid.
    """
    ranked = index.select("tile_id", "minx", "miny", "maxx", "maxy", ((F.col("maxx") - F.col("minx")) * (F.col("maxy") - F.col("miny"))).alias("_area"))
    small = ranked.limit(SMALL_INDEX + 1).count() <= SMALL_INDEX
    meets = (F.col("_bbox_xmax") >= F.col("minx")) & (F.col("_bbox_xmin") <= F.col("maxx")) & (F.col("_bbox_ymax") >= F.col("miny")) & (F.col("_bbox_ymin") <= F.col("maxy"))
    if small:
        joined = rows.join(F.broadcast(ranked), meets)
    else:
        wide, high = _cell_sizes(rows, ranked)
        cells = lambda a, b, size: F.explode(F.sequence(F.floor(F.col(a) / size), F.floor(F.col(b) / size)))
        left = rows.withColumn("_gx", cells("_bbox_xmin", "_bbox_xmax", wide)).withColumn("_gy", cells("_bbox_ymin", "_bbox_ymax", high))
        right = ranked.withColumn("_gx", cells("minx", "maxx", wide)).withColumn("_gy", cells("miny", "maxy", high))
        joined = left.join(right, ["_gx", "_gy"]).filter(meets).drop("_gx", "_gy").dropDuplicates([row_id, "tile_id"])
    best = W.partitionBy(row_id).orderBy("_area", "tile_id")
    return joined.withColumn("_n", F.row_number().over(best)).filter("_n = 1").drop("_n", "_area", "minx", "miny", "maxx", "maxy")
