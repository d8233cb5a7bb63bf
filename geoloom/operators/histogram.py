"""Two-dimensional vertex histograms over the Web Mercator square, their prefix sums and what is read off them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from geoloom.geo import wkb
from geoloom.geo.mercator import METRES, WORLD, epsg, forward, tile_range, transform_box


def vertex_cells(df: DataFrame, grid: int, crs: object = None, geom_col: str = "geometry") -> DataFrame:
    """row, col, n_vertices: sparse, row 0 in the north; vertices outside count in the edge cells, those not finite don't."""
    metres = epsg(crs) == METRES

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column(0).to_pylist()
            many, rest = wkb.stacked(values)
            parts = [xy.reshape(-1, 2) for _, _, xy in many]
            for i in rest:
                try:
                    parts.append(wkb.vertices(wkb.decode(values[i])))
                except wkb.GeometryError:
                    continue
            if not parts:
                continue
            xy = np.concatenate(parts)
            xy = xy if metres else forward(xy)
            xy = xy[np.isfinite(xy).all(1)]
            at = np.clip(((xy + WORLD) / (2 * WORLD) * grid).astype(np.int64), 0, grid - 1)
            cell, n = np.unique((grid - 1 - at[:, 1]) * grid + at[:, 0], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array((cell // grid).astype(np.int32)), pa.array((cell % grid).astype(np.int32)), pa.array(n)], ["row", "col", "n"])

    cells = df.select(geom_col).filter(F.col(geom_col).isNotNull()).mapInArrow(run, "row int, col int, n long")
    return cells.groupBy("row", "col").agg(F.sum("n").alias("n_vertices"))


def dense(cells: DataFrame, grid: int, dtype: str = "float64") -> np.ndarray:
    """The grid as an array; at most grid * grid cells reach the driver, a number that doesn't grow with the data."""
    out = np.zeros((grid, grid), dtype)
    table = cells.select("row", "col", "n_vertices").toPandas()
    out[table["row"], table["col"]] = table["n_vertices"]
    return out


def prefix_sum(grid: np.ndarray) -> np.ndarray:
    return grid.cumsum(0).cumsum(1)


def prefix_sum_frame(cells: DataFrame, grid: int) -> DataFrame:
    """row, col, total of the dense grid: the number in all cells above and to the left, included."""
    spark = cells.sparkSession
    every = spark.range(grid).select(F.col("id").cast("int").alias("row")).crossJoin(spark.range(grid).select(F.col("id").cast("int").alias("col")))
    full = every.join(cells, ["row", "col"], "left").fillna(0, ["n_vertices"])
    down = full.withColumn("d", F.sum("n_vertices").over(W.partitionBy("col").orderBy("row")))
    return down.select("row", "col", F.sum("d").over(W.partitionBy("row").orderBy("col")).alias("total"))


def area(prefix: np.ndarray, row0: int, col0: int, row1: int, col1: int) -> float:
    """Sum over a rectangle of cells, ends included."""
    at = lambda r, c: float(prefix[r, c]) if r >= 0 and c >= 0 else 0.0
    return at(row1, col1) - at(row0 - 1, col1) - at(row1, col0 - 1) + at(row0 - 1, col0 - 1)


def estimate(prefix: np.ndarray, rectangle: tuple[float, float, float, float], crs: object = None) -> float:
    """Vertices in the cells that a rectangle meets; 0 if it lies outside the world."""
    b = transform_box(tuple(map(float, rectangle)), crs, METRES)
    if b[0] > WORLD or b[2] < -WORLD or b[1] > WORLD or b[3] < -WORLD:
        return 0.0
    n = prefix.shape[0]
    at = lambda v: int(min(max((v + WORLD) / (2 * WORLD) * n, 0), n - 1))
    return area(prefix, n - 1 - at(b[3]), at(b[0]), n - 1 - at(b[1]), at(b[2]))


def tile_value(prefix: np.ndarray, z: int, x: int, y: int) -> float:
    """Vertices in a tile: a block of cells, or a share of one cell beyond the grid's own zoom."""
    n = prefix.shape[0]
    deep = n.bit_length() - 1
    if z <= deep:
        s = n >> z
        return area(prefix, y * s, x * s, (y + 1) * s - 1, (x + 1) * s - 1)
    d = z - deep
    return area(prefix, y >> d, x >> d, y >> d, x >> d) / 4**d


def deepest_level(prefix: np.ndarray, threshold: float, beyond: bool = True) -> int:
    """The deepest zoom at which some tile still exceeds the threshold; -1 if none does. ``beyond``: also zooms finer than the grid, by estimate; else only what was counted."""
    cells = np.diff(np.diff(np.pad(prefix, ((1, 0), (1, 0))), axis=0), axis=1)
    n = prefix.shape[0]
    deep = n.bit_length() - 1
    for z in range(deep, -1, -1):
        most = float(cells.max())
        if most > threshold:
            if z < deep or threshold <= 0 or not beyond:
                return z
            # Beyond the grid a cell is shared out evenly, by fours.
            while most / 4 > threshold and z < 30:
                most, z = most / 4, z + 1
            return z
        if cells.shape[0] > 1:
            cells = cells.reshape(cells.shape[0] // 2, 2, -1, 2).sum((1, 3))
    return -1


def accepted_tiles(prefix: np.ndarray, zooms: range, threshold: float) -> dict[int, np.ndarray]:
    """Per zoom, which tiles (row, column) hold more than ``threshold`` vertices, for zooms within the grid."""
    n = prefix.shape[0]
    out = {}
    for z in zooms:
        if 1 << z <= n:
            s = n >> z
            at = np.pad(prefix, ((1, 0), (1, 0)))[::s, ::s]
            out[z] = np.diff(np.diff(at, axis=0), axis=1) > threshold
    return out


__all__ = ["accepted_tiles", "area", "deepest_level", "dense", "estimate", "prefix_sum", "prefix_sum_frame", "tile_range", "tile_value", "vertex_cells"]
