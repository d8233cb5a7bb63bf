"""The tile pyramid: boxes fanned out to tiles, tiles filtered by density, the top features of each tile."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from geoloom.functions.geometry import BBOX
from geoloom.geo.mercator import METRES, WORLD, epsg, tile_id, tile_x, tile_y, x_of_lon, y_of_lat
from geoloom.operators.histogram import accepted_tiles, deepest_level


def metre_box(crs: object, columns: tuple[str, str, str, str] = BBOX) -> list[Column]:
    """The box columns in metres."""
    c = [F.col(x) for x in columns]
    return c if epsg(crs) == METRES else [x_of_lon(c[0]), y_of_lat(c[1]), x_of_lon(c[2]), y_of_lat(c[3])]


def fan_out(df: DataFrame, zooms: range, crs: object = None, buffer: float = 0.0, keep: list[str] | None = None) -> DataFrame:
    """One row for each tile that a row's box, grown by ``buffer`` of a tile's side, overlaps, at every zoom."""
    xmin, ymin, xmax, ymax = metre_box(crs)
    finite = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(1e300))
    keep = df.columns if keep is None else keep
    rows = df.filter(finite(xmin) & finite(ymin) & finite(xmax) & finite(ymax)).withColumn("z", F.explode(F.array(*[F.lit(z) for z in zooms])))
    grow = F.lit(buffer * 2 * WORLD) / F.pow(F.lit(2.0), F.col("z"))
    rows = rows.withColumn("x", F.explode(F.sequence(tile_x(xmin - grow, F.col("z")), tile_x(xmax + grow, F.col("z"))))).withColumn("y", F.explode(F.sequence(tile_y(ymax + grow, F.col("z")), tile_y(ymin - grow, F.col("z")))))
    return rows.select(*keep, "z", "x", "y", tile_id(F.col("z"), F.col("x"), F.col("y")).alias("tile_id"))


#: Tiles that a task expands at a time.
CHUNK = 1 << 16


def accepting(prefix: np.ndarray, zooms: range, threshold: float) -> dict[int, np.ndarray]:
    """Per zoom, a grid of the tiles that hold more than ``threshold`` vertices (strictly). Tiles finer than the histogram share their cell's count evenly, so their grid is the cells'."""
    deep = prefix.shape[0].bit_length() - 1
    out = accepted_tiles(prefix, range(zooms[0], min(zooms[-1], deep) + 1), threshold) if zooms[0] <= deep else {}
    for z in zooms:
        if z > deep:
            out[z] = accepted_tiles(prefix, range(deep, deep + 1), threshold * 4 ** (z - deep))[deep]
    return out


def descended(df: DataFrame, zooms: range, crs: object = None, buffer: float = 0.0, prefix: np.ndarray | None = None, threshold: float = 0.0) -> DataFrame:
    """``fan_out`` of rows with _fid and _prio, to the tiles that pass the histogram alone.

    A tile passes only if its parent does, and a box that reaches a tile by the buffer
    reaches the parent by the parent's; so each row goes down from tile to tile and
    never meets the tiles of an empty quarter, however large its box. There is no
    shuffle. What is broadcast is the grids of tiles: a bit for each cell of the
    histogram and zoom, which doesn't grow with the data.
    """
    if prefix is None:
        return fan_out(df, zooms, crs, buffer, ["_fid", "_prio"])
    every = range(zooms[-1] + 1)
    deep = prefix.shape[0].bit_length() - 1
    grids = {z: (g.shape, np.packbits(g)) for z, g in accepting(prefix, every, threshold).items()}
    shared = df.sparkSession.sparkContext.broadcast(grids)
    first = zooms[0]

    def run(batches):
        import pyarrow as pa

        grid = {z: np.unpackbits(bits, count=shape[0] * shape[1]).reshape(shape).astype(bool) for z, (shape, bits) in shared.value.items()}
        for batch in batches:
            box = [np.asarray(batch.column(c)) for c in ("x0", "y0", "x1", "y1")]
            good = np.flatnonzero(np.isfinite(np.array(box)).all(0))
            todo = [(0, good, np.zeros(len(good), np.int64), np.zeros(len(good), np.int64))]
            while todo:
                z, row, x, y = todo.pop()
                n = 1 << z
                grow = buffer * 2 * WORLD / n
                at = lambda v, n=n: np.clip(np.floor(v / (2 * WORLD) * n), 0, n - 1).astype(np.int64)
                inside = (x >= at(box[0][row] - grow + WORLD)) & (x <= at(box[2][row] + grow + WORLD)) & (y >= at(WORLD - box[3][row] - grow)) & (y <= at(WORLD - box[1][row] + grow))
                d = max(0, z - deep)
                inside &= grid[z][y >> d, x >> d]
                row, x, y = row[inside], x[inside], y[inside]
                if not len(row):
                    continue
                if z >= first:
                    take = pa.array(row)
                    yield pa.RecordBatch.from_arrays([batch.column("_fid").take(take), batch.column("_prio").take(take), pa.array(np.full(len(row), z, np.int32)), pa.array(x), pa.array(y), pa.array(np.int64(z) << np.int64(58) | x << 29 | y)], ["_fid", "_prio", "z", "x", "y", "tile_id"])
                if z < every[-1]:
                    row, x, y = np.repeat(row, 4), np.repeat(2 * x, 4) + np.tile([0, 1, 0, 1], len(x)), np.repeat(2 * y, 4) + np.tile([0, 0, 1, 1], len(y))
                    todo += [(z + 1, row[i : i + CHUNK], x[i : i + CHUNK], y[i : i + CHUNK]) for i in range(0, len(row), CHUNK)]

    x0, y0, x1, y1 = metre_box(crs)
    return df.select("_fid", "_prio", x0.alias("x0"), y0.alias("y0"), x1.alias("x1"), y1.alias("y1")).mapInArrow(run, "_fid long, _prio long, z int, x long, y long, tile_id long")


def zoom_range(prefix: np.ndarray | None, zoom: int, threshold: float) -> range:
    """Zooms 0..zoom, ending where the histogram says no tile would pass (only with a threshold above 0)."""
    if prefix is not None and threshold > 0:
        zoom = min(zoom, max(deepest_level(prefix, threshold), 0))
    return range(zoom + 1)


def top_features(tiles: DataFrame, capacity: int, fid: str = "_fid") -> DataFrame:
    """The ``capacity`` rows of the highest priority in each tile; ties to the lower id. Pruned before the shuffle."""
    order = W.partitionBy("tile_id").orderBy(F.desc("_prio"), F.asc(fid))
    return tiles.withColumn("_rank", F.row_number().over(order)).filter(F.col("_rank") <= capacity)


def rolled_up(base: DataFrame, zoom: int) -> DataFrame:
    """z, x, y, n of every zoom from counts x, y, n at ``zoom``: one small aggregate after another."""
    level = base.select(F.lit(zoom).alias("z"), "x", "y", "n")
    out = level
    for z in range(zoom - 1, -1, -1):
        level = level.groupBy(F.shiftright("x", 1).alias("x"), F.shiftright("y", 1).alias("y")).agg(F.sum("n").alias("n")).select(F.lit(z).alias("z"), "x", "y", "n")
        out = out.unionByName(level)
    return out


def tile_counts_by_zoom(tiles: DataFrame) -> DataFrame:
    return tiles.select("z", "x", "y").distinct().groupBy("z").agg(F.count("*").alias("n_tiles"))
