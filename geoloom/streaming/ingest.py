"""New features as they come: a running histogram, and tiles appended to a dataset by batches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from geoloom.functions.geometry import with_summary
from geoloom.geo.mercator import cell, x_of_lon, y_of_lat
from geoloom.operators.partition import KDTree
from geoloom.sinks.geoparquet import write_tiles


def cell_counts(points: DataFrame, grid: int, lon: str = "lon", lat: str = "lat") -> DataFrame:
    """row, col, n of a stream of points; state is bounded by the grid's cells."""
    there = points.filter(F.col(lon).isNotNull() & F.col(lat).isNotNull())
    return there.groupBy((F.lit(grid - 1) - cell(y_of_lat(F.col(lat)), float(grid))).alias("row"), cell(x_of_lon(F.col(lon)), float(grid)).alias("col")).agg(F.count("*").alias("n"))


def windowed_cell_counts(points: DataFrame, grid: int, time: str, window: str, late: str, lon: str = "lon", lat: str = "lat") -> DataFrame:
    """The same by window of time; rows later than ``late`` are dropped, and windows leave the state when they end."""
    there = points.withWatermark(time, late).filter(F.col(lon).isNotNull() & F.col(lat).isNotNull())
    return there.groupBy(F.window(time, window).alias("w"), (F.lit(grid - 1) - cell(y_of_lat(F.col(lat)), float(grid))).alias("row"), cell(x_of_lon(F.col(lon)), float(grid)).alias("col")).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "row", "col", "n")


def append_tiles(features: DataFrame, tree: KDTree, folder: str, checkpoint: str, geom_col: str = "geometry") -> DataStreamWriter:
    """Each batch as a dataset of its own, ``folder/batch=N``; a batch that is done again replaces what it wrote."""

    def write(batch: DataFrame, number: int) -> None:
        rows = with_summary(batch, geom_col).filter("_cx is not null")
        write_tiles(rows.withColumn("_tile_id", tree.column(F.col("_cx"), F.col("_cy"))), f"{folder}/batch={number}", geom_col)

    return features.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
