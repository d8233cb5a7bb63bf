"""From a source to a dataset: partitioned tiles, statistics, histogram, vector tiles."""

from __future__ import annotations

import io
import json
import shutil
from pathlib import Path

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geoloom.dataset import Dataset, MVTResult, TileResult
from geoloom.functions.geometry import BBOX, st_linearize, st_transform, with_summary
from geoloom.geo.mercator import DEGREES, METRES, WORLD, epsg, transform_box
from geoloom.operators import histogram, partition, pyramid, stats
from geoloom.plans import tiles as plans
from geoloom.shared import removed, written
from geoloom.sinks import geoparquet
from geoloom.sources import read_source
from geoloom.sources.files import exists, read_bytes, write_bytes
from geoloom.sources.geoparquet import crs_of, geometry_column

MB = 1 << 20
#: Bytes of input for one tile file, by kind of source.
PARTITION_SIZE = {"geojson": 512 * MB}
DEFAULT_PARTITION_SIZE = 128 * MB
#: What a GeoParquet footer says of coordinates in metres.
WEB_MERCATOR = {"type": "ProjectedCRS", "name": "WGS 84 / Pseudo-Mercator", "id": {"authority": "EPSG", "code": 3857}}


def write_histogram(outdir: str | Path, cells: DataFrame, grid: int, dtype: str, crs: object) -> np.ndarray:
    """global.npy and its prefix sums, each with a document beside it; gives the prefix sums."""
    folder = f"{outdir}/histograms"
    counts = histogram.dense(cells, grid, dtype)
    prefix = histogram.prefix_sum(counts.astype(np.float64))
    for name, a in (("global", counts), ("global_prefix", prefix)):
        held = io.BytesIO()
        np.save(held, a)
        write_bytes(f"{folder}/{name}.npy", held.getvalue())
        about = {"filename": f"{name}.npy", "dtype": str(a.dtype), "grid_size": grid, "shape": list(a.shape), "crs": "EPSG:3857", "bbox": [-WORLD, -WORLD, WORLD, WORLD], "sum": float(counts.sum()), "nonzero": int(np.count_nonzero(a))}
        write_bytes(f"{folder}/{name}.json", json.dumps(about, indent=2).encode())
    return prefix


def load_prefix(dataset: str | Path) -> np.ndarray:
    """Prefix sums of a dataset's histogram, from the histogram itself where they are missing."""
    folder = f"{dataset}/histograms"
    load = lambda name: np.load(io.BytesIO(read_bytes(f"{folder}/{name}.npy")))
    if exists(f"{folder}/global_prefix.npy"):
        return load("global_prefix")
    if exists(f"{folder}/global.npy"):
        return histogram.prefix_sum(load("global"))
    raise FileNotFoundError(f"{dataset} has no histogram")


def tile(spark: SparkSession, input: str, outdir: str, *, partition_size: int | None = None, partitions: int | None = None, sort: str = "zorder", sort_keys: list[str] | None = None, compression: str = "zstd", sample_cap: int | None = 10_000, sample_ratio: float = 1.0, seed: int = 42, geom_col: str | None = None, sfc_bits: int = 16, covering_bbox: bool = True, grid_size: int = 4096, histogram_dtype: str = "float64", csv_x_col: str | None = None, csv_y_col: str | None = None, csv_wkt_col: str | None = None, csv_split_size: int | None = None, src_crs: object = None) -> TileResult:
    """Write ``input`` as spatially balanced GeoParquet tiles with statistics and a histogram.

    Rows whose geometry is null, empty or not to be decoded count in the statistics of
    the other columns and go to no tile.
    """
    source = read_source(spark, input, geom_col, csv_x_col, csv_y_col, csv_wkt_col, src_crs, split_size=csv_split_size)
    if "_tile_id" in source.df.columns:
        raise ValueError("the input has a column _tile_id, which is reserved")
    crs, column = epsg(source.crs), source.geometry
    if crs not in (DEGREES, METRES):
        # Tiles and box columns are in degrees or Mercator metres: UTM becomes degrees as it is read.
        source.df, source.crs, crs = source.df.withColumn(column, st_transform(st_linearize(F.col(column)), crs, DEGREES)), None, DEGREES
    clean = source.df.drop(*BBOX).withColumn(column, st_linearize(F.col(column)))
    # The source is parsed and each geometry decoded once; all that follows reads this.
    rows = written(with_summary(clean, column), "rows")
    sample = partition.sample_points(rows, sample_cap, sample_ratio, seed)
    wanted = partitions or partition.partition_count(source.size_bytes, partition_size or PARTITION_SIZE.get(source.kind, DEFAULT_PARTITION_SIZE))
    tree = partition.build_tree(sample.points, sample.box, wanted)
    placed = rows.filter("_cx is not null").withColumn("_tile_id", tree.column(F.col("_cx"), F.col("_cy")))
    manifest = geoparquet.write_tiles(placed, outdir, column, source.crs if isinstance(source.crs, dict) else None if crs != METRES else WEB_MERCATOR, sort, sort_keys, covering_bbox, compression, sfc_bits=sfc_bits, stored=True)
    about = stats.attribute_statistics(rows, column)
    write_bytes(f"{outdir}/stats/attributes.json", json.dumps(about, indent=2, default=str).encode())
    cells = histogram.vertex_cells(rows, grid_size, crs, column)
    write_histogram(outdir, cells, grid_size, histogram_dtype, crs)
    removed(rows)
    files, total = manifest.agg(F.count("*"), F.coalesce(F.sum("n_rows"), F.lit(0))).first()
    return TileResult(str(outdir), files, total, sample.box, f"{outdir}/histograms/global_prefix.npy")


def generate_mvt(spark: SparkSession, tile_dir: str, *, zoom: int = 7, threshold: float = 0.0, pmtiles: bool = False, pmtiles_compression: str = "gzip", outdir: str | None = None, feature_capacity: int | None = plans.CAPACITY, extent: int = plans.EXTENT, buffer: int = plans.BUFFER) -> MVTResult:
    """Vector tiles of zooms 0..zoom for the tiles that hold more than ``threshold`` vertices; as files, or as one archive in their stead. A ``feature_capacity`` of 0 or None: tiles have all of their features."""
    root = Path(tile_dir)
    schema = Dataset(root)._schema()
    if schema is None:
        raise FileNotFoundError(f"{tile_dir} has no tiles")
    column = geometry_column(schema)
    crs = epsg(crs_of(schema, column))
    try:
        prefix = load_prefix(root)
    except FileNotFoundError:
        prefix = None
    rows = with_summary(geoparquet.read_tiles(spark, str(root)).drop(*BBOX), column)
    zooms = pyramid.zoom_range(prefix, zoom, threshold)
    made = plans.vector_tiles(rows, zooms, crs, prefix, threshold, feature_capacity, extent, buffer, column)
    if pmtiles:
        path = root / "tiles.pmtiles" if outdir is None else Path(outdir)
        box = Dataset(root).bbox
        n = plans.write_pmtiles(made, str(path), pmtiles_compression, transform_box(box, crs, 4326) if box else None)
        shutil.rmtree(root / "mvt", ignore_errors=True)
        return MVTResult(str(path), Dataset(root).zoom_levels, n)
    folder = Path(outdir) if outdir else root / "mvt"
    n = plans.write_mvt(made, str(folder))
    return MVTResult(str(folder), sorted(int(p.name) for p in folder.iterdir() if p.name.isdigit()) if folder.is_dir() else [], n)
