"""The library's functions: build, inspect, query and serve datasets."""

from __future__ import annotations

import json
import shutil
import threading
from collections.abc import Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geoloom import config, dataset, shared
from geoloom.dataset import Dataset, MVTResult, TileResult
from geoloom.functions.geometry import st_transform
from geoloom.geo import wkb
from geoloom.geo.mercator import DEGREES
from geoloom.operators import histogram, predicates
from geoloom.plans import build as plans
from geoloom.sinks import geoparquet, pmtiles
from geoloom.sources.geoparquet import crs_of, geometry_column

_temp_dir: str | None = None


def set_temp_dir(path: str | None) -> None:
    """A shared folder for intermediate tables, where spark.checkpoint.dir is unset."""
    global _temp_dir
    _temp_dir = path
    shared.use_folder(path)


def get_temp_dir() -> str | None:
    return _temp_dir


def _session(spark: SparkSession | None) -> SparkSession:
    if spark is None:
        spark = SparkSession.getActiveSession()
    if spark is None:
        from geoloom.session import local_session

        spark = local_session()
    return spark


# --- Building ---------------------------------------------------------------------

_TILE = ("partition_size", "sort", "compression", "sample_cap", "sample_ratio", "sfc_bits", "grid_size", "seed", "covering_bbox")
_MVT = ("zoom", "threshold", "pmtiles", "pmtiles_compression", "feature_capacity", "extent", "buffer")


def tile(input: str, outdir: str, *, spark: SparkSession | None = None, histogram_dtype: str | None = None, csv_split_size: int | str | None = None, **options) -> TileResult:
    """Partition a source into GeoParquet tiles with statistics and a histogram. What isn't given comes from the settings."""
    options = {k: config.resolve("tile", k, options.get(k)) for k in _TILE} | {k: v for k, v in options.items() if k not in _TILE}
    options["partition_size"] = config.parse_size(options["partition_size"])
    return plans.tile(_session(spark), input, outdir, histogram_dtype=config.resolve("tile", "dtype", histogram_dtype), csv_split_size=config.parse_size(config.resolve("tile", "csv_split_size", csv_split_size)), **options)


def generate_mvt(tile_dir: str, *, spark: SparkSession | None = None, outdir: str | None = None, **options) -> MVTResult:
    """Vector tiles of a partitioned dataset."""
    return plans.generate_mvt(_session(spark), tile_dir, outdir=outdir, **{k: config.resolve("mvt", k, options.get(k)) for k in _MVT})


def build(input: str, outdir: str, *, spark: SparkSession | None = None, **options) -> tuple[TileResult, MVTResult, str | None]:
    """Both, one after the other, and the archive's path if one was made."""
    mvt = {k: options.pop(k) for k in _MVT if k in options}
    tiles = tile(input, outdir, spark=spark, **options)
    made = generate_mvt(outdir, spark=spark, **mvt)
    return tiles, made, Dataset(outdir).pmtiles_path


def export_pmtiles(mvt_dir: str, output_path: str, tile_type: str = "mvt", compression: str = "gzip") -> str:
    pmtiles.export(mvt_dir, output_path, tile_type, compression)
    return str(output_path)


# --- Inspecting -------------------------------------------------------------------


def list_datasets(root: str | Path) -> list[str]:
    """Names of the folders with tiles; none where there is no such root."""
    root = Path(root)
    if not root.exists():
        return []
    if not root.is_dir():
        raise NotADirectoryError(str(root))
    return sorted(p.name for p in root.iterdir() if (p / "parquet_tiles").is_dir())


def search_datasets(root: str | Path, text: str | None = None) -> list[dict]:
    """id, title and bytes of the datasets whose name holds a text."""
    found = [n for n in list_datasets(root) if text is None or text.lower() in n.lower()]
    return [{"id": n, "name": n.replace("_", " ").title(), "size": _size(Path(root) / n)[0]} for n in found]


def _size(root: Path) -> tuple[int, int]:
    files = [p for p in root.rglob("*") if p.is_file()]
    return sum(p.stat().st_size for p in files), len(files)


def get_dataset_metadata(dataset_dir: str | Path) -> dict:
    root = Path(dataset_dir)
    out = {"name": root.name, "path": str(root), "exists": root.is_dir(), "size_bytes": 0, "file_count": 0, "parquet_tile_count": 0, "bbox": None, "zoom_levels": [], "has_histograms": False, "has_mvt": False, "has_stats": False, "has_summary": False, "parquet_has_bbox": False, "parquet_crs": None, "mvt_tile_count": 0, "histogram_resolution": None, "pmtiles_path": None, "missing": ["dataset_dir", "parquet_tiles", "histograms", "stats"]}
    if not root.is_dir():
        return out
    d = Dataset(root)
    size, n = _size(root)
    there = {"dataset_dir": True, "parquet_tiles": d.num_tiles > 0, "histograms": d.has_histograms, "stats": d.has_stats}
    return out | {"size_bytes": size, "file_count": n, "parquet_tile_count": d.num_tiles, "bbox": list(d.bbox) if d.bbox else None, "zoom_levels": d.zoom_levels, "has_histograms": d.has_histograms, "has_mvt": d.has_mvt, "has_pmtiles": d.has_pmtiles, "has_stats": d.has_stats, "has_summary": get_dataset_summary(root) is not None, "parquet_has_bbox": d.parquet_has_bbox, "parquet_crs": d.parquet_crs, "mvt_tile_count": d.mvt_tile_count, "histogram_resolution": d.histogram_resolution, "pmtiles_path": d.pmtiles_path, "missing": [k for k, v in there.items() if not v]}


def get_dataset_summary(dataset_dir: str | Path) -> dict | None:
    """summary.json of the dataset or of its stats; else one made of the statistics."""
    root = Path(dataset_dir)
    for p in (root / "summary.json", root / "stats" / "summary.json"):
        if p.is_file():
            return json.loads(p.read_text())
    return dataset.summary(root.name, Dataset(root).stats()) if (root / "stats" / "attributes.json").is_file() else None


def estimate_range_count(dataset_dir: str | Path, rectangle: tuple[float, float, float, float], *, rectangle_crs: object = DEGREES) -> float:
    """Vertices in the histogram's cells that a rectangle meets."""
    if len(rectangle) != 4:
        raise ValueError("a rectangle is (xmin, ymin, xmax, ymax)")
    return histogram.estimate(plans.load_prefix(dataset_dir), rectangle, rectangle_crs)


# --- Querying ---------------------------------------------------------------------


def _about(dataset_dir: str | Path, geom_col: str | None) -> tuple[str, object]:
    schema = Dataset(dataset_dir)._schema()
    if schema is None:
        raise FileNotFoundError(f"{dataset_dir} has no tiles")
    column = geom_col if geom_col in schema.names else geometry_column(schema)
    return column, crs_of(schema, column)


def query_frame(dataset_dir: str | Path, geometry: object, *, geometry_crs: object = DEGREES, geom_col: str | None = None, out_crs: object = DEGREES, spark: SparkSession | None = None) -> DataFrame:
    """Rows that meet a region, as a DataFrame: files by the manifest, row groups by the box columns, rows exactly. Geometry comes in ``out_crs``; None: as it is stored."""
    column, crs = _about(dataset_dir, geom_col)
    box = wkb.bounds(predicates.region_in(geometry, geometry_crs, crs))
    rows = geoparquet.read_tiles(_session(spark), str(dataset_dir), box, column)
    found = predicates.without_internal(predicates.range_filter(rows, geometry, geometry_crs, crs, column))
    return found if out_crs is None else found.withColumn(column, st_transform(F.col(column), crs, out_crs))


def query_dataset(dataset_dir: str | Path, geometry: object, *, geometry_crs: object = DEGREES, geom_col: str | None = None, batch_size: int | None = None, out_crs: object = DEGREES, spark: SparkSession | None = None) -> Iterator[pd.DataFrame]:
    """The same in pandas batches, geometry as WKB; one partition at a time is on the driver."""
    df = query_frame(dataset_dir, geometry, geometry_crs=geometry_crs, geom_col=geom_col, out_crs=out_crs, spark=spark)
    held: list = []
    for row in df.toLocalIterator():
        held.append(row)
        if len(held) == (batch_size or 10_000):
            yield pd.DataFrame(held, columns=df.columns)
            held = []
    if held:
        yield pd.DataFrame(held, columns=df.columns)


def query_dataset_count(dataset_dir: str | Path, geometry: object, **options) -> int:
    return query_frame(dataset_dir, geometry, **options).count()


def query_dataset_size(dataset_dir: str | Path, geometry: object, **options) -> int:
    """Bytes of WKB and of the other columns as text: an estimate."""
    column, _ = _about(dataset_dir, options.get("geom_col"))
    return predicates.estimated_size(query_frame(dataset_dir, geometry, **options), column).first()[0]


def get_sample_record(dataset_dir: str | Path, geometry: object, **options) -> dict | None:
    """The first row that meets a region."""
    row = query_frame(dataset_dir, geometry, **options).limit(1).first()
    return None if row is None else row.asDict(recursive=True)


_stores: dict[tuple, object] = {}
_stores_lock = threading.Lock()


def get_tile(dataset_dir: str | Path, z: int, x: int, y: int, *, output: dict | None = None, cache_size: int = 256, extent: int = 4096, buffer: int = 256, feature_capacity: int = 10_000) -> bytes:
    """One vector tile: from memory, the archive, a file, or made of the rows."""
    from geoloom.serving import TileStore

    key = (str(dataset_dir), cache_size, extent, buffer, feature_capacity)
    with _stores_lock:
        if key not in _stores:
            _stores[key] = TileStore(dataset_dir, cache_size, extent, buffer, feature_capacity)
    return _stores[key].get(z, x, y, output)


def generate_single_mvt_tile(dataset_dir: str | Path, tile: tuple[int, int, int], *, feature_capacity: int = 10_000, extent: int = 4096, buffer: int = 256, layer_name: str = "layer0") -> bytes:
    """One vector tile made of the rows, whether or not there is one already."""
    from geoloom.plans.tiles import encode_features
    from geoloom.serving import TileFiles

    files = TileFiles(dataset_dir)
    return encode_features(*tile, files.top(*tile, feature_capacity, buffer / extent), files.crs, extent, buffer, layer_name) or b""


def create_app(data_root: str | Path, **options):
    from geoloom.serving import App

    return App(data_root, **options)


# --- Lifecycle --------------------------------------------------------------------


def _target(datasets_dir: str | Path, name: str) -> Path:
    if not name or Path(name).is_absolute() or ".." in Path(name).parts or name in (".", ""):
        raise ValueError(f"{name!r} is no name of a dataset")
    return Path(datasets_dir) / name


def add_dataset(input_path: str, datasets_dir: str | Path, *, name: str | None = None, overwrite: bool = False, **build_options):
    """Build a dataset under a root; its name is the input's, unless given."""
    target = _target(datasets_dir, name or Path(input_path).name.partition(".")[0])
    if target.exists():
        if not overwrite:
            raise FileExistsError(str(target))
        shutil.rmtree(target)
    return build(input_path, str(target), **build_options)


def delete_dataset(datasets_dir: str | Path, name: str, *, missing_ok: bool = False) -> bool:
    target = _target(datasets_dir, name)
    if not target.exists():
        if missing_ok:
            return False
        raise FileNotFoundError(str(target))
    if not target.is_dir():
        raise NotADirectoryError(str(target))
    shutil.rmtree(target)
    return True


class AsyncDatasetHandle:
    """A build in a thread. Cancelling stops one that hasn't begun; one that runs ends by itself."""

    ENDED = ("cancelled", "succeeded", "failed")

    def __init__(self, run, name: str | None = None) -> None:
        self.name, self.status, self.error, self.cancel_requested = name, "pending", None, False
        self._run, self._result, self._lock = run, None, threading.Lock()
        self._thread = threading.Thread(target=self._work, daemon=True)

    def start(self) -> AsyncDatasetHandle:
        self._thread.start()
        return self

    def _work(self) -> None:
        with self._lock:
            if self.cancel_requested:
                self.status = "cancelled"
                return
            self.status = "running"
        try:
            result = self._run()
        except BaseException as e:  # noqa: BLE001  the caller gets it from result()
            self.error, self.status = e, "failed"
        else:
            self._result, self.status = result, "succeeded"

    def done(self) -> bool:
        return self.status in self.ENDED

    def join(self, timeout: float | None = None) -> bool:
        if self._thread.ident is not None:
            self._thread.join(timeout)
        return self.done()

    def result(self, timeout: float | None = None):
        if not self.join(timeout):
            raise TimeoutError("the build is still running")
        if self.status == "cancelled":
            raise RuntimeError("the build was cancelled")
        if self.error is not None:
            raise self.error
        return self._result

    def cancel(self) -> bool:
        """Whether the request was taken: a build that has ended takes none."""
        with self._lock:
            if self.done():
                return False
            self.cancel_requested = True
            self.status = "cancel_requested" if self.status == "running" else "cancelled" if self._thread.ident is None else self.status
            return True

    def as_dict(self) -> dict:
        return {"name": self.name, "status": self.status, "cancel_requested": self.cancel_requested, "done": self.done(), "error": None if self.error is None else str(self.error)}


def add_dataset_async(input_path: str, datasets_dir: str | Path, **options) -> AsyncDatasetHandle:
    return AsyncDatasetHandle(lambda: add_dataset(input_path, datasets_dir, **options), options.get("name")).start()


__all__ = ["AsyncDatasetHandle", "Dataset", "MVTResult", "TileResult", "add_dataset", "add_dataset_async", "build", "create_app", "delete_dataset", "estimate_range_count", "export_pmtiles", "generate_mvt", "generate_single_mvt_tile", "get_dataset_metadata", "get_dataset_summary", "get_sample_record", "get_temp_dir", "get_tile", "list_datasets", "query_dataset", "query_dataset_count", "query_dataset_size", "query_frame", "search_datasets", "set_temp_dir", "tile"]
