"""GeoParquet tiles: one file for each partition, sorted, with its box in footer and name, and a manifest."""

from __future__ import annotations

import json
import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from geoloom.functions.geometry import BBOX, with_summary
from geoloom.geo.mercator import morton, scaled
from geoloom.operators.predicates import box_meets
from geoloom.shared import removed, shared_path, written
from geoloom.sources.files import exists, file_system

ROW_GROUP = 16_384
SFC_BITS = 16
MANIFEST = "part int, name string, n_rows long, n_bytes long, _bbox_xmin double, _bbox_ymin double, _bbox_xmax double, _bbox_ymax double"
_SUMMARY_ONLY = ("_cx", "_cy", "_npts", "_gtype", "_prio")


def encode_coord(v: float, low: bool) -> str:
    """A coordinate rounded outward to millionths."""
    return f"{(math.floor if low else math.ceil)(v * 1e6) / 1e6:.6f}"


def tile_name(part: int, box: tuple[float, float, float, float]) -> str:
    return f"tile_{part:06d}__" + "_".join(encode_coord(v, i < 2) for i, v in enumerate(box)) + ".parquet"


def name_column(part, xmin, ymin, xmax, ymax) -> Column:
    """``tile_name`` of columns."""
    low = lambda c: F.format_string("%.6f", F.floor(c * 1e6) / F.lit(1e6))
    high = lambda c: F.format_string("%.6f", F.ceil(c * 1e6) / F.lit(1e6))
    return F.concat(F.format_string("tile_%06d__", part), F.concat_ws("_", low(xmin), low(ymin), high(xmax), high(ymax)), F.lit(".parquet"))


def name_bbox(name: Column) -> list[Column]:
    """xmin, ymin, xmax, ymax from a file's name; null if it has none."""
    number = r"(-?\d+(?:\.\d+)?)"
    return [F.regexp_extract(name, rf"__{number}_{number}_{number}_{number}\.(?:geo)?parquet$", i).try_cast("double") for i in range(1, 5)]


def geo_document(column: str, box, crs: object, kinds: set[str]) -> dict:
    """The footer's ``geo`` document."""
    about: dict = {"encoding": "WKB", "geometry_types": sorted(kinds), "bbox": list(box)}
    if crs is not None:
        about["crs"] = crs
    return {"version": "1.1.0", "primary_column": column, "columns": {column: about}}


def with_zorder(df: DataFrame, bits: int = SFC_BITS) -> DataFrame:
    """``df`` with _key: Z-order of the centroid within the box of its own tile; rows without geometry last.

    The boxes are one row for each tile file: an aggregate that is joined, not a window, which would hold a tile's rows in one task.
    """
    boxes = df.groupBy("_tile_id").agg(F.min(BBOX[0]).alias("_x0"), F.min(BBOX[1]).alias("_y0"), F.max(BBOX[2]).alias("_x1"), F.max(BBOX[3]).alias("_y1")).withColumnRenamed("_tile_id", "_of")
    # Columns of their own at each step: each is used many times by the next.
    ends = df.join(F.broadcast(boxes), F.col("_tile_id").eqNullSafe(F.col("_of")), "left")
    at = ends.withColumns({"_zx": scaled(F.col("_cx"), F.col("_x0"), F.col("_x1"), bits), "_zy": scaled(F.col("_cy"), F.col("_y0"), F.col("_y1"), bits)})
    return at.withColumn("_key", F.coalesce(morton(F.col("_zx"), F.col("_zy"), bits), F.lit(2**63 - 1))).drop("_x0", "_y0", "_x1", "_y1", "_zx", "_zy", "_of")


#: Bytes of rows that one task sorts, about, and bytes of a row besides its columns of any length.
PIECE_BYTES, ROW_BYTES = 64 << 20, 160


def _row_bytes(df: DataFrame) -> Column:
    """About the bytes of a row in memory."""
    long = [F.coalesce(F.octet_length(F.col(f"`{c}`")), F.lit(0)) for c, t in df.dtypes if t in ("binary", "string")]
    return sum(long, F.lit(ROW_BYTES)).cast("long")


def write_tiles(df: DataFrame, path: str, geom_col: str = "geometry", crs: object = None, sort: str = "zorder", sort_keys: list[str] | None = None, covering_bbox: bool = True, compression: str = "zstd", row_group: int = ROW_GROUP, sfc_bits: int = SFC_BITS, stored: bool = False) -> DataFrame:
    """Write ``df`` (with the summary's columns and ``_tile_id``) as one file for each tile; gives the manifest.

    The rows are written once to the shared folder (unless they are ``stored``: cheap to read again), then shuffled by tile and sort key in
    ranges of bounded size: a task sorts ``PIECE_BYTES`` of rows, however large a tile is.
    A tile in several ranges is put together from their pieces, row group by row group.
    A file gets its name when it is whole, so that a task that is done again replaces what
    it had written. ``sort``: zorder (hilbert means the same), columns (with
    ``sort_keys``, ``-name`` descending) or none.
    """
    if sort not in ("zorder", "hilbert", "none", "columns"):
        raise ValueError(f"sort {sort!r}: zorder, hilbert, columns or none")
    spark = df.sparkSession
    placed = df = df if stored else written(df, "placed")
    keys: list[Column] = []
    if sort in ("zorder", "hilbert"):
        df = with_zorder(df, sfc_bits)
        keys = [F.asc("_key")]
    elif sort == "columns":
        keys = [F.desc(k[1:]) if k.startswith("-") else F.asc(k) for k in sort_keys or []]
    tiles, most, total = placed.groupBy("_tile_id").agg(F.sum(_row_bytes(placed)).alias("b")).agg(F.count("*"), F.max("b"), F.sum("b")).first()
    whole = not most or most <= PIECE_BYTES
    if whole:
        df = df.repartition("_tile_id").sortWithinPartitions("_tile_id", *keys)
    else:
        # Rows of one key are cut as well: by a hash of theirs.
        tie = F.xxhash64(*[F.col(f"`{c}`") for c, t in placed.dtypes if not t.startswith(("map", "variant"))])
        df = df.withColumn("_tie", tie).repartitionByRange(min(10_000, max(tiles, -(-total // PIECE_BYTES))), "_tile_id", *keys, "_tie").sortWithinPartitions("_tile_id", *keys, "_tie").drop("_tie")
    df = df.drop("_key")
    drop = {*_SUMMARY_ONLY, "_tile_id", *(() if covering_bbox else BBOX)}
    tiles_path = f"{path}/parquet_tiles"

    def run(batches) -> Iterator[pa.RecordBatch]:
        fs, root = file_system(tiles_path)
        fs.create_dir(root, recursive=True)
        out: list[tuple] = []
        state: dict = {}

        def close() -> None:
            if not state:
                return
            flush(True)
            box = state["box"] if np.isfinite(state["box"]).all() else [0.0] * 4
            state["writer"].add_key_value_metadata({"geo": json.dumps(geo_document(geom_col, box, crs, state["kinds"]))})
            state["writer"].close()
            state["file"].close()
            name = tile_name(state["part"], box)
            if fs.get_file_info(f"{root}/{name}").type.name != "NotFound":
                fs.delete_file(f"{root}/{name}")
            fs.move(state["temp"], f"{root}/{name}")
            out.append((state["part"], name, state["rows"], fs.get_file_info(f"{root}/{name}").size, *box))
            state.clear()

        def flush(all_: bool) -> None:
            table = pa.Table.from_batches(state["held"]) if state["held"] else None
            at = 0
            while table is not None and (table.num_rows - at >= row_group or (all_ and at < table.num_rows)):
                state["writer"].write_table(table.slice(at, row_group), row_group_size=row_group)
                at += row_group
            state["held"] = table.slice(min(at, table.num_rows)).combine_chunks().to_batches() if table is not None else []
            state["n_held"] = sum(b.num_rows for b in state["held"])

        for batch in batches:
            part = np.asarray(batch.column("_tile_id"))
            cut = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(part)]
            keep = [n for n in batch.schema.names if n not in drop]
            for a, b in zip(cut, cut[1:]):
                if a == b:
                    continue
                piece = batch.slice(a, b - a)
                if state and state["part"] != part[a]:
                    close()
                rows = piece.select(keep)
                if not state:
                    temp = f"{root}/.{uuid.uuid4().hex}.part"
                    file = fs.open_output_stream(temp)
                    state.update(part=int(part[a]), temp=temp, file=file, writer=pq.ParquetWriter(file, rows.schema, compression=compression), rows=0, held=[], n_held=0, kinds=set(), box=np.array([np.inf, np.inf, -np.inf, -np.inf]))
                state["held"].append(rows)
                state["rows"] += rows.num_rows
                state["n_held"] += rows.num_rows
                b4 = [np.asarray(piece.column(c).cast(pa.float64())) for c in BBOX]
                if not all(np.isnan(c).all() for c in b4):
                    state["box"] = np.array([min(state["box"][0], np.nanmin(b4[0])), min(state["box"][1], np.nanmin(b4[1])), max(state["box"][2], np.nanmax(b4[2])), max(state["box"][3], np.nanmax(b4[3]))])
                state["kinds"] |= {x for x in piece.column("_gtype").unique().to_pylist() if x} if "_gtype" in piece.schema.names else set()
                if state["n_held"] >= row_group:
                    flush(False)
        close()
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*[[x if not isinstance(x, np.generic) else x.item() for x in r] for r in out])], [f.split()[0] for f in MANIFEST.split(", ")]).cast(_manifest_schema())

    if whole:
        df.mapInArrow(run, MANIFEST).write.mode("overwrite").parquet(f"{path}/_manifest")
    else:
        at = shared_path(spark, "pieces")
        pieces = df.mapInArrow(_pieces(at), "tile long, place long, name string").collect()
        # One row for each piece of bounded size; a task for each tile.
        listed = spark.createDataFrame([tuple(r) for r in pieces], "tile long, place long, name string").repartitionByRange(tiles, "tile").sortWithinPartitions("tile", "place")
        listed.mapInArrow(lambda batches: run(_read_pieces(at, batches)), MANIFEST).write.mode("overwrite").parquet(f"{path}/_manifest")
        fs, root = file_system(at)
        fs.delete_dir(root)
    if not stored:
        removed(placed)
    return manifest(spark, path)


def _pieces(at: str):
    """Writes the rows that a task gets, sorted, as a file for each tile among them: tile, number of the task's range, name."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        place = TaskContext.get().partitionId()
        fs, root = file_system(at)
        fs.create_dir(root, recursive=True)
        out: list[tuple[int, int, str]] = []
        file = writer = None
        for batch in batches:
            part = np.asarray(batch.column("_tile_id"))
            cut = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(part)]
            for a, b in zip(cut, cut[1:]):
                if a == b:
                    continue
                if writer is None or out[-1][0] != part[a]:
                    if writer is not None:
                        writer.close()
                        file.close()
                    # A task that is done again writes files of other names; those of the one that counts are read.
                    out.append((int(part[a]), place, f"{uuid.uuid4().hex}.arrow"))
                    file = fs.open_output_stream(f"{root}/{out[-1][2]}")
                    writer = pa.ipc.new_stream(file, batch.schema, options=pa.ipc.IpcWriteOptions(compression="lz4"))
                writer.write_batch(batch.slice(a, b - a))
        if writer is not None:
            writer.close()
            file.close()
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), (pa.int64(), pa.int64(), pa.string()))], ["tile", "place", "name"])

    return run


def _read_pieces(at: str, batches) -> Iterator[pa.RecordBatch]:
    """The rows of pieces, one after another."""
    fs, root = file_system(at)
    for listed in batches:
        for name in listed.column("name").to_pylist():
            with fs.open_input_stream(f"{root}/{name}") as f, pa.ipc.open_stream(f) as stream:
                yield from stream


def _manifest_schema() -> pa.Schema:
    kinds = {"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "double": pa.float64()}
    return pa.schema([(n, kinds[k]) for n, k in (f.split() for f in MANIFEST.split(", "))])


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """part, name, rows, bytes and box of each tile; from the files' names where there is no manifest."""
    if exists(f"{path}/_manifest"):
        return spark.read.schema(MANIFEST).parquet(f"{path}/_manifest")
    from geoloom.sources.files import files

    rows = [(p.rpartition("/")[2], n) for p, n in files(f"{path}/parquet_tiles") if p.endswith(("parquet",))]
    named = spark.createDataFrame(rows, "name string, n_bytes long")
    part = F.coalesce(F.regexp_extract("name", r"^tile_(\d+)", 1).try_cast("int"), F.lit(-1))
    return named.select(part.alias("part"), "name", F.lit(None).cast("long").alias("n_rows"), "n_bytes", *[b.alias(c) for b, c in zip(name_bbox(F.col("name")), BBOX)])


def tile_paths(spark: SparkSession, path: str, box: tuple[float, float, float, float] | None = None) -> list[str]:
    """Files whose box meets ``box``, and those whose box isn't known."""
    m = manifest(spark, path)
    if box is not None:
        m = m.filter(box_meets(box) | F.col(BBOX[0]).isNull())
    return [f"{path}/parquet_tiles/{r[0]}" for r in m.select("name").orderBy("name").toLocalIterator()]


def read_tiles(spark: SparkSession, path: str, box: tuple[float, float, float, float] | None = None, geom_col: str = "geometry") -> DataFrame:
    """The rows of the tiles that ``box`` meets, with box columns; these are computed where the files lack them."""
    paths = tile_paths(spark, path, box)
    if not paths:
        every = tile_paths(spark, path)
        if not every:
            raise FileNotFoundError(f"{path}: no tiles")
        df = spark.read.parquet(every[0]).filter(F.lit(False))
    else:
        df = spark.read.parquet(*paths)
    return df if BBOX[0] in df.columns else with_summary(df, geom_col)
