"""What the corpus operators share: reading, shared folders, columns."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geoloom.session import prepare
from geoloom.shared import removed, shared_path, written
from geoloom.sources.files import file_system


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def documents(df: DataFrame, lower: bool = False) -> DataFrame:
    """doc_id as long and text alone, so that extra columns of any name can't clash."""
    text = F.col("text").cast("string")
    return df.select(F.col("doc_id").cast("long").alias("doc_id"), (F.lower(text) if lower else text).alias("text"))


def lowered(df: DataFrame) -> DataFrame:
    """``df`` with its lower-cased text behind its columns, as ``documents`` gives it, under a name that is free."""
    return df.withColumn(free_name(df, "_lower"), F.lower(F.col("text").cast("string")))


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with as many underscores before it as it takes to be no column of ``df``."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def write_array(root: str, name: str, pieces: Iterator[np.ndarray]) -> None:
    """A file of the pieces' bytes, named when it is whole."""
    fs, folder = file_system(root)
    fs.create_dir(folder, recursive=True)
    temp = f"{folder}/.{uuid.uuid4().hex}"
    with fs.open_output_stream(temp) as f:
        for x in pieces:
            f.write(np.ascontiguousarray(x).tobytes())
    if fs.get_file_info(f"{folder}/{name}").type != pafs.FileType.NotFound:
        fs.delete_file(f"{folder}/{name}")
    fs.move(temp, f"{folder}/{name}")


def read_array(root: str, name: str, dtype: type) -> np.ndarray:
    """What ``write_array`` has written: mapped if the file is on this machine's file system, else read whole."""
    fs, folder = file_system(root)
    if isinstance(fs, pafs.LocalFileSystem):
        size = fs.get_file_info(f"{folder}/{name}").size
        return np.asarray(np.memmap(f"{folder}/{name}", dtype, "r")) if size else np.zeros(0, dtype)
    with fs.open_input_file(f"{folder}/{name}") as f:
        return np.frombuffer(f.read(), dtype)


class Lookup:
    """The sorted longs of a table's first column, and those of the others beside them, in files that processes map.

    One task writes them from rows sorted by Spark; neither the driver nor any heap holds
    them, whatever their number, and what is looked up needn't be shuffled.
    """

    def __init__(self, table: DataFrame, name: str) -> None:
        self.spark, self.names = table.sparkSession, table.columns
        self.root = root = shared_path(self.spark, name)
        names = self.names

        def run(batches) -> Iterator[pa.RecordBatch]:
            fs, folder = file_system(root)
            fs.create_dir(folder, recursive=True)
            tag, n = uuid.uuid4().hex, 0
            files = [fs.open_output_stream(f"{folder}/.{tag}-{c}") for c in names]
            for batch in batches:
                n += batch.num_rows
                for f, column in zip(files, batch.columns):
                    f.write(np.asarray(column).astype(np.int64).tobytes())
            for f, c in zip(files, names):
                f.close()
                if fs.get_file_info(f"{folder}/{c}").type != pafs.FileType.NotFound:
                    fs.delete_file(f"{folder}/{c}")
                fs.move(f"{folder}/.{tag}-{c}", f"{folder}/{c}")
            yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], ["n"])

        one = table.select(*[F.col(c).cast("long").alias(c) for c in names]).repartition(1).sortWithinPartitions(*names)
        self.rows = sum(r[0] for r in one.mapInArrow(run, "n long").collect())

    def __getstate__(self) -> dict:
        return {"root": self.root, "names": self.names, "rows": self.rows}

    def columns(self) -> list[np.ndarray]:
        if not self.rows:
            return [np.zeros(0, np.int64) for _ in self.names]
        return [read_array(self.root, c, np.int64) for c in self.names]

    def spans(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the rows of each id begin and end."""
        keys = self.columns()[0]
        return np.searchsorted(keys, ids, "left"), np.searchsorted(keys, ids, "right")

    def has(self, ids: np.ndarray) -> np.ndarray:
        begin, end = self.spans(ids)
        return end > begin

    def removed(self) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.root)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def replace_column(batch: pa.RecordBatch, name: str, values: pa.Array) -> pa.RecordBatch:
    i = batch.schema.get_field_index(name)
    return batch.set_column(i, batch.schema.field(i), values.cast(batch.schema.field(i).type))


__all__ = ["Lookup", "documents", "free_name", "lowered", "read", "read_array", "removed", "replace_column", "shared_path", "write_array", "written"]
