"""GeoJSON by byte ranges: every feature is read by the range in which it begins.

Works on feature collections and on a feature per line, files or folders of them. A
range looks for ``"type": "Feature"`` and takes the object around it; what a string
holds is never taken, nor an object that is the value of another's key.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from decimal import Decimal

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from geoloom.geo import wkb
from geoloom.sources.files import files, read_bytes

SPLIT = 32 << 20
_FEATURE = re.compile(r'"type"\s*:\s*"Feature"')
_DECODE = json.JSONDecoder().raw_decode
_TAIL = 1 << 20
BATCH = 1000
#: Bytes of ranges that one task takes at least, when there are many small ones.
TASK = 4 << 20


def features(path: str, offset: int, length: int, size: int) -> Iterator[str]:
    """The features that begin within a range of the file, as text."""
    end = min(size, offset + length)
    # What is read behind a range is no more than the range, or small ones would read the file many times over.
    step = min(_TAIL, max(4096, length))
    tail = min(size, end + step)
    # One byte is one character here, so places in the text are places in the file.
    text = read_bytes(path, max(0, offset - 64), tail - max(0, offset - 64)).decode("latin-1")
    before, text = text[: min(64, offset)], text[min(64, offset) :]
    at = floor = 0
    while True:
        m = _FEATURE.search(text, at)
        if m is None and offset + len(text) < size and at < length:
            # The last feature may name its type behind what has been read.
            text += read_bytes(path, offset + len(text), max(step, len(text) // 2)).decode("latin-1")
            continue
        if m is None:
            return
        found = None
        brace = text.rfind("{", floor, m.start())
        while brace >= 0:
            try:
                value, stop = _DECODE(text, brace)
            except ValueError:
                if offset + len(text) < size:
                    more = read_bytes(path, offset + len(text), max(step, len(text) // 2)).decode("latin-1")
                    text += more
                    continue
                value, stop = None, 0
            if stop > m.start() and isinstance(value, dict) and value.get("type") == "Feature" and "geometry" in value:
                if (before + text[max(0, brace - 64) : brace]).rstrip()[-1:] != ":":
                    found = (brace, stop)
                    break
            brace = text.rfind("{", floor, brace)
        if found is None:
            at = m.end()
            if at >= length:
                return
            continue
        if found[0] >= length:
            return
        yield text[found[0] : found[1]].encode("latin-1").decode("utf-8", "replace")
        at = floor = found[1]


def _canonical(v) -> str:
    return json.dumps(v, separators=(",", ":"), sort_keys=True, ensure_ascii=False)


def _kind(v) -> str:
    if v is None:
        return "null"
    if isinstance(v, bool):
        return "boolean"
    if isinstance(v, int):
        return "long" if -(2**63) <= v < 2**63 else "double"
    if isinstance(v, (float, Decimal)):
        return "double"
    return "string"


def merged_kind(kinds: set[str]) -> str:
    """One type for a property: whole numbers and others are double, all else that differs is text."""
    kinds = kinds - {"null"}
    if len(kinds) == 1:
        return kinds.pop()
    return "double" if kinds == {"long", "double"} else "string"


def _value(v, kind: str):
    if v is None:
        return None
    if kind == "string":
        return v if isinstance(v, str) else _canonical(v) if isinstance(v, (dict, list)) else json.dumps(v) if isinstance(v, bool) else str(v)
    return float(v) if kind == "double" else v


def column_name(name: str) -> str:
    """A property named as the geometry column gets another name."""
    return "geometry_1" if name == "geometry" else name


def _ranges(spark: SparkSession, path: str, split: int) -> DataFrame:
    rows = [(p, at, split, n) for p, n in files(path) for at in range(0, max(n, 1), split)]
    df = spark.createDataFrame(rows, "path string, at long, length long, size long")
    tasks = min(len(rows), max(64, sum(min(split, n - at) for _, at, split, n in rows) // TASK), 10_000)
    return df.repartitionByRange(tasks, "path", "at") if len(rows) > 1 else df.coalesce(1)


def _each(batches) -> Iterator[dict]:
    for batch in batches:
        for r in batch.to_pylist():
            for text in features(r["path"], r["at"], r["length"], r["size"]):
                yield json.loads(text)


def crs_of(path: str) -> object:
    """The collection's ``crs`` member, if its beginning has one."""
    first = files(path)
    head = read_bytes(first[0][0], 0, 4096).decode("utf-8", "replace") if first else ""
    m = re.search(r'"crs"\s*:\s*\{[^{}]*\{[^{}]*"name"\s*:\s*"([^"]+)"', head)
    return m[1] if m else None


def schema_of(ranges: DataFrame) -> T.StructType:
    """Properties of all features, in order of their names."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[str, str]] = set()
        for f in _each(batches):
            seen |= {(k, _kind(v)) for k, v in (f.get("properties") or {}).items()}
        if seen:
            names, kinds = zip(*sorted(seen))
            yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(kinds)], ["name", "kind"])

    kinds: dict[str, set[str]] = {}
    for name, kind in ranges.mapInArrow(run, "name string, kind string").distinct().collect():
        kinds.setdefault(name, set()).add(kind)
    types = {"long": T.LongType(), "double": T.DoubleType(), "boolean": T.BooleanType(), "string": T.StringType()}
    return T.StructType([T.StructField("geometry", T.BinaryType())] + [T.StructField(n, types[merged_kind(k)]) for n, k in sorted(kinds.items())])


def read(spark: SparkSession, path: str, split: int = SPLIT) -> tuple[DataFrame, object]:
    """geometry and all properties; nested values as compact JSON with sorted keys. Null geometry stays null."""
    ranges = _ranges(spark, path, split)
    schema = schema_of(ranges)
    names = [(f.name, f.dataType.simpleString().replace("bigint", "long")) for f in schema.fields[1:]]
    out = T.StructType([schema.fields[0]] + [T.StructField(column_name(f.name), f.dataType) for f in schema.fields[1:]])
    arrow = {"long": pa.int64(), "double": pa.float64(), "boolean": pa.bool_(), "string": pa.string()}

    def geometry(f):
        try:
            g = wkb.from_geojson(f.get("geometry"))
        except (ValueError, TypeError, KeyError):
            return None
        return None if g is None else wkb.encode(g)

    def batch(rows: list[dict]) -> pa.RecordBatch:
        arrays = [pa.array([geometry(f) for f in rows], pa.binary())]
        arrays += [pa.array([_value((f.get("properties") or {}).get(n), k) for f in rows], arrow[k]) for n, k in names]
        return pa.RecordBatch.from_arrays(arrays, out.names)

    def run(batches) -> Iterator[pa.RecordBatch]:
        rows: list[dict] = []
        for f in _each(batches):
            rows.append(f)
            if len(rows) == BATCH:
                yield batch(rows)
                rows = []
        if rows:
            yield batch(rows)

    return ranges.mapInArrow(run, out), crs_of(path)
