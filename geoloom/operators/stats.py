"""Column statistics: one aggregate over all columns, and one over their frequent values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

TOP_K, TOP_SHARE = 20, 0.8
#: Relative error of a HyperLogLog of 2**12 registers.
RSD = 0.0173


def role_of(kind: T.DataType) -> str:
    """Which statistics a type has; all that is none of these is counted as text of categories."""
    if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType)):
        return "numeric"
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return "temporal"
    return "text" if isinstance(kind, T.StringType) else "categorical"


def text_of(df: DataFrame, name: str) -> Column:
    """A value as text; times in ISO form."""
    c, kind = F.col(f"`{name}`"), df.schema[name].dataType
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        return F.when(~F.isnan(c), c).cast("string")
    if isinstance(kind, (T.ArrayType, T.MapType, T.StructType)):
        return F.to_json(c)
    return c.cast("string")


def column_statistics(df: DataFrame, columns: list[str]) -> dict[str, dict]:
    """Per column: number, distinct number and what else its role has. One pass."""
    if not columns:
        return {}
    aggs = []
    for name in columns:
        c, kind = F.col(f"`{name}`"), df.schema[name].dataType
        role, text = role_of(kind), text_of(df, name)
        v = F.when(~F.isnan(c), c) if isinstance(kind, (T.FloatType, T.DoubleType)) else c
        fields = {"non_null_count": F.count(v), "approx_distinct": F.approx_count_distinct(text, RSD)}
        if role == "numeric":
            fields |= {"min": F.min(v).cast("double"), "max": F.max(v).cast("double"), "mean": F.avg(v), "stddev": F.coalesce(F.stddev_pop(v), F.lit(0.0))}
        elif role == "text":
            fields |= {"avg_length": F.coalesce(F.avg(F.char_length(c)), F.lit(0.0)), "min_length": F.min(F.char_length(c)), "max_length": F.max(F.char_length(c))}
        elif role == "temporal":
            fields |= {"min": F.min(text), "max": F.max(text)}
        aggs.append(F.struct(*[x.alias(k) for k, x in fields.items()]).alias(name))
    row = df.agg(*aggs).first()
    top = top_values(df, columns)
    return {n: {**row[n].asDict(), "top_k": top.get(n, [])} for n in columns}


def value_counts(df: DataFrame, columns: list[str], k: int = TOP_K) -> DataFrame:
    """name, value, n, total: the k most frequent values of each column; ties in order of the value."""
    pairs = df.select(F.explode(F.array(*[F.struct(F.lit(n).alias("name"), text_of(df, n).alias("value")) for n in columns])).alias("p")).select("p.*").filter("value is not null")
    counts = pairs.groupBy("name", "value").agg(F.count("*").alias("n"))
    totals = counts.groupBy("name").agg(F.sum("n").alias("total"))
    ranked = counts.withColumn("rank", F.row_number().over(W.partitionBy("name").orderBy(F.desc("n"), "value"))).filter(F.col("rank") <= k)
    return ranked.join(totals, "name").select("name", "value", "n", "total", "rank")


def top_values(df: DataFrame, columns: list[str], k: int = TOP_K, share: float = TOP_SHARE) -> dict[str, list[dict]]:
    """The frequent values of columns in which they make up at least ``share`` of all; none of the others.

    A sketch first tells columns that can't reach the share (ids, prices), so that only
    the values of the others are shuffled and counted.
    """
    columns = _concentrated(df, columns, k, share)
    if not columns:
        return {}
    found: dict[str, list] = {}
    for r in value_counts(df, columns, k).orderBy("name", "rank").collect():
        found.setdefault(r["name"], []).append(r)
    return {n: [{"value": r["value"], "count": r["n"]} for r in rows] for n, rows in found.items() if sum(r["n"] for r in rows) >= share * rows[0]["total"]}


#: Items that the sketch of frequent values tracks, and what its estimates may miss of all values.
TRACKED, MISSED = 10_000, 0.02


def _concentrated(df: DataFrame, columns: list[str], k: int, share: float) -> list[str]:
    """Columns whose ``k`` most frequent values may make up ``share`` of all."""
    texts = df.select(*[text_of(df, n).alias(f"c{i}") for i, n in enumerate(columns)])
    row = texts.agg(*[F.struct(F.count(f"c{i}").alias("n"), F.expr(f"approx_top_k(c{i}, {k}, {TRACKED})").alias("top")).alias(f"c{i}") for i in range(len(columns))]).first()
    return [n for n, (total, top) in zip(columns, row) if total and sum(x["count"] for x in top or [] if x["item"] is not None) >= (share - MISSED) * total]


def geometry_statistics(df: DataFrame) -> dict:
    """Box, types and vertices of the decodable geometries; ``df`` has the summary's columns."""
    types = {r["_gtype"]: r["n"] for r in df.filter("_gtype is not null").groupBy("_gtype").agg(F.count("*").alias("n")).collect()}
    b = df.agg(F.min("_bbox_xmin"), F.min("_bbox_ymin"), F.max("_bbox_xmax"), F.max("_bbox_ymax"), F.coalesce(F.sum("_npts"), F.lit(0))).first()
    return {"mbr": list(b[:4]) if b[0] is not None else None, "geom_types": dict(sorted(types.items())), "total_points": b[4]}


def attribute_statistics(df: DataFrame, geom_col: str | None = "geometry", places: DataFrame | None = None) -> dict:
    """The document that a dataset keeps: a list of columns with their statistics.

    ``places`` has the summary's columns if ``df`` hasn't; so geometry isn't read again.
    """
    names = [f.name for f in df.schema.fields if f.name != geom_col and not f.name.startswith(("_bbox_", "_tile_id")) and f.name not in ("_cx", "_cy", "_npts", "_gtype", "_prio")]
    stats = column_statistics(df, names)
    out = [{"name": n, "stats": stats[n]} for n in names]
    if geom_col in df.columns:
        out.insert(0, {"name": geom_col, "role": "geometry", "stats": geometry_statistics(df if places is None else places)})
    return {"attributes": out}
