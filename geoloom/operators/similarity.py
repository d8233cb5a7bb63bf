"""Vectors: unit length, and the nearest by cosine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Stands for a length of 0 in a quotient.
TINY = 1e-12


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def normalised(v: Column) -> Column:
    """A vector of length 1; a vector of zeros stays one."""
    return F.transform(v, lambda x: x.cast("double") / F.greatest(norm(v), F.lit(TINY)))


def cosine_top_k(vectors: DataFrame, query: list[float], k: int, id_col: str, vector_col: str = "embedding") -> DataFrame:
    """id and cosine of the k nearest rows; ties to the lower id. Each task keeps k rows, so k * tasks rows meet.

    Null vectors, and those of another length than the query's, are left out.
    """
    v, q = F.col(vector_col), F.array(*[F.lit(float(x)) for x in query])
    length = max(sum(float(x) ** 2 for x in query) ** 0.5, TINY)
    score = dot(v, q) / (F.greatest(norm(v), F.lit(TINY)) * F.lit(length))
    return vectors.filter(F.size(v) == len(query)).select(F.col(id_col), score.alias("cosine")).orderBy(F.desc("cosine"), id_col).limit(k)
