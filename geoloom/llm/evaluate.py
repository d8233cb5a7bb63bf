"""Held-out figures of the toxicity operator: ``python -m geoloom.llm.evaluate FOLDER``."""

from __future__ import annotations

import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from geoloom.llm import toxicity
from geoloom.llm.common import read


def held_out(spark: SparkSession, sf_dir: str, **parameters) -> list[tuple[int, float, float, int]]:
    """Of either half of the labels (by a hash of doc_id), scored by a model of the other: half, recall, false positives, documents without neighbours."""
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels").select("doc_id", "toxic").dropna()
    half = F.pmod(F.xxhash64("doc_id"), F.lit(2))
    out = []
    for h in (0, 1):
        scored = toxicity.score_documents(docs, labels.filter(half != h), **parameters).select("doc_id", F.col("toxic").alias("found"), F.size("neighbours").alias("n"))
        r = scored.join(labels.filter(half == h), "doc_id").agg(F.avg(F.when(F.col("toxic") == 1, F.col("found").cast("int"))), F.avg(F.when(F.col("toxic") == 0, F.col("found").cast("int"))), F.count_if(F.col("n") == 0)).first()
        out.append((h, round(r[0], 4), round(r[1], 4), r[2]))
    return out


if __name__ == "__main__":
    from geoloom.session import local_session

    session = local_session("4", "4g", 8)
    session.sparkContext.setLogLevel("ERROR")
    for by_label in (True, False):
        print("by_label", by_label, held_out(session, sys.argv[1], by_label=by_label))
    session.stop()
