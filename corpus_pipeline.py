"""A training corpus from raw documents, in stages.

Each stage takes (spark, docs, sf_dir) and returns what it keeps of ``docs`` with all
their columns. ``run`` writes every stage's result to the shared folder before the
next one reads it, so that a lost executor costs no more than the stage at hand.

Defined results
  * Rows are kept or left out whole, with all columns of ``documents`` in their order,
    extra ones of any name too; only line dedup changes ``text``, and ``n_chars`` with it.
  * Null and empty texts are never toxic, a near copy or a leak: they pass all stages but
    mixing, which keeps or drops them by their hash as it does others. Texts of any
    length are taken whole.
  * Rows with null doc_id, and rows that repeat a doc_id, are scored, cut and filtered one
    by one; in the near-copy stage they stay or go as their doc_id does (null stays).
  * A document whose lines were all dropped as repeated goes; one that was empty before stays.
  * Ties fall as each operator says (the lower doc_id, the least hash).
  * Empty ``documents`` give an empty result; without ``labels`` nothing is toxic; without
    ``benchmark`` nothing is a leak.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from geoloom.llm import decontaminate, line_dedup, mixing, ngram_join, toxicity
from geoloom.llm.common import read, removed, written


def _toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.reject_toxic(docs, read(spark, sf_dir, "labels"))


def _lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return line_dedup.dedup(docs, drop_empty=True)


def _near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.keep_one(docs)


def _benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminate(docs, read(spark, sf_dir, "benchmark"))


def _mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_documents(docs)


STAGES = [
    ("toxicity", _toxicity),
    ("line dedup", _lines),
    ("n-gram Jaccard join", _near_duplicates),
    ("benchmark decontamination", _benchmark),
    ("mixing sources to target weights", _mixing),
]

#: Nearest neighbours and calibration can't be put as SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    before = None
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
        if before is not None:
            removed(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
