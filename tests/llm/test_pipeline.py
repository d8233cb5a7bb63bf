"""The pipeline, stage by stage, against the same in plain Python."""

import brute
import corpus_pipeline
from oracle import SF
from pyspark.sql import functions as F
from test_corpus_operators import SCHEMA, awkward, items

from geoloom.llm import decontaminate, line_dedup, mixing, ngram_join, toxicity


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    bench = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    toxic = {r["doc_id"] for r in toxicity.score_documents(docs, labels).filter("toxic").collect()}
    rows = [tuple(r) for r in docs.select("doc_id", "text", "source").collect() if r["doc_id"] not in toxic]
    cut = brute.line_dedup([r[:2] for r in rows], line_dedup.MIN_COUNT, line_dedup.MIN_CHARS)
    source = {r[0]: r[2] for r in rows}
    rows = [(d, t, source[d]) for d, t, _, dropped in cut if not (dropped and not t.strip())]
    groups = brute.near_groups([r[:2] for r in rows], ngram_join.N, ngram_join.THRESHOLD)
    rows = [r for r in rows if groups.get(r[0], r[0]) == r[0]]
    d = decontaminate
    leaks = {m[0] for m in brute.bm25_matches([r[:2] for r in rows], bench, d.SEGMENT, d.THRESHOLD, d.OVERLAP, d.GRAM, d.K1, d.B)}
    rows = [r for r in rows if r[0] not in leaks]
    kept = {m[0] for m in brute.mixed(rows, mixing.WEIGHTS, mixing.DEFAULT_WEIGHT, mixing.FRACTION, mixing.TIERS)}
    got = corpus_pipeline.run(spark, SF)
    assert got.columns == docs.columns
    assert sorted((r["doc_id"], r["text"]) for r in got.collect()) == sorted((r[0], r[1]) for r in rows if r[0] in kept)


def test_stage_list():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line dedup", "n-gram Jaccard join", "benchmark decontamination", "mixing sources to target weights"]


def _folder(spark, tmp_path, docs, labels, bench):
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    return str(tmp_path)


def test_awkward_documents(spark, tmp_path):
    """Nulls in every column, empty and long texts, ties, repeated rows, and extra columns named as ours."""
    docs = spark.createDataFrame(awkward(), SCHEMA)
    for name in ("_gone", "_lower", "_copy", "label", "row", "_key", "h", "score", "toxic", "_n_dropped"):
        docs = docs.withColumn(name, F.lit(name))
    sf = _folder(spark, tmp_path, docs, [(i, None, int(i % 5 == 0)) for i in range(1, 30)] + [(None, 1, 1), (2, 1, None)], items())
    stages = spark.read.parquet(f"{sf}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        before = stages
        stages = stage(spark, stages, sf)
        assert stages.columns == docs.columns
        assert stages.select("doc_id", "_gone").exceptAll(before.select("doc_id", "_gone")).isEmpty()
    got = corpus_pipeline.run(spark, sf)
    assert got.columns == docs.columns and 0 < got.count() <= len(awkward())
    assert got.filter("_gone <> '_gone' or h <> 'h'").isEmpty()


def test_empty_tables(spark, tmp_path):
    none = spark.createDataFrame([], SCHEMA)
    assert corpus_pipeline.run(spark, _folder(spark, tmp_path / "a", none, [], [])).count() == 0
    docs = spark.createDataFrame([(i, f"a text of its own, number {i} of many", "en", "src0", 1) for i in range(20)], SCHEMA)
    kept = corpus_pipeline.run(spark, _folder(spark, tmp_path / "b", docs, [], []))
    assert 0 < kept.count() <= 20
