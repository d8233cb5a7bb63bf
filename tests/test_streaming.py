"""Streams against the same work on a table."""

from pyspark.sql import functions as F

from geoloom.functions.geometry import st_point
from geoloom.operators.partition import KDTree
from geoloom.sinks.geoparquet import manifest
from geoloom.streaming.ingest import append_tiles, cell_counts, windowed_cell_counts


def points(spark):
    return spark.range(200).select("id", F.expr("cast((id*7919)%360 as double)-180").alias("lon"), F.expr("cast((id*104729)%170 as double)-85").alias("lat"), F.timestamp_seconds(F.col("id") * 60).alias("ts"))


def stream(spark, tmp_path):
    for i in range(2):
        points(spark).filter(F.col("id") % 2 == i).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    return spark.readStream.schema(points(spark).schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))


def test_running_histogram(spark, tmp_path):
    q = cell_counts(stream(spark, tmp_path), 8).writeStream.outputMode("complete").format("memory").queryName("cells").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert sorted(map(tuple, spark.table("cells").collect())) == sorted(map(tuple, cell_counts(points(spark), 8).collect()))


def test_windows_drop_late_rows(spark, tmp_path):
    df = windowed_cell_counts(stream(spark, tmp_path), 4, "ts", "1 hour", "10 minutes")
    q = df.writeStream.outputMode("append").format("memory").queryName("windows").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert 0 < spark.table("windows").agg(F.sum("n")).first()[0] < 200


def test_appended_tiles(spark, tmp_path):
    shapes = stream(spark, tmp_path).select("id", st_point("lon", "lat").alias("geometry"))
    q = append_tiles(shapes, KDTree([0], [0.0], [-1], [-2], 2), str(tmp_path / "out"), str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sum(manifest(spark, f"{tmp_path}/out/batch={i}").agg(F.sum("n_rows")).first()[0] for i in range(2)) == 200
