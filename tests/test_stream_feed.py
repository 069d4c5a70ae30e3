"""Streams over replayed tables: micro-batches are written and read by many tasks, and state lasts from one to the next."""

import glob

from pyspark.sql import functions as F

from palaver import session
from palaver.catalog import CATALOG
from palaver.catalog.base import Source
from palaver.streaming.dedup import stream_dedup_quarantine


def test_a_micro_batch_has_several_files(spark, tmp_path, monkeypatch):
    spark.range(0, 400, 1, 4).select(
        F.col("id").alias("event_id"), (F.col("id") % 20).alias("user_id"), F.lit("2024-01-01 00:00:00").cast("timestamp_ntz").alias("ts"),
        F.when((F.col("id") == 399), "other").otherwise("same").alias("event_type")).write.parquet(f"{tmp_path}/t/events.parquet")
    monkeypatch.setattr(session, "checkpoint_dir", lambda spark: f"{tmp_path}/kept")
    found = {r["key"]: r["conflict"] for r in CATALOG["st01_stream_dedup"].run(Source(spark, f"{tmp_path}/t")).collect()}
    assert found == {str(k): k == 19 for k in range(20)}
    assert len(glob.glob(f"{tmp_path}/kept/palaver-stream-dedup-*/in/**/*.parquet", recursive=True)) > 4  # four micro-batches
    assert len(glob.glob(f"{tmp_path}/kept/palaver-stream-dedup-*/out/batch=*")) == 4


def test_state_lasts_and_null_hashes_contradict(spark, tmp_path):
    schema, log = "k string, h string, ts timestamp", []
    spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/in")
    stream = stream_dedup_quarantine(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), "k", "h", "ts")
    for rows in ([("a", "1"), ("a", "1"), ("b", "1"), ("n", None)], [("a", "2"), ("b", "1"), (None, "1")]):
        spark.createDataFrame([(k, h, None) for k, h in rows], schema).withColumn("ts", F.lit("2024-01-01").cast("timestamp")).write.mode(
            "append").parquet(f"{tmp_path}/in")
        query = stream.writeStream.foreachBatch(lambda batch, i: log.extend(tuple(r) for r in batch.collect())).option(
            "checkpointLocation", f"{tmp_path}/checkpoint").outputMode("update").trigger(availableNow=True).start()
        query.awaitTermination()
    assert sorted(log, key=str) == sorted([("a", "1", False, 2), ("b", "1", False, 1), ("n", None, True, 1), ("a", "1", True, 3), (None, "1", False, 1)], key=str)
