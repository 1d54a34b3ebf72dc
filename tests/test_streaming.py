from pyspark.sql import functions as F

from newsloom.operators import ranking
from newsloom.storage import table
from newsloom.streaming import ingest
from tests.conftest import DATA


def _folder(spark, tmp_path):
    events = table(spark, DATA, "events")
    events.orderBy("ts").coalesce(1).write.parquet(str(tmp_path / "in"))
    return events, str(tmp_path / "in")


def test_stream_counts_equal_batch(spark, tmp_path):
    events, path = _folder(spark, tmp_path)
    out = str(tmp_path / "out")
    stream = ingest.classify_late(ingest.event_stream(spark, path, events.schema), "2024-01-29 12:00:00")
    ingest.drain(stream, lambda batch, i: batch.groupBy("bucket").count().write.mode("overwrite").parquet(f"{out}/{i}"), str(tmp_path / "c"))
    got = {r["bucket"]: r["sum"] for r in spark.read.parquet(f"{out}/*").groupBy("bucket").agg(F.sum("count").alias("sum")).collect()}
    want = {r["bucket"]: r["count"] for r in ingest.classify_late(events, "2024-01-29 12:00:00").groupBy("bucket").count().collect()}
    assert got == want


def test_stream_health_equals_batch(spark, tmp_path):
    events, path = _folder(spark, tmp_path)
    stream = ingest.event_stream(spark, path, events.schema).select("user_id", "ts", F.col("event_id").alias("seq"), (F.col("event_type") == "error").alias("failed"), (F.coalesce("value", F.lit(0.0)) == 0).alias("empty_run"))
    out = str(tmp_path / "health")
    ingest.drain(ingest.health(stream, "user_id"), lambda batch, i: batch.write.mode("overwrite").parquet(f"{out}/{i}"), str(tmp_path / "c2"), "update")
    got = {(int(r["source"]), r["runs"], r["failed_in_row"]) for r in spark.read.parquet(f"{out}/*").where("source is not null").collect()}
    batch = ranking.source_health(events, "user_id", [F.desc("ts"), F.desc("event_id")], F.col("event_type") == "error", F.coalesce("value", F.lit(0.0)) == 0)
    assert got == {(r["user_id"], r["runs"], r["failed_in_row"]) for r in batch.where("user_id is not null").collect()}
