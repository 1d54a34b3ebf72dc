"""Batches, ledger and cursors."""

import pytest
from pyspark.sql import functions as F

from newsloom.storage import table
from newsloom.streaming import ingest, sinks
from tests.conftest import DATA

SCHEMA = "id long, url string, day string"


def frame(spark, *rows):
    return spark.createDataFrame(list(rows), SCHEMA)


def state(spark, path):
    rows = sorted((r["id"], r["url"], r["day"], r["batch_id"]) for r in sinks.committed(spark, path, SCHEMA).collect())
    return rows, sorted(tuple(r) for r in sinks.ledger(spark, path).collect())


def test_a_run_that_stops_and_is_repeated_gives_the_same_table(spark, tmp_path):
    one = frame(spark, (1, "a", "d1"), (2, "b", "d3"), (3, "a", "d2"), (4, None, None), (5, None, "d1"))
    two = frame(spark, (6, "b", "d9"), (7, "c", "d2"))

    def stop():
        raise RuntimeError("stopped")

    smooth, broken = str(tmp_path / "smooth"), str(tmp_path / "broken")
    for path in (smooth, broken):
        fresh = sinks.append_new(one, path, 1, ["url"], "id", "day")
        assert sorted(r["id"] for r in fresh.collect()) == [1, 2, 4, 5]
    sinks.append_new(two, smooth, 2, ["url"], "id", "day")
    before = state(spark, broken)
    with pytest.raises(RuntimeError):
        sinks.append_new(two, broken, 2, ["url"], "id", "day", crash=stop)
    assert state(spark, broken) == before and sinks.cursor(spark, broken) == 5  # nobody sees rows without a line in the ledger
    assert [r["id"] for r in sinks.append_new(two, broken, 2, ["url"], "id", "day").collect()] == [7]
    assert [r["id"] for r in sinks.append_new(two, broken, 2, ["url"], "id", "day").collect()] == [7]  # repeated: same rows, nothing written
    assert state(spark, broken) == state(spark, smooth)
    assert state(spark, smooth)[1] == [(1, "", None, "5", "d3", 5, 4), (2, "", "5", "7", "d9", 2, 1)]


def test_cursors_only_rise(spark, tmp_path):
    path = str(tmp_path / "t")
    assert sinks.cursor(spark, path) is None and sinks.committed(spark, path, SCHEMA).count() == 0
    sinks.append_new(frame(spark, (9, "a", "d5")), path, 1, ["url"], "id", "day")
    sinks.append_new(frame(spark, (4, "b", "d1")), path, 2, ["url"], "id", "day")
    assert sinks.cursor(spark, path) == 9
    sinks.append_new(frame(spark, (50, "c", "d8")), path, 3, ["url"], "id", "day", moves=False)
    assert sinks.cursor(spark, path) == 9  # a run over history leaves the cursor
    sinks.append_new(frame(spark), path, 4, ["url"], "id", "day")
    assert sinks.cursor(spark, path) == 9 and sinks.cursor(spark, path, "other") is None
    assert {r["published_high"] for r in sinks.ledger(spark, path).collect()} == {"d5"}
    assert [r["id"] for r in sinks.rows_after(frame(spark, (9, "x", ""), (10, "y", ""), (12, "z", "")), "id", 9, 2).collect()] == [10]


def test_stream_into_the_ledger_equals_batch(spark, tmp_path):
    events = table(spark, DATA, "events")
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")).select("event_id", "user_id", "event_type")
    path = str(tmp_path / "out")
    for _ in range(2):  # the second run finds nothing new
        ingest.drain(stream, sinks.ledger_sink(path, ["user_id", "event_type"], "event_id"), str(tmp_path / "c"))
    rows = sinks.committed(spark, path, "event_id bigint, user_id bigint, event_type string")
    assert sinks.ledger(spark, path).count() == 3
    keys = ["user_id", "event_type"]
    assert rows.groupBy(*keys).count().where("count > 1").count() == 0
    assert rows.select(*keys).exceptAll(events.select(*keys).distinct()).count() == 0 and rows.count() == events.select(*keys).distinct().count()
    assert sinks.cursor(spark, path) == events.agg(F.max("event_id")).first()[0]
