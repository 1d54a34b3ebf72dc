"""Structured Streaming forms: ingest with late-data classes, TTL dedup, source health."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from newsloom.functions import times


def event_stream(spark: SparkSession, path: str, schema) -> DataFrame:
    """A parquet folder as a stream; ``ts`` becomes a timestamp, as watermarks need one."""
    return spark.readStream.schema(schema).parquet(path).withColumn("ts", F.col("ts").cast("timestamp"))


def classify_late(stream: DataFrame, clock: str) -> DataFrame:
    """Freshness before any watermark, which would drop late rows without a word."""
    return stream.withColumn("bucket", times.freshness(F.col("ts"), F.lit(clock).cast("timestamp")))


def counts(stream: DataFrame, width: str = "1 day", late: str = "720 minutes") -> DataFrame:
    """Tumbling counts by type, late rows accepted for ``late``."""
    return stream.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"))


def once_within(stream: DataFrame, keys: list[str], ttl: str = "1 day") -> DataFrame:
    """Rows whose key hasn't come up within the watermark."""
    return stream.withWatermark("ts", ttl).dropDuplicatesWithinWatermark(keys)


HEALTH = "source string, runs long, failed_in_row long, empty_in_row long, state string"


def _health(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    runs, failed, empty = state.get if state.exists else (0, 0, 0)
    rows = pd.concat(list(frames)).sort_values(["ts", "seq"])
    for bad, none in zip(rows.failed, rows.empty_run, strict=True):
        runs += 1
        if bad:
            failed += 1
        else:
            failed, empty = 0, (empty + 1 if none else 0)
    state.update((runs, failed, empty))
    name = "broken" if failed >= 3 else "degraded" if failed else "stale" if empty >= 3 else "healthy"
    yield pd.DataFrame([(str(key[0]), runs, failed, empty, name)], columns=[c.split()[0] for c in HEALTH.split(", ")])


def health(stream: DataFrame, key: str) -> DataFrame:
    """Running state of each source from ``ts, seq, failed, empty_run``: three failures break it, three empty runs make it stale."""
    return stream.groupBy(key).applyInPandasWithState(_health, HEALTH, "runs long, failed long, empty long", "update", GroupStateTimeout.NoTimeout)


def drain(stream: DataFrame, write, checkpoint: str, mode: str = "append") -> None:
    """Runs a stream over what there is and stops; ``write(batch, id)`` must be idempotent by id."""
    stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
