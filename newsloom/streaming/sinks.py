"""Tables that are written in numbered batches: a ledger of committed batches, cursors that only rise, and the new rows of each run.

A batch's rows are written first, then its line in the ledger; only batches in
the ledger are read. So a run that stops between the two leaves rows that nobody
sees, and the same batch run again writes them over. A batch that is in the
ledger isn't written again. All files go through Spark, to any folder that its
writers reach; the ledger is one row a batch.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from newsloom.storage import exists

LEDGER = "batch_id bigint, scope string, low string, high string, published_high string, seen bigint, fresh bigint"


def ledger(spark: SparkSession, path: str) -> DataFrame:
    """Committed batches, one row each; none before the first."""
    folder = f"{path}/ledger"
    if not exists(spark, folder):
        return spark.createDataFrame([], LEDGER)
    return spark.read.schema(LEDGER).parquet(folder)


def committed(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of all committed batches, with their ``batch_id``."""
    folder = f"{path}/rows"
    if not exists(spark, folder):
        return spark.createDataFrame([], f"{schema}, batch_id bigint")
    rows = spark.read.schema(f"{schema}, batch_id bigint").parquet(folder)
    done = ledger(spark, path).select(F.col("batch_id").alias("__done"))
    return rows.join(done, F.col("batch_id") == F.col("__done"), "left_semi")


def cursor(spark: SparkSession, path: str, scope: str = "") -> int | None:
    """The highest cursor that a committed batch of this scope has moved to."""
    found = ledger(spark, path).where(F.col("scope") == scope).agg(F.max(F.col("high").cast("bigint")).alias("high")).first()
    return found["high"]


def rows_after(df: DataFrame, column: str, after: int | None, most: int | None = None) -> DataFrame:
    """Rows beyond a cursor; with ``most``, those whose cursor is at most that much beyond it."""
    low = after if after is not None else None
    out = df if low is None else df.where(F.col(column) > low)
    if most is None:
        return out
    base = low if low is not None else -1
    return out.where(F.col(column) <= base + most)


def append_new(df: DataFrame, path: str, batch_id: int, keys: list[str], seq: str, published: str | None = None, scope: str = "", moves: bool = True, crash: Callable[[], None] | None = None) -> DataFrame:
    """Writes the rows of ``df`` whose keys no committed batch has, commits the batch, and returns the new rows.

    Of rows that share their keys the first by ``seq`` counts; rows with a null
    key are always new. The cursor rises to the largest ``seq`` seen and never falls;
    ``published_high`` is the latest ``published`` seen so far in the scope. With
    ``moves`` false (runs over history) both stay where they are once there is one.
    A batch that is committed already is left alone, and its rows are returned.
    ``crash`` is called between the two writes, for tests.
    """
    spark = df.sparkSession
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    before = ledger(spark, path)
    if not before.where(F.col("batch_id") == batch_id).limit(1).count():
        whole = None
        for k in keys:
            whole = F.col(k).isNotNull() if whole is None else whole & F.col(k).isNotNull()
        order = W.partitionBy(*keys).orderBy(seq)
        firsts = df.where(whole).withColumn("__n", F.row_number().over(order)).where("__n = 1").drop("__n")
        old = committed(spark, path, schema).select(*[F.col(k).alias(f"__{k}") for k in keys])
        fresh = firsts.join(old, [F.col(k) == F.col(f"__{k}") for k in keys], "left_anti").unionByName(df.where(~whole))
        target = f"{path}/rows/batch_id={batch_id}"
        fresh.write.mode("overwrite").parquet(target)
        if crash:
            crash()
        top = F.max(F.col(published).cast("string")) if published else F.lit(None).cast("string")
        seen = df.agg(F.count("*").alias("n"), F.max(seq).alias("high"), top.alias("latest")).first()
        last = before.where(F.col("scope") == scope).agg(F.max(F.col("high").cast("bigint")).alias("high"), F.max("published_high").alias("latest")).first()
        still = not moves and last["high"] is not None
        high = last["high"] if still or seen["high"] is None else max(seen["high"], last["high"] if last["high"] is not None else seen["high"])
        latest = last["latest"] if still or seen["latest"] is None else max(seen["latest"], last["latest"] or "")
        n = spark.read.schema(schema).parquet(target).count()
        text = lambda v: None if v is None else str(v)
        line = spark.createDataFrame([(batch_id, scope, text(last["high"]), text(high), latest, seen["n"], n)], LEDGER)
        line.coalesce(1).write.mode("append").parquet(f"{path}/ledger")
    return committed(spark, path, schema).where(F.col("batch_id") == batch_id).drop("batch_id")


def ledger_sink(path: str, keys: list[str], seq: str, published: str | None = None) -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch``: a stream that is restarted repeats its last batch, which changes nothing."""

    def write(batch: DataFrame, batch_id: int) -> None:
        append_new(batch, path, batch_id, keys, seq, published)

    return write


def unique_triggers(new: DataFrame, done: DataFrame, keys: list[str], state: Column, seq: str) -> DataFrame:
    """Rows of ``new`` with ``state_hash`` that no row of ``done`` has with the same keys; of equal ones the first by ``seq``.

    ``state`` is what a trigger is about, as text; ``done`` has the keys and ``state_hash``.
    """
    hashed = new.withColumn("state_hash", F.sha2(F.coalesce(state.cast("string"), F.lit("")), 256))
    once = hashed.withColumn("__n", F.row_number().over(W.partitionBy(*keys, "state_hash").orderBy(seq))).where("__n = 1").drop("__n")
    old = done.select(*[F.col(k).alias(f"__{k}") for k in (*keys, "state_hash")])
    on = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in (*keys, "state_hash")]
    return once.join(old, on, "left_anti")
