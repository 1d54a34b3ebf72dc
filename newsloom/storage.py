"""Table access and lineage cuts shared by every operator."""

from __future__ import annotations

import gc
import tempfile
import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Reads one parquet table, a single file or a folder of parts."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Bytes of one Arrow batch that goes to a Python worker.
BATCH_BYTES = 4 << 20


def bounded_batches(spark: SparkSession, most: int = BATCH_BYTES) -> None:
    """Bounds the session's Arrow batches by bytes, as rows alone don't bound batches of long texts.

    A smaller bound that the session has stays; a plan takes the bound when it runs.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(key, None)
    known = int(now[:-1]) if now and now[:-1].isdigit() and now.endswith("b") else None
    if known is None and now and now.isdigit():
        known = int(now)
    if known is None or known <= 0 or known > most:
        spark.conf.set(key, str(most))


def _checkpoint_folder(spark: SparkSession) -> None:
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        shared = spark.conf.get("spark.checkpoint.dir", None)
        one_machine = context.master.startswith("local") and "cluster" not in context.master
        if not shared and not one_machine:
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(shared or tempfile.mkdtemp(prefix="newsloom-"))


def scratch(spark: SparkSession) -> str:
    """A new folder's name within the checkpoint folder."""
    _checkpoint_folder(spark)
    return f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/table-{uuid.uuid4().hex}"


def exists(spark: SparkSession, path: str) -> bool:
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    return there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(there)


def cut(df: DataFrame) -> DataFrame:
    """Cuts lineage with a reliable checkpoint in the cluster's shared folder.

    The folder is the session's ``spark.checkpoint.dir``; only where that is
    unset on a local master (tests, one machine) a local folder is chosen.
    """
    _checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def release(spark: SparkSession) -> None:
    """Lets the files of finished shuffles and checkpoints go now.

    Spark's cleaner removes them once neither Python nor the driver's JVM holds
    their plans, which either finds out only when it collects its garbage. On a
    local master, where nothing else needs the disk, nothing is done.
    """
    if spark.sparkContext.master.startswith("local") and "cluster" not in spark.sparkContext.master:
        return
    for _ in range(2):
        gc.collect()
        spark._jvm.System.gc()
        time.sleep(0.3)


def written(df: DataFrame) -> tuple[DataFrame, Callable[[], None]]:
    """Cuts lineage with a Parquet table in the checkpoint folder, for rows that compress well; and what removes it."""
    spark = df.sparkSession
    context = spark.sparkContext
    path = scratch(spark)
    df.write.parquet(path)

    def drop() -> None:
        there = context._jvm.org.apache.hadoop.fs.Path(path)
        there.getFileSystem(context._jsc.hadoopConfiguration()).delete(there, True)

    return spark.read.schema(df.schema).parquet(path), drop


def only(rows: DataFrame, ids: DataFrame, column: str, most: int = 500_000) -> DataFrame:
    """Rows whose ``column`` is among ``ids`` (one column).

    Up to ``most`` distinct ids, by count, the ids are broadcast and the rows
    stay where they are; beyond that both sides are shuffled by Spark's join.
    """
    name = ids.columns[0]
    few = ids.where(F.col(name).isNotNull()).distinct().withColumnRenamed(name, "__only")
    small = few.limit(most + 1).count() <= most
    return rows.join(F.broadcast(few) if small else few, rows[column] == few["__only"], "left_semi")
