"""Ranking with caps, quotas and reserved lanes; windows over state and time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def capped_selection(df: DataFrame, group: list[str], order: list[Column], reserved: Column, shared: Column, cap: int = 5, least_reserved: int = 1, least_shared: int = 3) -> DataFrame:
    """Adds ``picked``: at most ``cap`` rows a group, with places kept for two lanes.

    First the best rows of the reserved lane; then rows of the shared lane until
    it has ``least_shared``, reserved picks that belong to it counting; then the
    best of the rest. Only counts pass between the steps, so three window passes do.
    """
    lane = W.partitionBy(*group, "__reserved").orderBy(*order)
    one = df.withColumns({"__reserved": reserved, "__shared": shared}).withColumn("__first", F.col("__reserved") & (F.row_number().over(lane) <= least_reserved))
    whole = W.partitionBy(*group)
    two = one.withColumn("__left", F.greatest(F.lit(least_shared) - F.count_if(F.col("__first") & F.col("__shared")).over(whole), F.lit(0)))
    open_ = W.partitionBy(*group, F.col("__shared") & ~F.col("__first")).orderBy(*order)
    three = two.withColumn("__second", F.col("__shared") & ~F.col("__first") & (F.row_number().over(open_) <= F.col("__left")))
    taken = F.col("__first") | F.col("__second")
    four = three.withColumn("__room", F.lit(cap) - F.count_if(taken).over(whole))
    rest = W.partitionBy(*group, taken).orderBy(*order)
    return four.withColumn("picked", taken | (F.row_number().over(rest) <= F.col("__room"))).drop("__reserved", "__shared", "__first", "__second", "__left", "__room")


def capped_levels(df: DataFrame, group: list[str], level: str, order: list[Column], reserved: Column, shared: Column, cap: int = 5, least_reserved: int = 1, least_shared: int = 3) -> DataFrame:
    """``level`` after the cap, and ``capped``: of critical and important rows those that aren't picked become normal; other rows are no candidates."""
    high = F.col(level).isin("critical", "important")
    picked = capped_selection(df.where(high), group, order, reserved, shared, cap, least_reserved, least_shared)
    rest = df.where(~F.coalesce(high, F.lit(False))).withColumn("capped", F.lit(False))
    return picked.withColumn("capped", ~F.col("picked")).withColumn(level, F.when(F.col("picked"), F.col(level)).otherwise("normal")).drop("picked").unionByName(rest)


def quota_selection(df: DataFrame, group: str, order: list[Column], per_group: int = 10, most: int = 15) -> DataFrame:
    """The best rows, at most ``per_group`` of each group and ``most`` in all, with their ``rank``.

    The quota comes first, so the global ranking sees few rows of each group;
    a top-k then ranks them.
    """
    own = W.partitionBy(group).orderBy(*order)
    few = df.withColumn("__own", F.row_number().over(own)).where(F.col("__own") <= per_group).orderBy(*order).limit(most)
    return few.withColumn("rank", F.row_number().over(W.partitionBy(F.lit(1)).orderBy(*order)).cast("long")).drop("__own")


def top_n(df: DataFrame, group: list[str], order: list[Column], n: int, name: str = "position") -> DataFrame:
    """The first n rows of each group with their position."""
    return df.withColumn(name, F.row_number().over(W.partitionBy(*group).orderBy(*order)).cast("long")).where(F.col(name) <= n)


def contiguous_days(df: DataFrame, key: str, day: Column) -> DataFrame:
    """Runs of days in a row: ``key, first_day, last_day, n_days``."""
    days = df.select(key, day.cast("date").alias("d")).distinct()
    order = W.partitionBy(key).orderBy("d")
    return days.withColumn("island", F.date_sub("d", F.row_number().over(order))).groupBy(key, "island").agg(
        F.min("d").alias("first_day"), F.max("d").alias("last_day"), F.count("*").alias("n_days")).drop("island")


def trailing_streak(df: DataFrame, key: str, order: list[Column], failed: Column) -> DataFrame:
    """How many failures end each key's history: ``key, streak``."""
    backwards = W.partitionBy(key).orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    good_since = F.sum(F.when(failed, 0).otherwise(1)).over(backwards)
    return df.withColumn("__good", good_since).groupBy(key).agg(F.count_if(F.col("__good") == 0).cast("long").alias("streak"))


def gap_sessions(df: DataFrame, keys: list[str], ts: str, seconds: int, tie: str) -> DataFrame:
    """Sessions of rows at most ``seconds`` apart: keys, start, end, n."""
    order = W.partitionBy(*keys).orderBy(ts, tie)
    micros = F.unix_micros(F.col(ts).cast("timestamp"))
    new = F.coalesce(micros - F.lag(micros).over(order) > seconds * 1_000_000, F.lit(True))
    marked = df.withColumn("__n", F.sum(new.cast("int")).over(order.rowsBetween(W.unboundedPreceding, W.currentRow)))
    return marked.groupBy(*keys, "__n").agg(F.min(ts).alias("session_start"), F.max(ts).alias("session_end"), F.count("*").alias("n")).drop("__n")


def previous_delta(df: DataFrame, keys: list[str], rank: str, value: str) -> DataFrame:
    """Adds ``delta`` to the value of the row just before (rank - 1), null if that is missing."""
    order = W.partitionBy(*keys).orderBy(rank)
    return df.withColumn("delta", F.when(F.lag(rank).over(order) == F.col(rank) - 1, F.round(F.col(value) - F.lag(value).over(order), 2)))


def ttl_fold(df: DataFrame, key: str, ts: str, seconds: int) -> DataFrame:
    """What is sent if a key is silent for ``seconds`` after each send: a fold, as silence counts from the last *sent* row.

    A key's times are folded with ``aggregate`` as an array of integers; returns key, n_seen, n_sent, last_sent (micros).
    """
    micros = F.unix_micros(F.col(ts).cast("timestamp"))
    state = F.struct(F.lit(None).cast("long").alias("last"), F.lit(0).cast("long").alias("sent"))

    def step(s: Column, t: Column) -> Column:
        send = s["last"].isNull() | (t - s["last"] >= seconds * 1_000_000)
        return F.struct(F.when(send, t).otherwise(s["last"]).alias("last"), (s["sent"] + F.when(send, 1).otherwise(0)).alias("sent"))

    folded = df.groupBy(key).agg(F.array_sort(F.collect_list(micros)).alias("ts")).withColumn("s", F.aggregate("ts", state, step))
    return folded.select(key, F.size("ts").cast("long").alias("n_seen"), F.col("s.sent").alias("n_sent"), F.col("s.last").alias("last_sent"))


def source_health(df: DataFrame, key: str, order: list[Column], failed: Column, empty: Column) -> DataFrame:
    """Final state of each source: consecutive failures and empty runs, and broken, stale, degraded or healthy."""
    up_to = W.partitionBy(key).orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    marks = df.withColumns({
        "__ok": F.sum(F.when(failed, 0).otherwise(1)).over(up_to),
        "__items": F.sum(F.when(~failed & ~empty, 1).otherwise(0)).over(up_to),
    })
    sums = marks.groupBy(key).agg(
        F.count("*").alias("runs"), F.count_if(failed).alias("failures"),
        F.count_if(failed & (F.col("__ok") == 0)).cast("long").alias("failed_in_row"),
        F.count_if(~failed & empty & (F.col("__items") == 0)).cast("long").alias("empty_in_row"),
    )
    state = F.when(F.col("failed_in_row") >= 3, "broken").when(F.col("failed_in_row") > 0, "degraded").when(F.col("empty_in_row") >= 3, "stale").otherwise("healthy")
    return sums.withColumn("state", state)
