"""Chains of pointers: superseded versions followed to their end by doubling, and the version before a current one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.storage import cut


def chain_ends(df: DataFrame, key: str, following: str) -> DataFrame:
    """``key, last, hops, state``: where each row's chain of pointers ends.

    States: ``end`` (a row that points nowhere), ``missing`` (``last`` is a key that
    no row has), ``cycle`` (``last`` null). Each round doubles the hops of all open
    rows, so rounds follow the logarithm of the longest chain: with ``2 ** r`` hops
    made, rows nearer to their end are settled and the next round settles some row
    on every longer chain, so what a round without a settled row leaves open goes
    round in cycles. Settled rows are written once. Keys are unique and not null.
    """
    at = F.col(following)
    rows = df.select(F.col(key).alias("k"), at.alias("at"))
    real = rows.select(F.col("k").alias("there"))
    # open: the pointer leads to a row whose own pointer isn't followed yet
    first = cut(rows.join(real, F.col("at") == F.col("there"), "left").select(
        "k", "at", F.when(F.col("at").isNull(), 0).otherwise(1).cast("long").alias("hops"), F.when(F.col("at").isNull(), "end").when(F.col("there").isNull(), "missing").otherwise("open").alias("state")))
    settled, waiting = first.where("state <> 'open'"), first.where("state = 'open'")
    n, before = waiting.count(), None
    while n and n != before:
        steps = settled.unionByName(waiting).select(F.col("k").alias("sk"), F.col("at").alias("sat"), F.col("hops").alias("shops"), F.col("state").alias("sstate"))
        moved = cut(waiting.join(steps, F.col("at") == F.col("sk")).select(
            "k", F.coalesce("sat", "at").alias("at"), (F.col("hops") + F.col("shops")).alias("hops"), F.col("sstate").alias("state")))
        settled, waiting = settled.unionByName(moved.where("state <> 'open'")), moved.where("state = 'open'")
        n, before = waiting.count(), n
    state = settled.unionByName(waiting)
    last = F.when(F.col("state") == "open", None).when((F.col("state") == "end") & F.col("at").isNull(), F.col("k")).otherwise(F.col("at"))
    return state.select(F.col("k").alias(key), last.alias("last"), F.when(F.col("state") != "open", F.col("hops")).alias("hops"), F.when(F.col("state") == "open", "cycle").otherwise(F.col("state")).alias("state"))


def previous_version(df: DataFrame, group: str, key: str, created: str, following: str, active: Column) -> DataFrame:
    """``group, current, previous, basis``: the version before each group's active one.

    The active version is the latest active row. Before it comes the latest row
    that it superseded, directly or by a chain (``superseded``), or else the latest
    row created before it (``created``); null and ``none`` if there is neither.
    Ties in time go to the larger key.
    """
    latest = lambda c: F.max(F.struct(F.col(created).alias("t"), F.col(key).alias("k")))  # noqa: E731, ARG005
    current = df.where(active).groupBy(group).agg(latest(None).alias("now"))
    ends = chain_ends(df, key, following).where("state = 'end' and hops > 0").select(F.col(key).alias("__k"), "last")
    rows = df.join(ends, F.col(key) == F.col("__k"), "left").join(current.withColumnRenamed(group, "__g"), F.col(group) == F.col("__g"))
    other = rows.where(F.col(key) != F.col("now.k")).withColumn("row", F.struct(F.col(created).alias("t"), F.col(key).alias("k")))
    picked = other.groupBy(F.col(group).alias("__g")).agg(F.max(F.when(F.col("last") == F.col("now.k"), F.col("row"))).alias("chain"), F.max(F.when(F.col(created) < F.col("now.t"), F.col("row"))).alias("older"))
    basis = F.when(F.col("chain").isNotNull(), "superseded").when(F.col("older").isNotNull(), "created").otherwise("none")
    return current.join(picked, F.col(group) == F.col("__g"), "left").select(group, F.col("now.k").alias("current"), F.coalesce("chain.k", "older.k").alias("previous"), basis.alias("basis"))


def supersede(df: DataFrame, keys: list[str], key: str, created: str, status: str, pending: str = "pending", done: str = "superseded") -> DataFrame:
    """The rows with all but the newest pending row of each group marked as superseded, and ``superseded_by`` (null for others)."""
    waiting = F.col(status) == pending
    newest = df.where(waiting).groupBy(*[F.col(k).alias(f"__{k}") for k in keys]).agg(F.max(F.struct(F.col(created).alias("t"), F.col(key).alias("k"))).alias("__new"))
    on = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]
    old = waiting & (F.col("__new.k") != F.col(key))
    joined = df.join(newest, on, "left").withColumn("superseded_by", F.when(old, F.col("__new.k"))).withColumn(status, F.when(old, done).otherwise(F.col(status)))
    return joined.select(*df.columns, "superseded_by")
