"""Exact deduplication, keyed merges and anti-join sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from newsloom.functions import text


def first_wins(df: DataFrame, key: Column, seq: str) -> DataFrame:
    """Adds ``is_duplicate``: a key that an earlier row (by ``seq``) has; blank keys are never merged."""
    order = W.partitionBy("__key").orderBy(seq)
    keyed = df.withColumn("__key", F.coalesce(key, F.lit("")))
    # blank keys don't meet in one window
    blank = keyed.where("__key = ''").withColumn("is_duplicate", F.lit(False))
    return keyed.where("__key <> ''").withColumn("is_duplicate", F.row_number().over(order) > 1).unionByName(blank).drop("__key")


def history_split(new: DataFrame, old: DataFrame, url_key, identity_key, url: str = "url") -> DataFrame:
    """Adds ``status``: url_seen, identity_seen or new, against the rows of ``old``."""
    urls = old.select(url_key(F.col(url)).alias("__u")).distinct()
    ids = old.select(identity_key(F.col(url)).alias("__i")).distinct()
    keyed = new.withColumns({"__k": url_key(F.col(url)), "__j": identity_key(F.col(url))})
    return (
        keyed.join(urls, F.col("__k") == F.col("__u"), "left")
        .join(ids, F.col("__j") == F.col("__i"), "left")
        .withColumn("status", F.when(F.col("__u").isNotNull(), "url_seen").when(F.col("__i").isNotNull(), "identity_seen").otherwise("new"))
        .drop("__k", "__j", "__u", "__i")
    )


def duplicate_report(df: DataFrame, url: str, title: str, source: str, category: str) -> DataFrame:
    """Adds how many other rows share the url and the (source, title), whether categories differ, and a reason."""
    by_url, by_title = W.partitionBy(url), W.partitionBy(source, title)
    out = df.withColumns({
        "url_dups": (F.count("*").over(by_url) - 1).cast("long"),
        "title_dups": (F.count("*").over(by_title) - 1).cast("long"),
        "cross_category": F.min(category).over(by_url) != F.max(category).over(by_url),
    })
    both = (F.col("url_dups") > 0) & (F.col("title_dups") > 0)
    return out.withColumn("reason", F.when(both, "url+title").when(F.col("url_dups") > 0, "url").when(F.col("title_dups") > 0, "title").otherwise("unique"))


def title_groups(df: DataFrame, title: str, key: str, source: str, prefix: int = 50) -> DataFrame:
    """One event for each equal title prefix without punctuation: id of its sorted members, size, confidence."""
    name = F.substring(F.regexp_replace(F.lower(F.col(title)), "[^a-z0-9]", ""), 1, prefix)
    return df.groupBy(name.alias("title_key")).agg(
        F.count("*").alias("n"), F.countDistinct(source).alias("n_sources"), F.array_join(F.array_sort(F.collect_list(F.col(key).cast("string"))), "|").alias("members")
    ).select("title_key", "n", "n_sources", text.short_hash(F.col("members")).alias("event_id"), F.when(F.col("n_sources") > 1, "high").otherwise("low").alias("confidence"))


def keyed_merge(old: DataFrame, new: DataFrame, keys: list[str], mode: str = "replace", preserve: tuple[str, tuple] | None = None) -> DataFrame:
    """The table after merging ``new`` into ``old``.

    ``insert``: existing keys stay; ``replace``: new rows win; ``fill``: new
    values only where old ones are null. ``preserve`` = (column, values): a row
    whose old value is among them keeps its old row. Keys of ``new`` are unique.
    """
    values = [c for c in old.columns if c not in keys]
    a = old.select(*[F.col(k).alias(f"o_{k}") for k in keys], *[F.col(c).alias(f"o_{c}") for c in values], F.lit(True).alias("o__"))
    b = new.select(*[F.col(k).alias(f"n_{k}") for k in keys], *[F.col(c).alias(f"n_{c}") for c in values], F.lit(True).alias("n__"))
    on = [F.col(f"o_{k}") == F.col(f"n_{k}") for k in keys]
    joined = a.join(b, on, "full")
    keeps_old = F.col("n__").isNull() | (F.col("o__").isNotNull() & F.lit(mode == "insert"))
    if preserve:
        keeps_old = keeps_old | F.coalesce(F.col(f"o_{preserve[0]}").isin(*preserve[1]), F.lit(False))
    if mode == "fill":
        picked = [F.coalesce(f"o_{c}", f"n_{c}").alias(c) for c in values]
    else:
        picked = [F.when(keeps_old, F.col(f"o_{c}")).otherwise(F.col(f"n_{c}")).alias(c) for c in values]
    return joined.select(*[F.coalesce(f"o_{k}", f"n_{k}").alias(k) for k in keys], *picked).select(*old.columns)


def row_diff(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """``key, change``: added, removed or modified (null-safe over all other columns); equal rows are left out."""
    others = [c for c in before.columns if c != key]
    a = before.select(F.col(key).alias("ka"), F.struct(*others).alias("va"))
    b = after.select(F.col(key).alias("kb"), F.struct(*others).alias("vb"))
    change = F.when(F.col("ka").isNull(), "added").when(F.col("kb").isNull(), "removed").when(~F.col("va").eqNullSafe(F.col("vb")), "modified")
    return a.join(b, F.col("ka") == F.col("kb"), "full").select(F.coalesce("ka", "kb").alias(key), change.alias("change")).where("change is not null")


def business_hash(df: DataFrame, columns: list[str], sep: str = "|") -> Column:
    """Hash of one row's columns as text; nulls as the empty text."""
    return F.sha2(F.concat_ws(sep, *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]), 256)


def table_hash(df: DataFrame, columns: list[str], groups: int = 256) -> DataFrame:
    """One order-insensitive hash of a table: rows are hashed, sorted and hashed by prefix, then the prefixes' hashes."""
    rows = df.select(business_hash(df, columns).alias("h")).withColumn("p", F.substring("h", 1, 2))
    parts = rows.groupBy("p").agg(F.sha2(F.array_join(F.array_sort(F.collect_list("h")), ""), 256).alias("h"), F.count("*").alias("n"))
    return parts.agg(F.sum("n").alias("n_rows"), F.sha2(F.array_join(F.array_sort(F.collect_list("h")), ""), 256).alias("table_hash"))
