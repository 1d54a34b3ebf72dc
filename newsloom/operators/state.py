"""Periods, coverage, snapshots, semantic diffs, audits and quality measures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def period_members(parents: DataFrame, children: DataFrame, key: tuple[str, str], own: str, child: str, start: str, end: str) -> DataFrame:
    """Parents dated within [start, end], or with a child that is: key and reasons.

    Children are cut to the period before the join, so it carries keys only.
    """
    a, b = F.lit(start).cast("timestamp_ntz"), F.lit(end).cast("timestamp_ntz")
    inside = children.where(F.col(child).between(a, b)).groupBy(F.col(key[1]).alias("__c")).agg(F.count("*").alias("n_children"))
    by_own = F.col(own).between(a, b)
    joined = parents.join(inside, F.col(key[0]) == F.col("__c"), "left").where(by_own | F.col("__c").isNotNull())
    reasons = F.array_join(F.array_compact(F.array(F.when(by_own, "own_date"), F.when(F.col("__c").isNotNull(), "sub_event"))), "|")
    return joined.select(key[0], reasons.alias("reasons"), F.coalesce("n_children", F.lit(0)).alias("n_children"))


def uncovered_days(df: DataFrame, group: str, day: Column, start: str, end: str) -> DataFrame:
    """Days of [start, end] without a row, for each group value that occurs: group, day."""
    groups = df.select(group).distinct()
    every = groups.withColumn("day", F.explode(F.sequence(F.lit(start).cast("date"), F.lit(end).cast("date"))))
    return every.join(df.select(F.col(group).alias("__g"), day.cast("date").alias("__d")).distinct(), (F.col(group) == F.col("__g")) & (F.col("day") == F.col("__d")), "left_anti")


def gap_ranges(days: DataFrame, group: str, day: str = "day") -> DataFrame:
    """Runs of uncovered days: group, gap_start, gap_end, n_days."""
    order = W.partitionBy(group).orderBy(day)
    return days.withColumn("__i", F.date_sub(day, F.row_number().over(order))).groupBy(group, "__i").agg(F.min(day).alias("gap_start"), F.max(day).alias("gap_end"), F.count("*").alias("n_days")).drop("__i")


def long_state(df: DataFrame, dimension: str, layers: dict[str, dict[str, Column]]) -> DataFrame:
    """Per-dimension state as rows (dimension, layer, path, value), one pass over the grouped rows."""
    entries = [F.struct(F.lit(layer).alias("layer"), F.lit(path).alias("path"), value.cast("string").alias("value")) for layer, paths in layers.items() for path, value in paths.items()]
    return df.select(F.col(dimension).alias("dimension"), F.inline(F.array(*entries)))


def semantic_diff(before: DataFrame, after: DataFrame, least_confidence: float = 0.05) -> DataFrame:
    """Changed paths of two long states: kind, and whether they matter.

    Business changes matter; a confidence matters from ``least_confidence`` on;
    limitations never do.
    """
    a = before.select(*[F.col(c).alias(f"a_{c}") for c in ("dimension", "layer", "path", "value")])
    b = after.select(*[F.col(c).alias(f"b_{c}") for c in ("dimension", "layer", "path", "value")])
    on = [F.col(f"a_{c}") == F.col(f"b_{c}") for c in ("dimension", "layer", "path")]
    j = a.join(b, on, "full").where(~F.col("a_value").eqNullSafe(F.col("b_value")))
    layer = F.coalesce("a_layer", "b_layer")
    moved = F.abs(F.coalesce(F.expr("try_cast(b_value as double)"), F.lit(0.0)) - F.coalesce(F.expr("try_cast(a_value as double)"), F.lit(0.0)))
    matters = F.when(layer == "business", True).when(layer == "confidence", moved >= least_confidence).otherwise(False)
    kind = F.when(F.col("a_value").isNull(), "added").when(F.col("b_value").isNull(), "removed").otherwise("changed")
    return j.select(F.coalesce("a_dimension", "b_dimension").alias("dimension"), layer.alias("layer"), F.coalesce("a_path", "b_path").alias("path"), kind.alias("kind"), matters.alias("material"))


def orphans(child: DataFrame, key: str, parent: DataFrame, parent_key: str, check: str) -> DataFrame:
    """Keys of ``child`` without a parent as audit rows (check, severity, key, n)."""
    lost = child.join(parent.select(F.col(parent_key).alias("__p")), F.col(key) == F.col("__p"), "left_anti")
    return lost.groupBy(F.col(key).cast("string").alias("key")).agg(F.count("*").alias("n")).select(F.lit(check).alias("check"), F.lit("error").alias("severity"), "key", "n")


def failing(df: DataFrame, key: str, condition: Column, check: str, severity: str = "error") -> DataFrame:
    """Rows for which a condition holds, as audit rows."""
    return df.where(condition).groupBy(F.col(key).cast("string").alias("key")).agg(F.count("*").alias("n")).select(F.lit(check).alias("check"), F.lit(severity).alias("severity"), "key", "n")


def pair_scores(df: DataFrame, expected: str, predicted: str) -> DataFrame:
    """Precision, recall and F1 over pairs of rows in one group, from group sizes only: no pair is made."""

    def pairs(*by: str) -> DataFrame:
        n = F.col("count")
        return df.groupBy(*by).count().agg(F.coalesce(F.sum((n * (n - 1) / 2).cast("long")), F.lit(0)).alias("p"))

    both, right, said = pairs(expected, predicted), pairs(expected), pairs(predicted)
    one = both.select(F.col("p").alias("tp")).join(right.select(F.col("p").alias("expected_pairs"))).join(said.select(F.col("p").alias("predicted_pairs")))
    return with_f1(one, "tp", "predicted_pairs", "expected_pairs")


def with_f1(df: DataFrame, hit: str, said: str, right: str) -> DataFrame:
    p = F.when(F.col(said) == 0, 0.0).otherwise(F.col(hit) / F.col(said))
    r = F.when(F.col(right) == 0, 0.0).otherwise(F.col(hit) / F.col(right))
    one = df.withColumns({"precision": p, "recall": r})
    return one.withColumn("f1", F.when(F.col("precision") + F.col("recall") == 0, 0.0).otherwise(2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))))


def label_scores(df: DataFrame, expected: str, predicted: str) -> DataFrame:
    """Per label: support, tp, fp, fn with precision, recall, F1."""
    seen = df.select(F.explode(F.array_distinct(F.array(expected, predicted))).alias("label"), expected, predicted)
    sums = seen.groupBy("label").agg(
        F.count_if((F.col(expected) == F.col("label")) & (F.col(predicted) == F.col("label"))).alias("tp"),
        F.count_if(F.col(predicted) == F.col("label")).alias("predicted_n"), F.count_if(F.col(expected) == F.col("label")).alias("expected_n"))
    return with_f1(sums, "tp", "predicted_n", "expected_n")
