"""Many distributions of one table in a single pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def distributions(df: DataFrame, seq: str, dimensions: dict[str, Column], distinct: str | None = None) -> DataFrame:
    """``dimension, value, n, n_distinct, first_seq``: how often each value of each dimension occurs, and each dimension's total (``value`` null).

    A dimension is a column of text or an array of them (its elements count once
    for each row). All are exploded side by side, not one inside the other, and
    grouped by grouping sets, so the table is read once. ``n`` of a total counts
    rows that have a value; ``n_distinct`` counts distinct ``distinct`` values (rows,
    if it isn't given); nulls and blanks aren't values.
    """
    kinds = {r.name: r.dataType.typeName() for r in df.select(*[c.alias(n) for n, c in dimensions.items()]).schema.fields}
    lists = [_tagged(n, c, kinds[n] == "array") for n, c in dimensions.items()]
    unit = F.col(distinct) if distinct else F.col(seq)
    rows = df.select(F.col(seq).alias("seq"), unit.alias("unit"), F.explode(F.concat(*lists)).alias("e")).select("seq", "unit", "e.dimension", "e.value").where("value is not null and value <> ''")
    grouped = rows.groupingSets([["dimension", "value"], ["dimension"]], "dimension", "value").agg(F.count("*").alias("n"), F.countDistinct("unit").alias("n_distinct"), F.min("seq").alias("first_seq"))
    return grouped.select("dimension", "value", "n", "n_distinct", "first_seq")


def _tagged(name: str, column: Column, many: bool) -> Column:
    values = F.array_distinct(F.coalesce(column.cast("array<string>"), F.array().cast("array<string>"))) if many else F.array(column.cast("string"))
    return F.transform(values, lambda v: F.struct(F.lit(name).alias("dimension"), v.alias("value")))


def top_values(counts: DataFrame, most: int = 5) -> DataFrame:
    """The ``most`` most frequent values of each dimension, with ``rank``; of equally frequent ones those seen first, then by value."""
    order = W.partitionBy("dimension").orderBy(F.desc("n"), "first_seq", "value")
    return counts.where("value is not null").withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= most).select("dimension", "value", "n", "rank")


def flag_counts(df: DataFrame, flags: dict[str, Column]) -> DataFrame:
    """One row: how many rows meet each of many conditions, in one aggregation; a null condition isn't met."""
    return df.agg(F.count("*").alias("n_rows"), *[F.count_if(F.coalesce(c, F.lit(False))).alias(n) for n, c in flags.items()])
