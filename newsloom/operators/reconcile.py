"""References held against each other: what was added or removed, used twice, or rendered other than exactly once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def reference_changes(before: DataFrame, after: DataFrame, formal: DataFrame) -> DataFrame:
    """``owner, kind, ref, change``: references of each owner that came or went.

    ``before`` and ``after``: ``owner, kind, ref``; ``formal``: ``kind, ref`` of what exists.
    Changes are ``added``, ``removed_still_formal`` and ``deleted``: a reference that
    went is a deletion only if what it refers to is gone as well.
    """
    keys = ["owner", "kind", "ref"]
    one, two = before.select(*keys).distinct(), after.select(*keys).distinct()
    there = formal.select(F.col("kind").alias("fk"), F.col("ref").alias("fr")).distinct()
    gone = one.join(two, keys, "left_anti").join(there, (F.col("kind") == F.col("fk")) & (F.col("ref") == F.col("fr")), "left")
    return two.join(one, keys, "left_anti").select(*keys, F.lit("added").alias("change")).unionByName(gone.select(*keys, F.when(F.col("fk").isNotNull(), "removed_still_formal").otherwise("deleted").alias("change")))


def reference_faults(refs: DataFrame, known: DataFrame) -> DataFrame:
    """``owner, check, ref, n``: ids that occur twice within a field, in several fields, or nowhere.

    ``refs``: ``owner, field, ref``; ``known``: ``ref``. Checks: ``within_field_duplicate``
    (n occurrences), ``cross_field_reuse`` (n fields) and ``missing_id``.
    """
    used = refs.where("ref is not null and ref <> ''")
    twice = used.groupBy("owner", "field", "ref").agg(F.count("*").alias("n"))
    within = twice.where("n > 1").groupBy("owner", "ref").agg(F.max("n").alias("n")).select("owner", F.lit("within_field_duplicate").alias("check"), "ref", "n")
    across = twice.groupBy("owner", "ref").agg(F.count("*").alias("n")).where("n > 1").select("owner", F.lit("cross_field_reuse").alias("check"), "ref", "n")
    lost = twice.select("owner", "ref").distinct().join(known.select(F.col("ref").alias("__k")).distinct(), F.col("ref") == F.col("__k"), "left_anti").select("owner", F.lit("missing_id").alias("check"), "ref", F.lit(1).cast("long").alias("n"))
    return within.unionByName(across).unionByName(lost)


def exact_cover(accepted: DataFrame, rendered: DataFrame, sections: DataFrame) -> DataFrame:
    """``plan, claim, fault``: claims of a plan that aren't rendered, and placed, exactly once.

    ``accepted``: ``plan, claim, section``; ``rendered``: ``plan, claim``; ``sections``: ``plan,
    claim, section``. Faults: ``missing``, ``unauthorized``, ``rendered_again``,
    ``section_missing``, ``section_unauthorized``, ``section_again`` and ``section_mismatch``.
    """
    keys = ["plan", "claim"]
    own = accepted.groupBy(*keys).agg(F.min("section").alias("target"))
    shown = rendered.groupBy(*keys).agg(F.count("*").alias("shown"))
    placed = sections.groupBy(*keys).agg(F.count("*").alias("placed"), F.collect_set("section").alias("where"))  # the sections of one claim
    rows = own.withColumn("own", F.lit(True)).join(shown, keys, "full").join(placed, keys, "full")
    known, n, m = F.col("own").isNotNull(), F.coalesce("shown", F.lit(0)), F.coalesce("placed", F.lit(0))
    faults = {
        "missing": known & (n == 0), "unauthorized": ~known & (n > 0), "rendered_again": n > 1, "section_missing": known & (m == 0), "section_unauthorized": ~known & (m > 0), "section_again": m > 1,
        "section_mismatch": known & F.coalesce(F.exists("where", lambda s: s != F.col("target")), F.lit(False)),
    }
    return rows.select(*keys, F.explode(F.array_compact(F.array(*[F.when(v, F.lit(k)) for k, v in faults.items()]))).alias("fault"))


def coverage_rate(accepted: DataFrame, rendered: DataFrame) -> DataFrame:
    """``plan, n, covered, rate``: the share of each plan's claims that are rendered."""
    keys = ["plan", "claim"]
    hit = rendered.select(*keys).distinct().withColumn("hit", F.lit(1))
    counted = accepted.select(*keys).distinct().join(hit, keys, "left").groupBy("plan").agg(F.count("*").alias("n"), F.count("hit").alias("covered"))
    return counted.withColumn("rate", F.col("covered") / F.col("n"))


def link_diff(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """The pairs of ``keys`` that one side lacks, with ``change`` added or removed; nulls are equal to each other."""
    one, two = before.select(*keys).distinct(), after.select(*keys).distinct()
    return two.exceptAll(one).withColumn("change", F.lit("added")).unionByName(one.exceptAll(two).withColumn("change", F.lit("removed")))
