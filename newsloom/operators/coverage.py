"""Coverage of a period: what was reviewed, which gaps block, a status, and whether a stated coverage holds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Kinds of gaps, and whether they block a full status.
BLOCKING = ("unreviewed_period", "missing_required_dimension", "source_outage")
HARMLESS = ("no_event_day", "poll_absence")
FORBIDDEN = ("who_leads", "win_rate", "advantage", "领先", "优势扩大", "胜算")


def gaps(events: DataFrame, group: str, day: Column, kind: Column, start: str, end: str, cutoffs: DataFrame, dimensions: tuple[str, ...]) -> DataFrame:
    """``group, kind, gap_start, gap_end, detail, blocking``: the gaps of each group of ``cutoffs`` (``group, cutoff``) in a period.

    A period that reaches beyond a group's cutoff (all of it, if there is none) is
    unreviewed; a dimension without an event in the period is missing; runs of
    days without events are gaps that don't block.
    """
    a, b = F.lit(start).cast("date"), F.lit(end).cast("date")
    own = cutoffs.select(group, F.col("cutoff").cast("date").alias("cutoff"))
    inside = events.select(F.col(group).alias("__g"), day.cast("date").alias("__d"), kind.alias("__k")).where(F.col("__d").between(a, b))
    line = lambda df, name, low, high, detail: df.select(group, F.lit(name).alias("kind"), low.alias("gap_start"), high.alias("gap_end"), detail.alias("detail"))
    late = own.where(F.coalesce(F.col("cutoff") < b, F.lit(True)))
    unreviewed = line(late, "unreviewed_period", F.greatest(a, F.coalesce(F.date_add("cutoff", 1), a)), b, F.coalesce(F.col("cutoff").cast("string"), F.lit("")))
    wanted = own.select(group, F.explode(F.array(*[F.lit(x) for x in dimensions])).alias("dim")) if dimensions else own.select(group, F.lit("").alias("dim")).limit(0)
    held = inside.select("__g", "__k").distinct()
    lacking = wanted.join(held, F.col(group).eqNullSafe(F.col("__g")) & (F.col("dim") == F.col("__k")), "left_anti")
    nothing = F.lit(None).cast("date")
    missing = line(lacking, "missing_required_dimension", nothing, nothing, F.col("dim"))
    # the days with events, with the day before the period and the one after it as ends
    days = inside.groupBy("__g").agg(F.array_sort(F.collect_set("__d")).alias("days"))  # as many as the period has days
    marked = own.join(days, F.col(group).eqNullSafe(F.col("__g")), "left").select(group, F.concat(F.array(F.date_sub(a, 1)), F.coalesce("days", F.array().cast("array<date>")), F.array(F.date_add(b, 1))).alias("days"))
    runs = marked.select(group, F.explode(F.transform(F.sequence(F.lit(1), F.size("days") - 1), lambda i: F.struct(F.date_add(F.get("days", i - 1), 1).alias("low"), F.date_sub(F.get("days", i), 1).alias("high")))).alias("r")).where("r.low <= r.high")
    empty = line(runs, "no_event_day", F.col("r.low"), F.col("r.high"), F.lit(""))
    return unreviewed.unionByName(missing).unionByName(empty).withColumn("blocking", F.col("kind").isin(*BLOCKING))


def coverage(events: DataFrame, found: DataFrame, group: str, key: str, day: Column, start: str, end: str, cutoffs: DataFrame) -> DataFrame:
    """One row for each group: events in the period, their latest day, gaps of both sorts, ``status`` and ``version``.

    ``found`` are the group's gaps. The status is ``full`` only if the cutoff reaches
    the end and no gap blocks; the latest event's day is never taken for a cutoff.
    The version names the cutoff's day (or the period's end) and a number from the
    content: cutoff, counts and blocking gaps.
    """
    a, b = F.lit(start).cast("date"), F.lit(end).cast("date")
    inside = events.where(day.cast("date").between(a, b)).groupBy(F.col(group).alias("__e")).agg(F.count("*").alias("n_events"), F.max(day.cast("date")).alias("latest_event"), F.bit_xor(F.xxhash64(key)).alias("__ids"))
    counted = found.groupBy(F.col(group).alias("__c")).agg(F.count_if("blocking").alias("n_blocking"), F.count_if(~F.col("blocking")).alias("n_harmless"))
    own = cutoffs.select(group, F.col("cutoff").cast("date").alias("cutoff"))
    rows = own.join(inside, F.col(group).eqNullSafe(F.col("__e")), "left").join(counted, F.col(group).eqNullSafe(F.col("__c")), "left").fillna(0, ["n_events", "n_blocking", "n_harmless"])
    status = F.when((F.col("cutoff") >= b) & (F.col("n_blocking") == 0), "full").otherwise("partial")
    content = F.sha2(F.concat_ws("|", F.coalesce(F.col("cutoff").cast("string"), F.lit("")), F.col("n_events").cast("string"), F.col("n_blocking").cast("string")), 256)
    number = F.conv(F.substring(content, 1, 8), 16, 10).cast("bigint") % 1000 + 1
    version = F.concat(F.lit("fact_coverage_"), F.date_format(F.coalesce("cutoff", b), "yyyyMMdd"), F.lit("_v"), F.lpad(number.cast("string"), 3, "0"))
    return rows.select(group, "n_events", "latest_event", "cutoff", "n_blocking", "n_harmless", status.alias("status"), version.alias("version"))


def stated_faults(stated: DataFrame, ids: DataFrame) -> DataFrame:
    """``key, check``: what is wrong with stated coverages, a row for each fault.

    ``stated``: ``key, period_start, period_end, cutoff`` (dates), ``status``, ``version``,
    ``provenance``, ``n_blocking``, ``ranges`` (uncovered, an array of ``low, high``), ``event_ids``
    and ``fields`` (names of all fields); ``ids`` has the ``id`` of each existing event.
    """
    s, e, c = (F.col(x).cast("date") for x in ("period_start", "period_end", "cutoff"))
    full, short = F.col("status") == "full", F.coalesce(c < e, F.lit(False))
    disclosed = F.exists("ranges", lambda r: (r["low"] <= F.date_add(c, 1)) & (F.date_add(c, 1) <= r["high"]))
    rules = {
        "coverage_status_allowed": ~F.coalesce(F.col("status").isin("full", "partial"), F.lit(False)), "coverage_version_format": ~F.coalesce(F.col("version").rlike("^fact_coverage_[0-9]{8}_v[0-9]{3,4}$"), F.lit(False)),
        "date_ranges_valid": s.isNull() | e.isNull() | (s >= e), "facts_cutoff_not_derived_from_latest_event": F.coalesce(F.col("provenance") == "derived_from_latest_event", F.lit(False)),
        "full_status_requires_cutoff": full & (c.isNull() | short), "coverage_status_consistent_with_gap_state": full & (F.col("n_blocking") > 0), "uncovered_ranges_valid": F.exists("ranges", lambda r: r["low"] > r["high"]),
        "unreviewed_period_disclosed": short & ~F.coalesce(disclosed, F.lit(False)), "no_inference": F.arrays_overlap("fields", F.array(*[F.lit(x) for x in FORBIDDEN])),
    }
    own = stated.select("key", F.explode(F.array_compact(F.array(*[F.when(F.coalesce(v, F.lit(False)), F.lit(k)) for k, v in rules.items()]))).alias("check"))
    known = ids.select(F.col("id").alias("__id")).distinct()
    unknown = stated.select("key", F.explode("event_ids").alias("id")).join(known, F.col("id") == F.col("__id"), "left_anti").select("key", F.lit("all_event_ids_resolve").alias("check")).distinct()
    return own.unionByName(unknown)
