"""Date and time expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FRESH, FUTURE, CATCH_UP = 90, 10, 720


def minutes_between(later: Column, earlier: Column) -> Column:
    return (F.unix_micros(later.cast("timestamp")) - F.unix_micros(earlier.cast("timestamp"))) / 60_000_000


def freshness(published: Column, clock: Column, fresh: int = FRESH, future: int = FUTURE, catch_up: int = CATCH_UP) -> Column:
    """unknown, future, fresh, catch_up or stale; all bounds inclusive."""
    age = minutes_between(clock, published)
    return F.when(published.isNull(), "unknown").when(age < -future, "future").when(age <= fresh, "fresh").when(age <= catch_up, "catch_up").otherwise("stale")


def floor_days(a: Column, b: Column) -> Column:
    """|floor((a - b) in days)|: seven days and a second count as 7 one way and 8 the other."""
    return F.abs(F.floor((F.unix_micros(a.cast("timestamp")) - F.unix_micros(b.cast("timestamp"))) / 86_400_000_000))


#: Up to how many days apart how close two times are.
CLOSENESS = ((1, 1.0), (7, 0.7), (30, 0.3))


def closeness(days: Column) -> Column:
    """1, 0.7, 0.3 or 0 at up to 1, 7, 30 days and beyond; 0 if unknown."""
    return F.when(days.isNull(), 0.0).when(days <= 1, 1.0).when(days <= 7, 0.7).when(days <= 30, 0.3).otherwise(0.0)


def half_month(day: Column) -> Column:
    """First day of the half month that a date lies in."""
    first = F.trunc(day.cast("date"), "month")
    return F.when(F.dayofmonth(day) <= 15, first).otherwise(F.date_add(first, 15))


def half_month_end(day: Column) -> Column:
    first = F.trunc(day.cast("date"), "month")
    return F.when(F.dayofmonth(day) <= 15, F.date_add(first, 14)).otherwise(F.last_day(day.cast("date")))


def previous_half_month(day: Column) -> Column:
    return half_month(F.date_sub(half_month(day), 1))


def run_period_start(run_day: Column) -> Column:
    """Start of what a run reports on: the 9th reports the previous month from the 16th, the 22nd its own month's first half; other days null."""
    first = F.trunc(run_day.cast("date"), "month")
    return F.when(F.dayofmonth(run_day) == 9, F.date_add(F.add_months(first, -1), 15)).when(F.dayofmonth(run_day) == 22, first)


#: Dates in text, in the order in which they are tried: pattern, and which of its groups is year, month and day.
DATES = (
    (r"(20\d{2})年(\d{1,2})月(\d{1,2})日", (1, 2, 3)), (r"(\d{1,2})月(\d{1,2})日", (0, 1, 2)), (r"(20\d{2})-(\d{1,2})-(\d{1,2})", (1, 2, 3)),
    (r"(\d{1,2})/(\d{1,2})", (0, 1, 2)), (r"(?<!\d)(\d{1,2})日", (0, 0, 1)),
)
#: Words for days, by distance from the day of publication.
RELATIVE = (("昨日", -1), ("昨天", -1), ("今日", 0), ("今天", 0), ("明日", 1), ("明天", 1))


def event_date(title: Column, summary: Column, published: Column) -> Column:
    """``date`` (a timestamp), ``basis`` and ``confidence`` of what an article reports.

    The first date of each pattern that is one, in the title, then the summary
    (``explicit_in_title``, ``explicit_in_summary``, high); what a pattern leaves out
    is taken from the publication. Then words such as yesterday (medium, the time
    of day kept), then the publication itself (``inferred_from_publication``, low).
    Without any it is null and ``unknown``. Dates that don't exist are passed over.
    """
    fields = (("explicit_in_title", F.coalesce(title, F.lit(""))), ("explicit_in_summary", F.coalesce(summary, F.lit(""))))
    moment = published.cast("timestamp")
    own = {0: F.year(moment), 1: F.month(moment)}
    found = []
    for basis, text in fields:
        for pattern, groups in DATES:
            parts = [F.regexp_extract(text, pattern, g).cast("string") if g else own[i].cast("string") for i, g in enumerate(groups)]
            there = F.regexp_extract(text, pattern, groups[2]) != ""
            date = F.concat_ws("-", *[F.lpad(p, n, "0") for p, n in zip(parts, (4, 2, 2), strict=True)]).try_cast("date").cast("timestamp")
            whole = there & parts[0].isNotNull() & parts[1].isNotNull()
            found.append(F.when(whole & date.isNotNull(), F.struct(date.alias("date"), F.lit(basis).alias("basis"), F.lit("high").alias("confidence"))))
    for basis, text in fields:
        for word, days in RELATIVE:
            moved = moment + F.make_dt_interval(days=F.lit(days))
            found.append(F.when(F.contains(text, F.lit(word)) & moment.isNotNull(), F.struct(moved.alias("date"), F.lit(basis).alias("basis"), F.lit("medium").alias("confidence"))))
    found.append(F.when(moment.isNotNull(), F.struct(moment.alias("date"), F.lit("inferred_from_publication").alias("basis"), F.lit("low").alias("confidence"))))
    return F.coalesce(*found, F.struct(F.lit(None).cast("timestamp").alias("date"), F.lit("unknown").alias("basis"), F.lit("unknown").alias("confidence")))


def to_zone(text: Column, zone: str, assumed: str | None = None) -> Column:
    """A time as text, with an offset or not, as local time of a zone (a timestamp without zone).

    A time without an offset is taken as of ``assumed``, or is null without one; what isn't a time is null.
    """
    there = text.rlike("(Z|[+-][0-9]{2}:?[0-9]{2})$") & text.rlike(":")
    plain = F.regexp_replace(text, "T", " ")
    aware = F.convert_timezone(F.lit("UTC"), F.lit(zone), F.to_utc_timestamp(F.try_to_timestamp(plain), F.current_timezone()).cast("timestamp_ntz"))
    naive = F.convert_timezone(F.lit(assumed), F.lit(zone), plain.try_cast("timestamp_ntz")) if assumed else F.lit(None).cast("timestamp_ntz")
    return F.when(there, aware).otherwise(naive)
