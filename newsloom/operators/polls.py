"""Polls: what is wrong with each record, which may be compared, and what a record is compared within."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fields that a complete methodology has, and the precisions of fieldwork dates.
COMPLETE = ("pollster", "field_start", "field_end", "sample_size", "sampling_method", "interview_method", "eligible_population")
PRECISION = ("exact", "month_only", "unknown")
INTERNAL, ONLINE = "internal_poll_claim", "online_vote"
NORMALISED, NOT_100, NO_POLLSTER = ("归一", "normalize"), ("非100", "不"), ("调查执行机构未公开",)


def poll_issues(polls: DataFrame, election: str, types: tuple[str, ...], statuses: tuple[str, ...]) -> DataFrame:
    """``poll_id, severity, check, detail``: a row for each rule that a record breaks, in one projection.

    ``polls``: ``poll_id, election_id, poll_type, fact_status, methodology_complete,
    field_start, field_end, sample_size, source_ids, pollster, sampling_method,
    interview_method, eligible_population, trend, scientific, syndicated, precision,
    limitations``, ``questions`` (an array with ``question_id``) and ``results`` (an array
    with ``question_id, reported, normalized``). Missing texts count as blank, missing
    flags as false, but ``trend`` and ``scientific`` as true where that is the fault; a
    missing precision is exact.
    """
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    flag = lambda c, default=False: F.coalesce(F.col(c), F.lit(default))
    items = lambda c: F.coalesce(F.size(c), F.lit(0))
    kind, complete, precision = text("poll_type"), flag("methodology_complete"), F.coalesce("precision", F.lit("exact"))
    says = lambda words: F.exists(F.coalesce("limitations", F.array().cast("array<string>")), lambda x: F.greatest(*[F.contains(F.lower(x), F.lit(w)) for w in words], F.lit(False)))
    asked = F.transform("questions", lambda q: q["question_id"])
    orphan = F.filter(F.transform("results", lambda r: F.coalesce(r["question_id"], F.lit(""))), lambda q: (q != "") & ~F.array_contains(F.coalesce(asked, F.array().cast("array<string>")), q))
    number = lambda r: F.trim(F.replace(r["reported"], F.lit("%"), F.lit(""))).try_cast("double")
    moved = F.filter("results", lambda r: F.coalesce(F.abs(number(r) - r["normalized"]) > 0.5, F.lit(False)))
    known = F.filter(F.transform("results", lambda r: r["normalized"]), lambda v: v.isNotNull())
    total = F.aggregate(known, F.lit(0.0), lambda a, v: a + v)
    missing = [F.when(F.coalesce(F.col(c).cast("string"), F.lit("")).isin("", "0"), F.lit(c)) for c in COMPLETE]
    sized = F.col("sample_size").isNotNull() & (F.col("sample_size") <= 0)
    nobody = text("pollster") == ""

    def rule(severity: str, check: str, broken: Column, detail: Column | str = "") -> Column:
        value = F.lit(detail) if isinstance(detail, str) else detail.cast("string")
        return F.when(F.coalesce(broken, F.lit(False)), F.array(F.struct(F.lit(severity).alias("severity"), F.lit(check).alias("check"), value.alias("detail"))))

    many = lambda check, values: F.transform(values, lambda v: F.struct(F.lit("error").alias("severity"), F.lit(check).alias("check"), v.alias("detail")))
    every = [
        rule("error", "poll_id_present", text("poll_id") == ""), rule("error", "election_id_valid", text("election_id") != election, text("election_id")), rule("error", "poll_type_valid", ~kind.isin(*types), kind),
        rule("error", "fact_status_valid", ~text("fact_status").isin(*statuses), text("fact_status")),
        rule("error", "field_dates_valid", (text("field_start") != "") & (text("field_end") != "") & (text("field_start") > text("field_end"))), rule("error", "sample_size_valid", sized, F.col("sample_size")),
        rule("error", "questions_not_empty", items("questions") <= 0), rule("error", "results_not_empty", items("results") <= 0), rule("error", "source_ids_not_empty", items("source_ids") <= 0),
        many("result_question_ids_valid", orphan), F.when(complete, many("methodology_complete_consistent", F.array_compact(F.array(*missing)))),
        rule("warning", "internal_poll_not_scientific", (kind == INTERNAL) & (flag("trend", True) | flag("scientific", True))), rule("warning", "online_vote_not_scientific", (kind == ONLINE) & flag("scientific", True)),
        rule("error", "no_duplicate_syndicated_poll", flag("syndicated")), rule("error", "no_unjustified_normalization", (F.size(moved) > 0) & ~says(NORMALISED)),
        rule("warning", "sum_is_100", (F.size(known) > 0) & (F.abs(total - 100) > 1) & ~says(NOT_100)), rule("error", "fieldwork_precision_valid", ~precision.isin(*PRECISION), precision),
        rule("error", "exact_fieldwork_has_dates", (precision == "exact") & ((text("field_start") == "") | (text("field_end") == ""))),
        rule("error", "vague_fieldwork_not_complete", precision.isin("month_only", "unknown") & complete), rule("error", "vague_fieldwork_no_trend", precision.isin("month_only", "unknown") & flag("trend")),
        rule("error", "no_pollster_not_complete", nobody & (kind != ONLINE) & complete), rule("error", "no_pollster_no_trend", nobody & (kind != ONLINE) & (flag("trend") | ((kind == INTERNAL) & flag("scientific")))),
        rule("warning", "pollster_not_published", nobody & (kind == INTERNAL) & ~says(NO_POLLSTER)),
    ]
    none = F.array().cast("array<struct<severity:string,check:string,detail:string>>")
    return polls.select("poll_id", F.explode(F.flatten(F.array(*[F.coalesce(e, none) for e in every]))).alias("i")).select("poll_id", "i.*")


def group_key(population: Column, question: Column, candidates: Column) -> Column:
    """What polls are comparable within: population, kind of question, and the set of candidates in order."""
    return F.concat_ws("|", F.coalesce(population, F.lit("unknown")), F.coalesce(question, F.lit("unknown")), F.array_join(F.array_sort(F.coalesce(candidates, F.array().cast("array<string>"))), "_"))


def conflicts(a: Column, b: Column) -> Column:
    """Why two polls aren't comparable, as an array: empty if they are. Each is a struct of ``candidates, population, question, kind``."""
    blank = lambda c: F.coalesce(c, F.lit(""))
    ordered = lambda c: F.array_sort(F.array_distinct(F.coalesce(c, F.array().cast("array<string>"))))
    return F.array_compact(F.array(
        F.when(ordered(a["candidates"]) != ordered(b["candidates"]), "candidate_sets_differ"),
        F.when((blank(a["population"]) != blank(b["population"])) & (blank(a["population"]) != "") & (blank(b["population"]) != ""), "populations_differ"),
        F.when(blank(a["question"]) != blank(b["question"]), "question_types_differ"), F.when(a["kind"].isin(INTERNAL, ONLINE) | b["kind"].isin(INTERNAL, ONLINE), "internal_or_online"),
    ))
