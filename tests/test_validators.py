"""Event dates, relations of clusters, polls and coverage on hand-worked rows."""

import datetime as dt

from pyspark.sql import functions as F

from newsloom.functions import times
from newsloom.operators import clustering, coverage, polls


def test_event_dates(spark):
    base = dt.datetime(2026, 7, 3, 8, 30)
    cases = [
        (("2026年7月1日登記", "", base), (dt.datetime(2026, 7, 1), "explicit_in_title", "high")), (("無", "於6月30日", base), (dt.datetime(2026, 6, 30), "explicit_in_summary", "high")),
        (("2月30日", "2026-06-05", base), (dt.datetime(2026, 7, 30), "explicit_in_title", "high")), (("9日", None, base), (dt.datetime(2026, 7, 9), "explicit_in_title", "high")),
        (("昨日", "", base), (dt.datetime(2026, 7, 2, 8, 30), "explicit_in_title", "medium")), (("", "明天", base), (dt.datetime(2026, 7, 4, 8, 30), "explicit_in_summary", "medium")), ((None, None, base), (base, "inferred_from_publication", "low")),
        (("7月1日", "昨日", None), (None, "unknown", "unknown")), (("123日 99/99", "", base), (base, "inferred_from_publication", "low")), (("2026-6-5", "", None), (dt.datetime(2026, 6, 5), "explicit_in_title", "high")),
    ]
    df = spark.createDataFrame([(i, *c) for i, (c, _) in enumerate(cases)], "i int, t string, s string, p timestamp")
    found = {r["i"]: tuple(r["d"]) for r in df.select("i", times.event_date(F.col("t"), F.col("s"), F.col("p")).alias("d")).collect()}
    assert found == {i: want for i, (_, want) in enumerate(cases)}


def test_relations(spark):
    a, b = dt.datetime(2026, 1, 1), dt.datetime(2026, 1, 8, 23)
    rows = [("x", "x", a, b, "m", "n", False), ("x", "x", a, b, "m", "", None), ("x", "y", a, b, "m", "m", True), ("x", "x", a, dt.datetime(2026, 1, 9), "m", "m", True), ("x", "y", a, b, "", "", False), (None, None, a, b, "m", "n", False), ("x", "x", None, b, "m", "n", True)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, a string, b string, s timestamp, t timestamp, m string, n string, w boolean")
    found = [tuple(r["r"]) for r in df.select("i", clustering.relationship(F.col("a"), F.col("b"), F.col("t"), F.col("s"), F.col("m"), F.col("n"), F.col("w")).alias("r")).orderBy("i").collect()]
    assert [x for x, _ in found] == ["possible_subevent", "related_event", "related_event", "separate_event", "separate_event", "separate_event", "separate_event"]
    assert found[3][1] == "date_window_exceeded" and found[5][1] == "different_primary_actor" and found[2][1] == "allegation_response_close_date"


def test_candidate_ids_depend_on_the_anchor_only(spark):
    kinds = "id long, url string, ts timestamp"
    one = spark.createDataFrame([(10, "u10", dt.datetime(2026, 1, 2)), (9, "u9", dt.datetime(2026, 1, 2)), (1, "u1", None)], kinds)
    two = one.unionByName(spark.createDataFrame([(30, "x", dt.datetime(2026, 3, 1))], kinds))
    ids = [clustering.candidate_ids(df, df.select("id", F.lit("c").alias("cluster"))).first() for df in (one, two)]
    assert ids[0] == ids[1] and ids[0]["anchor"] == 10 and len(ids[0]["candidate_id"]) == len("cand_") + 10  # "10" comes before "9"


def test_poll_rules_and_empty_tables(spark):
    kinds = ("poll_id string, election_id string, poll_type string, fact_status string, methodology_complete boolean, field_start string, field_end string, sample_size int, source_ids array<string>, pollster string, sampling_method string, interview_method string, "
             "eligible_population string, trend boolean, scientific boolean, syndicated boolean, precision string, limitations array<string>, questions array<struct<question_id:string>>, results array<struct<question_id:string,reported:string,normalized:double>>")
    good = ("p1", "E", "public_poll", "verified", True, "2026-01-01", "2026-01-02", 900, ["s"], "P", "r", "tel", "all", True, True, False, None, None, [("q",)], [("q", "40%", 40.0), ("q", "x", 60.0)])
    bare = ("p2", None, None, None, None, None, None, None, None, None, None, None, None, None, None, None, None, None, None, None)
    df = spark.createDataFrame([good, bare], kinds)
    found = polls.poll_issues(df, "E", ("public_poll",), ("verified",))
    assert {(r["poll_id"], r["check"]) for r in found.collect()} == {("p2", c) for c in ("election_id_valid", "poll_type_valid", "fact_status_valid", "questions_not_empty", "results_not_empty", "source_ids_not_empty", "exact_fieldwork_has_dates")}
    assert polls.poll_issues(df.limit(0), "E", (), ()).count() == 0


def test_coverage_of_groups_without_events(spark):
    events = spark.createDataFrame([("a", 1, dt.datetime(2026, 1, 2), "k"), ("a", 2, dt.datetime(2026, 1, 2), "k"), ("a", 3, dt.datetime(2025, 1, 1), "z")], "g string, id long, ts timestamp, kind string")
    groups = spark.createDataFrame([("a", dt.date(2026, 1, 3)), ("b", dt.date(2026, 1, 2)), (None, None)], "g string, cutoff date")
    found = coverage.gaps(events, "g", F.col("ts"), F.col("kind"), "2026-01-01", "2026-01-03", groups, ("k",))
    d = lambda n: dt.date(2026, 1, n)
    assert {(r["g"], r["kind"], r["gap_start"], r["gap_end"], r["blocking"]) for r in found.collect()} == {
        ("a", "no_event_day", d(1), d(1), False), ("a", "no_event_day", d(3), d(3), False), ("b", "unreviewed_period", d(3), d(3), True), ("b", "missing_required_dimension", None, None, True), ("b", "no_event_day", d(1), d(3), False),
        (None, "unreviewed_period", d(1), d(3), True), (None, "missing_required_dimension", None, None, True), (None, "no_event_day", d(1), d(3), False)}
    rows = {r["g"]: (r["n_events"], r["status"], r["version"][:22]) for r in coverage.coverage(events, found, "g", "id", F.col("ts"), "2026-01-01", "2026-01-03", groups).collect()}
    assert rows == {"a": (2, "full", "fact_coverage_20260103"), "b": (0, "partial", "fact_coverage_20260102"), None: (0, "partial", "fact_coverage_20260103")}
