"""Messages, references and text measures on hand-worked rows."""

import datetime as dt

from pyspark.sql import functions as F

from newsloom.functions import text as T
from newsloom.functions import times
from newsloom.operators import notifications as N
from newsloom.operators import reconcile as R


def test_messages_need_every_condition(spark):
    day = dt.datetime(2026, 1, 1)
    events = spark.createDataFrame([(1, "a", "u1", True, 1), (2, "a", "u2", True, 2), (3, "", "u3", True, 3), (4, "d", "u4", None, 4), (5, "e", "u5", True, 5), (6, "f", "u6", True, 6), (7, None, "u7", True, 7)], "event int, event_id string, canonical string, relevant boolean, seq int")
    rows = [(e, f"m{e}", "s", day, "fresh", True) for e in (1, 2, 3, 4, 5, 6, 7)] + [(1, "m1b", "z", day, "fresh", None), (5, "m5b", "s", day, None, False), (6, "m6b", None, None, "stale", False)]
    members = spark.createDataFrame(rows, "event int, url string, source string, ts timestamp, state string, international boolean")
    results = spark.createDataFrame([(f"m{e}", "important", 70) for e in (1, 2, 3, 4, 5, 7)] + [("m1b", "critical", 66), ("m6", "critical", 64)], "url string, level string, score int")
    seen = spark.createDataFrame([("url:u7",)], "key string")
    found = {r["event"]: tuple(r)[1:] for r in N.notification_candidates(events, members, results, seen).collect()}
    assert found == {1: ("event:a", "critical", 66, "m1b", "z", 2), 3: ("url:u3", "important", 70, "m3", "s", 1)}
    assert N.notification_candidates(events.limit(0), members, results, seen).count() == 0


def test_exact_cover(spark):
    accepted = spark.createDataFrame([("p", 1, "A"), ("p", 2, "A"), ("p", 3, "B")], "plan string, claim int, section string")
    rendered = spark.createDataFrame([("p", 1), ("p", 1), ("p", 9)], "plan string, claim int")
    sections = spark.createDataFrame([("p", 1, "A"), ("p", 3, "A"), ("p", 3, "B"), ("p", 8, "A")], "plan string, claim int, section string")
    assert {tuple(r) for r in R.exact_cover(accepted, rendered, sections).collect()} == {("p", 1, "rendered_again"), ("p", 2, "missing"), ("p", 2, "section_missing"), ("p", 3, "missing"), ("p", 3, "section_again"), ("p", 3, "section_mismatch"), ("p", 9, "unauthorized"), ("p", 8, "section_unauthorized")}
    assert tuple(R.coverage_rate(accepted, rendered).first()) == ("p", 3, 1, 1 / 3) and R.exact_cover(accepted.limit(0), rendered.limit(0), sections.limit(0)).count() == 0


def test_references(spark):
    kinds = "owner int, kind string, ref string"
    before, after = spark.createDataFrame([(1, "e", "x"), (1, "e", "y"), (1, "e", "y"), (1, "e", "z")], kinds), spark.createDataFrame([(1, "e", "x"), (1, "e", "w")], kinds)
    found = R.reference_changes(before, after, spark.createDataFrame([("e", "y")], "kind string, ref string"))
    assert {(r["ref"], r["change"]) for r in found.collect()} == {("w", "added"), ("y", "removed_still_formal"), ("z", "deleted")}
    refs = spark.createDataFrame([(1, "f", "x"), (1, "f", "x"), (1, "g", "x"), (1, "g", None), (2, "f", "")], "owner int, field string, ref string")
    assert {tuple(r) for r in R.reference_faults(refs, refs.select("ref").limit(0)).collect()} == {(1, "within_field_duplicate", "x", 2), (1, "cross_field_reuse", "x", 2), (1, "missing_id", "x", 1)}


def test_text_and_zones(spark):
    row = spark.range(1).select(
        T.chinese_characters(F.lit("a中文b")).alias("n"), T.phrase_tokens(F.lit("The cross-strait's U.S. x--y")).alias("t"), T.without_information(F.lit("值得關注，有待觀察。ok"), ("值得關注", "有待觀察")).alias("z"), T.with_terms(F.lit("Fed and FedEx, the fed"), {"fed": "聯準會"}).alias("w"),
        T.chinese_characters(F.lit(None).cast("string")).alias("none")).first()
    assert (row["n"], row["t"], row["z"], row["w"], row["none"]) == (2, ["the", "cross-strait", "s", "u", "s", "x", "y"], True, "聯準會 and FedEx, the 聯準會", 0)
    zone = lambda t, a=None: spark.range(1).select(times.to_zone(F.lit(t).cast("string"), "Asia/Taipei", a).alias("x")).first()["x"]
    assert zone("2026-01-01T00:00:00Z") == dt.datetime(2026, 1, 1, 8) and zone("2026-01-01T00:00:00+02:00") == dt.datetime(2026, 1, 1, 6) and zone("2026-01-01T00:00:00") is None
    assert zone("2026-01-01 00:00:00", "UTC") == dt.datetime(2026, 1, 1, 8) and zone("soon", "UTC") is None and zone(None, "UTC") is None and zone("2026-01-01", "Asia/Taipei") == dt.datetime(2026, 1, 1)
