"""Decisions on hand-worked rows, with nulls and empty tables."""

import datetime as dt

from pyspark.sql import functions as F

from newsloom.operators import decisions as D

WORDS = D.Tables(("taiwan",), ("china",), ("washington",), ("beijing",), ("pentagon",), ("missile", "trade"), ("missile",), ("tsmc",), (("military", ("missile",)),))


def test_relevance_takes_the_first_rule(spark):
    rows = ["Taiwan and China missile", "China missile", "Beijing meets Pentagon", "China and Washington", "China trade", "Washington", None, "TSMC"]
    found = spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "i int, t string").select("i", D.relevance_decision(F.col("t"), F.lit(None).cast("string"), F.lit("s"), WORDS).alias("d")).orderBy("i").collect()
    assert [(r["d"]["relevant"], r["d"]["tier"]) for r in found] == [(True, "direct"), (True, "first_party"), (True, "pair"), (True, "second_party"), (False, "first_party"), (False, "second_party"), (False, "other"), (False, "other")]
    assert found[0]["d"]["reason"] == "direct entity or context: taiwan; topics=military" and found[0]["d"]["keywords"] == ["taiwan", "china", "missile"] and found[7]["d"]["entities"] == ["tsmc"] and found[2]["d"]["topics"] == ["international"]
    assert found[6]["d"]["input_hash"] != found[7]["d"]["input_hash"]


def test_labels_and_missing_evidence(spark):
    names = ("region", "election", "action", "statement", "media", "uncertain", "national", "other_race", "internal", "empty", "broken")

    def label(actors=None, phrase=None, **on):
        row = spark.range(1).select(D.relevance_label({"actors": F.lit(actors).cast("array<string>") if actors is None else F.array(*map(F.lit, actors)), "phrase": F.lit(phrase).cast("string"), **{n: F.lit(on.get(n)).cast("boolean") for n in names}}).alias("r")).first()["r"]
        return row["label"], row["reasons"]

    assert label() == ("irrelevant", ["no_direct_relation"])
    assert label(region=True, phrase="rally") == ("direct_event", ["region_evidence", "action_evidence:rally", "region_plus_direct_action"])
    assert label(actors=["A", "B"], statement=True, election=True)[0] == "direct_statement" and label(actors=["A"], statement=True)[1][-1] == "statement_without_election_context"
    assert label(region=True, national=True)[0] == "contextual" and label(empty=True, region=True)[0] == "collection_error" and label(other_race=True)[0] == "irrelevant"


def test_gates_need_everything(spark):
    kinds = "id int, risk string, label string, date date, basis string, precision string, confidence string, type string, valid boolean, duplicate string, review string, key string"
    good = (1, "low", "direct_event", dt.date(2026, 1, 1), "explicit_in_title", "day", "high", "poll", True, "no_match", None, "k1")
    rows = [good, (2, *(None,) * 11), (3, *good[1:])]
    policy = {"risk": ("low",), "label": ("direct_event",), "forbidden_basis": ("unknown",), "source_status": ("exact",)}
    facts, sources = spark.createDataFrame([(1,), (3,)], "id int"), spark.createDataFrame([(1, "s", "exact"), (3, "s", "exact"), (3, None, "exact")], "id int, formal string, status string")
    history, formal = spark.createDataFrame([(3, "approve"), (1, "hold")], "id int, decision string"), spark.createDataFrame([("k9",), (None,)], "key string")
    found = {r["id"]: (r["decision"], r["reasons"]) for r in D.publication_gates(spark.createDataFrame(rows, kinds), facts, sources, history, formal, policy).collect()}
    assert found[1] == ("eligible", []) and found[3] == ("rejected", ["sources_resolved", "no_approve_decision"])
    assert found[2][1] == ["risk_level_low", "relevance_direct_event", "has_observed_fact", "date_explicit", "event_type_known", "validation_ready", "duplicate_status_no_match", "sources_resolved"]


def test_golden_rules_and_rates(spark):
    ranks = spark.createDataFrame([("q", "a", 1), ("q", "b", 2)], "query string, item string, rank int")
    rules = [("q", "include", "a", None, None, True), ("q", "include", "z", None, None, False), ("q", "exclude", "z", None, None, True), ("q", "first", "b", None, None, False), ("q", "before", "a", "b", None, True), ("q", "before", "a", "z", None, False), ("q", "most", "m", None, 2, True), ("none", "most", "m2", None, 0, True)]
    golden = spark.createDataFrame([r[:5] for r in rules], "query string, kind string, item string, other string, most int")
    assert sorted(map(tuple, D.golden_search(ranks, golden).select("kind", "item", "ok").collect())) == sorted((k, i, ok) for _, k, i, _, _, ok in rules)
    pairs = spark.createDataFrame([("a", "a"), ("a", "b"), ("b", None), (None, "a")], "expected string, predicted string")
    assert tuple(D.adjudication(pairs).first()) == (3, 1, 1, 1 / 3, 0.5, 1 / 3) and tuple(D.adjudication(pairs.limit(0)).first()) == (0, 0, 0, 0.0, 0.0, 0.0)
