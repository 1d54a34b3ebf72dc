"""Grounding, fuzzy names and names in texts against nested loops."""

import difflib
import random
import re

import pandas as pd
import pytest
from pyspark.sql import functions as F

from newsloom.operators import grounding, resolution


def sets(r, n, letters, most):
    return [(i, r.sample(letters, r.randint(0, min(most, len(letters))))) for i in range(n)]


@pytest.mark.parametrize("percent", [30, 55, 100])
def test_overlap_pairs_equal_all_pairs(spark, percent):
    r = random.Random(percent)
    one, two = sets(r, 50, "abcdefghijkl", 9), sets(r, 60, "abcdefghijkl", 12)
    kinds = "id long, tokens array<string>"
    a, b = spark.createDataFrame([*one, (99, None)], kinds), spark.createDataFrame(two, kinds)
    enough = lambda s, t: s and t and 100 * len(set(s) & set(t)) >= percent * min(len(s), len(t))
    found = {(x["a"], x["b"]): (x["common"], x["smaller"]) for x in grounding.overlap_pairs(a, b, percent).collect()}
    assert found == {(i, j): (len(set(s) & set(t)), min(len(s), len(t))) for i, s in one for j, t in two if enough(s, t)}
    own = {(x["a"], x["b"]) for x in grounding.overlap_pairs(a, a, percent, same=True).collect()}
    assert own == {(i, j) for i, s in one for j, t in one if i < j and enough(s, t)}
    assert grounding.overlap_pairs(a.limit(0), b, percent).count() == 0


@pytest.mark.parametrize("few", [500_000, 3])
def test_overlap_pairs_read_each_text_once(spark, monkeypatch, few):
    monkeypatch.setattr(grounding, "FEW", few, raising=False)
    r, read = random.Random(few), spark.sparkContext.accumulator(0)

    @F.pandas_udf("array<string>")
    def words(texts: pd.Series) -> pd.Series:
        read.add(len(texts))
        return texts.str.split()

    one, two = sets(r, 20, "abcdefghijkl", 9), sets(r, 40, "abcdefghijklmnop", 12)
    a, b = (spark.createDataFrame([(i, " ".join(s)) for i, s in x if s], "id long, text string") for x in (one, two))
    one, two = ({i: set(s) for i, s in x if s} for x in (one, two))
    found = {(x["a"], x["b"]): x["common"] for x in grounding.overlap_pairs(*(x.select("id", words("text").alias("tokens")) for x in (a, b)), 55).collect()}
    assert found == {(i, j): len(s & t) for i, s in one.items() for j, t in two.items() if 100 * len(s & t) >= 55 * min(len(s), len(t))} and found
    # each step used to read the texts again
    assert read.value == len(one) + len(two)


def test_bigrams(spark):
    row = spark.range(1).select(grounding.bigrams(F.lit("A-b 民，調")).alias("x"), grounding.bigrams(F.lit("a")).alias("y"), grounding.bigrams(F.lit(None).cast("string")).alias("z")).first()
    assert (row["x"], row["y"], row["z"]) == (["Ab", "b民", "民調"], [], [])


def test_issues_of_claims(spark):
    claims = spark.createDataFrame([("good", "f", "up 1,200 on 2024-05-01"), ("bad", "f", "up 7% on 2024-06-02"), ("bare", "f", None), ("plain", "d", "in 2030-01-01")], "claim string, kind string, text string")
    refs = spark.createDataFrame(
        [("good", "event", "e1"), ("good", "event", "e1"), ("good", "source", "s1"), ("bad", "event", "e1"), ("bad", "poll", "p9"), ("bad", "source", "s2"), ("bad", "gap", None), ("bare", "poll", "p1"), ("plain", "source", "s9")], "claim string, kind string, ref string")
    evidence = spark.createDataFrame([("event", "e1", "rose 1200 of 2024 05-01", ["2024-05-01T08:00"]), ("poll", "p1", "", []), ("source", "s1", "", None), ("source", "s2", None, None)], "kind string, id string, text string, dates array<string>")
    links = spark.createDataFrame([("event", "e1", "s1"), ("poll", "p1", "s2")], "kind string, id string, source string")
    found = {tuple(x) for x in grounding.issues(claims, refs, evidence, links, days=("2030-01-01",)).collect()}
    assert found == {
        ("bad", "unknown_poll", "p9"), ("bad", "item_without_source", "event:e1"), ("bad", "item_without_source", "poll:p9"), ("bad", "source_without_item", "s2"), ("bad", "number_not_in_evidence", "7%"), ("bad", "number_not_in_evidence", "06"),
        ("bad", "date_not_in_evidence", "2024-06-02"), ("bare", "missing_source", ""), ("plain", "unknown_source", "s9"), ("plain", "number_not_in_evidence", "2030"), ("plain", "number_not_in_evidence", "01")}
    said = spark.createDataFrame([("a1", "e1", "allegation", "甲", "乙收受賄款三百萬"), ("a2", "e1", "actor_statement", "丙", "市政建設要加快"), ("a3", "e2", "allegation", "甲", "乙收受賄款三百萬")], "id string, event string, kind string, speaker string, text string")
    told = spark.createDataFrame([("x", "f", "乙收受賄款三百萬元"), ("y", "f", "甲指控乙收受賄款三百萬"), ("z", "f", "市政建設要加快，丙"), ("w", "f", None)], "claim string, kind string, text string")
    cites = spark.createDataFrame([(c, "event", "e1") for c in "xyzw"], "claim string, kind string, ref string")
    assert {tuple(x) for x in grounding.unattributed(told, cites, said).collect()} == {("x", "allegation_as_fact", "a1"), ("z", "statement_as_fact", "a2")}


def test_fuzzy_pairs_equal_the_nested_loop(spark):
    r = random.Random(2)
    base = ["".join(r.choice("abcde xyz") for _ in range(r.randint(1, 14))) for _ in range(40)]

    def noisy(s):
        s = list(s)
        for _ in range(r.randint(0, 2)):
            if s:
                s[r.randrange(len(s))] = r.choice(["", "q", "ab"])
        return "".join(s)

    one, two = [noisy(s) for s in base] + ["", None, base[0]], base + [base[0]]
    found = {(x["a"], x["b"]): round(x["ratio"], 9) for x in resolution.fuzzy_pairs(spark.createDataFrame([(x,) for x in one], "name string"), spark.createDataFrame([(x,) for x in two], "name string")).collect()}
    ratio = lambda a, b: difflib.SequenceMatcher(None, a, b).ratio()
    assert found == {(a, b): round(ratio(a, b), 9) for a in set(one) if a for b in set(two) if b and ratio(a, b) >= 0.85} and len(found) > 20


def test_sources_are_resolved_in_order(spark):
    known = spark.createDataFrame([(3, "Daily News", "news.org"), (1, "Evening Post", "post.org"), (2, "Daily News", None), (4, "Star Media", "")], "id long, name string, domain string")
    rows = [(1, "Evening Post", "news.org"), (2, " Daily　News ", None), (3, "DN", ""), (4, "Star Media Inc", "x.org"), (5, "Evening Pots", None), (6, "Nobody", None), (7, None, None), (8, "", "post.org"), (9, "Ｄaily News", "")]
    found = {x["id"]: (x["source"], x["status"], x["basis"]) for x in resolution.resolve_sources(spark.createDataFrame(rows, "id long, name string, domain string"), known, {"DN": "Daily News"}, (" Inc",)).collect()}
    assert found == {
        1: (3, "exact", "domain_exact"), 2: (2, "exact", "name_exact"), 3: (2, "normalized_match", "alias_match"), 4: (4, "normalized_match", "normalized_name_match"), 5: (1, "possible_match", "fuzzy_name_match"),
        6: (None, "new_candidate_source", "none"), 7: (None, "unresolved", "no_name_no_domain"), 8: (1, "exact", "domain_exact"), 9: (2, "exact", "name_exact")}


def test_names_in_texts_equal_a_quadratic_scan(spark):
    r = random.Random(8)
    texts = [(i, "".join(r.choice("ab ") for _ in range(r.randint(0, 60)))) for i in range(40)] + [(50, None), (51, "ab" * 30_000)]
    names = ["a", "ab", "aba", "bb", "a b", "zz", "", "ab"]
    want = {(i, n): len(re.findall(f"(?={re.escape(n)})", t or "")) for i, t in texts for n in set(names) if n}
    df, table = spark.createDataFrame(texts, "id long, text string"), spark.createDataFrame([(n,) for n in names], "name string")
    for few in (100, 2):  # by automaton, by join
        assert {(x["id"], x["name"]): x["n"] for x in resolution.names_in_texts(df, table, few).collect()} == {k: n for k, n in want.items() if n}
    assert resolution.names_in_texts(df, table.limit(0)).count() == 0


def test_persons_and_organisations(spark):
    text = F.lit("王小明與李大同出席，王陳明、林先生；台南發展協會宣布，青年會說")
    row = spark.range(1).select(resolution.persons(text, "王李林陳", "與", ("先生",)).alias("p"), resolution.organisations(text, ("協會", "會"), ("宣布", "說"), ("同",)).alias("o"), resolution.persons(F.lit("王"), "王").alias("q")).first()
    assert row["p"] == ["王小明", "李大同"] and row["o"] == ["台南發展協會", "青年會"] and row["q"] == []


def test_pairs_of_a_claim_meet_the_links_of_a_much_linked_item(spark, monkeypatch):
    claims = spark.createDataFrame([("c", "")], "claim string, text string")
    refs = spark.createDataFrame([("c", "event", "e"), ("c", "source", "s7"), ("c", "source", "none")], "claim string, kind string, ref string")
    evidence = spark.createDataFrame([("event", "e", "", []), ("source", "s7", "", []), ("source", "none", "", [])], "kind string, id string, text string, dates array<string>")
    links = spark.range(3000).selectExpr("'event' as kind", "'e' as id", "'s' || id as source")
    plans, plain = [], grounding.cut
    monkeypatch.setattr(grounding, "cut", lambda df: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or plain(df))
    found = grounding.issues(claims, refs, evidence, links)
    assert [tuple(r) for r in found.collect()] == [("c", "source_without_item", "none")]
    # the links are only looked up, by all three columns: an inner join would bring 3,000 of them to the claim
    assert sum("Join LeftSemi" in p for p in plans) == 1
