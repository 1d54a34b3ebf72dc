"""Clauses, quotes and assertions on hand-worked rows."""

from newsloom.operators import assertions as A

COLUMNS = "id long, title string, summary string, subject string, known array<string>"


def kinds(spark, *rows):
    data = [(i, *r) for i, r in enumerate(rows)]
    found = A.assertions(spark.createDataFrame(data, COLUMNS)).orderBy("id", "pos").collect()
    return [[r for r in found if r["id"] == i] for i in range(len(rows))]


def test_clauses_keep_quotes_whole():
    assert A.split_clauses("甲說「好，走。」然後離開；再見") == ["甲說「好，走。」然後離開", "再見"]
    assert A.split_clauses("a」，b「c『d，e』，f」，g") == ["a」", "b「c『d，e』，f」", "g"]  # a quote that closes nothing, and one within another
    assert A.split_clauses("「open，never。closed") == ["「open，never。closed"]
    assert A.split_clauses(" ，， x ,y\n") == ["x ,y"]
    assert A.split_clauses(None) == A.split_clauses("") == A.split_clauses("。\n") == []
    long = "字" * 50_000 + "，" + "「" + "，" * 50_000 + "」"
    assert [len(c) for c in A.split_clauses(long)] == [50_000, 50_002]


def test_quotes_and_their_speakers(spark):
    row = spark.createDataFrame([("王明：「好」然後李四“不”，「無名」", None), ("", None)], "t string, n string")
    found = row.select(A.quotes(row["t"]).alias("q"), A.quotes(row["n"]).alias("none")).collect()
    assert [(q["speaker"], q["quote"]) for q in found[0]["q"]] == [("王明", "「好」"), ("然後李四", "“不”")]
    assert found[1]["q"] == [] and not found[0]["none"]


def test_each_kind(spark):
    known = ["甲君", "市府"]
    rows = kinds(
        spark, ("某黨正式提名乙", "", "", []), ("甲君表示支持建設", "", "甲君", known), ("丙質疑對手", None, None, None), ("丁觀點 選情冷清", "", "", []), ("戊擬於月底參選", "", "", []), ("傳己不再選", "", "", []),
        ("丁觀點：選情冷清", "", "", []), ("無事", "", "", []), (None, None, None, None), ("庚表示反對", "", "", known), ("辛駁斥批評", "", "", ["辛"]), ("壬：否認爆料", "", "", []), ("可能召開會議", "", "", []),
    )
    first = [r[0] for r in rows]
    assert [r["kind"] for r in first] == [
        "observed_fact", "actor_statement", "allegation", "media_interpretation", "planned_action", "uncertain_report", "actor_statement", "unknown", "unknown", "unknown", "actor_statement", "actor_statement", "observed_fact"]
    assert (first[1]["speaker"], first[1]["predicate"], first[1]["object"], first[1]["text"]) == ("甲君", "表示", "支持建設", "甲君表示支持建設")
    assert first[2]["risks"] == ["unverified"] and first[2]["reasons"] == ["allegation_verb:質疑"]
    assert first[6]["speaker"] == "丁觀點"  # anyone may speak before a colon
    assert (first[10]["speaker"], first[10]["predicate"]) == ("辛", "駁斥") and (first[11]["speaker"], first[11]["predicate"]) == ("壬", "駁斥/否認")
    assert first[12]["risks"] == ["hedged"] and first[7]["risks"] == ["unknown_kind"] and first[8]["text"] == ""


def test_speakers_are_carried_on(spark):
    known = ["甲君", "市府"]
    rows = kinds(
        spark, ("甲君表示支持", "並稱會再來", "", known), ("並稱會再來", "甲君出席", "", known), ("市府公布結果", "並稱順利", "", known), ("並稱市府將辦", "並表示再議", "", known), ("甲君表示支持，甲君表示支持", "", "", known),
    )
    assert [(r["kind"], r["speaker"]) for r in rows[0]] == [("actor_statement", "甲君"), ("actor_statement", "甲君")] and rows[0][1]["reasons"] == ["connector_speaker_carry:稱"]
    assert [(r["kind"], r["speaker"]) for r in rows[1]] == [("observed_fact", "")]  # nobody spoke before: the connector's clause says nothing
    assert [(r["kind"], r["speaker"]) for r in rows[2]] == [("observed_fact", ""), ("actor_statement", "市府")]  # one who acts may speak next
    assert [(r["kind"], r["speaker"]) for r in rows[3]] == [("planned_action", ""), ("actor_statement", "市府")]
    assert len(rows[4]) == 1 and rows[4][0]["field"] == "title"


def test_profile_and_empty_table(spark):
    data = spark.createDataFrame([(1, "甲質疑乙", "可能召開", "", []), (2, "無事", "", "", [])], COLUMNS)
    found = {r["id"]: r for r in A.profile(A.assertions(data)).collect()}
    assert (found[1]["allegation"], found[1]["observed_fact"], found[1]["unknown"], found[1]["risks"]) == (1, 1, 0, "hedged|unverified") and found[2]["unknown"] == 1
    assert A.profile(A.assertions(data.limit(0))).count() == 0


def test_articles_are_read_and_cut_once(spark):
    """Silent articles come from the same pass: texts are cut once and rows are dealt by id once."""
    rows = spark.range(3).selectExpr("id", "'a表示b。c' title", "'' summary", "'' subject", "array('a') known")
    plan = A.assertions(rows)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan
