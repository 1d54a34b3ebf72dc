"""Clauses, quotes and assertions of articles, with the speaker carried on from clause to clause."""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.types import ArrayType, StringType

#: What ends a clause, what opens and closes a quote.
DELIMITERS, OPEN, CLOSE = "。；！？，、\n", "「“『", "」”』"
#: A character of a speaker's name, and the verbs that may end it.
NAME = "[\\x{4e00}-\\x{9fff}A-Za-z0-9]"
SUFFIXES = ("直呼", "表示", "稱", "說", "強調", "主張", "認為", "要求", "呼籲", "批評", "指控", "質疑")
COLON = "[：:]"
#: Confidence of each kind of assertion.
CONFIDENCE = {"observed_fact": 0.8, "actor_statement": 0.7, "planned_action": 0.6, "allegation": 0.5, "media_interpretation": 0.4, "uncertain_report": 0.3, "unknown": 0.2}


@dataclass(frozen=True)
class Markers:
    """The words that make a clause one kind of assertion, in order of precedence within each list."""

    uncertain: tuple = ("傳出", "傳", "據悉", "據了解", "消息人士", "知情人士", "外傳", "盛傳", "疑似")
    allegation: tuple = ("指控", "批評", "質疑", "爆料", "驚爆", "抨擊", "痛批", "砲轟")
    denial: tuple = ("指控不實", "駁斥", "否認", "澄清")
    denying: tuple = ("駁斥", "否認", "澄清")
    statement: tuple = ("稱", "表示", "說", "盼", "讚", "強調", "主張", "呼籲", "要求", "認為", "研判", "透露", "建議", "表態", "駁斥")
    media: tuple = ("分析認為", "研判", "觀點", "初探", "評論", "學者分析", "觀察家", "專家評估", "媒體分析")
    planned: tuple = ("預計", "將於", "計劃", "計畫", "擬", "規劃", "預告", "未來", "號召", "將", "明天", "下周", "下週", "月底", "近日")
    observed: tuple = (
        "正式提名", "完成登記", "宣布", "拜票", "公布", "發布", "公告", "召開", "出席", "視察", "成立", "啟動", "開跑", "結果出爐", "當選", "敗選", "辭職", "接任", "宣布參選", "領表", "造勢", "掃街",
        "舉辦", "同框", "看板", "登記參選", "民調", "協調", "競選總部", "後援會", "前往", "參拜",
    )
    hedges: tuple = ("可能", "疑似", "恐怕")
    connectors: tuple = ("並表示", "並稱", "同时指出", "同時指出", "但強調", "但强调", "隨後宣布", "随后宣布", "接著", "接着")
    suffixes: tuple = SUFFIXES
    #: Predicates of kinds that don't take the marker itself.
    uncertain_as: str = "傳出/據悉"
    denied_as: str = "駁斥/否認"
    denied_plain: str = "否認"
    quoted_as: str = "表示"
    media_as: str = "媒體分析"
    planned_as: str = "計劃/將"
    comma: str = "，"


def split_clauses(text: str | None, delimiters: str = DELIMITERS, opening: str = OPEN, closing: str = CLOSE) -> list[str]:
    """Clauses of a text without the blanks around them; delimiters inside quotes don't cut, and an unopened closing quote doesn't count."""
    out, depth, start = [], 0, 0
    text = text or ""
    for m in re.finditer(f"[{re.escape(delimiters + opening + closing)}]", text):
        mark = m.group()
        if mark in opening:
            depth += 1
        elif mark in closing:
            depth = max(depth - 1, 0)
        if depth == 0 and mark in delimiters:
            out.append(text[start : m.start()].strip())
            start = m.end()
    return [c for c in (*out, text[start:].strip()) if c]


def clauses(text: Column, delimiters: str = DELIMITERS, opening: str = OPEN, closing: str = CLOSE) -> Column:
    """The clauses of a text column as an array: one pass over the marks of each text."""

    @F.pandas_udf(ArrayType(StringType()))
    def split(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: split_clauses(t, delimiters, opening, closing))

    return split(F.coalesce(text, F.lit("")))


def quotes(text: Column) -> Column:
    """Quotes with the name before them, as an array of ``speaker, quote``."""
    pattern = F.lit(f"({NAME}{{1,12}}?){COLON}?([{OPEN}].+?[{CLOSE}])")
    return F.arrays_zip(F.regexp_extract_all(text, pattern, F.lit(1)).alias("speaker"), F.regexp_extract_all(text, pattern, F.lit(2)).alias("quote"))


def _any(text: Column, words: tuple) -> Column:
    return reduce(Column.__or__, [F.contains(text, F.lit(w)) for w in words], F.lit(False))


def _first(text: Column, words: tuple) -> Column:
    """The first word of the table that the text contains; null if none."""
    return F.coalesce(*[F.when(F.contains(text, F.lit(w)), F.lit(w)) for w in words], F.lit(None).cast("string"))


def _starts(text: Column, words: tuple) -> Column:
    return reduce(Column.__or__, [F.startswith(text, F.lit(w)) for w in words], F.lit(False))


def _before(text: Column, words: tuple) -> Column:
    """The name, 12 characters at most, that ends right before the first word of the table that has one before it."""
    name = lambda w: F.regexp_extract(F.substring(text, F.lit(1), F.instr(text, F.lit(w)) - 1), f"({NAME}{{1,12}})$", 1)
    return F.coalesce(*[F.when(F.contains(text, F.lit(w)), F.nullif(name(w), F.lit(""))) for w in words], F.lit(""))


def assertions(articles: DataFrame, markers: Markers = Markers(), delimiters: str = DELIMITERS, opening: str = OPEN, closing: str = CLOSE) -> DataFrame:
    """``id, pos, kind, predicate, speaker, text, object, field, clause, confidence, risks, reasons`` for each assertion of each article.

    ``articles``: ``id, title, summary, subject, known``, the last an array of
    names in the order in which they are tried. A clause of title and summary is
    an uncertain report, a denial or allegation, a quote after a colon, a
    statement by a verb, an interpretation, a plan or an observed fact, by the
    first table that fits; other clauses say nothing. A statement needs a
    speaker: one of the known names, or anyone before a colon; one that opens
    with a connector takes the speaker of the clauses before. (kind, text) counts
    once for each article, the first time. An article that asserts nothing gives
    its title as ``unknown``; null texts are empty.
    """
    m = markers
    base = articles.select("id", F.coalesce("title", F.lit("")).alias("title"), F.coalesce("summary", F.lit("")).alias("summary"), F.coalesce("subject", F.lit("")).alias("subject"), F.coalesce("known", F.array().cast("array<string>")).alias("known"))
    parts = base.select("*", clauses(F.col("title"), delimiters, opening, closing).alias("head"), clauses(F.col("summary"), delimiters, opening, closing).alias("body"))
    c = F.col("clause")
    # the first row of each article has no clause and stands for the article
    own_row = F.array(F.lit(None).cast("string"))
    every = parts.select("id", "subject", "known", F.posexplode(F.concat(own_row, "head", "body")).alias("pos", "clause"), "title").withColumn("pos", F.col("pos") - 1)
    tail = "(" + "|".join(m.suffixes) + ")$"
    colon = F.regexp_extract(c, f"({NAME}{{1,12}}?){COLON}", 1)
    verb, ordered = _first(c, m.statement), tuple(sorted(m.statement, key=len, reverse=True))
    named = _before(c, ordered)
    facts = every.withColumns({
        "uncertain": _any(c, m.uncertain), "charge": _first(c, m.allegation), "denies": _any(c, m.denial), "colon": colon, "has_colon": c.contains("：") | c.contains(":"), "verb": verb,
        "own": F.when(F.array_contains("known", named), named).otherwise(""), "denier": _before(c, m.denying), "linked": _starts(c, m.connectors),
        "media": _any(c, m.media), "planned": _any(c, m.planned), "seen": _first(c, m.observed),
        "mentioned": F.try_element_at(F.filter("known", lambda k: (k != "") & F.contains(c, k)), F.lit(1)),
    })
    charged, quoted = F.col("charge").isNotNull(), F.col("colon") != ""
    bare = F.regexp_replace("colon", tail, "")
    early = (
        F.when(F.col("uncertain"), F.lit("uncertain_report")).when(charged & F.col("denies"), "actor_statement").when(charged, "allegation").when(quoted, "actor_statement")
        .when(F.col("verb").isNotNull() & (F.col("own") != ""), "actor_statement")
    )
    late = F.when(F.col("media"), F.lit("media_interpretation")).when(F.col("planned"), "planned_action").when(F.col("seen").isNotNull(), "observed_fact")
    speaker = (
        F.when(F.col("uncertain"), F.lit("")).when(charged & F.col("denies"), F.when(quoted, bare).otherwise(F.col("denier"))).when(charged, "").when(quoted, bare).when(F.col("verb").isNotNull(), F.col("own")).otherwise("")
    )
    may_carry = F.col("early").isNull() & F.col("verb").isNotNull() & F.col("linked")
    told = facts.withColumns({"early": early, "late": late, "own_speaker": speaker}).withColumn("may_carry", may_carry)
    # other clauses neither say anything nor name a speaker; what needs the title and the known names is settled before the shuffle
    told = told.withColumns({
        "field": F.when(F.instr("title", c) > 0, "title").otherwise("summary"), "title": F.when(c.isNull(), F.col("title")), "known": F.when(F.col("linked") | F.col("has_colon"), F.array().cast("array<string>")).otherwise(F.col("known"))})
    # a generator, as a filter would be pushed below the tables and evaluate them anew
    told = told.select(F.inline(F.when(F.expr("clause is null or early is not null or late is not null or may_carry"), F.array(F.struct(*told.columns)))))
    sets = F.when(F.col("early").isNotNull(), F.nullif("own_speaker", F.lit(""))).when(F.col("late").isNotNull(), F.col("mentioned"))
    earlier = W.partitionBy("id").orderBy("pos").rowsBetween(W.unboundedPreceding, -1)
    # a clause that could carry a speaker names one only if there is none to carry
    prior = F.coalesce(F.last(F.when(~F.col("may_carry"), sets), ignorenulls=True).over(earlier), F.first(F.when(F.col("may_carry"), sets), ignorenulls=True).over(earlier))
    carried = told.withColumn("prior", prior).withColumn("carries", F.col("may_carry") & F.col("prior").isNotNull())
    kind = F.when(F.col("carries"), "actor_statement").otherwise(F.coalesce("early", "late"))
    said = carried.withColumns({"kind": kind, "speaker": F.when(F.col("carries"), F.col("prior")).when(F.col("early").isNotNull(), F.col("own_speaker")).otherwise("")})
    by_verb = (F.col("kind") == "actor_statement") & ~charged & ~quoted
    rest = F.substring(F.split_part(F.substring(c, F.instr(c, F.col("verb")) + F.length("verb"), F.length(c)), F.lit(m.comma), F.lit(1)), 1, 80)
    predicate = (
        F.when(F.col("uncertain"), F.lit(m.uncertain_as)).when(charged & F.col("denies"), F.when(quoted, F.lit(m.denied_as)).when(F.col("denier") != "", _denied(c, m.denying)).otherwise(F.lit(m.denied_plain)))
        .when(charged, F.col("charge")).when(quoted, F.lit(m.quoted_as)).when(by_verb, F.col("verb")).when(F.col("media"), F.lit(m.media_as)).when(F.col("planned"), F.lit(m.planned_as)).otherwise(F.col("seen"))
    )
    source = F.when(by_verb, F.when(rest != "", rest).otherwise(F.substring(c, 1, 80))).otherwise(c)
    reason = (
        F.when(F.col("uncertain"), F.lit("uncertain_marker")).when(charged & F.col("denies"), F.when(quoted, "denial_with_colon_speaker").otherwise("denial_statement")).when(charged, F.concat(F.lit("allegation_verb:"), "charge"))
        .when(quoted, "colon_quotation").when(F.col("carries"), F.concat(F.lit("connector_speaker_carry:"), "verb")).when(by_verb, F.concat(F.lit("statement_verb:"), "verb", F.lit("(known_actor)")))
        .when(F.col("media"), "media_marker").when(F.col("planned"), "planned_or_future_marker").otherwise(F.concat(F.lit("observed_marker:"), "seen"))
    )
    risk = F.when(F.col("kind").isin("uncertain_report", "allegation"), "unverified").when(F.col("kind") == "media_interpretation", "interpretation").when(F.col("kind") == "planned_action", "future")
    anonymous = (F.col("kind") == "actor_statement") & ((F.col("speaker") == "") | (~F.array_contains("known", F.col("speaker")) & ~F.col("linked") & ~F.col("has_colon")))
    worded = said.where(c.isNull() | (F.col("kind").isNotNull() & ~anonymous)).select(
        "id", "pos", "kind", predicate.alias("predicate"), "speaker", "subject", source.alias("source"), "clause", "field", "title",
        F.array_compact(F.array(risk, F.when(_any(c, m.hedges), "hedged"))).alias("risks"), F.array(reason).alias("reasons"),
    )
    full = F.when((F.col("subject") != "") | (F.col("predicate") != ""), F.concat("subject", "predicate", F.substring("source", 1, 80))).otherwise(F.substring("source", 1, 150))
    shown = worded.select("id", "pos", "kind", "predicate", "speaker", F.substring(full, 1, 200).alias("text"), F.substring("source", 1, 80).alias("object"), "field", F.substring("clause", 1, 200).alias("clause"), "risks", "reasons", "title")
    once = shown.withColumn("__n", F.row_number().over(W.partitionBy("id", "kind", "text").orderBy("pos"))).where("__n = 1 or kind is null")
    counted = once.withColumn("__said", F.count("kind").over(W.partitionBy("id"))).where("kind is not null or __said = 0 or id is null")
    silent = lambda value, name: F.when(F.col("kind").isNull(), value).otherwise(F.col(name)).alias(name)
    none = F.array().cast("array<string>")
    title = lambda n: F.substring("title", 1, n)
    found = counted.select(
        "id", "pos", F.coalesce("kind", F.lit("unknown")).alias("kind"), silent(F.lit(""), "predicate"), silent(F.lit(""), "speaker"), silent(title(150), "text"), silent(title(80), "object"),
        silent(F.lit("title"), "field"), silent(title(200), "clause"), silent(F.array(F.lit("unknown_kind")), "risks"), silent(none, "reasons"))
    sure = F.lit(None).cast("double")
    for name, value in CONFIDENCE.items():
        sure = F.when(F.col("kind") == name, value).otherwise(sure)
    return found.withColumn("confidence", sure)


def _denied(text: Column, words: tuple) -> Column:
    """The verb whose name before it counts."""
    pairs = F.transform(F.array(*[F.lit(w) for w in words]), lambda w: F.when(F.regexp_extract(F.substring(text, F.lit(1), F.greatest(F.instr(text, w) - 1, F.lit(0))), f"{NAME}$", 0) != "", w))
    return F.try_element_at(F.filter(pairs, lambda w: w.isNotNull()), F.lit(1))


def profile(rows: DataFrame) -> DataFrame:
    """``id``, a count for each kind, and the distinct risks in alphabetical order, joined by ``|``."""
    counts = [F.count_if(F.col("kind") == k).alias(k) for k in sorted(CONFIDENCE)]
    return rows.groupBy("id").agg(*counts, F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_set("risks")))), "|").alias("risks"))
