"""Core queries, part four: routing by label, additive search, capped levels, newsletter links, message parts, pairs in time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.functions import text as T
from newsloom.functions import urls
from newsloom.operators import match, ranking, rules
from newsloom.storage import table

QUERIES, ORACLE = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


_CANDIDATES = """with a as (select o_custkey, count(*) as n, count(*) filter (where o_orderstatus = 'F') as facts, count(*) filter (where o_orderpriority = '1-URGENT') as said, max(o_totalprice) as m from orders group by 1),
c as (select c_custkey, case c_custkey % 7 when 0 then 'irrelevant' when 1 then 'contextual' when 2 then 'direct_event' when 3 then 'direct_statement' when 4 then 'collection_error' end as label,
  coalesce(facts, 0) > 3 as fact, coalesce(said, 0) > 2 as said, c_acctbal > 9000 as dup, case when c_nationkey = 3 then 'unknown' else 'title' end as basis, coalesce(n, 0) as sources,
  case when c_acctbal < 0 then 'low' else 'medium' end as risk, coalesce(m, 0) / 1000000 as cluster, coalesce(n, 0) / 30 as source, least(coalesce(n, 0) / 20, 1) as complete from customer left join a on o_custkey = c_custkey),
e as (select *, list_filter([case when not fact then 'direct_event_without_observed_fact' end, case when basis = 'unknown' then 'date_unknown' end, case when sources = 0 then 'no_valid_source' end], lambda x: x is not null) as ev,
  list_filter([case when not said then 'direct_statement_without_actor_statement' end, case when risk = 'low' then 'direct_statement_risk_too_low' end, case when basis = 'unknown' then 'date_unknown' end, case when sources = 0 then 'no_valid_source' end], lambda x: x is not null) as st,
  list_filter([case when not fact and not said then 'no_observed_fact_no_statement' end, case when basis = 'unknown' then 'date_unknown' end, case when cluster < 0.35 then 'low_cluster_confidence' end, case when source < 0.30 then 'low_source_confidence' end,
    case when complete < 0.40 then 'low_completeness' end], lambda x: x is not null) as pl from c)
select c_custkey, case when label in ('irrelevant', 'collection_error') then 'auto_reject' when label = 'contextual' then case when not fact and not said then 'hold' else 'context_only' end when dup then 'duplicate_candidate'
  when label = 'direct_event' then case when len(ev) > 0 then 'hold' else 'review_required' end when label = 'direct_statement' then case when len(st) > 0 then 'hold' else 'review_required' end
  else case when len(pl) > 0 then 'hold' else 'review_required' end end as route,
 case when label in ('irrelevant', 'collection_error') then 'relevance_label_' || label when label = 'contextual' then case when not fact and not said then 'contextual_without_actionable_assertion' else 'contextual_no_direct_event_or_statement' end
  when dup then 'formal_duplicate_or_existing_candidate' when label = 'direct_event' then case when len(ev) > 0 then array_to_string(ev, '|') else 'direct_event_eligible' end
  when label = 'direct_statement' then case when len(st) > 0 then array_to_string(st, '|') else 'direct_statement_eligible' end else case when len(pl) > 0 then array_to_string(pl, '|') else 'eligible_for_review' end end as reasons from e"""


@query(_CANDIDATES)
def candidate_router(spark: SparkSession, d: str) -> DataFrame:
    """Routes by relevance label, duplicate, and what each kind of candidate lacks, with the reasons."""
    o = table(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"), F.count_if(F.col("o_orderstatus") == "F").alias("facts"), F.count_if(F.col("o_orderpriority") == "1-URGENT").alias("said"), F.max("o_totalprice").alias("m"))
    j = table(spark, d, "customer").join(o, F.col("c_custkey") == F.col("o_custkey"), "left").fillna(0, ["n", "facts", "said", "m"])
    labels = {0: "irrelevant", 1: "contextual", 2: "direct_event", 3: "direct_statement", 4: "collection_error"}
    label = F.lit(None).cast("string")
    for k, name in labels.items():
        label = F.when(F.col("c_custkey") % 7 == k, name).otherwise(label)
    scores = {"cluster_confidence": F.col("m") / 1000000, "source_confidence": F.col("n") / 30, "completeness": F.least(F.col("n") / 20, F.lit(1.0))}
    verdict = rules.route_candidate(
        label, F.col("facts") > 3, F.col("said") > 2, F.col("c_acctbal") > 9000, F.when(F.col("c_nationkey") == 3, "unknown").otherwise("title"), F.col("n"),
        F.when(F.col("c_acctbal") < 0, "low").otherwise("medium"), scores)
    return j.select("c_custkey", verdict.alias("v")).select("c_custkey", "v.route", F.array_join("v.reasons", "|").alias("reasons"))


_EVENTS = """with e as (select p_partkey, p_name as title, [p_brand, split_part(p_type, ' ', 1)] as actors, p_brand || ' ' || split_part(p_type, ' ', 1) as named, p_type as summary, split_part(p_type, ' ', 3) as kind, p_brand as notes from part),
h as (select *, [contains(title, w) for w in ws] as ti, [contains(named, w) for w in ws] as na, [contains(summary, w) for w in ws] as su, [contains(notes, w) for w in ws] as no from e, (select ['ECONOMY', 'STEEL', 'Brand#1'] as ws)),
m as (select *, list_transform([1, 2, 3], lambda i: ti[i] or na[i] or su[i] or no[i]) as hit from h),
n as (select *, len(list_filter(hit, lambda x: x)) as matched, list_contains(na, true) as person, list_contains(na, true) or list_contains(ti, true) as there from m),
o as (select *, case when matched >= 3 then 'strict' when matched >= 2 and (person or not there) then 'relaxed' else 'irrelevant' end as mode,
  coalesce(list_filter([1, 2, 3], lambda i: na[i])[1], 0) as w from n)
select p_partkey, matched::bigint as matched, mode, (case when mode = 'irrelevant' then 0 else (case when contains(title, 'ECONOMY STEEL Brand#1') then 100 when ti[1] and ti[2] and ti[3] then 80 else 0 end)
  + case when w > 0 then 35 + case when len(list_filter(actors, lambda a: starts_with(title, a) and contains(a, ws[w]))) > 0 then 35 else 20 end else 0 end
  + case when kind = 'STEEL' then 25 else 0 end + 15 * len(list_filter(su, lambda x: x)) + 12 * len(list_filter(na, lambda x: x)) + 3 * len(list_filter(no, lambda x: x)) end)::bigint as relevance from o"""


@query(_EVENTS)
def event_search(spark: SparkSession, d: str) -> DataFrame:
    """Additive relevance of every part for one query: title, actors, type and field points, strict and relaxed matches."""
    words = F.split("p_type", " ")
    events = table(spark, d, "part").select("p_partkey", F.col("p_name").alias("title"), F.array("p_brand", words[0]).alias("actors"), F.col("p_type").alias("summary"), F.try_element_at(words, F.lit(3)).alias("kind"), F.col("p_brand").alias("notes"))
    found = rules.event_search(events, "ECONOMY STEEL Brand#1", "title", "actors", ("kind", {"STEEL": ["STEEL"], "COPPER": ["COPPER"]}), {"summary": "summary", "notes": "notes"})
    return found.select("p_partkey", "matched", "mode", "relevance")


_LEVELS = """with o as (select *, date_trunc('month', o_orderdate) as m, case when o_totalprice >= 300000 then 'critical' when o_totalprice >= 150000 then 'important' else 'normal' end as lvl, o_orderpriority = '1-URGENT' as re, o_orderpriority in ('1-URGENT', '2-HIGH') as sh from orders),
one as (select *, re and row_number() over (partition by m, re order by lvl, o_totalprice desc, o_orderdate desc, o_orderkey) <= 1 as first from o where lvl <> 'normal'),
two as (select *, greatest(3 - sum((first and sh)::int) over (partition by m), 0) as lft from one),
three as (select *, (sh and not first) and row_number() over (partition by m, (sh and not first) order by lvl, o_totalprice desc, o_orderdate desc, o_orderkey) <= lft as second from two),
four as (select *, first or second as taken, 5 - sum((first or second)::int) over (partition by m) as room from three),
five as (select *, taken or row_number() over (partition by m, taken order by lvl, o_totalprice desc, o_orderdate desc, o_orderkey) <= room as picked from four)
select o_orderkey, case when picked then lvl else 'normal' end as level, not picked as capped from five union all select o_orderkey, lvl, false from o where lvl = 'normal'"""


@query(_LEVELS)
def highlight_levels(spark: SparkSession, d: str) -> DataFrame:
    """Levels after the monthly cap: only critical and important rows compete, those that lose become normal."""
    level = F.when(F.col("o_totalprice") >= 300000, "critical").when(F.col("o_totalprice") >= 150000, "important").otherwise("normal")
    o = table(spark, d, "orders").withColumns({"month": F.date_trunc("month", F.col("o_orderdate").cast("timestamp")), "level": level})
    order = [F.col("level").asc(), F.col("o_totalprice").desc(), F.col("o_orderdate").desc(), F.col("o_orderkey").asc()]
    capped = ranking.capped_levels(o, ["month"], "level", order, F.col("o_orderpriority") == "1-URGENT", F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"))
    return capped.select("o_orderkey", "level", "capped")


@query()
def newsletter_links(spark: SparkSession, d: str) -> DataFrame:
    """Canonical newsletter links of all pages, '' for unsafe ones; rules of URL parsing that SQL hasn't, held against a brute-force version in the tests."""
    return table(spark, d, "pages").select("page_id", urls.newsletter_url(F.col("url")).alias("link"), urls.newsletter_url(F.regexp_replace("url", "^http:", "https:")).alias("as_https"))


@query()
def message_splits(spark: SparkSession, d: str) -> DataFrame:
    """Parts of every conversation turn's text, broken at line ends, with number and length; a fold, held against a brute-force version in the tests."""
    parts = T.message_parts(F.coalesce("text", F.lit("")), 200)
    return table(spark, d, "conversations").select("conv_id", "turn", F.posexplode(parts).alias("part", "body")).select("conv_id", "turn", "part", F.length("body").alias("n_chars"), T.short_hash(F.col("body")).alias("body_hash"))


@query("""with k as (select distinct l_orderkey, l_suppkey from lineitem), c as (select l_orderkey, count(*) as n from k group by 1),
r as (select k.l_orderkey as id, l_suppkey as token, n, o_orderdate as ts from k join c using (l_orderkey) join orders on o_orderkey = k.l_orderkey)
select x.id as a, y.id as b from r x join r y on x.token = y.token and x.id < y.id and y.ts between x.ts - interval 48 hours and x.ts + interval 48 hours group by x.id, y.id, x.n, y.n having count(*) >= 2 and 100 * count(*) >= 30 * (x.n + y.n - count(*))""")
def article_pairs_in_time(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of orders at most 48 hours apart whose suppliers are similar sets, two in common at least."""
    items = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_set("l_suppkey").alias("tokens"))
    rows = table(spark, d, "orders").join(items, F.col("o_orderkey") == F.col("l_orderkey")).select("o_orderkey", "o_orderdate", "tokens")
    return match.similar_within(rows, "o_orderkey", "o_orderdate", "tokens", 48, 30, 2)
