"""Core queries, part seven: event dates, relations and ids of clusters, polls and coverage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from newsloom.functions import times
from newsloom.operators import clustering, coverage, polls
from newsloom.plans.core_e import _ARTICLES, articles
from newsloom.storage import table

QUERIES, ORACLE = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


_DATED = """o as (select o_orderkey as id, case when o_orderkey % 9 <> 8 then o_orderdate end as pub, year(o_orderdate) % 100 + 2000 - case when year(o_orderdate) >= 2000 then 0 else 90 end as y, month(o_orderdate) as m, day(o_orderdate) as d from orders),
t as (select id, pub, case id % 8 when 0 then y || '年' || m || '月' || d || '日' when 1 then '於' || m || '月' || d || '日' when 2 then 'on ' || y || '-' || m || '-' || d when 3 then m || '/' || d when 4 then '第' || d || '日' when 5 then '昨天' when 6 then '2月31日，明日' else 'none' end as title,
  case when id % 3 = 0 then '13/45 5月7日' when id % 3 = 1 then '今日 123日' else '' end as summary from o)"""


def _explicit(field: str) -> str:
    """SQL of the first date of each pattern that exists, in order."""
    own_y, own_m = "year(pub)::varchar", "month(pub)::varchar"
    patterns = (("(20\\d{2})年(\\d{1,2})月(\\d{1,2})日", None, None), ("(\\d{1,2})月(\\d{1,2})日", own_y, None), ("(20\\d{2})-(\\d{1,2})-(\\d{1,2})", None, None), ("(\\d{1,2})/(\\d{1,2})", own_y, None), ("(?:^|[^0-9])(\\d{1,2})日", own_y, own_m))
    out = []
    for pattern, y, m in patterns:
        n = 1
        parts = []
        for given in (y, m, None):
            parts.append(given or f"regexp_extract({field}, '{pattern}', {n})")
            n += given is None
        out.append(f"try_cast({parts[0]} || '-' || lpad({parts[1]}, 2, '0') || '-' || lpad(nullif({parts[2]}, ''), 2, '0') as timestamp)")
    return "coalesce(" + ", ".join(out) + ")"


def _relative(field: str) -> str:
    return "case " + " ".join(f"when contains({field}, '{w}') then pub + interval ({d}) day" for w, d in times.RELATIVE) + " end"


@query(f"""with {_DATED}, x as (select id, pub, {_explicit('title')} as a, {_explicit('summary')} as b, {_relative('title')} as c, {_relative('summary')} as e from t)
select id, coalesce(a, b, c, e, pub) as event_date, case when a is not null then 'explicit_in_title' when b is not null then 'explicit_in_summary' when c is not null then 'explicit_in_title' when e is not null then 'explicit_in_summary' when pub is not null then 'inferred_from_publication' else 'unknown' end as basis,
  case when coalesce(a, b) is not null then 'high' when coalesce(c, e) is not null then 'medium' when pub is not null then 'low' else 'unknown' end as confidence from x""")
def article_event_dates(spark: SparkSession, d: str) -> DataFrame:
    """What day each of the orders, written as news, reports: five patterns, relative words, the publication."""
    day = F.col("o_orderdate")
    y = F.year(day) % 100 + 2000 - F.when(F.year(day) >= 2000, 0).otherwise(90)
    text = lambda *p: F.concat(*[F.lit(x) if isinstance(x, str) else x.cast("string") for x in p])
    m, n, k = F.month(day), F.dayofmonth(day), F.col("o_orderkey") % 8
    title = (
        F.when(k == 0, text(y, "年", m, "月", n, "日")).when(k == 1, text("於", m, "月", n, "日")).when(k == 2, text("on ", y, "-", m, "-", n)).when(k == 3, text(m, "/", n)).when(k == 4, text("第", n, "日"))
        .when(k == 5, "昨天").when(k == 6, "2月31日，明日").otherwise("none")
    )
    summary = F.when(F.col("o_orderkey") % 3 == 0, "13/45 5月7日").when(F.col("o_orderkey") % 3 == 1, "今日 123日").otherwise("")
    found = times.event_date(title, summary, F.when(F.col("o_orderkey") % 9 != 8, day))
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), found.alias("f")).select("id", F.col("f.date").cast("timestamp_ntz").alias("event_date"), "f.basis", "f.confidence")


@query(f"""with {_ARTICLES}, l as (select *, lag(id) over w as other, lag(actor) over w as actor_b, lag(ts) over w as ts_b, lag(action) over w as action_b from b window w as (partition by issue order by ts nulls last, id)),
r as (select *, coalesce(abs(floor((epoch_us(ts) - epoch_us(ts_b)) / 86400000000)) <= 7, false) as near, actor <> '' and actor = actor_b as same from l where other is not null)
select id, other, case when same and near and action <> '' and action_b <> '' and action <> action_b then 'possible_subevent' when same and near then 'related_event' when near and id % 5 = 0 then 'related_event' else 'separate_event' end as relation,
  case when same and near and action <> '' and action_b <> '' and action <> action_b then 'same_actor_close_date_different_action' when same and near then 'same_actor_close_date' when near and id % 5 = 0 then 'allegation_response_close_date'
    when not near then 'date_window_exceeded' else 'different_primary_actor' end as reason from r""")
def cluster_relationships(spark: SparkSession, d: str) -> DataFrame:
    """How each document, as a cluster's anchor, belongs to the one before it in its language."""
    by = W.partitionBy("issue").orderBy(F.asc_nulls_last("ts"), "id")
    rows = articles(spark, d).withColumns({f"{c}_b": F.lag(c).over(by) for c in ("id", "actor", "ts", "action")}).where("id_b is not null")
    found = clustering.relationship(F.col("actor"), F.col("actor_b"), F.col("ts"), F.col("ts_b"), F.col("action"), F.col("action_b"), F.col("id") % 5 == 0)
    return rows.select("id", F.col("id_b").alias("other"), found.alias("r")).select("id", "other", "r.relation", "r.reason")


@query(f"""with {_ARTICLES}, u as (select *, 'https://example.org/' || id as url from b), f as (select actor || '/' || issue as cluster, arg_min({{'id': id, 'url': url, 'day': coalesce(left(ts::varchar, 10), '')}}, (coalesce(ts, timestamp '9999-01-01'), id::varchar)) as a from u group by 1)
select cluster, a.id as anchor, 'cand_' || left(sha256('news|' || a.id || '|' || a.url || '|' || a.day), 10) as candidate_id from f""")
def candidate_event_ids(spark: SparkSession, d: str) -> DataFrame:
    """Stable ids of the documents' clusters by source and language, from their anchors alone."""
    a = articles(spark, d).withColumn("url", F.concat(F.lit("https://example.org/"), F.col("id").cast("string")))
    return clustering.candidate_ids(a, a.select("id", F.concat_ws("/", "actor", "issue").alias("cluster")))


TYPES, STATUSES = ("public_poll", "internal_poll_claim", "online_vote"), ("verified", "reported")


def _polls(spark: SparkSession, d: str) -> DataFrame:
    """Orders as polls, their lines as results."""
    k, text = F.col("o_orderkey"), lambda c: c.cast("string")
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    lines = table(spark, d, "lineitem").groupBy("l_orderkey").agg(
        F.collect_list(F.struct(F.when(F.col("l_linenumber") <= 6, text(F.col("l_linenumber") % 3)).otherwise("9").alias("question_id"), F.concat(text(F.col("l_quantity").cast("int")), F.lit("%")).alias("reported"),
                                (F.col("l_quantity").cast("int") + (F.col("l_partkey") % 20 == 0).cast("int")).cast("double").alias("normalized"))).alias("results"),
        F.count("*").alias("n"))
    question = F.transform(F.sequence(F.lit(0), F.lit(2)), lambda i: F.struct(text(i).alias("question_id")))
    empty = F.array().cast("array<struct<question_id:string>>")
    return table(spark, d, "orders").join(lines, k == F.col("l_orderkey"), "left").select(
        F.when(k % 97 != 0, text(k)).otherwise("").alias("poll_id"), F.when(k % 89 == 0, "X").otherwise("E1").alias("election_id"), F.when(k % 5 == 0, "internal_poll_claim").when(k % 7 == 0, "online_vote").when(k % 83 == 0, "odd").otherwise("public_poll").alias("poll_type"),
        F.when(k % 79 == 0, None).otherwise("verified").alias("fact_status"), (k % 3 == 0).alias("methodology_complete"), F.when(k % 11 != 0, day).alias("field_start"), F.when(k % 13 == 0, "1990-01-01").otherwise(day).alias("field_end"),
        F.when(k % 17 != 0, (k % 1000).cast("int") - 5).alias("sample_size"), F.when(k % 19 != 0, F.array(F.lit("s"))).alias("source_ids"), F.when(k % 23 != 0, F.lit("P")).alias("pollster"), F.lit("random").alias("sampling_method"),
        F.when(k % 29 != 0, F.lit("phone")).alias("interview_method"), F.lit("adults").alias("eligible_population"), F.when(k % 31 != 0, k % 2 == 0).alias("trend"), F.when(k % 37 != 0, k % 4 == 0).alias("scientific"), (k % 41 == 0).alias("syndicated"),
        F.when(k % 43 == 0, "month_only").when(k % 47 == 0, "guess").when(k % 53 != 0, "exact").alias("precision"), F.when(k % 59 == 0, F.array(F.lit("Normalized, 非100"))).otherwise(F.array(F.lit("none"))).alias("limitations"),
        F.when(k % 61 == 0, empty).otherwise(question).alias("questions"), "results", "o_custkey", "o_orderdate", "o_orderkey")


_POLLS = """l as (select l_orderkey, count(*) as n, list(case when l_linenumber <= 6 then (l_linenumber % 3)::varchar else '9' end) as qs, bool_or(l_partkey % 20 = 0) as moved, sum(l_quantity::int + (l_partkey % 20 = 0)::int) as total from lineitem group by 1),
p as (select o_orderkey as k, case when o_orderkey % 97 <> 0 then o_orderkey::varchar else '' end as poll_id, case when o_orderkey % 5 = 0 then 'internal_poll_claim' when o_orderkey % 7 = 0 then 'online_vote' when o_orderkey % 83 = 0 then 'odd' else 'public_poll' end as kind, o_orderkey % 3 = 0 as complete,
  case when o_orderkey % 11 <> 0 then left(o_orderdate::varchar, 10) else '' end as fs, case when o_orderkey % 13 = 0 then '1990-01-01' else left(o_orderdate::varchar, 10) end as fe, case when o_orderkey % 17 <> 0 then o_orderkey % 1000 - 5 end as size, o_orderkey % 23 = 0 as nobody,
  case when o_orderkey % 31 <> 0 then o_orderkey % 2 = 0 end as trend, case when o_orderkey % 37 <> 0 then o_orderkey % 4 = 0 end as scientific, case when o_orderkey % 43 = 0 then 'month_only' when o_orderkey % 47 = 0 then 'guess' else 'exact' end as prec,
  o_orderkey % 59 = 0 as says, o_orderkey % 61 = 0 as unasked, l.* from orders left join l on l_orderkey = o_orderkey)"""


@query(f"""with {_POLLS} select poll_id, 'error' as severity, 'poll_id_present' as "check", '' as detail from p where poll_id = ''
union all select poll_id, 'error', 'election_id_valid', 'X' from p where k % 89 = 0 union all select poll_id, 'error', 'poll_type_valid', kind from p where kind = 'odd' union all select poll_id, 'error', 'fact_status_valid', '' from p where k % 79 = 0
union all select poll_id, 'error', 'field_dates_valid', '' from p where fs <> '' and fs > fe union all select poll_id, 'error', 'sample_size_valid', size::varchar from p where size <= 0 union all select poll_id, 'error', 'questions_not_empty', '' from p where unasked
union all select poll_id, 'error', 'results_not_empty', '' from p where n is null union all select poll_id, 'error', 'source_ids_not_empty', '' from p where k % 19 = 0
union all select poll_id, 'error', 'result_question_ids_valid', q from (select poll_id, unasked, unnest(qs) as q from p) where q = '9' or unasked
union all select poll_id, 'error', 'methodology_complete_consistent', f from (select poll_id, unnest([case when nobody then 'pollster' end, case when fs = '' then 'field_start' end, case when size is null or size = 0 then 'sample_size' end, case when k % 29 = 0 then 'interview_method' end]) as f from p where complete) where f is not null
union all select poll_id, 'warning', 'internal_poll_not_scientific', '' from p where kind = 'internal_poll_claim' and (coalesce(trend, true) or coalesce(scientific, true)) union all select poll_id, 'warning', 'online_vote_not_scientific', '' from p where kind = 'online_vote' and coalesce(scientific, true)
union all select poll_id, 'error', 'no_duplicate_syndicated_poll', '' from p where k % 41 = 0 union all select poll_id, 'error', 'no_unjustified_normalization', '' from p where moved and not says union all select poll_id, 'warning', 'sum_is_100', '' from p where n > 0 and abs(total - 100) > 1 and not says
union all select poll_id, 'error', 'fieldwork_precision_valid', prec from p where prec = 'guess' union all select poll_id, 'error', 'exact_fieldwork_has_dates', '' from p where prec = 'exact' and fs = ''
union all select poll_id, 'error', 'vague_fieldwork_not_complete', '' from p where prec = 'month_only' and complete union all select poll_id, 'error', 'vague_fieldwork_no_trend', '' from p where prec = 'month_only' and trend
union all select poll_id, 'error', 'no_pollster_not_complete', '' from p where nobody and kind <> 'online_vote' and complete
union all select poll_id, 'error', 'no_pollster_no_trend', '' from p where nobody and kind <> 'online_vote' and (coalesce(trend, false) or (kind = 'internal_poll_claim' and coalesce(scientific, false))) union all select poll_id, 'warning', 'pollster_not_published', '' from p where nobody and kind = 'internal_poll_claim'""")
def poll_record_issues(spark: SparkSession, d: str) -> DataFrame:
    """Every rule that a poll record breaks, over all orders as polls."""
    return polls.poll_issues(_polls(spark, d), "E1", TYPES, STATUSES)


@query("""with q as (select o_orderkey as id, o_custkey, ['A', 'B', case when o_orderkey % 3 = 0 then 'C' else 'B' end] as c, case when o_orderkey % 4 = 0 then null else 'adults' end as pop, 'q' || (o_orderkey % 5) // 4 as question, case when o_orderkey % 6 = 0 then 'online_vote' else 'public_poll' end as kind, o_orderdate from orders),
l as (select *, lag(id) over w as other, lag(c) over w as c0, lag(pop) over w as pop0, lag(question) over w as question0, lag(kind) over w as kind0 from q window w as (partition by o_custkey order by o_orderdate, id))
select id, other, coalesce(pop, 'unknown') || '|' || question || '|' || array_to_string(list_sort(c), '_') as group_key, array_to_string(list_filter([case when list_sort(list_distinct(c)) <> list_sort(list_distinct(c0)) then 'candidate_sets_differ' end, case when question <> question0 then 'question_types_differ' end,
  case when kind = 'online_vote' or kind0 = 'online_vote' then 'internal_or_online' end], lambda x: x is not null), '|') as conflicts from l where other is not null""")
def poll_comparability(spark: SparkSession, d: str) -> DataFrame:
    """Whether each of a customer's polls may be compared with the one before, and if not, why; and the group it belongs to."""
    k = F.col("o_orderkey")
    poll = F.struct(
        F.array(F.lit("A"), F.lit("B"), F.when(k % 3 == 0, "C").otherwise("B")).alias("candidates"), F.when(k % 4 != 0, "adults").alias("population"), F.concat(F.lit("q"), F.floor(k % 5 / 4).cast("string")).alias("question"),
        F.when(k % 6 == 0, "online_vote").otherwise("public_poll").alias("kind"))
    by = W.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    rows = table(spark, d, "orders").select(k.alias("id"), poll.alias("a"), F.lag(poll).over(by).alias("b"), F.lag("o_orderkey").over(by).alias("other")).where("other is not null")
    return rows.select("id", "other", polls.group_key(F.col("a.population"), F.col("a.question"), F.col("a.candidates")).alias("group_key"), F.array_join(polls.conflicts(F.col("a"), F.col("b")), "|").alias("conflicts"))


START, END = "2024-01-05", "2024-01-20"


def _covered(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    events = table(spark, d, "events")
    users = events.select("user_id").distinct().withColumn("cutoff", F.when(F.col("user_id") % 4 == 0, F.date_add(F.lit(END).cast("date"), 1)).when(F.col("user_id") % 4 == 1, F.lit("2024-01-15").cast("date")).when(F.col("user_id") % 4 == 2, F.lit("2023-12-01").cast("date")))
    return events, users


_COVERED = """u as (select distinct user_id, case user_id % 4 when 0 then date '2024-01-21' when 1 then date '2024-01-15' when 2 then date '2023-12-01' end as cutoff from events), p as (select * from events where ts::date between date '2024-01-05' and date '2024-01-20'),
dd as (select unnest(generate_series(date '2024-01-05', date '2024-01-20', interval 1 day))::date as day), free as (select u.user_id, day, (day - date '2024-01-01') - row_number() over (partition by u.user_id order by day) as i from u, dd where not exists (select 1 from p where p.user_id is not distinct from u.user_id and p.ts::date = day)),
g as (select user_id, 'unreviewed_period' as kind, greatest(date '2024-01-05', coalesce(cutoff + 1, date '2024-01-05')) as gap_start, date '2024-01-20' as gap_end, coalesce(cutoff::varchar, '') as detail, true as blocking from u where cutoff is null or cutoff < date '2024-01-20'
  union all select u.user_id, 'missing_required_dimension', null, null, t, true from u, (values ('click'), ('purchase')) as k(t) where not exists (select 1 from p where p.user_id is not distinct from u.user_id and p.event_type = t)
  union all select user_id, 'no_event_day', min(day), max(day), '', false from free group by user_id, i)"""


def _gaps(spark: SparkSession, d: str) -> DataFrame:
    events, users = _covered(spark, d)
    return coverage.gaps(events, "user_id", F.col("ts"), F.col("event_type"), START, END, users, ("click", "purchase"))


@query(f"with {_COVERED} select * from g")
def coverage_gap_kinds(spark: SparkSession, d: str) -> DataFrame:
    """Gaps of each user's period: not reviewed, without a required kind of event, days without events; and which block."""
    return _gaps(spark, d)


@query(f"""with {_COVERED}, n as (select u.user_id, cutoff, (select count(*) from p where p.user_id is not distinct from u.user_id) as n_events, (select max(ts::date) from p where p.user_id is not distinct from u.user_id) as latest_event,
  (select count(*) from g where g.user_id is not distinct from u.user_id and blocking) as n_blocking, (select count(*) from g where g.user_id is not distinct from u.user_id and not blocking) as n_harmless from u)
select user_id, n_events, latest_event, cutoff, n_blocking, n_harmless, case when cutoff >= date '2024-01-20' and n_blocking = 0 then 'full' else 'partial' end as status,
  'fact_coverage_' || strftime(coalesce(cutoff, date '2024-01-20'), '%Y%m%d') || '_v' || lpad((('0x' || left(sha256(coalesce(cutoff::varchar, '') || '|' || n_events || '|' || n_blocking), 8))::bigint % 1000 + 1)::varchar, 3, '0') as version from n""")
def coverage_status(spark: SparkSession, d: str) -> DataFrame:
    """Coverage of each user's period: counts, gaps, status and a version from its content."""
    events, users = _covered(spark, d)
    return coverage.coverage(events, _gaps(spark, d), "user_id", "event_id", F.col("ts"), START, END, users)


@query("""with s as (select o_orderkey as key, o_orderdate::date as ps, o_orderdate::date + (o_orderkey % 20)::int as pe, case when o_orderkey % 6 <> 0 then o_orderdate::date + (o_orderkey % 15)::int end as c, case when o_orderkey % 7 = 0 then 'done' when o_orderkey % 2 = 0 then 'full' else 'partial' end as status,
  case when o_orderkey % 8 = 0 then 'v1' else 'fact_coverage_20240101_v001' end as version, o_orderkey % 10 = 0 as derived, o_orderkey % 3 as n_blocking, o_orderkey % 4 as r, o_custkey from orders)
select key, 'coverage_status_allowed' as "check" from s where status = 'done' union all select key, 'coverage_version_format' from s where version = 'v1' union all select key, 'date_ranges_valid' from s where ps >= pe union all select key, 'facts_cutoff_not_derived_from_latest_event' from s where derived
union all select key, 'full_status_requires_cutoff' from s where status = 'full' and (c is null or c < pe) union all select key, 'coverage_status_consistent_with_gap_state' from s where status = 'full' and n_blocking > 0 union all select key, 'uncovered_ranges_valid' from s where r = 1
union all select key, 'unreviewed_period_disclosed' from s where c < pe and not coalesce(r = 2 and ps <= c + 1 and c + 1 <= pe, false) union all select key, 'no_inference' from s where r = 3 union all select key, 'all_event_ids_resolve' from s where o_custkey not in (select c_custkey from customer where c_custkey % 9 <> 0)""")
def coverage_faults(spark: SparkSession, d: str) -> DataFrame:
    """What is wrong with stated coverages, made from every order."""
    k, day = F.col("o_orderkey"), F.col("o_orderdate").cast("date")
    end, r = F.date_add(day, (k % 20).cast("int")), k % 4
    span = lambda a, b: F.array(F.struct(a.alias("low"), b.alias("high")))
    stated = table(spark, d, "orders").select(
        k.alias("key"), day.alias("period_start"), end.alias("period_end"), F.when(k % 6 != 0, F.date_add(day, (k % 15).cast("int"))).alias("cutoff"), F.when(k % 7 == 0, "done").when(k % 2 == 0, "full").otherwise("partial").alias("status"),
        F.when(k % 8 == 0, "v1").otherwise("fact_coverage_20240101_v001").alias("version"), F.when(k % 10 == 0, "derived_from_latest_event").otherwise("authoritative_input").alias("provenance"), (k % 3).alias("n_blocking"),
        F.when(r == 1, span(F.lit("2024-02-02").cast("date"), F.lit("2024-02-01").cast("date"))).when(r == 2, span(day, end)).otherwise(F.array().cast("array<struct<low:date,high:date>>")).alias("ranges"), F.array("o_custkey").alias("event_ids"),
        F.when(r == 3, F.array(F.lit("coverage_status"), F.lit("win_rate"))).otherwise(F.array(F.lit("coverage_status"))).alias("fields"))
    return coverage.stated_faults(stated, table(spark, d, "customer").where("c_custkey % 9 <> 0").select(F.col("c_custkey").alias("id")))
