"""Core queries, part one: scans, URLs, deduplication, filters, rules, ranking."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.functions import text as T
from newsloom.functions import times, urls
from newsloom.operators import dedup, ranking, rules
from newsloom.storage import table

CLOCK = "2024-01-29 12:00:00"
QUERIES, ORACLE = {}, {}


def query(sql: str | None = None):
    """Registers a query under its function's name, with its DuckDB statement."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


@query(f"""
with c as (select *, case when ts is null then 'unknown' when epoch_us(timestamp '{CLOCK}') - epoch_us(ts) < -600000000 then 'future'
  when epoch_us(timestamp '{CLOCK}') - epoch_us(ts) <= 5400000000 then 'fresh' when epoch_us(timestamp '{CLOCK}') - epoch_us(ts) <= 43200000000 then 'catch_up' else 'stale' end as bucket from events),
b as (select distinct user_id from events where ts < timestamp '{CLOCK}' - interval 720 minutes),
f as (select c.*, case when bucket = 'catch_up' and b.user_id is null then 'baseline_excluded' else bucket end as final from c left join b using (user_id))
select event_type, final as bucket, count(*)::bigint as n from f group by all""")
def freshness_buckets(spark: SparkSession, d: str) -> DataFrame:
    """Freshness against a clock; catch-up rows of sources without earlier rows are set apart."""
    e = table(spark, d, "events")
    clock = F.lit(CLOCK).cast("timestamp_ntz")
    known = e.where(times.minutes_between(clock, F.col("ts")) > times.CATCH_UP).select(F.col("user_id").alias("u")).distinct()
    marked = e.withColumn("bucket", times.freshness(F.col("ts"), clock)).join(known, F.col("user_id") == F.col("u"), "left")
    final = F.when((F.col("bucket") == "catch_up") & F.col("u").isNull(), "baseline_excluded").otherwise(F.col("bucket"))
    return marked.groupBy("event_type", final.alias("bucket")).agg(F.count("*").alias("n"))


_PARTS = r"'^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)(?:\?([^#]*))?(?:#.*)?$'"


def _p(i: int) -> str:
    return f"coalesce(regexp_extract(trim(url), {_PARTS}, {i}), '')"


_HOST = f"lower(regexp_replace(regexp_replace({_p(2)}, '^.*@', ''), ':[0-9]*$', ''))"


def _q(drop: tuple[str, ...]) -> str:
    keys = ", ".join(f"'{k}'" for k in drop)
    return f"array_to_string(list_sort(list_filter(string_split({_p(4)}, '&'), lambda p: regexp_matches(p, '^[^=]+=.+$') and lower(regexp_extract(p, '^([^=]*)', 1)) not in ({keys}))), '&')"


def _joined(base: str, q: str) -> str:
    return f"case when {q} = '' then {base} else {base} || '?' || {q} end"


_COLLECTOR = f"case when {_p(1)} = '' then lower(trim(url)) else {_joined(f"lower({_p(1)}) || '://' || lower({_p(2)}) || regexp_replace(lower({_p(3)}), '/+$', '')", _q(urls.TRACKING['collector']))} end"
_CANDIDATE = f"case when {_p(1)} = '' then lower(trim(url)) else {_joined(f"lower({_p(1)}) || '://' || {_HOST} || case when regexp_replace(lower({_p(3)}), '/+$', '') = '' then '/' else regexp_replace(lower({_p(3)}), '/+$', '') end", _q(urls.TRACKING['candidate']))} end"
_EVENT = f"case when {_p(1)} = '' then trim(url) else {_joined(f"lower({_p(1)}) || '://' || lower({_p(2)}) || case when {_p(3)} = '/' then '/' else regexp_replace({_p(3)}, '/+$', '') end", _q(urls.TRACKING['event']))} end"
_RELEASE = "regexp_replace(regexp_replace(lower(trim(url)), '[?&]utm_[^&#]*', '', 'g'), '/+$', '')"
_DOMAIN = f"regexp_replace({_HOST}, '^www\\.', '')"
_NUMBER = f"regexp_extract({_p(3)}, '/([0-9]{{2,}})/?$', 1)"
_IDENTITY = f"case when {_NUMBER} <> '' then 'id:' || {_DOMAIN} || ':' || {_NUMBER} else 'url:' || ({_COLLECTOR}) end"


@query(f"select page_id, {_COLLECTOR} as collector, {_CANDIDATE} as candidate, {_EVENT} as event, {_RELEASE} as release, {_DOMAIN} as domain from pages")
def url_normalize(spark: SparkSession, d: str) -> DataFrame:
    u = F.col("url")
    return table(spark, d, "pages").select("page_id", urls.collector_url(u).alias("collector"), urls.candidate_url(u).alias("candidate"), urls.event_url(u).alias("event"), urls.release_url(u).alias("release"), urls.domain(u).alias("domain"))


_PRIVATE = f"({_HOST} = 'localhost' or regexp_matches({_HOST}, '\\.(local|localhost|internal)$') or regexp_matches({_HOST}, '^(127|10)\\.') or regexp_matches({_HOST}, '^192\\.168\\.') or regexp_matches({_HOST}, '^172\\.(1[6-9]|2[0-9]|3[01])\\.') or regexp_matches({_HOST}, '^(0x[0-9a-f]+|[0-9]+)$') or regexp_matches({_HOST}, '^\\['))"


@query(f"""select page_id, (lower({_p(1)}) = 'https' and {_HOST} <> '' and not contains({_p(2)}, '@') and not {_PRIVATE}) as safe,
({_HOST} = 'example.com' or ends_with({_HOST}, '.example.com') or {_HOST} = 'example.org' or ends_with({_HOST}, '.example.org')) as allowed from pages""")
def url_safety(spark: SparkSession, d: str) -> DataFrame:
    u = F.col("url")
    return table(spark, d, "pages").select("page_id", urls.safe_url(u).alias("safe"), urls.allowed_host(u, ["example.com", "example.org"]).alias("allowed"))


@query(f"select page_id, ({_COLLECTOR}) <> '' and row_number() over (partition by ({_COLLECTOR}) order by page_id) > 1 as is_duplicate from pages")
def dedup_url_first(spark: SparkSession, d: str) -> DataFrame:
    return dedup.first_wins(table(spark, d, "pages"), urls.collector_url(F.col("url")), "page_id").select("page_id", "is_duplicate")


@query(f"select page_id, row_number() over (partition by ({_IDENTITY}) order by page_id) > 1 as is_duplicate, {_IDENTITY} as identity from pages")
def identity_dedup(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "pages").withColumn("identity", urls.identity_key(F.col("url")))
    return dedup.first_wins(p, F.col("identity"), "page_id").select("page_id", "is_duplicate", "identity")


@query(f"""with o as (select * from pages where page_id % 2 = 0), n as (select page_id, ({_COLLECTOR}) as k, ({_IDENTITY}) as j from pages where page_id % 2 = 1)
select page_id, case when k in (select ({_COLLECTOR}) from o) then 'url_seen' when j in (select ({_IDENTITY}) from o) then 'identity_seen' else 'new' end as status from n""")
def history_antijoin(spark: SparkSession, d: str) -> DataFrame:
    """Rows against history: even page ids are what was stored before, odd ones arrive."""
    p = table(spark, d, "pages")
    return dedup.history_split(p.where("page_id % 2 = 1"), p.where("page_id % 2 = 0"), urls.collector_url, urls.identity_key).select("page_id", "status")


@query("""select text_key, n, members from (select md5(regexp_replace(lower(coalesce(text, '')), '[^a-z0-9]', '', 'g')) as text_key, count(*)::bigint as n,
  string_agg(doc_id::varchar, '|' order by doc_id::varchar) as members from documents group by 1) where n > 1""")
def doc_exact_dup(spark: SparkSession, d: str) -> DataFrame:
    key = F.md5(F.regexp_replace(F.lower(F.coalesce("text", F.lit(""))), "[^a-z0-9]", ""))
    return table(spark, d, "documents").groupBy(key.alias("text_key")).agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_list(F.col("doc_id").cast("string"))), "|").alias("members")).where("n > 1")


@query("""select title_key, n, n_sources, substr(sha256(members), 1, 16) as event_id, case when n_sources > 1 then 'high' else 'low' end as confidence from (
  select substr(regexp_replace(lower(p_name), '[^a-z0-9]', '', 'g'), 1, 50) as title_key, count(*)::bigint as n, count(distinct p_brand)::bigint as n_sources,
    string_agg(p_partkey::varchar, '|' order by p_partkey::varchar) as members from part group by 1)""")
def title_group_events(spark: SparkSession, d: str) -> DataFrame:
    return dedup.title_groups(table(spark, d, "part"), "p_name", "p_partkey", "p_brand")


@query("""with t as (select event_id, event_type, user_id, date_trunc('hour', ts) as h from events),
c as (select event_id, (count(*) over (partition by user_id, h) - 1)::bigint as url_dups, (count(*) over (partition by user_id, event_type) - 1)::bigint as title_dups,
  min(event_type) over (partition by user_id, h) <> max(event_type) over (partition by user_id, h) as cross_category from t)
select *, case when url_dups > 0 and title_dups > 0 then 'url+title' when url_dups > 0 then 'url' when title_dups > 0 then 'title' else 'unique' end as reason from c""")
def duplicate_diagnosis(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").withColumn("url", F.concat_ws("@", "user_id", F.date_trunc("hour", F.col("ts").cast("timestamp")).cast("string")))
    return dedup.duplicate_report(e, "url", "event_type", "user_id", "event_type").select("event_id", "url_dups", "title_dups", "cross_category", "reason")


DEFAULT_BLOCK, LANG_BLOCK = ["trash", "scum"], {"en": ["idiot", "moron"], "de": ["keitung"]}


@query("""with h as (select doc_id, lang, list_filter(case when lang = 'en' then ['trash', 'scum', 'idiot', 'moron'] when lang = 'de' then ['trash', 'scum', 'keitung'] else ['trash', 'scum'] end,
  lambda w: contains(lower(coalesce(text, '')), w)) as ws from documents) select doc_id, array_to_string(ws, '|') as blocked_by, len(ws) > 0 as blocked from h""")
def content_filter_split(spark: SparkSession, d: str) -> DataFrame:
    return rules.content_filter(table(spark, d, "documents"), F.coalesce("text", F.lit("")), F.col("lang"), DEFAULT_BLOCK, LANG_BLOCK).select("doc_id", "blocked_by", "blocked")


FAMILIES = [("faith", ["clown"]), ("military", ["scum", "trash"]), ("world", ["license", "copyright"]), ("economy", ["tion"])]


@query("""select case when contains(t, 'clown') then 'faith' when contains(t, 'scum') or contains(t, 'trash') then 'military' when contains(t, 'license') or contains(t, 'copyright') then 'world'
  when contains(t, 'tion') then 'economy' else lang end as category, count(*)::bigint as n from (select lower(coalesce(text, '')) as t, lang from documents) group by 1""")
def category_classify(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").groupBy(rules.category(F.coalesce("text", F.lit("")), FAMILIES, F.col("lang")).alias("category")).agg(F.count("*").alias("n"))


RULES = [
    rules.ImportanceRule("leadership", ("the",), ("tion",), ("license",), ("clown",), 78, ((("ing",), 8),), "critical"),
    rules.ImportanceRule("region", ("der", "die"), ("ung",), (), ("scum",), 68, ((("keit",), 10),), "important"),
    rules.ImportanceRule("notice", (), (), ("released", "token"), (), 60, (), "normal"),
]
_IMPORTANCE = """
with m as (select doc_id, lower(coalesce(text, '')) as t, source = 'src0' as official, source = 'src1' as tier from documents),
r as (select doc_id, official, tier,
  case when ((contains(t, 'the') and contains(t, 'tion')) or contains(t, 'license')) and not contains(t, 'clown') then 78 + case when contains(t, 'ing') then 8 else 0 end end as a,
  case when (contains(t, 'der') or contains(t, 'die')) and contains(t, 'ung') and not contains(t, 'scum') then 68 + case when contains(t, 'keit') then 10 else 0 end end as b,
  case when contains(t, 'released') or contains(t, 'token') then 60 end as c from m),
s as (select *, (a is not null)::int + (b is not null)::int + (c is not null)::int as k from r),
x as (select *, case when official then 5 when tier then 3 else 0 end + case when k >= 2 then 5 else 0 end as extra from s),
u as (select doc_id, k, unnest([{'p': a, 'cap': 0, 'i': 0, 'name': 'leadership'}, {'p': b, 'cap': 1, 'i': 1, 'name': 'region'}, {'p': c, 'cap': 2, 'i': 2, 'name': 'notice'}]) as h, extra from x),
v as (select doc_id, k, h.i as i, h.name as name, least(greatest(h.p + extra, 0), 100) as score, h.cap as cap from u where h.p is not null),
l as (select *, greatest(case when score >= 85 then 0 when score >= 65 then 1 else 2 end, cap) as ord from v),
best as (select * from l qualify row_number() over (partition by doc_id order by ord desc, score desc, i) = 1),
done as (select m.doc_id, coalesce(best.k, 0)::bigint as rules_hit, coalesce(best.score, 0)::bigint as score, coalesce(['critical', 'important', 'normal'][best.ord + 1], 'normal') as level, coalesce(best.name, '') as best_rule from m left join best using (doc_id))
"""


@query(_IMPORTANCE + "select * from done")
def importance_score(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").withColumn("body", F.coalesce("text", F.lit("")))
    return rules.importance(docs, F.col("body"), RULES, F.col("source") == "src0", F.col("source") == "src1").select("doc_id", "rules_hit", "score", "level", "best_rule")


@query(_IMPORTANCE + "select level, count(*)::bigint as n from done group by 1")
def importance_levels(spark: SparkSession, d: str) -> DataFrame:
    return importance_score(spark, d).groupBy("level").agg(F.count("*").alias("n"))


_REL = ["idiot"], ["tion"], ["license"], ["der"]


@query("""select doc_id, case when contains(t, 'idiot') then 'direct' when contains(t, 'tion') and contains(t, 'license') then 'region_strong' when contains(t, 'tion') and contains(t, 'der') then 'region_other'
  when contains(t, 'tion') then 'region' when contains(t, 'der') then 'other' else 'none' end as relevance from (select doc_id, lower(coalesce(text, '')) as t from documents)""")
def relevance_decision(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", rules.relevance(F.coalesce("text", F.lit("")), *_REL).alias("relevance"))


@query("""with f as (select doc_id, contains(t, 'ing') as r, contains(t, 'idiot') as p, contains(t, 'scum') as q, contains(t, 'license') as i, contains(t, 'tion') or contains(t, 'license') as c, contains(t, 'clown') as x
  from (select doc_id, lower(coalesce(text, '')) as t from documents)),
g as (select *, (r or p or q or i) and (not x or c) as m, case when p then 3 else 0 end + case when q then 2 else 0 end + case when c then 2 else 0 end + case when i then 1 else 0 end as s from f)
select doc_id, m as matched, case when m then s else 0 end::bigint as score, case when not m then 'none' when s >= 5 then 'high' when s >= 3 then 'medium' else 'low' end as level from g""")
def place_match(spark: SparkSession, d: str) -> DataFrame:
    found = rules.place_match(F.coalesce("text", F.lit("")), ["ing"], ["idiot"], ["scum"], ["license"], ["tion"], ["clown"])
    return table(spark, d, "documents").select("doc_id", found.alias("m")).select("doc_id", "m.*")


TYPES = [("attack", ["idiot", "scum", "moron"], [], None), ("notice", ["license", "version"], ["clown"], "license"), ("report", ["tion"], [], None)]


@query("""with h as (select doc_id, t, contains(t, 'idiot')::int + contains(t, 'scum')::int + contains(t, 'moron')::int as a, contains(t, 'license')::int + contains(t, 'version')::int as b, contains(t, 'tion')::int as c
  from (select doc_id, lower(coalesce(text, '')) as t from documents)),
g as (select doc_id, a, case when not contains(t, 'clown') and contains(t, 'license') then b else 0 end as b, c from h)
select doc_id, case when greatest(a, b, c) = 0 then 'unknown' when a >= b and a >= c then 'attack' when b >= c then 'notice' else 'report' end as event_type from g""")
def event_type_classify(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", rules.event_type(F.coalesce("text", F.lit("")), TYPES).alias("event_type"))


_CAPPED = """
with b as (select *, date_trunc('month', o_orderdate) as m, case when o_totalprice >= 300000 then 0 when o_totalprice >= 150000 then 1 else 2 end as lvl,
  o_orderpriority = '1-URGENT' as res, o_orderpriority in ('1-URGENT', '2-HIGH') as sh from orders),
one as (select *, res and row_number() over (partition by m, res order by lvl, o_totalprice desc, o_orderdate desc, o_orderkey) <= 1 as first from b),
two as (select *, greatest(3 - sum((first and sh)::int) over (partition by m), 0) as lft from one),
three as (select *, (sh and not first) and row_number() over (partition by m, (sh and not first) order by lvl, o_totalprice desc, o_orderdate desc, o_orderkey) <= lft as second from two),
four as (select *, first or second as taken, 5 - sum((first or second)::int) over (partition by m) as room from three),
five as (select *, taken or row_number() over (partition by m, taken order by lvl, o_totalprice desc, o_orderdate desc, o_orderkey) <= room as picked from four)
select o_orderkey, o_orderpriority from five where picked"""


@query(_CAPPED)
def highlight_capped_topk(spark: SparkSession, d: str) -> DataFrame:
    """Per month at most five orders, one urgent and three of the two high lanes reserved."""
    o = table(spark, d, "orders").withColumn("month", F.date_trunc("month", F.col("o_orderdate").cast("timestamp")))
    level = F.when(F.col("o_totalprice") >= 300000, 0).when(F.col("o_totalprice") >= 150000, 1).otherwise(2)
    order = [level.asc(), F.col("o_totalprice").desc(), F.col("o_orderdate").desc(), F.col("o_orderkey").asc()]
    picked = ranking.capped_selection(o, ["month"], order, F.col("o_orderpriority") == "1-URGENT", F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"))
    return picked.where("picked").select("o_orderkey", "o_orderpriority")


@query("select o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey limit 20")
def highlight_top(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(20)


@query("""select o_orderkey, o_orderpriority, row_number() over (order by o_totalprice desc, o_orderkey)::bigint as rank from (
  select * from orders qualify row_number() over (partition by o_orderpriority order by o_totalprice desc, o_orderkey) <= 10) order by o_totalprice desc, o_orderkey limit 15""")
def background_quota(spark: SparkSession, d: str) -> DataFrame:
    return ranking.quota_selection(table(spark, d, "orders"), "o_orderpriority", [F.col("o_totalprice").desc(), F.col("o_orderkey").asc()]).select("o_orderkey", "o_orderpriority", "rank")


@query("select user_id, event_id, row_number() over (partition by user_id order by ts, event_id)::bigint as position from events qualify position <= 20")
def feed_position(spark: SparkSession, d: str) -> DataFrame:
    return ranking.top_n(table(spark, d, "events"), ["user_id"], [F.col("ts").asc(), F.col("event_id").asc()], 20).select("user_id", "event_id", "position")


@query("select source, doc_id from documents qualify row_number() over (partition by source order by (length(trim(coalesce(text, ''))) > 500) desc, doc_id desc) = 1")
def source_representative(spark: SparkSession, d: str) -> DataFrame:
    full = F.length(F.trim(F.coalesce("text", F.lit("")))) > 500
    return ranking.top_n(table(spark, d, "documents"), ["source"], [full.desc(), F.col("doc_id").desc()], 1).select("source", "doc_id")


@query("""with r as (select o_orderkey, o_orderdate, 0 as part from orders where o_orderdate >= timestamp '1998-01-01' order by o_orderdate desc, o_orderkey limit 30),
h as (select o_orderkey, o_orderdate, 1 as part from orders where o_totalprice > 300000 and o_orderkey not in (select o_orderkey from r) order by o_totalprice desc, o_orderkey limit 50)
select o_orderkey, part from (select * from r union all select * from h) order by part, o_orderdate desc, o_orderkey limit 40""")
def context_union(spark: SparkSession, d: str) -> DataFrame:
    """Recent rows, then notable older ones that aren't among them, up to a maximum."""
    o = table(spark, d, "orders")
    recent = o.where(F.col("o_orderdate") >= F.lit("1998-01-01").cast("timestamp_ntz")).orderBy(F.desc("o_orderdate"), "o_orderkey").limit(30).select("o_orderkey", "o_orderdate", F.lit(0).alias("part"))
    old = o.where("o_totalprice > 300000").join(recent.select("o_orderkey"), "o_orderkey", "left_anti").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(50).select("o_orderkey", "o_orderdate", F.lit(1).alias("part"))
    return recent.unionByName(old).orderBy("part", F.desc("o_orderdate"), "o_orderkey").limit(40).select("o_orderkey", "part")


@query("""select event_id, event_type, value from events where event_type in ('purchase', 'signup') and value > 0 order by value desc, ts desc, event_id limit 25""")
def milestones_topk(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").where("event_type in ('purchase', 'signup') and value > 0").orderBy(F.desc("value"), F.desc("ts"), "event_id").limit(25).select("event_id", "event_type", "value")


_SEARCH = """with w as (select doc_id, source, lower(coalesce(text, '')) as t from documents),
p as (select doc_id, greatest(case when contains(t, 'license') then 15 else 0 end, case when contains(lower(source), 'license') then 35 else 0 end) as a,
  greatest(case when contains(t, 'tion') then 15 else 0 end, case when contains(lower(source), 'tion') then 35 else 0 end) as b,
  greatest(case when contains(t, 'src1') then 15 else 0 end, case when contains(lower(source), 'src1') then 35 else 0 end) as c from w),
m as (select doc_id, ((a > 0)::int + (b > 0)::int + (c > 0)::int)::bigint as matched, (a + b + c)::bigint as relevance from p)
select doc_id, matched, relevance, case when matched = 3 then 'strict' else 'relaxed' end as mode from m where matched >= 2 order by relevance desc, mode, doc_id limit 50"""


@query(_SEARCH)
def search_rank(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "source", F.coalesce("text", F.lit("")).alias("text"))
    mode_order = [F.desc("relevance"), F.when(F.col("mode") == "relaxed", 0).otherwise(1), F.col("doc_id")]
    return rules.search(docs, "license tion src1", {"text": 15, "source": 35}).orderBy(*mode_order).limit(50).select("doc_id", "matched", "relevance", "mode")


@query("""select doc_id, contains(' ' || array_to_string(regexp_extract_all(regexp_replace(lower(coalesce(text, '')), '\\b([a-z])\\.([a-z])\\.', '\\1\\2', 'g'), '[a-z0-9]+'), ' ') || ' ', ' mit license ') as phrase,
  contains(' ' || array_to_string(regexp_extract_all(regexp_replace(lower(coalesce(text, '')), '\\b([a-z])\\.([a-z])\\.', '\\1\\2', 'g'), '[a-z0-9]+'), ' ') || ' ', ' of the ') as common from documents""")
def word_phrase_hits(spark: SparkSession, d: str) -> DataFrame:
    t = F.coalesce("text", F.lit(""))
    return table(spark, d, "documents").select("doc_id", T.has_phrase(t, "MIT License").alias("phrase"), T.has_phrase(t, "of the").alias("common"))


@query("""select doc_id, regexp_matches(t, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{2,}') as email, regexp_matches(t, '\\b[0-9]{1,3}\\.[0-9]{1,3}\\.[0-9]{1,3}\\.[0-9]{1,3}\\b') as ip,
  regexp_matches(t, '(?i)(api[_-]?key|secret|token|password)\\s*[=:]\\s*[^\\s]{8,}') as assigned, regexp_matches(t, '\\b[0-9a-f]{32,}\\b') as hex from (select doc_id, coalesce(text, '') as t from documents)""")
def secret_scan(spark: SparkSession, d: str) -> DataFrame:
    found = T.secret_classes(F.coalesce("text", F.lit("")))
    docs = table(spark, d, "documents").select("doc_id", found.alias("s"))
    return docs.select("doc_id", *[F.array_contains("s", name).alias(short) for name, short in (("email", "email"), ("ip_address", "ip"), ("assigned_secret", "assigned"), ("long_hex", "hex"))])


@query("""select doc_id, len(regexp_extract_all(coalesce(text, ''), '[0-9]+(?:\\.[0-9]+)?'))::bigint as n_numbers, array_to_string(list_slice(regexp_extract_all(coalesce(text, ''), '[0-9]+(?:\\.[0-9]+)?'), 1, 5), '|') as first_numbers from documents""")
def number_extract(spark: SparkSession, d: str) -> DataFrame:
    n = T.numbers(F.coalesce("text", F.lit("")))
    return table(spark, d, "documents").select("doc_id", F.size(n).cast("long").alias("n_numbers"), F.array_join(F.slice(n, 1, 5), "|").alias("first_numbers"))


@query("""with b as (select page_id, trim(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<(?:script|style)[^>]*>.*?</(?:script|style)>', ' ', 'g'), '<[^>]*>', ' ', 'g'), '[ \\t\\n\\r\\f]+', ' ', 'g')) as t from pages)
select page_id, case when length(t) <= 150 then t when regexp_extract(substr(t, 1, 150), '^(.*[.!?])', 1) <> '' then regexp_extract(substr(t, 1, 150), '^(.*[.!?])', 1) else substr(t, 1, 150) end as summary from b""")
def summary_clean(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", T.clean_summary(F.col("html")).alias("summary"))


@query("""select page_id, regexp_extract(html, '(?is)<title>(.*?)</title>', 1) as title, regexp_extract(html, '<html lang="([a-z]+)"', 1) as lang, regexp_extract(html, '(?is)<h1[^>]*>(.*?)</h1>', 1) as heading from pages""")
def html_meta(spark: SparkSession, d: str) -> DataFrame:
    h = F.col("html")
    return table(spark, d, "pages").select("page_id", F.regexp_extract(h, "(?is)<title>(.*?)</title>", 1).alias("title"), F.regexp_extract(h, '<html lang="([a-z]+)"', 1).alias("lang"), F.regexp_extract(h, "(?is)<h1[^>]*>(.*?)</h1>", 1).alias("heading"))
