"""Core queries, part nine: messages, reconciled references, exact covers and text measures."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.functions import text as T
from newsloom.functions import times
from newsloom.operators import notifications, reconcile
from newsloom.storage import table

QUERIES, ORACLE = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


_EVENTS = """m as (select l_orderkey as event, l_orderkey || '-' || l_linenumber as url, 's' || l_suppkey as source, case when l_linenumber <> 5 then l_shipdate end as ts, case when l_partkey % 40 = 0 then null when l_partkey % 3 = 0 then 'fresh' else 'stale' end as state, l_suppkey % 4 = 0 as international,
  case when l_quantity > 45 then 'critical' when l_quantity > 30 then 'important' else 'normal' end as level, (l_quantity * 2)::int as score from lineitem),
e as (select o_orderkey as event, case when o_orderkey % 3 = 0 then '' when o_orderkey % 10 = 1 then 'same' else 'e' || o_orderkey end as event_id, 'c' || o_custkey as canonical, o_orderkey % 5 <> 0 as relevant from orders)"""


@query(f"""with {_EVENTS}, j as (select event, bool_or(international) as foreign_, bool_and(state is not null) as known, count(*)::bigint as n_members from m group by 1),
f as (select event, arg_max({{'url': url, 'source': source}}, (coalesce(ts, timestamp '0001-01-01'), source, url)) as x from m where state = 'fresh' group by 1),
b as (select event, arg_max({{'level': level, 'score': score}}, (case level when 'critical' then 2 when 'important' then 1 else 0 end, score)) as x from m group by 1),
k as (select e.*, n_members, f.x.url as evidence_url, f.x.source as evidence_source, b.x.level as level, b.x.score as score, case when event_id <> '' then 'event:' || event_id else 'url:' || canonical end as key from e join j using (event) join f using (event) join b using (event) where relevant and foreign_ and known and b.x.level in ('important', 'critical') and b.x.score >= 65)
select event, key, level, score, evidence_url, evidence_source, n_members from k where key not in (select 'url:c' || c_custkey from customer where c_custkey % 6 = 0) qualify row_number() over (partition by key order by event) = 1""")
def notification_candidates(spark: SparkSession, d: str) -> DataFrame:
    """Orders as events that make a message: international, all members classified, one fresh, relevant, important enough, new, each key once."""
    k = F.col("o_orderkey")
    text = lambda c: F.col(c).cast("string")
    members = table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("event"), F.concat_ws("-", text("l_orderkey"), text("l_linenumber")).alias("url"), F.concat(F.lit("s"), text("l_suppkey")).alias("source"), F.when(F.col("l_linenumber") != 5, F.col("l_shipdate")).alias("ts"),
        F.when(F.col("l_partkey") % 40 == 0, None).when(F.col("l_partkey") % 3 == 0, "fresh").otherwise("stale").alias("state"), (F.col("l_suppkey") % 4 == 0).alias("international"),
        F.when(F.col("l_quantity") > 45, "critical").when(F.col("l_quantity") > 30, "important").otherwise("normal").alias("level"), (F.col("l_quantity") * 2).cast("int").alias("score"))
    events = table(spark, d, "orders").select(
        k.alias("event"), F.when(k % 3 == 0, "").when(k % 10 == 1, "same").otherwise(F.concat(F.lit("e"), k.cast("string"))).alias("event_id"), F.concat(F.lit("c"), text("o_custkey")).alias("canonical"), (k % 5 != 0).alias("relevant"), k.alias("seq"))
    results = members.groupBy("url").agg(F.max_by(F.struct("level", "score"), F.struct(F.col("level") == "critical", F.col("level") == "important", "score")).alias("r")).select("url", "r.level", "r.score")
    seen = table(spark, d, "customer").where("c_custkey % 6 = 0").select(F.concat(F.lit("url:c"), text("c_custkey")).alias("key"))
    return notifications.notification_candidates(events, members, results, seen)


@query("""with x as (select o_orderkey as e, o_orderdate::date as day, o_orderpriority as type, unnest(list_distinct([o_custkey % 40, o_orderkey % 40])) as actor from orders) select a.e as a, b.e as b, count(*)::bigint as shared from x a join x b using (day, type, actor) where a.e < b.e group by 1, 2""")
def shared_actor_twins(spark: SparkSession, d: str) -> DataFrame:
    """Orders of one day and priority with an actor in common, as pairs."""
    return notifications.shared_actor_pairs(_acting(spark, d))


def _acting(spark: SparkSession, d: str) -> DataFrame:
    actors = F.array(F.col("o_custkey") % 40, F.col("o_orderkey") % 40)
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("event"), F.col("o_orderdate").alias("day"), F.col("o_orderpriority").alias("type"), actors.alias("actors"))


@query("""with o as (select o_orderkey as e, o_orderdate::date as day, o_orderpriority as type, list_sort(list_distinct([o_custkey % 40, o_orderkey % 40])) as actors from orders), x as (select e, day, type, unnest(actors) as actor from o),
p as (select a.e as e, b.e as other, count(*) as shared from x a join x b using (day, type, actor) where a.e <> b.e group by 1, 2), n as (select e, count(*) as links, sum(shared) as shared from p group by e)
select e as event, min(e) over (partition by day, type, actors) as class_id, coalesce(links, 0)::bigint as links, coalesce(shared, 0)::bigint as shared from o left join n using (e)""")
def shared_actor_links(spark: SparkSession, d: str) -> DataFrame:
    """How many orders of its day and priority have an actor in common with each order, with its class of equal sets."""
    return notifications.shared_actor_twins(_acting(spark, d))


@query("""with r as (select user_id as parent, ts::date as day, event_type as text, value > 30 as rich, event_id as seq from events), m as (select *, bool_or(rich) over (partition by parent, day) as has_rich, row_number() over (partition by parent, day order by seq) as n, row_number() over (partition by parent, day, text order by rich desc, seq) as again from r)
select parent, day, text, rich, seq from m where case when has_rich then rich and again = 1 else n = 1 end""")
def sub_event_dedup(spark: SparkSession, d: str) -> DataFrame:
    """Events of each user's day: the rich ones once for each text, or else the first."""
    rows = table(spark, d, "events").select(F.col("user_id").alias("parent"), F.col("ts").cast("date").alias("day"), F.col("event_type").alias("text"), (F.col("value") > 30).alias("rich"), F.col("event_id").alias("seq"))
    return notifications.sub_events(rows)


def _references(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    rows = table(spark, d, "lineitem").select((F.col("l_orderkey") % 200).alias("owner"), F.when(F.col("l_linenumber") % 2 == 0, "event").otherwise("poll").alias("kind"), (F.col("l_partkey") % 500).cast("string").alias("ref"), "l_shipdate")
    early = F.col("l_shipdate") < F.lit("1997-06-01").cast("timestamp_ntz")
    return rows.where(early).drop("l_shipdate"), rows.where(~early).drop("l_shipdate")


@query("""with r as (select l_orderkey % 200 as owner, case when l_linenumber % 2 = 0 then 'event' else 'poll' end as kind, (l_partkey % 500)::varchar as ref, l_shipdate < timestamp '1997-06-01' as early from lineitem), a as (select distinct owner, kind, ref from r where early), b as (select distinct owner, kind, ref from r where not early)
select *, 'added' as change from (select * from b except select * from a) union all select *, case when ref::int % 7 <> 0 then 'removed_still_formal' else 'deleted' end from (select * from a except select * from b)""")
def reference_changes(spark: SparkSession, d: str) -> DataFrame:
    """References that two halves of the order lines have for each owner: added, removed though still there, deleted."""
    before, after = _references(spark, d)
    formal = before.unionByName(after).select("kind", "ref").distinct().where(F.col("ref").cast("int") % 7 != 0)
    return reconcile.reference_changes(before, after, formal)


@query("""with r as (select l_orderkey as owner, l_returnflag as field, (l_suppkey % 30)::varchar as ref from lineitem), t as (select owner, field, ref, count(*) as n from r group by all)
select owner, 'within_field_duplicate' as "check", ref, max(n)::bigint as n from t where n > 1 group by owner, ref union all select owner, 'cross_field_reuse', ref, count(*)::bigint from t group by owner, ref having count(*) > 1
union all select distinct owner, 'missing_id', ref, 1::bigint from t where ref not in (select n_nationkey::varchar from nation)""")
def reference_faults(spark: SparkSession, d: str) -> DataFrame:
    """Ids that an order's lines use twice within a field, in several fields, or that don't exist."""
    refs = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("owner"), F.col("l_returnflag").alias("field"), (F.col("l_suppkey") % 30).cast("string").alias("ref"))
    return reconcile.reference_faults(refs, table(spark, d, "nation").select(F.col("n_nationkey").cast("string").alias("ref")))


def _plans(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    rows = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("plan"), F.col("l_linenumber").alias("claim"), F.col("l_returnflag").alias("section"), "l_partkey", "l_suppkey")
    accepted = rows.where("l_partkey % 10 <> 0")
    rendered = rows.where("l_partkey % 7 <> 0").unionByName(rows.where("l_suppkey % 20 = 0"))
    sections = rows.where("l_partkey % 9 <> 0").withColumn("section", F.when(F.col("l_suppkey") % 25 == 0, "Z").otherwise(F.col("section"))).unionByName(rows.where("l_suppkey % 30 = 0"))
    return accepted.select("plan", "claim", "section"), rendered.select("plan", "claim"), sections.select("plan", "claim", "section")


_PLANS = """r as (select l_orderkey as plan, l_linenumber as claim, l_returnflag as section, l_partkey, l_suppkey from lineitem), own as (select plan, claim, min(section) as target from r where l_partkey % 10 <> 0 group by all),
shown as (select plan, claim, count(*) as n from (select * from r where l_partkey % 7 <> 0 union all select * from r where l_suppkey % 20 = 0) group by all),
placed as (select plan, claim, count(*) as m, list(distinct section) as places from (select plan, claim, case when l_suppkey % 25 = 0 then 'Z' else section end as section from r where l_partkey % 9 <> 0 union all select plan, claim, section from r where l_suppkey % 30 = 0) group by all)"""


@query(f"""with {_PLANS}, j as (select plan, claim, target, coalesce(n, 0) as n, coalesce(m, 0) as m, places from (select distinct plan, claim from r) left join own using (plan, claim) left join shown using (plan, claim) left join placed using (plan, claim))
select plan, claim, f as fault from (select plan, claim, unnest([case when target is not null and n = 0 then 'missing' end, case when target is null and n > 0 then 'unauthorized' end, case when n > 1 then 'rendered_again' end, case when target is not null and m = 0 then 'section_missing' end, case when target is null and m > 0 then 'section_unauthorized' end,
  case when m > 1 then 'section_again' end, case when target is not null and len(list_filter(places, lambda s: s <> target)) > 0 then 'section_mismatch' end]) as f from j) where f is not null""")
def exact_cover_faults(spark: SparkSession, d: str) -> DataFrame:
    """Lines as claims that their order renders, and places in its sections, other than exactly once."""
    return reconcile.exact_cover(*_plans(spark, d))


@query(f"with {_PLANS} select plan, count(*)::bigint as n, count(shown.n)::bigint as covered, count(shown.n) / count(*) as rate from own left join shown using (plan, claim) group by plan")
def claim_coverage_rate(spark: SparkSession, d: str) -> DataFrame:
    """The share of each order's claims that are rendered."""
    accepted, rendered, _ = _plans(spark, d)
    return reconcile.coverage_rate(accepted, rendered)


@query("""with a as (select l_partkey, l_suppkey from lineitem where l_linenumber <= 4), b as (select l_partkey, l_suppkey from lineitem where l_linenumber > 4) select *, 'added' as change from (select distinct * from b except select * from a) union all select *, 'removed' from (select distinct * from a except select * from b)""")
def link_diff(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of part and supplier that only one half of the lines has."""
    lines = table(spark, d, "lineitem")
    return reconcile.link_diff(lines.where("l_linenumber <= 4"), lines.where("l_linenumber > 4"), ["l_partkey", "l_suppkey"])


_ACTIONS = [("first", ("ering", "ement")), ("second", ("tion", "keit")), ("campaign_rally", ("ou",)), ("support", ("er",))]


@query("""with t as (select doc_id as id, coalesce(text, '') as body, left(string_split(coalesce(text, ''), chr(10))[1], 80) as title from documents)
select id, case when contains(title, 'ering') or contains(title, 'ement') then 'first' when contains(title, 'tion') or contains(title, 'keit') then 'second' when contains(title, 'ou') then 'campaign_rally' when contains(title, 'er') then 'support' else '' end as action,
  case when contains(title, 'ering') or contains(title, 'ement') or contains(title, 'tion') or contains(title, 'keit') then case when contains(title, 'ering') or contains(title, 'ement') then 'first' else 'second' end when contains(title, 'ou') then 'campaign' when contains(title, 'er') then 'support' else '' end as family,
  len(regexp_extract_all(body, '[A-Za-z0-9]+(?:[-''][A-Za-z0-9]+)?'))::bigint as n_tokens, length(regexp_replace(body, '[^\\x{4e00}-\\x{9fff}]', '', 'g'))::bigint as n_chinese,
  length(regexp_replace(replace(replace(title, 'the', ''), 'und', ''), '[^0-9A-Za-z\\x{4e00}-\\x{9fff}]', '', 'g')) < 20 as empty_talk from t""")
def title_measures(spark: SparkSession, d: str) -> DataFrame:
    """What each document's title does, by ordered phrases, and measures of its text."""
    body = F.coalesce("text", F.lit(""))
    title = F.substring(F.split(body, "\n", 2)[0], 1, 80)
    found = notifications.canonical_action(title, _ACTIONS)["action"]
    return table(spark, d, "documents").select(
        F.col("doc_id").alias("id"), found.alias("action"), notifications.action_family(found).alias("family"), F.size(T.phrase_tokens(body)).cast("long").alias("n_tokens"), T.chinese_characters(body).cast("long").alias("n_chinese"),
        T.without_information(title, ("the", "und"), 20).alias("empty_talk"))


@query("""with t as (select event_id, ts, event_id % 4 as k from events) select event_id, case k when 0 then date_trunc('second', ts) + interval 8 hour when 1 then date_trunc('second', ts) + interval 6 hour when 2 then date_trunc('second', ts) end as local from t""")
def times_in_zone(spark: SparkSession, d: str) -> DataFrame:
    """Event times written with Z, with +02:00, without an offset, and not as times, as local times of Taipei."""
    k = F.col("event_id") % 4
    plain = F.date_format(F.col("ts"), "yyyy-MM-dd'T'HH:mm:ss")
    written = F.when(k == 0, F.concat(plain, F.lit("Z"))).when(k == 1, F.concat(plain, F.lit("+02:00"))).when(k == 2, plain).otherwise("soon")
    return table(spark, d, "events").select("event_id", times.to_zone(written, "Asia/Taipei", "Asia/Taipei").alias("local"))
