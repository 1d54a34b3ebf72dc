"""Core queries, part eight: decisions with reasons, gates, release rules and golden checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from newsloom.operators import decisions
from newsloom.storage import table

QUERIES, ORACLE = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


WORDS = decisions.Tables(
    direct=("thorou", "keitver"), first=("the ", "der ", "les "), second=("by ", "von ", "par "), pair_first=("and ", "und "), pair_second=("with ", "mit "), cross=("tion", "ung", "ment"), strong=("ung", "ment"), entities=("ering", "onment", "schein"),
    topics=(("first", ("er", "ou")), ("second", ("ll", "ss"))))


def _hits(words: tuple[str, ...]) -> str:
    return "list_filter([" + ", ".join(f"'{w}'" for w in words) + "], lambda w: contains(body, w))"


@query(f"""with t as (select doc_id as id, left(string_split(coalesce(text, ''), chr(10))[1], 80) as title, source, lower(left(string_split(coalesce(text, ''), chr(10))[1], 80) || ' ' || '') as body from documents),
h as (select *, {_hits(WORDS.direct)} as d, {_hits(WORDS.first)} as f, {_hits(WORDS.second)} as s, {_hits(WORDS.pair_first)} as pf, {_hits(WORDS.pair_second)} as ps, {_hits(WORDS.cross)} as c, {_hits(WORDS.entities)} as e,
  list_filter([case when contains(body, 'er') or contains(body, 'ou') then 'first' end, case when contains(body, 'll') or contains(body, 'ss') then 'second' end], lambda x: x is not null) as tp from t),
k as (select *, list_filter(c, lambda w: w in ('ung', 'ment')) as st, case when len(tp) = 0 then 'international' else array_to_string(tp, ',') end as topics from h)
select id, len(d) > 0 or (len(f) > 0 and len(st) > 0) or (len(pf) > 0 and len(ps) > 0) or (len(f) > 0 and len(s) > 0) as relevant,
  case when len(d) > 0 then 'direct' when len(f) > 0 and len(st) > 0 then 'first_party' when len(pf) > 0 and len(ps) > 0 then 'pair' when len(f) > 0 and len(s) > 0 then 'second_party' when len(f) > 0 then 'first_party' when len(s) > 0 then 'second_party' else 'other' end as tier,
  case when len(d) > 0 then 'direct entity or context: ' || array_to_string(d[1:5], ', ') || '; topics=' || topics when len(f) > 0 and len(st) > 0 then 'first party with context: ' || array_to_string(st[1:5], ', ') || '; topics=' || topics
    when len(pf) > 0 and len(ps) > 0 then 'relation: ' || array_to_string(pf[1:5], ', ') || ' and ' || array_to_string(ps[1:5], ', ') || '; topics=' || topics when len(f) > 0 and len(s) > 0 then 'second party linked to first: ' || array_to_string(s[1:5], ', ') || '; topics=' || topics
    when len(f) > 0 then 'first party without context' when len(s) > 0 then 'second party without context' else 'no relation' end as reason,
  array_to_string(list_concat(d, list_concat(f, list_concat(s, list_concat(pf, list_concat(ps, c))))), '|') as keywords, array_to_string(e, '|') as entities, sha256(title || chr(31) || '' || chr(31) || source) as input_hash from k""")
def relevance_decisions(spark: SparkSession, d: str) -> DataFrame:
    """Whether each document's title is relevant, by which rule and words, with entities, topics and a hash of what was looked at."""
    title = F.substring(F.split(F.coalesce("text", F.lit("")), "\n", 2)[0], 1, 80)
    found = decisions.relevance_decision(title, F.lit(""), F.col("source"), WORDS)
    return table(spark, d, "documents").select(F.col("doc_id").alias("id"), found.alias("r")).select("id", "r.relevant", "r.tier", "r.reason", F.array_join("r.keywords", "|").alias("keywords"), F.array_join("r.entities", "|").alias("entities"), "r.input_hash")


@query("""with e as (select doc_id as id, doc_id % 3 = 0 as region, case when doc_id % 4 = 0 then [source] else [] end as actors, doc_id % 5 < 2 as election, case when contains(text, 'ering') then 'ering' else '' end as phrase, doc_id % 7 = 0 as action, contains(text, 'ment') as statement, doc_id % 11 = 0 as media,
  doc_id % 13 = 0 as uncertain, lang = 'de' as national, doc_id % 17 = 0 as other_race, doc_id % 19 = 0 as internal, trim(coalesce(text, '')) = '' as empty, coalesce(contains(text, 'license'), false) as broken from documents),
f as (select id, region, actors, election, coalesce(phrase, '') as phrase, coalesce(action, false) or coalesce(phrase, '') <> '' as acts, coalesce(statement, false) as statement, media, uncertain, national, other_race, internal, empty, broken, len(actors) > 0 as people, region or len(actors) > 0 as near, not national and not other_race as clean from e),
r as (select *, case when empty then 'collection_error:no_valid_text' when broken then 'collection_error:collection_error_marker' when other_race and not near then 'irrelevant:other_race_elsewhere' when uncertain then 'contextual:uncertain_report_not_direct'
  when near and statement and election and clean then 'direct_statement:actor_region_statement_election' when region and acts and not national then 'direct_event:region_plus_direct_action' when people and acts and clean then 'direct_event:actor_plus_direct_action'
  when near and (not clean or internal or media or not (phrase <> '' or statement)) then 'contextual:related_but_not_direct' when people and statement and not election then 'contextual:statement_without_election_context' when election and national then 'contextual:election_background_national' else 'irrelevant:no_direct_relation' end as v from f)
select id, split_part(v, ':', 1) as label, array_to_string(list_filter([case when region then 'region_evidence' end, case when election then 'election_evidence' end, case when people then 'actor_evidence:' || actors[1] end, case when phrase <> '' then 'action_evidence:' || phrase end, case when national then 'negative_evidence:national_topic' end,
  case when other_race then 'negative_evidence:other_race' end, case when internal then 'negative_evidence:party_internal' end, split_part(v, ':', 2)], lambda x: x is not null), '|') as reasons from r""")
def relevance_labels(spark: SparkSession, d: str) -> DataFrame:
    """Five-way label of each document with all reasons for it."""
    k = F.col("doc_id")
    evidence = {
        "region": k % 3 == 0, "actors": F.when(k % 4 == 0, F.array("source")), "election": k % 5 < 2, "phrase": F.when(F.contains(F.col("text"), F.lit("ering")), "ering"), "action": k % 7 == 0, "statement": F.contains(F.col("text"), F.lit("ment")), "media": k % 11 == 0,
        "uncertain": k % 13 == 0, "national": F.col("lang") == "de", "other_race": k % 17 == 0, "internal": k % 19 == 0, "empty": F.trim(F.coalesce("text", F.lit(""))) == "", "broken": F.contains(F.col("text"), F.lit("license")),
    }
    return table(spark, d, "documents").select(k.alias("id"), decisions.relevance_label(evidence).alias("r")).select("id", "r.label", F.array_join("r.reasons", "|").alias("reasons"))


_POLICY = {"risk": ("low",), "label": ("direct_event",), "forbidden_basis": ("unknown", "inferred_from_publication"), "source_status": ("exact", "normalized_match")}


@query("""with c as (select o_orderkey as id, case when o_orderkey % 3 = 0 then 'high' else 'low' end as risk, case when o_orderkey % 4 = 0 then 'contextual' else 'direct_event' end as label, case when o_orderkey % 29 <> 0 then o_orderdate end as dt, case o_orderkey % 5 when 0 then 'unknown' when 1 then null else 'explicit_in_title' end as basis,
  o_orderkey % 31 = 0 as vague, case when o_orderkey % 37 = 0 then 'unknown' else 'poll' end as type, o_orderkey % 7 <> 0 as valid, case when o_orderkey % 11 = 0 then 'possible' else 'no_match' end as dup, case when o_orderkey % 13 = 0 then 'published' end as review, o_custkey as key from orders),
f as (select distinct l_orderkey from lineitem where l_returnflag = 'R'), s as (select l_orderkey, count(*) filter (where not (l_linenumber <> 7 and l_suppkey % 50 <> 0)) as bad from lineitem group by 1), a as (select distinct l_orderkey from lineitem where l_partkey % 97 = 0),
g as (select id, list_filter([case when risk <> 'low' then 'risk_level_low' end, case when label <> 'direct_event' then 'relevance_direct_event' end, case when f.l_orderkey is null then 'has_observed_fact' end, case when dt is null or coalesce(basis, '') = 'unknown' or vague then 'date_explicit' end, case when type = 'unknown' then 'event_type_known' end,
  case when not valid then 'validation_ready' end, case when dup <> 'no_match' then 'duplicate_status_no_match' end, case when key % 41 = 0 then 'duplicate_recheck_clean' end, case when bad is null or bad > 0 then 'sources_resolved' end, case when review = 'published' then 'no_terminal_status' end, case when a.l_orderkey is not null then 'no_approve_decision' end], lambda x: x is not null) as r
  from c left join f on f.l_orderkey = id left join s on s.l_orderkey = id left join a on a.l_orderkey = id)
select id, case when len(r) = 0 then 'eligible' else 'rejected' end as decision, array_to_string(r, '|') as reasons from g""")
def publication_gates(spark: SparkSession, d: str) -> DataFrame:
    """Every order as a candidate against all eleven gates of publication, with those that it fails."""
    k, lines = F.col("o_orderkey"), table(spark, d, "lineitem")
    candidates = table(spark, d, "orders").select(
        k.alias("id"), F.when(k % 3 == 0, "high").otherwise("low").alias("risk"), F.when(k % 4 == 0, "contextual").otherwise("direct_event").alias("label"), F.when(k % 29 != 0, F.col("o_orderdate")).alias("date"),
        F.when(k % 5 == 0, "unknown").when(k % 5 == 1, None).otherwise("explicit_in_title").alias("basis"), F.when(k % 31 == 0, "unknown").otherwise("day").alias("precision"), F.lit("high").alias("confidence"), F.when(k % 37 == 0, "unknown").otherwise("poll").alias("type"),
        (k % 7 != 0).alias("valid"), F.when(k % 11 == 0, "possible").otherwise("no_match").alias("duplicate"), F.when(k % 13 == 0, "published").alias("review"), F.col("o_custkey").alias("key"))
    facts = lines.where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("id"))
    sources = lines.select(F.col("l_orderkey").alias("id"), F.when(F.col("l_linenumber") != 7, F.col("l_suppkey").cast("string")).alias("formal"), F.when(F.col("l_suppkey") % 50 != 0, "exact").alias("status"))
    approved = lines.where("l_partkey % 97 = 0").select(F.col("l_orderkey").alias("id"), F.lit("approve").alias("decision"))
    formal = table(spark, d, "customer").where("c_custkey % 41 = 0").select(F.col("c_custkey").alias("key"))
    return decisions.publication_gates(candidates, facts, sources, approved, formal, _POLICY).select("id", "decision", F.array_join("reasons", "|").alias("reasons"))


@query("""with r as (select distinct l_orderkey from lineitem where l_partkey % 50 = 0) select o_orderkey as poll_id, case when (o_orderdate::date between date '1996-01-01' and date '1996-01-15') or (o_orderdate::date + 10 between date '1996-01-01' and date '1996-01-15') then 'period' else 'context' end as role
from orders left join r on l_orderkey = o_orderkey where l_orderkey is not null or (o_orderdate::date between date '1996-01-01' and date '1996-01-15') or (o_orderdate::date + 10 between date '1996-01-01' and date '1996-01-15')""")
def poll_inclusion(spark: SparkSession, d: str) -> DataFrame:
    """Orders as polls: those of a half month, and those that lines of some parts refer to."""
    day = F.col("o_orderdate").cast("date")
    polls = table(spark, d, "orders").select(F.col("o_orderkey").alias("poll_id"), day.alias("release"), F.date_add(day, 10).alias("field_end"))
    refs = table(spark, d, "lineitem").where("l_partkey % 50 = 0").select(F.col("l_orderkey").alias("poll_id"))
    return decisions.poll_inclusion(polls, refs, F.lit("1996-01-01").cast("date"), F.lit("1996-01-15").cast("date")).select("poll_id", "role")


@query("""with e as (select case when p_partkey % 53 = 0 then '' when p_partkey % 51 = 0 then 'twice' else p_partkey::varchar end as event_id, case when p_partkey % 7 = 0 then 'X' else 'E' end as el, p_type as type, case when p_partkey % 11 = 0 then 'rumour' else 'confirmed' end as st, p_name as title, p_name || ' ' || p_brand as summary,
  case when p_partkey % 13 = 0 then '2024-13-40' when p_partkey % 17 = 0 then null else '2024-02-03T10:00:00' end as occ, case when p_partkey % 19 = 0 then '' when p_partkey % 23 = 0 then 'date_conflict_hold' else 'explicit' end as basis, p_partkey % 29 = 0 as nodate, p_partkey % 31 = 0 as claim, p_partkey % 3 = 0 as limited, p_partkey as k, p_size from part)
select event_id, 'error' as severity, 'event_id_present' as "check", '' as detail from e where event_id = '' union all select event_id, 'error', 'election_id_valid', '' from e where el = 'X' union all select event_id, 'error', 'event_type_valid', '' from e where type not in ('ECONOMY', 'SMALL', 'LARGE')
union all select event_id, 'error', 'event_type_unrestricted', '' from e where type = 'LARGE' union all select event_id, 'error', 'fact_status_valid', '' from e where st = 'rumour' union all select event_id, 'error', 'claims_not_in_summary', '' from e where claim
union all select event_id, 'error', 'occurred_valid', '' from e where try_cast(occ as timestamp) is null union all select event_id, 'error', 'date_basis_present', '' from e where basis = '' union all select event_id, 'error', 'date_sources_present', '' from e where nodate union all select event_id, 'error', 'no_date_conflict', '' from e where basis = 'date_conflict_hold'
union all select event_id, 'warning', 'limits_present', '' from e where not limited and not claim union all select event_id, 'error', 'title_phrase', w from e, (values ('ring'), ('red')) as t(w) where contains(title, w) union all select event_id, 'error', 'event_id_unique', count(*)::varchar from e where event_id <> '' group by event_id having count(*) > 1
union all select event_id, 'error', 'sources_resolve', (k % 150)::varchar from e where (k % 150)::varchar not in (select s_suppkey::varchar from supplier) union all select event_id, 'error', 'actors_valid', p_size::varchar from e where p_size not in (select n_nationkey from nation)
union all select distinct event_id, 'error', 'event_is_new', '' from e where event_id in (select l_partkey::varchar from lineitem where l_linenumber = 7)""")
def release_issues(spark: SparkSession, d: str) -> DataFrame:
    """What keeps events, made from every part, from being released: a row for each fault, by check and severity."""
    k, none = F.col("p_partkey"), F.array().cast("array<string>")
    text = lambda c: c.cast("string")
    events = table(spark, d, "part").select(
        F.when(k % 53 == 0, "").when(k % 51 == 0, "twice").otherwise(text(k)).alias("event_id"), F.when(k % 7 == 0, "X").otherwise("E").alias("election_id"), F.col("p_type").alias("type"), F.when(k % 11 == 0, "rumour").otherwise("confirmed").alias("status"), F.col("p_name").alias("title"),
        F.concat_ws(" ", "p_name", "p_brand").alias("summary"), F.when(k % 13 == 0, "2024-13-40").when(k % 17 == 0, None).otherwise("2024-02-03T10:00:00").alias("occurred"), F.when(k % 19 == 0, "").when(k % 23 == 0, "date_conflict_hold").otherwise("explicit").alias("basis"),
        F.when(k % 29 != 0, F.array(F.lit("s"))).alias("date_sources"), F.array(text(k % 150)).alias("source_ids"), F.array(text(F.col("p_size"))).alias("actors"), F.when(k % 31 == 0, F.array("p_brand")).otherwise(none).alias("claims"), none.alias("readings"),
        F.when(k % 3 == 0, F.array(F.lit("l"))).alias("limits"), F.lit("").alias("significance"))
    ids = lambda t, c: table(spark, d, t).select(text(F.col(c)).alias("id"))
    existing = table(spark, d, "lineitem").where("l_linenumber = 7").select(text(F.col("l_partkey")).alias("id"))
    return decisions.release_issues(events, existing, ids("supplier", "s_suppkey"), ids("nation", "n_nationkey"), "E", ("ECONOMY", "SMALL", "LARGE"), ("LARGE",), ("confirmed",), ("ring", "red"))


@query("select distinct o_orderkey as snapshot, l_partkey as event from orders join lineitem on l_orderkey = o_orderkey join (select l_partkey as p, max(l_shipdate) as latest from lineitem where l_linenumber = 1 group by 1) on p = l_partkey where latest > o_orderdate")
def snapshots_before_events(spark: SparkSession, d: str) -> DataFrame:
    """Orders as snapshots that rest on events, the last first-line shipment of their parts, that came later."""
    lines = table(spark, d, "lineitem")
    events = lines.where("l_linenumber = 1").groupBy(F.col("l_partkey").alias("event")).agg(F.max("l_shipdate").alias("occurred"))
    used = lines.groupBy("l_orderkey").agg(F.collect_set("l_partkey").alias("event_ids"))  # the lines of one order
    snapshots = table(spark, d, "orders").join(used, F.col("o_orderkey") == F.col("l_orderkey")).select(F.col("o_orderkey").alias("snapshot"), F.col("o_orderdate").alias("as_of"), "event_ids")
    return decisions.snapshots_before_events(snapshots, events)


@query("""with r as (select p_type as query, p_partkey as item, row_number() over (partition by p_type order by p_retailprice desc, p_partkey) as rank from part), g as (select * from (values ('include', 7), ('exclude', 7), ('first', 7), ('before', 7), ('most', 7)) as t(kind, x)),
k as (select p_type as query, kind, p_partkey as item, p_partkey + 1 as other, 300 as most from part, g where p_partkey % 9 = 0)
select k.query, kind, k.item, coalesce(case kind when 'include' then a.rank is not null when 'exclude' then a.rank is null when 'first' then a.rank = 1 when 'before' then a.rank < b.rank when 'most' then coalesce(n, 0) <= 300 end, false) as ok
from k left join r a on a.query = k.query and a.item = k.item and a.rank <= 200 left join r b on b.query = k.query and b.item = k.other and b.rank <= 200 left join (select query, count(*) as n from r where rank <= 200 group by 1) s on s.query = k.query""")
def golden_search(spark: SparkSession, d: str) -> DataFrame:
    """Golden rules about searches by type: each ninth part in, out, first, before the next, and the number of results."""
    best = W.partitionBy("p_type").orderBy(F.desc("p_retailprice"), "p_partkey")
    ranks = table(spark, d, "part").select(F.col("p_type").alias("query"), F.col("p_partkey").alias("item"), F.row_number().over(best).alias("rank")).where("rank <= 200")
    kinds = F.explode(F.array(*[F.lit(x) for x in ("include", "exclude", "first", "before", "most")]))
    golden = table(spark, d, "part").where("p_partkey % 9 = 0").select(F.col("p_type").alias("query"), kinds.alias("kind"), F.col("p_partkey").alias("item"), (F.col("p_partkey") + 1).alias("other"), F.lit(300).alias("most"))
    return decisions.golden_search(ranks, golden)


@query("""with p as (select quality::varchar as e, case when text is null or length(text) < 300 then null else (length(text) > 800)::int::varchar end as g from labels left join documents using (doc_id)), c as (select count(*)::bigint as n, (count(*) filter (where g is null))::bigint as missing, (count(*) filter (where e = g))::bigint as agreed from p where e is not null)
select *, case when n = 0 then 0 else agreed / n end as agreement, case when n - missing = 0 then 0 else agreed / (n - missing) end as precision, case when n = 0 then 0 else agreed / n end as recall from c""")
def adjudication_rates(spark: SparkSession, d: str) -> DataFrame:
    """Agreement, precision and recall of a length rule with the quality labels; errors count on both sides."""
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.length("text").alias("n"))
    pairs = table(spark, d, "labels").join(docs, F.col("doc_id") == F.col("id"), "left").select(F.col("quality").cast("string").alias("expected"), F.when(F.col("n") >= 300, (F.col("n") > 800).cast("int").cast("string")).alias("predicted"))
    return decisions.adjudication(pairs)
