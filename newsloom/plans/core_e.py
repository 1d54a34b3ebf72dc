"""Core queries, part five: documents as articles, their event clusters and assertions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.functions import text as T
from newsloom.operators import assertions, clustering
from newsloom.storage import table

QUERIES, ORACLE = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


#: Terms that stand for actions, entities and event groups in the given texts.
ACTIONS = ("ering", "ement", "keit")
ENTITIES = ("the", "und", "des", "los", "and", "die", "les", "que")
GROUPS = ("by", "that", "ist", "sich", "pour", "par", "con", "una")


def articles(spark: SparkSession, d: str) -> DataFrame:
    """Documents as articles: the first line as title, a publication time from the id, every 50th without one."""
    first = F.substring(F.split(F.coalesce("text", F.lit("")), "\n", 2)[0], 1, 80)
    hours = F.make_dt_interval(hours=(F.col("doc_id") * 7919 % 2160).cast("int"))
    ts = F.when(F.col("doc_id") % 50 != 7, F.lit("2024-01-01").cast("timestamp") + hours)
    action = F.lit("")
    for word in reversed(ACTIONS):
        action = F.when(first.contains(word), word).otherwise(action)
    url = F.when(F.col("doc_id") % 40 == 3, "").otherwise(F.concat(F.lit("https://example.org/"), (F.col("doc_id") - F.when(F.col("doc_id") % 31 == 0, F.col("doc_id") % 100).otherwise(0)).cast("string")))
    return table(spark, d, "documents").select(F.col("doc_id").alias("id"), url.alias("url"), first.alias("title"), F.col("source").alias("actor"), action.alias("action"), F.col("lang").alias("issue"), ts.alias("ts"))


_ARTICLES = """a as (select doc_id as id, left(string_split(coalesce(text, ''), chr(10))[1], 80) as title, source as actor, lang as issue,
  case when doc_id % 50 <> 7 then timestamp '2024-01-01' + to_hours((doc_id * 7919 % 2160)::int) end as ts from documents),
b as (select *, case when contains(title, 'ering') then 'ering' when contains(title, 'ement') then 'ement' when contains(title, 'keit') then 'keit' else '' end as action from a)"""


@query(f"""with {_ARTICLES}, l as (select *, lag(ts) over (partition by actor, action, issue order by ts, id) as before from b where ts is not null),
n as (select *, sum(case when before is null or floor((epoch_us(ts) - epoch_us(before)) / 86400000000) > 7 then 1 else 0 end) over (partition by actor, action, issue order by ts, id) as bucket from l)
select b.id, b.actor, b.action, b.issue, coalesce(n.bucket, 1)::bigint as bucket from b left join n using (id)""")
def date_bucket_clusters(spark: SparkSession, d: str) -> DataFrame:
    """Chained date buckets of every document within source, action and language: seven whole days at most from some member."""
    return clustering.date_islands(articles(spark, d), ["actor", "action", "issue"], "ts", 7).select("id", "actor", "action", "issue", "bucket")


@query()
def layered_event_clusters(spark: SparkSession, d: str) -> DataFrame:
    """Candidate clusters of all documents: by URL, dates, title and shared phrase; an order-dependent pass, held against a sequential one in the tests."""
    return clustering.layered_clusters(articles(spark, d))


def reports(spark: SparkSession, d: str) -> DataFrame:
    """Articles with the sets that decide whether two report the same event."""
    tokens = T.token_set(F.col("title"))
    found = lambda words: F.array_intersect(tokens, F.array(*[F.lit(w) for w in words]))
    a = articles(spark, d).select("id", F.col("id").alias("seq"), "ts", "url", "title", "actor", tokens.alias("tokens"))
    entities = F.filter(F.array(*[F.lit(w) for w in ENTITIES]), lambda w: F.contains(F.lower("title"), w))
    groups = F.filter(F.array(*[F.lit(w) for w in GROUPS]), lambda w: F.contains(F.lower("title"), w))
    return a.select("id", "seq", "ts", "url", "tokens", entities.alias("entities"), groups.alias("groups"), found(("los", "die")).alias("places"), found(ENTITIES + GROUPS).alias("core"), "tokens", F.length("actor").alias("priority")).select(
        "id", "seq", "ts", "url", a["tokens"], "entities", "groups", "places", "core", a["tokens"].alias("names"), "priority")


@query()
def same_event_cliques(spark: SparkSession, d: str) -> DataFrame:
    """Events of all documents: cliques in order of id over the same-event rule, with content ids; held against a sequential pass in the tests."""
    rows = reports(spark, d)
    clusters = clustering.greedy_cliques(rows, "id", "seq", clustering.same_event_edges(rows))
    return clustering.events_of(rows, clusters, "event-v1")


#: Word tables that stand for the markers of news in the given texts.
STAND_INS = assertions.Markers(
    uncertain=("ndern", "tzke"), allegation=("thor", "eauou", "pfver"), denial=("thore", "eauoue"), denying=("thore", "eauoue"), statement=(" by ", " der ", " la ", " en "), media=("erth", "onment"),
    planned=("tion",), observed=("sh", "ich", "oi"), hedges=("or",), connectors=("And", "Und", "Et", "The"), suffixes=("by",), comma=",")
SPEAKERS = ("with", "the", "of", "le", "die", "ist", "de", "el")
ENDS, OPENS, CLOSES = ".;!?,\n", "(“", ")”"


def _named(spark: SparkSession, d: str) -> DataFrame:
    body = F.coalesce("text", F.lit(""))
    parts = F.split(body, "\n", 2)
    return table(spark, d, "documents").select(
        F.col("doc_id").alias("id"), F.substring(parts[0], 1, 80).alias("title"), F.coalesce(F.try_element_at(parts, F.lit(2)), F.lit("")).alias("summary"), F.col("source").alias("subject"),
        F.array(*[F.lit(w) for w in SPEAKERS]).alias("known"))


def _list(words) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


def assertions_sql(m: assertions.Markers) -> str:
    """The rules written as one statement: clauses by running depth, then kinds, then the speaker before."""
    any_ = lambda words: f"len(list_filter({_list(words)}, lambda w: contains(clause, w))) > 0"
    first = lambda words: f"list_filter({_list(words)}, lambda w: contains(clause, w))[1]"
    name = "[\\x{4e00}-\\x{9fff}A-Za-z0-9]"
    before = lambda words: f"coalesce(list_filter(list_transform({_list(words)}, lambda w: regexp_extract(left(clause, greatest(instr(clause, w) - 1, 0)), '({name}{{1,12}})$', 1)), lambda x: x <> '')[1], '')"
    blanks = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(133) || chr(160) || chr(8201) || chr(8232) || chr(12288)"
    sure = " ".join(f"when '{k}' then {v}" for k, v in assertions.CONFIDENCE.items())
    return f"""
with d as (
  select doc_id as id, source as subject, left(string_split(coalesce(text, ''), chr(10))[1], 80) as title, case when contains(coalesce(text, ''), chr(10)) then substr(text, instr(text, chr(10)) + 1) else '' end as summary from documents
), f as (
  select id, 0 as part, title as body from d union all select id, 1, summary from d
), k as (
  select id, part, unnest(regexp_extract_all(body, '[^.;!?,\\n(“)”]+|[.;!?,\\n(“)”]')) as tok, generate_subscripts(regexp_extract_all(body, '[^.;!?,\\n(“)”]+|[.;!?,\\n(“)”]'), 1) as n from f
), s as (
  select *, sum(case when tok in ('(', '“') then 1 when tok in (')', '”') then -1 else 0 end) over (partition by id, part order by n) as depth from k
), e as (
  select *, depth - least(min(depth) over (partition by id, part order by n), 0) = 0 and tok in ('.', ';', '!', '?', ',', chr(10)) as ends from s
), g as (
  select *, sum(ends::int) over (partition by id, part order by n) - ends::int as piece from e
), c as (
  select id, part, piece, trim(coalesce(string_agg(tok, '' order by n) filter (where not ends), ''), {blanks}) as clause from g group by all
), p as (
  select id, subject, title, clause, row_number() over (partition by id order by part, piece) as pos from c join d using (id) where clause <> ''
), x as (
  select *, {any_(m.uncertain)} as uncertain, {first(m.allegation)} as charge, {any_(m.denial)} as denies, regexp_extract(clause, '({name}{{1,12}}?)[：:]', 1) as colon, contains(clause, '：') or contains(clause, ':') as has_colon,
    {first(m.statement)} as verb, {before(sorted(m.statement, key=len, reverse=True))} as named, {before(m.denying)} as denier, len(list_filter({_list(m.connectors)}, lambda w: starts_with(clause, w))) > 0 as linked,
    {any_(m.media)} as media, {any_(m.planned)} as planned, {first(m.observed)} as seen, list_filter({_list(SPEAKERS)}, lambda w: contains(clause, w))[1] as mentioned,
    list_filter({_list(m.denying)}, lambda w: regexp_matches(left(clause, greatest(instr(clause, w) - 1, 0)), '{name}$'))[1] as denied_by from p
), y as (
  select *, case when list_contains({_list(SPEAKERS)}, named) then named else '' end as own, regexp_replace(colon, '({"|".join(m.suffixes)})$', '') as bare from x
), z as (
  select *, case when uncertain then 'uncertain_report' when charge is not null and denies then 'actor_statement' when charge is not null then 'allegation' when colon <> '' then 'actor_statement' when verb is not null and own <> '' then 'actor_statement' end as early,
    case when media then 'media_interpretation' when planned then 'planned_action' when seen is not null then 'observed_fact' end as late,
    case when uncertain then '' when charge is not null and denies then case when colon <> '' then bare else denier end when charge is not null then '' when colon <> '' then bare when verb is not null then own else '' end as own_speaker from y
), u as (
  select *, early is null and verb is not null and linked as may_carry, case when early is not null then nullif(own_speaker, '') when late is not null then mentioned end as sets from z
), v as (
  select *, coalesce(last_value(case when not may_carry then sets end ignore nulls) over before, first_value(case when may_carry then sets end ignore nulls) over before) as prior from u
  window before as (partition by id order by pos rows between unbounded preceding and 1 preceding)
), w as (
  select *, case when may_carry and prior is not null then 'actor_statement' else coalesce(early, late) end as kind, case when may_carry and prior is not null then prior when early is not null then own_speaker else '' end as speaker from v
), a as (
  select *, kind = 'actor_statement' and charge is null and colon = '' as by_verb from w where kind is not null
    and not coalesce(kind = 'actor_statement' and (speaker = '' or (not list_contains({_list(SPEAKERS)}, speaker) and not linked and not has_colon)), false)
), b as (
  select *, case when uncertain then '{m.uncertain_as}' when charge is not null and denies then case when colon <> '' then '{m.denied_as}' when denier <> '' then denied_by else '{m.denied_plain}' end when charge is not null then charge when colon <> '' then '{m.quoted_as}'
    when by_verb then verb when media then '{m.media_as}' when planned then '{m.planned_as}' else seen end as predicate,
    case when by_verb then coalesce(nullif(left(string_split(substr(clause, instr(clause, verb) + length(verb)), '{m.comma}')[1], 80), ''), left(clause, 80)) else clause end as source from a
), t as (
  select id, pos, kind, predicate, speaker, left(case when subject <> '' or predicate <> '' then subject || predicate || left(source, 80) else left(source, 150) end, 200) as text, case when contains(title, clause) then 'title' else 'summary' end as field,
    {any_(m.hedges)} as hedged from b qualify row_number() over (partition by id, kind, text order by pos) = 1
), q as (
  select id, pos - 1 as pos, kind, predicate, speaker, text, field, array_to_string(list_filter([case when kind in ('uncertain_report', 'allegation') then 'unverified' when kind = 'media_interpretation' then 'interpretation' when kind = 'planned_action' then 'future' end, case when hedged then 'hedged' end], lambda x: x is not null), '|') as risks from t
  union all select id, -1, 'unknown', '', '', title, 'title', 'unknown_kind' from d where id not in (select id from t)
)
select id, pos::int as pos, kind, predicate, speaker, text, field, risks, (case kind {sure} end)::double as confidence from q"""


@query(assertions_sql(STAND_INS))
def article_assertions(spark: SparkSession, d: str) -> DataFrame:
    """Every assertion of every document: clauses at quote depth 0, seven kinds by ordered tables, speakers carried on, (kind, text) once."""
    found = assertions.assertions(_named(spark, d), STAND_INS, ENDS, OPENS, CLOSES)
    return found.select("id", "pos", "kind", "predicate", "speaker", "text", "field", F.array_join("risks", "|").alias("risks"), "confidence")


_KINDS = ", ".join(f"(count(*) filter (where kind = '{k}'))::bigint as {k}" for k in sorted(assertions.CONFIDENCE))


@query(f"""with every as ({assertions_sql(STAND_INS)}), n as (select id, {_KINDS} from every group by id), r as (select distinct id, unnest(string_split(risks, '|')) as risk from every)
select n.*, coalesce((select string_agg(risk, '|' order by risk) from r where r.id = n.id and risk <> ''), '') as risks from n""")
def assertion_kinds(spark: SparkSession, d: str) -> DataFrame:
    """Counts of each kind and the risks of every document."""
    return assertions.profile(assertions.assertions(_named(spark, d), STAND_INS, ENDS, OPENS, CLOSES))
