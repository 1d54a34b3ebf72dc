"""Core queries, part six: grounding, names, JSON, chains and many distributions in one pass."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from newsloom.operators import chains, distributions, documents, grounding, resolution
from newsloom.storage import scratch, table
from newsloom.streaming import sinks

QUERIES, ORACLE = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def _claims(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Orders as claims that cite parts as events, suppliers as sources and nations as gaps."""
    text = lambda c: F.col(c).cast("string")
    orders, lines, parts = table(spark, d, "orders"), table(spark, d, "lineitem"), table(spark, d, "part")
    claims = orders.select(text("o_orderkey").alias("claim"), F.concat_ws(" ", F.lit("size"), (F.col("o_orderkey") % 50).cast("string"), F.lit("on"), text("o_orderdate").substr(1, 10)).alias("text"))
    one = lines.select(text("l_orderkey").alias("claim"), F.lit("event").alias("kind"), text("l_partkey").alias("ref")).where("l_linenumber <= 3")
    two = lines.where("l_linenumber % 2 = 0").select(text("l_orderkey").alias("claim"), F.lit("source").alias("kind"), text("l_suppkey").alias("ref"))
    three = lines.where("l_linenumber = 4").select(text("l_orderkey").alias("claim"), F.lit("gap").alias("kind"), (F.col("l_orderkey") % 100).cast("string").alias("ref"))
    none = F.array().cast("array<string>")
    day = F.date_add(F.lit("1995-01-01").cast("date"), (F.col("p_partkey") % 365).cast("int")).cast("string")
    evidence = (
        parts.where("p_size > 3").select(F.lit("event").alias("kind"), text("p_partkey").alias("id"), F.concat_ws(" ", "p_name", F.lit("size"), text("p_size")).alias("text"), F.array(day).alias("dates"))
        .unionByName(table(spark, d, "supplier").select(F.lit("source").alias("kind"), text("s_suppkey").alias("id"), F.col("s_name").alias("text"), none.alias("dates")))
        .unionByName(table(spark, d, "nation").select(F.lit("gap").alias("kind"), text("n_nationkey").alias("id"), F.col("n_name").alias("text"), none.alias("dates")))
    )
    links = lines.where("l_linenumber <> 2").select(F.lit("event").alias("kind"), text("l_partkey").alias("id"), text("l_suppkey").alias("source"))
    return claims, one.unionByName(two).unionByName(three), evidence, links


_CLAIMS = """claims as (select o_orderkey::varchar as claim, 'size ' || (o_orderkey % 50) || ' on ' || left(o_orderdate::varchar, 10) as text from orders),
cited as (select distinct l_orderkey::varchar as claim, 'event' as kind, l_partkey::varchar as ref from lineitem where l_linenumber <= 3
  union select l_orderkey::varchar, 'source', l_suppkey::varchar from lineitem where l_linenumber % 2 = 0 union select l_orderkey::varchar, 'gap', (l_orderkey % 100)::varchar from lineitem where l_linenumber = 4),
evidence as (select 'event' as kind, p_partkey::varchar as id, p_name || ' size ' || p_size as body, (date '1995-01-01' + (p_partkey % 365)::int)::varchar as day from part where p_size > 3
  union all select 'source', s_suppkey::varchar, s_name, null from supplier union all select 'gap', n_nationkey::varchar, n_name, null from nation),
links as (select distinct l_partkey::varchar as id, l_suppkey::varchar as source from lineitem where l_linenumber <> 2),
items as (select * from cited where kind = 'event'), sources as (select claim, ref as source from cited where kind = 'source'),
tied as (select claim, ref, source from items join links on ref = id join sources using (claim, source)),
bodies as (select claim, body, day from cited join evidence on cited.kind = evidence.kind and ref = id),
numbers as (select distinct claim, unnest(regexp_extract_all(text, '\\d[\\d,]*(?:\\.\\d+)?%?')) as v from claims),
days as (select distinct claim, unnest(regexp_extract_all(text, '\\d{4}-\\d{2}-\\d{2}')) as v from claims)"""


@query(f"""with {_CLAIMS}
select claim, 'unknown_' || kind as issue, ref as detail from cited c where not exists (select 1 from evidence e where e.kind = c.kind and e.id = c.ref)
union all select distinct claim, 'missing_source', '' from items where claim not in (select claim from sources)
union all select claim, 'item_without_source', 'event:' || ref from items where claim in (select claim from sources) and (claim, ref) not in (select claim, ref from tied)
union all select claim, 'source_without_item', source from sources where claim in (select claim from items) and (claim, source) not in (select claim, source from tied)
union all select claim, 'number_not_in_evidence', v from numbers n where not exists (select 1 from bodies b where b.claim = n.claim and (contains(body, v) or contains(body, replace(v, ',', ''))))
union all select claim, 'date_not_in_evidence', v from days n where v <> '1995-06-17' and not exists (select 1 from bodies b where b.claim = n.claim and b.day = v)""")
def claim_issues(spark: SparkSession, d: str) -> DataFrame:
    """What isn't grounded in any order's citations: unknown ids, unrelated pairs, numbers and dates, a row each."""
    return grounding.issues(*_claims(spark, d), days=("1995-06-17",))


@query("""with cited as (select distinct l_orderkey as claim, 'event' as kind, l_partkey::varchar as ref from lineitem where l_linenumber <= 3
  union select l_orderkey, 'source', l_suppkey::varchar from lineitem where l_linenumber % 2 = 0 union select l_orderkey, 'gap', (l_orderkey % 100)::varchar from lineitem where l_linenumber = 4)
select kind, ref, count(distinct claim)::bigint as n from cited group by all having count(distinct claim) > 1""")
def evidence_reuse(spark: SparkSession, d: str) -> DataFrame:
    """Evidence that several claims cite."""
    return grounding.evidence_reuse(_claims(spark, d)[1])


@query("""with a as (select distinct item_id as a, unnest(regexp_extract_all(lower(text), '[a-zà-ÿ]+')) as w from benchmark), b as (select distinct doc_id as b, unnest(regexp_extract_all(lower(text), '[a-zà-ÿ]+')) as w from documents),
na as (select a, count(*) as n from a group by 1), nb as (select b, count(*) as n from b group by 1)
select a, b, count(*)::bigint as common, least(na.n, nb.n)::bigint as smaller from a join b using (w) join na using (a) join nb using (b) group by a, b, na.n, nb.n having 100 * count(*) >= 55 * least(na.n, nb.n)""")
def evidence_overlap(spark: SparkSession, d: str) -> DataFrame:
    """Benchmark items and documents of which one has 55 % of the other's words, whichever has fewer."""
    words = lambda t, key: table(spark, d, t).select(F.col(key).alias("id"), F.regexp_extract_all(F.lower("text"), F.lit("[a-zà-ÿ]+"), F.lit(0)).alias("tokens"))
    return grounding.overlap_pairs(words("benchmark", "item_id"), words("documents", "doc_id"), 55)


@query()
def source_resolution_cascade(spark: SparkSession, d: str) -> DataFrame:
    """Customers' garbled part names against all part names: domain, name, alias, suffix, then matching blocks; a ratio that SQL hasn't, held against a nested loop in the tests."""
    parts, kind = table(spark, d, "part"), F.col("c_custkey") % 7
    known = parts.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.when(F.col("p_partkey") % 100 == 0, F.concat(F.lit("host"), F.col("p_partkey").cast("string"))).alias("domain"))
    garbled = (
        F.when(kind == 1, F.expr("left(p_name, length(p_name) - 1)")).when(kind == 2, F.upper("p_name")).when(kind == 3, F.concat("p_name", F.lit(" Ltd"))).when(kind == 4, F.concat(F.expr("left(p_name, 4)"), F.lit("x"), F.expr("substr(p_name, 5)")))
        .when(kind == 5, F.reverse("p_name")).otherwise(F.col("p_name"))
    )
    rows = table(spark, d, "customer").join(parts, F.col("c_custkey") == F.col("p_partkey"), "left").select(
        F.col("c_custkey").alias("id"), garbled.alias("name"), F.when(F.col("c_custkey") % 200 == 0, F.concat(F.lit("host"), F.col("c_custkey").cast("string"))).alias("domain"))
    return resolution.resolve_sources(rows, known, {"RED WIDGET": "red widget"}, (" Ltd",)).withColumn("ratio", F.round("ratio", 6))


@query("""with n as (select distinct array_to_string(string_split(text, ' ')[1:3], ' ') as name from benchmark), m as (select doc_id as id, name, text from documents join n on contains(text, name))
select id, name, len(list_filter(range(1, length(text) - length(name) + 2), lambda i: substr(text, i, length(name)) = name))::bigint as n from m""")
def names_in_documents(spark: SparkSession, d: str) -> DataFrame:
    """How often the first words of each benchmark item stand in each document, one automaton for all."""
    names = table(spark, d, "benchmark").select(F.array_join(F.slice(F.split("text", " "), 1, 3), " ").alias("name"))
    return resolution.names_in_texts(table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text"), names)


def _states(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Each event's state as a JSON document, before (the user's last event) and after."""
    note = F.when(F.col("value") < 10, F.lit('""')).when(F.col("value") < 25, "null").otherwise('"x"')
    extra = F.when(F.col("value") > 60, F.lit(',"extra":{"high":[1,{"a":[]}]}')).otherwise("")
    tags = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit('["'), "event_type", F.lit('","all"]'))).otherwise(F.concat(F.lit('["all","'), "event_type", F.lit('"]')))
    doc = F.concat(F.lit('{"checked_at":'), F.col("event_id").cast("string"), F.lit(',"state":{"type":"'), "event_type", F.lit('","props":'), "props", F.lit(',"note":'), note, extra, F.lit('},"tags":'), tags, F.lit("}"))
    e = table(spark, d, "events").select("event_id", doc.alias("doc"), F.lag(doc).over(W.partitionBy("user_id").orderBy("ts", "event_id")).alias("earlier"))
    pairs = e.where("earlier is not null")
    return pairs.select("event_id", F.col("earlier").alias("doc")), pairs.select("event_id", "doc")


@query("""with e as (select event_id, event_type as t, props as p, case when value < 25 then '' else 'x' end as note, value > 60 as extra, lag(event_id) over w as before, lag(event_type) over w as t0, lag(props) over w as p0,
  lag(case when value < 25 then '' else 'x' end) over w as note0, lag(value > 60) over w as extra0 from events window w as (partition by user_id order by ts, event_id)), q as (select * from e where before is not null)
select event_id as id, 'state.type' as path, 'changed' as change from q where t <> t0 union all select event_id, 'tags', 'changed' from q where t <> t0 union all select event_id, 'state.props.k', 'changed' from q where p <> p0
union all select event_id, 'state.note', 'changed' from q where note <> note0 union all select event_id, 'state.extra', case when extra then 'added' else 'removed' end from q where extra <> extra0""")
def json_state_diff(spark: SparkSession, d: str) -> DataFrame:
    """Paths at which each event's state differs from the one before: JSON of any depth, lists as sets, null as '', a metadata key left out."""
    return documents.path_diff(*_states(spark, d), "event_id", "doc", ("checked_at",))


@query("""with h as (select event_type as t, props as p, case when value < 25 then '' else 'x' end as note, value > 60 as extra, lag(event_id) over (partition by user_id order by ts, event_id) as before from events)
select count(*)::bigint as n_documents, count(distinct (t, p, note, extra))::bigint as n_states from h where before is not null""")
def json_canonical_states(spark: SparkSession, d: str) -> DataFrame:
    """How many different states the events' documents have, by the hash of their canonical form."""
    hashes = documents.canonical_hash(_states(spark, d)[1], "event_id", "doc", ("checked_at",))
    return hashes.agg(F.count("*").alias("n_documents"), F.countDistinct("hash").alias("n_states"))


@query("""with t as (select event_id, event_id % 6 as kind, event_type as t, props as p from events)
select event_id, case kind when 0 then p when 1 then p when 2 then p when 3 then '{"a": ' || p || ', "s": "}"}' end as value,
  case kind when 0 then '' when 1 then 'trimmed_outer_whitespace' when 2 then 'unwrapped_single_json_fence' when 3 then 'extracted_unique_json_object' when 4 then 'objects:2' else 'objects:0' end as steps from t""")
def json_from_text(spark: SparkSession, d: str) -> DataFrame:
    """The one JSON object in answers made from every event: bare, padded, fenced, among words, twice, broken."""
    kind, p = F.col("event_id") % 6, F.col("props")
    text = (
        F.when(kind == 0, p).when(kind == 1, F.concat(F.lit("\n "), p, F.lit(" "))).when(kind == 2, F.concat(F.lit("```json\n"), p, F.lit("\n```")))
        .when(kind == 3, F.concat(F.lit('The "answer" is {"a": '), p, F.lit(', "s": "}"} as {'), "event_type", F.lit("}"))).when(kind == 4, F.concat(p, F.lit(" or "), p)).otherwise(F.concat(F.lit("{"), p))
    )
    found = documents.json_in_text(text)
    return table(spark, d, "events").select("event_id", found.alias("o")).select("event_id", "o.value", "o.steps")


def _versions(spark: SparkSession, d: str) -> DataFrame:
    """Orders as versions: most are superseded by the customer's next order, some by one that doesn't exist, some in cycles of two."""
    by = W.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    following = F.when(F.col("o_orderkey") % 11 == 0, None).when(F.col("o_orderkey") % 13 == 0, -F.col("o_orderkey")).when((F.col("o_orderkey") % 7 == 0) & F.lag("o_orderkey").over(by).isNotNull(), F.lag("o_orderkey").over(by)).otherwise(F.lead("o_orderkey").over(by))
    return table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderdate", following.alias("superseded_by"), (F.col("o_orderkey") % 3 == 0).alias("active"))


_VERSIONS = """v as (select o_orderkey, o_custkey, o_orderdate, case when o_orderkey % 11 = 0 then null when o_orderkey % 13 = 0 then -o_orderkey when o_orderkey % 7 = 0 and lag(o_orderkey) over w is not null then lag(o_orderkey) over w else lead(o_orderkey) over w end as nxt,
  o_orderkey % 3 = 0 as active from orders window w as (partition by o_custkey order by o_orderdate, o_orderkey)),
walk as (select o_orderkey as k, o_orderkey as spot, 0 as hops, [o_orderkey] as seen, false as looped, false as missing from v
  union all select k, v.nxt, hops + 1, list_append(seen, v.nxt), list_contains(seen, v.nxt), not exists (select 1 from v x where x.o_orderkey = v.nxt) from walk join v on v.o_orderkey = walk.spot where v.nxt is not null and not looped and not missing),
ends as (select k, arg_max(spot, hops) as final, max(hops) as hops, bool_or(looped) as looped, bool_or(missing) as missing from walk group by k)"""


@query(f"""with recursive {_VERSIONS} select k as o_orderkey, case when not looped then final end as last, case when not looped then hops end::bigint as hops, case when looped then 'cycle' when missing then 'missing' else 'end' end as state from ends""")
def superseded_chain_ends(spark: SparkSession, d: str) -> DataFrame:
    """Where each order's chain of superseding orders ends: by doubling, with cycles and missing ends named."""
    return chains.chain_ends(_versions(spark, d), "o_orderkey", "superseded_by")


@query(f"""with recursive {_VERSIONS}, cur as (select o_custkey, max((o_orderdate, o_orderkey)) as now from v where active group by 1),
p as (select c.o_custkey, max(case when e.final = c.now[2] and not e.looped and not e.missing and e.hops > 0 then (v.o_orderdate, v.o_orderkey) end) as chain, max(case when v.o_orderdate < c.now[1] then (v.o_orderdate, v.o_orderkey) end) as older
  from cur c left join v on v.o_custkey = c.o_custkey and v.o_orderkey <> c.now[2] left join ends e on e.k = v.o_orderkey group by 1)
select o_custkey, now[2] as current, coalesce(chain[2], older[2]) as previous, case when chain is not null then 'superseded' when older is not null then 'created' else 'none' end as basis from cur join p using (o_custkey)""")
def previous_versions(spark: SparkSession, d: str) -> DataFrame:
    """The version before each customer's active order: along the chain it superseded, else by date."""
    v = _versions(spark, d)
    return chains.previous_version(v, "o_custkey", "o_orderkey", "o_orderdate", "superseded_by", v["active"])


@query("""with o as (select *, case when o_orderstatus = 'O' then 'pending' else 'done' end as status from orders), n as (select o_custkey, o_orderpriority, max((o_orderdate, o_orderkey)) as m from o where status = 'pending' group by all)
select o_orderkey, case when status = 'pending' and m[2] <> o_orderkey then 'superseded' else status end as status, case when status = 'pending' and m[2] <> o_orderkey then m[2] end as superseded_by from o left join n using (o_custkey, o_orderpriority)""")
def superseded_triggers(spark: SparkSession, d: str) -> DataFrame:
    """Of a customer's pending orders of one priority only the newest stays pending."""
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderpriority", "o_orderdate", F.when(F.col("o_orderstatus") == "O", "pending").otherwise("done").alias("status"))
    return chains.supersede(o, ["o_custkey", "o_orderpriority"], "o_orderkey", "o_orderdate", "status").select("o_orderkey", "status", "superseded_by")


_DIMENSIONS = """e as (select doc_id, 'source' as dimension, source as value from documents union all select doc_id, 'lang', lang from documents
  union all select distinct doc_id, 'people', unnest(regexp_extract_all(coalesce(text, ''), '[A-Z][a-z]{7,}')) from documents union all select doc_id, 'issues', i from documents, (values ('ering'), ('keit'), ('ement')) as t(i) where contains(text, i)),
k as (select * from e where value is not null and value <> '')"""


def _counted(spark: SparkSession, d: str) -> DataFrame:
    issues = F.filter(F.array(*[F.lit(w) for w in ("ering", "keit", "ement")]), lambda w: F.coalesce(F.contains(F.col("text"), w), F.lit(False)))
    people = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit("[A-Z][a-z]{7,}"), F.lit(0))
    return distributions.distributions(table(spark, d, "documents"), "doc_id", {"source": F.col("source"), "lang": F.col("lang"), "people": people, "issues": issues})


@query(f"with {_DIMENSIONS} select dimension, value, count(*)::bigint as n, count(distinct doc_id)::bigint as n_distinct, min(doc_id) as first_seq from k group by grouping sets ((dimension, value), (dimension))")
def corpus_distributions(spark: SparkSession, d: str) -> DataFrame:
    """Documents by source, language, capitalised names and issues, with totals: one scan, grouping sets."""
    return _counted(spark, d)


@query(f"""with {_DIMENSIONS}, c as (select dimension, value, count(*)::bigint as n, min(doc_id) as first_seq from k group by 1, 2)
select dimension, value, n, row_number() over (partition by dimension order by n desc, first_seq, value) as rank from c qualify rank <= 5""")
def corpus_top_values(spark: SparkSession, d: str) -> DataFrame:
    """The five most frequent values of each of these, ties by first appearance."""
    return distributions.top_values(_counted(spark, d))


@query("""select count(*)::bigint as n_rows, (count(*) filter (where l_returnflag = 'R'))::bigint as returned, (count(*) filter (where l_linestatus = 'O'))::bigint as open, (count(*) filter (where l_discount > 0.05))::bigint as discounted,
 (count(*) filter (where l_quantity >= 25))::bigint as large, (count(*) filter (where l_returnflag = 'R' and l_discount > 0.05))::bigint as returned_discounted from lineitem""")
def evidence_statistics(spark: SparkSession, d: str) -> DataFrame:
    """Counters over every order line in one aggregation."""
    r, disc = F.col("l_returnflag") == "R", F.col("l_discount") > 0.05
    return distributions.flag_counts(table(spark, d, "lineitem"), {"returned": r, "open": F.col("l_linestatus") == "O", "discounted": disc, "large": F.col("l_quantity") >= 25, "returned_discounted": r & disc})


@query("""with e as (select *, row_number() over (partition by user_id, event_type, props order by event_id) as n from events), c as (select (select max(event_id) from events) as top)
select event_id, user_id, event_type, props, case when event_id <= top // 2 then 1 else 2 end::bigint as batch_id from e, c where n = 1""")
def ledger_scan(spark: SparkSession, d: str) -> DataFrame:
    """First events of each user, type and properties, taken in two runs by cursor, the second one repeated; a committed batch changes nothing when it comes again."""
    events, path = table(spark, d, "events").select("event_id", "user_id", "event_type", "props"), scratch(spark)
    top = events.agg(F.max("event_id").alias("top")).first()["top"] or 0
    keys = ["user_id", "event_type", "props"]
    sinks.append_new(sinks.rows_after(events, "event_id", None, top // 2 + 1), path, 1, keys, "event_id")
    rest = sinks.rows_after(events, "event_id", sinks.cursor(spark, path))
    for _ in range(2):
        sinks.append_new(rest, path, 2, keys, "event_id")
    return sinks.committed(spark, path, "event_id bigint, user_id bigint, event_type string, props string")


@query("""with t as (select o_orderkey, o_custkey, o_orderpriority, sha256(o_orderstatus || '|' || (o_totalprice > 200000)::int) as state_hash from orders), d as (select distinct o_custkey, o_orderpriority, state_hash from t where o_orderkey % 5 = 0),
n as (select *, row_number() over (partition by o_custkey, o_orderpriority, state_hash order by o_orderkey) as k from t where o_orderkey % 5 <> 0)
select o_orderkey, state_hash from n where k = 1 and not exists (select 1 from d where d.o_custkey = n.o_custkey and d.o_orderpriority = n.o_orderpriority and d.state_hash = n.state_hash)""")
def unique_triggers(spark: SparkSession, d: str) -> DataFrame:
    """Orders whose customer, priority and state haven't set anything off before."""
    o = table(spark, d, "orders")
    state = F.concat_ws("|", "o_orderstatus", (F.col("o_totalprice") > 200000).cast("int").cast("string"))
    done = o.where("o_orderkey % 5 = 0").select("o_custkey", "o_orderpriority", F.sha2(state, 256).alias("state_hash"))
    return sinks.unique_triggers(o.where("o_orderkey % 5 <> 0"), done, ["o_custkey", "o_orderpriority"], state, "o_orderkey").select("o_orderkey", "state_hash")
