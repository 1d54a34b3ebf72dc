"""Core queries, part three: validation, reconciliation, chunking, costs, JSON, version numbers, selection."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from newsloom.functions import text as T
from newsloom.functions import times
from newsloom.operators import ranking, rules
from newsloom.storage import table

QUERIES, ORACLE = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


@query("""with i as (select l_orderkey, count(*) as n, sum(l_discount) as s, max(l_shipdate) as last from lineitem group by 1)
select o_orderkey, array_to_string(list_filter([case when o_totalprice <= 0 then 'price' end, case when o_orderstatus not in ('F', 'O', 'P') then 'status' end, case when coalesce(i.n, 0) = 0 then 'no_items' end,
  case when i.last < o_orderdate then 'dates' end, case when o_totalprice > 400000 then 'too_large' end], lambda x: x is not null), '|') as errors, array_to_string(list_filter([case when i.n > 6 then 'many_items' end, case when abs(i.s - 0.3) > 0.2 then 'discount_sum' end], lambda x: x is not null), '|') as warnings
from orders left join i on l_orderkey = o_orderkey""")
def record_validation(spark: SparkSession, d: str) -> DataFrame:
    """Each record with the names of the checks it fails, errors and warnings apart; children are counted before the join.

    Discounts are added as decimals: a sum of doubles near a bound depends on the order of its rows.
    """
    items = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"), F.sum(F.col("l_discount").cast("decimal(18,6)")).alias("s"), F.max("l_shipdate").alias("last"))
    j = table(spark, d, "orders").join(items, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    errors = {"price": F.col("o_totalprice") <= 0, "status": ~F.col("o_orderstatus").isin("F", "O", "P"), "no_items": F.coalesce("n", F.lit(0)) == 0, "dates": F.col("last") < F.col("o_orderdate"), "too_large": F.col("o_totalprice") > 400000}
    return j.select("o_orderkey", rules.errors(errors).alias("errors"), rules.errors({"many_items": F.col("n") > 6, "discount_sum": F.expr("abs(s - 0.3BD) > 0.2BD")}).alias("warnings"))


@query("""with g as (select c_mktsegment, c_nationkey, count(*)::bigint as n, min(c_custkey) as one, max(c_custkey) as two from customer group by all) select c_mktsegment || '/' || c_nationkey as group_key, n, one, two, n >= 2 as comparable from g where n > 1""")
def comparable_groups(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").groupBy(F.concat_ws("/", "c_mktsegment", "c_nationkey").alias("group_key"))
    return c.agg(F.count("*").alias("n"), F.min("c_custkey").alias("one"), F.max("c_custkey").alias("two")).where("n > 1").withColumn("comparable", F.col("n") >= 2)


@query("""with l as (select conv_id, turn, length(coalesce(text, '')) + 1 as n from conversations), s as (select *, sum(n) over (partition by conv_id order by turn rows unbounded preceding) as total from l)
select conv_id, turn, n::bigint as n, floor((total - n) / 4000)::bigint as chunk from s""")
def message_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Which 4,000-character chunk each line of a message begins in, by prefix sums."""
    lines = table(spark, d, "conversations").select("conv_id", "turn", (F.length(F.coalesce("text", F.lit(""))) + 1).cast("long").alias("n"))
    before = F.sum("n").over(W.partitionBy("conv_id").orderBy("turn").rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col("n")
    return lines.select("conv_id", "turn", "n", F.floor(before / 4000).cast("long").alias("chunk"))


@query("""with rates as (select * from (values ('en', 0.5, 1.0), ('de', 0.6, 1.2), ('fr', 0.7, 1.4)) r(lang, off_peak, peak))
select source, round(sum(n_chars / 1e6 * coalesce(off_peak, 1.0)), 6) as cost, round(sum(n_chars / 1e6 * coalesce(peak, 2.0)), 6) as peak_cost from documents left join rates using (lang) group by 1""")
def cost_estimate(spark: SparkSession, d: str) -> DataFrame:
    rates = spark.createDataFrame([("en", 0.5, 1.0), ("de", 0.6, 1.2), ("fr", 0.7, 1.4)], "rate_lang string, off_peak double, peak double")
    j = table(spark, d, "documents").join(F.broadcast(rates), F.col("lang") == F.col("rate_lang"), "left")
    return j.groupBy("source").agg(F.round(F.sum(F.col("n_chars") / 1e6 * F.coalesce("off_peak", F.lit(1.0))), 6).alias("cost"), F.round(F.sum(F.col("n_chars") / 1e6 * F.coalesce("peak", F.lit(2.0))), 6).alias("peak_cost"))


@query("""select event_id, json_extract_string(props, '$.k')::bigint as k, json_extract_string(props, '$.missing') as missing, json_valid(props) as parses from events""")
def tolerant_json(spark: SparkSession, d: str) -> DataFrame:
    """Open JSON read with defaults: what doesn't parse gives nulls and a flag."""
    return table(spark, d, "events").select("event_id", F.expr("try_variant_get(try_parse_json(props), '$.k', 'bigint')").alias("k"), F.expr("try_variant_get(try_parse_json(props), '$.missing', 'string')").alias("missing"), F.expr("try_parse_json(props) is not null").alias("parses"))


@query("""select event_type || '_' || day as version_of, lpad((((('0x' || substr(h, 1, 7))::bigint) % 1000) + 1)::varchar, 3, '0') as version from (
  select event_type, (ts::date)::varchar as day, sha256(string_agg(event_id::varchar, ',' order by event_id::varchar)) as h from events group by all)""")
def content_version(spark: SparkSession, d: str) -> DataFrame:
    """A version number from the content: hash of the sorted members, modulo 1,000."""
    g = table(spark, d, "events").groupBy("event_type", F.col("ts").cast("date").cast("string").alias("day")).agg(F.sha2(F.array_join(F.array_sort(F.collect_list(F.col("event_id").cast("string"))), ","), 256).alias("h"))
    return g.select(F.concat_ws("_", "event_type", "day").alias("version_of"), F.lpad((F.conv(F.substring("h", 1, 7), 16, 10).cast("long") % 1000 + 1).cast("string"), 3, "0").alias("version"))


@query("""with s as (select p_partkey, trim(regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g'), '-') as slug from part)
select p_partkey, slug || case when row_number() over (partition by slug order by p_partkey) > 1 then '-' || row_number() over (partition by slug order by p_partkey) else '' end as allocated from s""")
def slug_allocation(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "part").select("p_partkey", T.slug(F.col("p_name")).alias("slug"))
    n = F.row_number().over(W.partitionBy("slug").orderBy("p_partkey"))
    return s.select("p_partkey", F.concat("slug", F.when(n > 1, F.concat(F.lit("-"), n.cast("string"))).otherwise("")).alias("allocated"))


@query("""with p as (select o_custkey, count(*) as n from orders where o_orderdate < timestamp '1996-01-01' group by 1), q as (select o_custkey, count(*) as n from orders where o_orderdate >= timestamp '1996-01-01' group by 1)
select coalesce(p.o_custkey, q.o_custkey) as custkey, case when q.n is null then 'resolved' when p.n is null then 'new' when q.n < p.n then 'narrowed' when q.n > p.n then 'reframed' else 'unchanged' end as status from p full join q on p.o_custkey = q.o_custkey""")
def gap_reconciliation(spark: SparkSession, d: str) -> DataFrame:
    """Known gaps against present ones: resolved, new, narrowed, reframed or unchanged."""
    o = table(spark, d, "orders")
    early = F.col("o_orderdate") < F.lit("1996-01-01").cast("timestamp_ntz")
    g = o.groupBy(F.col("o_custkey").alias("custkey")).agg(F.count_if(early).alias("p"), F.count_if(~early).alias("q"))
    return g.select("custkey", F.when(F.col("q") == 0, "resolved").when(F.col("p") == 0, "new").when(F.col("q") < F.col("p"), "narrowed").when(F.col("q") > F.col("p"), "reframed").otherwise("unchanged").alias("status"))


@query("""with r as (select n_nationkey, lower(n_name) as a from nation), s as (select r_regionkey, lower(r_name) as b from region),
c as (select n_nationkey, r_regionkey, list_distinct(string_split(a, '')) as x, list_distinct(string_split(b, '')) as y from r, s),
v as (select n_nationkey, r_regionkey, len(list_intersect(x, y)) / least(len(x), len(y)) + case when n_nationkey % 5 = r_regionkey then 0.15 else 0 end as score from c),
b as (select * from v qualify row_number() over (partition by n_nationkey order by score desc, r_regionkey) = 1) select n_nationkey, case when score >= 0.35 then r_regionkey end as matched, round(score, 6) as score from b""")
def risk_reconciliation(spark: SparkSession, d: str) -> DataFrame:
    """Best earlier match by overlap of characters, same kind preferred; the earlier side is a fixed small list, held in one array."""
    old = table(spark, d, "region").agg(F.array_sort(F.collect_list(F.struct("r_regionkey", F.lower("r_name").alias("name")))).alias("old"))
    new = table(spark, d, "nation").select("n_nationkey", F.lower("n_name").alias("name"), F.lit(1).alias("one"))
    j = new.join(F.broadcast(old.withColumn("one_", F.lit(1))), F.col("one") == F.col("one_"))
    scored = F.transform("old", lambda o: F.struct((T.overlap(T.characters(F.col("name")), T.characters(o["name"])) + F.when(F.col("n_nationkey") % 5 == o["r_regionkey"], 0.15).otherwise(0.0)).alias("score"), (-o["r_regionkey"]).alias("k")))
    best = j.withColumn("best", F.array_max(scored))
    return best.select("n_nationkey", F.when(F.col("best.score") >= 0.35, -F.col("best.k")).alias("matched"), F.round("best.score", 6).alias("score"))


@query("""select event_id, case when value is null then 'unknown' when value < 0 then 'rejected' when event_type = 'error' and value > 60 then 'HARD_BLOCK' when event_type = 'error' or value > 90 then 'REVIEW' else 'PASS' end as disposition from events""")
def disposition(spark: SparkSession, d: str) -> DataFrame:
    v, bad = F.col("value"), F.col("event_type") == "error"
    return table(spark, d, "events").select("event_id", F.when(v.isNull(), "unknown").when(v < 0, "rejected").when(bad & (v > 60), "HARD_BLOCK").when(bad | (v > 90), "REVIEW").otherwise("PASS").alias("disposition"))


@query("""with f as (select *, row_number() over (partition by user_id, ts::date order by ts, event_id) as i from events where event_type = 'purchase') select user_id, event_id, i::bigint as nth, i <= 3 as allowed from f""")
def daily_quota(spark: SparkSession, d: str) -> DataFrame:
    """At most three a day: the running count within the day against the quota."""
    n = F.row_number().over(W.partitionBy("user_id", F.col("ts").cast("date")).orderBy("ts", "event_id"))
    return table(spark, d, "events").where("event_type = 'purchase'").select("user_id", "event_id", n.cast("long").alias("nth"), (n <= 3).alias("allowed"))


@query("""with m as (select event_type, user_id, max(ts) as latest, arg_max(event_id, (ts, event_id)) as newest from events group by all) select event_type, user_id, newest, latest >= timestamp '2024-01-29' + interval 1 day - interval 1 microsecond as covered from m""")
def ingestion_watermark(spark: SparkSession, d: str) -> DataFrame:
    """Each feed's newest row, and whether the feed has come past the end of a day."""
    m = table(spark, d, "events").groupBy("event_type", "user_id").agg(F.max("ts").alias("latest"), F.max_by("event_id", F.struct("ts", "event_id")).alias("newest"))
    return m.select("event_type", "user_id", "newest", (F.unix_micros(F.col("latest").cast("timestamp")) >= F.unix_micros(F.lit("2024-01-30 00:00:00").cast("timestamp")) - 1).alias("covered"))


@query("""select o_orderkey, case when abs(floor((epoch_us(o_orderdate) - epoch_us(timestamp '1995-06-15')) / 86400000000)) <= 1 then 1.0 when abs(floor((epoch_us(o_orderdate) - epoch_us(timestamp '1995-06-15')) / 86400000000)) <= 7 then 0.7
when abs(floor((epoch_us(o_orderdate) - epoch_us(timestamp '1995-06-15')) / 86400000000)) <= 30 then 0.3 else 0.0 end as closeness from orders""")
def date_closeness(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select("o_orderkey", times.closeness(times.floor_days(F.col("o_orderdate"), F.lit("1995-06-15").cast("timestamp_ntz"))).cast("double").alias("closeness"))


@query("""with l as (select o_custkey, o_orderkey, o_totalprice, case o_orderpriority when '1-URGENT' then 0 when '2-HIGH' then 1 else 2 end as lane from orders)
select lane, o_orderkey, row_number() over (partition by lane order by o_totalprice desc, o_orderkey)::bigint as position from l qualify position <= 12""")
def digest_order(spark: SparkSession, d: str) -> DataFrame:
    """Sections in a given order of priorities, the best twelve of each."""
    lane = F.when(F.col("o_orderpriority") == "1-URGENT", 0).when(F.col("o_orderpriority") == "2-HIGH", 1).otherwise(2)
    o = table(spark, d, "orders").withColumn("lane", lane)
    return ranking.top_n(o, ["lane"], [F.desc("o_totalprice"), F.asc("o_orderkey")], 12).select("lane", "o_orderkey", "position")
