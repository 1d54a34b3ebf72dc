import datetime as dt
import random
import re

from pyspark.sql import functions as F

from newsloom.functions import text, times, urls
from newsloom.operators import clustering, components, dedup, match, ranking, rules
from newsloom.plans import core_b
from newsloom.sources import feeds
from newsloom.storage import table
from tests.conftest import DATA


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def at(s):
    return F.lit(s).cast("timestamp")


def test_freshness_bounds(spark):
    clock = at("2024-01-02 12:00:00")
    cases = {"2024-01-02 10:30:00": "fresh", "2024-01-02 10:29:59": "catch_up", "2024-01-02 12:10:00": "fresh", "2024-01-02 12:10:01": "future", "2024-01-02 00:00:00": "catch_up", "2024-01-01 23:59:59": "stale"}
    for when, bucket in cases.items():
        assert one(spark, times.freshness(at(when), clock)) == bucket
    assert one(spark, times.freshness(F.lit(None).cast("timestamp"), clock)) == "unknown"


def test_floor_days_is_asymmetric(spark):
    a, b = at("2024-01-08 00:00:01"), at("2024-01-01 00:00:00")
    assert one(spark, times.floor_days(a, b)) == 7
    assert one(spark, times.floor_days(b, a)) == 8


def test_half_months(spark):
    assert one(spark, times.previous_half_month(F.lit("2024-01-10").cast("date"))) == dt.date(2023, 12, 16)
    assert one(spark, times.run_period_start(F.lit("2024-01-09").cast("date"))) == dt.date(2023, 12, 16)
    assert one(spark, times.run_period_start(F.lit("2024-01-22").cast("date"))) == dt.date(2024, 1, 1)
    assert one(spark, times.run_period_start(F.lit("2024-01-23").cast("date"))) is None


def test_one_url_through_five_rules(spark):
    u = F.lit("HTTPS://User@WWW.Example.com:8443/News/A/?b=2&utm_source=x&a=1&utm_term=t&ref=r#top")
    assert one(spark, urls.collector_url(u)) == "https://user@www.example.com:8443/news/a?a=1&b=2&ref=r&utm_term=t"
    assert one(spark, urls.candidate_url(u)) == "https://www.example.com/news/a?a=1&b=2"
    assert one(spark, urls.event_url(u)) == "https://user@www.example.com:8443/News/A?a=1&b=2&ref=r"
    assert one(spark, urls.newsletter_url(u)) == ""
    assert one(spark, urls.newsletter_url(F.lit("https://127.0.0.1/x"))) == ""


def test_newsletter_links(spark):
    cases = {
        "https://WWW.Example.com:8443/News/A/?b=2&utm_x=1&a=1&trk=t&MKT_tok=q&igshid=7#top": "https://www.example.com:8443/news/a?a=1&b=2&igshid=7",
        " <https://Example.com> ": "https://example.com/", "https://example.com/?empty=&from=x": "https://example.com/?empty=", "https://example.com./x": "https://example.com/x",
        "http://example.com/x": "", "https://user:word@example.com/": "", "https://169.254.1.1/": "", "https://0.0.0.0/": "", "https://[::1]/": "", "https://[fe80::1]/": "",
        "https://[::ffff:10.0.0.1]/": "", "https://0x7f000001/": "", "https://2130706433/": "", "https://010.1.1.1/": "", "https://box.local/": "", "https://8.8.8.8/A": "https://8.8.8.8/a",
        "https://[2606:4700::1]/": "https://[2606:4700::1]/", "not a link": "",
    }
    rows = spark.createDataFrame([(u,) for u in cases], "u string").select("u", urls.newsletter_url(F.col("u")).alias("v")).collect()
    assert {r["u"]: r["v"] for r in rows} == cases


def split_by_hand(message, most):
    if len(message) <= most:
        return [message]
    head, *lines = message.split("\n")
    room, parts, own = max(most - len(head) - 60, 20), [], None
    for line in lines:
        if len(line) + 1 > room:
            link = line[line.find("http") :] if "http" in line else ""
            if link and len(link) < room - 10:
                line = line[: room - len(link) - 4] + "..." + link
            else:
                line = (link or line)[: room - 3] + "..."
        if own is not None and len(own) + 1 + len(line) + 1 > room:
            parts.append(own)
            own = line
        else:
            own = line if own is None else own + "\n" + line
    parts += [own] if own is not None else []
    return [f"{head}\n{i}/{len(parts)}\n\n{p}" for i, p in enumerate(parts, 1)]


def test_message_parts(spark):
    r = random.Random(5)
    messages = ["", "short", "a" * 300, "head\n" + "b" * 500, "head\n" + "c" * 200 + " https://example.com/" + "d" * 30, "h\n\n\n" + "e" * 190]
    messages += ["\n".join("x" * r.randint(0, 90) for _ in range(r.randint(1, 20))) for _ in range(40)]
    rows = spark.createDataFrame(list(enumerate(messages)), "i int, m string").select("i", text.message_parts(F.col("m"), 200).alias("parts")).collect()
    for r_ in rows:
        assert r_["parts"] == split_by_hand(messages[r_["i"]], 200), r_["i"]
        assert all(len(p) <= 200 for p in r_["parts"]) or len(messages[r_["i"]].split("\n")[0]) > 120


def test_routes_by_label(spark):
    row = lambda **k: {"label": None, "fact": True, "said": True, "dup": False, "basis": "title", "n": 2, "risk": "high", "s": 1.0} | k
    cases = [
        (row(label="irrelevant", dup=True), "auto_reject", ["relevance_label_irrelevant"]), (row(label="contextual"), "context_only", ["contextual_no_direct_event_or_statement"]),
        (row(label="contextual", fact=False, said=False, dup=True), "hold", ["contextual_without_actionable_assertion"]), (row(label="direct_event", dup=True), "duplicate_candidate", ["formal_duplicate_or_existing_candidate"]),
        (row(label="direct_event", fact=False, basis="unknown", n=0), "hold", ["direct_event_without_observed_fact", "date_unknown", "no_valid_source"]), (row(label="direct_event"), "review_required", ["direct_event_eligible"]),
        (row(label="direct_statement", risk="low"), "hold", ["direct_statement_risk_too_low"]), (row(label="direct_statement"), "review_required", ["direct_statement_eligible"]),
        (row(s=0.33), "hold", ["low_cluster_confidence", "low_completeness"]), (row(), "review_required", ["eligible_for_review"]),
    ]
    df = spark.createDataFrame([c for c, *_ in cases], "label string, fact boolean, said boolean, dup boolean, basis string, n int, risk string, s double").coalesce(1)
    c = F.col
    got = df.select(rules.route_candidate(c("label"), c("fact"), c("said"), c("dup"), c("basis"), c("n"), c("risk"), {k: c("s") for k in rules.REVIEW}).alias("v")).collect()
    assert [(r["v"]["route"], r["v"]["reasons"]) for r in got] == [(route, reasons) for _, route, reasons in cases]


def test_overlap_measures_differ(spark):
    a, b = F.lit("abcd"), F.lit("abdc")
    assert one(spark, text.overlap(text.characters(a), text.characters(b))) == 1.0
    assert abs(one(spark, text.overlap(text.bigrams(a), text.bigrams(b))) - 1 / 3) < 1e-9
    assert one(spark, text.jaccard(text.token_set(F.lit("")), text.token_set(b))) == 0.0


def test_phrase_respects_word_ends(spark):
    assert one(spark, text.has_phrase(F.lit("The U.S. mit license."), "us MIT"))
    assert not one(spark, text.has_phrase(F.lit("summit licenses"), "mit license"))


def test_mildest_level_wins_unless_told_otherwise(spark):
    table = [rules.ImportanceRule("a", (), (), ("fire",), (), 90, (), "critical"), rules.ImportanceRule("b", (), (), ("fire",), (), 40, (), "normal")]
    df = spark.createDataFrame([("fire",), ("calm",)], "t string")
    no = F.lit(False)
    assert {r["t"]: r["level"] for r in rules.importance(df, F.col("t"), table, no, no).collect()} == {"fire": "normal", "calm": "normal"}
    assert rules.importance(df, F.col("t"), table, no, no, highest=True).where("t = 'fire'").first()["level"] == "critical"
    assert rules.validate_rules([*table, table[0]._replace(cap="odd")]) == ["duplicate rule a", "a: unknown level odd"]


def test_ttl_counts_from_the_last_sent_row(spark):
    rows = [("k", dt.datetime(2024, 1, 1, h)) for h in (0, 5, 9, 11, 22)]
    r = ranking.ttl_fold(spark.createDataFrame(rows, "k string, ts timestamp"), "k", "ts", 10 * 3600).first()
    assert (r["n_seen"], r["n_sent"]) == (5, 3)


def test_components_of_chains_and_cycles(spark):
    random.seed(3)
    edges = [(i, i + 1) for i in range(1, 60)] + [(100, 101), (101, 100), (102, 102), (200, 150), (150, 170)]
    random.shuffle(edges)
    found = {r["node"]: r["component"] for r in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {**{i: 1 for i in range(1, 61)}, 100: 100, 101: 100, 150: 150, 170: 150, 200: 150}


def test_cliques_need_every_member(spark):
    df = spark.createDataFrame([(1, 1), (2, 2), (3, 3), (4, 4)], "id long, seq long")
    edges = spark.createDataFrame([(1, 2), (2, 3)], "a long, b long")
    assert {r["id"]: r["cluster"] for r in clustering.greedy_cliques(df, "id", "seq", edges).collect()} == {1: 1, 2: 1, 3: 3, 4: 4}
    turned = df.withColumn("seq", -F.col("seq"))
    assert {r["id"]: r["cluster"] for r in clustering.greedy_cliques(turned, "id", "seq", edges).collect()} == {3: 3, 2: 3, 1: 1, 4: 4}


def test_jaccard_pairs_equal_all_pairs(spark):
    random.seed(5)
    rows = [(i, [random.choice("abcdefghij") for _ in range(random.randint(1, 8))]) for i in range(60)]
    found = {(r["a"], r["b"]) for r in match.jaccard_pairs(spark.createDataFrame(rows, "id long, t array<string>"), "id", F.col("t"), 60).collect()}
    sets = {i: set(t) for i, t in rows}
    assert found == {(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 60 * len(sets[a] | sets[b])}


def test_similar_parts_of_the_whole_table(spark):
    parts = {r["p_partkey"]: r for r in table(spark, DATA, "part").collect()}
    tokens = lambda *c: {i: set(re.findall("[a-z0-9#]+", " ".join(r[x] for x in c).lower())) for i, r in parts.items()}
    pairs = lambda s, t: {(a, b) for a in s for b in s if a < b and 100 * len(s[a] & s[b]) >= t * len(s[a] | s[b])}
    t = tokens("p_name", "p_brand", "p_type")
    alike = pairs(t, 60)
    links = {i: (min(j for j in t if t[j] == t[i]), sum(i in p for p in alike)) for i in t}
    assert {r["p_partkey"]: (r["class_id"], r["links"]) for r in core_b.token_jaccard_pairs_whole(spark, DATA).collect()} == links
    s = tokens("p_name", "p_type")
    near = {(a, b) for a, b in pairs(s, 70) if len(s[a] & s[b]) >= 2}
    label = {i: i for i in parts}
    for _ in parts:
        for a, b in near:
            label[a] = label[b] = min(label[a], label[b])
    assert dict(map(tuple, core_b.near_dup_components_whole(spark, DATA).collect())) == label
    clusters = []
    for i in sorted(parts):
        home = next((c for c in clusters if all((m, i) in near for m in c)), None)
        clusters.append([i]) if home is None else home.append(i)
    assert dict(map(tuple, core_b.near_dup_cliques(spark, DATA).select("p_partkey", "cluster").collect())) == {m: c[0] for c in clusters for m in c}


def test_similar_events_within_a_day(spark):
    events = {r["event_id"]: r for r in table(spark, DATA, "events").collect()}
    s = {i: {r["event_type"].lower(), f"user{r['user_id']}", *re.findall("[a-z0-9#]+", r["props"].lower())} for i, r in events.items()}
    near = [(a, b) for a in s for b in s if a < b and len(s[a] & s[b]) >= 2 and 100 * len(s[a] & s[b]) >= 70 * len(s[a] | s[b]) and abs(events[a]["ts"] - events[b]["ts"]) <= dt.timedelta(days=1)]
    label = {i: i for i in events}
    for _ in range(len(near) + 1):
        before = dict(label)
        for a, b in near:
            label[a] = label[b] = min(label[a], label[b])
        if label == before:
            break
    assert dict(map(tuple, core_b.near_dup_components_day(spark, DATA).collect())) == label


def test_merge_keeps_terminal_rows(spark):
    old = spark.createDataFrame([(1, "open"), (2, "published")], "k long, s string")
    new = spark.createDataFrame([(1, "closed"), (2, "closed"), (3, "open")], "k long, s string")
    assert {tuple(r) for r in dedup.keyed_merge(old, new, ["k"], "replace", ("s", ("published",))).collect()} == {(1, "closed"), (2, "published"), (3, "open")}
    assert {tuple(r) for r in dedup.keyed_merge(old, new, ["k"], "insert").collect()} == {(1, "open"), (2, "published"), (3, "open")}


def test_feeds(spark):
    rss = '<?xml version="1.0"?><rss><channel><item><title>A</title><link>https://a.example/1</link><pubDate>Mon, 01 Jan 2024 08:00:00 +0800</pubDate></item><item><title> </title><link>https://a.example/2</link></item><item><title>C</title><link>https://a.example/1</link></item></channel></rss>'
    bodies = spark.createDataFrame([("s", rss), ("bad", "<html></html>")], "source_id string, body string")
    r = feeds.rss(bodies).collect()
    assert [(x["title"], x["position"], x["published"]) for x in r] == [("A", 1, dt.datetime(2024, 1, 1))]
    site = '<urlset xmlns:news="n"><url><loc>https://b.example/world/1</loc><lastmod>2024-01-02</lastmod><news:news><news:title>W</news:title></news:news></url><url><loc>https://b.example/x/2</loc><news:news><news:title>Morning Summary</news:title></news:news></url></urlset>'
    m = feeds.sitemap(spark.createDataFrame([("m", site)], "source_id string, body string"), "/world").collect()
    assert [(x["title"], x["published"]) for x in m] == [("W", dt.datetime(2024, 1, 2))]
    api = '{"data": [{"Title": "P", "URL": "https://p.example", "PublishDate": "2026/7/17 下午 04:48:00"}]}'
    j = feeds.json_api(spark.createDataFrame([("j", api)], "source_id string, body string")).first()
    assert j["published"] == dt.datetime(2026, 7, 17, 16, 48)
    page = '<div class="list"><a href="/1"> One <b>two</b></a><time datetime="2024-01-03">x</time><a href="/2">Three</a></div><a href="/3">Out</a>'
    h = feeds.html_list(spark.createDataFrame([("h", page)], "source_id string, body string"), "list").collect()
    assert [(x["title"], x["url"]) for x in h] == [("One two", "/1"), ("Three", "/2")]
    mail = "Date: Mon, 01 Jan 2024 08:00:00 +0000\nContent-Type: text/plain\n\nA headline\nhttps://m.example/1\n\nUnsubscribe https://m.example/u\n"
    n = feeds.newsletter(spark.createDataFrame([("n", mail)], "source_id string, body string")).collect()
    assert [(x["title"], x["url"]) for x in n] == [("A headline", "https://m.example/1")]
    spark.dataSource.register(feeds.PagedSource)
    assert spark.read.format("newsloom_pages").option("pages", "3").option("rows", "4").load().count() == 12


def test_discounts_are_added_exactly(spark, tmp_path):
    from newsloom.plans import core_c

    # as doubles these give more than 0.5 in this order
    many = (0.08, 0.1, 0.09, 0.08, 0.1, 0.05)
    assert 0.08 + 0.1 + 0.09 + 0.08 + 0.1 + 0.05 > 0.5
    lines = [(1, x) for x in (0.1, 0.2, 0.1, 0.1)] + [(2, x) for x in (0.03, 0.07)] + [(3, x) for x in (0.1, 0.4, 0.01)] + [(4, x) for x in (0.06, 0.01, 0.02)]
    lines += [(5, x) for x in many]
    spark.createDataFrame(lines, "l_orderkey long, l_discount double").selectExpr("*", "timestamp'2020-01-02' as l_shipdate").coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.range(1, 6).selectExpr("id as o_orderkey", "'O' as o_orderstatus", "1.0 as o_totalprice", "timestamp'2020-01-01' as o_orderdate").write.parquet(f"{tmp_path}/orders.parquet")
    got = {r["o_orderkey"]: r["warnings"] for r in core_c.record_validation(spark, str(tmp_path)).collect()}
    assert got == {1: "", 2: "", 3: "discount_sum", 4: "discount_sum", 5: ""}


def test_sizes_decide_how_many_tokens_are_keys(spark):
    rows = [(i, [f"user{i // 50}", f"k{i}", "common", "all"]) for i in range(200)] + [(1000 + i, [f"user{i // 50}", f"k{i}", "common", "all", "more"]) for i in range(0, 200, 7)]
    sets = {i: set(t) for i, t in rows}
    df = spark.createDataFrame(rows, "id long, t array<string>")
    assert {(r["a"], r["b"]) for r in match.jaccard_pairs(df, "id", F.col("t"), 70).collect()} == {(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 70 * len(sets[a] | sets[b])}
    keys = match.prefixes(df.select("id", F.col("t").alias("s")), "id", 70)
    # sets of four match sets of four only as copies, and sets of five by all four tokens: the rarest one is the key
    assert keys.where("n = 4 and m = 4").count() == 0 and keys.where("n = 4").count() == 200


def test_copies_are_one_class(spark):
    random.seed(6)
    rows = [(i, dt.datetime(2024, 1, 1) + dt.timedelta(hours=random.randint(0, 400)), [random.choice("abcdefg") for _ in range(random.randint(0, 6))]) for i in range(150)]
    rows += [(200 + i, dt.datetime(2024, 1, 3 + i // 4, i % 24), ["a", "b", "c"]) for i in range(40)] + [(300, None, ["a", "b", "c"])]
    df = spark.createDataFrame(rows, "id long, ts timestamp, t array<string>")
    sets = {i: (t, set(w)) for i, t, w in rows}
    near = lambda a, b: len(a & b) >= 2 and 100 * len(a & b) >= 70 * len(a | b)

    def spread(edge):
        label = {i: i for i in sets}
        for _ in sets:
            for a in sets:
                for b in sets:
                    if a < b and edge(sets[a], sets[b]):
                        label[a] = label[b] = min(label[a], label[b])
        return label

    within = lambda x, y: None not in (x[0], y[0]) and near(x[1], y[1]) and abs(x[0] - y[0]) <= dt.timedelta(days=1)
    assert dict(map(tuple, match.similar_components(df, "id", F.col("t"), 70, 2, "ts", 24).collect())) == spread(within)
    assert dict(map(tuple, match.similar_components(df, "id", F.col("t"), 70, 2).collect())) == spread(lambda x, y: near(x[1], y[1]))
    nodes, edges = match.class_edges(df, "id", F.col("t"), 70, 2)
    assert nodes.groupBy("s").count().where("count > 1").count() == 0 and edges.count() <= nodes.count() ** 2


def test_suggestions_pair_profiles_not_rows(spark):
    random.seed(7)
    rows = [(i, random.choice("xy"), random.choice("pq"), random.choice([1, 2, None])) for i in range(120)]
    c, f = spark.createDataFrame(rows, "c_id long, c_k string, c_t string, c_n int"), spark.createDataFrame(rows, "f_id long, f_k string, f_t string, f_n int")
    features = {"type": (F.col("c_t") == F.col("f_t")).cast("int"), "action": F.coalesce((F.col("c_n") == F.col("f_n")).cast("int"), F.lit(0))}
    got = match.duplicate_suggestions(c, f, "k", features)
    want = set()
    for i, k, t, n in rows:
        facts = sorted((-(0.15 * (t == u) + 0.2 * (n is not None and n == m)), j) for j, b, u, m in rows if b == k and j != i)[:5]
        want |= {(i, j, r, round(-x, 4)) for r, (x, j) in enumerate(facts, 1)}
    assert {(r["candidate"], r["fact"], r["rank"], r["score"]) for r in got.collect()} == want
    # ranked rows are distinct profiles: the plan groups both sides before the block join
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    join = plan[plan.index("(c_k"):] if "(c_k" in plan else plan
    assert join.count("Aggregate") >= 2
