"""Event clustering against sequential passes on small random inputs."""

import datetime as dt
import hashlib
import random
import re

from pyspark.sql import functions as F

from newsloom.operators import clustering

START = dt.datetime(2024, 1, 1)


def near(a, b, days=7):
    return a is None or b is None or abs((a - b).days) <= days


def by_time(r):
    return (r["ts"] is None, r["ts"] or START, str(r["id"]))


def test_date_buckets_chain_within_whole_days(spark):
    r = random.Random(3)
    rows = [{"id": i, "k": r.choice("ab"), "ts": None if r.random() < 0.1 else START + dt.timedelta(hours=r.randint(0, 3000))} for i in range(120)]
    found = {x["id"]: (x["k"], x["bucket"]) for x in clustering.date_islands(spark.createDataFrame(rows, "id long, k string, ts timestamp"), ["k"], "ts", 7).collect()}
    for k in "ab":
        buckets = []
        for row in sorted((x for x in rows if x["k"] == k), key=by_time):
            home = next((b for b in buckets if any(near(row["ts"], o["ts"]) for o in b)), None)
            buckets.append([row]) if home is None else home.append(row)
        for n, b in enumerate(buckets, 1):
            assert {found[x["id"]] for x in b} == {(k, n)}
    assert clustering.date_islands(spark.createDataFrame([], "id long, k string, ts timestamp"), ["k"], "ts", 7).count() == 0
    # seven days and 23 hours are seven whole days, eight days aren't; rows without any time are one bucket
    edge = [(1, None, START), (2, None, START + dt.timedelta(days=7, hours=23)), (3, None, START + dt.timedelta(days=15, hours=23)), (4, "x", None), (5, "x", None)]
    assert [x["bucket"] for x in clustering.date_islands(spark.createDataFrame(edge, "id long, k string, ts timestamp"), ["k"], "ts", 7).orderBy("id").collect()] == [1, 1, 2, 1, 1]


def phrase(a, b, least=6):
    a, b = re.sub(r"\s+", "", a or ""), re.sub(r"\s+", "", b or "")
    return any(a[i : i + least] in b for i in range(len(a) - least + 1))


def sequential_layers(rows):
    seen, unique = set(), []
    for x in sorted(rows, key=lambda x: x["id"]):
        if x["url"] and x["url"] in seen:
            continue
        seen.add(x["url"])
        unique.append(x)
    clusters, groups, titles = [], {}, {}
    for x in unique:
        if x["action"]:
            groups.setdefault((x["actor"] or "", x["action"], x["issue"] or ""), []).append(x)
        else:
            titles.setdefault(re.sub(r"[^\w]", "", x["title"] or "")[:50], []).append(x)
    for g in groups.values():
        buckets = []
        for row in sorted(g, key=by_time):
            home = next((b for b in buckets if any(near(row["ts"], o["ts"]) for o in b)), None)
            buckets.append([row]) if home is None else home.append(row)
        clusters += buckets
    clusters += titles.values()
    merged = []
    for c in sorted(clusters, key=lambda c: by_time(min(c, key=by_time))):
        a = min(c, key=by_time)
        for m in merged:
            o = min(m, key=by_time)
            if near(a["ts"], o["ts"]) and (a["actor"] or "") == (o["actor"] or "") and (a["action"] or "") == (o["action"] or "") and phrase(a["title"], o["title"]):
                m.extend(c)
                break
        else:
            merged.append(list(c))
    return {x["id"]: min(m, key=by_time)["id"] for m in merged for x in m}


def test_layers_equal_the_sequential_pass(spark):
    for seed in range(6):
        r = random.Random(seed)
        words = ["budget", "talks", "open", "close", "vote on", "rally", "x"]
        rows = [
            {"id": i, "url": r.choice([None, "", f"u{r.randint(0, 60)}"]), "title": r.choice([None, "", " ".join(r.choice(words) for _ in range(r.randint(1, 4)))]),
             "actor": r.choice(["p", "q", None]), "action": r.choice(["", "", "meet", "sign", None]), "issue": r.choice(["i", "j", None]),
             "ts": None if r.random() < 0.15 else START + dt.timedelta(hours=r.randint(0, 1500))}
            for i in range(70)
        ]
        df = spark.createDataFrame(rows, "id long, url string, title string, actor string, action string, issue string, ts timestamp")
        assert dict(clustering.layered_clusters(df).select("id", "cluster").collect()) == sequential_layers(rows), seed


def test_a_row_with_a_head_keeps_nobody_waiting(spark, monkeypatch):
    """A chain x0, x1, ... each of whose rows has a head of its own takes a few rounds, not one for each row."""
    cuts, real = [], clustering.cut
    monkeypatch.setattr(clustering, "cut", lambda df: cuts.append(1) or real(df))
    posts, order, expected = [], {}, {0: 0}
    for i in range(20):
        order[i] = 2 * i
        posts += [(i, f"x{i}"), (i, f"x{i - 1}"), (i, f"h{i}")]
        if i:
            order[100 + i] = 2 * i - 1
            posts.append((100 + i, f"h{i}"))
            expected |= {i: 0 if i == 1 else 100 + i, 100 + i: 100 + i}
    nodes = spark.createDataFrame(list(order.items()), "id long, t long").select(
        "id", F.struct("t", F.col("id").cast("string").alias("s")).alias("ord"), F.lit(0).alias("status"), F.lit(None).cast("struct<t: bigint, s: string>").alias("head"))
    for width in (1000, None):
        cuts.clear()
        found = clustering.greedy_heads(nodes, spark.createDataFrame(posts, "id long, key string"), width)
        assert {x["id"]: int(x["head"]["s"]) for x in found.collect()} == expected
        assert len(cuts) < 12


def sequential_cliques(order, edges):
    clusters = []
    for i in order:
        home = next((c for c in clusters if all((m, i) in edges or (i, m) in edges for m in c)), None)
        clusters.append([i]) if home is None else home.append(i)
    return {m: c[0] for c in clusters for m in c}


def test_cliques_equal_the_sequential_pass_on_random_graphs(spark):
    """200 graphs at once, as parts of one table: they share no edges."""
    r = random.Random(9)
    rows, edges, expected = [], [], {}
    for g in range(200):
        n = r.randint(1, 12)
        ids = [g * 100 + i for i in range(n)]
        p = r.choice([0.1, 0.3, 0.6, 0.9, 1.0])
        own = {(a, b) for a in ids for b in ids if a < b and r.random() < p}
        seq = {i: r.randint(0, 5) for i in ids}
        rows += seq.items()
        edges += [(b, a) if r.random() < 0.5 else (a, b) for a, b in own]
        expected |= sequential_cliques(sorted(ids, key=lambda i: (seq[i], i)), own)
    df = spark.createDataFrame(rows, "id long, seq long")
    pairs = spark.createDataFrame(edges + edges[:5] + [(1, 1), (None, 3)], "a long, b long")
    found = clustering.greedy_cliques(df, "id", "seq", pairs)
    assert dict(map(tuple, found.collect())) == expected
    assert "InPandas" not in found._jdf.queryExecution().toString()
    assert clustering.greedy_cliques(df.limit(0), "id", "seq", pairs.limit(0)).count() == 0


def test_events_and_their_ids(spark):
    r = random.Random(4)
    tokens, entities, groups, places = [f"t{i}" for i in range(9)], ["Avia", "Bora", "Cela"], ["talks", "tariff", "drill"], ["Avia", "Bora"]
    rows = []
    for i in range(110):
        own = sorted(r.sample(entities, r.randint(0, 2)))
        words = sorted(r.sample(tokens, r.randint(0, 7)))
        rows.append({
            "id": i, "seq": i, "ts": None if r.random() < 0.1 else START + dt.timedelta(hours=r.randint(0, 60)), "url": r.choice(["", None, f"u{r.randint(0, 40)}"]), "tokens": words, "entities": own,
            "groups": sorted(r.sample(groups, r.randint(0, 2))), "places": [x for x in own if x in places], "core": [w for w in words if w in ("t1", "t2", "t3")], "names": words[:3], "priority": r.randint(0, 2),
        })

    def same(a, b):
        if a["url"] and a["url"] == b["url"]:
            return True
        if a["ts"] is None or b["ts"] is None or abs((a["ts"] - b["ts"]).total_seconds()) > 86400:
            return False
        s = {k: (set(a[k]), set(b[k])) for k in ("tokens", "entities", "groups", "places", "core")}
        if not s["entities"][0] & s["entities"][1] or not s["groups"][0] & s["groups"][1] or (s["places"][0] and s["places"][1] and s["places"][0] != s["places"][1]):
            return False
        one, two = s["tokens"]
        if not one or not two or 100 * len(one & two) < 55 * len(one | two):
            return False
        return len(s["core"][0] & s["core"][1]) + len(s["groups"][0] & s["groups"][1]) >= 2

    kinds = "id long, seq long, ts timestamp, url string, tokens array<string>, entities array<string>, groups array<string>, places array<string>, core array<string>, names array<string>, priority int"
    df = spark.createDataFrame(rows, kinds)
    edges = {(a["id"], b["id"]) for a in rows for b in rows if a["id"] < b["id"] and same(a, b)}
    pairs = clustering.same_event_edges(df)
    assert {tuple(x) for x in pairs.collect()} == edges and len(edges) > 10
    clusters = clustering.greedy_cliques(df, "id", "seq", pairs)
    expected = sequential_cliques(range(110), edges)
    assert dict(map(tuple, clusters.collect())) == expected
    found = {x["cluster"]: x for x in clustering.events_of(df, clusters, "v1").collect()}
    for head in set(expected.values()):
        members = [x for x in rows if expected[x["id"]] == head]
        best = min(members, key=lambda x: (x["ts"] is None, x["ts"] or START, x["priority"], x["seq"]))
        times = [x["ts"] for x in members if x["ts"]]
        shared = set.intersection(*(set(x["names"]) for x in members))
        url = best["url"] or ""
        text = "\x1f".join([
            "v1", min(times).date().isoformat() if times else "time-unknown", "canonical=" + (url if len(members) == 1 else ""), "entities=" + ",".join(sorted({e for x in members for e in x["entities"]})),
            "groups=" + ",".join(sorted({e for x in members for e in x["groups"]})), "tokens=" + (",".join(sorted(shared)) if shared else url or "content-unknown")])
        assert (found[head]["event_id"], found[head]["canonical"], found[head]["n"]) == ("evt_" + hashlib.sha256(text.encode()).hexdigest(), best["id"], len(members))
    assert clustering.events_of(df.limit(0), clusters.limit(0).withColumn("cluster", F.col("cluster")), "v1").count() == 0
