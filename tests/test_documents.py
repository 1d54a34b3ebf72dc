"""JSON documents and chains against plain recursion."""

import json
import random

from newsloom.operators import chains, documents

DROP = ("updated_at",)


def stripped(x):
    if isinstance(x, dict):
        return {k: stripped(v) for k, v in x.items() if k not in DROP}
    return [stripped(v) for v in x] if isinstance(x, list) else x


def form(x):
    if isinstance(x, dict):
        return "{" + ",".join(sorted(json.dumps(k) + ":" + form(v) for k, v in x.items())) + "}"
    if isinstance(x, list):
        return "[" + ",".join(sorted(form(v) for v in x)) + "]"
    return "null" if x in (None, "") and not isinstance(x, bool) else json.dumps(float(x) if isinstance(x, (int, float)) and not isinstance(x, bool) else x)


def diff(a, b, path=""):
    if isinstance(a, dict) and isinstance(b, dict):
        out = []
        for k in set(a) | set(b):
            here = f"{path}.{k}" if path else k
            out += diff(a[k], b[k], here) if k in a and k in b else [here]
        return out
    return [] if form(a) == form(b) else [path or "."]


def value(r, depth):
    kind = r.random()
    if depth and kind < 0.35:
        return {r.choice(["a", "b", "c", "updated_at", "é x"]): value(r, depth - 1) for _ in range(r.randint(0, 3))}
    if depth and kind < 0.55:
        return [value(r, depth - 1) for _ in range(r.randint(0, 3))]
    return r.choice([None, "", "x", "y\"q", 1, 1.5, -20, 100, 2.0, True, False, 0])


def shuffled(r, x):
    if isinstance(x, dict):
        items = [(k, shuffled(r, v)) for k, v in x.items()]
        r.shuffle(items)
        return dict(items)
    if isinstance(x, list):
        out = [shuffled(r, v) for v in x]
        r.shuffle(out)
        return out
    return None if x == "" else x


def changed(r, x):
    if isinstance(x, dict) and x and r.random() < 0.8:
        k = r.choice(list(x))
        out = {**x, k: changed(r, x[k])}
        if r.random() < 0.2:
            out.pop(k)
        return out
    return value(r, 2)


def test_path_diff_equals_recursion(spark):
    r = random.Random(12)
    pairs = {i: (a := value(r, 4), changed(r, a) if r.random() < 0.6 else shuffled(r, a)) for i in range(150)}
    before = spark.createDataFrame([(i, json.dumps(a)) for i, (a, _) in pairs.items()] + [(900, "{"), (901, None), (902, "{}")], "k long, j string")
    after = spark.createDataFrame([(i, json.dumps(b, indent=2)) for i, (_, b) in pairs.items()] + [(900, "{}"), (901, None), (903, "1")], "k long, j string")
    want = {(i, p) for i, (a, b) in pairs.items() for p in diff(stripped(a), stripped(b))} | {(900, "."), (902, "."), (903, ".")}
    found = {(x["id"], x["path"]): x["change"] for x in documents.path_diff(before, after, "k", "j", DROP).collect()}
    assert set(found) == want and (found[902, "."], found[903, "."]) == ("removed", "added") and len(want) > 60
    hashes = [{x["id"]: x["hash"] for x in documents.canonical_hash(df, "k", "j", DROP).collect()} for df in (before, after)]
    assert all((hashes[0][i] == hashes[1][i]) == (form(stripped(a)) == form(stripped(b))) for i, (a, b) in pairs.items())
    got = sorted((x["id"], x["form"]) for x in documents.values_of(before, "k", "j", "a").collect())
    count = lambda x: sum((k == "a") + count(v) for k, v in x.items()) if isinstance(x, dict) else sum(map(count, x)) if isinstance(x, list) else 0
    assert len(got) == sum(count(a) for a, _ in pairs.values())
    assert documents.path_diff(before.limit(0), after.limit(0), "k", "j").count() == 0


def test_depth_costs_no_rounds(spark, monkeypatch):
    rounds = []
    # every level of the deepest document used to be a checkpoint and a shuffle
    monkeypatch.setattr(documents, "cut", lambda df: rounds.append(1) or df, raising=False)
    deep = lambda leaf: '{"a":[' * 60 + leaf + "]}" * 60
    under = lambda leaf: '{"a":' * 400 + leaf + "}" * 400
    one = [(1, deep("1.50")), (2, deep("1.5")), (3, under("10")), (4, '{"b":12345678901234567890.10,"c":"\\u001f"}'), (5, "[1,[2,1]]"), (6, '{"a":1,"a":2}')]
    two = [(1, deep("1.5")), (2, deep('"1.5"')), (3, under("1e2")), (4, '{"c":"\\u001F","b":12345678901234567890.2}'), (5, "[[1.0,2.00],1]"), (6, "no")]
    a, b = (spark.createDataFrame(x, "k long, j string") for x in (one, two))
    assert sorted(map(tuple, documents.path_diff(a, b, "k", "j").collect())) == [(2, "a", "changed"), (3, ".".join("a" * 400), "changed"), (4, "b", "changed")]
    first, second = ({x["id"]: x["hash"] for x in documents.canonical_hash(d, "k", "j").collect()} for d in (a, b))
    assert {k for k in first if first[k] == second[k]} == {1, 5, 6}
    got = [tuple(x) for x in documents.values_of(a.where("k = 5").unionByName(spark.createDataFrame([(7, '{"x":[{"a":[2,1.0]}]}')], "k long, j string")), "k", "j", "a").collect()]
    assert got == [(7, ["", "x", "0", "a"], "[1,2]")]
    assert not rounds


def scan(text):
    """Character by character."""
    found, depth, start, inside, escaped = [], 0, 0, False, False
    for i, c in enumerate(text):
        if inside:
            escaped, inside = (not escaped and c == "\\"), not (c == '"' and not escaped)
        elif c == '"' and depth:
            inside = True
        elif c == "{":
            start = start if depth else i
            depth += 1
        elif c == "}" and depth:
            depth -= 1
            if not depth:
                found.append(text[start : i + 1])
    return found


def test_objects_in_text(spark):
    r = random.Random(6)
    for _ in range(3000):
        text = "".join(r.choice('{}"\\a:1 ,') for _ in range(r.randint(0, 25)))
        assert documents.objects_in(text) == scan(text), text
    cases = {
        '{"a": 1}': ('{"a": 1}', ""), ' \n{"a": "}"} ': ('{"a": "}"}', "trimmed_outer_whitespace"), '```json\n{"a": {"b": "{"}}\n```': ('{"a": {"b": "{"}}', "unwrapped_single_json_fence"),
        '﻿So: {"a": "\\"}"} done': ('{"a": "\\"}"}', "removed_utf8_bom|extracted_unique_json_object"), '{"a":1} {"b":2}': (None, "objects:2"), "{broken": (None, "objects:0"), "[1]": (None, "root_not_object"),
        "null": (None, "root_not_object"), "": (None, "objects:0"), None: (None, "not_text"), "x {not json} {\"a\": []}": ('{"a": []}', "extracted_unique_json_object"),
    }
    df = spark.createDataFrame([(t,) for t in cases], "t string")
    for x in df.select("t", documents.json_in_text(df["t"]).alias("o")).collect():
        assert (x["o"]["value"], x["o"]["steps"]) == cases[x["t"]], x["t"]


def follow(nexts, k):
    seen, hops = {k}, 0
    while True:
        if k not in nexts:
            return k, hops, "missing"
        if nexts[k] is None:
            return k, hops, "end"
        k, hops = nexts[k], hops + 1
        if k in seen:
            return None, None, "cycle"
        seen.add(k)


def test_chains_equal_following_them(spark):
    r = random.Random(5)
    nexts = {0: None, 1: 0, **{i: i + 1 for i in range(2000, 3000)}, 3000: None, 10: 11, 11: 12, 12: 10, 13: 12, 20: 20, 30: 999}
    nexts |= {i: r.choice([None, r.randint(100, 180)]) for i in range(100, 170)} | {i: 5000 for i in range(5001, 5200)} | {5000: None}
    found = {x["k"]: (x["last"], x["hops"], x["state"]) for x in chains.chain_ends(spark.createDataFrame(list(nexts.items()), "k long, n long"), "k", "n").collect()}
    assert found == {k: follow(nexts, k) for k in nexts}
    assert chains.chain_ends(spark.createDataFrame([], "k long, n long"), "k", "n").count() == 0


def test_previous_and_superseded(spark):
    rows = [("a", 1, 10, 3, False), ("a", 2, 40, None, False), ("a", 3, 30, 4, False), ("a", 4, 50, None, True), ("b", 5, 5, None, False), ("b", 6, 6, None, True), ("c", 7, 1, None, True), ("d", 8, 1, None, False)]
    df = spark.createDataFrame(rows, "g string, k long, t long, n long, live boolean")
    assert {tuple(x) for x in chains.previous_version(df, "g", "k", "t", "n", df["live"]).collect()} == {("a", 4, 3, "superseded"), ("b", 6, 5, "created"), ("c", 7, None, "none")}
    todo = spark.createDataFrame([("e", 1, 1, "pending"), ("e", 2, 2, "pending"), ("e", 3, 3, "done"), (None, 4, 1, "pending"), (None, 5, 1, "pending")], "e string, k long, t long, s string")
    assert {(x["k"], x["s"], x["superseded_by"]) for x in chains.supersede(todo, ["e"], "k", "t", "s").collect()} == {(1, "superseded", 2), (2, "pending", None), (3, "done", None), (4, "superseded", 5), (5, "pending", None)}


def test_chain_rounds_follow_the_longest_chain(spark, monkeypatch):
    rows = [(i, i + 1 if i % 10 < 9 else None) for i in range(400)] + [(1000 + i, 1000 + (i ^ 1)) for i in range(200)] + [(2000 + i, 1000 + i) for i in range(50)] + [(3000, -1)]
    rounds, plain = [], chains.cut
    monkeypatch.setattr(chains, "cut", lambda df: rounds.append(1) or plain(df))
    got = {r["k"]: (r["last"], r["hops"], r["state"]) for r in chains.chain_ends(spark.createDataFrame(rows, "k long, n long"), "k", "n").collect()}
    # cycles used to cost a round for each bit of the table's size
    assert len(rounds) <= 1 + 5
    ends = {i: (i // 10 * 10 + 9, 9 - i % 10, "end") for i in range(400)}
    assert got == ends | {k: (None, None, "cycle") for k, _ in rows if 1000 <= k < 3000} | {3000: (-1, 1, "missing")}
