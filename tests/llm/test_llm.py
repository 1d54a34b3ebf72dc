"""The llm operators against brute force on small fixtures, with nulls, empties, ties and repeats."""

import collections
import hashlib
import math
import random
import zlib
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest
import zstandard
from pyspark.sql import functions as F

from newsloom.llm import chat, decontam, kernel, licenses, linear, lm, near_dedup, pieces, quality_classifier, quality_rules, queries, sql, substring, toxicity
from tests.conftest import DATA
from tests.parity import assert_same, connect

WORDS = [a + b for a in ("ba", "co", "du", "fe", "gi", "ho", "ju", "ka") for b in ("ran", "sel", "tim", "vor", "wex", "yul", "zan")]


def prose(r, n):
    return " ".join(r.choice(WORDS) + str(r.randint(0, 40)) for _ in range(n))


@pytest.fixture(scope="module")
def corpus(spark):
    """Texts with exact and near copies, a shared passage, nulls, empties and one long text."""
    r = random.Random(11)
    texts = [prose(r, r.randint(5, 150)) for _ in range(40)]
    base = prose(r, 120).split()
    for i in range(12):
        w = list(base)
        w[(i * 9) % 120] = f"edit{i}"
        texts.append(" ".join(w))
    shared = prose(r, 60)
    texts += [f"{prose(r, 30)} {shared} {prose(r, 30)}" for _ in range(5)]
    texts += [texts[2], texts[2].upper(), "one two", "one  two", "one", None, "", " \n\t", prose(r, 3000)]
    rows = [(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)]
    return spark.createDataFrame([*rows, (None, "lost id " * 30, None, None, None)], "doc_id long, text string, lang string, source string, n_chars long"), {i: t for i, t, *_ in rows}


def words(t):
    return (t or "").encode().lower().split()


def components(edges, nodes):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_words_are_ascii_whitespace_runs():
    texts = ["Ab\x0bcd  e", "", "\xa0x y", "end"]
    data = "".join(texts).encode()
    offsets = np.cumsum([0, *[len(t.encode()) for t in texts]])
    w = kernel.Words(np.frombuffer(data, np.uint8), offsets)
    got = [[data[s:e] for s, e in zip(w.starts[a:b], w.ends[a:b])] for a, b in zip(w.bounds[:-1], w.bounds[1:])]
    assert got == [t.encode().split() for t in texts]


@pytest.mark.parametrize("k", [4, 5])
def test_near_duplicates_equal_all_pairs(spark, corpus, k):
    docs, texts = corpus
    sets = {i: ({tuple(w[j : j + k]) for j in range(len(w) - k + 1)} or ({tuple(w)} if w else set())) for i, w in ((i, words(t)) for i, t in texts.items())}
    want = components([(a, b) for a, b in combinations(sets, 2) if sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])], sets)
    got = near_dedup.near_duplicates(docs.withColumn("component_id", F.lit("clash")), near_dedup.Setting(k, 80)).collect()
    assert {r["doc_id"]: r["component_id"] for r in got if r["doc_id"] is not None} == want
    assert {r["doc_id"]: r["n_shingles"] for r in got if r["doc_id"] is not None} == {i: len(s) for i, s in sets.items()}
    assert all(r["kept"] == (r["doc_id"] is None or want[r["doc_id"]] == r["doc_id"]) for r in got)
    assert len(got) == docs.count()


def test_near_duplicates_link_beyond_hubs(spark, monkeypatch):
    """A chain of edits: the ends are unlike, so only pairs away from the hub hold it together."""
    r, w, rows = random.Random(2), prose(random.Random(1), 200).split(), []
    for i in range(30):
        rows.append((i, " ".join(w)))
        for j in range(3):
            w[(7 * i + 61 * j) % 200] = f"n{i}x{j}"
    r.shuffle(rows)
    sets = {i: {tuple(t.split()[j : j + 5]) for j in range(196)} for i, t in rows}
    want = components([(a, b) for a, b in combinations(sets, 2) if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])], sets)
    monkeypatch.setattr(near_dedup, "BLOCK", 4)
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {x["doc_id"]: x["component_id"] for x in got} == want


def test_bands_come_from_the_kept_signatures():
    r = random.Random(2)
    batch = pa.RecordBatch.from_arrays([pa.array([prose(r, 60) for _ in range(20)]), pa.array(range(20), pa.int64())], names=["text", "doc_id"])
    for out in near_dedup._scan(5)([batch]):
        keys = kernel.signed(near_dedup.band_keys(near_dedup._matrix(out["sig"])))
        assert out["bands"].to_pylist() == keys.tolist()


def test_sequential_test_keeps_pairs_at_the_threshold():
    least, r = near_dedup.least_matches(80), np.random.default_rng(4)
    n = near_dedup.BANDS * near_dedup.ROWS
    a = r.integers(0, 60000, (4000, n)).astype(np.uint16)
    same = r.random((4000, n)) < 0.8
    assert near_dedup.survives(a, np.where(same, a, a ^ 1), least).mean() > 0.999
    assert near_dedup.survives(a, np.where(r.random((4000, n)) < 0.3, a, a ^ 1), least).mean() < 0.001


def test_repeated_passages_cover_all_shared_windows(spark, corpus):
    docs, texts = corpus
    rows = substring.repeated_passages(docs).collect()
    covered = collections.defaultdict(set)
    for r in rows:
        assert r["other_id"] < r["doc_id"] and r["n_words"] >= 50
        covered[r["doc_id"]] |= set(range(r["first_word"], r["end_word"]))
    seen, need = {}, collections.defaultdict(list)
    for i in sorted(texts):
        w = words(texts[i])
        own = [tuple(w[j : j + 50]) for j in range(len(w) - 49)]
        for j, g in enumerate(own):
            if g in seen:
                need[i].append(set(range(j, j + 50)))
        seen.update({g: i for g in own if g not in seen})
    # a passage found against one earlier copy may end a shingle short of one shared with another
    assert need and all(len(w & covered[i]) >= 45 for i in need for w in need[i])
    assert not set(covered) & set(range(40)), "clean documents stay alone"


def found_in(spark, texts):
    rows = substring.repeated_passages(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    return sorted((x["other_id"], x["doc_id"], x["n_words"]) for x in rows)


@pytest.mark.parametrize("seed", [6, 11, 24])
def test_passages_beyond_a_hub_that_is_not_similar(spark, monkeypatch, seed):
    r = random.Random(seed)
    phrase = prose(r, 44)
    passage = f"{prose(r, 3)} {phrase} {prose(r, 3)}"
    texts = [f"{prose(r, 60)} {phrase} {prose(r, 60)}", *(f"{prose(r, 10)} {passage} {prose(r, 10)}" for _ in range(2))]
    assert found_in(spark, texts) == [(1, 2, 50)]
    monkeypatch.setattr(substring, "SMALL", 1)
    assert found_in(spark, texts) == [(1, 2, 50)]


@pytest.mark.parametrize("seed", [1, 2])
def test_overlapping_copies_of_a_found_passage(spark, monkeypatch, seed):
    r = random.Random(seed)
    w = prose(r, 80).split()
    one, two, three = " ".join(w[:60]), " ".join(w), " ".join(w[20:])
    texts = [f"{prose(r, 30)} {one} {prose(r, 30)}", f"{prose(r, 30)} {two} {prose(r, 30)}", f"{prose(r, 30)} {three} {prose(r, 30)}"]
    assert found_in(spark, texts) == [(0, 1, 60), (1, 2, 60)]
    monkeypatch.setattr(substring, "SMALL", 1)
    assert found_in(spark, texts) == [(0, 1, 60), (1, 2, 60)]


@pytest.mark.parametrize("levels", [substring.LEVELS, ()])
def test_groups_of_a_common_phrase(spark, monkeypatch, levels):
    """A phrase under the length in all texts, a few passages around it in two texts each, exact and edited; by levels, and by the last rounds alone."""
    monkeypatch.setattr(substring, "SMALL", 2)
    monkeypatch.setattr(substring, "LEVELS", levels)
    monkeypatch.setattr(substring, "HUBS", 16 if levels else 64)
    r = random.Random(8)
    phrase, texts, want = prose(r, 36), [], []
    for i in range(24):
        if i % 4 == 3:
            passage = f"{prose(r, 14)} {phrase} {prose(r, 14)}"
            edited = passage.split()
            edited[2] = "edited"
            texts += [f"{prose(r, 30)} {passage} {prose(r, 20)}", f"{prose(r, 5)} {' '.join(edited) if i % 8 == 7 else passage} {prose(r, 30)}"]
            want.append((len(texts) - 2, len(texts) - 1))
        else:
            texts.append(f"{prose(r, 40)} {phrase} {prose(r, 40)}")
    got = found_in(spark, texts)
    assert [x[:2] for x in got] == want and all(n >= 59 for *_, n in got)


def test_pairs_of_a_common_phrase_do_not_grow_with_the_square(spark, monkeypatch):
    """Before it and after it each text has words of two different others, so all that surrounds the phrase is shared, but with no single text."""
    r, tried, plain = random.Random(12), [], substring.cut

    def spy(rows):
        out = plain(rows)
        if out.columns == ["a", "b"]:
            tried.append(out.count())
        return out

    monkeypatch.setattr(substring, "cut", spy)
    phrase, n = prose(r, 24), 48
    before, after = ([prose(r, 14) for _ in range(n // 2)] for _ in range(2))
    texts = [f"{prose(r, 20)} {before[i // 2]} {phrase} {after[(i + 1) // 2 % (n // 2)]} {prose(r, 20)}" for i in range(n)]
    texts.append(f"{prose(r, 9)} {before[5]} {phrase} {after[5]} {prose(r, 9)}")
    got = found_in(spark, texts)
    # 10 has both sides of the last text
    assert [x[:2] for x in got] == [(10, n)] and sum(tried) < 6 * n


def test_verification_reads_each_text_once(monkeypatch):
    r, read, plain = np.random.default_rng(8), [], substring.Words
    monkeypatch.setattr(substring, "Words", lambda *args: read.append(1) or plain(*args))
    text = lambda n: [f"w{i}" for i in r.integers(0, 10**9, n)]
    p, q = text(60), text(45)
    # one and three share 60 words, one and four 45, which are too few
    texts = [zstandard.compress(" ".join(x).encode()) for x in (text(30) + p + q, text(90), text(20) + p + text(9), q + text(50))]
    pairs = [(a, b, 7, texts[a], texts[b]) for a in (0, 1) for b in (2, 3)]
    batch = pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*pairs, strict=True)], names=["a", "b", "mark", "one", "two"])
    got = [tuple(x.values()) for out in substring._verify(50, 5, 80)(iter([batch])) for x in out.to_pylist()]
    assert got == [(2, 20, 80, 60, 0, 30, 90, 7)]
    # later texts used to be read once a pair
    assert len(read) == 4


def test_one_choice_of_functions_each():
    for functions, n in substring.LEVELS:
        for root in range(substring.FIRST):
            own = substring.choices(root, functions, n)
            assert len({frozenset(c) for c in own}) == n and all(len(set(c)) == functions and root not in c for c in own)


def test_passages_of_texts_that_repeat_themselves():
    r = np.random.default_rng(5)
    lost = 0
    for n in range(200):
        lines = [r.integers(1, 1 << 60, int(r.integers(8, 40))).astype(np.uint64) for _ in range(6)]
        text = lambda k: np.concatenate([lines[i] if r.random() < 0.7 else r.integers(1, 1 << 60, 12).astype(np.uint64) for i in r.integers(0, 6, k)])
        a, b = text(14), text(9)
        if n % 2:
            # the first half of the passage also stands far away in a
            p = r.integers(1, 1 << 60, 56).astype(np.uint64)
            other = [r.integers(1, 1 << 60, 90).astype(np.uint64) for _ in range(5)]
            a, b = np.concatenate([p[:28], other[0], other[1], p, other[2]]), np.concatenate([other[3], p, other[4]])
        grams = {tuple(a[i : i + 50].tolist()) for i in range(len(a) - 49)}
        need = [j for j in range(len(b) - 49) if tuple(b[j : j + 50].tolist()) in grams]
        got = substring.passages(a, b, 50, 5, 80)
        covered = {i for s, e, *_ in got for i in range(s, e)}
        assert all(set(range(j, j + 50)) <= covered for j in need), n
        lost += bool(need)
        for s, e, low, high in got:
            one, two = ({tuple(x[i : i + 5].tolist()) for i in range(f, t - 4)} for x, f, t in ((b, s, e), (a, low, high)))
            assert e - s >= 50 and 100 * len(one & two) >= 80 * len(one | two)
    assert lost > 100


def test_edited_passages_are_candidates():
    r = np.random.default_rng(17)
    n, both = 2_000, 0

    def keys(words):
        raw = " ".join(f"w{x}" for x in words).encode()
        t = substring.Texts(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]), 50, 5)
        own = set()
        for f in range(substring.FIRST):
            text, key, place = t.roots(f)
            for k, side in zip(key.tolist(), t.beside(text, place, 5).tolist()):
                own |= ({(k, 0, side >> 16)} if side >> 16 else set()) | ({(k, 1, side & 0xFFFF)} if side & 0xFFFF else set())
        return own

    for _ in range(n):
        a = r.integers(1, 1 << 60, 50).astype(np.uint64)
        b = a.copy()
        b[r.integers(5, 45)] = 7  # 41 of 51 shingles stay
        assert substring.passages(a, b, 50, 5, 80) == [(0, 50, 0, 50)]
        both += bool(keys(a) & keys(b))
    assert both >= 0.997 * n


def test_removing_repeats_keeps_the_rest(spark, corpus):
    docs, texts = corpus
    left = {r["doc_id"]: r for r in substring.remove_repeats(docs).collect()}
    assert left[0]["text"] == texts[0] and left[None]["lang"] is None
    later = [i for i in range(53, 57)]
    assert all(60 <= len(left[i]["text"].split()) <= 64 and left[i]["n_chars"] == len(left[i]["text"]) for i in later)
    assert 57 not in left or len(words(texts[2])) < 50


def test_removing_repeats_judges_texts_and_not_ids(spark):
    r = random.Random(4)
    a, u = prose(r, 100), prose(r, 100)
    rows = [(0, a, 1, "x"), (1, a, 2, "y"), (1, u, 3, "z"), (None, a, 4, "n"), (2, None, 5, "e"), (2, "", 6, "e"), (1, u, 3, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, __1 long, __3 string")
    left = sorted(map(tuple, substring.remove_repeats(docs).collect()), key=repr)
    assert left == sorted([x for x in rows if x[2] != 2], key=repr)
    assert substring.remove_repeats(docs.limit(0)).count() == 0


def test_compact_windows_are_wide_cartesian_nodes():
    r = np.random.default_rng(1)
    x, bounds, least = kernel.mix(r.integers(0, 1 << 60, 300).astype(np.uint64)), np.array([0, 120, 300]), 20
    starts, l, c, right = substring.compact_windows(x, bounds, 9, least)
    v = kernel.mix(x, 9)
    want = set()
    for lo, hi in zip(bounds[:-1], bounds[1:]):
        todo = [(lo, hi - 1)]
        while todo:
            a, b = todo.pop()
            if b - a + 1 >= least:
                m = a + int(np.argmin(v[a : b + 1]))
                want.add((int(a), m, int(b)))
                todo += [(a, m - 1), (m + 1, b)]
    assert set(zip(l.tolist(), c.tolist(), right.tolist())) == want


def test_contamination_finds_reordered_passages(spark):
    r = random.Random(8)
    items = [(i, prose(r, 40)) for i in range(6)] + [(6, "too short"), (7, None)]
    w = items[2][1].split()
    docs = [(0, prose(r, 200)), (1, prose(r, 20) + " " + items[1][1].upper() + " " + prose(r, 20)), (2, " ".join(w[20:] + ["x"] + w[:20])), (3, " ".join(items[3][1].split()[:12])), (4, None), (5, items[1][1]), (5, items[1][1])]
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = sorted(map(tuple, decontam.contaminated(d, b).collect()))
    assert [(x[0], x[1], x[3]) for x in got] == [(1, 1, 40), (2, 2, 40), (5, 1, 40), (5, 1, 40)]
    assert sorted(map(tuple, decontam.contaminated(d, b, most_words=0).collect())) == got
    assert sorted(r["doc_id"] for r in decontam.drop_contaminated(d, b).collect()) == [0, 3, 4]
    assert decontam.contaminated(d.limit(0), b).count() == 0


def test_tiles_are_greedy_and_disjoint():
    r = np.random.default_rng(6)
    for _ in range(60):
        item, doc = r.integers(0, 4, 20), r.integers(0, 4, 60)
        pairs = [(p, d) for p in range(17) for d in range(57) if (item[p : p + 4] == doc[d : d + 4]).all()]
        if not pairs:
            continue
        got = decontam.tiles(item, doc, np.array([p for p, _ in pairs]), np.array([d for _, d in pairs]), 4)
        mi, md, want = set(), set(), []
        while True:
            best = None
            for p in range(20):
                for d in range(60):
                    n = 0
                    while p + n < 20 and d + n < 60 and item[p + n] == doc[d + n] and p + n not in mi and d + n not in md:
                        n += 1
                    if n >= 4 and (best is None or n > best[2]):
                        best = (p, d, n)
            if not best:
                break
            want.append(best)
            mi |= set(range(best[0], best[0] + best[2]))
            md |= set(range(best[1], best[1] + best[2]))
        assert [t[2] for t in got] == [t[2] for t in want] and got[0] == want[0]


def test_pieces_equal_the_library(spark, corpus):
    sentencepiece = pytest.importorskip("sentencepiece")
    library, model = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL), pieces.load_model()
    texts = ["", "  two  spaces ", "tab\tline\n\nend", "日本語 ünï 😀", "a" * 300, "ab" * 200, "=-" * 90, "x 1234567 y", *[t for t in corpus[1].values() if t][:30]]
    docs = spark.createDataFrame([(i, t, [1]) for i, t in enumerate([*texts, None])], "doc_id long, text string, ids array<int>")
    got = {r["doc_id"]: (r["ids"], r["decoded"]) for r in pieces.decode(pieces.encode(docs, model), model).collect()}
    for i, t in enumerate(texts):
        assert got[i][0] == library.encode(t) and got[i][1] == t
    assert got[len(texts)] == ([], "")


@pytest.mark.parametrize("kind", [None, pieces.UNIGRAM])
def test_exploded_lattice_equals_the_kernel(spark, corpus, kind):
    model = pieces.load_model(kind=kind)
    unit_rows = pieces.units(spark.createDataFrame([("The quick brown fox, jumping! 日x 12",), ("aab abab baab",)], "text string"))
    rows = pieces.lattice_encode(unit_rows, pieces.piece_table(spark, model), model).collect()
    got = {r["unit"]: r["tokens"] for r in rows}
    fold = pieces._viterbi if model.kind == pieces.UNIGRAM else pieces._merge
    assert got == {u: fold(u, model) for u in got} and len(got) == 10
    assert all(r["ids"] == [model.ids.get(p) for p in r["tokens"]] for r in rows)


def test_pieces_of_many_chunks_and_of_none(spark, monkeypatch):
    sentencepiece = pytest.importorskip("sentencepiece")
    library, model = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL), pieces.load_model()
    r = random.Random(3)
    texts = [prose(r, r.randint(0, 80)) for _ in range(60)] + ["a" * 5000, "", None, "same", "same", "x" * 59 + " " + "y" * 61, "\U0010fffe\u2581 z"]
    docs = spark.createDataFrame([(i % 50, t, [2.5], f"b{i}") for i, t in enumerate(texts)], "doc_id long, text string, chunk array<double>, body string")
    monkeypatch.setattr(pieces, "CHUNK", 4_000)
    got = {x["body"]: x for x in pieces.encode(docs, model, decoded="unit").collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        x = got[f"b{i}"]
        assert x["text"] == t and x["doc_id"] == i % 50 and x["chunk"] == [2.5]
        assert x["ids"] == library.encode(t or "") and x["unit"] == (t or "").replace("\u2581", " ")
    assert pieces.encode(docs.limit(0), model).count() == 0
    assert pieces.Decoder(model).decode_all(np.array([model.bytes_[0xE6], 300, 400]), np.array([0, 1, 1, 3])).to_pylist()[0] == "\ufffd"


def test_contamination_judges_rows_alike_for_any_benchmark(spark):
    r = random.Random(9)
    item, other, clean = prose(r, 30), prose(r, 25), prose(r, 40)
    docs = [(1, item, "a"), (1, clean, "b"), (None, item, "c"), (2, clean, "d"), (None, clean, "e"), (3, None, "f"), (1, item, "a")]
    d = spark.createDataFrame(docs, "doc_id long, text string, __bad string")
    b = spark.createDataFrame([(0, item), (None, item), (5, other), (5, None)], "item_id long, text string")
    small, large = (sorted(map(tuple, decontam.contaminated(d, b, most_words=n).collect()), key=repr) for n in (10_000, 0))
    assert small == large and len(small) == 6
    left = [sorted(map(tuple, decontam.drop_contaminated(d, b, most_words=n).collect()), key=repr) for n in (10_000, 0)]
    assert left[0] == left[1] == sorted([x for x in docs if x[1] != item], key=repr)


def test_context_tree_equals_brute_force(spark, monkeypatch):
    r = random.Random(5)
    texts = {i: prose(r, r.randint(0, 40)) for i in range(20)}
    texts[20] = None
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {x["doc_id"]: x for x in lm.score_texts(docs).collect()}
    depth, counts, held = lm.DEPTH, collections.defaultdict(lambda: [0, 0]), {i: zlib.crc32(str(i).encode()) % 5 == 1 for i in texts}

    def bits(t):
        b = b"\n" * depth + lm.normal((t or "").encode())
        for j in range(depth, len(b)):
            node = 1
            for k in range(7, -1, -1):
                bit = b[j] >> k & 1
                yield [(d, b[j - d : j], node) for d in range(depth + 1)], bit
                node = 2 * node + bit

    for i, t in texts.items():
        if not held[i]:
            for chain, bit in bits(t):
                for key in chain:
                    counts[key][bit] += 1
    kids = collections.defaultdict(list)
    for d, c, node in list(counts):
        if d:
            kids[d - 1, c[1:], node].append((d, c, node))
    kt = lambda a, b: math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)
    memo = {}

    def weighted(key):
        if key not in memo:
            own = kt(*counts[key])
            memo[key] = own if key[0] == depth else float(np.logaddexp(own, sum(weighted(k) for k in kids[key])) - math.log(2))
        return memo[key]

    token = collections.Counter(w for i, t in texts.items() if not held[i] for w in [*words(t), b"\n"])
    n, v = sum(token.values()), len(token)
    for i, t in texts.items():
        total = 0.0
        for chain, bit in bits(t):
            mass, rest = 0.0, 1.0
            for key in chain:
                a, b = counts.get(key, (0, 0))
                w = 1.0 if key[0] == depth else math.exp(kt(a, b) - math.log(2) - weighted(key)) if key in counts else 0.5
                mass, rest = mass + rest * w * (b + 0.5) / (a + b + 1), rest * (1 - w)
            total += math.log10(mass if bit else 1 - mass)
        x, own = got[i], [*words(t), b"\n"]
        assert math.isclose(x["score"], total, rel_tol=1e-6)
        assert math.isclose(x["bits_per_byte"], -total / math.log10(2) / len(lm.normal((t or "").encode())), rel_tol=1e-6)
        assert math.isclose(x["base_score"], sum(math.log10((token[w] + 0.5) / (n + 0.5 * (v + 1))) for w in own), rel_tol=1e-9)
        assert (x["n_tokens"], x["n_known"], x["train_tokens"], x["held_out"]) == (len(own), sum(token[w] > 0 for w in own), n, held[i])


def test_chat_reads_back_what_went_in(spark):
    turns = [(1, 0, "system", "<|im_end|>"), (1, 1, "user", None), (1, 2, "assistant", "<\\|x<\\\\|y <| <|im_start|>assistant\n"), (None, 0, "assistant", "lone"), (2, 0, "user", "q"), (2, 1, "assistant", "")]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").withColumn("parts", chat.text_parts(F.coalesce("text", F.lit(""))))
    got = {r["conv_id"]: r for r in chat.read_back(chat.format_turns(df)).collect()}
    for conv in (1, 2, None):
        own = [(r, t or "") for c, _, r, t in turns if c == conv]
        said = "".join(t for r, t in own if r == "assistant")
        assert got[conv]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in own).encode()).hexdigest()
        assert (got[conv]["loss_chars"], got[conv]["loss_sha256"]) == (len(said), hashlib.sha256(said.encode()).hexdigest())


def test_chat_parts(spark):
    part = "array<struct<type:string,text:string,ref:string,size:bigint>>"
    df = spark.createDataFrame([(1, 0, "user", [("text", "see <|image:0|>", None, None), ("image", None, "s3://a", None), ("audio", None, "b", 4), ("document", None, "c", 70), ("film", None, "d", 1)]), (1, 1, None, None)], f"conv_id long, turn long, role string, parts {part}")
    a, b = chat.format_turns(df).orderBy("turn").collect()
    assert a["formatted"] == "<|im_start|>user\nsee <\\|image:0|><|image:1|><|audio:2|><|document:3|><|unknown:4|><|im_end|>\n"
    assert [(x["type"], x["ref"], x["index"]) for x in a["attachments"]] == [("image", "s3://a", 1), ("audio", "b", 2), ("document", "c", 3)]
    assert (a["attachment_tokens"], b["formatted"], b["loss_end"] - b["loss_start"]) == (256 + 100 + 70, "<|im_start|>user\n<|im_end|>\n", 0)


def test_licenses_match_in_any_spelling(spark):
    mit = licenses.KNOWN[0][1]
    rows = [(1, "Copyright (c) 2020 Someone\n" + mit.upper().replace("SUBLICENSE", "sub-license").replace(" ", " \t ")), (2, mit + " extra"), (3, "prose\nReleased under the MIT Licence!\nmore"), (4, None), (5, ""), (3, "prose\nReleased under the MIT Licence!\nmore")]
    got = sorted((r["doc_id"], r["license"], r["notices"]) for r in licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string").withColumn("license", F.lit("clash")), licenses.known_licenses(spark)).collect())
    assert got == [(1, "MIT", ""), (2, None, ""), (3, None, "MIT"), (3, None, "MIT"), (4, None, ""), (5, None, "")]
    assert all(any(m in body.lower() for m in licenses.MARKS) for _, body in licenses.KNOWN)


BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
%s
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""


def test_whole_licence_texts_are_known(spark):
    clause = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
    rows = [(1, "BSD 3-Clause License\n\nCopyright (c) 2021, Someone\n\n" + BSD % clause), (2, "Copyright 2021 Someone\n" + BSD % ""), (3, BSD % "x")]
    got = {r["doc_id"]: r["license"] for r in licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string"), licenses.known_licenses(spark)).collect()}
    assert got == {1: "BSD-3-Clause", 2: "BSD-2-Clause", 3: None}
    names = {n for n, _ in licenses.DIGESTS}
    assert {"Apache-2.0", "GPL-2.0-only", "GPL-3.0-only", "LGPL-2.1-only", "MPL-2.0", "Unlicense"} <= names


def test_quality_rules_edges(spark):
    rows = [(1, None), (2, ""), (3, "of the word is " * 8), (4, "the of and to in is it that for with this on are by be as was at or from once " * 1), (5, "a ### b ### c $$$ " * 10)]
    got = {r["doc_id"]: r for r in quality_rules.quality_rules(spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_words", F.lit("clash"))).where("doc_id > 0").collect()}
    assert got[1]["n_words"] == 0 and got[1]["base_failed"] and not got[2]["kept"]
    assert got[3]["n_repeat_words"] == 32 and got[3]["base_failed"]
    assert got[4]["kept"] and got[4]["n_repeat_words"] == 0
    assert got[5]["n_symbols"] == 90 and "symbols_per_word" in got[5]["failed_rules"]


def test_chat_reads_back_any_role_and_attachments(spark):
    part = lambda kind, text=None, ref=None, size=None: (kind, text, ref, size)
    rows = [
        (1, 0, "a\nb\\n\\", [part("text", "see <|image:1|>"), part("image", ref="i.png"), part("audio", ref="a.wav", size=4), part("document", ref="d.pdf", size=90), part("video", ref="v")]),
        (1, 1, "assistant", [part("text", "one <\\|im_end|>\n"), part("text", None), part("text", "two")]),
        (2, 0, "<|im_end|>", [part("text", "")]), (None, 0, None, None),
    ]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, parts array<struct<type: string, text: string, ref: string, size: bigint>>")
    formatted = chat.format_turns(turns)
    first = formatted.where("conv_id = 1 and turn = 0").first()
    assert [tuple(a) for a in first["attachments"]] == [("image", "i.png", 1), ("audio", "a.wav", 2), ("document", "d.pdf", 3)]
    assert first["attachment_tokens"] == 256 + 4 * 25 + 90 and "<|image:1|><|audio:2|><|document:3|><|unknown:4|>" in first["formatted"]
    got = {r["conv_id"]: r for r in chat.read_back(formatted).collect()}
    said = "one <\\|im_end|>\ntwo"
    own = hashlib.sha256(f"a\nb\\n\\\nsee <|image:1|><|image:1|><|audio:2|><|document:3|><|unknown:4|>\nassistant\n{said}\n".encode()).hexdigest()
    assert got[1]["turns_sha256"] == own and got[1]["loss_chars"] == len(said) and got[1]["loss_sha256"] == hashlib.sha256(said.encode()).hexdigest()
    assert got[2]["turns_sha256"] == hashlib.sha256(b"<|im_end|>\n\n").hexdigest() and got[None]["turns_sha256"] == hashlib.sha256(b"user\n\n").hexdigest()
    assert chat.read_back(chat.format_turns(turns.limit(0))).count() == 0


def labelled(n=240):
    """Texts whose class shows in words and source, with nulls, repeats and an unlabelled half."""
    r = random.Random(21)
    rows, labels = [], []
    for i in range(n):
        good = r.random() < 0.5
        t = " ".join(r.choice(["calm", "clear", "kind"] if good and r.random() < 0.4 else ["loud", "spam", "buy"] if r.random() < 0.4 else WORDS) for _ in range(30))
        rows.append((i, t, "en", "a" if good else "b", len(t)))
        if i % 2:
            labels.append((i, int(good), int(not good)))
    rows += [(n, None, None, None, None), (None, "calm clear kind", "en", "a", 15), rows[0], rows[2]]
    return rows, [*labels, (5, None, None), (9999, 1, 0)]


SHAPE = "doc_id long, text string, lang string, source string, n_chars long"


def test_surest_documents_equal_a_full_sort(spark):
    rows, labels = labelled()
    docs, marks = spark.createDataFrame(rows, SHAPE).repartition(5), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    base = quality_classifier._carried(docs)
    kept = {"source": "string", "lang": "string", "n_chars": "bigint", "n_lines": "bigint"}
    known = linear.sample(base, marks.select("doc_id", "quality").where("quality is not null"), 60, kept | {"quality": "int"})
    y, fold = np.array([x["quality"] for x in known], float), linear.folds(known)
    meta = np.array(quality_classifier._meta(*([x[c] for x in known] for c in kept)))
    models = [quality_classifier._Model(known, y, fold != k, meta) for k in (0, 1, 99)]
    ids = np.array([x["doc_id"] for x in known])
    got = collections.defaultdict(set)
    for x in quality_classifier._surest(base, models, ids, 7):
        got[x["model"], x["view"], x["label"]].add((x["doc_id"], round(x["sure"], 9)))
    batch = pa.RecordBatch.from_pylist([{"text": t or "", "doc_id": i} for i, t, *_ in rows])
    (_, hashes, bounds, shapes), = linear.presence(batch)
    features = np.array(quality_classifier._meta([x[3] for x in rows], [x[2] for x in rows], [x[4] for x in rows], [1] * len(rows)))
    for m, model in enumerate(models):
        for v, x in enumerate((np.hstack([linear.hits(hashes, bounds, model.words), shapes]), features)):
            z = linear.logits(x, model.train(v))
            for label, score in ((1, z), (0, -z)):
                want = sorted({(-round(float(p), 9), i[0]) for p, i in zip(score, rows) if i[0] is not None and i[0] not in ids and p > math.log(19)})[:7]
                assert got[m, v, label] == {(i, -p) for p, i in want}


def test_models_of_a_fold_have_not_seen_it(spark):
    rows, labels = labelled()
    docs = spark.createDataFrame(rows, SHAPE)
    both = []
    for swap in (False, True):
        marks = spark.createDataFrame([(i, a, 1 - b if swap and i % 10 == 1 and b is not None else b) for i, a, b in labels], "doc_id long, quality int, toxic int")
        known = linear.sample(docs, marks.select("doc_id", F.coalesce("toxic", F.lit(0)).alias("toxic")), 1000, {"toxic": "int"})
        y, fold = np.array([x["toxic"] for x in known], float), linear.folds(known)
        keep = fold != fold[[x["doc_id"] for x in known].index(1)]
        assert not any(x["doc_id"] % 10 == 1 for x, k in zip(known, keep) if k)
        words, x = toxicity._features(known, {"toxic": y}, keep)
        both.append((words.tolist(), linear.fit(x[keep], y[keep]).tolist()))
    assert both[0] == both[1]


def test_classifiers_of_empty_tables(spark):
    rows, labels = labelled()
    docs, marks = spark.createDataFrame(rows, SHAPE), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    none = marks.limit(0)
    for op in (toxicity.toxicity, quality_classifier.quality_classifier):
        assert op(docs.limit(0), marks).count() == 0
        assert op(docs, none).count() == len(rows)
    assert {r["p_quality"] for r in quality_classifier.quality_classifier(docs, none).collect()} == {0.5}


def test_chain_and_views_learn(spark):
    r = random.Random(7)
    rows, labels = [], []
    for i in range(400):
        toxic, good = i % 5 == 0, i % 3 != 0
        t = prose(r, 40)
        t = t if good else t.upper().replace(" ", " ### ")
        rows.append((i, t + (" vilified scoundrel" if toxic else ""), "en", "a" if good else "b", len(t)))
        if i % 2 == 0:
            labels.append((i, int(good), int(toxic)))
    docs = spark.createDataFrame([*rows, (900, None, None, None, None)], "doc_id long, text string, lang string, source string, n_chars long")
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    scored = {x["doc_id"]: x for x in toxicity.toxicity(docs, lab).collect()}
    assert sum(scored[i]["flagged"] == (i % 5 == 0) for i in range(400)) >= 396 and len(scored) == 401 and not scored[900]["flagged"]
    judged = {x["doc_id"]: x for x in quality_classifier.quality_classifier(docs, lab).collect()}
    assert sum(judged[i]["kept"] == (i % 3 != 0) for i in range(400)) >= 396 and 900 in judged
    assert toxicity.toxicity(docs, lab.limit(0)).where("flagged").count() == 0
    assert quality_classifier.quality_classifier(docs, lab.limit(0)).where("not kept").count() == 0


def test_empty_tables(spark, corpus):
    none = corpus[0].limit(0)
    assert near_dedup.near_duplicates(none).count() == 0
    assert substring.repeated_passages(none).count() == 0
    assert lm.score_texts(none).count() == 0
    assert quality_rules.quality_rules(none).count() == 0
    assert licenses.scan_licenses(none, licenses.known_licenses(spark)).count() == 0


def test_pipeline_against_brute_force(spark):
    """Stage by stage over the smallest tables: exact sets where a rule is exact, windows and coverage where a method finds passages."""
    import corpus_pipeline

    sentencepiece = pytest.importorskip("sentencepiece")
    duck = connect(DATA)
    docs = spark.read.parquet(f"{DATA}/documents.parquet").cache()
    shape, items = docs.columns, [words(t) for (t,) in duck.execute("select text from benchmark").fetchall()]
    frames = [{r["doc_id"]: r for r in docs.collect()}]
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, DATA).cache()
        frames.append({r["doc_id"]: r for r in docs.collect()})
        assert docs.count() == len(frames[-1]) and (len(frames) == 6 or docs.columns == shape)
    start, good, single, cut, clean, coded = frames
    assert set(good) == {r[0] for r in duck.execute(f"select doc_id from ({sql.ORACLE['op2_quality_rules']}) where kept").fetchall()}

    grams = {i: {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} for i, r in good.items() if (w := words(r["text"]))}
    edges = [(a, b) for a, b in combinations(sorted(grams), 2) if 100 * len(grams[a] & grams[b]) >= 80 * len(grams[a] | grams[b])]
    first = components(edges, good)
    assert set(single) == {i for i in good if first[i] == i} and all(single[i]["text"] == good[i]["text"] for i in single)

    windows = lambda w: {tuple(w[j : j + 50]) for j in range(len(w) - 49)}
    seen = set()
    for i in sorted(single):
        own = windows(words(single[i]["text"]))
        left = words(cut[i]["text"]) if i in cut else []
        assert not windows(left) & seen
        if not grams[i] & set().union(*(grams[j] for j in single if j < i), set()):
            assert cut[i]["text"] == single[i]["text"]
        if i in cut:
            assert cut[i]["n_chars"] == (len(cut[i]["text"]) if cut[i]["text"] != single[i]["text"] else single[i]["n_chars"])
        seen |= own

    fives = lambda w: {tuple(w[j : j + 5]) for j in range(len(w) - 4)}
    for i, r in cut.items():
        own, text = fives(words(r["text"])), b" " + b" ".join(words(r["text"])) + b" "
        if any(len(x) >= 5 and b" " + b" ".join(x) + b" " in text for x in items):
            assert i not in clean
        if not any(own & fives(x) for x in items):
            assert i in clean and clean[i]["text"] == r["text"]
    library = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    assert set(coded) == set(clean) and all(coded[i]["ids"] == library.encode(r["text"]) for i, r in clean.items())


@pytest.mark.parametrize("name", sorted(sql.ORACLE))
def test_query_equals_sql(spark, name):
    assert_same(queries.QUERIES[name](spark, DATA), connect(DATA), sql.ORACLE[name])


def test_pipeline_stages(spark):
    import corpus_pipeline as cp

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns, n = docs.columns, docs.count()
    for i, (_, stage) in enumerate(cp.STAGES):
        docs = stage(spark, docs, DATA).cache()
        assert docs.count() <= n and (i == 4 or docs.columns == columns)
        n = docs.count()
    assert n > 100 and docs.where("n_pieces <> size(ids)").count() == 0
