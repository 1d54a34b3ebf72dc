"""Context-tree weighting over bytes, with binary decomposition.

A text is its lower-cased (A-Z) words joined by one space, then a line feed as
its end: the same events as the word model that it is held against. Each byte
is eight binary decisions; for each decision the last 0..D bytes form a chain
of contexts, each with a Krichevsky-Trofimov estimator. The tree weights all
depths: P_w = (P_kt + product of children's P_w) / 2, so the probability of a
bit mixes the estimates along its chain by their posterior weights. Counts come
from the training documents and then stay fixed.

Spark gathers the counts. Texts are packed into chunks once (checkpointed);
each chunk sends its distinct words and (D+1)-grams with their training counts,
and gets back only what it needs: word counts, and each gram's log probability,
worked out by joins and aggregations between the levels of the tree. So neither
the vocabulary nor the tree is ever in one place, and text moves once.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.llm.kernel import SLICE, Words, signed
from newsloom.storage import bounded_batches, cut, release

DEPTH = 4
CHUNK = 28 << 20
#: Bytes whose grams are sorted at once.
SPAN = 1 << 18
END = b"\n"
SCHEMA = "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double, bits_per_byte double"


def held_out(doc_id: int | None) -> bool:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % 5 == 1


def normal(raw: bytes) -> bytes:
    """Lower-cased words joined by one space, and the end."""
    return b" ".join(raw.lower().split()) + END


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of the texts, and the bounds of each text's words; slice by slice."""
    hashes, counts, at = [], [], 0
    while at < len(texts):
        to, size = at, 0
        while to < len(texts) and (to == at or size + len(texts[to]) <= SLICE):
            size += len(texts[to])
            to += 1
        data = b"".join(texts[at:to])
        w = Words(np.frombuffer(data, np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts[at:to]])]).astype(np.int64))
        hashes.append(w.hashes)
        counts.append(w.counts)
        at = to
    none = np.empty(0, np.uint64)
    return np.concatenate([none, *hashes]), np.concatenate([[0], np.cumsum(np.concatenate([np.empty(0, np.int64), *counts]))]).astype(np.int64)


def _spans(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(text, gram) of each byte of the texts, about ``SPAN`` bytes at a time; a gram is the D bytes before, then the byte.

    Each text is led in by D ends, which are context only.
    """
    lead, at = END * DEPTH, 0
    while at < len(texts):
        to, size = at, 0
        while to < len(texts) and (to == at or size + len(texts[to]) <= SPAN):
            size += len(texts[to])
            to += 1
        data = np.frombuffer(b"".join(lead + t for t in texts[at:to]), np.uint8)
        ends = np.cumsum(np.array([len(t) + DEPTH for t in texts[at:to]], np.int64))
        starts = np.concatenate([[0], ends[:-1]]) + DEPTH
        for low in range(DEPTH, len(data), SPAN):
            high = min(low + SPAN, len(data))
            where = np.arange(low, high)
            text = np.searchsorted(ends, where, "right")
            inside = where >= starts[text]
            gram = np.zeros(high - low, np.int64)
            for k in range(DEPTH, -1, -1):
                gram = (gram << 8) | data[low - k : high - k]
            yield at + text[inside], gram[inside]
        at = to


def _summed(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    found, at = np.unique(np.concatenate(keys), return_inverse=True)
    return found, np.bincount(at, np.concatenate(counts).astype(np.float64), len(found)).astype(np.int64)


def count_grams(texts: list[bytes], train: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct grams, sorted, and how often they occur in training texts; memory follows the distinct ones and a span."""
    keys, counts, held = [np.empty(0, np.int64)], [np.empty(0, np.int64)], 0
    for text, gram in _spans(texts):
        found, at = np.unique(gram, return_inverse=True)
        keys.append(found)
        counts.append(np.bincount(at, train[text].astype(np.float64), len(found)).astype(np.int64))
        held += len(found)
        if held > 4 * len(keys[0]) + SPAN:
            one, two = _summed(keys, counts)
            keys, counts, held = [one], [two], 0
    return _summed(keys, counts)


def score_grams(texts: list[bytes], grams: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Sum of the grams' values over each text; the grams are all that occur."""
    order = np.argsort(grams)
    grams, values = grams[order], values[order]
    out = np.zeros(len(texts))
    for text, gram in _spans(texts):
        if len(text):
            found, at = np.unique(gram, return_inverse=True)
            own = values[np.searchsorted(grams, found)]
            first = int(text[0])
            sums = np.bincount(text - first, own[at])
            out[first : first + len(sums)] += sums
    return out


def _gaps(keys: np.ndarray) -> np.ndarray:
    return np.diff(keys, prepend=np.int64(0))


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    packer = zstandard.ZstdCompressor(level=9)

    def packed(ids: list, texts: list[bytes]) -> pa.RecordBatch:
        body = b"".join(texts)
        train = np.array([not held_out(i) for i in ids])
        hashes, bounds = word_hashes(texts)
        words, inverse = np.unique(hashes, return_inverse=True)
        n_words = np.bincount(inverse, np.repeat(train, np.diff(bounds)), len(words)).astype(np.int64)
        del hashes, inverse, bounds
        grams, n_grams = count_grams(texts, train)
        name = zlib.crc32(body) << 31 ^ zlib.crc32(repr(ids).encode())
        columns = {
            "chunk": pa.array([name], pa.int64()), "ids": pa.array([ids], pa.list_(pa.int64())), "lengths": pa.array([[len(t) for t in texts]], pa.list_(pa.int64())),
            "body": pa.array([packer.compress(body)], pa.binary()),
            # keys as gaps, which pack better
            **{n: pa.array([packer.compress(x.astype("<i8").tobytes())], pa.binary()) for n, x in (("words", _gaps(signed(words))), ("n_words", n_words), ("grams", _gaps(grams)), ("n_grams", n_grams))},
        }
        return pa.RecordBatch.from_pydict(columns)

    ids, texts, size = [], [], 0
    for batch in batches:
        for i in range(batch.num_rows):
            ids.append(batch.column(1)[i].as_py())
            texts.append(normal(batch.column(0)[i].as_buffer().to_pybytes()))
            size += len(texts[-1]) + DEPTH
            if size >= CHUNK:
                yield packed(ids, texts)
                ids, texts, size = [], [], 0
    if ids:
        yield packed(ids, texts)


def _unpack():
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened = zstandard.ZstdDecompressor()
        for batch in batches:
            for i in range(batch.num_rows):
                keys, counts = (np.frombuffer(opened.decompress(batch.column(c)[i].as_py()), "<i8") for c in (1, 2))
                keys = np.cumsum(keys)
                for at in range(0, len(keys), 50_000):
                    part = keys[at : at + 50_000]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), batch.column(0)[i].as_py())), pa.array(part), pa.array(counts[at : at + 50_000])], names=["chunk", "key", "n"])

    return run


def _log_gamma(x: Column) -> Column:
    """ln gamma(x) for x >= 0.5: Stirling's series at x + 8, and the product that leads back; correct to about 1e-13."""
    y = x + 8
    series = 1 / (12 * y) - 1 / (360 * y * y * y) + 1 / (1260 * y * y * y * y * y)
    back = F.lit(0.0)
    for k in range(8):
        back = back + F.ln(x + k)
    return (y - 0.5) * F.ln(y) - y + 0.5 * math.log(2 * math.pi) + series - back


def _kt(zeros: Column, ones: Column) -> Column:
    """ln of the Krichevsky-Trofimov probability of so many zeros and ones in any order."""
    return _log_gamma(zeros + 0.5) + _log_gamma(ones + 0.5) - _log_gamma(zeros + ones + 1.0) - math.log(math.pi)


def gram_values(grams: DataFrame, depth: int = DEPTH) -> DataFrame:
    """``gram, value``: ln probability of each gram's byte in its context, from ``gram, n`` with training counts.

    Levels of the tree are tables: each is aggregated from the next deeper one
    on the way up, and joined to the next shallower one on the way down.
    """
    total = grams.groupBy("gram").agg(F.sum("n").alias("n"))
    bits = total.select("gram", "n", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("k")).select(
        "gram", "n", F.shiftright("gram", 8).alias("ctx"),
        F.expr("cast(shiftleft(1, k) | shiftright(cast(gram & 255 as int), 8 - k) as int)").alias("node"),
        F.expr("cast(shiftright(cast(gram & 255 as int), 7 - k) & 1 as int)").alias("bit"),
    )
    levels = {}
    level = (
        bits.groupBy("ctx", "node").agg(F.sum(F.when(F.col("bit") == 0, F.col("n")).otherwise(0)).alias("n0"), F.sum(F.when(F.col("bit") == 1, F.col("n")).otherwise(0)).alias("n1"))
        .withColumn("kt", _kt(F.col("n0").cast("double"), F.col("n1").cast("double"))).withColumn("pw", F.col("kt"))
    )
    levels[depth] = cut(level)
    for d in range(depth - 1, -1, -1):
        below = levels[d + 1].select(F.expr(f"ctx & {(1 << (8 * d)) - 1}L").alias("ctx"), "node", "n0", "n1", "pw")
        level = (
            below.groupBy("ctx", "node").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"), F.sum("pw").alias("split"))
            .withColumn("kt", _kt(F.col("n0").cast("double"), F.col("n1").cast("double")))
            .withColumn("pw", F.greatest("kt", "split") + F.log1p(F.exp(-F.abs(F.col("kt") - F.col("split")))) - math.log(2))
        )
        levels[d] = cut(level)
    one = (F.col("n1") + 0.5) / (F.col("n0") + F.col("n1") + 1.0)
    stop = F.exp(F.col("kt") - math.log(2) - F.col("pw"))
    above = levels[0].select("ctx", "node", (stop * one).alias("mass"), (1 - stop).alias("rest"))
    for d in range(1, depth + 1):
        weight = stop if d < depth else F.lit(1.0)
        own = levels[d].select("ctx", "node", F.expr(f"ctx & {(1 << (8 * (d - 1))) - 1}L").alias("parent"), one.alias("one"), weight.alias("w"))
        above = (
            own.join(above.withColumnsRenamed({"ctx": "parent"}), ["parent", "node"])
            .select("ctx", "node", (F.col("mass") + F.col("rest") * F.col("w") * F.col("one")).alias("mass"), (F.col("rest") * (1 - F.col("w"))).alias("rest"))
        )
    return (
        bits.select("gram", "ctx", "node", "bit").join(above.select("ctx", "node", "mass"), ["ctx", "node"])
        .groupBy("gram").agg(F.sum(F.ln(F.when(F.col("bit") == 1, F.col("mass")).otherwise(1 - F.col("mass")))).alias("value"))
    )


def _score(train_tokens: int, vocabulary: int, train_docs: int):
    unit = train_tokens + 0.5 * (vocabulary + 1)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        opened = zstandard.ZstdDecompressor()
        kind, keys, values = (right[c].to_numpy() for c in ("kind", "key", "value"))
        own = kind == 0
        order = np.argsort(keys[own])
        words, counts = keys[own][order], values[own][order]
        out = []
        for ids, lengths, body in zip(left["ids"].to_pylist(), left["lengths"].to_pylist(), left["body"].to_pylist(), strict=True):
            raw, ends = opened.decompress(body), np.concatenate([[0], np.cumsum(lengths)])
            texts = [raw[s:e] for s, e in zip(ends[:-1], ends[1:], strict=True)]
            hashes, bounds = word_hashes(texts)
            c = counts[np.minimum(np.searchsorted(words, signed(hashes)), max(len(words) - 1, 0))] if len(hashes) else np.empty(0)
            base, known = (np.concatenate([[0], np.cumsum(x)]) for x in (np.log10((c + 0.5) / unit), c > 0))
            scores = score_grams(texts, keys[~own], values[~own]) / math.log(10)
            n = np.diff(bounds)
            out.append(pa.table({
                "doc_id": pa.array(ids, pa.int64()), "held_out": pa.array([held_out(i) for i in ids]), "n_tokens": pa.array(n + 1, pa.int64()),
                "n_known": pa.array(np.diff(known[bounds]).astype(np.int64) + int(train_docs > 0)), "train_tokens": pa.array(np.full(len(ids), train_tokens)),
                "base_score": pa.array(np.diff(base[bounds]) + math.log10((train_docs + 0.5) / unit)), "score": pa.array(scores),
                "bits_per_byte": pa.array(-scores / math.log10(2) / np.asarray(lengths)),
            }))
        return pa.concat_tables(out)

    return run


def score_texts(docs: DataFrame) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte`` for every row.

    ``bits_per_byte`` is the code length per byte of the lower-cased words, joined by one space, and the end.

    Learns from documents whose crc32(doc_id as text) mod 5 isn't 1. Defined
    results: a null or empty text is its end alone; a null doc_id counts as the
    empty text for crc32, so it is trained on; repeated rows count and are
    scored each; an empty table gives an empty one; other columns are left out.
    """
    bounded_batches(docs.sparkSession)
    base = docs.select(F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("text"), F.col("doc_id").cast("bigint").alias("doc_id"))
    chunks = cut(base.mapInArrow(_chunks, "chunk bigint, ids array<bigint>, lengths array<bigint>, body binary, words binary, n_words binary, grams binary, n_grams binary"))
    rows = "chunk bigint, key bigint, n bigint"
    words = chunks.select("chunk", "words", "n_words").mapInArrow(_unpack(), rows)
    grams = chunks.select("chunk", "grams", "n_grams").mapInArrow(_unpack(), rows)
    totals = words.groupBy("key").agg(F.sum("n").alias("c"))
    counted = totals.agg(F.count_if(F.col("c") > 0).alias("v"), F.sum("c").alias("n")).first()
    release(docs.sparkSession)
    train_docs = base.where(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 5 != 1).count()
    n, v = (counted["n"] or 0) + train_docs, (counted["v"] or 0) + (train_docs > 0)
    known = words.join(totals.withColumnRenamed("key", "k"), F.col("key") == F.col("k")).select("chunk", F.lit(0).alias("kind"), "key", F.col("c").cast("double").alias("value"))
    values = cut(gram_values(grams.select(F.col("key").alias("gram"), "n")))
    release(docs.sparkSession)
    valued = grams.join(values, F.col("key") == F.col("gram")).select("chunk", F.lit(1).alias("kind"), "key", "value")
    return (
        chunks.select("chunk", "ids", "lengths", "body").groupBy("chunk")
        .cogroup(known.unionByName(valued).groupBy("chunk"))
        .applyInArrow(_score(n, v, train_docs), SCHEMA)
    )
