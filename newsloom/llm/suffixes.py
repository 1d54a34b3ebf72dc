"""Suffix-array dedup: bytes under a string of ``length`` bytes that starts anywhere else as well are removed.

Texts are packed into compressed chunks once. Every window of ``length`` bytes
has an anchor, the gram of ``GRAM`` bytes in it with the least hash (ties: the
first), so equal windows have equal anchors at equal places. A run of windows
with one anchor is a segment, of ``2 * length - GRAM`` bytes at most. Spark
counts segments by anchor: windows whose anchor occurs once are unique, segments
that occur twice are repeated as they are, and only one of each kind of segment
that shares its anchor with other kinds is sent on. These meet in shards by
anchor, where ``induced.suffix_array`` sorts them with disk-backed queues;
neighbours with ``length`` bytes in common are repeated windows.

Anchors with more than ``CROWD`` kinds of segments, such as a phrase that a third
of all texts has, are split: blocks of ``BLOCK`` windows with the same place to
the anchor are keyed by the bytes that all of them share, and go through the same
counts and shards; blocks that still crowd are split into single windows, where
counting alone decides. So no shard follows the number of rows, nothing is
dropped, and a group of copies is one kind, whatever its size.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.llm.induced import suffix_array
from newsloom.llm.kernel import SLICE, mix, signed, span_hashes
from newsloom.storage import bounded_batches, cut, release, written

LENGTH, GRAM, BLOCK = 400, 200, 16
CHUNK, SHARD, CROWD = 8 << 20, 2 << 20, 2048
#: Bytes of segments for each task that sorts shards.
TASK = 8 << 20
_PLACE = np.uint64((1 << 20) - 1)
_GRAMS, _OWN, _CORE = (mix(np.arange(256, dtype=np.uint64), seed) for seed in (101, 202, 303))
#: A verdict's stop that stands for all windows of the segment.
ALL = -1
VERDICT = "chunk bigint, root bigint, start int, stop int"
PIECE = "chunk bigint, root bigint, offset int, core bigint, own bigint, n bigint, at int, windows int, piece binary"


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """Least of every ``width`` consecutive values."""
    size, row = 1, values
    while 2 * size <= width:
        row = np.minimum(row[:-size], row[size:])
        size *= 2
    n, shift = len(values) - width + 1, width - size
    return np.minimum(row[:n], row[shift : shift + n])


def segments(body: np.ndarray, ends: np.ndarray, length: int, gram: int) -> Iterator[tuple[np.ndarray, ...]]:
    """Start, stop, place of the anchor, anchor and own hash of all segments of some joined texts, ``SLICE`` windows at a time."""
    starts = np.concatenate([[0], ends[:-1]])
    for low in range(0, len(body) - length + 1, SLICE):
        high = min(low + SLICE, len(body) - length + 1)
        data = body[low : high + length - 1]
        one, last = np.searchsorted(ends, [low, high - 1], "right")
        own = slice(one, last + 1)
        limit = np.repeat(ends[own], np.minimum(ends[own], high) - np.maximum(starts[own], low)) - length
        good = np.flatnonzero(np.arange(low, high) <= limit)  # windows that stay within their text
        if not len(good):
            continue
        grams = np.arange(len(data) - gram + 1)
        hashes = span_hashes(_GRAMS[data], grams, grams + gram)
        least = (_least((hashes & ~_PLACE) | grams.astype(np.uint64), length - gram + 1) & _PLACE).astype(np.int64)
        anchor = least[good]
        heads = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (good[1:] != good[:-1] + 1)]))
        tails = np.append(heads[1:], len(good)) - 1
        begin, stop, at = good[heads], good[tails] + length, anchor[heads]
        key = hashes[at]
        yield begin + low, stop + low, at - begin, signed(key), signed(span_hashes(_OWN[data], begin, stop) ^ mix(key, 13))


def _chunks(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = zstandard.ZstdCompressor(level=3)

        def packed(ids: list, texts: list[bytes]) -> pa.RecordBatch:
            body = b"".join(texts)
            name = zlib.crc32(body) << 31 ^ zlib.crc32(repr((ids, [len(t) for t in texts])).encode())
            return pa.RecordBatch.from_pydict({
                "chunk": pa.array([name], pa.int64()), "ids": pa.array([ids], pa.list_(pa.int64())),
                "lengths": pa.array([[len(t) for t in texts]], pa.list_(pa.int64())), "body": pa.array([packer.compress(body)], pa.binary()),
            })

        ids, texts, held = [], [], 0
        for batch in batches:
            for i in range(batch.num_rows):
                ids.append(batch.column(0)[i].as_py())
                texts.append(batch.column(1)[i].as_py())
                held += len(texts[-1]) + 16
                if held >= size:
                    yield packed(ids, texts)
                    ids, texts, held = [], [], 0
        if ids:
            yield packed(ids, texts)

    return run


def _opened(lengths: list[int], body: bytes) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(body), np.uint8), np.cumsum(np.array(lengths, np.int64))


def _index(length: int, gram: int):
    """Kinds of segments of each chunk and how often it has them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, lengths, body in zip(*(batch.column(n).to_pylist() for n in ("chunk", "lengths", "body")), strict=True):
                found = [(core, own) for _, _, _, core, own in segments(*_opened(lengths, body), length, gram)]
                if not found:
                    continue
                core, own = (np.concatenate(x) for x in zip(*found, strict=True))
                kinds, first, n = np.unique(own, return_index=True, return_counts=True)
                for at in range(0, len(kinds), 50_000):
                    part = slice(at, at + 50_000)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(kinds[part]), chunk)), pa.array(core[first[part]]), pa.array(kinds[part]), pa.array(n[part].astype(np.int64))], names=["home", "core", "own", "n"]
                    )

    return run


def _judge(rows: DataFrame) -> DataFrame:
    """``core, own, n, home, kinds, open``: the kinds of pieces whose core occurs more than once, from ``home, core, own, n``.

    One home sends each kind on; a core isn't ``open`` if all its kinds occur more than once.
    """
    kinds = rows.groupBy("core", "own").agg(F.sum("n").alias("n"), F.min("home").alias("home"))
    cores = kinds.groupBy("core").agg(F.count("*").alias("kinds"), F.sum("n").alias("total"), (F.min("n") == 1).alias("open")).where("total > 1")
    return cut(kinds.join(cores.select("core", "kinds", "open"), "core"))


def _sent(length: int, gram: int):
    """The segments of a chunk that its rows on the right ask for, once each."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        asked, times = right["own"].to_numpy(), right["n"].to_numpy()
        order = np.argsort(asked)
        asked, times = asked[order], times[order]
        out, done = [], np.zeros(len(asked), bool)
        for chunk, lengths, body in zip(*(left[n].to_pylist() for n in ("chunk", "lengths", "body")), strict=True):
            if not len(asked):
                continue
            data, ends = _opened(lengths, body)
            for start, stop, at, core, own in segments(data, ends, length, gram):
                where = np.minimum(np.searchsorted(asked, own), len(asked) - 1)
                for i in np.flatnonzero(asked[where] == own):
                    if not done[where[i]]:
                        done[where[i]] = True
                        out.append((chunk, int(own[i]), 0, int(core[i]), int(own[i]), int(times[where[i]]), int(at[i]), int(stop[i] - start[i]) - length + 1, data[start[i] : stop[i]].tobytes()))
        return _pieces(out)

    return run


def _pieces(rows: list[tuple]) -> pa.Table:
    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary())
    columns = zip(*rows, strict=True) if rows else [[]] * len(kinds)
    return pa.Table.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names=[c.split()[0] for c in PIECE.split(", ")])


def _blocks(length: int, step: int):
    """Cuts pieces into runs of at most ``step`` windows by their place to the anchor; the core is what all windows of a whole run share."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at_row in range(0, batch.num_rows, 256):
                out = []
                for r in batch.slice(at_row, 256).to_pylist():
                    data = np.frombuffer(r["piece"], np.uint8)
                    group = (r["at"] - np.arange(r["windows"])) // step  # falls from window to window
                    heads = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
                    stops = np.append(heads[1:], len(group))
                    # a whole run begins its windows at anchor - step * group - step + 1 .. anchor - step * group
                    late = r["at"] - step * group[heads]
                    cores = signed(mix(span_hashes(_CORE[data], late, late - step + 1 + length) ^ group[heads].astype(np.uint64), step) ^ mix(np.array([r["core"]], np.int64).view(np.uint64), 17))
                    owns = signed(span_hashes(_OWN[data], heads, stops - 1 + length))
                    out += [
                        (r["chunk"], r["root"], r["offset"] + int(h), int(c), int(o), r["n"], r["at"] - int(h), int(s - h), r["piece"][h : s - 1 + length])
                        for h, s, c, o in zip(heads, stops, cores, owns, strict=True)
                    ]
                yield from _pieces(out).to_batches()

    return run


def _shards(length: int, most: int):
    """Sorts runs of whole groups (rows come ordered by core), and returns the repeated windows of pieces that occur once."""

    def solved(rows: list[dict]) -> pa.RecordBatch:
        data = np.zeros(sum(len(r["piece"]) + 1 for r in rows) + 1, np.int32)
        starts, at = [], 0
        for r in rows:
            size = len(r["piece"])
            data[at : at + size] = np.frombuffer(r["piece"], np.uint8)
            data[at : at + size] += 2
            data[at + size] = 1
            starts.append(at)
            at += size + 1
        order, common = suffix_array(data)
        alike = common >= length
        alike[:-1] |= alike[1:]
        hit = np.zeros(len(data) + 1, bool)
        hit[order[alike]] = True
        del order, common, alike
        found = ([], [], [], [])
        for r, s in zip(rows, starts, strict=True):
            own = hit[s : s + r["windows"]]
            if r["n"] > 1 or not own.any():
                continue
            edges = np.flatnonzero(np.diff(np.concatenate([[0], own.view(np.int8), [0]])))
            for low, high in zip(edges[::2], edges[1::2], strict=True):
                for column, value in zip(found, (r["chunk"], r["root"], r["offset"] + int(low), r["offset"] + int(high)), strict=True):
                    column.append(value)
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(found, (pa.int64(), pa.int64(), pa.int32(), pa.int32()), strict=True)], names=["chunk", "root", "start", "stop"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        for batch in batches:
            for r in batch.to_pylist():
                if size >= most and r["core"] != rows[-1]["core"]:
                    yield solved(rows)
                    rows, size = [], 0
                rows.append(r)
                size += len(r["piece"])
        if rows:
            yield solved(rows)

    return run


def _sorted(pieces: DataFrame, tasks: int, length: int) -> DataFrame:
    return pieces.repartition(tasks, "core").sortWithinPartitions("core").mapInArrow(_shards(length, SHARD), VERDICT)


def _tasks(asked: DataFrame, size: int) -> int:
    parts = int(asked.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(parts, asked.count() * size // TASK)


def _whole(rows: DataFrame, found: DataFrame, *columns: Column) -> DataFrame:
    """The rows whose piece occurs more than once."""
    return rows.join(found.where("n > 1").select("core", "own"), ["core", "own"]).select(*columns)


def _crowded(crowd: DataFrame, length: int) -> DataFrame:
    """Repeated windows of the segments of crowded anchors."""
    home = F.struct("chunk", "root", "offset").alias("home")
    span = (F.col("home.chunk").alias("chunk"), F.col("home.root").alias("root"), F.col("home.offset").alias("start"), (F.col("home.offset") + F.col("windows")).alias("stop"))
    blocks = crowd.mapInArrow(_blocks(length, BLOCK), PIECE)
    rows = blocks.select(home, "core", "own", "n", "windows")
    found = _judge(rows)
    mine = found.where("kinds > 1 and open").select("core", "own", F.col("home").alias("sender"), F.col("n").alias("times"), "kinds")
    asked = blocks.join(mine, ["core", "own"]).where(F.struct("chunk", "root", "offset") == F.col("sender")).withColumn("n", F.col("times"))
    names = [c.split()[0] for c in PIECE.split(", ")]
    single = asked.where(F.col("kinds") > CROWD).select(*names).mapInArrow(_blocks(length, 1), PIECE).select(home, "core", "own", "n", "windows")
    tasks = _tasks(found.where(F.col("open") & F.col("kinds").between(2, CROWD)), length + BLOCK)
    return (
        _whole(rows, found, *span).unionByName(_sorted(asked.where(F.col("kinds") <= CROWD).select(*names), tasks, length))
        .unionByName(_whole(single, _judge(single), *span))
    )


def _removed(length: int, gram: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        roots, start, stop = (right[c].to_numpy() for c in ("root", "start", "stop"))
        order = np.argsort(roots, kind="stable")
        roots, start, stop = roots[order], start[order], stop[order]
        out = []
        for ids, lengths, body in zip(*(left[n].to_pylist() for n in ("ids", "lengths", "body")), strict=True):
            data, ends = _opened(lengths, body)
            lows, highs = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
            for first, last, _, _, own in segments(data, ends, length, gram) if len(roots) else ():
                one, two = np.searchsorted(roots, own, "left"), np.searchsorted(roots, own, "right")
                n = two - one
                each = np.repeat(one, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                base = np.repeat(first, n)
                lows.append(base + start[each])
                highs.append(np.where(stop[each] == ALL, np.repeat(last, n), base + stop[each] - 1 + length))
            low, high = np.concatenate(lows), np.concatenate(highs)
            order = np.argsort(low, kind="stable")
            low, high = low[order], high[order]
            text = np.searchsorted(ends, low, "right")
            reach = np.maximum.accumulate(high)
            heads = np.flatnonzero(np.concatenate([[True], (low[1:] > reach[:-1]) | (text[1:] != text[:-1])])) if len(low) else np.empty(0, np.int64)
            low, text, high = low[heads], text[heads], reach[np.append(heads[1:], len(reach)) - 1] if len(heads) else high
            bounds = np.searchsorted(text, np.arange(len(ids) + 1))
            begin = np.concatenate([[0], ends[:-1]])
            spans, kept = [], []
            for i in range(len(ids)):
                mine = [(int(a - begin[i]), int(b - begin[i])) for a, b in zip(low[bounds[i] : bounds[i + 1]], high[bounds[i] : bounds[i + 1]], strict=True)]
                own = data[begin[i] : ends[i]]
                edges = [0, *(x for span in mine for x in span), len(own)]
                kept.append(b"".join(own[a:b].tobytes() for a, b in zip(edges[::2], edges[1::2], strict=True)))
                spans.append([{"start": a, "stop": b} for a, b in mine])
            out.append(pa.table({
                "doc_id": pa.array(ids, pa.int64()), "n_bytes": pa.array(lengths, pa.int64()), "kept": pa.array(kept, pa.binary()),
                "spans": pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))),
            }))
        return pa.concat_tables(out) if out else pa.table({"doc_id": pa.array([], pa.int64()), "n_bytes": pa.array([], pa.int64()), "kept": pa.array([], pa.binary()), "spans": pa.array([], pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())])))})

    return run


def remove_repeated_strings(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """``doc_id, n_bytes, kept, spans`` of every row: what is left of the text's UTF-8 bytes, and the maximal runs that were removed.

    A byte goes if a string of ``length`` bytes covers it that also starts
    anywhere else, in the same text or another; judged on the input, and never
    across texts. Defined results: a null text is empty; texts of fewer bytes
    than ``length`` stay whole; repeated rows, whatever their doc_id, remove each
    other's strings entirely; rows without doc_id are rows like all others; a
    multi-byte character may be cut, so ``kept`` is binary; an empty table gives
    an empty one; other columns are left out.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    base = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("text"))
    chunks = cut(base.mapInArrow(_chunks(CHUNK), "chunk bigint, ids array<bigint>, lengths array<bigint>, body binary"))
    bodies = chunks.select("chunk", "lengths", "body")
    rows, _ = written(bodies.mapInArrow(_index(length, gram), "home bigint, core bigint, own bigint, n bigint"))
    found = _judge(rows)
    release(spark)
    asked = found.where("kinds > 1 and open")
    pieces = bodies.groupBy("chunk").cogroup(asked.select(F.col("home").alias("chunk"), "own", "n").groupBy("chunk")).applyInArrow(_sent(length, gram), PIECE)
    verdicts = _whole(rows, found, F.col("home").alias("chunk"), F.col("own").alias("root"), F.lit(0).alias("start"), F.lit(ALL).alias("stop"))
    crowd = asked.where(F.col("kinds") > CROWD).select("core").distinct()
    if crowd.limit(1).count():
        pieces, _ = written(pieces.join(crowd.withColumn("crowded", F.lit(True)), "core", "left").fillna(False, ["crowded"]))
        more = _crowded(pieces.where("crowded").drop("crowded").select(*[c.split()[0] for c in PIECE.split(", ")]), length)
        pieces = pieces.where("not crowded").select(*[c.split()[0] for c in PIECE.split(", ")])
        verdicts = verdicts.unionByName(more)
    tasks = _tasks(asked.where(F.col("kinds") <= CROWD), 2 * length - gram - 150)
    verdicts = cut(verdicts.unionByName(_sorted(pieces, tasks, length)))
    release(spark)
    schema = "doc_id bigint, n_bytes bigint, kept binary, spans array<struct<start: bigint, stop: bigint>>"
    return chunks.groupBy("chunk").cogroup(verdicts.groupBy("chunk")).applyInArrow(_removed(length, gram), schema)
