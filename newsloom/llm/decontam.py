"""Benchmark decontamination by greedy string tiling.

Runs of ``min_match`` words that a text shares with a benchmark item are seeds,
found by rolling hashes. Seeds on one diagonal join to matches; the longest
match whose words are still unmarked becomes a tile, again and again, a match
that meets a marked word being split around it. The share of an item's words
under tiles is its coverage, so a passage counts whatever order its parts come in.

Benchmarks are small and don't grow with the corpus. Up to ``most_words`` words
they travel to the scan, which then needs no shuffle; a larger one is joined to
the texts' seeds as a table, with the same result.

Defined results: null and empty texts and items match nothing; an item of fewer
than ``min_match`` words can't be tiled and matches nothing; repeated rows are
judged one by one; words are compared with A-Z as a-z.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.llm.kernel import Words, shingles, signed, slices
from newsloom.storage import bounded_batches

MIN_MATCH, COVERAGE, MOST_WORDS = 5, 0.6, 2_000_000
SCHEMA = "doc_id bigint, item_id bigint, item_words bigint, covered bigint, coverage double, n_tiles bigint"
_BITS = 22


def tiles(item: np.ndarray, doc: np.ndarray, places: np.ndarray, spots: np.ndarray, min_match: int) -> list[tuple[int, int, int]]:
    """Greedy tiles (place in item, spot in doc, length) from seeds at ``places`` of the item and ``spots`` of the doc."""
    order = np.lexsort((places, spots - places))
    p, d = places[order], spots[order]
    new = np.ones(len(p), bool)
    new[1:] = (p[1:] != p[:-1] + 1) | (d[1:] != d[:-1] + 1)
    first = np.flatnonzero(new)
    lengths = np.diff(np.append(first, len(p))) + min_match - 1
    heap = [(-int(n), int(p[i]), int(d[i])) for i, n in zip(first, lengths, strict=True)]
    heapq.heapify(heap)
    item_marked, doc_marked, found = np.zeros(len(item), bool), {}, []
    while heap:
        n, a, b = heapq.heappop(heap)
        n = -n
        marked = item_marked[a : a + n] | np.fromiter((b + k in doc_marked for k in range(n)), bool, n)
        if not marked.any():
            if (item[a : a + n] == doc[b : b + n]).all():
                item_marked[a : a + n] = True
                doc_marked.update((b + k, True) for k in range(n))
                found.append((a, b, n))
            continue
        edges = np.flatnonzero(np.diff(np.concatenate([[True], marked, [True]]).astype(np.int8)))
        for s, e in zip(edges[::2], edges[1::2], strict=True):
            if e - s >= min_match:
                heapq.heappush(heap, (-int(e - s), a + int(s), b + int(s)))
    return found


class Bench:
    """Items as word hashes, and a sorted index of their seeds."""

    def __init__(self, ids: list, texts: list[str], min_match: int):
        self.ids, self.min_match = ids, min_match
        data = "".join(texts).encode()
        offsets = np.concatenate([[0], np.cumsum([len(t.encode()) for t in texts])]).astype(np.int64)
        w = Words(np.frombuffer(data, np.uint8), offsets)
        self.items = [w.hashes[w.bounds[i] : w.bounds[i + 1]] for i in range(len(ids))]
        grams = [shingles(x, min_match) for x in self.items]
        every = np.concatenate([np.empty(0, np.uint64), *grams])
        order = np.argsort(every, kind="stable")
        self.seeds = every[order]
        self.item = np.repeat(np.arange(len(ids)), [len(g) for g in grams])[order]
        self.place = np.concatenate([np.empty(0, np.int64), *[np.arange(len(g)) for g in grams]])[order]
        self.bits = np.zeros(1 << _BITS, bool)
        self.bits[self.seeds & np.uint64((1 << _BITS) - 1)] = True

    def matches(self, w: Words, coverage: float) -> Iterator[tuple[int, int, int, float, int]]:
        """(row, item, words covered, coverage, tiles) of every row and item over the threshold."""
        grams = shingles(w.hashes, self.min_match)
        maybe = np.flatnonzero(self.bits[grams & np.uint64((1 << _BITS) - 1)])
        if not len(maybe) or not len(self.seeds):
            return
        left, right = (np.searchsorted(self.seeds, grams[maybe], side) for side in ("left", "right"))
        hit = right > left
        maybe, left, right = maybe[hit], left[hit], right[hit]
        row = np.searchsorted(w.bounds, maybe, "right") - 1
        within = maybe + self.min_match <= w.bounds[row + 1]
        maybe, left, right, row = maybe[within], left[within], right[within], row[within]
        if not len(maybe):
            return
        n = right - left
        which = np.repeat(left, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        rows, spots, items, places = np.repeat(row, n), np.repeat(maybe, n), self.item[which], self.place[which]
        order = np.lexsort((spots, items, rows))
        rows, spots, items, places = rows[order], spots[order], items[order], places[order]
        cuts = np.flatnonzero(np.concatenate([[True], (rows[1:] != rows[:-1]) | (items[1:] != items[:-1])]))
        for s, e in zip(cuts, np.append(cuts[1:], len(rows)), strict=True):
            item = self.items[items[s]]
            # each place covers at most min_match words: too few places can't reach the threshold
            if min(len(item), len(np.unique(places[s:e])) * self.min_match) < coverage * len(item):
                continue
            start = w.bounds[rows[s]]
            found = tiles(item, w.hashes[start : w.bounds[rows[s] + 1]], places[s:e], spots[s:e] - start, self.min_match)
            covered = sum(t[2] for t in found)
            if found and covered >= coverage * len(item):
                yield int(rows[s]), int(items[s]), covered, covered / len(item), len(found)


def _prepared(docs: DataFrame, *more: str) -> DataFrame:
    return docs.select(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), F.col("doc_id").cast("bigint").alias("doc_id"), *more)


def _items(bench: DataFrame) -> DataFrame:
    return bench.select(F.col("item_id").cast("bigint").alias("item_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def small(bench: DataFrame, most_words: int) -> bool:
    """Whether the benchmark is within the bound, by a count over the whole of it."""
    n = _items(bench).agg(F.sum(F.length("text")), F.count("*")).first()
    return (n[0] or 0) <= 6 * most_words and n[1] <= most_words


def _carry(bench: DataFrame, min_match: int) -> Bench:
    rows = sorted(map(tuple, _items(bench).collect()), key=lambda r: (r[0] is None, r))
    return Bench([r[0] for r in rows], [r[1] for r in rows], min_match)


def contaminated(docs: DataFrame, bench: DataFrame, min_match: int = MIN_MATCH, coverage: float = COVERAGE, most_words: int = MOST_WORDS) -> DataFrame:
    """One row for each document and item whose coverage reaches the threshold; clean documents have none."""
    bounded_batches(docs.sparkSession)
    if not small(bench, most_words):
        return _by_join(docs, bench, min_match, coverage).drop("doc_id_mark")
    held = docs.sparkSession.sparkContext.broadcast(_carry(bench, min_match))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, _, data, offsets in slices(batch):
                rows = [
                    (batch.column(1)[at + row].as_py(), held.value.ids[item], len(held.value.items[item]), covered, share, n)
                    for row, item, covered, share, n in held.value.matches(Words(data, offsets), coverage)
                ]
                yield _batch(rows)

    return _prepared(docs).mapInArrow(find, SCHEMA)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64()] * 4 + [pa.float64(), pa.int64()]
    columns = list(zip(*rows, strict=True)) if rows else [[]] * 6
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[x.split()[0] for x in SCHEMA.split(", ")])


def _seeds(min_match: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, _, data, offsets in slices(batch):
                w = Words(data, offsets)
                grams = [np.unique(shingles(w.hashes[w.bounds[i] : w.bounds[i + 1]], min_match)) for i in range(len(offsets) - 1)]
                row = np.repeat(np.arange(at, at + len(grams)), [len(g) for g in grams])
                yield pa.RecordBatch.from_arrays([*(c.take(pa.array(row)) for c in batch.columns[1:]), pa.array(signed(np.concatenate([np.empty(0, np.uint64), *grams])))], names=[*batch.schema.names[1:], "seed"])

    return run


def _named(texts: DataFrame, name: str) -> DataFrame:
    """``text``, the id, and a hash of the text: rows are judged by both, so that rows that share an id don't mix."""
    return texts.select("text", F.col(name), F.xxhash64("text").alias(f"{name}_mark"))


def _by_join(docs: DataFrame, bench: DataFrame, min_match: int, coverage: float) -> DataFrame:
    """The same rows, and ``doc_id_mark``, for a benchmark of any size: seeds of both sides meet in an equi-join."""
    left, right = _named(_prepared(docs), "doc_id"), _named(_items(bench), "item_id")

    def seeds(side: DataFrame, name: str) -> DataFrame:
        return side.distinct().mapInArrow(_seeds(min_match), f"{name} bigint, {name}_mark bigint, seed bigint")

    one, two = seeds(left, "doc_id").toDF("d", "d_mark", "seed"), seeds(right, "item_id").toDF("i", "i_mark", "seed")
    pairs = one.join(two, "seed").drop("seed").distinct()
    full = (
        pairs.join(left.withColumnRenamed("text", "doc_text"), F.col("d").eqNullSafe(F.col("doc_id")) & (F.col("d_mark") == F.col("doc_id_mark")))
        .join(right, F.col("i").eqNullSafe(F.col("item_id")) & (F.col("i_mark") == F.col("item_id_mark")))
        .select("doc_id", "doc_id_mark", "item_id", "doc_text", "text")
    )

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, marks = [], []
            for i in range(batch.num_rows):
                doc, mark, item, body, text = (c[i].as_py() for c in batch.columns)
                one, raw = Bench([item], [text], min_match), body.encode()
                words = Words(np.frombuffer(raw, np.uint8), np.array([0, len(raw)], np.int64))
                found = [(doc, item, len(one.items[0]), covered, share, n) for _, _, covered, share, n in one.matches(words, coverage)]
                rows += found
                marks += [mark] * len(found)
            out = _batch(rows)
            yield pa.RecordBatch.from_arrays([*out.columns, pa.array(marks, pa.int64())], names=[*out.schema.names, "doc_id_mark"])

    return full.mapInArrow(verify, SCHEMA + ", doc_id_mark bigint")


def drop_contaminated(docs: DataFrame, bench: DataFrame, min_match: int = MIN_MATCH, coverage: float = COVERAGE, most_words: int = MOST_WORDS) -> DataFrame:
    """Documents without the contaminated ones, all columns as they were, whatever their names.

    Rows are judged one by one: of rows that share a doc_id, or have none, those
    with a contaminated text go.
    """
    bounded_batches(docs.sparkSession)
    if not small(bench, most_words):
        bad = _by_join(docs, bench, min_match, coverage).select("doc_id", "doc_id_mark").distinct().alias("bad")
        mark = F.xxhash64(F.coalesce(F.col("own.text").cast("string"), F.lit("")))
        return docs.alias("own").join(bad, F.col("own.doc_id").cast("bigint").eqNullSafe(F.col("bad.doc_id")) & (mark == F.col("bad.doc_id_mark")), "left_anti")
    held = docs.sparkSession.sparkContext.broadcast(_carry(bench, min_match))
    text = docs.columns.index("text")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bodies = pa.RecordBatch.from_arrays([batch.column(text).cast(pa.string()).fill_null("")], names=["text"])
            clean = np.ones(batch.num_rows, bool)
            for at, _, data, offsets in slices(bodies):
                for row, *_ in held.value.matches(Words(data, offsets), coverage):
                    clean[at + row] = False
            yield batch.filter(pa.array(clean))

    return docs.mapInArrow(keep, docs.schema)
