"""Quality by co-training two views of a document.

The text view sees word presence and the shape of the text; the metadata view
sees source, language, recorded length and line layout, never the words. Both start
from the labelled sample. In each round one pass scores all other documents, and
each view's surest ones, by a distributed top-k, are labelled for the other view
to train on. At last both views are calibrated on out-of-fold logits of labelled
rows and combined, and every document is scored in one pass. The models of a
fold choose their words, and get their pseudo-labels, from models that haven't
seen the fold's labels either; all folds share the passes.

Defined results: null and empty texts count as texts without words; a null
source, language or length is a value of its own; documents without labels are scored
like all others; labelled ones beyond the sample count as unlabelled; without any
labels, or with one class only, every score is 0.5 and everything is kept; an
empty table gives an empty one; other columns are left out.
"""

from __future__ import annotations

import collections
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from newsloom.llm import linear

#: Production bounds: labelled rows, rounds (each a pass over all documents), rows that a view labels in a round and class.
ROWS, ROUNDS, SHARED = 6_000, 3, 200
#: A pseudo-label needs this probability.
SURE = 0.95
HASHED = 64


class Views(NamedTuple):
    words: np.ndarray
    text: np.ndarray
    meta: np.ndarray
    calibration: tuple[np.ndarray, np.ndarray]
    combine: np.ndarray


def _meta(source: list, lang: list, chars: list, lines: list) -> np.ndarray:
    """Metadata features: hashed source and language, log length and its bucket, line density."""
    x = np.zeros((len(source), HASHED + 14))
    for i, (s, g, c, n) in enumerate(zip(source, lang, chars, lines, strict=True)):
        for value in (f"source={s}", f"lang={g}"):
            x[i, sum(b * 31**k for k, b in enumerate(value.encode())) % HASHED] = 1
        length = np.log1p(max(c or 0, 0))
        x[i, HASHED] = length / 10
        x[i, HASHED + 1] = np.log1p(max(c or 0, 0) / max(n or 1, 1)) / 10
        x[i, HASHED + 2 + min(11, int(length))] = 1
    return x


def _carried(docs: DataFrame) -> DataFrame:
    return docs.select(
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), F.col("doc_id").cast("bigint").alias("doc_id"),
        F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"), F.col("n_chars").cast("bigint").alias("n_chars"),
        (F.regexp_count(F.coalesce(F.col("text").cast("string"), F.lit("")), F.lit("\n")) + 1).cast("bigint").alias("n_lines"),
    )


class _Model:
    """Both views' training rows, for one choice of labelled rows (all, or all but a fold)."""

    def __init__(self, rows: list[dict], y: np.ndarray, keep: np.ndarray, meta: np.ndarray):
        self.words = linear.choose_words([r for r, k in zip(rows, keep, strict=True) if k], y[keep], 120)
        text = np.hstack([linear.matrix(rows, self.words), np.array([r["shape"] for r in rows]).reshape(len(rows), len(linear.SHAPES))])
        self.views, self.y, self.keep = (text, meta), y, keep
        # what the other view has labelled: (doc_id, text's hash) -> (features, label)
        self.given: tuple[dict, dict] = ({}, {})

    def train(self, v: int) -> np.ndarray:
        own = [self.given[v][k] for k in sorted(self.given[v])]
        x = np.vstack([self.views[v][self.keep], *[f[None, :] for f, _ in own]])
        target = np.concatenate([self.y[self.keep], [label for _, label in own]])
        return linear.fit(x, target, np.concatenate([np.ones(self.keep.sum()), np.full(len(own), 0.5)]))


_CANDIDATE = "model int, view int, label int, task int, doc_id bigint, hash bigint, sure double, text array<double>, meta array<double>"


def _surest(base: DataFrame, models: list[_Model], known: np.ndarray, shared: int) -> list:
    """For each model, view and label the ``shared`` surest documents that aren't known.

    Each scan task sends its own best ones only; these are ranked among 256 tasks,
    then among 65,536, then all, so that no window follows the number of tasks.
    """
    words, weights = [m.words for m in models], [(m.train(0), m.train(1)) for m in models]
    # of what has been labelled already, a task could send as many again
    most = shared + max(len(g) for m in models for g in m.given)
    least = float(np.log(SURE / (1 - SURE)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[tuple, list] = {}
        for batch in batches:
            meta = _meta(*(batch.column(i).to_pylist() for i in range(2, 6)))
            ids, marks = np.array(batch.column(1).fill_null(-1)), np.array(batch.column(6))
            free = ~np.isin(ids, known) & np.array(batch.column(1).is_valid())
            for at, hashes, bounds, shapes in linear.presence(batch):
                n = len(bounds) - 1
                for m, (own, (w_text, w_meta)) in enumerate(zip(words, weights, strict=True)):
                    text = np.hstack([linear.hits(hashes, bounds, own), shapes])
                    for v, z in enumerate((linear.logits(text, w_text), linear.logits(meta[at : at + n], w_meta))):
                        for label, score in ((1, z), (0, -z)):
                            sure = np.flatnonzero((score > least) & free[at : at + n])
                            top = best.setdefault((m, v, label), [])
                            for i in sure[np.lexsort((marks[at + sure], ids[at + sure], -score[sure]))[:most]].tolist():
                                top.append((-float(score[i]), int(ids[at + i]), int(marks[at + i]), tuple(text[i].tolist()), tuple(meta[at + i].tolist())))
                            if len(top) > 2 * most:
                                best[m, v, label] = sorted(set(top))[:most]  # repeated rows take one place
        task = TaskContext.get().partitionId()
        rows = [(m, v, label, task, i, mark, -score, text, meta) for (m, v, label), top in best.items() for score, i, mark, text, meta in sorted(set(top))[:most]]
        for at in range(0, len(rows), 500):
            part = list(zip(*rows[at : at + 500], strict=True))
            kinds = [pa.int32()] * 4 + [pa.int64()] * 2 + [pa.float64()] + [pa.list_(pa.float64())] * 2
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(part, kinds, strict=True)], names=[x.split()[0] for x in _CANDIDATE.split(", ")])

    found = base.withColumn("hash", F.xxhash64("text")).mapInArrow(run, _CANDIDATE).dropDuplicates(["model", "view", "label", "doc_id", "hash"])
    for tasks in (1 << 8, 1 << 16, 1 << 31):
        order = W.partitionBy("model", "view", "label", F.floor(F.col("task") / tasks)).orderBy(F.col("sure").desc(), "doc_id", "hash")
        found = found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most).drop("place")
    return found.collect()


def train_views(docs: DataFrame, labels: DataFrame, rows: int = ROWS, rounds: int = ROUNDS, shared: int = SHARED) -> Views | None:
    """Fits both views by co-training; None if no class or only one has labels."""
    kept = {"source": "string", "lang": "string", "n_chars": "bigint", "n_lines": "bigint"}
    base = _carried(docs)
    known = linear.sample(base, labels.select("doc_id", F.col("quality").cast("int").alias("quality")).where("quality is not null"), rows, kept | {"quality": "int"})
    y = np.array([r["quality"] for r in known], float)
    if not known or y.min() == y.max():
        return None
    meta, fold = np.array(_meta(*([r[c] for r in known] for c in kept))), linear.folds(known)
    models = [_Model(known, y, np.ones(len(y), bool), meta), *[_Model(known, y, fold != k, meta) for k in np.unique(fold)]]
    ids = np.array([r["doc_id"] for r in known], np.int64)
    for _ in range(rounds):
        taken = collections.Counter()
        for r in sorted(_surest(base, models, ids, shared), key=lambda r: (-r["sure"], r["doc_id"], r["hash"])):
            place, other = (r["model"], r["view"], r["label"]), models[r["model"]].given[1 - r["view"]]
            if taken[place] < shared and (r["doc_id"], r["hash"]) not in other:
                taken[place] += 1
                other[r["doc_id"], r["hash"]] = (np.array(r["meta"] if r["view"] == 0 else r["text"]), float(r["label"]))
        if not taken:
            break
    held, calibration = [], []
    for v in (0, 1):
        out = np.zeros(len(y))
        for m, k in zip(models[1:], np.unique(fold), strict=True):
            out[fold == k] = linear.logits(m.views[v][fold == k], m.train(v))
        calibration.append(linear.fit(out[:, None] / 5, y))
        held.append(linear.logits(out[:, None] / 5, calibration[-1]))
    combine = linear.fit(np.stack(held, 1) / 5, y)
    return Views(models[0].words, models[0].train(0), models[0].train(1), (calibration[0], calibration[1]), combine)


SCHEMA = "doc_id bigint, p_text double, p_meta double, p_quality double, kept boolean"


def score_views(docs: DataFrame, views: Views | None, threshold: float = 0.5) -> DataFrame:
    """``doc_id``, both views' calibrated probabilities, the combined ``p_quality``, and ``kept``."""
    if views is None:
        half = F.lit(0.5)
        return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), half.alias("p_text"), half.alias("p_meta"), half.alias("p_quality"), F.lit(True).alias("kept"))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            meta = _meta(*(batch.column(i).to_pylist() for i in range(2, 6)))
            for at, hashes, bounds, shapes in linear.presence(batch):
                n = len(bounds) - 1
                raw = (
                    linear.logits(np.hstack([linear.hits(hashes, bounds, views.words), shapes]), views.text),
                    linear.logits(meta[at : at + n], views.meta),
                )
                own = [linear.logits(r[:, None] / 5, c) for r, c in zip(raw, views.calibration, strict=True)]
                p = linear.sigmoid(linear.logits(np.stack(own, 1) / 5, views.combine))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(1).slice(at, n), *[pa.array(linear.sigmoid(o)) for o in own], pa.array(p), pa.array(p >= threshold)],
                    names=["doc_id", "p_text", "p_meta", "p_quality", "kept"],
                )

    return _carried(docs).mapInArrow(score, SCHEMA)


def quality_classifier(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Trains both views with production bounds and scores every document."""
    return score_views(docs, train_views(docs, labels))
