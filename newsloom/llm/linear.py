"""Linear models on word presence, trained on a bounded labelled sample.

What is bounded is training only: at most ``rows`` labelled documents, chosen by
a hash of doc_id, meet on the driver as lists of distinct word hashes. A model
is at most ``most`` word hashes with weights, so it travels in a closure, and
scoring is one pass over all documents without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.llm.kernel import Words, signed, slices

#: Letters, digits and all bytes beyond ASCII are inside words.
NOT_LETTERS = np.array([not (chr(i).isalnum() or i >= 128) for i in range(256)])

#: Shape of a text: shares of bytes or words, none of which needs the words themselves.
SHAPES = ("symbols", "shouts", "bars", "upper", "word_length", "repeats", "digits", "log_words")


def presence(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """Runs of rows: (first row, distinct word hashes of all rows, bounds of each row's, shapes)."""
    for at, _, data, offsets in slices(batch):
        w = Words(data, offsets, NOT_LETTERS)
        n = len(offsets) - 1
        row = np.repeat(np.arange(n), w.counts)
        order = np.lexsort((w.hashes, row))
        h, r = w.hashes[order], row[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (r[1:] != r[:-1])
        words = np.maximum(w.counts, 1)

        def share(mask: np.ndarray, offsets=offsets, words=words) -> np.ndarray:
            total = np.concatenate([[0], np.cumsum(mask, dtype=np.int64)])
            return np.diff(total[offsets]) / words

        same = np.zeros(len(w.hashes) + 1)
        same[1:-1] = w.hashes[1:] == w.hashes[:-1]
        same[w.bounds[:-1]] = 0
        repeats = np.diff(np.concatenate([[0], np.cumsum(same[: len(w.hashes)])])[w.bounds]) / words
        lengths = np.concatenate([[0], np.cumsum(w.ends - w.starts)])
        low = np.isin(np.arange(256), np.frombuffer(b"#*$%&<>", np.uint8))
        shapes = np.stack([
            share(low[data]), share(data == ord("!")), share(data == ord("|")), share((data >= 65) & (data <= 90)),
            np.diff(lengths[w.bounds]) / words / 10, repeats, share((data >= 48) & (data <= 57)), np.log1p(w.counts) / 10,
        ], 1)
        yield at, h[new], np.searchsorted(r[new], np.arange(n + 1)), np.minimum(shapes, 3.0)


def _sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at, hashes, bounds, shapes in presence(batch):
            n = len(bounds) - 1
            words = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(signed(hashes)))
            shape = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * shapes.shape[1], pa.int32()), pa.array(shapes.ravel()))
            rest = [batch.column(i).slice(at, n) for i in range(1, batch.num_columns)]
            yield pa.RecordBatch.from_arrays([words, shape, *rest], names=["words", "shape", *batch.schema.names[1:]])


def sample(docs: DataFrame, labels: DataFrame, rows: int, carried: dict[str, str]) -> list[dict]:
    """At most ``rows`` labelled documents as distinct word hashes, shapes and the columns ``carried`` (name: type)."""
    known = labels.where("doc_id is not null").dropDuplicates(["doc_id"]).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    joined = docs.withColumn("text", text).join(known, "doc_id")
    # of rows that repeat a doc_id one is taken, so that rows bound the sample
    one = joined.groupBy("doc_id").agg(F.min_by(F.struct("text", *carried), F.xxhash64("text")).alias("r")).select("r.text", "doc_id", *[f"r.{c}" for c in carried])
    schema = "words array<bigint>, shape array<double>, doc_id bigint" + "".join(f", {n} {t}" for n, t in carried.items())
    found = []
    for batch in one.mapInArrow(_sampled, schema).toArrow().to_batches():
        others = batch.select([n for n in batch.schema.names if n != "words"]).to_pylist()
        # hashes stay in Arrow's memory, 8 bytes each
        words = batch.column(batch.schema.get_field_index("words"))
        ends, flat = words.offsets.to_numpy(), words.values.to_numpy(zero_copy_only=False)
        found += [{"words": flat[a:b], **r} for a, b, r in zip(ends[:-1], ends[1:], others, strict=True)]
    return sorted(found, key=lambda r: r["doc_id"])


def choose_words(rows: list[dict], y: np.ndarray, most: int = 150, least_z: float = 5.0) -> np.ndarray:
    """Word hashes whose share of documents differs most between the classes, by z score; sorted."""
    if not len(rows) or y.min() == y.max():
        return np.empty(0, np.int64)
    every = np.concatenate([np.asarray(r["words"], np.int64) for r in rows])
    hit = np.repeat(y, [len(r["words"]) for r in rows])
    h, inverse = np.unique(every, return_inverse=True)
    a, n = np.bincount(inverse, hit), np.bincount(inverse)
    pos, neg = y.sum(), len(y) - y.sum()
    p = n / len(y)
    z = (a / pos - (n - a) / neg) / np.sqrt(np.maximum(p * (1 - p), 1e-9) * (1 / pos + 1 / neg))
    good = np.flatnonzero((np.abs(z) >= least_z) & (n >= 3))
    return np.sort(h[good[np.argsort(-np.abs(z[good]), kind="stable")[:most]]])


def matrix(rows: list[dict], chosen: np.ndarray) -> np.ndarray:
    x = np.zeros((len(rows), len(chosen)))
    for i, r in enumerate(rows):
        x[i, np.isin(chosen, np.asarray(r["words"], np.int64), assume_unique=True)] = 1
    return x


def fit(x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, l2: float = 1.0, rounds: int = 12) -> np.ndarray:
    """Logistic regression by damped Newton steps; the last weight is the intercept."""
    z = np.hstack([x, np.ones((len(x), 1))])
    w, s = np.zeros(z.shape[1]), np.ones(len(y)) if weight is None else weight
    ridge = np.full(z.shape[1], l2)
    ridge[-1] = 1e-3
    for _ in range(rounds):
        p = sigmoid(z @ w)
        grad = z.T @ (s * (p - y)) + ridge * w
        step = np.linalg.solve((z * (s * np.maximum(p * (1 - p), 1e-4))[:, None]).T @ z + np.diag(ridge), grad)
        w = w - step * min(1.0, 5 / max(1e-9, np.abs(step).max()))
    return w


def logits(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return np.clip(x @ w[:-1] + w[-1], -30, 30)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def folds(rows: list[dict], n: int = 5) -> np.ndarray:
    """A fold for each row, by its rank in doc_id order (rows come sorted)."""
    return np.arange(len(rows)) % n


def hits(hashes: np.ndarray, bounds: np.ndarray, chosen: np.ndarray) -> np.ndarray:
    """Presence of the chosen words (sorted signed hashes) for each row of a run."""
    n = len(bounds) - 1
    x = np.zeros((n, len(chosen)), np.float32)
    if len(chosen) and len(hashes):
        h = signed(hashes)
        at = np.minimum(np.searchsorted(chosen, h), len(chosen) - 1)
        found = np.flatnonzero(chosen[at] == h)
        x[np.searchsorted(bounds, found, "right") - 1, at[found]] = 1
    return x
