"""Toxicity by a classifier chain.

Categories are predicted in order; each later linear model gets the earlier
categories' probabilities as features. While training, those probabilities are
out-of-fold predictions, so a later model doesn't learn from leaked labels.

Defined results: null and empty texts are scored on the intercepts alone;
repeated rows are scored one by one; documents without labels are scored like
all others; with no labels at all every probability is 0; an empty table gives
an empty one; columns other than doc_id and text are left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.llm import linear

#: Production bound of the labelled sample.
ROWS = 8_000


class Chain(NamedTuple):
    categories: tuple[str, ...]
    words: np.ndarray
    weights: tuple[np.ndarray, ...]
    threshold: float


def train_chain(docs: DataFrame, labels: DataFrame, categories: tuple[str, ...], rows: int = ROWS) -> Chain:
    """Fits the chain on at most ``rows`` labelled documents; ``labels`` has doc_id and a 0/1 column for each category."""
    known = linear.sample(docs, labels.select("doc_id", *[F.coalesce(F.col(c).cast("int"), F.lit(0)).alias(c) for c in categories]), rows, {c: "int" for c in categories})
    if not known:
        return Chain(categories, np.empty(0, np.int64), tuple(np.append(np.zeros(i), -30.0) for i in range(len(categories))), 0.5)
    y = {c: np.array([r[c] for r in known], float) for c in categories}
    fold = linear.folds(known)
    words, x = _features(known, y, np.ones(len(known), bool))
    inside = {k: _features(known, y, fold != k)[1] for k in np.unique(fold)}
    weights, first, earlier = [], None, np.empty((len(known), 0))
    for c in categories:
        # neither the words nor the weights of a held-out row's model have seen its labels
        held = np.zeros(len(known))
        for k, own in inside.items():
            own = np.hstack([own, earlier])
            held[fold == k] = linear.logits(own[fold == k], linear.fit(own[fold != k], y[c][fold != k]))
        weights.append(linear.fit(np.hstack([x, earlier]), y[c]))
        first = held if first is None else first
        earlier = np.hstack([earlier, linear.sigmoid(held)[:, None]])
    return Chain(categories, words, tuple(weights), _threshold(linear.sigmoid(first), y[categories[0]]))


def _features(rows: list[dict], y: dict[str, np.ndarray], keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words that tell any category among the rows kept, and their presence in all rows."""
    own = [r for r, k in zip(rows, keep, strict=True) if k]
    words = np.unique(np.concatenate([linear.choose_words(own, labels[keep], 100) for labels in y.values()]))
    return words, linear.matrix(rows, words)


def _threshold(p: np.ndarray, y: np.ndarray) -> float:
    """The out-of-fold probability with the best F1, halfway to its lower neighbour; 0.5 if a class is missing."""
    if not 0 < y.sum() < len(y):
        return 0.5
    order = np.argsort(-p, kind="stable")
    good = np.cumsum(y[order])
    f1 = 2 * good / (np.arange(1, len(y) + 1) + y.sum())
    k = int(np.argmax(f1))
    below = p[order[k + 1]] if k + 1 < len(y) else 0.0
    return float(np.clip((p[order[k]] + below) / 2, 0.2, 0.8))


def score_chain(docs: DataFrame, chain: Chain) -> DataFrame:
    """``doc_id``, a probability ``p_<category>`` for each, and ``flagged`` by the first category's threshold."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, hashes, bounds, _ in linear.presence(batch):
                x, ps = linear.hits(hashes, bounds, chain.words), []
                for w in chain.weights:
                    ps.append(linear.sigmoid(linear.logits(x, w)))
                    x = np.hstack([x, ps[-1][:, None]])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(1).slice(at, len(bounds) - 1), *[pa.array(p) for p in ps], pa.array(ps[0] >= chain.threshold)],
                    names=["doc_id", *[f"p_{c}" for c in chain.categories], "flagged"],
                )

    schema = "doc_id bigint, " + "".join(f"p_{c} double, " for c in chain.categories) + "flagged boolean"
    return docs.select(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), F.col("doc_id").cast("bigint")).mapInArrow(score, schema)


def label_categories(labels: DataFrame) -> DataFrame:
    """Three chained categories from the given labels: toxic; toxic in readable prose; toxic in junk."""
    toxic, good = F.coalesce("toxic", F.lit(0)), F.coalesce("quality", F.lit(0))
    return labels.select(
        "doc_id", toxic.alias("toxic"),
        ((toxic == 1) & (good == 1)).cast("int").alias("toxic_prose"),
        ((toxic == 1) & (good == 0)).cast("int").alias("toxic_junk"),
    )


def toxicity(docs: DataFrame, labels: DataFrame, rows: int = ROWS) -> DataFrame:
    """Trains the production chain and scores every document."""
    return score_chain(docs, train_chain(docs, label_categories(labels), ("toxic", "toxic_prose", "toxic_junk"), rows))
