"""Filter interaction audit: what each filter of a chain removes, in every order of the chain.

A document's part in the audit is only which of the five filters it fails, so a
table of 32 counts for each part of the corpus, and of the same counts over good
and over toxic documents, says all. These histograms are stacked as rows and
multiplied by four integer matrices of 32 masks by 600 (order, step) columns:
kept, removed, redundant and unique.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

FILTERS = "ABCDE"
ORDERS = ["".join(p) for p in permutations(FILTERS)]
COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
SCHEMA = "part string, filter_order string, step int, " + ", ".join(f"{c} bigint" for c in COUNTS)


def matrices() -> tuple[dict[str, np.ndarray], np.ndarray]:
    """The four 32 x 600 matrices, and the filter (0 to 4) of each column; columns are orders, then steps."""
    letters = np.array([[FILTERS.index(x) for x in order] for order in ORDERS])
    bits = 1 << letters
    after = np.bitwise_or.accumulate(bits, axis=1)
    before = after ^ bits
    mask = np.arange(1 << len(FILTERS))[:, None, None]
    fails, reached = (mask & bits) > 0, (mask & before) == 0
    found = {"kept": (mask & after) == 0, "removed": fails & reached, "redundant": fails & ~reached, "unique": np.broadcast_to(mask == bits, fails.shape)}
    return {n: m.reshape(len(mask), -1).astype(np.int64) for n, m in found.items()}, letters.ravel()


def failures(text: Column) -> Column:
    """Bits of the filters that a text fails by itself (A 1, B 2, C 4, D 8)."""
    words = F.array_remove(F.split(text, "[\\x20\\x09-\\x0D]"), "")

    def bits(w: Column) -> Column:
        n, kinds = F.size(w), F.size(F.array_distinct(w))
        capitals = 100 * F.size(F.regexp_extract_all(text, F.lit("[A-Z]"), F.lit(0))) > 3 * F.length(text)
        each = (n < 200, 100 * kinds < 50 * n, capitals, text.rlike("[#$%&*|]"))
        return sum((F.when(fails, 1 << i).otherwise(0) for i, fails in enumerate(each)), F.lit(0))

    return F.transform(F.array(words), bits)[0]  # the words are split once


def _product(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    by, letters = matrices()
    columns, steps = len(letters), len(FILTERS)
    for batch in batches:
        for at in range(0, batch.num_rows, 64):
            rows = batch.slice(at, 64)
            everyone, good, toxic = (np.array(rows.column(n).to_pylist(), np.int64).reshape(-1, 1 << steps) for n in ("everyone", "good", "toxic"))
            removed = everyone @ by["removed"]
            share = np.stack([removed[:, letters == f].sum(1) for f in range(steps)], axis=1)
            values = (everyone @ by["kept"], removed, everyone @ by["redundant"], everyone @ by["unique"], good @ by["removed"], toxic @ by["removed"], share[:, letters])
            n = rows.num_rows
            yield pa.RecordBatch.from_pydict({
                "part": pa.array(np.repeat(np.array(rows.column("part").to_pylist(), object), columns), pa.string()),
                "filter_order": pa.array(np.tile(np.repeat(ORDERS, steps), n), pa.string()),
                "step": pa.array(np.tile(np.arange(1, steps + 1), n * len(ORDERS)), pa.int32()),
                **{c: pa.array(v.ravel(), pa.int64()) for c, v in zip(COUNTS, values, strict=True)},
            })


def failure_histograms(docs: DataFrame, labels: DataFrame, part: str = "lang") -> DataFrame:
    """``part, everyone, good, toxic``: for each part three arrays of 32 counts, by mask of the filters failed.

    Copies are pre-aggregated by text, part and labels before anything meets by
    text, so a text that makes up a third of the table is a few rows by then.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), failures(text).alias("mask"), F.unhex(F.sha2(text, 256)).alias("same"))
    known = labels.groupBy(F.col("doc_id").cast("bigint").alias("labelled")).agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    rows = rows.join(known, F.col("doc_id") == F.col("labelled"), "left").fillna(0, ["good", "toxic"])
    keys = ["same", "part", "mask", "good", "toxic"]
    ids = rows.groupBy(*keys, "doc_id").agg(F.count("*").alias("n"))
    texts = ids.groupBy(*keys).agg(F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "n"))).alias("first"), F.sum("n").alias("n"), F.sum(F.when(F.col("doc_id").isNull(), F.col("n")).otherwise(0)).alias("lost"))
    # by now a text is one row for each part and pair of labels that it has
    judged = texts.withColumn("least", F.min("first.doc_id").over(W.partitionBy("same")))
    own = F.col("lost") + F.when(F.col("first").isNull() | (F.col("first.doc_id") > F.col("least")), 0).otherwise(F.col("first.n"))
    halves = F.array(F.struct(F.col("mask").alias("mask"), own.alias("n")), F.struct((F.col("mask") + 16).alias("mask"), (F.col("n") - own).alias("n")))
    counted = (
        judged.select("part", "good", "toxic", F.explode(halves).alias("h")).where("h.n > 0").groupBy("part", "h.mask")
        .agg(F.sum("h.n").alias("everyone"), F.sum(F.col("h.n") * F.col("good")).alias("good"), F.sum(F.col("h.n") * F.col("toxic")).alias("toxic"))
    )
    table = counted.groupBy("part").agg(F.map_from_entries(F.collect_list(F.struct("mask", F.struct("everyone", "good", "toxic")))).alias("by"))  # 32 entries at most
    return table.select("part", *(F.expr(f"transform(sequence(0, 31), i -> coalesce(by[i].{n}, 0L))").alias(n) for n in ("everyone", "good", "toxic")))


def filter_audit(docs: DataFrame, labels: DataFrame, part: str = "lang") -> DataFrame:
    """One row per part, order of the five filters and step, zeros included: the columns of ``SCHEMA``.

    Filters: A under 200 words; B fewer than half of the words distinct; C more
    than 3 % of the characters in A-Z; D one of ``#$%&*|``; E the text of a
    smaller doc_id. Defined results: a null text is the empty one, a null part
    is the part ''; a row without doc_id is nobody's earlier copy and fails E
    never, and has no labels; rows that share doc_id and text are no copies of
    each other; of several labels of a doc_id any 1 counts; an empty table has
    no parts and gives no rows; other columns are left out.
    """
    return failure_histograms(docs, labels, part).mapInArrow(_product, SCHEMA)
