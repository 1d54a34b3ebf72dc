"""Near-duplicate documents: banded MinHash with sequential Bayesian verification.

1. One scan makes, for each text, a key of its word sequence, the size of its
   shingle set, a MinHash signature and its band keys. Texts with one key are
   one class: only its smallest doc_id, the representative, goes on, so groups
   of exact copies of any size cost one row.
2. In each band bucket every representative is paired with the bucket's
   smallest, its hub: pairs grow with the members and not with their square.
3. Pairs are verified in sequence: signatures are compared a batch at a time
   and a pair goes as soon as the posterior probability of reaching the
   threshold falls under ``miss``. Survivors are confirmed on full shingle sets.
4. Components of the links are labelled. Buckets that still hold several
   components are compared across components, signatures in blocks of bounded
   size, so a link that doesn't pass through a hub isn't lost; survivors are
   confirmed within their blocks, one link to each component, and the
   components are labelled once more.

Nothing about all documents reaches the driver. Signatures are checkpointed
once, so a lost executor costs a stage.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.llm.kernel import Words, mix, sequence_key, shingles, signed, slices
from newsloom.operators.components import connected_components
from newsloom.storage import bounded_batches, cut, only

BANDS, ROWS, BATCH = 32, 5, 32
MISS = 1e-6
BLOCK = 2_048


class Setting(NamedTuple):
    """``words`` in a shingle; linked if 100 * common >= ``percent`` * union."""

    words: int
    percent: int


def _shared_base(n: int) -> tuple[np.ndarray, np.ndarray]:
    own = mix(np.arange(1, n + 1, dtype=np.uint64), 991)
    return (own & np.uint64(0xFFFFFFFF)).astype(np.uint32) | np.uint32(1), (own >> np.uint64(32)).astype(np.uint32)


_MUL, _ADD = _shared_base(BANDS * ROWS)


def text_shingles(hashes: np.ndarray, k: int) -> np.ndarray:
    """A text's shingle set, sorted: every k words, or the whole sequence if it is shorter; none without words."""
    if not len(hashes):
        return np.empty(0, np.uint64)
    return np.unique(shingles(hashes, min(k, len(hashes))))


def signatures(base: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """MinHash values, a row for each non-empty run of 64-bit hashes that begins at ``starts``."""
    x = (base ^ (base >> np.uint64(32))).astype(np.uint32)
    out = np.empty((len(starts), len(_MUL)), np.uint32)
    for i in range(len(_MUL)):
        h = x * _MUL[i]
        h ^= h >> np.uint32(15)
        h *= np.uint32(0x85EBCA6B)
        h ^= _ADD[i]
        out[:, i] = np.minimum.reduceat(h, starts)
    return out


def band_keys(sig: np.ndarray) -> np.ndarray:
    """A 64-bit key for each band of each signature."""
    rows = sig.reshape(-1, BANDS, ROWS).astype(np.uint64)
    total = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), rows.shape[:2])
    with np.errstate(over="ignore"):
        for j in range(ROWS):
            total = mix(total + rows[:, :, j], j)
    return total


def _scan(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, to, data, offsets in slices(batch):
                w = Words(data, offsets)
                keys, sets = [], []
                for i in range(to - at):
                    own = w.hashes[w.bounds[i] : w.bounds[i + 1]]
                    sets.append(text_shingles(own, k))
                    keys.append(sequence_key(own) if len(own) else (0, 0))
                sizes = np.array([len(s) for s in sets])
                full = np.flatnonzero(sizes)
                sigs, bands = [b""] * len(sets), [[]] * len(sets)
                if len(full):
                    # buckets and comparisons see the same 16 bits, so that they agree on common bands
                    sig = signatures(np.concatenate(sets), (np.cumsum(sizes) - sizes)[full]).astype("<u2")
                    for i, own, keyed in zip(full.tolist(), sig, signed(band_keys(sig)).tolist(), strict=True):
                        sigs[i], bands[i] = own.tobytes(), keyed
                yield pa.RecordBatch.from_arrays(
                    [batch.column(1).slice(at, to - at), pa.array([a for a, _ in keys], pa.int64()), pa.array([b for _, b in keys], pa.int64()), pa.array(sizes, pa.int64()), pa.array(sigs, pa.binary()), pa.array(bands, pa.list_(pa.int64()))],
                    names=["doc_id", "k1", "k2", "n_shingles", "sig", "bands"],
                )

    return run


def least_matches(percent: int, miss: float = MISS) -> dict[int, int]:
    """After n compared hashes, the fewest matches with which a pair goes on.

    With a uniform prior, the posterior probability that similarity is at least
    t after m of n matches equals P(Binomial(n + 1, t) <= m).
    """
    t, out = percent / 100, {}
    for n in range(BATCH, BANDS * ROWS + 1, BATCH):
        total, m = 0.0, -1
        while total < miss:
            m += 1
            total += math.comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
        out[n] = m
    return out


def survives(a: np.ndarray, b: np.ndarray, least: dict[int, int]) -> np.ndarray:
    """Which rows of two signature matrices stand the sequential test; compared a batch of hashes at a time."""
    alive, matches, done = np.arange(len(a)), np.zeros(len(a), np.int32), 0
    for n, m in least.items():
        matches[alive] += (a[alive, done:n] == b[alive, done:n]).sum(1, dtype=np.int32)
        alive, done = alive[matches[alive] >= m], n
    out = np.zeros(len(a), bool)
    out[alive] = True
    return out


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<u2").reshape(-1, BANDS * ROWS)


def _bayes(least: dict[int, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                keep = survives(_matrix(batch.column(2)), _matrix(batch.column(3)), least)
                yield batch.select([0, 1]).filter(pa.array(keep))

    return run


def _across(table: pa.Table, least: dict[int, int]) -> Iterator[tuple[int, np.ndarray]]:
    """Each minor member of a block and the members of other labels with which it stands the test; a pair counts in the first of its common bands only."""
    label, minor = table["label"].to_numpy(), table["side"].to_numpy() == 0
    sig = _matrix(table["sig"].combine_chunks())
    right, bucket = np.flatnonzero(~minor), table["pos"][0].as_py() if table.num_rows else 0
    for i in np.flatnonzero(minor):
        other = right[label[right] != label[i]]
        stays = other[survives(np.broadcast_to(sig[i], (len(other), sig.shape[1])), sig[other], least)]
        stays = stays[(sig[stays] == sig[i]).reshape(-1, BANDS, ROWS).all(2).argmax(1) == bucket]
        if len(stays):
            yield i, stays[np.argsort(-(sig[stays] == sig[i]).sum(1), kind="stable")]


def _blocks(least: dict[int, int]):
    """The members of one block of minor members and one block of all members of a bucket that some pair across labels needs."""

    def run(table: pa.Table) -> pa.Table:
        needed = np.zeros(table.num_rows, bool)
        for i, stays in _across(table, least):
            needed[i] = needed[stays] = True
        return table.drop_columns(["sig"]).filter(pa.array(needed))

    return run


def _linked(least: dict[int, int], k: int, percent: int):
    """Confirms a block's pairs on full shingle sets, the likeliest first; one link of a member to a component will do."""

    def run(table: pa.Table) -> pa.Table:
        ids, label, texts = table["rep"].to_numpy(), table["label"].to_numpy(), table["text"].combine_chunks()
        sets: dict[int, np.ndarray] = {}

        def of(i: int) -> np.ndarray:
            if i not in sets:
                sets[i] = _set(texts[i].as_py(), k)
            return sets[i]

        a, b = [], []
        for i, stays in _across(table, least):
            joined, own = set(), of(int(i))
            for j in stays.tolist():
                if label[j] in joined:
                    continue
                other = of(j)
                union = len(own) + len(other)
                if min(len(own), len(other)) * 100 < percent * max(len(own), len(other)):
                    continue
                common = len(np.intersect1d(own, other, assume_unique=True))
                if common and 100 * common >= percent * (union - common):
                    joined.add(label[j])
                    a.append(min(ids[i], ids[j]))
                    b.append(max(ids[i], ids[j]))
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


def _confirm(k: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[str | None, np.ndarray] = (None, np.empty(0, np.uint64))
        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            for i in range(batch.num_rows):
                one, two = batch.column(2)[i].as_py(), batch.column(3)[i].as_py()
                if one != held[0]:
                    held = (one, _set(one, k))
                other = _set(two, k)
                union = len(held[1]) + len(other)
                if min(len(held[1]), len(other)) * 100 < percent * max(len(held[1]), len(other)):
                    continue
                common = len(np.intersect1d(held[1], other, assume_unique=True))
                keep[i] = 100 * common >= percent * (union - common) and common > 0
            yield batch.select([0, 1]).filter(pa.array(keep))

    return run


def _set(text: str, k: int) -> np.ndarray:
    raw = text.encode()
    w = Words(np.frombuffer(raw, np.uint8), np.array([0, len(raw)], np.int64))
    return text_shingles(w.hashes, k)


def _verified(pairs: DataFrame, docs: DataFrame, k: int, percent: int) -> DataFrame:
    """Pairs a, b confirmed on the full shingle sets of their texts."""
    pairs = cut(pairs)
    docs = only(docs, pairs.select("a").unionByName(pairs.select(F.col("b").alias("a"))), "doc_id")
    return (
        pairs.join(docs.select(F.col("doc_id").alias("b"), F.col("text").alias("two")), "b")
        .join(docs.select(F.col("doc_id").alias("a"), F.col("text").alias("one")), "a")
        .select("a", "b", "one", "two")
        .mapInArrow(_confirm(k, percent), "a bigint, b bigint")
        .distinct()
    )


def _crossing(shared: DataFrame, label: DataFrame, sigs: DataFrame, texts: DataFrame, least: dict[int, int], setting: Setting) -> DataFrame:
    """Confirmed links across components, from buckets that hold several: members away from the hub's component against all.

    Signatures are compared in blocks; only members that survive with someone
    are sent once more, with their texts, and confirmed block by block.
    """
    known = label.select(F.col("node").alias("__n"), "component")
    named = shared.join(known, F.col("rep") == F.col("__n"), "left").withColumn("label", F.coalesce("component", "rep")).drop("__n", "component")
    major = named.where("rep = hub").select(F.col("band").alias("at"), F.col("label").alias("major")).distinct()
    named = named.join(major, F.col("band") == F.col("at")).drop("at", "hub")
    open_ = named.groupBy("band").agg(F.count_if(F.col("label") != F.col("major")).alias("minors"), F.count("*").alias("all")).where("minors > 0").withColumnRenamed("band", "at")
    rest = named.join(open_, F.col("band") == F.col("at")).drop("at")
    n_minor, n_all = F.ceil(F.col("minors") / BLOCK).cast("int"), F.ceil(F.col("all") / BLOCK).cast("int")
    place = F.pmod(F.xxhash64("rep"), F.lit(1 << 20)).cast("int")
    left = rest.where("label <> major").select(
        "band", "pos", (place % n_minor).alias("i"), F.explode(F.sequence(F.lit(0), n_all - 1)).alias("j"), "rep", "label", F.lit(0).alias("side"))
    right = rest.select(
        "band", "pos", F.explode(F.sequence(F.lit(0), n_minor - 1)).alias("i"), (place % n_all).alias("j"), "rep", "label", F.lit(1).alias("side"))
    signed_ = sigs.select(F.col("doc_id").alias("rep"), "sig")
    schema = "rep bigint, band bigint, pos int, i int, j int, label bigint, side int"
    needed = cut(left.unionByName(right).join(signed_, "rep").select("rep", "band", "pos", "i", "j", "label", "side", "sig").groupBy("band", "i", "j").applyInArrow(_blocks(least), schema))
    bodies = only(texts, needed.select("rep"), "doc_id").select(F.col("doc_id").alias("rep"), "text")
    whole = needed.join(signed_, "rep").join(bodies, "rep").select("rep", "band", "pos", "i", "j", "label", "side", "sig", "text")
    return whole.groupBy("band", "i", "j").applyInArrow(_linked(least, *setting), "a bigint, b bigint").distinct()


def near_duplicates(docs: DataFrame, setting: Setting = Setting(5, 80)) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept``, one row for each row of ``docs``.

    Defined results: a null or empty text, or one without words, has no
    shingles, is linked with nothing and is kept; a row without doc_id is linked
    with nothing and kept, its component null; rows that repeat a doc_id with
    one text share a verdict; other columns are left out.
    """
    k, percent = setting
    least = least_matches(percent)
    bounded_batches(docs.sparkSession)
    base = docs.select(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), F.col("doc_id").cast("bigint").alias("doc_id"))
    scan = cut(base.mapInArrow(_scan(k), "doc_id bigint, k1 bigint, k2 bigint, n_shingles bigint, sig binary, bands array<bigint>"))
    linkable = scan.where("n_shingles > 0 and doc_id is not null")
    reps = cut(linkable.groupBy("k1", "k2").agg(F.min("doc_id").alias("rep")))
    texts = base.where("doc_id is not null")
    sigs = linkable.select("doc_id", "sig", "n_shingles", "k1", "k2")

    members = (
        linkable.join(reps.withColumnsRenamed({"k1": "r1", "k2": "r2"}), (F.col("k1") == F.col("r1")) & (F.col("k2") == F.col("r2")) & (F.col("doc_id") == F.col("rep")))
        .select("rep", F.posexplode("bands").alias("pos", "band"))
    )
    hubs = members.groupBy("band").agg(F.min("rep").alias("hub"), F.max("rep").alias("top")).where("hub < top").select(F.col("band").alias("at"), "hub")
    shared = cut(members.join(hubs, F.col("band") == F.col("at")).select("band", "pos", "hub", "rep"))
    star = shared.where("rep <> hub").select(F.col("hub").alias("a"), F.col("rep").alias("b")).distinct()
    tested = (
        star.join(sigs.select(F.col("doc_id").alias("b"), F.col("sig").alias("sig_b"), F.col("n_shingles").alias("n_b")), "b")
        .join(sigs.select(F.col("doc_id").alias("a"), F.col("sig").alias("sig_a"), F.col("n_shingles").alias("n_a")), "a")
        .where(f"100 * least(n_a, n_b) >= {percent} * greatest(n_a, n_b)")
        .select("a", "b", "sig_a", "sig_b")
        .mapInArrow(_bayes(least), "a bigint, b bigint")
    )
    links = cut(_verified(tested, texts, k, percent))
    label = connected_components(links)
    more = cut(_crossing(shared, label, sigs, texts, least, setting))
    if more.limit(1).count():
        label = connected_components(links.unionByName(more))
    label = label.select(F.col("node").alias("__n"), "component")
    classes = reps.join(label, F.col("rep") == F.col("__n"), "left").select("k1", "k2", F.coalesce("component", "rep").alias("component"))
    return (
        scan.select("doc_id", "k1", "k2", "n_shingles")
        .join(classes.withColumnsRenamed({"k1": "r1", "k2": "r2"}), (F.col("k1") == F.col("r1")) & (F.col("k2") == F.col("r2")) & (F.col("n_shingles") > 0), "left")
        .select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id"))
        .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
    )


def drop_near_duplicates(docs: DataFrame, setting: Setting = Setting(5, 80)) -> DataFrame:
    """One document of each group, the one with the smallest doc_id, all columns as they were.

    Defined results: rows without doc_id, null texts and texts without words
    stay; of rows that repeat a doc_id all stay or all go, so that repeated
    rows stay together; an empty table stays empty; columns may have any names.
    """
    gone = near_duplicates(docs, setting).where("not kept").select("doc_id").distinct()
    return docs.alias("own").join(gone.alias("gone"), F.col("own.doc_id") == F.col("gone.doc_id"), "left_anti")
