"""SentencePiece encoding and decoding from a public model's piece table.

Spaces become ``▁`` and a text gets one in front. A text falls into units where
no piece holds two neighbouring characters (so before each run of ``▁``); units
are encoded on their own and the result is the same as for the whole text.

1. Rows are packed into chunks of some MB, compressed; chunks are shuffled once.
2. Each chunk sends its distinct units. Over the distinct units of all chunks
   lattices are built as tables: substrings of at most the longest piece's
   length are exploded, equi-joined to the piece table, grouped by unit, and
   folded with Spark's ``aggregate``. For a unigram model the fold is Viterbi;
   for a BPE model, whose scores are merge ranks and not probabilities, Viterbi
   gives wrong ids, and the fold merges the best adjacent pair of edges until
   none is left. Which boundaries remain is a bit mask.
3. The ids come back by chunk, and a cogroup puts them into the texts.

So texts are never exploded, and each distinct unit is folded once in the whole
corpus. Units of more than ``LONGEST`` characters, and characters without a
piece, which become byte pieces, are resolved in the chunk's own task.
"""

from __future__ import annotations

import hashlib
import heapq
import struct
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from newsloom.llm.kernel import SLICE, buffers, mix, span_hashes
from newsloom.storage import bounded_batches

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
#: Bytes of text in a chunk.
CHUNK = 24 << 20
#: Characters of a unit that the lattice takes: one bit of a mask for each boundary.
LONGEST = 60
UNIGRAM, BPE = 1, 2
_NORMAL, _BYTE, _USER = 1, 6, 4


def _fields(data: bytes) -> Iterator[tuple[int, bytes | int | float]]:
    """Fields of one protocol-buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        key = varint()
        if key & 7 == 0:
            yield key >> 3, varint()
        elif key & 7 == 2:
            n = varint()
            yield key >> 3, data[at : at + n]
            at += n
        else:
            n = 4 if key & 7 == 5 else 8
            yield key >> 3, struct.unpack("<f" if n == 4 else "<d", data[at : at + n])[0]
            at += n


class Model(NamedTuple):
    """A piece table: ids and scores of normal pieces, ids of byte pieces, all pieces by id."""

    kind: int
    ids: dict[str, int]
    scores: dict[str, float]
    bytes_: list[int]
    pieces: list[str]
    longest: int
    unknown: int


def load_model(path: str = MODEL, kind: int | None = None) -> Model:
    """Reads a ``.model`` file on the driver; ``kind`` overrides its type (for tests of the other fold)."""
    with open(path, "rb") as f:
        data = f.read()
    ids, scores, bytes_, pieces, own = {}, {}, [0] * 256, [], UNIGRAM
    for field, value in _fields(data):
        if field == 1:
            piece, score, sort = "", 0.0, _NORMAL
            for f2, v2 in _fields(value):
                piece, score, sort = (v2.decode() if f2 == 1 else piece), (v2 if f2 == 2 else score), (v2 if f2 == 3 else sort)
            if sort in (_NORMAL, _USER):
                ids[piece], scores[piece] = len(pieces), score
            elif sort == _BYTE:
                bytes_[int(piece[3:5], 16)] = len(pieces)
            pieces.append(piece)
        elif field == 2:
            own = next((v2 for f2, v2 in _fields(value) if f2 == 3), own)
    return Model(kind or own, ids, scores, bytes_, pieces, max(map(len, ids)), min(scores.values()) - 10.0)


def _viterbi(unit: str, model: Model) -> list[str]:
    """The best-scored path over a unit's lattice; of equal paths the one whose last edge is longest."""
    n, scores = len(unit), model.scores
    best, back = [0.0] + [-1e300] * n, [0] * (n + 1)
    for end in range(1, n + 1):
        for start in range(max(0, end - model.longest), end):
            score = scores.get(unit[start:end])
            if score is None:
                if end - start > 1:
                    continue
                score = model.unknown
            if best[start] + score > best[end]:
                best[end], back[end] = best[start] + score, start
    out, end = [], n
    while end:
        out.append(unit[back[end] : end])
        end = back[end]
    return out[::-1]


def _merge(unit: str, model: Model) -> list[str]:
    """Merges the best-scored adjacent pair, the leftmost of equals, until no pair is a piece."""
    scores, parts = model.scores, list(unit)
    # a heap of pairs over a linked list
    after, before, heap = [*range(1, len(parts)), -1], [*range(-1, len(parts) - 1)], []

    def offer(i: int) -> None:
        if i >= 0 and after[i] >= 0 and (score := scores.get(parts[i] + parts[after[i]])) is not None:
            heapq.heappush(heap, (-score, i, parts[i], parts[after[i]]))

    for i in range(len(parts) - 1):
        offer(i)
    while heap:
        _, i, left, right = heapq.heappop(heap)
        j = after[i] if parts[i] == left and left else -1
        if j < 0 or parts[j] != right:
            continue
        parts[i], parts[j], after[i] = left + right, "", after[j]
        if after[j] >= 0:
            before[after[j]] = i
        offer(before[i])
        offer(i)
    return [p for p in parts if p]


class Cutter:
    """Cuts texts into units, by code points."""

    def __init__(self, model: Model):
        self.model = model
        pairs = sorted({ord(p[i]) << 21 | ord(p[i + 1]) for p in model.ids for i in range(len(p) - 1)})
        self.pairs = np.array(pairs, np.int64)
        self.low = np.zeros((128, 128), bool)
        low = self.pairs[((self.pairs >> 21) < 128) & ((self.pairs & 0x1FFFFF) < 128)]
        self.low[low >> 21, low & 0x1FFFFF] = True
        self.has_piece = np.zeros(0x110000, bool)
        self.has_piece[[ord(p) for p in model.ids if len(p) == 1]] = True

    def cut(self, texts: list[str]) -> tuple[str, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """All texts in one string with ``▁``, where units begin (and its end), their hashes, whether Spark's lattice takes them, and each text's first unit."""
        marked = [SPACE + t.replace(" ", SPACE) if t else "" for t in texts]
        body = "".join(marked)
        codes = np.frombuffer(body.encode("utf-32-le"), np.uint32)
        n = len(codes)
        first = np.cumsum([0, *map(len, marked)])
        new = np.zeros(n + 1, bool)
        new[first] = True
        if n:
            a, b = codes[:-1], codes[1:]
            low = (a < 128) & (b < 128)
            inside = np.zeros(n - 1, bool)
            inside[low] = self.low[a[low], b[low]]
            keys = a[~low].astype(np.int64) << 21 | b[~low]
            inside[~low] = len(self.pairs) and self.pairs[np.minimum(np.searchsorted(self.pairs, keys), len(self.pairs) - 1)] == keys
            new[1:n] |= ~inside
        starts = np.flatnonzero(new)
        hashes = span_hashes(mix(codes.astype(np.uint64), 13), starts[:-1], starts[1:])
        lengths = np.diff(starts)
        known = np.add.reduceat(self.has_piece[codes], starts[:-1], dtype=np.int64) == lengths if n else np.empty(0, bool)
        return body, starts, hashes, known & (lengths <= LONGEST), np.searchsorted(starts, first)

    def own(self, unit: str) -> list[int]:
        """Ids of a unit that the lattice doesn't take."""
        fold, out = (_viterbi if self.model.kind == UNIGRAM else _merge), []
        for piece in fold(unit, self.model):
            own = self.model.ids.get(piece)
            out += [own] if own is not None else [self.model.bytes_[b] for b in piece.encode()]
        return out


#: One cutter for each model in a Python worker.
_cutters: dict[tuple, Cutter] = {}


def _cutter(model: Model) -> Cutter:
    key = (model.kind, len(model.ids), hash(tuple(model.pieces)))
    if key not in _cutters:
        _cutters.clear()
        _cutters[key] = Cutter(model)
    return _cutters[key]


def _parts(texts: list[str | None]) -> Iterator[tuple[int, int, list[str]]]:
    """Runs of texts of about ``SLICE`` characters."""
    at = 0
    while at < len(texts):
        to, size = at, 0
        while to < len(texts) and (to == at or size + len(texts[to] or "") <= SLICE):
            size += len(texts[to] or "")
            to += 1
        yield at, to, [t or "" for t in texts[at:to]]
        at = to


def _packed(at: int, names: list[str]):
    """Chunks: rows with all their columns as a compressed Arrow stream, named by its content."""

    def packed(rows: list[pa.RecordBatch]) -> pa.RecordBatch:
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, rows[0].schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", 6))) as stream:
            for x in rows:
                stream.write_batch(x)
        body = sink.getvalue().to_pybytes()
        name = int.from_bytes(hashlib.blake2b(body, digest_size=8).digest(), "little", signed=True)
        return pa.RecordBatch.from_arrays([pa.array([name], pa.int64()), pa.array([body], pa.binary())], names=["chunk", "body"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        for batch in batches:
            _, offsets = buffers(batch.column(at))
            start = 0
            while start < batch.num_rows:
                to = min(max(start + 1, int(np.searchsorted(offsets, offsets[start] + CHUNK - size, "right")) - 1), batch.num_rows)
                # a copy, as slices are written with all that they are cut from
                rows.append(pa.RecordBatch.from_arrays([x.take(pa.array(np.arange(start, to))) for x in batch.columns], names=names))
                size += int(offsets[to] - offsets[start])
                start = to
                if size >= CHUNK:
                    yield packed(rows)
                    rows, size = [], 0
        if rows:
            yield packed(rows)

    return run


def _opened(body: bytes) -> Iterator[pa.RecordBatch]:
    with pa.ipc.open_stream(body) as stream:
        yield from stream


def _unit_rows(held, at: int):
    """``chunk, place, unit``: the distinct units of each chunk that the lattice takes; ``place`` is the rank of the unit's hash among them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter = _cutter(held.value)
        for batch in batches:
            for i in range(batch.num_rows):
                seen, found, units_ = np.empty(0, np.uint64), [np.empty(0, np.uint64)], [pa.array([], pa.string())]
                for rows in _opened(batch.column(1)[i].as_py()):
                    for _, _, texts in _parts(rows.column(at).to_pylist()):
                        body, starts, hashes, takes, _ = cutter.cut(texts)
                        which = np.flatnonzero(takes)
                        own, first = np.unique(hashes[which], return_index=True)
                        if len(seen):
                            fresh = seen[np.minimum(np.searchsorted(seen, own), len(seen) - 1)] != own
                            own, first = own[fresh], first[fresh]
                        first = which[first]
                        found.append(own)
                        units_.append(pa.array([body[s:e] for s, e in zip(starts[first].tolist(), starts[first + 1].tolist(), strict=True)], pa.string()))
                        # merged now and then; what has been met since may come twice
                        if len(found) % 8 == 0:
                            seen = np.unique(np.concatenate(found))
                seen, first = np.unique(np.concatenate(found), return_index=True)
                # in the order of units, in which a shuffle compresses them best
                units_ = pa.concat_arrays(units_).take(pa.array(first))
                order = pa.compute.sort_indices(units_)
                units_, places = units_.take(order), order.cast(pa.int32())
                name = pa.array(np.full(len(places), batch.column(0)[i].as_py(), np.int64))
                all_ = pa.RecordBatch.from_arrays([name, places, units_], names=["chunk", "place", "unit"])
                yield from (all_.slice(k, 50_000) for k in range(0, all_.num_rows, 50_000))

    return run


def width(model: Model) -> tuple[int, int]:
    """Bits of an id and one, and how many such go into a number."""
    bits = len(model.pieces).bit_length()
    return bits, 63 // bits


def packed_ids(model: Model) -> tuple[Column, Column]:
    """The first ids in one number, the others, if any, as a list."""
    bits, n = width(model)
    head = F.expr(f"aggregate(slice(ids, 1, {n}), 0L, (a, x) -> shiftleft(a, {bits}) | (x + 1))")
    return head.alias("head"), F.expr(f"if(size(ids) > {n}, slice(ids, {n + 1}, size(ids)), null)").alias("tail")


def _lists(head: np.ndarray, tail: pa.Array, bits: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and ids of what ``packed_ids`` has packed."""
    digits = head[:, None] >> (np.arange(n)[::-1] * bits) & ((1 << bits) - 1)
    there = digits > 0
    first, more = there.sum(1), np.asarray(pa.compute.list_value_length(tail).fill_null(0), np.int64)
    offsets = np.concatenate([[0], np.cumsum(first + more)]).astype(np.int64)
    flat = np.empty(offsets[-1], np.int32)
    flat[np.repeat(offsets[:-1], first) + _ranks(first)] = digits[there] - 1
    flat[np.repeat(offsets[:-1] + first, more) + _ranks(more)] = tail.flatten().to_numpy()
    return offsets, flat


def _ranks(sizes: np.ndarray) -> np.ndarray:
    return np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def _filled(held, at: int, text_out: str | None, names: list[str]):
    """The rows of a chunk with the ids of its texts, and with what the ids decode to."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        cutter = _cutter(held.value)
        decoder = Decoder(held.value) if text_out else None
        places = right["place"].to_numpy()
        order = np.argsort(places, kind="stable")
        # chunks of equal content have equal rows
        order = order[np.concatenate([[True], places[order][1:] != places[order][:-1]])] if len(order) else order
        offsets, flat = _lists(right["head"].to_numpy()[order], right["tail"].combine_chunks().take(pa.array(order)), *width(held.value))
        done = []
        for body in left["body"].to_pylist():
            each = [np.empty(0, np.uint64)]
            for rows in _opened(body):
                for _, _, texts in _parts(rows.column(at).to_pylist()):
                    _, _, hashes, takes, _ = cutter.cut(texts)
                    each.append(np.unique(hashes[takes]))
            seen = np.unique(np.concatenate(each))
            del each
            if len(seen) != len(order):
                raise RuntimeError("a chunk and its units differ: the rows that were encoded aren't the same in each reading of them")
            for rows in _opened(body):
                for start, to, texts in _parts(rows.column(at).to_pylist()):
                    whole, starts, hashes, takes, first = cutter.cut(texts)
                    unit = np.searchsorted(seen, hashes)
                    begin, size = np.zeros(len(hashes), np.int64), np.zeros(len(hashes), np.int64)
                    begin[takes], size[takes] = offsets[unit[takes]], offsets[unit[takes] + 1] - offsets[unit[takes]]
                    more: list[int] = []
                    for u in np.flatnonzero(~takes).tolist():
                        own = cutter.own(whole[starts[u] : starts[u + 1]])
                        begin[u], size[u] = len(flat) + len(more), len(own)
                        more += own
                    ends = np.concatenate([[0], np.cumsum(size)])
                    every = np.concatenate([flat, np.array(more, np.int32)]) if more else flat
                    ids = every[np.repeat(begin - ends[:-1], size) + np.arange(ends[-1])].astype(np.int32)
                    bounds = ends[first]
                    arrays = [x.slice(start, to - start) for x in rows.columns]
                    arrays.append(pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(ids)))
                    if decoder:
                        arrays.append(decoder.decode_all(ids, bounds))
                    done.append(pa.RecordBatch.from_arrays(arrays, names=names))
        return pa.Table.from_batches(done)

    return run


class Decoder:
    """Ids back to text: pieces in order, runs of byte pieces as UTF-8, the leading space dropped."""

    def __init__(self, model: Model):
        special = {i for i, p in enumerate(model.pieces) if p not in model.ids}
        self.raw = [b"" if i in special else p.replace(SPACE, " ").encode() for i, p in enumerate(model.pieces)]
        for byte, i in enumerate(model.bytes_):
            if i:
                self.raw[i] = bytes([byte])
        self.blob = np.frombuffer(b"".join(self.raw), np.uint8)
        self.ends = np.concatenate([[0], np.cumsum([len(x) for x in self.raw])]).astype(np.int64)

    def decode(self, ids: list[int]) -> str:
        raw = b"".join(map(self.raw.__getitem__, ids))
        return raw.decode("utf-8", "replace").removeprefix(" ")

    def decode_all(self, ids: np.ndarray, bounds: np.ndarray) -> pa.Array:
        """Texts of many lists of ids that lie one after another."""
        size = self.ends[ids + 1] - self.ends[ids]
        ends = np.concatenate([[0], np.cumsum(size)])
        raw = self.blob[np.repeat(self.ends[ids] - ends[:-1], size) + np.arange(ends[-1])]
        start, end = ends[bounds[:-1]], ends[bounds[1:]]
        lead = np.flatnonzero(end > start)
        keep = np.ones(len(raw), bool)
        keep[start[lead[raw[start[lead]] == 0x20]]] = False
        kept = np.concatenate([[0], np.cumsum(keep)])
        offsets = np.append(kept[start], kept[end[-1]] if len(end) else 0).astype(np.int32)
        found = pa.StringArray.from_buffers(len(start), pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(raw[keep])))
        try:
            found.validate(full=True)
        except pa.ArrowInvalid:  # bytes that are no UTF-8
            return pa.array([self.decode(ids[s:e].tolist()) for s, e in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)], pa.string())
        return found


def encode(docs: DataFrame, model: Model, text: str = "text", out: str = "ids", decoded: str | None = None) -> DataFrame:
    """Adds ``out``, an array of piece ids, and with ``decoded`` the text that these give again.

    Defined results: a null or empty text has no ids and decodes to an empty
    text; repeated rows are encoded each; an empty table gives an empty one;
    columns of these names are replaced, others stay, whatever their names. The
    order of rows isn't kept.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    held = spark.sparkContext.broadcast(model)
    docs = docs.drop(out, *([decoded] if decoded else []))
    at, columns = docs.columns.index(text), docs.columns
    # columns by number inside, so that no name clashes
    names = [f"c{i}" for i in range(len(columns))]
    plain = docs.toDF(*names).withColumn(names[at], F.col(names[at]).cast("string"))
    chunks = plain.mapInArrow(_packed(at, names), "chunk bigint, body binary").repartition("chunk")
    rows = chunks.mapInArrow(_unit_rows(held, at), "chunk bigint, place int, unit string").repartition("unit")
    # chunk and place are looked at, so that both uses of these rows are one shuffle
    distinct = rows.groupBy("unit").agg(F.min(F.struct("chunk", "place")).alias("first")).where("first.place >= 0 and first.chunk is not null").select("unit")
    coded = lattice_encode(distinct, piece_table(spark, model), model).select(F.col("unit").alias("u"), "ids")
    answers = rows.join(coded, F.col("unit") == F.col("u")).select("chunk", "place", *packed_ids(model))
    fields = [T.StructField(x, f.dataType) for x, f in zip(names, plain.schema.fields, strict=True)]
    added = [T.StructField("out", T.ArrayType(T.IntegerType()))] + ([T.StructField("decoded", T.StringType())] if decoded else [])
    schema = T.StructType([*fields, *added])
    filled = chunks.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(_filled(held, at, decoded, schema.names), schema)
    return filled.toDF(*columns, out, *([decoded] if decoded else []))


def decode(frame: DataFrame, model: Model, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """Adds ``out``, the text of an array of piece ids; null ids give an empty text. A column of that name is replaced."""
    bounded_batches(frame.sparkSession)
    held = frame.sparkSession.sparkContext.broadcast(model)
    frame = frame.drop(out)
    at, schema = frame.columns.index(ids), T.StructType([*frame.schema.fields, T.StructField(out, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(held.value)
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                part = batch.slice(start, 500)
                texts = [decoder.decode(x or []) for x in part.column(at).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], names=[*part.schema.names, out])

    return frame.mapInArrow(run, schema)


def piece_table(spark: SparkSession, model: Model) -> DataFrame:
    """``piece, id, score, rank`` of all normal pieces; the best score has rank 0."""
    ranks = {p: r for r, p in enumerate(sorted(model.ids, key=lambda p: -model.scores[p]))}
    return spark.createDataFrame([(p, i, model.scores[p], ranks[p]) for p, i in model.ids.items()], "piece string, id int, score double, rank int")


def units(docs: DataFrame, text: str = "text") -> DataFrame:
    """The distinct ``unit`` strings of all texts, cut before each run of ``▁``."""
    marked = F.concat(F.lit(SPACE), F.replace(F.col(text), F.lit(" "), F.lit(SPACE)))
    return docs.where(F.length(text) > 0).select(F.explode(F.regexp_extract_all(marked, F.lit(f"{SPACE}*[^{SPACE}]+|{SPACE}+"), F.lit(0))).alias("unit")).distinct()


def lattice_encode(unit_rows: DataFrame, pieces: DataFrame, model: Model) -> DataFrame:
    """``unit, tokens, ids`` of each distinct unit of at most ``LONGEST`` characters, with DataFrame operations only.

    The piece table is fixed (tens of thousands of rows), so its side is
    broadcast; exploded substrings stay with their unit's partition and the
    grouping by unit needs no shuffle of its own. A character without a piece
    is a token of its own with the id null.
    """
    own = unit_rows.select("unit").where(F.length("unit").between(1, LONGEST)).distinct()
    spans = own.select("unit", F.explode(F.sequence(F.lit(0), F.length("unit") - 1)).alias("s")).select(
        "unit", "s", F.explode(F.sequence(F.col("s") + 1, F.least(F.length("unit"), F.col("s") + model.longest))).alias("e")
    )
    # an edge in one number: rank, place, end, id
    edge = "shiftleft(cast(coalesce(rank, 1048575) as bigint), 32) | shiftleft(cast(s as bigint), 26) | shiftleft(cast(e as bigint), 20) | coalesce(id, 1048575)"
    edges = (
        spans.withColumn("part", F.substring("unit", F.col("s") + 1, F.col("e") - F.col("s")))
        .join(F.broadcast(pieces), F.col("part") == F.col("piece"), "left")
        .where("piece is not null or e = s + 1")
        .groupBy("unit").agg(F.sort_array(F.collect_list(F.expr(edge))).alias("edges"), *([F.collect_list(F.struct("s", "e", F.coalesce("score", F.lit(model.unknown)).alias("score"))).alias("scored")] if model.kind == UNIGRAM else []))
    )
    # the boundaries that an edge needs, and those that it would take away
    shape = "struct(shiftleft(1L, cast(shiftright(x, 26) & 63 as int)) | shiftleft(1L, cast(shiftright(x, 20) & 63 as int)) as two, shiftleft(1L, cast(shiftright(x, 20) & 63 as int)) - shiftleft(2L, cast(shiftright(x, 26) & 63 as int)) as inner, shiftleft(shiftright(x, 20) & 4095, 20) | (x & 1048575) as code)"
    mask = _viterbi_mask() if model.kind == UNIGRAM else _merge_mask(shape)
    left = f"transform(array({mask}), m -> array_sort(transform(filter(transform(edges, x -> {shape}), x -> (m & x.two) = x.two and (m & x.inner) = 0), x -> x.code)))[0]"
    codes = edges.select("unit", F.explode(F.array(F.expr(left))).alias("codes"))
    return codes.select(
        "unit",
        F.expr("transform(codes, c -> substring(unit, cast(shiftright(c, 26) + 1 as int), cast((shiftright(c, 20) & 63) - shiftright(c, 26) as int)))").alias("tokens"),
        F.expr("transform(codes, c -> cast(nullif(c & 1048575, 1048575) as int))").alias("ids"),
    )


def _viterbi_mask() -> str:
    """Boundaries of the best path: a fold over places that keeps (score, previous) of each, then a fold backwards."""
    best = (
        "aggregate(sequence(1, length(unit)), array(struct(0D as score, 0 as back)), (state, p) -> concat(state, array(array_max("
        "transform(filter(scored, e -> e.e = p), e -> struct(get(state, e.s).score + e.score as score, -e.s as back))))))"
    )
    return (
        f"aggregate(array({best}), 0L, (zero, state) -> aggregate(sequence(1, length(unit)), struct(shiftleft(1L, length(unit)) | 1L as mask, length(unit) as at), "
        "(path, i) -> struct(path.mask | shiftleft(1L, -get(state, path.at).back) as mask, -get(state, path.at).back as at), path -> path.mask))"
    )


def _merge_mask(shape: str) -> str:
    """Boundaries that are left after merging: each step takes the best edge, the leftmost of equals, that spans just two pieces."""
    wide = f"filter(transform(edges, x -> {shape}), x -> x.inner <> 0)"
    return (
        f"aggregate(array({wide}), shiftleft(1L, length(unit) + 1) - 1, (all, wide) -> aggregate(sequence(1, length(unit)), all, "
        "(m, i) -> coalesce(m & ~get(filter(wide, x -> (m & x.two) = x.two and bit_count(m & x.inner) = 1), 0).inner, m)))"
    )
