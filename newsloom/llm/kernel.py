"""Vectorised text kernels over Arrow batches.

Texts are handled as the bytes of an Arrow string column: words, their 64-bit
hashes and shingles come from whole-array numpy passes, a slice of at most
``SLICE`` bytes at a time (one longer text makes one longer slice), so memory
follows the slice and not the batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE = 1 << 18
#: Words are runs of anything but space, tab, line feed, VT, FF and CR.
BREAKS = np.zeros(256, bool)
BREAKS[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_BASE = np.uint64(0x9E3779B97F4A7C55)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C55, -1, 1 << 64))


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit finaliser: two multiply-xorshift rounds."""
    with np.errstate(over="ignore"):
        x = x + np.uint64((0x9E3779B97F4A7C15 * (seed + 1)) & 0xFFFFFFFFFFFFFFFF)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def _byte_values() -> np.ndarray:
    values = mix(np.arange(256, dtype=np.uint64), 77)
    values[ord("A") : ord("Z") + 1] = values[ord("a") : ord("z") + 1]
    return values


_VALUES = _byte_values()
_powers = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers["up"]) < n:
        size = max(n, SLICE + 1)
        for key, base in (("up", _BASE), ("down", _INVERSE)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[key] = np.cumprod(steps, dtype=np.uint64)
    return _powers["up"][:n], _powers["down"][:n]


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Rolling hashes of spans of one run of values."""
    n = len(values)
    up, down = _power_tables(n + 1)
    with np.errstate(over="ignore"):
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(values * up[:n], dtype=np.uint64, out=sums[1:])
        spans = (sums[ends] - sums[starts]) * down[starts]
        return mix(spans ^ ((ends - starts).astype(np.uint64) << np.uint64(48)))


class Words:
    """The words of some texts: byte spans, hashes (A-Z as a-z), and where each text's words begin."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, breaks: np.ndarray = BREAKS, hashed: bool = True):
        self.data, self.offsets, n = data, offsets, len(data)
        inside = ~breaks[data]
        before = np.empty(n + 1, bool)
        before[0] = False
        before[1:] = inside
        after = np.empty(n + 1, bool)
        after[:n] = inside
        after[n] = False
        edges = offsets[(offsets > 0) & (offsets < n)]
        before[edges] = False  # a text's end breaks a word
        first = after[:n] & ~before[:n]
        # a word ends where the next byte is a break, another text's, or none
        ends = before[1:].copy()
        following = after[1:].copy()
        following[edges - 1] = False
        ends = inside & ~following
        self.starts, self.ends = np.flatnonzero(first), np.flatnonzero(ends) + 1
        self.bounds = np.searchsorted(self.starts, offsets)
        self.hashes = self._hash() if hashed else None

    def _hash(self) -> np.ndarray:
        return span_hashes(_VALUES[self.data], self.starts, self.ends)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.bounds)


def shingles(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hashes of every k consecutive words of one run of words; none if there are fewer."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    with np.errstate(over="ignore"):
        total = np.zeros(n, np.uint64)
        for i in range(k):
            total = total * np.uint64(0xD6E8FEB86659FD93) + hashes[i : i + n]
    return mix(total, k)


def sequence_key(hashes: np.ndarray) -> tuple[int, int]:
    """Two 64-bit hashes of a whole sequence of words, as signed integers."""
    n = len(hashes)
    up, _ = _power_tables(n + 1)
    with np.errstate(over="ignore"):
        one = mix(np.array([np.sum(mix(hashes, 3) * up[:n], dtype=np.uint64) + np.uint64(n)]), 5)
        two = mix(np.array([np.sum(mix(hashes, 11) * up[:n], dtype=np.uint64) ^ np.uint64(n)]), 7)
    return int(one.view(np.int64)[0]), int(two.view(np.int64)[0])


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string or binary column without copying; a null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, ends, data = column.buffers()
    offsets = np.frombuffer(ends, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)), offsets


def slices(batch: pa.RecordBatch, text: str = "text", most: int = SLICE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of rows (from, to, bytes, offsets from 0) of at most ``most`` bytes, one row at least."""
    if not batch.num_rows:
        return
    data, offsets = buffers(batch.column(batch.schema.get_field_index(text)))
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
        to = min(to, batch.num_rows)
        yield at, to, data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        at = to


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
