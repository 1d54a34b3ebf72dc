"""Suffix arrays with common prefixes by induced sorting, one shard of text at a time.

The suffixes that start a rise after a fall ("stars") are sorted first: the
substrings from star to star get ranks as names, and the names' own suffix array
is found by recursion. The sorted stars then induce all falling suffixes, and
these, in reverse, all rising ones. Either pass is a priority queue: extracting
a suffix inserts the one before it under its own first character, and within a
character first in is first out. As the number of tuples of each character is
known, the queue is one file-like pair of arrays in the order of characters,
where extraction is a scan and insertion appends to a character's stretch;
beyond ``MEMORY`` bytes these arrays are files in Spark's local folders, which
only this task reads. A tuple carries its position and the prefix that it has in
common with the tuple before; that of an inserted suffix is one more than the
least common prefix since the last insertion under the same character.

Scans work on whole runs of filled tuples, so numpy does the work.
"""

from __future__ import annotations

import os
import tempfile

import numpy as np

from newsloom.llm.kernel import mix, span_hashes

#: Bytes of one array of a queue that stay in memory; larger arrays are files.
MEMORY = 64 << 20


def queue_array(n: int, most: int) -> np.ndarray:
    """An array of 32-bit numbers: in memory, or a nameless file where Spark spills too."""
    if 4 * n <= most:
        return np.empty(n, np.int32)
    folder = os.environ.get("SPARK_LOCAL_DIRS", "").split(",")[0] or None
    with tempfile.TemporaryFile(dir=folder) as f:
        return np.memmap(f, np.int32, "w+", shape=(n,))


def range_min(values: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Least of values[low..high] for each pair, ends included, low <= high: a table of powers of two."""
    out = values[low]
    width = (high - low + 1).astype(np.int64)
    level = np.zeros(len(width), np.int64)
    for k in range(1, int(width.max(initial=1)).bit_length()):
        level += width >= (1 << k)
    row, size = values, 1
    for k in range(int(level.max(initial=0)) + 1):
        if k:
            row = np.minimum(row[:-size], row[size:])
            size *= 2
        at = np.flatnonzero(level == k)
        out[at] = np.minimum(row[low[at]], row[high[at] - size + 1])
    return out


def _induce(text: np.ndarray, run: np.ndarray, letters: int, counts: np.ndarray, seeds: np.ndarray, seed_lcp: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes that ``seeds`` (in order) induce, in order, and their common prefixes; ``counts`` of them begin with each character.

    Within a character the induced suffixes come before its seeds.
    """
    seeded = np.bincount(text[seeds], minlength=letters)
    start = np.concatenate([[0], np.cumsum(counts + seeded)])
    turn = start[:-1] + counts  # where a character's seeds begin
    place, common = queue_array(int(start[-1]), most), queue_array(int(start[-1]), most)
    at = turn[text[seeds]] + np.arange(len(seeds)) - np.concatenate([[0], np.cumsum(seeded)])[text[seeds]]
    place[at], common[at] = seeds, seed_lcp
    free, pend, stamp = start[:-1].copy(), np.zeros(letters, np.int32), np.full(letters, -1)
    touched, i, c = np.empty(0, np.int64), 0, 0
    while i < start[-1]:
        while start[c + 1] <= i:
            c += 1
        to = c
        while to < letters and free[to] == turn[to]:
            to += 1
        j = int(start[-1] if to == letters else free[to])  # all before j is filled
        pos, l = np.array(place[i:j]), np.array(common[i:j])
        own = text[pos]
        new = np.concatenate([[i == start[c]], own[1:] != own[:-1]])
        index = np.arange(i, j)
        seed = index >= turn[own]
        edge = np.flatnonzero((index == turn[own]) & ~new)  # the first seed after induced ones
        if len(edge):
            before = np.where(edge > 0, pos[edge - 1], place[i - 1] if i else 0)
            l[edge] = np.minimum(run[before], run[pos[edge]])
        l[new] = 0
        common[i:j] = l
        prior = text[pos - 1]  # of position 0: the last character, which is smallest
        taken = np.flatnonzero((pos > 0) & ((prior > own) | ((prior == own) & ~seed)))
        goes_on = not new[0]
        if goes_on and len(touched):
            old, left = touched, np.minimum(pend[touched], l.min())
        else:
            old, left = touched[:0], None
        if len(taken):
            order = np.argsort(prior[taken], kind="stable")
            source, target = taken[order], prior[taken][order]
            first = np.concatenate([[True], target[1:] != target[:-1]])
            heads = np.flatnonzero(first)
            sizes = np.diff(np.concatenate([heads, [len(target)]]))
            where = free[target] + np.arange(len(target)) - np.repeat(heads, sizes)
            lcp = np.empty(len(target), np.int32)
            rest = np.flatnonzero(~first)
            if len(rest):
                lcp[rest] = range_min(l, source[rest - 1] + 1, source[rest])
            carried = np.zeros(len(heads), np.int32)
            if goes_on:
                known = stamp[target[heads]] == c
                least = np.minimum.accumulate(l)
                carried[known] = np.minimum(pend[target[heads[known]]], least[source[heads[known]]])
            lcp[heads] = carried
            place[where], common[where] = pos[source] - 1, lcp + 1
            free[target[heads]] += sizes
        last = int(own[-1])
        if len(old) and last == c:
            pend[old] = left
        elif last != c:
            touched = np.empty(0, np.int64)
        if not goes_on and last == c:
            touched = np.empty(0, np.int64)
        if len(taken):
            ends = heads + sizes - 1
            mine = own[source[ends]] == last
            t, s = target[ends][mine], source[ends][mine]
            tail = np.concatenate([np.minimum.accumulate(l[::-1])[::-1], [np.iinfo(np.int32).max]])
            pend[t] = tail[s + 1]
            touched = np.concatenate([touched, t[stamp[t] != last] if last == c and goes_on else t])
            stamp[t] = last
        c, i = last, j
    keep = np.arange(start[-1]) < np.repeat(turn, counts + seeded)
    return place[keep], common[keep]


def suffix_array(text: np.ndarray, most: int = MEMORY) -> tuple[np.ndarray, np.ndarray]:
    """Starts of all suffixes in order, and what each has in common with the one before (the first: 0).

    ``text``: integers from 0, the last one 0 and the only 0.
    """
    n = len(text)
    if n == 1:
        return np.zeros(1, np.int32), np.zeros(1, np.int32)
    text = np.ascontiguousarray(text, np.int32)
    letters = int(text.max()) + 1
    step = np.sign(np.diff(text))
    turn = np.minimum.accumulate(np.where(step != 0, np.arange(n - 1), n)[::-1])[::-1]
    rising = np.append(step[turn] > 0, True)
    run = np.append(turn - np.arange(n - 1) + 1, 1).astype(np.int32)
    stars = np.flatnonzero(rising[1:] & ~rising[:-1]) + 1
    names = _names(text, stars)
    if names.max() + 1 == len(stars):
        order, shared = np.argsort(names), np.zeros(len(stars), np.int32)
    else:
        order, shared = suffix_array(names, most)
    seeds, ends = stars[order], np.append(stars, n)
    lcp = np.zeros(len(stars), np.int32)
    a, b = seeds[:-1], seeds[1:]
    lcp[1:] = ends[order[1:] + shared[1:]] - b  # whole names in common, then characters
    open_ = np.arange(len(a))
    while len(open_):
        open_ = open_[text[a[open_] + lcp[1:][open_]] == text[b[open_] + lcp[1:][open_]]]
        lcp[open_ + 1] += 1
    falling, fall_lcp = _induce(text, run, letters, np.bincount(text[~rising], minlength=letters), seeds, lcp, most)
    flipped = letters - 1 - text
    risen = np.bincount(flipped[:-1][rising[:-1]], minlength=letters)
    up, up_lcp = _induce(flipped, run, letters, risen, falling[::-1], _back(fall_lcp), most)
    up, up_lcp = np.append(up, n - 1)[::-1], np.append(0, _back(up_lcp))
    every, every_lcp = np.concatenate([falling, up]), np.concatenate([fall_lcp, up_lcp])
    key = 2 * text[every].astype(np.int64) + rising[every]
    order = np.argsort(key, kind="stable")
    found, lcp, key = every[order], every_lcp[order], key[order]
    edge = np.flatnonzero(key[1:] != key[:-1]) + 1
    lcp[edge] = np.where(key[edge] >> 1 == key[edge - 1] >> 1, np.minimum(run[found[edge]], run[found[edge - 1]]), 0)
    lcp[0] = 0
    return found.astype(np.int32), lcp.astype(np.int32)


def _back(lcp: np.ndarray) -> np.ndarray:
    """Common prefixes of the same suffixes in reverse order."""
    return np.concatenate([[0], lcp[:0:-1]]).astype(np.int32) if len(lcp) else lcp


def _names(text: np.ndarray, stars: np.ndarray) -> np.ndarray:
    """Ranks of the substrings from star to star; of two, one of which begins the other, the longer is smaller."""
    ends = np.append(stars[1:], len(text) - 1) + 1
    kinds, first, which = np.unique(span_hashes(mix(text.astype(np.uint64), 9), stars, ends), return_index=True, return_inverse=True)
    wide = text.astype(">u4")
    bodies = [wide[stars[f] : ends[f]].tobytes() + b"\xff\xff\xff\xff" for f in first]
    rank = np.empty(len(kinds), np.int64)
    rank[sorted(range(len(kinds)), key=bodies.__getitem__)] = np.arange(len(kinds))
    return rank[which].astype(np.int32)
