"""Periodic runs of words: stretches that repeat a period at least twice and that no neighbouring word extends.

All suffixes of a document that begin with equal words form classes, which grow as fewer words are asked for. Neighbours
in suffix order are taken by decreasing common prefix L and their classes united, each an ordered set of positions.
Positions a < b that become neighbours in a united class repeat L words at distance b - a; where that distance is at most L
they seed a run of b - a + L words, which no word on the right extends, as L is all that they share. One of a
run's seeds begins where no word on the left extends it either, and that one is kept. Positions between a and b would
repeat earlier, so b - a is the smallest period.

Runs of at least ``least`` words share half as many words with themselves, so documents in which no window of that size
occurs twice are passed over; suffixes of all others are sorted whole, many documents at a time.

Defined cases: a null, empty or blank text has no words and no runs; very long texts are judged whole; runs of equal start
are ordered by period; repeated rows are judged alike; an empty table gives an empty result; a null doc_id is carried
through; columns that clash with new ones are left out of ``runs`` and kept by ``without_repetition``.
"""

from __future__ import annotations

import hashlib
import itertools
import zlib
from bisect import bisect_left, insort
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mixed, pieces, text_bytes
from .spans import Rolling, covered

LEAST = 12
RUNS = "doc_id long, start long, length long, period long"
DIGEST = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


def numbered(words: list[bytes]) -> np.ndarray:
    """The number of each word among the different ones."""
    known = defaultdict(itertools.count().__next__)
    return np.fromiter(map(known.__getitem__, words), np.int64, len(words))


def with_repeats(symbols: np.ndarray, lengths: np.ndarray, size: int) -> np.ndarray:
    """The documents in which some window of ``size`` symbols may occur twice."""
    ends = np.cumsum(lengths)
    doc = np.repeat(np.arange(len(lengths)), lengths)
    n = len(symbols) - size + 1
    if n <= 1:
        return np.zeros(0, np.int64)
    inside = np.arange(n) + size <= ends[doc[:n]]
    with np.errstate(over="ignore"):
        keys = mixed(Rolling(mixed(symbols.astype(np.uint64) + np.uint64(1))).fixed(size)[:n] + doc[:n].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    where = np.flatnonzero(inside)
    order = np.argsort(keys[where])
    found = keys[where][order]
    twice = np.flatnonzero(found[1:] == found[:-1])
    return np.unique(doc[where[order[twice]]])


def windows(symbols: np.ndarray, ends: np.ndarray, size: int) -> list[np.ndarray]:
    """Keys, the most significant first, that order the windows of ``size`` symbols from each place; a document's end comes before any symbol."""
    n = len(symbols)
    bits = int(symbols.max() + 1).bit_length() if n else 1
    each = max(1, 63 // bits)
    padded = np.concatenate((symbols + 1, np.zeros(size, np.int64)))
    at, out = np.arange(n), []
    for first in range(0, size, each):
        key = np.zeros(n, np.int64)
        for k in range(first, min(size, first + each)):
            key = (key << bits) | np.where(at + k < ends, padded[k : k + n], 0)
        out.append(key)
    return out


def shared_prefixes(symbols: np.ndarray, lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a, b, L): neighbours in the order of a document's suffixes that share L symbols, ``size`` or more.

    Suffixes are ranked by ``size`` symbols, then by twice as many, of those alone that are not told apart yet. The ranks
    of all steps then give L from the largest power down.
    """
    n = len(symbols)
    ends = np.repeat(np.cumsum(lengths), lengths)
    doc = np.repeat(np.arange(len(lengths)), lengths)
    keys = windows(symbols, ends, size)
    order = np.lexsort((*keys[::-1], doc))
    new = np.ones(n, bool)
    new[1:] = doc[order[1:]] != doc[order[:-1]]
    for key in keys:
        new[1:] |= key[order[1:]] != key[order[:-1]]
    rank = np.empty(n, np.int32)
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    steps, k = [rank.copy()], size
    alike = np.flatnonzero(~new)
    a, b = order[alike - 1], order[alike]
    open_ = np.union1d(alike, alike - 1)
    while len(open_):
        place = order[open_]
        own = rank[place]
        then = np.where(place + k < ends[place], rank[np.minimum(place + k, n - 1)] + 1, 0)
        by = np.lexsort((then, own))
        place, own, then = place[by], own[by], then[by]
        order[open_] = place
        head = np.ones(len(place), bool)
        head[1:] = (own[1:] != own[:-1]) | (then[1:] != then[:-1])
        rank[place] = np.maximum.accumulate(np.where(head, open_, 0))
        steps.append(rank.copy())
        single = head & np.append(head[1:], True)
        open_, k = open_[~single], 2 * k
    a, b = order[alike - 1], order[alike]
    same = np.zeros(len(a), np.int64)
    for t in range(len(steps) - 1, -1, -1):
        x, y = a + same, b + same
        there = (x < ends[a]) & (y < ends[b])
        x, y = np.minimum(x, n - 1), np.minimum(y, n - 1)
        same += np.where(there & (steps[t][x] == steps[t][y]), size << t, 0)
    more = np.ones(len(a), bool)
    for _ in range(size - 1):
        x, y = a + same, b + same
        more &= (x < ends[a]) & (y < ends[b])
        more &= symbols[np.minimum(x, n - 1)] == symbols[np.minimum(y, n - 1)]
        same += more
    return a, b, same


def seeds(a: list[int], b: list[int], same: list[int], before: list[int], least: int) -> list[tuple[int, int, int]]:
    """(start, L, period) of all runs, from neighbours by decreasing L; ``before`` holds the symbol before each place."""
    sets: dict[int, list[int]] = {}
    waiting: list[tuple[int, int]] = []
    out = []

    def settle(shared: int) -> None:
        # Of the pairs that this L brought together, those that are still neighbours when all of its classes are united.
        for x, y in waiting:
            own = sets[x]
            k = bisect_left(own, x) + 1
            if k < len(own) and own[k] == y:
                out.append((x, shared, y - x))
        waiting.clear()

    last = None
    for i, j, shared in zip(a, b, same, strict=True):
        if shared != last:
            settle(last)
            last = shared
        large, small = sets.get(i) or [i], sets.get(j) or [j]
        if len(large) < len(small):
            large, small = small, large
        if len(large) == 1:
            sets[large[0]] = large
        n, m = len(large), len(small)
        for k, x in enumerate(small):
            at = bisect_left(large, x)
            if at:
                y = large[at - 1]
                if x - y <= shared and x - y + shared >= least and (not k or small[k - 1] < y) and before[x] != before[y]:
                    waiting.append((y, x))
            if at < n:
                y = large[at]
                if y - x <= shared and y - x + shared >= least and (k + 1 == m or small[k + 1] > y) and before[x] != before[y]:
                    waiting.append((x, y))
        for x in small:
            sets[x] = large
        if 16 * m < n:
            for x in small:
                insort(large, x)
        else:
            large += small
            large.sort()
    settle(last)
    return out


def find_runs(symbols: np.ndarray, lengths: np.ndarray, least: int = LEAST) -> np.ndarray:
    """Rows (document, start, length, period) of all runs of at least ``least`` symbols in documents laid end to end, in order."""
    size = -(-least // 2)
    some = with_repeats(symbols, lengths, size)
    if not len(some):
        return np.zeros((0, 4), np.int64)
    own = lengths[some]
    begins = (np.cumsum(lengths) - lengths)[some]
    starts = np.cumsum(own) - own
    chosen = symbols[np.repeat(begins - starts, own) + np.arange(own.sum())]
    a, b, same = shared_prefixes(chosen, own, size)
    by = np.argsort(-same, kind="stable")
    before = np.concatenate(([-1], chosen[:-1]))
    before[starts] = -1
    found = seeds(a[by].tolist(), b[by].tolist(), same[by].tolist(), before.tolist(), least)
    if not found:
        return np.zeros((0, 4), np.int64)
    start, shared, period = np.array(found, np.int64).T
    k = np.searchsorted(starts, start, "right") - 1
    rows = np.stack((some[k], start - starts[k], shared + period, period), 1)
    return rows[np.lexsort((rows[:, 3], rows[:, 1], rows[:, 0]))]


def judged(texts: list[list[bytes]], least: int) -> list[np.ndarray]:
    """The runs (start, length, period) of each list of words."""
    lengths = np.array([len(x) for x in texts], np.int64)
    rows = find_runs(numbered(list(itertools.chain.from_iterable(texts))), lengths, least)
    stops = np.searchsorted(rows[:, 0], np.arange(len(texts) + 1))
    return [rows[i:j, 1:] for i, j in itertools.pairwise(stops)]


def once(words: list[bytes], runs: np.ndarray) -> list[bytes]:
    """``words`` without those that a run holds after its first period."""
    if not len(runs):
        return words
    gone = covered(len(words), runs[:, 0] + runs[:, 2], runs[:, 0] + runs[:, 1])
    return [w for w, g in zip(words, gone.tolist(), strict=True) if not g]


def planted(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The words of one document in ten with all from some place on in a period, as the query over all documents asks."""
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if doc_id is None or h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    period = words[a : a + p]
    return words[:a] + (period * (-(-(n - a) // p)))[: n - a]


def runs(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """doc_id, start, length and period of every run, in words."""

    def run(batches):
        for batch in batches:
            for part in pieces(batch, "text"):
                ids = part.column(0).to_pylist()
                found = judged([t.split() for t in text_bytes(part.column(1))], least)
                rows = np.concatenate([np.zeros((0, 3), np.int64), *found])
                named = [i for i, x in zip(ids, found, strict=True) for _ in range(len(x))]
                yield pa.RecordBatch.from_arrays([pa.array(named, pa.int64()), *(pa.array(np.ascontiguousarray(rows[:, k])) for k in range(3))], ["doc_id", "start", "length", "period"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, RUNS)


def without_repetition(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """``docs``, texts with runs reduced to their words outside of repeated periods, joined by spaces; all others as they are."""

    def run(batches):
        for batch in batches:
            at = batch.schema.get_field_index("text")
            for part in pieces(batch, "text"):
                words = [t.split() for t in text_bytes(part.column(at))]
                old = part.column(at).to_pylist()
                new = [b" ".join(once(w, x)).decode() if len(x) else t for w, x, t in zip(words, judged(words, least), old, strict=True)]
                yield part.set_column(at, part.schema.field(at), pa.array(new, part.schema.field(at).type))

    return docs.withColumn("text", F.col("text").cast("string")).mapInArrow(run, docs.withColumn("text", F.col("text").cast("string")).schema)


def digest(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """Of each document, some of which are made periodic first (``planted``), the longest run and hashes of all runs and of what is left."""

    def row(doc_id, words, found):
        best = min(found.tolist(), key=lambda x: (-x[1], x[0], x[2]), default=None)
        told = "".join(f"{s},{n},{q}\n" for s, n, q in found.tolist())
        longest = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
        return (doc_id, len(found), *longest, hashlib.sha256(told.encode()).hexdigest(), hashlib.sha256(b" ".join(once(words, found))).hexdigest())

    kinds = [*(pa.int64(),) * 6, pa.string(), pa.string()]
    names = [x.split()[0] for x in DIGEST.split(", ")]

    def run(batches):
        for batch in batches:
            for part in pieces(batch, "text"):
                ids = part.column(0).to_pylist()
                texts = [planted(i, t.split()) for i, t in zip(ids, text_bytes(part.column(1)), strict=True)]
                rows = list(map(row, ids, texts, judged(texts, least)))
                yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in rows], t) for k, t in enumerate(kinds)], names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, DIGEST)
