"""Decontamination by latent semantic retrieval of benchmark passages.

1. Passages of the benchmark are cut into retrieval parts of ``PART`` words at most, which overlap by half. All passages
   of ``PART`` words of all documents join them. Frequencies over all these weight the benchmark's words (TF-IDF), within
   ``WEIGHTS``, so that no passage is without length however often it leaks.
2. Parts are taken in spaces of ``SPACE`` at most. For each a randomised SVD of the sparse rows gives latent axes, half as
   many as it has parts: Spark adds up the rows' products of words over tasks, in blocks, and multiplies these with a thin
   matrix. ``TOGETHER`` spaces share a scan.
3. Every document is cut into overlapping windows, laid along the axes. Windows and parts whose latent vectors have a
   cosine of ``cosine`` or more, and of which the window covers ``covers`` of the part's length, are candidates for the
   whole passage where the part says that it should stand.
4. Each candidate is checked against the text there: the longest common subsequence of words must hold ``sure`` of the
   passage, or ``likely`` of it and ``answer`` of its last sentence, in order.

Words are lower-case and without the marks ``MARKS``.

Defined cases: null or blank documents, and passages without a word, match nothing; a passage of any length is found
through its parts; very long documents are read whole, 1 MB of text at a time; equal rows match alike, one row for each;
of several places with a passage the one with the longest subsequence is named, of equal ones the first; no documents
or no passages: an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, pieces, saved

MARKS = b".,;:!?"
FOUND = "doc_id long, item_id long, cosine double, lcs double, answer double, start long"
BLOCK = 12
#: Most words of a retrieval part; parts of up to ``SHORT`` words are compared with windows of two blocks, others of four.
PART, SHORT = 48, 30
#: Least and largest weight of a word.
WEIGHTS = 1.5, 6.0
#: Share of the benchmark's energy that the passages of the documents get in the SVD.
SHARE = 0.25
#: Most products of words that a task adds up at a time, about, and that a block of them has.
BAND_CELLS, BLOCK_CELLS = 1 << 24, 1 << 16
#: Most parts of a space, and spaces that are compared in one scan of the documents.
SPACE, TOGETHER = 384, 8


def words_of(text: str | None) -> list[bytes]:
    return (text or "").lower().encode().translate(None, MARKS).split()


def last_sentence(text: str) -> str:
    return ([x for x in re.split(r"(?<=[.!?])\s+", text) if words_of(x)] or [""])[-1]


def parts_of(n: int) -> list[tuple[int, int]]:
    """(start, stop) of the retrieval parts of a passage of ``n`` words."""
    if n <= PART:
        return [(0, n)]
    size = 3 * PART // 4
    return [(min(at, n - size), min(at, n - size) + size) for at in range(0, n - size // 2, size // 2)]


class Vocabulary:
    """Numbers of the benchmark's words."""

    def __init__(self, passages: list[list[bytes]]):
        self.ids = {w: k for k, w in enumerate(sorted({w for x in passages for w in x}))}
        self.size = len(self.ids)

    def of(self, words: list[bytes]) -> np.ndarray:
        get = self.ids.get
        return np.array([get(w, -1) for w in words], np.int64)


def sparse(ids: np.ndarray, row: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, word, count) of words given with their rows; words that are no benchmark's are left out."""
    known = ids >= 0
    both, counts = np.unique(row[known] * size + ids[known], return_counts=True)
    return both // max(size, 1), both % max(size, 1), counts


def weighed(word: np.ndarray, counts: np.ndarray, row: np.ndarray, rows: int, weights: np.ndarray) -> np.ndarray:
    """TF-IDF values of sparse rows, each row of length one."""
    x = counts * weights[word]
    return x / np.sqrt(np.maximum(np.bincount(row, x * x, rows), 1e-12))[row]


def passage_rows(docs: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """(words, counts): sparse rows of all passages of ``PART`` words of all documents that hold a word of the benchmark."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches):
        vocabulary = shared.value
        for batch in batches:
            for part in pieces(batch, "text", 1 << 20):
                split = [words_of(x) for x in part.column(part.schema.get_field_index("text")).to_pylist()]
                lengths = np.array([len(x) for x in split], np.int64)
                begin, passages = np.cumsum(lengths) - lengths, -(-lengths // PART)
                within = np.arange(int(lengths.sum())) - np.repeat(begin, lengths)
                row = np.repeat(np.cumsum(passages) - passages, lengths) + within // PART
                r, w, c = sparse(vocabulary.of([w for x in split for w in x]), row, vocabulary.size)
                cuts = np.flatnonzero(np.concatenate(([True], r[1:] != r[:-1]))) if len(r) else np.zeros(0, np.int64)
                offsets = pa.array(np.append(cuts, len(r)).astype(np.int32))
                yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(offsets, pa.array(x.astype(np.int32))) for x in (w, c)], ["words", "counts"])

    return docs.select("text").mapInArrow(run, "words array<int>, counts array<int>")


def flat(batch) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(row, word, count) of a batch of sparse rows, and the number of rows."""
    lists = batch.column(0)
    row = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
    return row, lists.flatten().to_numpy(), batch.column(1).flatten().to_numpy(), len(lists)


def frequencies(rows: DataFrame, size: int) -> tuple[np.ndarray, int]:
    """Rows that hold each word, and all rows."""

    def run(batches):
        total = np.zeros(size, np.int64)
        for batch in batches:
            total += np.bincount(batch.column(0).flatten().to_numpy(), minlength=size)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(total[held])], ["w", "n"])

    counts = np.zeros(size, np.int64)
    for w, n in rows.select("words").mapInArrow(run, "w long, n long").groupBy("w").agg(F.sum("n")).collect():  # the vocabulary's size at most
        counts[w] = n
    return counts, rows.count()


def products(rows: DataFrame, local: np.ndarray, weights: np.ndarray) -> DataFrame:
    """(at, part): A' A, where A has the TF-IDF values of ``rows`` (words, counts, scale), times their scale; ``part`` has the
    products of some words, from ``at`` on, with all words. Blocks without a product are left out.

    A task adds up ``BAND_CELLS`` at a time; with more of them, the words are taken in bands and the rows read once for each.
    """
    size = len(weights)
    width = max(1, BLOCK_CELLS // size)
    band = max(1, BAND_CELLS // size // width) * width
    shared = rows.sparkSession.sparkContext.broadcast((local, weights))

    def of(low: int, high: int):
        def run(batches):
            local, weights = shared.value
            total = np.zeros((high - low) * size, np.float32)
            for batch in batches:
                for some in (batch.slice(at, 512) for at in range(0, batch.num_rows, 512)):
                    row, word, counts, n = flat(some)
                    known = local[word] >= 0
                    row, word, counts = row[known], local[word[known]], counts[known]
                    x = (weighed(word, counts, row, n, weights) * some.column(2).to_numpy()[row]).astype(np.float32)
                    lengths = np.bincount(row, minlength=n)
                    begin = np.cumsum(lengths) - lengths
                    # Each word of the band meets all words of its row.
                    own = np.flatnonzero((word >= low) & (word < high))
                    many = lengths[row[own]]
                    left = np.repeat(own, many)
                    right = np.arange(len(left)) + np.repeat(begin[row[own]] - (np.cumsum(many) - many), many)
                    np.add.at(total, (word[left] - low) * size + word[right], x[left] * x[right])
            for at in range(low, high, width):
                block = total[(at - low) * size : (at - low + width) * size]
                cells = np.flatnonzero(block)
                if len(cells):
                    yield pa.RecordBatch.from_arrays([pa.array([at]), *(pa.ListArray.from_arrays(pa.array([0, len(cells)], pa.int32()), x) for x in (pa.array(cells.astype(np.int32)), pa.array(block[cells])))], ["at", "cells", "sums"])

        return run

    def add(key, parts):
        at = key[0].as_py()
        cells, sums = (np.concatenate([x.flatten().to_numpy() for x in parts[name].chunks]) for name in ("cells", "sums"))
        total = np.bincount(cells, sums, min(width, size - at) * size).astype(np.float32)
        return pa.table({"at": pa.array([at]), "part": pa.ListArray.from_arrays(pa.array([0, len(total)], pa.int32()), pa.array(total))})

    rows = rows.select("words", "counts", "scale")
    bands = [rows.mapInArrow(of(low, min(size, low + band)), "at long, cells array<int>, sums array<float>") for low in range(0, size, band)]
    return reduce(DataFrame.union, bands).groupBy("at").applyInArrow(add, "at long, part array<float>")


def latent_axes(rows: DataFrame, local: np.ndarray, weights: np.ndarray, rank: int, rounds: int = 2, seed: int = 5) -> np.ndarray:
    """Orthonormal axes (word x rank): the right singular vectors of the TF-IDF matrix of ``rows`` (words, counts, scale),
    by randomised subspace iteration over its saved ``products``; the driver holds word x rank numbers.

    ``local`` numbers the words of the space (-1: none of it), ``weights`` are theirs.
    """
    size = len(weights)
    blocks = saved(products(rows, local, weights))

    def times(thin: np.ndarray) -> np.ndarray:
        """A' A thin, where A has the rows, times their scale."""
        right = rows.sparkSession.sparkContext.broadcast(thin)

        def run(batches):
            for batch in batches:
                for at in range(batch.num_rows):
                    block = batch.column(1)[at].values.to_numpy().reshape(-1, len(right.value)) @ right.value
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, 1), pa.array([block.ravel()], pa.list_(pa.float32()))], ["at", "part"])

        out = np.zeros(thin.shape)
        for at, part in blocks.mapInArrow(run, "at long, part array<float>").collect():  # words of the benchmark x rank
            block = np.array(part).reshape(-1, thin.shape[1])
            out[at : at + len(block)] = block
        return out

    axes = np.random.default_rng(seed).standard_normal((size, min(rank + 16, size))).astype(np.float32)
    for _ in range(rounds):
        axes = np.linalg.qr(times(axes))[0].astype(np.float32)
    # Rayleigh-Ritz: the best axes within the subspace.
    small = axes.T.astype(np.float64) @ times(axes)
    values, turn = np.linalg.eigh((small + small.T) / 2)
    return (axes @ turn[:, ::-1][:, :rank]).astype(np.float32)


def common_subsequence(passage: dict[int, int], words) -> int:
    """Length of the longest common subsequence; ``passage``: word -> bits of its places."""
    row = 0
    for w in words:
        at = passage.get(w)
        if at:
            x = row | at
            row = x & ~(x - ((row << 1) | 1))
    return row.bit_count()


def places(words) -> dict[int, int]:
    out: dict[int, int] = {}
    for k, w in enumerate(words):
        out[w] = out.get(w, 0) | 1 << k
    return out


def matches(docs: DataFrame, items: DataFrame, cosine: float = 0.5, covers: float = 0.4, sure: float = 0.7, likely: float = 0.5, answer: float = 0.8, slice_bytes: int = 4 << 20) -> DataFrame:
    """(doc_id, item_id, cosine, lcs, answer, start): every document and passage of which it holds a copy or paraphrase;
    ``start`` is about where the passage begins, in words. The benchmark is collected ``slice_bytes`` at a time."""
    items = cut(items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).filter("text is not null"))
    slices = -(-(items.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // slice_bytes)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = docs.sparkSession.createDataFrame([], FOUND)
    for k in range(slices):
        some = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(slices)) == k)
        named = [(i, t) for i, t in sorted(map(tuple, some.collect()), key=str) if words_of(t)]  # slice_bytes, about
        if named:
            passages = Passages(named)
            spaces = spaces_of(docs, passages)
            for at in range(0, len(spaces), TOGETHER):
                out = out.union(_compared(docs, passages, spaces[at : at + TOGETHER], cosine, covers, sure, likely, answer))
    return out


class Passages:
    """A slice of the benchmark: its words, names, parts (passage, first and last word), and what checks need."""

    def __init__(self, named: list[tuple]):
        whole = [words_of(t) for _, t in named]
        self.vocabulary = Vocabulary(whole)
        self.ids = [self.vocabulary.of(x) for x in whole]
        self.names = [i for i, _ in named]
        self.bits = [(len(x), places(x.tolist())) for x in self.ids]
        ends = [self.vocabulary.of(words_of(last_sentence(t))).tolist() for _, t in named]
        self.ends = [(max(1, len(x)), places(x)) for x in ends]
        self.parts = [(k, a, b) for k, x in enumerate(self.ids) for a, b in parts_of(len(x))]


class Space:
    """Latent space of some parts: places of all words among its own, weighted axes, and the parts along the axes."""

    def __init__(self, passages: Passages, parts: list[tuple], others: DataFrame, counts: np.ndarray, n: int):
        spark = others.sparkSession
        self.item, self.offset, stop = (np.array(x) for x in zip(*parts, strict=True))
        self.short = stop - self.offset <= SHORT
        row = np.repeat(np.arange(len(parts)), stop - self.offset)
        r, word, c = sparse(np.concatenate([passages.ids[k][a:b] for k, a, b in parts]), row, passages.vocabulary.size)
        own = np.unique(word)
        self.local = np.full(passages.vocabulary.size, -1)
        self.local[own] = np.arange(len(own))
        n += len(parts)
        weights = np.clip(np.log((n + 1) / (counts[own] + np.bincount(self.local[word], minlength=len(own)) + 1)), *WEIGHTS).astype(np.float32)
        cuts = np.append(np.flatnonzero(np.concatenate(([True], r[1:] != r[:-1]))), len(r)).astype(np.int32)
        rows = spark.createDataFrame(pa.table({"words": pa.ListArray.from_arrays(pa.array(cuts), pa.array(word.astype(np.int32))), "counts": pa.ListArray.from_arrays(pa.array(cuts), pa.array(c.astype(np.int32)))}))
        scale = float(np.sqrt(SHARE * len(parts) / max(1, n - len(parts))))
        rows = others.withColumn("scale", F.lit(scale)).union(rows.withColumn("scale", F.lit(1.0)))
        axes = latent_axes(rows, self.local, weights, max(1, min(max(16, len(parts) // 2), n - 1)))
        # The last row is for words that are none of the space.
        self.axes = np.concatenate((axes * weights[:, None], np.zeros((1, axes.shape[1]), np.float32)))
        latent = np.zeros((len(parts), axes.shape[1]), np.float32)
        np.add.at(latent, r, c[:, None].astype(np.float32) * self.axes[self.local[word]])
        self.lengths = np.maximum(np.linalg.norm(latent, axis=1), 1e-6)
        self.latent = latent / self.lengths[:, None]


def spaces_of(docs: DataFrame, passages: Passages) -> list[Space]:
    others = saved(passage_rows(docs, passages.vocabulary))
    counts, n = frequencies(others, passages.vocabulary.size)
    return [Space(passages, passages.parts[at : at + SPACE], others, counts, n) for at in range(0, len(passages.parts), SPACE)]


def block_sums(ids: np.ndarray, block: np.ndarray, n: int, axes: np.ndarray) -> np.ndarray:
    """Latent vectors of blocks of words."""
    out = np.zeros((n, axes.shape[1]), np.float32)
    word = np.flatnonzero(ids >= 0)
    rows = block[word]
    heads = np.flatnonzero(np.concatenate(([True], rows[1:] != rows[:-1]))) if len(rows) else word
    within = np.arange(len(rows)) - np.repeat(heads, np.diff(np.append(heads, len(rows))))
    order = np.argsort(within, kind="stable")
    cuts = np.searchsorted(within[order], np.arange(BLOCK + 1))
    for k in range(BLOCK):  # the k-th known word of every block
        some = order[cuts[k] : cuts[k + 1]]
        out[rows[some]] += axes[ids[word[some]]]
    return out


def candidates(space: Space, ids: np.ndarray, lengths: np.ndarray, cosine: float, covers: float):
    """(document, passage, first and last place where it should begin, cosine): windows and parts that are alike; windows
    that follow each other are put together, up to four blocks."""
    blocks = -(-lengths // BLOCK)
    first = np.cumsum(blocks) - blocks
    within = np.arange(len(ids)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    n = int(blocks.sum())
    document = np.repeat(np.arange(len(lengths)), blocks)
    sums = block_sums(np.where(ids >= 0, space.local[ids], -1), np.repeat(first, lengths) + within // BLOCK, n, space.axes)
    found = []
    for size, chosen in ((2, np.flatnonzero(space.short)), (4, np.flatnonzero(~space.short))):
        if not n or not len(chosen):
            continue
        windows = sums.copy()
        stop = np.minimum(np.arange(n) + size, (first + blocks)[document])
        for k in range(1, size):
            more = np.flatnonzero(np.arange(n) + k < stop)
            windows[more] += sums[more + k]
        length = np.sqrt(np.einsum("ij,ij->i", windows, windows))
        latent, least = space.latent[chosen], covers * space.lengths[chosen].min()
        rich = np.flatnonzero(length >= max(least, 1e-6))
        for at in range(0, len(rich), 8192):
            some = rich[at : at + 8192]
            dots = windows[some] @ latent.T
            w, p = np.nonzero(dots >= np.maximum(cosine * length[some, None], covers * space.lengths[chosen]))
            found.append((document[some[w]], chosen[p], some[w] - first[document[some[w]]], dots[w, p] / length[some[w]]))
    if not found:
        return (np.zeros(0, np.int64),) * 5
    d, part, at, like = (np.concatenate([x[k] for x in found]) for k in range(4))
    order = np.lexsort((at, part, d))
    d, part, at, like = d[order], part[order], at[order], like[order]
    new = np.concatenate(([True], (d[1:] != d[:-1]) | (part[1:] != part[:-1]) | (at[1:] != at[:-1] + 1)))[: len(d)]
    run = np.maximum.accumulate(np.where(new, np.arange(len(d)), 0))
    heads = np.flatnonzero(new | ((np.arange(len(d)) - run) % 4 == 0))
    if not len(heads):
        return (np.zeros(0, np.int64),) * 5
    last = np.append(heads[1:], len(d)) - 1
    offset = space.offset[part[heads]]
    return d[heads], space.item[part[heads]], at[heads] * BLOCK - offset, at[last] * BLOCK - offset, np.maximum.reduceat(like, heads)


def _compared(docs, passages: Passages, spaces: list[Space], cosine, covers, sure, likely, answer) -> DataFrame:
    """The matches of one scan of the documents."""
    shared = docs.sparkSession.sparkContext.broadcast((passages.vocabulary, passages.names, passages.bits, passages.ends, spaces))

    def run(batches):
        vocabulary, names, passages, ends, spaces = shared.value
        for batch in batches:
            for part in pieces(batch, "text", 1 << 20):
                split = [words_of(x) for x in part.column(1).to_pylist()]
                lengths = np.array([len(x) for x in split], np.int64)
                ids = vocabulary.of([w for x in split for w in x])
                begin = np.cumsum(lengths) - lengths
                best = {}
                for space in spaces:
                    for d, i, low, high, like in zip(*(x.tolist() for x in candidates(space, ids, lengths, cosine, covers)), strict=True):
                        length, bits = passages[i]
                        known = best.get((d, i))
                        if known and known[1] == 1:
                            continue
                        a, b = begin[d] + max(0, low - length), begin[d] + min(lengths[d], high + 2 * length + 4 * BLOCK)
                        around = [w for w in ids[a:b].tolist() if w in bits]
                        if len(around) < min(sure, likely) * length:
                            continue
                        lcs = common_subsequence(bits, around) / length
                        if lcs < min(sure, likely) or (known and lcs <= known[1]):
                            continue
                        end = common_subsequence(ends[i][1], around) / ends[i][0]
                        if lcs >= sure or (lcs >= likely and end >= answer):
                            best[d, i] = like, lcs, end, max(0, low)
                found = [(d, names[i], *x) for (d, i), x in best.items()]
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array([x[0] for x in found], pa.int64())), *(pa.array([x[k] for x in found], t) for k, t in zip(range(1, 6), (pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.int64()), strict=True))], ["doc_id", "item_id", "cosine", "lcs", "answer", "start"])

    return docs.mapInArrow(run, FOUND)
