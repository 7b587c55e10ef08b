"""Removal of repeated word spans by compaction of a sparse de Bruijn graph.

The windows of ``width`` words are the edges of the graph, the anchor k-mers they choose (``spans``) its nodes. The
windows of one node in one place form a path without branches; equal paths compact to one row (node, path) with its
number of places and its first source coordinates. A node that occurs once has no repeats and is dropped by a join. A
node with a single path is decided by that path's coordinates: every other place repeats it whole. Only where a node
branches are the paths, one copy of each, taken back to their sources and compared window by window.

An operator row is removed text: every word covered by a window that also starts earlier (a smaller doc_id, or the
same document and an earlier start).

Defined cases: a null or blank text has no words; documents shorter than a window lose nothing; rows with equal doc_id
and text are one document (they lose the same words); rows with equal doc_id and other texts are put in order by a
checksum of the text; a null doc_id counts as the largest; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pieces, saved, text_bytes, word_hashes
from .spans import BASES, Rolling, anchors, covered

LAST = (1 << 63) - 1
KMER = 6
#: Bytes of text that a task takes at a time, and words whose hashes it remembers: a worker keeps what its largest task took.
PIECE, KNOWN = 1 << 20, 50_000


def sources(docs: DataFrame, *more: str) -> DataFrame:
    """doc (ids in order), t (tells texts of equal ids apart; of null ids, which may be very many, by 64 bits), text."""
    text = F.col("text").cast("string")
    t = F.when(F.col("doc_id").isNull(), F.xxhash64(text)).otherwise(F.hash(text).cast("long"))
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("doc"), F.when(text.isNull(), F.lit(0).cast("long")).otherwise(t).alias("t"), text.alias("text"), *more)


def _words(batch, cache):
    """Hashes of the words of all texts, end to end, and the number of words of each."""
    split = [x.split() for x in text_bytes(batch.column(batch.schema.get_field_index("text")))]
    lengths = np.array([len(x) for x in split], np.int64)
    return word_hashes([w for x in split for w in x], cache, KNOWN), lengths


def occurrences(docs: DataFrame, width: int) -> DataFrame:
    """A row for every path in every document: node and path hashes, and where it starts and how many windows it has."""

    def run(batches):
        cache = {}
        for whole in batches:
            for batch in pieces(whole, "text", PIECE):
                words, lengths = _words(batch, cache)
                document, place, first, n = anchors(Rolling(words).fixed(KMER), lengths, width, KMER)
                runs = Rolling(words, BASES[1])
                node = runs.of(place, place + KMER)
                with np.errstate(over="ignore"):
                    path = runs.of(first, first + n + (width - 1)) + (place - first).astype(np.uint64) * np.uint64(BASES[0])
                start = first - (np.cumsum(lengths) - lengths)[document]
                at = pa.array(document)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(node.view(np.int64)), pa.array(path.view(np.int64)), pa.array((start << 8) | n)], ["doc", "t", "node", "path", "run"])

    return docs.mapInArrow(run, "doc long, t long, node long, path long, run long")


def path_windows(docs: DataFrame, width: int) -> DataFrame:
    """Hashes of the windows of the paths in column ``paths`` (node, path, run) of the documents."""

    def run(batches):
        cache = {}
        for whole in batches:
            for batch in pieces(whole, "text", PIECE):
                words, lengths = _words(batch, cache)
                if not len(words):
                    continue
                runs = Rolling(words, BASES[1])
                column = batch.column(batch.schema.get_field_index("paths"))
                flat, row = column.flatten(), np.repeat(np.arange(len(column)), np.diff(column.offsets.to_numpy()))
                node, path, where = (flat.field(k).to_numpy() for k in range(3))
                n = where & 0xFF
                start = np.repeat((where >> 8) + (np.cumsum(lengths) - lengths)[row], n) + _within(n)
                at = np.repeat(np.arange(len(n)), n)
                doc = pa.array(row[at])
                yield pa.RecordBatch.from_arrays([pa.array(node[at]), pa.array(path[at]), pa.array(_within(n).astype(np.int32)), pa.array(runs.of(start, start + width).view(np.int64)), batch.column(0).take(doc), batch.column(1).take(doc), pa.array((where >> 8)[at] + _within(n))], ["node", "path", "k", "window", "doc", "t", "start"])

    return docs.mapInArrow(run, "node long, path long, k int, window long, doc long, t long, start long")


def _within(n: np.ndarray) -> np.ndarray:
    """0 .. n-1 for each n in turn."""
    return np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)


def repeated_runs(docs: DataFrame, width: int) -> DataFrame:
    """doc, t and ``runs``: (run, mask) of the windows to remove; mask bit k is the window k of the run."""
    # A table of its own, so that the join below deals out both sides anew and can split a node with very many places.
    again = saved(occurrences(docs, width).groupBy("node").agg(F.count("*").alias("n")).filter("n > 1").select("node"))
    found = saved(occurrences(docs, width).join(again, "node", "left_semi"))
    paths = saved(found.groupBy("node", "path").agg(F.min(F.struct("doc", "t", "run")).alias("first"), F.count("*").alias("n")))
    branching = paths.groupBy("node").agg(F.count("*").alias("ways")).filter("ways > 1").select("node")
    apart = paths.join(branching, "node", "left_semi").groupBy(F.col("first.doc").alias("doc"), F.col("first.t").alias("t")).agg(F.collect_list(F.struct("node", "path", "first.run")).alias("paths"))
    windows = saved(path_windows(docs.join(apart, ["doc", "t"]).select("doc", "t", "text", "paths"), width))
    here = F.struct("doc", "t", "start")
    firsts = windows.groupBy("node", "window").agg(F.min(here).alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n")
    late = windows.join(firsts, ["node", "window"]).filter(here != F.col("first")).groupBy("node", "path").agg(F.bit_or(F.expr("shiftleft(1L, k)")).alias("mask"))
    every = F.lit(-1).cast("long")
    # The first place of a path loses the windows that another path has earlier; all its other places lose every window.
    first_places = paths.join(late, ["node", "path"]).select("first.doc", "first.t", "first.run", "mask")
    others = found.join(paths.filter("n > 1").select("node", "path", "first"), ["node", "path"]).filter(F.struct("doc", "t", "run") != F.col("first")).select("doc", "t", "run", every.alias("mask"))
    return first_places.union(others).groupBy("doc", "t").agg(F.collect_list(F.struct("run", "mask")).alias("runs"))


def removed_words(batch, width: int):
    """For each text of a batch with columns text and runs: its words and which of them to remove."""
    runs = batch.column(batch.schema.get_field_index("runs")).to_pylist()
    for text, own in zip(text_bytes(batch.column(batch.schema.get_field_index("text"))), runs, strict=True):
        words = text.split()
        gone = np.zeros(len(words), bool)
        if own:
            run = np.array([x["run"] for x in own], np.int64)
            mask = np.array([x["mask"] for x in own], np.int64)
            n = run & 0xFF
            k = _within(n)
            marked = (np.repeat(mask, n) >> k) & 1 == 1
            start = (np.repeat(run >> 8, n) + k)[marked]
            gone = covered(len(words), start, start + width)
        yield words, gone


def digest(docs: DataFrame, width: int = 20) -> DataFrame:
    """doc_id, n_words, n_removed and the SHA-256 of the words kept, joined by spaces."""

    def run(batches):
        for whole in batches:
            for batch in pieces(whole, "text", PIECE):
                out = [(len(words), int(gone.sum()), hashlib.sha256(b" ".join([w for w, g in zip(words, gone.tolist(), strict=True) if not g] if gone.any() else words)).hexdigest()) for words, gone in removed_words(batch, width)]
                yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index("doc_id")), *(pa.array([x[k] for x in out], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.string())))], ["doc_id", "n_words", "n_removed", "kept_sha256"])

    docs = sources(docs, F.col("doc_id").cast("long").alias("doc_id"))
    return docs.join(repeated_runs(docs.drop("doc_id"), width), ["doc", "t"], "left").mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def without_repeats(docs: DataFrame, width: int = 20) -> DataFrame:
    """``docs`` with its own columns, in ``text`` only the words kept, joined by spaces; texts that lose none stay as they are."""
    names, types = docs.columns, dict(docs.dtypes)

    def run(batches):
        for whole in batches:
            for batch in pieces(whole, "text", PIECE):
                old = batch.column(batch.schema.get_field_index("text")).to_pylist()
                new = [b" ".join([w for w, g in zip(words, gone.tolist(), strict=True) if not g]).decode() if gone.any() else was for was, (words, gone) in zip(old, removed_words(batch, width), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(new, pa.string()) if c == "text" else batch.column(batch.schema.get_field_index(f"_{k}")) for k, c in enumerate(names)], names)

    keyed = sources(docs, *(F.col(f"`{c}`").alias(f"_{k}") for k, c in enumerate(names) if c != "text"))
    marked = keyed.join(repeated_runs(keyed.select("doc", "t", "text"), width), ["doc", "t"], "left")
    return marked.mapInArrow(run, ", ".join(f"`{c}` {'string' if c == 'text' else types[c]}" for c in names))
