"""Scores of documents by cross-entropy difference of a target and a background language model.

Both models are bigram models of one form over one vocabulary, the lower-case words of the corpus. With c and N the
counts of a model and V the number of distinct words, P(w) = (c(w) + 1) / (N + V) and
P(w | v) = (c(v, w) + mu P(w)) / (c(v) + mu); a text starts after a mark that is no word. A document's score is the mean over its
tokens of target loss minus background loss (in nats): the lower, the closer to the target. The target learns from the
target documents, the background from all; where a model has learned a document, its own counts are taken off before it
is scored, so that none is judged by itself.

All counts are exact for every word and pair of the corpus, and grow with it: each block of documents sends the keys and
counts of its distinct words and pairs, each once, to buckets, which add them up and answer with the sums. Nothing but a
few totals reaches the driver, and no table goes to all tasks. Keys are hashes of 48 bits, or a dozen more than the
number of bytes has, so that next to no words or pairs share theirs.

Defined cases: a null or blank text has no tokens and null losses and score; with no target documents the target model
is the uniform one; repeated rows count as often as they occur, and all rows with a target's doc_id are target documents;
a null doc_id is none; very long texts are a block of their own; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import SENT, Block, by_bucket, packed, sent, squeezed, steps, told, unsqueezed
from .common import mixed, saved, word_hashes

SCORED = "doc_id long, n_tokens long, target_loss double, background_loss double, score double"
BLOCK = 4 << 20
#: Steps that rows of ``SENT`` belong to: counts of words and of pairs, and ids of target documents.
WORDS, PAIRS, TARGETS = range(3)
#: Hashes of words that a worker has met; ``word_hashes`` bounds it.
KNOWN: dict[bytes, int] = {}


class Tokens:
    """Tokens of a block: document, key of the word, of the one before (0: the start), and of the pair; a key's place among
    the distinct ones, and how often each document has it."""

    def __init__(self, block: Block, shift: int):
        split = [block.text[i : i + n].decode("utf-8", "replace").lower().encode().split() for i, n in zip(block.starts.tolist(), block.lengths.tolist(), strict=True)]
        self.n = np.array([len(x) for x in split], np.int64)
        self.doc = np.repeat(np.arange(len(split)), self.n)
        h = word_hashes([w for x in split for w in x], KNOWN)
        before = np.concatenate((np.zeros(1, np.uint64), h[:-1])) if len(h) else h
        self.first = np.flatnonzero(np.concatenate(([True], self.doc[1:] != self.doc[:-1]))) if len(h) else np.zeros(0, np.int64)
        before[self.first] = 0
        with np.errstate(over="ignore"):
            pair = mixed(before * np.uint64(0x9E3779B97F4A7C15) + h)
        self.words, self.word = np.unique(mixed(h) >> np.uint64(shift), return_inverse=True)
        self.pairs, self.pair = np.unique(pair >> np.uint64(shift), return_inverse=True)
        # The word before, as a place among the words; -1 at the start.
        self.before = np.concatenate(([-1], self.word[:-1])) if len(h) else self.word
        self.before[self.first] = -1

    def counts(self, place: np.ndarray, size: int, some: np.ndarray) -> np.ndarray:
        """How often the documents in ``some`` have each distinct key."""
        return np.bincount(place[some[self.doc]], minlength=size)

    def own(self, place: np.ndarray, size: int) -> np.ndarray:
        """For each token, how often its own document has its key."""
        _, at, n = np.unique(self.doc * max(size, 1) + place, return_inverse=True, return_counts=True)
        return n[at]


def score(docs: DataFrame, targets: DataFrame, mu: float = 20.0, bytes_a_block: int = BLOCK) -> DataFrame:
    """doc_id, n_tokens, both mean losses and the score of every document; the target model learns from those whose doc_id is in ``targets``."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    # About a million counts a bucket, and blocks that grow with the root of the corpus beyond 8 GB, so that messages stay large.
    buckets = max(24, total // (10 << 20))
    bytes_a_block = int(bytes_a_block * min(16.0, max(1.0, math.sqrt(total / (8 << 30)))))
    bits = min(64, max(48, total.bit_length() + 12))
    shift = 64 - bits
    held = saved(packed(docs.withColumn("doc", F.coalesce("doc_id", F.lit(0).cast("long"))), bytes_a_block))

    def dealt(keys: np.ndarray) -> np.ndarray:
        """Buckets of keys; they do not fall where the keys do not."""
        return ((keys >> np.uint64(max(0, bits - 32))) * np.uint64(buckets) >> np.uint64(min(32, bits))).astype(np.int64)

    def ids(batches):
        for batch in batches:
            for block, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                own = Block({"data": [data]})
                doc = own.doc[own.named > 0]
                yield pa.RecordBatch.from_arrays([pa.array([block] * len(doc), pa.int64()), pa.array(doc)], ["block", "doc_id"])

    def listed(key, rows):
        return sent([(-1, key[0].as_py(), TARGETS, squeezed(rows["doc_id"].to_numpy()))])

    def target_of(block: Block, replies) -> np.ndarray:
        (found,) = told(replies, TARGETS, "i8")
        return np.isin(block.doc, found) & (block.named > 0)

    def ask(key, rows, replies):
        block, me = Block(rows), key[0].as_py()
        target, tokens, out = target_of(block, replies), Tokens(block, shift), []
        for step, keys, place in ((WORDS, tokens.words, tokens.word), (PAIRS, tokens.pairs, tokens.pair)):
            every, good = tokens.counts(place, len(keys), np.ones(len(target), bool)), tokens.counts(place, len(keys), target)
            out += [(b, me, step, squeezed(steps(keys[s]), every[s].astype(np.uint32), good[s].astype(np.uint32))) for b, s in by_bucket(dealt(keys))]
        starts = np.array([[np.count_nonzero(tokens.n)], [np.count_nonzero(tokens.n[target])]], np.int64)
        return sent([*out, (-1, me, WORDS, squeezed(np.zeros(1, np.int64), *starts))])

    def answer(key, rows):
        """The sums of a bucket's keys to each block that has them; and in a row of no block: distinct keys, all counts, those of the target."""
        me, step, whom = key[0].as_py(), key[1].as_py(), rows["block"].to_pylist()
        parts = [unsqueezed(x, "u8", "u4", "u4") if me >= 0 else unsqueezed(x, "i8", "i8", "i8") for x in rows["data"].to_pylist()]
        every, good = (np.concatenate([x[k] for x in parts]).astype(np.float64) for k in (1, 2))
        if me < 0:
            return sent([(-1, -1, step, squeezed(*(np.array([int(x)]) for x in (0, every.sum(), good.sum()))))])
        distinct, at = np.unique(np.concatenate([np.cumsum(x[0], dtype=np.uint64) for x in parts]), return_inverse=True)
        sums = [np.bincount(at, x, len(distinct)).astype(np.int64) for x in (every, good)]
        stops = np.cumsum([len(x[0]) for x in parts])
        out = [(me, block, step, squeezed(sums[0][at[j - len(x[0]) : j]], sums[1][at[j - len(x[0]) : j]])) for block, x, j in zip(whom, parts, stops.tolist(), strict=True)]
        return sent([*out, (me, -1, step, squeezed(*(np.array([int(x)]) for x in (len(distinct), sums[0].sum(), sums[1].sum()))))])

    def totals(batches):
        for batch in batches:
            rows = [(b < 0, *(int(y[0]) for y in unsqueezed(x, "i8", "i8", "i8"))) for b, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in rows], t) for k, t in enumerate((pa.bool_(), pa.int64(), pa.int64(), pa.int64()))], ["starts", "distinct", "every", "good"])

    by_block = held.groupBy("block")
    found = held.mapInArrow(ids, "block long, doc_id long").join(targets.select(F.col("doc_id").cast("long").alias("doc_id")).distinct(), "doc_id").groupBy("block").applyInArrow(listed, SENT)
    found = saved(found)
    asked = by_block.cogroup(found.groupBy("block")).applyInArrow(ask, SENT)
    replies = saved(asked.groupBy("bucket", "step").applyInArrow(answer, SENT))
    told_of = {x["starts"]: x for x in replies.filter(f"block < 0 and step = {WORDS}").select("bucket", "data").mapInArrow(totals, "starts boolean, distinct long, every long, good long").groupBy("starts").agg(*(F.sum(c).alias(c) for c in ("distinct", "every", "good"))).collect()}
    none = {"distinct": 0, "every": 0, "good": 0}
    whole, starts = told_of.get(False, none), told_of.get(True, none)
    size, all_words, all_starts = whole["distinct"], (whole["good"], whole["every"]), (starts["good"], starts["every"])

    def rate(key, rows, replies):
        block = Block(rows)
        target, tokens = target_of(block, replies), Tokens(block, shift)
        word_sums, pair_sums = told(replies, WORDS, "i8", "i8"), told(replies, PAIRS, "i8", "i8")
        own_word, own_pair = tokens.own(tokens.word, len(tokens.words)), tokens.own(tokens.pair, len(tokens.pairs))
        at_start = tokens.before < 0
        own_before = np.concatenate(([0], own_word[:-1])) if len(own_word) else own_word
        means = []
        for k, learned in ((1, target), (0, np.ones(len(target), bool))):  # target, background
            minus = learned[tokens.doc].astype(np.int64)
            words, pairs = word_sums[k], pair_sums[k]
            n = all_words[1 - k] - (minus * tokens.n[tokens.doc])
            prior = (words[tokens.word] - minus * own_word + 1.0) / (n + size)
            context = np.where(at_start, all_starts[1 - k] - minus, words[tokens.before] - minus * own_before)
            pair = pairs[tokens.pair] - minus * own_pair
            loss = -np.log((pair + mu * prior) / (np.maximum(context, pair) + mu))
            means.append(np.bincount(tokens.doc, loss, len(target)) / np.maximum(tokens.n, 1))
        none = tokens.n == 0
        columns = [pa.array(block.doc, pa.int64(), mask=block.named == 0), pa.array(tokens.n), *(pa.array(x, pa.float64(), mask=none) for x in (*means, means[0] - means[1]))]
        return pa.table(columns, names=[x.split()[0] for x in SCORED.split(", ")])

    both = replies.filter("block >= 0").union(found)
    return by_block.cogroup(both.groupBy("block")).applyInArrow(rate, SCORED)
