"""Two tokenizers' tokens of the same text, aligned by the bytes that they stand for, and how often ids end together.

Each token points to the token of the other tokenizer that overlaps it and reaches farthest right; one that ends where a
token of the other side ends points to that end's B token, which points to itself. Taking the successor's successor until
nothing changes leads every token to the last one of its component (``labels``): its group, between two places where
tokens of both sides end.

Neither tokenizer joins what lies before a single space between two other characters to what follows, so a text is cut
there, and each different piece is encoded, aligned and put into words once a worker (``limit`` pieces of up to 64
characters are remembered). Pairs of ids are counted exactly over all documents: blocks of documents tell their counts of
each pair, Spark adds them up and joins the sums back to the blocks that asked.

Defined cases: null and empty texts, and texts that either tokenizer does not give back byte for byte (such as those with
U+2581), have no tokens: all counts are 0 and the hash is ''. Texts of any length are encoded whole. A null doc_id is
carried through; repeated rows count as often as they occur; of pairs of a B id that are equally frequent all are its
most frequent ones; an empty table gives an empty result; other columns are ignored. Tokens stand for one byte or more.
"""

from __future__ import annotations

import hashlib
import itertools
import json
import os
from collections import defaultdict
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import squeezed, steps, unsqueezed
from .common import pieces, saved

GROUPS = "doc_id long, group long, a_ids array<int>, b_ids array<int>"
BLOCKS = "block long, documents binary, links binary, pairs binary"
DIGEST = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
#: Pieces of more characters are encoded alone and not remembered.
LONGEST = 64
#: So many pieces are encoded at a time.
TOGETHER = 500
#: Fixed value: the pattern by which byte-level vocabularies cut texts.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
LOW = (1 << 32) - 1


def labels(ends_a: np.ndarray, ends_b: np.ndarray) -> np.ndarray:
    """For the tokens of A, then those of B, given by where they end, the place among B of their component's last token.

    Both sides cover the same bytes.
    """
    n = len(ends_a)
    over_b = np.searchsorted(ends_b, ends_a)
    over_a = np.searchsorted(ends_a, ends_b)
    ends = ends_a[over_a] == ends_b
    after = np.concatenate((over_b + n, np.where(ends, np.arange(len(ends_b)) + n, over_a)))
    while True:
        then = after[after]
        if (then == after).all():
            return after - n
        after = then


def letters() -> dict[str, int]:
    """The byte of each letter of byte-level vocabularies: printable Latin-1 stands for itself, the rest follow from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Piece(NamedTuple):
    """A piece of text: its numbers of tokens, its groups in words, and the pairs of ids that end together, A's id in the high bits."""

    n_a: int
    n_b: int
    told: bytes
    pairs: list[int]


def told_pieces(a: np.ndarray, b: np.ndarray, ends_a: np.ndarray, ends_b: np.ndarray, stop_a: np.ndarray, stop_b: np.ndarray) -> list[Piece]:
    """Pieces that lie end to end, of tokens ``a`` and ``b`` up to ``stop_a`` and ``stop_b``."""
    label = labels(ends_a, ends_b)
    group = np.cumsum(label[: len(a)][1:] != label[: len(a)][:-1])
    group_a = np.concatenate(([0], group))
    last_a = np.append(np.flatnonzero(label[: len(a)][1:] != label[: len(a)][:-1]), len(a) - 1)
    last_b = label[last_a]
    many = np.diff(last_b, prepend=-1)
    group_b = np.repeat(np.arange(len(many)), many)
    pairs = ((a[last_a] << 32) | b[last_b]).tolist()
    stop_g = group_a[stop_a - 1] + 1
    # All ids in the order of the groups, those of A first in each, with the mark that follows.
    at_a = np.arange(len(a)) + (last_b + 1 - many)[group_a]
    at_b = np.arange(len(b)) + (last_a + 1)[group_b]
    ids, mark = np.empty(len(a) + len(b), np.int64), np.full(len(a) + len(b), ord(","))
    ids[at_a], ids[at_b] = a, b
    mark[at_a[last_a]], mark[at_b[last_b]] = ord("|"), ord(";")
    told = [b"%d%c" % x for x in zip(ids.tolist(), mark.tolist(), strict=True)]
    out, ia, ib, ig = [], 0, 0, 0
    for ja, jb, jg in zip(stop_a.tolist(), stop_b.tolist(), stop_g.tolist(), strict=True):
        out.append(Piece(ja - ia, jb - ib, b"".join(told[ia + ib : ja + jb])[:-1], pairs[ig:jg]))
        ia, ib, ig = ja, jb, jg
    return out


def by_ranks(path: str, byte: dict[str, int]):
    """The same vocabulary for a faster library, where a token's id is its rank among merges and white space is cut off by the usual rule; else None."""
    import tiktoken

    with open(path, encoding="utf-8") as file:
        plan = json.load(file)
    model, first = plan["model"], plan["pre_tokenizer"] or {}
    wanted = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}
    merges = [x if isinstance(x, str) else " ".join(x) for x in model.get("merges", [])]
    if plan["normalizer"] or any(first.get(k) != v for k, v in wanted.items()) or [model["vocab"].get(x.replace(" ", "")) for x in merges] != list(range(256, 256 + len(merges))):
        return None
    special = {x["content"] for x in plan["added_tokens"]}
    ranks = {bytes(byte[c] for c in token): i for token, i in model["vocab"].items() if token not in special}
    return tiktoken.Encoding("own", pat_str=WORDS, mergeable_ranks=ranks, special_tokens={})


class Aligner:
    def __init__(self, path_a: str, path_b: str, limit: int = 250_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.one = Tokenizer.from_file(path_a)
        self.one.encode_special_tokens = True
        byte = letters()
        vocabulary = self.one.get_vocab(with_added_tokens=True)
        self.bytes_a = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            self.bytes_a[i] = bytes(byte[c] for c in token) if all(c in byte for c in token) else token.encode()
        self.fast = by_ranks(path_a, byte)
        self.two = sentencepiece.SentencePieceProcessor(model_file=path_b)
        names = [self.two.id_to_piece(i) for i in range(self.two.get_piece_size())]
        self.bytes_b = [bytes([int(x[3:5], 16)]) if self.two.is_byte(i) else x.replace("\u2581", " ").encode() for i, x in enumerate(names)]
        self.size_a, self.size_b = (np.array([len(x) for x in y], np.int64) for y in (self.bytes_a, self.bytes_b))
        self.known: dict[str, Piece | None] = {}
        self.limit = limit

    def learn(self, texts: list[str]) -> list[Piece | None]:
        """The pieces " " + text; None for those whose bytes are not given back.

        Short pieces that begin and end without white space are encoded many at a time, end to end, as they are in texts.
        """
        out: list[Piece | None] = [None] * len(texts)
        joined = [k for k, t in enumerate(texts) if len(t) <= LONGEST and t and plain(t[0]) and plain(t[-1])]
        rest = sorted(set(range(len(texts))) - set(joined))
        for at in range(0, len(joined), TOGETHER):
            some = joined[at : at + TOGETHER]
            raw = [(" " + texts[k]).encode() for k in some]
            text = " ".join([texts[k] for k in some])
            a = self.fast.encode_ordinary(" " + text) if self.fast else self.one.encode(" " + text, add_special_tokens=False).ids
            b = self.two.encode(text, num_threads=1)
            whole = b"".join(raw)
            if b"".join(map(self.bytes_a.__getitem__, a)) != whole or b"".join(map(self.bytes_b.__getitem__, b)) != whole:
                rest += some
                continue
            a, b = np.array(a, np.int64), np.array(b, np.int64)
            ends_a, ends_b = np.cumsum(self.size_a[a]), np.cumsum(self.size_b[b])
            stops = np.cumsum([len(x) for x in raw])
            stop_a, stop_b = np.searchsorted(ends_a, stops), np.searchsorted(ends_b, stops)
            if (ends_a[stop_a] != stops).any() or (ends_b[stop_b] != stops).any():
                rest += some
                continue
            for k, x in zip(some, told_pieces(a, b, ends_a, ends_b, stop_a + 1, stop_b + 1), strict=True):
                out[k] = x
        if not rest:
            return out
        ids_a = [x.ids for x in self.one.encode_batch([" " + texts[k] for k in rest], add_special_tokens=False)]
        ids_b = self.two.encode([texts[k] for k in rest], num_threads=1)
        good = self.given_back([texts[k] for k in rest], ids_a, ids_b)
        if good:
            a, b = (np.fromiter(itertools.chain.from_iterable(x[k] for k in good), np.int64) for x in (ids_a, ids_b))
            stop_a, stop_b = (np.cumsum([len(x[k]) for k in good]) for x in (ids_a, ids_b))
            for k, x in zip(good, told_pieces(a, b, np.cumsum(self.size_a[a]), np.cumsum(self.size_b[b]), stop_a, stop_b), strict=True):
                out[rest[k]] = x
        return out

    def given_back(self, texts: list[str], ids_a: list[list[int]], ids_b: list[list[int]]) -> list[int]:
        """Places of the texts whose bytes the tokens of both sides are."""
        raw = [(" " + t).encode() for t in texts]
        good = np.ones(len(texts), bool)
        for ids, known in ((ids_a, self.bytes_a), (ids_b, self.bytes_b)):
            told = [b"".join(map(known.__getitem__, x)) for x in ids]
            if told != raw:
                good &= [x == y for x, y in zip(told, raw, strict=True)]
        return np.flatnonzero(good).tolist()

    def of(self, texts: list[str]) -> list[Piece | None]:
        """``learn`` with a memory."""
        if len(self.known) > self.limit:
            self.known.clear()
        found = [self.known.get(t, 0) for t in texts]
        new = [k for k, x in enumerate(found) if x == 0]
        for at in range(0, len(new), 10_000):
            some = new[at : at + 10_000]
            for k, x in zip(some, self.learn([texts[k] for k in some]), strict=True):
                found[k] = x
                if len(texts[k]) <= LONGEST:
                    self.known[texts[k]] = x
        return found


def plain(c: str) -> bool:
    """Whether ``c`` is certainly no white space to either tokenizer."""
    return not c.isspace() and c not in "\u2581\u180e\u200b\u2060\ufeff"


class Sure(dict):
    """Whether parts of a text begin and end with what is certainly no white space."""

    def __missing__(self, part: str) -> bool:
        known = self[part] = bool(part) and plain(part[0]) and plain(part[-1])
        return known


def cut(text: str, sure: Sure) -> list[str]:
    """``text`` as pieces, between which lies a single space that has no other white space beside it."""
    parts = text.split(" ")
    if all(map(sure.__getitem__, parts)):
        return parts
    out, held = [], parts[0]
    for p in parts[1:]:
        if held and plain(held[-1]) and p and plain(p[0]):
            out.append(held)
            held = p
        else:
            held = f"{held} {p}"
    return [*out, held]


def encoded(part: pa.RecordBatch, both: Aligner):
    """(doc_id, tokens of A, tokens of B, groups in words, pairs that end together) of each document of a batch (doc_id, text)."""
    number = defaultdict(itertools.count().__next__)
    sure = Sure()
    cuts = [list(map(number.__getitem__, cut(t, sure))) if t else [] for t in part.column(1).to_pylist()]
    found = both.of(list(number))
    bad = np.array([x is None for x in found], bool)
    found = [x or Piece(0, 0, b"", []) for x in found]
    n_a, n_b, n = (np.array(x, np.int64) for x in ([x.n_a for x in found], [x.n_b for x in found], [len(x.pairs) for x in found]))
    pairs = np.fromiter(itertools.chain.from_iterable(x.pairs for x in found), np.int64)
    starts = np.cumsum(n) - n
    told = [x.told for x in found]
    for i, own in zip(part.column(0).to_pylist(), cuts, strict=True):
        own = np.array(own, np.int64)
        if not len(own) or bad[own].any():
            yield i, 0, 0, b"", pairs[:0]
            continue
        each = n[own]
        at = np.repeat(starts[own] - np.cumsum(each) + each, each) + np.arange(each.sum())
        yield i, int(n_a[own].sum()), int(n_b[own].sum()), b";".join(map(told.__getitem__, own.tolist())), pairs[at]


_ALIGNERS: dict[tuple[str, str], Aligner] = {}


def aligner(path_a: str, path_b: str) -> Aligner:
    if (path_a, path_b) not in _ALIGNERS:
        _ALIGNERS[path_a, path_b] = Aligner(path_a, path_b)
    return _ALIGNERS[path_a, path_b]


def narrow(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def groups(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """A row for each group of each document, numbered from 0: its ids of both tokenizers in order."""

    def run(batches):
        both = aligner(path_a, path_b)
        for batch in batches:
            for part in pieces(batch, "text", 256 << 10):
                numbers = lambda x: [int(k) for k in x.split(b",")]
                rows = [(i, g, *map(numbers, x.split(b"|"))) for i, _, _, told, _ in encoded(part, both) if told for g, x in enumerate(told.split(b";"))]
                kinds = (pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in rows], t) for k, t in enumerate(kinds)], ["doc_id", "group", "a_ids", "b_ids"])

    return narrow(docs).mapInArrow(run, GROUPS)


def blocks(docs: DataFrame, path_a: str, path_b: str, bytes_a_block: int = 16 << 20) -> DataFrame:
    """Blocks of documents: what is known of each already, its links as (document, pair, times), and the block's pairs with their counts."""

    def run(batches):
        both, kept, size, k = aligner(path_a, path_b), [], 0, 0
        first = TaskContext.get().partitionId() << 32

        def block():
            ids = np.array([x[0] or 0 for x in kept], np.int64)
            named = np.array([x[0] is not None for x in kept], np.uint8)
            numbers = np.array([x[1] for x in kept], np.int64).reshape(-1, 3)
            hashes = b"".join([x[2] for x in kept])
            links = np.concatenate([x[3] for x in kept])
            pairs, own, n = np.unique(links, return_inverse=True, return_counts=True)
            doc = np.repeat(np.arange(len(kept)), [len(x[3]) for x in kept])
            place, times = np.unique(doc * max(1, len(pairs)) + own, return_counts=True)
            head = squeezed(ids, named, *(np.ascontiguousarray(numbers[:, j]) for j in range(3)))
            rows = [head + hashes, squeezed(steps(place), times), squeezed(steps(pairs), n)]
            return pa.RecordBatch.from_arrays([pa.array([first + k]), *(pa.array([len(head).to_bytes(8, "little") + x if j == 0 else x], pa.binary()) for j, x in enumerate(rows))], ["block", "documents", "links", "pairs"])

        for batch in batches:
            for part in pieces(batch, "text"):
                for i, n_a, n_b, told, links in encoded(part, both):
                    kept.append((i, (n_a, n_b, len(links)), hashlib.sha256(told).digest(), links))
                size += part.nbytes
                if size >= bytes_a_block:
                    yield block()
                    kept, size, k = [], 0, k + 1
        if kept:
            yield block()

    return narrow(docs).mapInArrow(run, BLOCKS)


def asked(held: DataFrame) -> DataFrame:
    """(block, pair, n): each block's count of each of its pairs."""

    def run(batches):
        for batch in batches:
            for block, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                pairs, n = unsqueezed(data, "i8", "i8")
                pairs = np.cumsum(pairs)
                for at in range(0, len(pairs), 1 << 17):
                    some = slice(at, at + (1 << 17))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(pairs[some]), block)), pa.array(pairs[some]), pa.array(n[some])], ["block", "pair", "n"])

    return held.select("block", "pairs").mapInArrow(run, "block long, pair long, n long")


def counted(rows: DataFrame) -> DataFrame:
    """pair, its count over all documents, and whether no pair of its B id has a higher one, from (pair, n)."""
    totals = saved(rows.groupBy("pair").agg(F.sum("n").alias("count"))).withColumn("b", F.col("pair").bitwiseAND(F.lit(LOW)))
    return totals.join(totals.groupBy("b").agg(F.max("count").alias("most")), "b").select("pair", "count", (F.col("count") == F.col("most")).alias("best"))


def pair_counts(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """a_id, b_id, count and best of all pairs of ids that end together somewhere."""
    found = counted(asked(saved(blocks(docs, path_a, path_b))))
    return found.select(F.shiftright("pair", 32).alias("a_id"), F.col("pair").bitwiseAND(F.lit(LOW)).alias("b_id"), "count", "best")


def digest(docs: DataFrame, path_a: str, path_b: str, bytes_a_block: int = 16 << 20) -> DataFrame:
    """For each document its numbers of tokens, groups and links, how its links stand among all, and a hash of its groups."""
    held = saved(blocks(docs, path_a, path_b, bytes_a_block))
    rows = asked(held)
    # One number a row: twice the count, and one more for the best.
    answers = rows.select("block", "pair").join(counted(rows).select("pair", (2 * F.col("count") + F.col("best").cast("long")).alias("told")), "pair").select("block", "pair", "told")

    def run(key, told, own):
        data, links = own["documents"][0].as_py(), own["links"][0].as_py()
        stop = 8 + int.from_bytes(data[:8], "little")
        ids, named, *numbers = unsqueezed(data[8:stop], "i8", "u1", "i8", "i8", "i8")
        place, times = unsqueezed(links, "i8", "i8")
        told = told.sort_by("pair")["told"].to_numpy()
        doc, pair = np.divmod(np.cumsum(place), max(1, len(told)))
        n_links, best, total = (np.zeros(len(ids), np.int64) for _ in range(3))
        np.add.at(n_links, doc, times)
        np.add.at(best, doc, times * (told[pair] & 1))
        np.add.at(total, doc, times * (told[pair] >> 1))
        hashes = [data[at : at + 32].hex() if n else "" for at, n in zip(range(stop, len(data), 32), numbers[0], strict=True)]
        return pa.table([pa.array(ids, mask=named == 0), *map(pa.array, (*numbers, n_links, best, total)), pa.array(hashes, pa.string())], names=[x.split()[0] for x in DIGEST.split(", ")])

    return answers.groupBy("block").cogroup(held.select("block", "documents", "links").groupBy("block")).applyInArrow(run, DIGEST)
