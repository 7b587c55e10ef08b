"""Best-fit packing of tokenised documents into sequences of fixed length, by sums of squares.

``cut_documents`` tokenises whole texts and cuts what is longer than a sequence. ``pack`` takes the longest pieces first
and puts each into the open sequence for which the sum over gaps g of N(g)^2 becomes smallest, N(g) being the number of
open sequences with g free places; a new one is opened only where none has room. (Left free to open one at any time, the
rule spreads long pieces over sequences that nothing is left to fill.)

Defined cases: a null or empty text is the end token alone (one piece of length 1); a very long text is cut into full
pieces and a rest; pieces of equal length are taken by doc_id and piece, and of places that are equally good the fullest
is taken; repeated rows are packed as often as they occur; a null doc_id is carried through; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import codecs
import functools
import json
import os
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, pieces, saved, text_bytes

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PACKED = PIECES + ", sequence_id long, offset long"


class WordIds:
    """Token ids, as little-endian bytes, of words between ASCII white space.

    A tokenizer that drops white space splits there, so the ids of a text are those of its words in a row. Words of
    Latin-1 letters, with or without closing marks, go many at a time through the same vocabulary and merges without
    the normaliser; all others through the tokenizer itself. ``limit`` bounds the number of words that are remembered.
    """

    LETTERS = re.compile(r"^([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]*)(.*)$", re.M)
    MARKS = re.compile(r"[.,;:!?|*$%&#]+")

    def __init__(self, path: str, limit: int = 400_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            plan = json.load(file)
        suffix = plan["model"].get("end_of_word_suffix") or ""
        self.plain = None
        if suffix:
            vocabulary = plan["model"]["vocab"]
            self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
            self.ends[[i for token, i in vocabulary.items() if token.endswith(suffix)]] = True
            plan |= {"normalizer": None, "pre_tokenizer": {"type": "WhitespaceSplit"}, "added_tokens": [], "post_processor": None}
            self.plain = Tokenizer.from_str(json.dumps(plan))
            # In such vocabularies printable bytes stand for themselves; the others are the letters from 256 on.
            hidden = [x for x in range(256) if not (33 <= x <= 126 or 161 <= x <= 172 or x >= 174)]
            letters = {x: 256 + k for k, x in enumerate(hidden) if x != 32}
            self.letters = "".join(chr(letters.get(x, x)) for x in range(256))
        self.limit, self.ids = limit, {}

    def whole_words(self, words: list[bytes]) -> None:
        for w, e in zip(words, self.whole.encode_batch_fast([w.decode("utf-8", "replace") for w in words], add_special_tokens=False), strict=True):
            self.ids[w] = np.array(e.ids, "<u4").tobytes()

    def plain_words(self, words: list[bytes]) -> None:
        for at in range(0, len(words), 20_000):
            some = [words[k : k + 500] for k in range(at, min(at + 20_000, len(words)), 500)]
            joined = [codecs.charmap_decode(b" ".join(x).decode().lower().encode(), "strict", self.letters)[0] for x in some]
            for part, e in zip(some, self.plain.encode_batch_fast(joined, add_special_tokens=False), strict=True):
                got = np.array(e.ids, "<u4")
                stops = (4 * (np.flatnonzero(self.ends[got]) + 1)).tolist()
                if len(stops) != len(part):
                    self.whole_words(part)
                    continue
                raw = got.tobytes()
                self.ids.update(zip(part, (raw[i:j] for i, j in zip([0, *stops], stops, strict=False)), strict=True))

    def learn(self, new: list[bytes]) -> None:
        if self.plain is None:
            return self.whole_words(new)
        known, stems, rest, both, closing = self.ids, {w for w in new if w.isalpha()}, [], [], {}
        new = [w for w in new if w not in stems]
        found = self.LETTERS.findall(b"\n".join(new).decode("utf-8", "replace")) if new else []
        for w, (stem, marks) in zip(new, found, strict=True):
            if not marks:
                stems.add(w)
            elif stem and (closing[marks] if marks in closing else closing.setdefault(marks, self.MARKS.fullmatch(marks) is not None)):
                both.append((w, w[: -len(marks)], marks))
            else:
                rest.append(w)
        stems.update([stem for _, stem, _ in both if stem not in known])
        self.whole_words(rest)
        self.whole_words([m for m in (x.encode() for x, good in closing.items() if good) if m not in known])
        self.plain_words(list(stems))
        ending = {x: known[x.encode()] for x, good in closing.items() if good}
        for w, stem, marks in both:
            known[w] = known[stem] + ending[marks]

    def of(self, texts: list[bytes]) -> list[bytes]:
        """Ids of each text."""
        split = [x.split() for x in texts]
        if len(self.ids) > self.limit:
            self.ids.clear()
        if new := set().union(*split).difference(self.ids):
            self.learn(list(new))
        return [b"".join(map(self.ids.__getitem__, words)) for words in split]


@functools.lru_cache(maxsize=1)
def word_ids(path: str, limit: int) -> WordIds:
    """One for each worker process, whose tasks follow each other: what one has learnt helps the next."""
    return WordIds(path, limit)


def cut_documents(docs: DataFrame, tokenizer: str, length: int = 2048, end: int = 0, known: int = 400_000) -> DataFrame:
    """A row for each piece of each document: where it starts among its document's ids, its length, and the CRC-32 of its ids."""

    def run(batches):
        ids = word_ids(tokenizer, known)
        stop = np.array([end], "<u4").tobytes()
        for batch in (part for whole in batches for part in pieces(whole, "text", 1 << 20)):
            out = [[], [], [], [], []]
            for doc_id, raw in zip(batch.column(0).to_pylist(), ids.of(text_bytes(batch.column(1))), strict=True):
                raw += stop
                for k, at in enumerate(range(0, len(raw), 4 * length)):
                    part = raw[at : at + 4 * length]
                    for column, value in zip(out, (doc_id, k, k * length, len(part) // 4, zlib.crc32(part)), strict=True):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, PIECES)


def sum_of_squares(lengths, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """For each length in turn, the number of its bin and its place there.

    An item goes into the open bin for which the sum of the squared counts of open bins per gap is least afterwards, of
    equal ones into the fullest; into a new bin where it fits into none.
    """
    open_bins: list[list[int]] = [[] for _ in range(capacity + 1)]
    n = np.zeros(capacity + 1, np.int64)
    bins, places, made = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64), 0
    for i, size in enumerate(lengths):
        gaps = np.flatnonzero(n[size:capacity]) + size
        if len(gaps):
            change = 2 * (n[gaps - size] - n[gaps]) + 2
            if gaps[0] == size:
                change[0] = 1 - 2 * n[size]
            gap = int(gaps[change.argmin()])
            b = open_bins[gap].pop()
            n[gap] -= 1
        else:
            gap, b, made = capacity, made, made + 1
        bins[i], places[i] = b, capacity - gap
        if gap > size:
            open_bins[gap - size].append(b)
            n[gap - size] += 1
    return bins, places


def packed_by_groups(cut_up: DataFrame, length: int, group_rows: int, level: int) -> tuple[DataFrame, int]:
    """Pieces with their places, each group of about ``group_rows`` packed by itself, and whether their sequence is full."""
    groups = max(1, -(-cut_up.count() // group_rows))

    def one(key, rows):
        rows = rows.drop_columns(["group"]).sort_by([("length", "descending"), ("doc_id", "ascending"), ("piece", "ascending"), ("ids_crc32", "ascending")])
        sizes = rows["length"].to_numpy()
        bins, places = sum_of_squares(sizes.tolist(), length)
        full = np.bincount(bins, sizes) == length
        return rows.append_column("sequence_id", pa.array((level << 56 | key[0].as_py() << 32) + bins)).append_column("offset", pa.array(places)).append_column("full", pa.array(full[bins]))

    dealt = cut_up.withColumn("group", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(groups)))
    return dealt.groupBy("group").applyInArrow(one, f"{PACKED}, full boolean"), groups


def pack(cut_up: DataFrame, length: int = 2048, group_rows: int = 100_000) -> DataFrame:
    """Sequence and place of every piece.

    Pieces are dealt by hash to groups, each small enough for one task. What lies in sequences that a group could not
    fill is packed anew, until one group holds all of it or it becomes no less.
    """
    rest, left, done, level = cut(cut_up), None, [], 0
    while True:
        packed, groups = packed_by_groups(rest, length, group_rows, level)
        if groups == 1:
            done.append(packed)
            break
        packed = saved(packed)
        loose = packed.filter("not full")
        n = loose.count()
        if left is not None and n >= left:
            done.append(packed)
            break
        done.append(packed.filter("full"))
        rest, left, level = loose.drop("sequence_id", "offset", "full"), n, level + 1
    out = done[0]
    for x in done[1:]:
        out = out.union(x)
    return out.drop("full")


def best_fit(docs: DataFrame, tokenizer: str, length: int = 2048, end: int = 0, known: int = 400_000) -> DataFrame:
    """``known``: how many words a worker remembers; it holds them in the stages that follow, too."""
    return pack(cut_documents(docs, tokenizer, length, end, known), length)
