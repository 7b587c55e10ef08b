"""Removal of byte spans that a smaller document has too, with a run-length index of the contexts that repeat.

Every window of ``width`` bytes chooses an anchor (``spans``); the bytes that consecutive windows with one anchor cover
are its context. Documents lie in blocks, compressed; anchors are dealt to buckets. In linked jobs

0. each block sends a hash of each text, and is told which of its documents equal a smaller one: these are decided;
1. each block sends the keys of its anchors, each once, to the anchors' buckets, which answer which of them other blocks
   have as well, and which very many blocks have;
2. each block sends, for the anchors that repeat, the hashes of the distinct contexts and the smallest document that has
   each; a bucket answers which contexts a smaller document has too (these are decided), and which texts it needs:
   those of anchors with several contexts, once each;
3. those texts go to the bucket, which builds run-length indexes of them (``rindex``), streams the contexts of larger
   documents against those of smaller ones, and answers the windows with matching statistics of ``width`` or more;
4. each block marks its documents.

All occurrences of a window have the same anchor and so meet in one bucket. A context that many documents share is one
row a block, so no key gathers rows in proportion to its copies. An anchor in ``HOT`` or more blocks could have as many
different contexts, so these are cut into their single windows, which are dealt and decided by their own hashes. Keys are
shortened to a few bits more than the corpus needs: two anchors with one key only mean more work, contexts are told apart
by 48 bits more, whole texts by 128.

Defined cases: a null text is empty; texts shorter than a window lose nothing; rows of equal doc_id are one document
for the comparison, since only smaller ids count; a null doc_id counts as the largest; very long texts are a block of
their own and are anchored in parts; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import SENT, Block, by_bucket, packed, sent, squeezed, steps, told, unsqueezed
from .common import mixed
from .rindex import later_windows
from .spans import BASES, Rolling, anchors, covered

LAST = (1 << 63) - 1
KMER = 24
HOT = 64
PIECE = 1 << 19
BLOCK = 4 << 20
PATH = np.uint64((1 << 48) - 1)
#: A context on its way: difference of keys, path in two, doc.
CONTEXT = "u8", "u4", "u2", "i8"
#: Steps that rows of ``SENT`` belong to.
REPEATS, STATE, DECIDED, MASKS, COPIES = range(5)


def packed_bits(*flags: np.ndarray) -> bytes:
    return squeezed(np.sum([x.astype(np.uint8) << k for k, x in enumerate(flags)], 0, np.uint8))


class AnchoredBlock(Block):
    """A block, with those of its documents marked that equal a smaller one."""

    def __init__(self, rows, replies=None):
        super().__init__(rows)
        self.copies = np.zeros(len(self.doc), bool)
        if replies is not None:
            self.copies[told(replies, COPIES, "u4")[0]] = True

    def pieces(self, width: int):
        """(bytes, lengths, starts in the block) of runs of documents that are no copies; long ones are cut, with what windows at the cut need."""
        own, size = [], 0
        for start, length in zip(self.starts[~self.copies].tolist(), self.lengths[~self.copies].tolist(), strict=True):
            for at in range(0, max(1, length - width + 1), PIECE):
                part = (start + at, min(PIECE + width - 1, length - at))
                if own and size + part[1] > PIECE:
                    yield self._piece(own)
                    own, size = [], 0
                own.append(part)
                size += part[1]
        if own:
            yield self._piece(own)

    def _piece(self, own):
        return np.frombuffer(b"".join([self.text[i : i + n] for i, n in own]), np.uint8), np.array([n for _, n in own], np.int64), np.array([i for i, _ in own], np.int64)

    def anchors(self, width: int, shift: int, chosen=None):
        """Key, start in the block and number of windows of every context, and what ``chosen(key)`` is not 0 for also the
        path hash; with ``chosen`` only those, and single windows where it is 2."""
        out = []
        for text, lengths, starts in self.pieces(width):
            symbols = text.astype(np.uint64)
            hashes = Rolling(symbols).fixed(KMER)
            document, place, first, n = anchors(hashes, lengths, width, KMER)
            key = mixed(hashes[place]) >> np.uint64(shift) if len(place) else np.zeros(0, np.uint64)
            real = starts - (np.cumsum(lengths) - lengths)
            if chosen is None:
                out.append((key, first + real[document], n))
                continue
            said = chosen(key)
            runs = Rolling(symbols, BASES[1])
            a, b = np.flatnonzero(said == 1), np.flatnonzero(said == 2)
            with np.errstate(over="ignore"):
                path = runs.of(first[a], first[a] + n[a] + (width - 1)) + (place[a] - first[a]).astype(np.uint64) * np.uint64(BASES[0])
            single = np.repeat(b, n[b])
            start = np.repeat(first[b], n[b]) + np.arange(len(single)) - np.repeat(np.cumsum(n[b]) - n[b], n[b])
            whole = runs.of(start, start + width)
            out.append((np.concatenate((key[a], mixed(whole) >> np.uint64(shift))), np.concatenate((first[a] + real[document[a]], start + real[document[single]])), np.concatenate((n[a], np.ones(len(single), np.int64))), np.concatenate((path, whole)) & PATH))
        kinds = (np.uint64, np.int64, np.int64) + (() if chosen is None else (np.uint64,))
        return [np.concatenate([np.zeros(0, kind), *(x[k] for x in out)]).astype(kind) for k, kind in enumerate(kinds)]

    def documents(self, start: np.ndarray) -> np.ndarray:
        """doc of the places in the block."""
        return self.doc[np.searchsorted(self.starts + self.lengths, start, "right")]


def among(x: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which of ``x`` are in ``known``, which is sorted."""
    if not len(known):
        return np.zeros(len(x), bool)
    return known[np.minimum(np.searchsorted(known, x), len(known) - 1)] == x


def marks(docs: DataFrame, width: int, finish, schema: str, bytes_a_block: int = 0) -> DataFrame:
    """``finish(block, gone)`` for each block of the documents: an Arrow batch, given which bytes to remove.

    Blocks hold ``bytes_a_block``; 0: ``BLOCK``, and more, up to 16 times, where the corpus exceeds 64 GB.
    """
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bytes_a_block = bytes_a_block or int(BLOCK * min(16.0, max(1.0, math.sqrt(total / (64 << 30)))))
    blocks = max(1, -(-total // bytes_a_block))
    buckets = max(24, blocks // 8)
    bits = min(64, max(24, total.bit_length() + 6))
    shift = 64 - bits

    def dealt(keys: np.ndarray) -> np.ndarray:
        """Buckets of keys; they do not fall where the keys do not."""
        return ((keys >> np.uint64(max(0, bits - 32))) * np.uint64(buckets) >> np.uint64(min(32, bits))).astype(np.int64)

    def block_keys(block: AnchoredBlock) -> tuple[np.ndarray, np.ndarray]:
        """Distinct anchor keys of a block in order, and which of them several of its documents have."""
        key, start, _ = block.anchors(width, shift)
        doc = block.documents(start)
        order = np.argsort(key)
        key, doc = key[order], doc[order]
        heads = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, np.int64)
        several = np.minimum.reduceat(doc, heads) != np.maximum.reduceat(doc, heads) if len(heads) else np.zeros(0, bool)
        return key[heads], several

    def hashes(key, rows):
        """Of texts as long as a window: two hashes, doc, and place in the block."""
        from xxhash import xxh3_128_digest

        block, me = AnchoredBlock(rows), key[0].as_py()
        some = np.flatnonzero(block.lengths >= width)
        both = np.frombuffer(b"".join([xxh3_128_digest(block.text[i : i + n]) for i, n in zip(block.starts[some].tolist(), block.lengths[some].tolist(), strict=True)]), np.uint64).reshape(-1, 2)
        bucket = (both[:, 0] % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        both, some = both[order], some[order]
        return sent([(b, me, COPIES, squeezed(both[s, 0], both[s, 1], block.doc[some[s]], some[s].astype(np.uint32))) for b, s in by_bucket(bucket[order])])

    def equal(key, rows):
        """Places in each block of the documents that equal a smaller one."""
        me, whom = key[0].as_py(), rows["block"].to_pylist()
        parts = [unsqueezed(x, "u8", "u8", "i8", "u4") for x in rows["data"].to_pylist()]
        a, b, doc = (np.concatenate([x[k] for x in parts]) for k in range(3))
        order = np.lexsort((doc, b, a))
        new = np.concatenate(([True], (a[order][1:] != a[order][:-1]) | (b[order][1:] != b[order][:-1])))
        late = np.empty(len(doc), bool)
        late[order] = doc[order] > doc[order][new][np.cumsum(new) - 1]
        stops = np.cumsum([len(x[0]) for x in parts])
        found = [(block, x[3][late[j - len(x[0]) : j]]) for block, x, j in zip(whom, parts, stops.tolist(), strict=True)]
        return sent([(me, block, COPIES, squeezed(x)) for block, x in found if len(x)])

    def ask(key, rows, replies):
        keys, several = block_keys(AnchoredBlock(rows, replies))
        me = key[0].as_py()
        return sent([(b, me, REPEATS, squeezed(steps(keys[s]), several[s])) for b, s in by_bucket(dealt(keys))])

    def answer(key, rows):
        me, whom = key[0].as_py(), rows["block"].to_pylist()
        parts = [unsqueezed(x, "u8", "u1") for x in rows["data"].to_pylist()]
        keys = [np.cumsum(x, dtype=np.uint64) for x, _ in parts]
        everything = np.sort(np.concatenate(keys))
        again = everything[1:][everything[1:] == everything[:-1]]
        hot = everything[HOT - 1 :][everything[HOT - 1 :] == everything[: max(0, len(everything) - HOT + 1)]]
        out = []
        for block, k, (_, several) in zip(whom, keys, parts, strict=True):
            some = (several > 0) | among(k, again)
            out.append((me, block, REPEATS, squeezed(steps(k[some]), among(k[some], hot).astype(np.uint8))))
        return sent(out)

    def tell(key, rows, replies):
        """The distinct contexts of anchors that repeat: key, path and smallest document; and, for the block itself, which contexts its places have."""
        block, me = AnchoredBlock(rows, replies), key[0].as_py()
        again, hot = [], []
        for x in replies.filter(pc.equal(replies["step"], REPEATS)).sort_by("bucket")["data"].to_pylist():
            k, h = unsqueezed(x, "u8", "u1")
            again.append(np.cumsum(k, dtype=np.uint64))
            hot.append(h)
        again, hot = np.concatenate([np.zeros(0, np.uint64), *again]), np.concatenate([np.zeros(0, np.uint8), *hot])
        known = lambda x: np.where(among(x, again), 1 + hot[np.minimum(np.searchsorted(again, x), max(0, len(again) - 1))], 0) if len(again) else np.zeros(len(x), np.int64)
        node, start, windows, path = block.anchors(width, shift, known)
        doc = block.documents(start)
        order = np.lexsort((doc, path, node))
        new = np.concatenate(([True], (node[order][1:] != node[order][:-1]) | (path[order][1:] != path[order][:-1]))) if len(node) else np.zeros(0, bool)
        unit = np.empty(len(node), np.int64)
        unit[order] = np.cumsum(new) - 1
        one = order[new]
        node, path, doc = node[one], path[one], doc[one]
        out = [(b, me, DECIDED, squeezed(steps(node[s]), path[s].astype(np.uint32), (path[s] >> np.uint64(32)).astype(np.uint16), doc[s])) for b, s in by_bucket(dealt(node))]
        at = np.argsort(start, kind="stable")
        return sent([*out, (-1, me, STATE, squeezed(steps(start[at]).astype(np.uint32), windows[at].astype(np.uint8), unit[at].astype(np.uint32)))])

    def decide(key, rows):
        """Of each context of a block: whether a smaller document has it too, and whether its text is needed."""
        me, whom = key[0].as_py(), rows["block"].to_pylist()
        parts = [unsqueezed(x, *CONTEXT) for x in rows["data"].to_pylist()]
        node = np.concatenate([np.cumsum(x[0], dtype=np.uint64) for x in parts])
        path = np.concatenate([x[1] | (x[2].astype(np.uint64) << np.uint64(32)) for x in parts])
        doc = np.concatenate([x[3] for x in parts])
        order = np.lexsort((doc, path, node))
        n, p = node[order], path[order]
        new_node = np.concatenate(([True], n[1:] != n[:-1]))
        new = new_node | np.concatenate(([True], p[1:] != p[:-1]))
        kind, group = np.cumsum(new) - 1, np.cumsum(new_node) - 1
        late = np.empty(len(doc), bool)
        late[order] = doc[order] > doc[order][new][kind]
        several = np.empty(len(doc), bool)
        several[order] = (np.bincount(group[new]) > 1)[group]
        stops = np.cumsum([len(x[0]) for x in parts])
        return sent([(me, block, DECIDED, packed_bits(late[j - len(x[0]) : j], (several & ~late)[j - len(x[0]) : j])) for block, x, j in zip(whom, parts, stops.tolist(), strict=True)])

    def state_of(block: AnchoredBlock, replies):
        start, windows, unit = told(replies, STATE, "u4", "u1", "u4")
        (said,) = told(replies, DECIDED, "u1")
        return np.cumsum(start, dtype=np.int64), windows.astype(np.int64), unit.astype(np.int64), (said & 1) > 0, said > 1

    def show(key, rows, replies):
        import zstandard

        block, me = AnchoredBlock(rows, replies), key[0].as_py()
        start, windows, unit, late, needed = state_of(block, replies)
        doc = block.documents(start)
        order = np.lexsort((doc, unit))
        one = order[np.concatenate(([True], unit[order][1:] != unit[order][:-1]))] if len(order) else order
        one = one[needed[unit[one]]]
        # Keys are taken from the bucket's own rows again: contexts come in the order in which they were told.
        sizes = replies.filter(pc.equal(replies["step"], DECIDED)).sort_by("bucket")
        counts = np.cumsum([len(unsqueezed(x, "u1")[0]) for x in sizes["data"].to_pylist()])
        bucket = np.searchsorted(counts, unit[one], "right")
        names = sizes["bucket"].to_pylist()
        out = []
        for b, s in by_bucket(bucket):
            head = squeezed(doc[one[s]], windows[one[s]].astype(np.uint8))
            text = b"".join([block.text[i : i + w + width - 1] for i, w in zip(start[one[s]].tolist(), windows[one[s]].tolist(), strict=True)])
            out.append((names[b], me, MASKS, len(head).to_bytes(8, "little") + head + zstandard.compress(text, 3)))
        return sent(out)

    def compare(key, told_rows, shown):
        """Windows of the contexts shown that a smaller document has in another context of the anchor."""
        import zstandard

        me = key[0].as_py()
        if not shown.num_rows:
            return sent([])
        decided = decide(key, told_rows)
        flags = {b: unsqueezed(x, "u1")[0] > 1 for b, x in zip(decided["block"].to_pylist(), decided["data"].to_pylist(), strict=True)}
        keys = {b: np.cumsum(unsqueezed(x, *CONTEXT)[0], dtype=np.uint64) for b, x in zip(told_rows["block"].to_pylist(), told_rows["data"].to_pylist(), strict=True)}
        whom, node, doc, windows, text = shown["block"].to_pylist(), [], [], [], []
        for block, x in zip(whom, shown["data"].to_pylist(), strict=True):
            size = 8 + int.from_bytes(x[:8], "little")
            d, w = unsqueezed(x[8:size], "i8", "u1")
            node.append(keys[block][flags[block]])
            doc.append(d)
            windows.append(w.astype(np.int64))
            text.append(zstandard.decompress(x[size:]))
        counts = [len(x) for x in doc]
        node, doc, size = np.concatenate(node), np.concatenate(doc), np.concatenate(windows) + width - 1
        text = np.frombuffer(b"".join(text), np.uint8)
        first = np.cumsum(size) - size
        order = np.argsort(node, kind="stable")
        take = np.repeat(first[order], size[order]) + np.arange(len(text)) - np.repeat(np.cumsum(size[order]) - size[order], size[order])
        mask = np.empty(len(doc), np.int64)
        mask[order] = later_windows(text[take], size[order], node[order], doc[order], width)
        stops = np.cumsum(counts)
        return sent([(me, block, MASKS, squeezed(mask[j - n : j].astype(np.uint32))) for block, n, j in zip(whom, counts, stops.tolist(), strict=True)])

    def mark(key, rows, replies):
        block = AnchoredBlock(rows, replies)
        start, windows, unit, late, needed = state_of(block, replies)
        (shown,) = told(replies, MASKS, "u4")
        doc = block.documents(start)
        mask = np.where(late, np.int64(-1), 0)
        mask[needed] = shown
        least = np.full(len(mask), LAST, np.int64)
        np.minimum.at(least, unit, doc)
        bits = np.where(doc > least[unit], np.int64(-1), mask[unit])
        some = bits != 0
        bits, start, windows = bits[some], start[some], windows[some]
        step = np.arange(int(windows.sum())) - np.repeat(np.cumsum(windows) - windows, windows)
        starts = (np.repeat(start, windows) + step)[(np.repeat(bits, windows) >> step) & 1 == 1]
        gone = covered(len(block.text), starts, starts + width) | np.repeat(block.copies, block.lengths)
        return pa.Table.from_batches([finish(block, gone)])

    held = packed(docs, bytes_a_block).groupBy("block")
    copies = held.applyInArrow(hashes, SENT).groupBy("bucket").applyInArrow(equal, SENT)
    asked = held.cogroup(copies.groupBy("block")).applyInArrow(ask, SENT)
    repeats = asked.groupBy("bucket").applyInArrow(answer, SENT)
    told_of = held.cogroup(repeats.union(copies).groupBy("block")).applyInArrow(tell, SENT)
    state, contexts = told_of.filter("bucket < 0"), told_of.filter("bucket >= 0").groupBy("bucket")
    known = state.union(contexts.applyInArrow(decide, SENT)).union(copies)
    shown = held.cogroup(known.groupBy("block")).applyInArrow(show, SENT)
    masks = contexts.cogroup(shown.groupBy("bucket")).applyInArrow(compare, SENT)
    return held.cogroup(known.union(masks).groupBy("block")).applyInArrow(mark, schema)


def sources(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("doc"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def digest(docs: DataFrame, width: int = 50) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and the SHA-256 of the bytes kept."""
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"

    def finish(block: Block, gone: np.ndarray):
        out = []
        for start, n in zip(block.starts.tolist(), block.lengths.tolist(), strict=True):
            own = gone[start : start + n]
            data = block.text[start : start + n]
            spans = int(own[0]) + int((own[1:] & ~own[:-1]).sum()) if n else 0
            kept = np.frombuffer(data, np.uint8)[~own].tobytes() if spans else data
            out.append((n, int(own.sum()), spans, hashlib.sha256(kept).hexdigest()))
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array(block.doc, pa.int64(), mask=block.named == 0), *(pa.array([x[k] for x in out], t) for k, t in enumerate(kinds))], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return marks(sources(docs), width, finish, schema)
