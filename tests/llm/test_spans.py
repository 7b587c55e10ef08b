"""Removal of repeated spans of bytes and of words, against brute force."""

import hashlib
import random

import numpy as np
import pytest

from kinstats.llm import debruijn, rindex, runindex

LAST = 1 << 63


def corpus(unit):
    rng = random.Random(1)
    base = [[rng.choice(["ab", "c", "dé", "e"]) + str(rng.randrange(9)) for _ in range(120)] for _ in range(5)]
    docs = []
    for i in range(120):
        words = []
        for _ in range(rng.randint(0, 4)):
            x, a = rng.choice(base), rng.randint(0, 90)
            words += x[a : a + rng.randint(5, 60)] + [f"u{rng.randrange(10**6)}" for _ in range(rng.randint(0, 9))]
        docs.append((i, " ".join(words)))
    docs += [(None, docs[7][1]), (400, None), (401, "é " * 100), (402, "é " * 100), (403, ""), (404, " \t\n"), (405, "x " * 3000)]
    return docs + [docs[9]]


def bytes_by_force(docs, width=50):
    least = {}
    texts = [(LAST if i is None else i, (t or "").encode()) for i, t in docs]
    for i, b in texts:
        for k in range(len(b) - width + 1):
            least[b[k : k + width]] = min(i, least.get(b[k : k + width], LAST))
    out = []
    for (i, b), (name, _) in zip(texts, docs):
        gone = bytearray(len(b))
        for k in range(len(b) - width + 1):
            if least[b[k : k + width]] < i:
                gone[k : k + width] = b"\1" * width
        spans = sum(1 for k in range(len(b)) if gone[k] and not (k and gone[k - 1]))
        out.append((name, len(b), sum(gone), spans, hashlib.sha256(bytes(c for c, g in zip(b, gone) if not g)).hexdigest()))
    return sorted(out, key=str)


def words_by_force(docs, width=20):
    first = {}
    texts = [(LAST if i is None else i, (t or "").encode().split()) for i, t in docs]
    for i, w in texts:
        for k in range(len(w) - width + 1):
            g = tuple(w[k : k + width])
            first[g] = min((i, k), first.get(g, (LAST, LAST)))
    out = []
    for (i, w), (name, _) in zip(texts, docs):
        gone = [False] * len(w)
        for k in range(len(w) - width + 1):
            if first[tuple(w[k : k + width])] < (i, k):
                gone[k : k + width] = [True] * width
        out.append((name, len(w), sum(gone), hashlib.sha256(b" ".join(x for x, g in zip(w, gone) if not g)).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("block,hot,piece", [(1 << 22, 64, 1 << 19), (5000, 64, 700), (1500, 2, 1 << 19)])
def test_bytes(spark, monkeypatch, block, hot, piece):
    docs = corpus("bytes")
    marks = runindex.marks
    monkeypatch.setattr(runindex, "marks", lambda *x: marks(*x, bytes_a_block=block))
    monkeypatch.setattr(runindex, "HOT", hot)
    monkeypatch.setattr(runindex, "PIECE", piece)
    frame = spark.createDataFrame([(*x, 1) for x in docs], "doc_id long, text string, block int")
    assert sorted(map(tuple, runindex.digest(frame).collect()), key=str) == bytes_by_force(docs)


def test_words(spark):
    docs = corpus("words")
    frame = spark.createDataFrame([(*x, "t") for x in docs], "doc_id long, text string, t string")
    assert sorted(map(tuple, debruijn.digest(frame).collect()), key=str) == words_by_force(docs)
    kept = debruijn.without_repeats(frame)
    assert kept.columns == frame.columns and kept.dtypes == frame.dtypes
    got = sorted(((x.doc_id, hashlib.sha256(" ".join((x.text or "").split()).encode()).hexdigest()) for x in kept.collect()), key=str)
    assert got == sorted(((x[0], x[3]) for x in words_by_force(docs)), key=str)


def test_empty_tables(spark):
    frame = spark.createDataFrame([], "doc_id long, text string")
    assert runindex.digest(frame).count() == debruijn.digest(frame).count() == debruijn.without_repeats(frame).count() == 0


def strings_of(rng, base, n):
    return ["".join(base[a : a + rng.randint(1, 20)] for a in (rng.randrange(len(base)) for _ in range(rng.randint(1, 3)))) or "a" for _ in range(n)]


def flat(strings):
    return np.frombuffer("".join(strings).encode(), np.uint8), np.array([len(x) for x in strings])


def test_matching_statistics_of_runs_equal_naive_ones():
    rng = random.Random(4)
    for _ in range(200):
        base = "".join(rng.choice(rng.choice(["ab", "abc", "abcdefgh"])) for _ in range(40)) + "a"
        strings, patterns = strings_of(rng, base, rng.randint(1, 6)), strings_of(rng, base, 4)
        tags = np.unique(sorted(rng.randint(0, 2) for _ in strings), return_inverse=True)[1]
        wanted = np.array([rng.randint(0, int(tags[-1])) for _ in patterns])
        index = rindex.RunIndex(*flat(strings), tags)
        seen = set()
        for which, place, match, at in index.statistics(*flat(patterns), wanted):
            for i, j, k, x in zip(which.tolist(), place.tolist(), match.tolist(), at.tolist()):
                assert k == max(k for k in range(len(patterns[i]) - j + 1) if any(t == wanted[i] and patterns[i][j : j + k] in y for t, y in zip(tags, strings)))
                assert bytes(index.text[x : x + k] - 1).decode() == patterns[i][j : j + k]
                seen.add((i, j))
        assert len(seen) == sum(map(len, patterns))


@pytest.mark.parametrize("symbols", [300, 1 << 20])
def test_index_finds_later_windows(symbols):
    rng = random.Random(4)
    bases = ["".join(rng.choice("ab") for _ in range(300)) for _ in range(2)]
    strings = [x[a : a + rng.randint(50, 84)] for x, a in ((rng.choice(bases), rng.randint(0, 200)) for _ in range(80))]
    groups, docs = np.array(sorted(rng.randrange(3) for _ in strings)), np.array([rng.randrange(40) for _ in strings], np.int64)
    masks = rindex.later_windows(*flat(strings), groups, docs, 50, symbols)
    for i, x in enumerate(strings):
        want = sum(1 << k for k in range(len(x) - 49) if any(g == groups[i] and d < docs[i] and x[k : k + 50] in y for y, g, d in zip(strings, groups, docs)))
        assert int(masks[i]) == want
