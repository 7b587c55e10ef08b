"""Periodic runs against a search that tries every start and period."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from kinstats.llm.runs import digest, find_runs, once, planted, runs, without_repetition


def by_force(w, least=12):
    """Every start, length and period: maximal stretches of each period, of which those that are whole at a smaller one go."""
    out = {}
    for q in range(1, len(w) // 2 + 1):
        i = 0
        while i + q < len(w):
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j - i + q >= max(least, 2 * q):
                out.setdefault((i, j - i + q), q)
            i = j
    return sorted((s, n, q) for (s, n), q in out.items())


def made(rng, n):
    kind = rng.randrange(5)
    if kind == 0:
        return [rng.choice("ab") for _ in range(n)]
    if kind == 1:
        return [rng.choice("abc") for _ in range(n)]
    if kind == 2:
        return ["a"] * rng.randrange(n + 1)
    out = []
    while len(out) < n:
        part = [rng.choice("abcdefgh") for _ in range(rng.randrange(1, 9))]
        out += part * rng.randrange(1, 6)
        if rng.random() < 0.3 and len(out) > 10:
            out += out[-rng.randrange(1, len(out)) :] * rng.randrange(1, 3)
    return out[: 3 * n]


@pytest.mark.parametrize("least", [12, 5, 2])
def test_runs_equal_those_found_by_force(least):
    rng = random.Random(least)
    for _ in range(60):
        docs = [made(rng, rng.randrange(0, 90)) for _ in range(rng.randrange(1, 8))]
        words = [x for d in docs for x in d]
        names = {x: k for k, x in enumerate(sorted(set(words)))}
        found = find_runs(np.array([names[x] for x in words], np.int64), np.array([len(d) for d in docs], np.int64), least)
        want = [(k, *x) for k, d in enumerate(docs) for x in by_force(d, least)]
        assert [tuple(x) for x in found.tolist()] == want, docs


def test_fibonacci_and_long_words():
    a, b = [0], [0, 1]
    while len(b) < 400:
        a, b = b, b + a
    assert [tuple(x[1:]) for x in find_runs(np.array(b), np.array([len(b)])).tolist()] == by_force(b)
    # More different symbols than three to a key.
    big = (list(range(0, 1 << 33, (1 << 33) // 40)) * 3)[:100]
    assert [tuple(x[1:]) for x in find_runs(np.array(big, np.int64), np.array([100])).tolist()] == by_force(big)
    long = ([7] + list(range(50))) * 600
    assert find_runs(np.array(long), np.array([len(long)])).tolist() == [[0, 0, len(long), 51]]
    assert find_runs(np.array([3] * 30_000), np.array([30_000])).tolist() == [[0, 0, 30_000, 1]]


ODD = [(1, None), (2, ""), (3, " \n\t"), (4, "a " * 11), (5, "a " * 12), (6, "x y z " * 5 + "q"), (6, "x y z " * 5 + "q"), (None, "u v\x0b" * 9), (7, "é ü " * 14), (8, " ".join(f"w{k % 700}" for k in range(9_000)))]


def rows_of(docs, change=lambda i, w: w):
    out = []
    for i, text in docs:
        w = change(i, (text or "").encode().split())
        out.append((i, w, by_force(w) if len(w) < 5_000 else None))
    return out


def test_frames_with_odd_texts(spark):
    frame = spark.createDataFrame([(*x, 1) for x in ODD], "doc_id long, text string, start int").repartition(3)
    want = [(i, *x) for i, _, found in rows_of(ODD[:-1]) for x in found] + [(8, 0, 9_000, 700)]
    key = lambda x: tuple((v is None, v) for v in x)
    assert sorted(map(tuple, runs(frame).collect()), key=key) == sorted(want, key=key)
    left = {(x.doc_id, x.start): x.text for x in without_repetition(frame).collect()}
    assert left[1, 1] is None and left[3, 1] == " \n\t" and left[5, 1] == "a" and left[6, 1] == "x y z q" and left[4, 1] == "a " * 11 and len(left[8, 1].split()) == 700
    empty = frame.limit(0)
    assert runs(empty).count() == without_repetition(empty).count() == digest(empty).count() == 0


def test_digest_equals_brute_force(spark):
    rng = random.Random(9)
    docs = ODD[:-1] + [(k, " ".join(made(rng, rng.randrange(1, 120)))) for k in range(100, 260)]
    want = []
    for (i, text), (_, w, found) in zip(docs, rows_of(docs, planted), strict=True):
        # The rule of the query, word by word.
        plain = (text or "").encode().split()
        h = zlib.crc32(str(i).encode())
        if i is not None and h % 10 == 0 and plain:
            g, n = h // 10, len(plain)
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            plain = [x if k < a else plain[a + (k - a) % p] for k, x in enumerate(plain)]
        assert w == plain
        best = min(found, key=lambda x: (-x[1], x[0], x[2]), default=None)
        told = "".join(f"{s},{n},{q}\n" for s, n, q in found)
        gone = {k for s, n, q in found for k in range(s + q, s + n)}
        kept = b" ".join(x for k, x in enumerate(w) if k not in gone)
        assert once(w, np.array(found, np.int64).reshape(-1, 3)) == [x for k, x in enumerate(w) if k not in gone]
        want.append((i, len(found), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, hashlib.sha256(told.encode()).hexdigest(), hashlib.sha256(kept).hexdigest()))
    got = list(map(tuple, digest(spark.createDataFrame(docs, "doc_id long, text string").repartition(3)).collect()))
    key = lambda x: tuple((v is None, v) for v in x)
    assert sorted(got, key=key) == sorted(want, key=key) and sum(x[1] > 0 for x in want) > 60
