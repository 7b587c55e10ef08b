"""Two tokenizers' tokens held against an alignment of whole texts, token by token."""

import collections
import hashlib
import random

import numpy as np
import public_tokenizers

from kinstats.llm.align import Aligner, Sure, cut, digest, groups, labels, letters, pair_counts

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def by_force(texts):
    """Groups [(a ids, b ids)] of each whole text; None where bytes differ."""
    import sentencepiece
    from tokenizers import Tokenizer

    one, two = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    one.encode_special_tokens = True
    byte = letters()
    out = []
    for t in texts:
        if not t:
            out.append(None)
            continue
        a, b = one.encode(" " + t, add_special_tokens=False).ids, two.encode(t)
        told_a = [bytes(byte[c] for c in one.id_to_token(i)) for i in a]
        told_b = [bytes([int(two.id_to_piece(i)[3:5], 16)]) if two.is_byte(i) else two.id_to_piece(i).replace("▁", " ").encode() for i in b]
        raw = (" " + t).encode()
        if b"".join(told_a) != raw or b"".join(told_b) != raw:
            out.append(None)
            continue
        found, i, j, at_a, at_b = [([], [])], 0, 0, 0, 0
        while i < len(a) or j < len(b):
            if at_a == at_b and (found[-1][0] or found[-1][1]):
                found.append(([], []))
            if at_a <= at_b and i < len(a):
                found[-1][0].append(a[i])
                at_a += len(told_a[i])
                i += 1
            else:
                found[-1][1].append(b[j])
                at_b += len(told_b[j])
                j += 1
        out.append(found)
    return out


def made(rng):
    words = ["the", "Zürich", "naïve", "1234567", "don't", "it's", "ﬁne", "x" * 70, "日本語", "\U0001f600\U0001f468‍\U0001f469", "é", "foo_bar", "<|endoftext|>", "<s>", "<unk>", "<0x41>", "....", "\x1c", "a b", "　", "﻿", "À́", "\x00", "​", "ΑΒΓ", "كتاب"]
    spaces = [" "] * 12 + ["  ", "\n", "\n\n", "\t", " \n ", "\r\n", "   ", " ", " ", "\x85", "\x1c", "\x0b "]
    out = rng.choice(["", "", "", " ", "\n", "  "])
    for _ in range(rng.randrange(1, 40)):
        out += rng.choice(words) + rng.choice(spaces)
    return out if rng.random() < 0.3 else out.rstrip()


ODD = [(1, None), (2, ""), (3, " "), (4, "  "), (5, "\n"), (6, "a"), (7, "▁"), (8, "x▁y z"), (9, "same text"), (9, "same text"), (None, "same text"), (10, "word " * 20_000), (11, "日" * 5_000), (12, " lead"), (13, "trail "), (14, "a  b   c")]


def test_labels_lead_to_the_last_token_of_each_component():
    rng = random.Random(1)
    for _ in range(50):
        total = rng.randrange(1, 60)
        cuts = [np.array(sorted({total, *(rng.randrange(1, total + 1) for _ in range(rng.randrange(0, 30)))})) for _ in range(2)]
        got = labels(*cuts)
        both = np.array(sorted(set(cuts[0].tolist()) & set(cuts[1].tolist())))
        want = np.concatenate([np.searchsorted(cuts[1], both[np.searchsorted(both, x)]) for x in cuts])
        assert got.tolist() == want.tolist()
    # A chain over all tokens, which only ends at its end.
    a, b = np.arange(2, 20_002, 2), np.append(np.arange(1, 20_000, 2), 20_000)
    assert set(labels(a, b).tolist()) == {len(b) - 1}


def test_pieces_are_encoded_as_in_the_whole_text():
    rng = random.Random(2)
    texts = [made(rng) for _ in range(400)]
    assert all(" ".join(cut(t, Sure())) == t for t in texts)
    both = Aligner(A, B)
    for t, want in zip(texts, by_force(texts), strict=True):
        held = both.of(cut(t, Sure())) if t else [None]
        if want is None:
            assert None in held
            continue
        got = [tuple([int(k) for k in y.split(b",")] for y in x.split(b"|")) for p in held for x in p.told.split(b";")]
        assert [(x >> 32, x & ((1 << 32) - 1)) for p in held for x in p.pairs] == [(a[-1], b[-1]) for a, b in got]
        assert got == want, t


def test_digest_groups_and_counts_equal_brute_force(spark):
    rng = random.Random(3)
    docs = ODD + [(k, made(rng)) for k in range(100, 220)]
    found = by_force([t for _, t in docs])
    links = [[(x[0][-1], x[1][-1]) for x in g or []] for g in found]
    counts = collections.Counter(x for own in links for x in own)
    most = collections.defaultdict(int)
    for (_, b), n in counts.items():
        most[b] = max(most[b], n)
    want = []
    for (i, _), g, own in zip(docs, found, links, strict=True):
        told = ";".join(f"{','.join(map(str, a))}|{','.join(map(str, b))}" for a, b in g or [])
        want.append((i, sum(len(a) for a, _ in g or []), sum(len(b) for _, b in g or []), len(g or []), len(own), sum(counts[x] == most[x[1]] for x in own), sum(counts[x] for x in own), hashlib.sha256(told.encode()).hexdigest() if g else ""))
    frame = spark.createDataFrame([(*x, "n") for x in docs], "doc_id long, text string, n_a string").repartition(3)
    key = lambda x: tuple((v is None, v) for v in x)
    for size in (32 << 20, 2_000):
        assert sorted(map(tuple, digest(frame, A, B, size).collect()), key=key) == sorted(want, key=key)
    told = {(x.a_id, x.b_id): (x["count"], x.best) for x in pair_counts(frame, A, B).collect()}
    assert told == {x: (n, n == most[x[1]]) for x, n in counts.items()}
    rows = sorted((x.group, x.a_ids, x.b_ids) for x in groups(frame.filter("doc_id = 14"), A, B).collect())
    assert rows == [(k, *x) for k, x in enumerate(found[docs.index((14, "a  b   c"))])]
    empty = frame.limit(0)
    assert digest(empty, A, B).count() == groups(empty, A, B).count() == pair_counts(empty, A, B).count() == 0
    bare = digest(frame.filter("doc_id < 3"), A, B).collect()
    assert sorted(map(tuple, bare)) == [(1, *(0,) * 6, ""), (2, *(0,) * 6, "")]
