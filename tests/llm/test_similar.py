"""Near-duplicate groups and fingerprint components against brute force."""

import random
import re

import pytest
import xxhash

from kinstats.llm import similar, simhash


def family(rng, n, words, edits):
    base = [f"w{rng.randrange(5000)}" for _ in range(words)]
    out = []
    for _ in range(n):
        x = list(base)
        for _ in range(rng.randint(0, edits)):
            x[rng.randrange(len(x))] = f"e{rng.randrange(10**6)}"
        out.append(" ".join(x))
    return out


def corpus():
    rng = random.Random(3)
    texts = [t for n, words, edits in ((30, 80, 4), (12, 60, 3), (8, 120, 12)) for t in family(rng, n, words, edits)]
    texts += [" ".join(f"u{rng.randrange(10**6)}" for _ in range(40)) for _ in range(30)]
    texts += ["", None, " \t", "one two", "ONE  two", "x " * 300]
    rng.shuffle(texts)
    return list(enumerate(texts)) + [(None, texts[0])]


def classes(ids, linked):
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in linked:
        x, y = sorted((find(a), find(b)))
        parent[y] = x
    return {i: find(i) for i in ids}


def shingles(text, size):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    return [" ".join(words[k : k + size]) for k in range(max(1, len(words) - size + 1))] if words else []


def test_groups_match_brute_force(spark):
    docs = [(similar.LAST if i is None else i, t) for i, t in corpus()]
    sets = [(i, set(shingles(t, 5))) for i, t in docs]
    linked = [(i, j) for k, (i, a) in enumerate(sets) for j, b in sets[:k] if a == b or len(a & b) >= 0.8 * len(a | b) > 0]
    want = classes([i for i, _ in docs], linked)
    frame = spark.createDataFrame(docs, "doc long, text string")
    for hot in (64, 3):  # with and without draws that are too crowded to pair
        got = dict(map(tuple, similar.groups(frame, hot=hot, sampled=2).collect()))
        assert got == want, hot


def test_groups_of_texts_that_repeat_phrases_match_brute_force(spark):
    rng = random.Random(8)
    docs = []
    for k in range(20):
        words = [f"r{rng.randrange(10**6)}" for _ in range(100)]
        docs += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(words + words[-5:] * 16))]
    sets = [(i, set(shingles(t, 5))) for i, t in docs]
    want = classes([i for i, _ in docs], [(i, j) for k, (i, a) in enumerate(sets) for j, b in sets[:k] if len(a & b) >= 0.8 * len(a | b)])
    assert len(set(want.values())) == 20
    frame = spark.createDataFrame(docs, "doc long, text string")
    for hot in (64, 1):
        assert dict(map(tuple, similar.groups(frame, hot=hot, sampled=2).collect())) == want, hot


def exchanged(plan):
    """Columns of what a plan sends, a line for each exchange."""
    if plan.nodeName() == "AdaptiveSparkPlan":
        plan = plan.initialPlan()
    below = [x for k in range(plan.children().size()) for x in exchanged(plan.children().apply(k))]
    return [plan.output().toString()] * (plan.nodeName() == "Exchange") + below


def test_near_dedup_sends_no_texts(spark, monkeypatch):
    sent, save = [], similar.saved
    monkeypatch.setattr(similar, "saved", lambda df: sent.extend(exchanged(df._jdf.queryExecution().executedPlan())) or save(df))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as if no table were small
    try:
        similar.groups(spark.createDataFrame([x for x in corpus() if x[0] is not None], "doc long, text string"))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert any("set#" in x for x in sent) and not any("text#" in x for x in sent)


@pytest.mark.parametrize("bits", [64, 1 << 23])
def test_sets_of_wanted_documents_only(spark, bits):
    docs = [(k * k - 50, f"a{k} b c d e f a{k} b c d e") for k in range(200)] + [(-1, None)]
    wanted = [(d,) for d, _ in docs[::7]] + [(-1,)]
    out = similar.shingle_sets(spark.createDataFrame(docs, "doc long, text string"), 5, spark.createDataFrame(wanted, "doc long"), bits)
    got = {x.doc: len(x.set) for x in out.collect()}
    assert got == {d: len(set(shingles(t, 5))) for d, t in docs if (d,) in wanted}


def test_one_of_each_keeps_columns_and_least_ids(spark):
    rows = [(5, "a b c d e f g", "x"), (3, "A b c d e  f g", "y"), (9, "z z z", None), (9, "z z z", None), (None, "a b c d e f g", "n"), (None, None, "n")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, same string")
    out = similar.one_of_each(frame)
    assert out.columns == frame.columns
    assert sorted(map(str, map(tuple, out.collect()))) == sorted(map(str, [rows[1], rows[2], rows[3], rows[5]]))
    assert similar.one_of_each(frame.limit(0)).count() == 0


@pytest.mark.parametrize("hot", [64, 2])
def test_fingerprint_components_match_brute_force(spark, hot, monkeypatch):
    docs = corpus()
    prints = {}
    for i, t in docs:
        h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in shingles(t, 3)]
        prints[i] = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
    ids = [i for i in prints if i is not None]
    want = classes(ids, [(i, j) for k, i in enumerate(ids) for j in ids[:k] if (prints[i] ^ prints[j]).bit_count() <= 2])
    links = simhash.fingerprint_links
    monkeypatch.setattr(simhash, "fingerprint_links", lambda nodes, bits: links(nodes, bits, hot=hot))
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    got = [tuple(x) for x in simhash.near_duplicates(frame).collect()]
    assert {(i, f, c) for i, f, c in got if i is not None} == {(i, f"{prints[i]:016x}", want[i]) for i in ids}
    assert len(got) == len(docs)
    (null,) = [x for x in got if x[0] is None]
    assert null[1] == f"{prints[0]:016x}" and null[2] == want[0]
    assert simhash.near_duplicates(frame.limit(0)).count() == 0


def test_links_between_components_of_a_draw_are_all_found(spark):
    rng = random.Random(3)
    sets = [sorted({rng.randrange(40) for _ in range(30)} | {1000 + k}) if k % 9 else [] for k in range(90)]
    held = [(d, k, rng.getrandbits(6), k % 7 if k % 2 else 3, 3, sets[k]) for d in (1, 2) for k in range(90) if (k + d) % 5]
    frame = spark.createDataFrame(held, "draw long, node long, fp long, component long, largest long, set array<int>")
    alike = lambda x, y: len({*x} & {*y}) >= 0.6 * len({*x} | {*y}) - 1e-9
    want = {(min(x[1], y[1]), max(x[1], y[1])) for x in held for y in held if x[0] == y[0] and x[3] != 3 and x[3] != y[3] and (x[2] ^ y[2]).bit_count() <= 3 and alike(x[5], y[5])}
    assert len(want) > 20
    for side in (512, 7):
        assert {(x.a, x.b) for x in similar.crossing(frame, 0.6, 3, side).collect()} == want
