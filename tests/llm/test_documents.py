"""Quality rules, language, model scores, packing, URL rules, decontamination and the pipeline on small tables."""

import collections
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinstats.llm import langid, lmscore, lsa, packing, quality, urlrules

SPACE = r"[^\x20\x09-\x0D]+"
ODD = [(1, None), (2, ""), (3, " \n\t"), (4, "a b a b a b a"), (5, "one\ntwo\none\n\none\n \n"), (6, "#|& <x> é ü\x0bz\u00a0q"), (6, "#|& <x> é ü\x0bz\u00a0q"), (None, "w " * 70), (8, "x y z " * 4000), (9, " ".join(f"word{k}" for k in range(80)))]


def test_quality_counts_and_cascade(spark):
    frame = spark.createDataFrame([(*x, 0) for x in ODD], "doc_id long, text string, n_words int")
    got = {(x.doc_id, x.text): x for x in quality.measure(frame).collect()}
    for i, text in ODD:
        words = re.findall(SPACE, text or "")
        windows = collections.Counter(tuple(words[k : k + 3]) for k in range(len(words) - 2))
        cover = {j for k in range(len(words) - 2) if windows[tuple(words[k : k + 3])] > 1 for j in (k, k + 1, k + 2)}
        lines = [x for x in (text or "").split("\n") if re.search(SPACE, x)]
        want = (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(cover))
        x = got[i, text]
        assert (x.n_words, x.word_chars, x.n_symbols, x.n_dup_lines, x.n_repeat_words) == want, (i, want)
    kept = quality.keep_good(frame)
    assert kept.columns == frame.columns and [x.doc_id for x in kept.collect()] == [9]
    assert quality.keep_good(frame.limit(0)).count() == 0
    ranked = quality.profile(frame, quality.BASE + quality.RULES)
    assert sorted(x[2].name for x in ranked) == sorted(x.name for x in quality.BASE + quality.RULES)
    # A second rule on the same counts costs next to nothing.
    assert min(x[1] for x in ranked if x[2].name in ("short_words", "long_words")) == pytest.approx(1e-4)
    assert [x[1] for x in quality.profile(frame, quality.RULES, list(quality.COUNTS))] == [pytest.approx(1e-4)] * 5


def test_quality_rules_after_a_rejection_do_not_run(spark):
    few, = [x for x in quality.BASE if x.name == "few_words"]
    never = quality.Rule("never", lambda c: F.when(c("n_words") < 50, F.raise_error(F.lit("ran")).cast("boolean")).otherwise(False))
    short = spark.createDataFrame([(k, "a b") for k in range(5)] + [(9, None)], "doc_id long, text string")
    text = F.col("text")
    assert short.filter(quality.cascade([few, never], text)).count() == 6
    with pytest.raises(Exception, match="ran"):
        short.filter(quality.cascade([never, few], text)).count()
    # Whatever the order, the verdicts are the same.
    frame = spark.createDataFrame([(i, t) for i, t in ODD] + [(20 + k, f"#| {'x' * (k % 14)} y{k} " * (30 + k)) for k in range(40)], "doc_id long, text string")
    want = frame.select(quality.cascade(quality.BASE + quality.RULES, text)).collect()
    rules = quality.BASE + quality.RULES
    for k in range(3):
        random.Random(k).shuffle(rules)
        assert frame.select(quality.cascade(rules, text)).collect() == want


def test_language(spark):
    rng = random.Random(2)
    make = lambda parts: " ".join("".join(rng.choice(parts) for _ in range(3)) for _ in range(40)).capitalize()
    syllables = {"aa": ["th", "er", "ing", "ou"], "bb": ["ñe", "ció", "os", "ra"], "cc": ["sch", "ein", "ung", "ß"]}
    rows = [(k, make(syllables[lang]), lang) for k, lang in enumerate(sorted(syllables) * 30)]
    train = spark.createDataFrame(rows[:60] + [(900, "x", None), (901, None, "aa")], "doc_id long, text string, lang string")
    model = langid.learn(train, dimension=512)
    odd = [(1000, None), (1001, "12 !!"), (1002, ""), (1003, "\U0001f600"), (1004, "q"), (1005, rows[60][1] * 300), (1006, rows[61][1]), (1006, rows[61][1]), (1007, "\u0436\u0438 \U00010400\U00010401")]
    frame = spark.createDataFrame([(i, t, "zz") for i, t, _ in rows[60:]] + [(i, t, "zz") for i, t in odd], "doc_id long, text string, score string")
    found = langid.predict(frame, model, ["doc_id"]).collect()
    got = {x.doc_id: x for x in found}
    assert len(found) == frame.count() and got[1005].lang_pred == rows[60][2] and got[1006].lang_pred == rows[61][2]
    assert all(got[i].lang_pred == lang for i, _, lang in rows[60:])
    assert all(got[i].lang_pred == "und" and got[i].score == 0 for i in (1000, 1001, 1002, 1003)) and got[1004].lang_pred != "und" != got[1007].lang_pred
    assert all(0 <= x.score <= 1 for x in got.values())
    # A text alone in its batch is judged as beside others.
    alone = langid.predict(frame.filter("doc_id = 1004").coalesce(1), model, ["doc_id"]).first()
    assert alone.lang_pred == got[1004].lang_pred and alone.score == pytest.approx(got[1004].score, abs=1e-6)
    # Brute force: whole bundles of vectors put together letter by letter.
    names, vectors = langid.centred(model)
    letter = lambda c: np.random.default_rng([7, ord(c)]).choice(np.array([-1, 1], np.int8), 512).astype(float)
    for i, text in [(i, t) for i, t, _ in rows[60:70]] + odd[4:]:
        marked = "\0" + re.sub(r"[\W\d_]+", "\0", text.lower()).strip("\0") + "\0"
        windows = [marked[k : k + 3] for k in range(len(marked) - 2) if marked[k + 1] != "\0"]
        bundle = sum(np.roll(letter(a), 2) * np.roll(letter(b), 1) * letter(c) for a, b, c in windows)
        products = vectors @ bundle
        size = math.sqrt(512 * sum(n * n for n in collections.Counter(windows).values()))
        assert got[i].lang_pred == names[int(np.argmax(products))] and got[i].score == pytest.approx(max(0.0, products.max() / size), abs=1e-4)
    # Equal prototypes are a tie: the first name wins.
    assert {x.lang_pred for x in langid.predict(frame, {"b": model["aa"], "a": model["aa"]}, ["doc_id"]).filter("score > 0").collect()} <= {"a"}
    assert langid.learn(train.limit(0)) == {} and langid.predict(frame, {}, ["doc_id"]).filter("lang_pred <> 'und'").count() == 0
    assert langid.predict(frame.limit(0), model, ["doc_id"]).count() == 0


@pytest.mark.parametrize("block", [1 << 22, 60])
def test_model_scores_match_brute_force(spark, block):
    rng = random.Random(5)
    docs = [(k, " ".join(rng.choice("abcdefgh") * rng.randint(1, 2) for _ in range(rng.randint(0, 30)))) for k in range(40)] + [(None, None), (50, "  "), (51, "A b"), (51, "A b"), (52, "É é a"), (None, "b a"), (53, "a c " * 3000)]
    frame = spark.createDataFrame([(*x, 1.0) for x in docs], "doc_id long, text string, score double").repartition(3)
    good = set(range(15)) | {51, 53}
    targets = spark.createDataFrame([(i,) for i in [*good, 3, 999, None]], "doc_id long")
    got = lmscore.score(frame, targets, mu=5.0, bytes_a_block=block).collect()
    assert sorted((str(x.doc_id), x.n_tokens) for x in got) == sorted((str(i), len((t or "").split())) for i, t in docs)
    texts = [(i in good, (t or "").lower().split()) for i, t in docs]
    size = len({w for _, x in texts for w in x})

    def model(some):
        return collections.Counter(w for x in some for w in x), collections.Counter(p for x in some for p in zip([None, *x], x)), sum(1 for x in some if x)

    models = [(model([x for g, x in texts if g]), lambda g: g), (model([x for _, x in texts]), lambda g: True)]
    for (i, _), (g, tokens) in zip(docs, texts):
        if not tokens:
            assert all(x.score is None and x.target_loss is None for x in got if x.doc_id == i and x.n_tokens == 0)
            continue
        loss = []
        for (words, pairs, starts), learned in models:
            own = model([tokens]) if learned(g) else model([])
            n, total = sum(words.values()) - sum(own[0].values()), 0
            for v, w in zip([None, *tokens], tokens):
                prior = (words[w] - own[0][w] + 1) / (n + size)
                context = words[v] - own[0][v] if v is not None else starts - own[2]
                pair = pairs[v, w] - own[1][v, w]
                total -= math.log((pair + 5 * prior) / (max(context, pair) + 5))
            loss.append(total / len(tokens))
        mine = [x for x in got if x.doc_id == i and x.n_tokens == len(tokens)]
        assert mine and all((x.target_loss, x.background_loss, x.score) == pytest.approx((*loss, loss[0] - loss[1]), abs=1e-9) for x in mine)
    assert lmscore.score(frame.limit(0), targets).count() == 0
    # Without target documents the target model is the uniform one.
    alone = lmscore.score(frame, targets.limit(0)).filter("n_tokens > 0").collect()
    assert all(x.target_loss == pytest.approx(math.log(size)) for x in alone)


def test_packing(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    whole = Tokenizer.from_file(path)
    odd = [*ODD, (20, "I'm don't x's 12a3 ÀÉ naïve straße ﬁ \u0130stanbul e\u0301 <|endoftext|>a b\u2028c Ünï, \x1cq fin... ..x ,,"), (21, "ok " * 5000)]
    frame = spark.createDataFrame([(*x, 5) for x in odd], "doc_id long, text string, length int")
    got = packing.best_fit(frame, path, length=100)
    want = collections.Counter()
    for i, text in odd:
        ids = [*whole.encode(text or "", add_special_tokens=False).ids, 0]
        for k in range(0, len(ids), 100):
            want[i, k // 100, k, len(ids[k : k + 100]), zlib.crc32(np.array(ids[k : k + 100], "<u4").tobytes())] += 1
    rows = got.collect()
    assert collections.Counter((x.doc_id, x.piece, x.start, x.length, x.ids_crc32) for x in rows) == want
    bins = collections.defaultdict(list)
    for x in rows:
        bins[x.sequence_id].append((x.offset, x.length))
    for parts in bins.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= 100
    assert packing.best_fit(frame.limit(0), path).count() == 0


def test_packing_in_several_groups(spark):
    rng = random.Random(16)
    rows = [(k, 0, 0, rng.choice([rng.randint(1, 20), rng.randint(20, 90), 100]), k) for k in range(3000)] + [(None, 0, 0, 60, 1)] * 40
    frame = spark.createDataFrame(rows, packing.PIECES)
    got = packing.pack(frame, length=100, group_rows=500).collect()
    assert sorted(map(str, (tuple(x)[:5] for x in got))) == sorted(map(str, rows))
    bins = collections.defaultdict(list)
    for x in got:
        bins[x.sequence_id].append((x.offset, x.length))
    for parts in bins.values():
        starts = [sum(n for _, n in sorted(parts)[:k]) for k in range(len(parts))]
        assert [o for o, _ in sorted(parts)] == starts and starts[-1] + sorted(parts)[-1][1] <= 100
    # Less than one sequence a group more than the lower bound; with one group as few as best-fit decreasing gives.
    sizes = sorted((x[3] for x in rows), reverse=True)
    least = math.ceil(sum(sizes) / 100)
    assert len(bins) < least + math.ceil(len(rows) / 500)
    gaps = []
    for n in sizes:
        k = min((g for g in gaps if g >= n), default=None)
        if k is not None:
            gaps.remove(k)
        gaps.append((100 if k is None else k) - n)
    assert packing.pack(frame, length=100).select("sequence_id").distinct().count() <= len(gaps)


def test_sum_of_squares_places():
    rng = random.Random(6)
    sizes = [rng.randint(1, 20) for _ in range(300)]
    bins, places = packing.sum_of_squares(sizes, 20)
    level = collections.Counter()
    for size, b, place in zip(sizes, bins, places):
        gaps = collections.Counter(20 - x for x in level.values() if x < 20)
        cost = {}
        for gap in [x for x in gaps if x >= size] or [20]:  # a new bin only where it fits into no open one
            if gap >= size:
                after = collections.Counter(gaps)
                after[gap] -= gap < 20 or 0
                after[gap - size] += gap > size
                cost[gap] = sum(n * n for g, n in after.items() if 0 < g < 20)
        assert place == level[b] and cost[20 - place] == min(cost.values())
        level[b] += size


def test_url_rules(spark):
    rules = {"org/": "allow", "example.org/es/": "block", "example.org/en/1": "block", "com/fr/": "allow", "com/de/": "block"}
    rng = random.Random(8)
    urls = [f"http{s}://{h}.EXAMPLE.{t}/{p}/{n}{e}" for s in ("", "s") for h in ("a", "b.c") for t in ("org", "com", "net") for p in ("en", "fr", "de", "es", "x") for n in (1, 25) for e in ("", "?page=2#z", ".html")]
    urls += [None, "", "no scheme", "://", "http://org", "http://org?x", "http://ORG/é", "x://y://org/a", "http://notorg/", "http://a.com/fr", "http://a.com/fr/", "h://com/fr/\nq?"]
    rows = [(k, u) for k, u in enumerate(urls + rng.sample(urls, 5))] + [(None, "http://org/")]
    frame = spark.createDataFrame([(*x, "h") for x in rows], "page_id long, url string, host string")
    got = urlrules.judge(frame, rules, support=0.02, least_count=1).collect()
    assert len(got) == len(rows)
    by = {x.page_id: x for x in got}
    labelled = []
    for i, u in rows:
        m = re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)", u or "")
        host, path = (m[1].translate({c: c + 32 for c in range(65, 91)}), m[2]) if m else ("", "")
        fits = [r for r in rules if (host == r.partition("/")[0] or host.endswith("." + r.partition("/")[0])) and path.startswith("/" + r.partition("/")[2])]
        rule = max(fits, key=len, default=None)
        assert (by[i].host, by[i].path, by[i].rule) == (host, path, rule), u
        if rule:
            assert by[i].verdict == rules[rule]
            labelled.append((u, rules[rule]))
    # Mined rules by force: all combinations of tokens, by confidence, support, size and verdict.
    from itertools import combinations

    tokens = {x.url: frozenset(x.t) for x in frame.select("url", urlrules.tokens(F.col("url")).alias("t")).distinct().collect()}
    labels = dict(labelled)
    count, sure = collections.Counter(), collections.Counter()
    for u, verdict in labels.items():
        for k in range(1, len(tokens[u]) + 1):
            for some in combinations(sorted(tokens[u]), k):
                count[some] += 1
                sure[some, verdict] += 1
    least = 0.02 * len(labels)
    found = {(s, v): (n / count[s], n) for (s, v), n in sure.items() if n >= least - 1e-9 and n / count[s] >= 0.9}
    found = {(s, v): x for (s, v), x in found.items() if not any(w == v and set(r) < set(s) and y[0] >= x[0] for (r, w), y in found.items())}
    for i, u in rows:
        if by[i].rule is None:
            own = [(*x, len(s), v) for (s, v), x in found.items() if u is not None and set(s) <= tokens[u]]
            assert by[i].verdict == (max(own)[3] if own else "allow"), u
    assert urlrules.judge(frame.filter("page_id = 0 and url = 'none'"), rules).count() == 0


def test_decontamination(spark):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(3, 8)))
    items = [(k, " ".join(word() for _ in range(rng.randint(15, 50))) + ". " + " ".join(word() for _ in range(6)) + ".") for k in range(30)]
    noise = lambda n: " ".join(word() if rng.random() < 0.7 else "the" for _ in range(n))
    docs, want = [], set()
    for k in range(150):
        text = noise(rng.randint(0, 200))
        if k % 3 == 0:
            i, passage = rng.choice(items)
            words = passage.split()
            if k % 2:  # a paraphrase: some words are others, some are gone
                words = [w if rng.random() > 0.12 else word() for w in words if rng.random() > 0.06]
            text += " " + " ".join(words).upper() * (k % 4 == 0) + " ".join(words) * (k % 4 != 0) + " " + noise(rng.randint(0, 100))
            want.add((k, i))
        docs.append((k, text))
    docs += [(None, items[3][1]), (500, None), (501, ""), (502, noise(20_000) + " " + items[4][1])]
    want |= {(None, 3), (502, 4)}
    frame = spark.createDataFrame([(*x, 0.5) for x in docs], "doc_id long, text string, cosine double").repartition(3)
    passages = spark.createDataFrame([*items, (90, None), (91, " ")], "item_id long, text string")
    found = {(x.doc_id, x.item_id) for x in lsa.matches(frame, passages).collect()}
    assert len(found & want) >= 0.9 * len(want) and found <= want
    assert {(x.doc_id, x.item_id) for x in lsa.matches(frame, passages, slice_bytes=2000).collect()} >= found & {(None, 3), (502, 4)}
    assert lsa.matches(frame.limit(0), passages).count() == 0 and lsa.matches(frame, passages.limit(0)).count() == 0


def test_decontamination_with_fewer_axes_than_passages(spark):
    rng = random.Random(13)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(4, 8))) for _ in range(6000)]
    items = [(k, " ".join(rng.choice(words) for _ in range(rng.randint(15, 50))) + ".") for k in range(300)]
    docs = []
    for k in range(80):
        passage = rng.choice(items)[1].split()
        if k % 2:  # a paraphrase
            passage = [w if rng.random() > 0.15 else rng.choice(words) for w in passage]
        noise = lambda n: [rng.choice(words) + "x" for _ in range(n)]
        docs.append((k, " ".join(noise(rng.randint(0, 60)) + passage + noise(rng.randint(0, 60)))))
    whole = [(i, lsa.words_of(t)) for i, t in items]
    bits = [(i, len(w), set(w), lsa.places(w)) for i, w in whole]
    want = set()
    for d, t in docs:
        own = lsa.words_of(t)
        have = set(own)
        want |= {(d, i) for i, n, some, at in bits if len(some & have) >= 0.6 * len(some) and lsa.common_subsequence(at, own) >= 0.7 * n}
    assert len(want) > 70
    found = {(x.doc_id, x.item_id) for x in lsa.matches(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert found >= want


def test_decontamination_finds_passages_that_leak_often(spark):
    rng = random.Random(14)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(4, 8)))
    often = ["so", "we", "go", "on", "and", "then", "it", "is", "all", "of", "the", "day", "to", "him", "for"]
    items = [(k, " ".join(word() for _ in range(20)) + ".") for k in range(5)] + [(5, " ".join(often) + ".")]
    docs, want = [], set()
    for k in range(200):
        words = [word() if rng.random() < 0.6 else rng.choice(often) for _ in range(60)]
        at = rng.randint(0, 60)
        if k % 2:  # one passage in half of the documents
            words[at:at] = items[0][1].split()
            want.add((k, 0))
        elif k % 10 == 0:  # a passage of words that most documents have
            words = [word() for _ in range(60)]
            words[at:at] = items[5][1].split()
            want.add((k, 5))
        docs.append((k, " ".join(words)))
    copies = [(k, docs[1][1]) for k in range(200, 300)]
    want |= {(k, 0) for k, _ in copies}
    frame = spark.createDataFrame(docs + copies, "doc_id long, text string")
    assert {(x.doc_id, x.item_id) for x in lsa.matches(frame, spark.createDataFrame(items, "item_id long, text string")).collect()} >= want


@pytest.mark.parametrize("n_docs", [5, 1500])
def test_decontamination_finds_passages_of_any_length(spark, n_docs):
    rng = random.Random(15)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(3, 8))) for _ in range(3000)]
    draw = lambda n: [words[min(int(rng.expovariate(0.004)), 2999)] for _ in range(n)]
    sizes = [20, 100, 600, 1000, 3000]
    items = [(k, " ".join(draw(sizes[k % 5])) + ".") for k in range(20)]
    # No-break spaces are no white space here, and a passage of marks has no word.
    odd = [(100, "\u00a0 \u2003"), (101, "!? ... ;"), (102, None), (103, "  ")]
    docs, want = [], set()
    for k in range(n_docs):
        text = draw(rng.randint(0, 80))
        if k < 5 or k % 50 == 0:
            i = k % 5 if n_docs == 5 else rng.randrange(20)
            passage = items[i][1].split()
            if k % 100 == 50:  # a paraphrase
                passage = [w if rng.random() > 0.1 else rng.choice(words) for w in passage if rng.random() > 0.08]
            text = text + passage + draw(rng.randint(0, 80))
            want.add((k, i))
        docs.append((k, " ".join(text)))
    docs += [(9000, docs[0][1]), (9000, docs[0][1]), (9001, None), (9002, "\u00a0")]
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    found = [(x.doc_id, x.item_id) for x in lsa.matches(frame, spark.createDataFrame(items + odd, "item_id long, text string")).collect()]
    want |= {(9000, i) for k, i in want if k == 0}
    assert len(want & set(found)) >= 0.95 * len(want) and set(found) - {(9002, 100)} <= want
    assert found.count((9000, 0)) == 2 * ((0, 0) in want)


def test_decontamination_weighs_words_by_all_passages_of_all_documents(spark, monkeypatch):
    rng = random.Random(16)
    words = [f"w{k}" for k in range(300)]
    docs = [(k, " ".join(rng.choice(words) for _ in range(rng.choice((0, 3, 47, 48, 49, 130))))) for k in range(3000)] + [(9000, " ".join(rng.choice(words) for _ in range(5000))), (9001, None)]
    items = [(k, " ".join(rng.sample(words[:200], 20))) for k in range(12)]
    seen, space = [], lsa.Space.__init__
    monkeypatch.setattr(lsa.Space, "__init__", lambda self, passages, parts, others, counts, n: seen.append((passages.vocabulary.ids, counts, n)) or space(self, passages, parts, others, counts, n))
    lsa.matches(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).count()
    known = {w for _, t in items for w in t.split()}
    rows = [known & set(own[at : at + lsa.PART]) for _, t in docs for own in [(t or "").split()] for at in range(0, len(own), lsa.PART)]
    want = collections.Counter(w for x in rows for w in x)
    (ids, counts, n), = seen
    assert n == sum(map(bool, rows)) and {w.decode(): counts[k] for w, k in ids.items()} == dict(want)


@pytest.mark.parametrize("cells", [(1 << 24, 1 << 16), (500, 100), (1, 1)])
def test_products_of_words_in_bands_and_blocks(spark, monkeypatch, cells):
    monkeypatch.setattr(lsa, "BAND_CELLS", cells[0])
    monkeypatch.setattr(lsa, "BLOCK_CELLS", cells[1])
    rng = np.random.default_rng(17)
    a = np.where(rng.random((1300, 31)) < 0.3, rng.integers(1, 4, (1300, 31)), 0)
    a[:, 7] = a[5] = 0
    scale, weights = rng.random(1300), np.linspace(1, 2, 30).astype(np.float32)
    frame = spark.createDataFrame([(np.flatnonzero(x).tolist(), x[x > 0].tolist(), float(s)) for x, s in zip(a, scale)], "words array<int>, counts array<int>, scale double").repartition(3)
    got = np.zeros((30, 30))
    for at, part in lsa.products(frame, np.arange(31) - 1, weights).collect():
        block = np.array(part).reshape(-1, 30)
        got[at : at + len(block)] += block
    x = a[:, 1:] * weights
    x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-6) * scale[:, None]
    assert np.allclose(got, x.T @ x, rtol=1e-4, atol=1e-5)


def test_latent_axes_are_singular_vectors(spark):
    rng = random.Random(10)
    rows = [[(w, rng.randint(1, 3)) for w in sorted(rng.sample(range(40), 12))] for _ in range(25)]
    frame = spark.createDataFrame([([w for w, _ in x], [n for _, n in x], 1.0) for x in rows], "words array<long>, counts array<long>, scale double")
    local, weights = np.arange(40) - 1, np.linspace(1, 2, 39).astype(np.float32)  # word 0 is none of the space
    axes = lsa.latent_axes(frame, local, weights, 5, rounds=8)
    a = np.zeros((25, 39))
    for k, row in enumerate(rows):
        for w, n in row:
            if w:
                a[k, w - 1] = n * weights[w - 1]
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    right = np.linalg.svd(a)[2][:5]
    assert np.allclose(axes.T @ axes, np.eye(5), atol=1e-4) and np.linalg.norm(right @ axes) == pytest.approx(math.sqrt(5), abs=0.05)


def test_parts_cover_passages():
    for n in range(1, 400):
        parts = lsa.parts_of(n)
        assert parts[0][0] == 0 and parts[-1][1] == n and all(b - a <= lsa.PART for a, b in parts) and all(a2 <= b1 - 9 for (_, b1), (a2, _) in zip(parts, parts[1:]))


def test_subsequence():
    rng = random.Random(11)
    for _ in range(50):
        a, b = ([rng.choice([b"a", b"b", b"c"]) for _ in range(rng.randint(1, 25))] for _ in range(2))
        row = [0] * (len(b) + 1)
        for x in a:
            before = row[:]
            for j, y in enumerate(b):
                row[j + 1] = before[j] + 1 if x == y else max(row[j], before[j + 1])
        assert lsa.common_subsequence(lsa.places(a), b) == row[-1]
