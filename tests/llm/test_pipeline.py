"""The pipeline against its stages by brute force, on a small corpus."""

import random
import re

import numpy as np
from tokenizers import Tokenizer

import corpus_pipeline

from .test_spans import LAST

SPACE = r"[^\x20\x09-\x0D]+"


def corpus():
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(3, 8)))
    text = lambda n: [word() for _ in range(n)]
    items = [(k, " ".join(text(25)) + ".") for k in range(6)]
    shared = text(60)
    docs = []
    for k in range(60):
        words = text(rng.randint(60, 150))
        if k % 6 == 0:
            words[20:20] = shared
        if k % 10 == 3:
            words[30:30] = items[k % 6][1].split()
        docs.append(" ".join(words))
    docs += [docs[1], docs[2].upper(), docs[4] + " more", " ".join(["x"] + docs[5].split()[1:]), "short text", None, "# " * 200, "spam spam " * 100, " ".join(text(3000))]
    return [(k, t, "en", f"s{k % 3}", len(t or "")) for k, t in enumerate(docs)], items


def keeps(text):
    words = re.findall(SPACE, text or "")
    if len(words) < 50:
        return False
    windows = [tuple(words[k : k + 3]) for k in range(len(words) - 2)]
    cover = {j for k, w in enumerate(windows) if windows.count(w) > 1 for j in (k, k + 1, k + 2)} if len(words) < 1000 else set()
    symbols = sum(c in "#*$%&|<>" for c in text)
    return 2 * len(cover) <= len(words) and 3 * len(words) <= sum(map(len, words)) <= 10 * len(words) and 10 * symbols <= len(words)


def test_stages_by_force(spark, tmp_path):
    docs, items = corpus()
    names = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(docs, names).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    at = [x for x in docs if keeps(x[1])]
    assert len(at) == 65
    sets = {x[0]: {tuple(w[k : k + 5]) for k in range(len(w) - 4)} for x in at for w in [re.findall(SPACE, x[1].lower())]}
    gone = {i for i in sets for j in sets if j < i and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])}
    assert gone == {60, 61, 62, 63}
    at = [x for x in at if x[0] not in gone]
    seen, cut = set(), []
    for x in at:
        words = x[1].split()
        drop = set()
        for k in range(len(words) - 19):
            window = tuple(words[k : k + 20])
            if window in seen:
                drop.update(range(k, k + 20))
            seen.add(window)
        cut.append((x[0], " ".join(w for k, w in enumerate(words) if k not in drop) if drop else x[1], *x[2:]))
    assert sum(a != b for a, b in zip(at, cut)) == 9 + len([k for k in range(60) if k % 10 == 3 and k >= 30])
    clean = [x for x in cut if not any(t in x[1] for _, t in items)]
    assert len(clean) == len(cut) - 3  # what a second document repeats of a passage is gone by then
    results = []
    spark_docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, spark_docs, str(tmp_path))
        out.write.parquet(str(tmp_path / f"stage{k}"))
        spark_docs = spark.read.parquet(str(tmp_path / f"stage{k}"))
        if k < 4:
            assert spark_docs.columns == [x.split()[0] for x in names.split(", ")], name
        results.append(sorted(map(tuple, spark_docs.collect())))
    assert [x[0] for x in results[0]] == [x[0] for x in docs if keeps(x[1])]
    assert results[1] == at and results[2] == cut and results[3] == clean
    import public_tokenizers

    whole = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = {(x[0], k): len(part) for x in clean for ids in [np.append(whole.encode(x[1], add_special_tokens=False).ids, 0)] for k, part in enumerate(np.split(ids, range(2048, len(ids), 2048)))}
    assert {(x[0], x[1]): x[3] for x in results[4]} == want
    run = corpus_pipeline.run(spark, str(tmp_path))
    assert {(x.doc_id, x.piece): x.length for x in run.collect()} == want


def test_stages_without_documents(spark, tmp_path):
    docs, items = corpus()
    kinds = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(docs, kinds).limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_decontamination_stage_weighs_words_by_all_passages(spark, tmp_path, monkeypatch):
    from kinstats.llm import lsa

    docs = [(k, " ".join(["often" if k % 3 else "seldom", *(f"x{j}" for j in range(k % 90))])) for k in range(3000)]
    spark.createDataFrame([(1, "often seldom never. Often seldom never.")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    seen, space = [], lsa.Space.__init__
    monkeypatch.setattr(lsa.Space, "__init__", lambda self, passages, parts, others, counts, n: seen.append((passages.vocabulary.ids, counts, n)) or space(self, passages, parts, others, counts, n))
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    assert corpus_pipeline.benchmark_decontamination(spark, frame, str(tmp_path)).count() == 3000
    (ids, counts, n), = seen
    assert n == 3000 and {w: counts[k] for w, k in ids.items()} == {b"often": 2000, b"seldom": 1000, b"never": 0}
