"""Exact copies: groups, hot texts dealt in pieces, odd cases."""

import hashlib
import random
import re

from pyspark.sql import functions as F

from kinstats.llm.contentsort import marked, without_copies


def by_force(rows):
    groups = {}
    for i, text in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0d]+", " ", text or ""), []).append(i)
    return {t: (min((i for i in ids if i is not None), default=None), len(ids), hashlib.sha256(t.encode()).hexdigest()) for t, ids in groups.items()}


def held(spark, rows):
    frame = spark.createDataFrame([(*x, 0, "q") for x in rows], "doc_id long, text string, kept int, h string")
    want, got = by_force(rows), marked(frame).collect()
    assert len(got) == len(rows)
    stays = {}
    for x in got:
        t = re.sub(r"[\x20\x09-\x0d]+", " ", x.text or "")
        assert (x.keep_id, x.group_size, x.text_sha256) == want[t], (x.doc_id, t[:40])
        assert x.h == "q" and (not x.kept or x.doc_id == x.keep_id)
        stays[t] = stays.get(t, 0) + x.kept
    assert set(stays.values()) <= {1}
    return frame


def test_groups_and_odd_texts(spark):
    rng = random.Random(4)
    same_head = "x" * 70
    rows = [(1, None), (2, ""), (3, " "), (4, "\n\t"), (5, "a  b"), (6, "a\nb"), (7, "a b "), (8, "a b"), (8, "a b"), (None, "a b"), (None, "only"), (None, "only"), (9, "é  \x0b q"), (10, "é  q"), (11, "w " * 40_000), (12, "w\n" * 40_000)]
    rows += [(k, same_head + rng.choice("ab") + rng.choice(["", " "])) for k in range(20, 60)]
    rng.shuffle(rows)
    frame = held(spark, rows)
    kept = without_copies(frame)
    assert kept.columns == frame.columns and kept.count() == len(by_force(rows))
    assert marked(frame.limit(0)).count() == 0 and without_copies(frame.limit(0)).count() == 0


def test_a_text_of_a_third_of_the_rows_is_dealt_in_pieces(spark):
    rng = random.Random(5)
    rows = [(k, rng.choice(["hot  text", "hot\ttext"]) if k % 3 == 0 else f"text {rng.randrange(900)}") for k in range(3000)]
    rows += [(7, "other hot")] * 600
    rng.shuffle(rows)
    held(spark, rows)


def test_hot_rows_do_not_meet_in_one_task(spark):
    frame = spark.createDataFrame([(k, "hot") for k in range(4000)] + [(k, f"t{k}") for k in range(4000, 8000)], "doc_id long, text string").repartition(4)
    from kinstats.llm.contentsort import _with_pieces

    dealt = _with_pieces(frame.withColumn("h", F.xxhash64("text")))
    sizes = [x["count"] for x in dealt.filter("piece >= 0").groupBy("piece").count().collect()]
    assert sum(sizes) == 4000 and max(sizes) < 800


def test_texts_are_shuffled_once(spark, capsys):
    """The window takes the ranges and their order as they are: no exchange lies between it and the splitters."""
    from kinstats.llm.contentsort import _with_pieces, grouped

    rows = spark.createDataFrame([(k, f"t{k % 90}", "t") for k in range(300)], "doc_id long, norm string, head string").withColumn("h", F.xxhash64("norm")).withColumn("_own", F.struct("doc_id"))
    grouped(_with_pieces(rows)).explain()
    plan = capsys.readouterr().out
    assert "rangepartitioning" in plan and "hashpartitioning" not in plan.split("rangepartitioning")[0] and plan.count("Sort [") == 1
