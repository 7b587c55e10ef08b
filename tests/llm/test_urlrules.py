"""URL rules where tokens are many: classes of tokens, rules inside rules, very long urls."""

import collections
import random
import time
from itertools import combinations

from pyspark.sql import functions as F

from kinstats.llm import urlrules

RULES = {"org/": "allow", "com/": "block"}


def by_force(labels, tokens, least, confidence=0.9):
    count, sure = collections.Counter(), collections.Counter()
    for u, verdict in labels.items():
        for k in range(1, len(tokens[u]) + 1):
            for some in combinations(sorted(tokens[u]), k):
                count[some] += 1
                sure[some, verdict] += 1
    found = {(s, v): (n / count[s], n) for (s, v), n in sure.items() if n >= least and n / count[s] >= confidence}
    return {(s, v): x for (s, v), x in found.items() if not any(w == v and set(r) < set(s) and y[0] >= x[0] for (r, w), y in found.items())}


def test_rules_over_classes_equal_those_by_force(spark):
    rng = random.Random(3)
    fields = "abcdefg"
    make = lambda top: f"http://{rng.choice('pq')}.{top}/{rng.choice(['x', 'y/z', '1'])}?" + "&".join(f"{f}={rng.randrange(9)}" for f in fields if (f in "ab") == (rng.random() < 0.5) or f == "g")
    urls = [make(rng.choice(["org", "com", "com", "net"])) for _ in range(260)]
    # Two tokens that always come together where a verdict is known, and apart where it is not.
    urls += [f"http://h{k % 3}.com/t/u?twin=1&other={k}" for k in range(12)] + [f"http://n.net/{t}?{f}=1" for t in "tu" for f in ("twin", "other", "none")]
    frame = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    tokens = {x.url: frozenset(x.t) for x in frame.select("url", urlrules.tokens(F.col("url")).alias("t")).distinct().collect()}
    labels = {u: {"org": "allow", "com": "block"}[u.split("/")[2].split(".")[-1]] for u in urls if u.split("/")[2].split(".")[-1] in ("org", "com")}
    for least in (1, 5, 11):
        found = by_force(labels, tokens, max(least, 0.02 * len(labels)))
        got = {x.page_id: x for x in urlrules.judge(frame, RULES, support=0.02, least_count=least).collect()}
        for i, u in enumerate(urls):
            if u not in labels:
                own = [(*x, len(s), v) for (s, v), x in found.items() if set(s) <= tokens[u]]
                assert got[i].verdict == (max(own)[3] if own else "allow") and got[i].mined_confidence == (max(own)[0] if own else None), (least, u)
    assert any(x.mined_confidence for x in got.values())


def test_many_fields_end_soon(spark):
    rng = random.Random(4)
    together = [f"http://s{k % 9}.{rng.choice(['org', 'com', 'net'])}/p/{k}?" + "&".join(f"f{j}={rng.randrange(99)}" for j in range(16)) for k in range(200)]
    some = [f"http://s{k % 9}.{rng.choice(['org', 'com', 'net'])}/p/{k}?" + "&".join(f"f{j}=1" for j in range(12) if rng.random() < 0.4) for k in range(20_000)]
    long = ["http://x.net/" + "/".join(f"s{chr(97 + k % 26)}{'y' * (k % 40)}" for k in range(5_000)), "http://x.com/" + "/".join("abc" * 2_000)]
    for urls in (together, some, together + long):
        frame = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
        began = time.time()
        assert urlrules.judge(frame, RULES).count() == len(urls)
        assert time.time() - began < 90


def test_no_labels_and_empty_tables(spark):
    frame = spark.createDataFrame([(1, "http://a.net/x"), (2, None)], "page_id long, url string")
    assert sorted((x.page_id, x.verdict) for x in urlrules.judge(frame, RULES).collect()) == [(1, "allow"), (2, "allow")]
    assert urlrules.judge(frame.limit(0), RULES).count() == 0


def test_few_urls_are_enough_for_a_rule(spark, tmp_path):
    import duckdb

    from kinstats.llm.q_urlrules import SQL, op9_url_filters

    urls = [f"http://a.com/de/shop/{k}" for k in range(2)] + ["http://b.com/fr/news/1", "http://c.org/news/2", "http://d.net/shop", "http://d.net/news", "http://d.net/else"]
    spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").write.parquet(str(tmp_path / "pages.parquet"))
    got = {tuple(x) for x in op9_url_filters(spark, str(tmp_path)).collect()}
    with duckdb.connect() as db:
        db.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
        assert got == set(db.execute(SQL).fetchall())
    assert {x[0]: x[4:] for x in got if x[0] > 3} == {4: ("block", 1.0), 5: ("allow", 1.0), 6: ("allow", None)}


def test_rules_follow_from_all_urls(spark):
    of = lambda verdict, top, n: spark.range(n).select(F.concat(F.lit(f"http://h.{top}/t/"), "id").alias("url"), F.lit(verdict).alias("verdict"))
    rules, _ = urlrules.mine(of("allow", "org", 24_001).union(of("block", "com", 1_001)))
    found = {(x.verdict, *x["items"]): (x.confidence, x.support) for x in rules.collect()}
    assert found["allow", "host=h"] == (24_001 / 25_002, 24_001) and found["allow", "host=org"] == (1.0, 24_001) and found["block", "host=com"] == (1.0, 1_001)
