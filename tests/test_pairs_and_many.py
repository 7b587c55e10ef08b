"""Joins of pairs with people, stored pairs, packed frequencies and tiles, many phenotypes, counts that ride along, studies."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinstats.operators import (
    allele_freqs, allele_freqs_packed, binned_stats, binned_stats_many, crossprods, grm_for_pairs, grm_from_packed, he_regression, he_regression_many,
    intervals, join_pairs, join_stored, pack_genotypes, pair_products, products_many, residualise, residualise_many, resolve_pairs, store_pairs, summarise,
)
from kinstats.operators import packed
from kinstats.operators.many import merged, moments_of
from kinstats.operators.pairs import measured
from kinstats.plans import study
from kinstats.sources import read_grm, read_joined_pairs, write_genotypes, write_tsv
from kinstats.storage import saved
from kinstats.watch import Watch


def plan_of(df, capsys):
    df.explain()
    return capsys.readouterr().out


def hub(spark):
    """Someone in very many pairs, people without a value, one who is not listed."""
    people = spark.createDataFrame([(k, None if k % 7 == 3 else k / 10) for k in range(400)], "iid long, y double")
    pairs = spark.createDataFrame([(5, k) for k in range(300)] + [(k, 5) for k in range(300, 500)] + [(k, k + 1) for k in range(300)], "iid1 long, iid2 long")
    return people, pairs


def test_people_are_sent_or_shuffled_by_their_size(spark, capsys):
    people, pairs = hub(spark)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        sent = crossprods(pairs, people, ["y"])
        met = crossprods(pairs, people, ["y"], broadcast_bytes=0)
        dealt = crossprods(pairs, people, ["y"], broadcast_bytes=0, hot_pairs=20)
        one, two, three = (plan_of(x, capsys) for x in (sent, met, dealt))
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert one.count("BroadcastHashJoin") == 2 and "SortMergeJoin" not in one
    assert two.count("SortMergeJoin") == 2 and "_piece" not in two and three.count("_piece") > 2
    key = lambda x: tuple((v is None, v) for v in x)
    rows = [sorted(map(tuple, x.collect()), key=key) for x in (sent, met, dealt)]
    assert rows[0] == rows[1] == rows[2] and len(rows[0]) == 800
    value = lambda k: None if k % 7 == 3 or k >= 400 else k / 10
    assert {(a, b): v for a, b, v in rows[0]} == {(a, b): None if value(a) is None or value(b) is None else pytest.approx(value(a) * value(b)) for a, b in map(tuple, pairs.collect())}
    # Of the hub's pairs none of the tasks has more than some.
    from kinstats.operators.pairs import _dealt

    left = _dealt(pairs, people.select("iid", F.col("y").alias("_a0")), "iid1", "iid2", "left", 20)
    assert left.filter("iid1 = 5").count() == 301
    samples = people.select("iid", (1000 - F.col("iid")).alias("sample_idx"))
    places = [sorted(map(tuple, resolve_pairs(pairs, samples, "drop", **k).collect())) for k in ({}, {"broadcast_bytes": 0}, {"broadcast_bytes": 0, "hot_pairs": 9})]
    assert places[0] == places[1] == places[2] and len(places[0]) == 700
    assert measured(spark.createDataFrame([("abc", 1, [1.0, 2.0]), (None, 2, None)], "a string, b int, c array<double>")) == 2 * (8 + 16 + 16) + 3 + 16


def test_repeated_people_fail_or_follow_an_order(spark):
    people = spark.createDataFrame([("a", 2.0, 2), ("a", 5.0, 1), ("b", 3.0, 3), (None, 1.0, 4), (None, 1.0, 5)], "iid string, y double, o long")
    pairs = spark.createDataFrame([("a", "b", 7), (None, "b", 8)], "iid1 string, iid2 string, line long")
    for run in (lambda **k: crossprods(pairs, people, ["y"], **k), lambda **k: crossprods(pairs, people, ["y"], broadcast_bytes=0, **k)):
        with pytest.raises(Exception, match="list a twice"):
            run().collect()
        assert sorted(map(tuple, run(order="o", keep=("line",)).collect()), key=str) == [("a", "b", 7, 15.0), (None, "b", 8, None)]
    with pytest.raises(Exception, match="list a twice"):
        pair_products(pairs.withColumn("grm", F.lit(0.1)), people, "y").collect()
    assert pair_products(pairs.withColumn("grm", F.lit(0.1)).filter("line = 7"), people, "y", people_order="o").first().y_crossprod == 15.0


def test_stored_pairs_join_without_a_shuffle(spark, capsys):
    rng = random.Random(3)
    grm = spark.createDataFrame([(f"p{rng.randrange(60)}", f"p{rng.randrange(60)}", k / 900, k) for k in range(900)], "iid1 string, iid2 string, grm double, o long")
    values = grm.select(F.col("iid2").alias("iid1"), F.col("iid1").alias("iid2"), (F.col("o") * 1.0).alias("y"), (F.col("o") * 2.0).alias("z"), "o").filter("o % 3 > 0")
    left, one, two = (store_pairs(df, name, 4, "o") for df, name in ((grm, "kin_grm"), (values.drop("z"), "kin_y"), (values.drop("y"), "kin_z")))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        joined = [join_stored(left, one, ["y"]), join_stored(left, two, ["z"])]
        for df in joined:
            assert "Exchange" not in plan_of(df, capsys)
        assert "Exchange" in plan_of(join_pairs(grm, values, ["y"], "o"), capsys)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    want = {}
    for a, b, g, o in map(tuple, grm.collect()):
        want.setdefault((min(a, b), max(a, b)), [(o, g), None])[0] = min(want[min(a, b), max(a, b)][0], (o, g)) if (min(a, b), max(a, b)) in want else (o, g)
    first = {}
    for a, b, y, _, o in sorted(map(tuple, values.collect()), key=lambda x: x[4]):
        first.setdefault((min(a, b), max(a, b)), y)
    got = {(x.lo, x.hi): (x.grm, x.y) for x in joined[0].collect()}
    assert got == {k: (v[0][1], first.get(k)) for k, v in want.items()}
    for name in ("kin_grm", "kin_y", "kin_z"):
        spark.sql(f"drop table {name}")


def random_genotypes(rng, samples, variants, absent=0.2):
    a1 = rng.integers(0, 3, (samples, variants)).astype(float)
    a1[rng.random((samples, variants)) < 0.1] = np.nan
    there = rng.random((samples, variants)) >= absent
    rows = [(s, v, None if np.isnan(a1[s, v]) else int(a1[s, v])) for s in range(samples) for v in range(variants) if there[s, v]]
    return np.where(there, a1, np.nan), rows


@pytest.mark.parametrize("samples", [12, 13, 15])
def test_absent_rows_are_missing(spark, samples):
    a1, rows = random_genotypes(np.random.default_rng(samples), samples, 30)
    long = spark.createDataFrame(rows, "sample_id int, variant_id int, a1 int")
    codes = pack_genotypes(long.withColumnRenamed("sample_id", "sample_idx"), samples)
    found = {x.variant_id: (x.freq, x.n_obs) for x in allele_freqs_packed(codes, samples).collect()}
    want = {x.variant_id: (x.freq, x.n_obs) for x in allele_freqs(long).collect()}
    assert found == {k: (pytest.approx(f), n) for k, (f, n) in want.items()}
    listed = [(i, j) for i in range(samples) for j in range(i + 1)]
    p = np.nanmean(a1, 0) / 2
    w = (a1 - 2 * p) / np.sqrt(2 * p * (1 - p))
    pairs = spark.createDataFrame(listed, "idx1 int, idx2 int")
    for missing in ("exclude", "mean"):
        n = {(i, j): (~np.isnan(w[i] * w[j])).sum() if missing == "exclude" else a1.shape[1] for i, j in listed}
        want = {k: (n[k], pytest.approx(np.nansum(w[k[0]] * w[k[1]]) / n[k])) for k in listed}
        for most in (0, 1000):
            got = grm_from_packed(pairs, codes, samples=samples, missing=missing, max_pairs=most, samples_a_block=8)
            assert {(x.idx1, x.idx2): (x.n_snps, x.grm) for x in got.collect()} == want
        freqs = allele_freqs(long).withColumnRenamed("freq", "p")
        got = grm_for_pairs(pairs.select(F.col("idx1").alias("id1"), F.col("idx2").alias("id2")), long, freqs, missing)
        assert {(x.id1, x.id2): (x.n_snps, x.grm) for x in got.collect()} == want
    with pytest.raises(ValueError, match="exclude"):
        grm_from_packed(pairs, codes, samples=samples, missing="zero")
    with pytest.raises(ValueError, match="number of samples"):
        grm_from_packed(pairs, codes)
    for bad, says in ((rows[:1] * 2, "several genotypes"), ([(samples, 0, 1)], "no place"), ([(-1, 0, 1)], "no place")):
        with pytest.raises(Exception, match=says):
            pack_genotypes(spark.createDataFrame(bad, "sample_idx int, variant_id int, a1 int"), samples).collect()


def few_and_brute(spark, samples=60, variants=30):
    """Long genotypes, their packed rows, pairs of which some repeat either way round, and n_snps and relatedness by brute force."""
    rng = np.random.default_rng(8)
    a1, rows = random_genotypes(rng, samples, variants)
    long = spark.createDataFrame(rows, "sample_id int, variant_id int, a1 int")
    listed = [tuple(map(int, x)) for x in rng.integers(0, samples, (700, 2))] + [(3, 5), (5, 3), (3, 5), (7, 7)]
    p = np.nanmean(a1, 0) / 2
    w = (a1 - 2 * p) / np.sqrt(2 * p * (1 - p))
    want = {(i, j): (int((~np.isnan(w[i] * w[j])).sum()), pytest.approx(np.nanmean(w[i] * w[j]))) for i, j in listed}
    return long, pack_genotypes(long.withColumnRenamed("sample_id", "sample_idx"), samples), listed, want


def test_ranges_deal_pairs_in_few_pieces_of_bounded_sums(spark, monkeypatch):
    _, codes, listed, want = few_and_brute(spark)
    pairs = spark.createDataFrame(listed, "idx1 int, idx2 int")
    seen, real = [], packed.saved
    monkeypatch.setattr(packed, "saved", lambda df: (seen.append(out := real(df)), out)[1])
    got = grm_from_packed(pairs, codes, samples=60, max_pairs=0, samples_a_block=24).collect()
    assert sorted((x.idx1, x.idx2) for x in got) == sorted(listed) and {(x.idx1, x.idx2): (x.n_snps, x.grm) for x in got} == want
    pieces = [x for df in seen if "pieces" in df.columns for x in df.collect()]
    assert len(pieces) == 9 and all(x.pieces == 1 for x in pieces)  # not as many as there are pairs
    for tile_pairs, group_bytes in ((5, 64 << 20), (5, 50)):
        got = grm_from_packed(pairs, codes, samples=60, max_pairs=0, samples_a_block=24, tile_pairs=tile_pairs, group_bytes=group_bytes).collect()
        assert sorted((x.idx1, x.idx2) for x in got) == sorted(listed) and {(x.idx1, x.idx2): (x.n_snps, x.grm) for x in got} == want
    # However wide a range is, sums are held tile by tile.
    rng, shapes = np.random.default_rng(2), []
    monkeypatch.setattr(packed, "TILE_WIDTH", 8)
    monkeypatch.setattr(packed, "Tile", type("Seen", (packed.Tile,), {"sums": lambda self, old=packed.Tile.sums: (shapes.append(self.total.shape), old(self))[1]}))
    rows, p, places = rng.integers(0, 256, (12, 20), np.uint8), rng.uniform(0.2, 0.8, 12), rng.integers(0, 80, (6000, 2))
    n, s = packed.tiled_sums(rows, p, places, True)
    assert len(shapes) >= 100 and max(np.prod(x) for x in shapes) <= 64
    whole = packed.Tile(places, True)
    packed.weigh(rows, p, np.arange(80), [whole])
    assert (whole.sums()[0] == n).all() and whole.sums()[1] == pytest.approx(s)


def test_lists_of_pairs_hold_each_as_often_as_it_is_listed(spark):
    rng = np.random.default_rng(1)
    listed = [tuple(map(int, x)) for x in rng.integers(0, 50, (2000, 2))] + [(70_000, 3), (3, 70_000), (1 << 30, 1 << 30)]
    pairs = spark.createDataFrame(listed, "idx1 int, idx2 int")
    found = []
    for x in packed.in_lists(pairs, 16).collect():
        keys = packed.from_list(x.n, x.kind, bytes(x.steps))
        found += [(k // 16 + 16 * x.block1, k % 16 + 16 * x.block2) for k in keys.tolist()]
    assert sorted(found) == sorted(listed)
    once = [(x.idx1, x.idx2) for x in packed.pairs_once(pairs, 16).collect()]
    assert sorted(once) == sorted({(min(x), max(x)) for x in listed})
    for bad in ((None, 1), (-1, 2)):
        with pytest.raises(Exception, match="null or below zero"):
            packed.pairs_once(spark.createDataFrame([bad], "idx1 int, idx2 int")).collect()


def test_few_genotypes_go_to_the_pairs(spark):
    _, codes, listed, want = few_and_brute(spark)
    pairs = spark.createDataFrame([(i, j, f"line {k}") for k, (i, j) in enumerate(listed)] + [(1, 60_000, "beyond")], "idx1 int, idx2 int, line string")
    got = grm_from_packed(pairs, codes, samples=60, max_pairs=0, keep=("line",))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan
    rows = {x.line: x for x in got.collect()}
    assert len(rows) == len(listed) + 1 and (rows["beyond"].n_snps, rows["beyond"].grm) == (0, None)
    assert all((x.n_snps, x.grm) == want[x.idx1, x.idx2] and listed[int(k[5:])] == (x.idx1, x.idx2) for k, x in rows.items() if k != "beyond")
    # By ranges, other columns stay too.
    again = grm_from_packed(pairs.filter("line <> 'beyond'"), codes, samples=60, max_pairs=0, samples_a_block=8, keep=("line",)).collect()
    assert len(again) == len(listed) and all((x.n_snps, x.grm) == want[x.idx1, x.idx2] and listed[int(x.line[5:])] == (x.idx1, x.idx2) for x in again)


def test_few_long_genotypes_make_no_row_for_each_pair_and_variant(spark):
    long, _, listed, want = few_and_brute(spark)
    names = long.withColumns({"sample_id": F.concat(F.lit("s"), "sample_id"), "variant_id": F.concat(F.lit("v"), "variant_id")})
    freqs = allele_freqs(names).withColumnRenamed("freq", "p")
    pairs = spark.createDataFrame([(f"s{i}", f"s{j}") for i, j in listed] + [("s1", "nobody"), (None, "s2")], "id1 string, id2 string")
    got = grm_for_pairs(pairs, names, freqs)
    assert "variant_id" not in got._jdf.queryExecution().executedPlan().toString()
    found = got.collect()
    assert len(found) == len(listed) + 2 and [(x.n_snps, x.grm) for x in found if x.id1 is None or x.id2 == "nobody"] == [(0, None)] * 2
    assert {(int(x.id1[1:]), int(x.id2[1:])): (x.n_snps, x.grm) for x in found if x.id1 and x.id2 != "nobody"} == want
    # Dosages, and several genotypes of a sample, meet by joins as before.
    one = spark.createDataFrame([("a", 1, 0.5), ("b", 1, 1.5), ("b", 1, 1.5)], "sample_id string, variant_id int, a1 double")
    got = grm_for_pairs(spark.createDataFrame([("a", "b")], "id1 string, id2 string"), one, spark.createDataFrame([(1, 0.5)], "variant_id int, p double")).collect()
    assert [(x.n_snps, round(x.grm, 9)) for x in got] == [(2, -0.5)]


def test_pairs_known_to_come_once_are_not_shuffled(spark):
    grm = spark.createDataFrame([(1, 2, 0.1), (2, 3, 0.2)], "iid1 long, iid2 long, grm double")
    people = spark.createDataFrame([(1, 2.0), (2, 3.0), (3, 5.0)], "iid long, y double")
    got = pair_products(grm, people, "y", once=True)
    assert {(x.iid1, x.iid2): (x.grm, x.y_crossprod) for x in got.collect()} == {(1, 2): (0.1, 6.0), (2, 3): (0.2, 15.0)}
    assert "least" not in got._jdf.queryExecution().executedPlan().toString().lower()


def test_people_in_no_pair_do_not_make_pairs_move(spark):
    pairs = spark.createDataFrame([(1, 2), (2, 3), (3, 9_999_999), (None, 1)], "iid1 long, iid2 long")
    people = spark.range(5000).select(F.col("id").alias("iid"), (F.col("id") * 2.0).alias("y"))
    got = crossprods(pairs, people, ["y"], broadcast_bytes=200)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("BroadcastHashJoin") == 2 and "SortMergeJoin" not in plan
    assert sorted(map(tuple, got.collect()), key=str) == sorted([(1, 2, 8.0), (2, 3, 24.0), (3, 9_999_999, None), (None, 1, None)], key=str)


def test_dense_and_sparse_tiles_give_the_same_sums():
    rng = np.random.default_rng(4)
    codes, p, samples = rng.integers(0, 256, (150, 20), np.uint8), rng.uniform(0.2, 0.8, 150), np.arange(78)
    listed = np.array([(i, j) for i in range(40) for j in range(78) if rng.random() < 0.3], np.int32)
    sums = []
    for dense in (0, 1000):
        old, packed.DENSE = packed.DENSE, dense
        try:
            tiles = [packed.Tile(x, True) for x in packed.in_tiles(listed, 32)]
        finally:
            packed.DENSE = old
        assert {t.dense for t in tiles} == {bool(dense)}
        packed.weigh(codes, p, samples, tiles)
        sums.append({tuple(pair): (n, s) for t in tiles for pair, n, s in zip(t.listed.tolist(), *t.sums(), strict=True)})
    assert sums[0].keys() == sums[1].keys() == set(map(tuple, listed.tolist()))
    assert all(sums[0][k][0] == sums[1][k][0] and sums[0][k][1] == pytest.approx(sums[1][k][1]) for k in sums[0])
    a1 = packed.decode(codes, samples).astype(float)
    w = np.where(a1 < 0, 0, (a1 - 2 * p[:, None]) / np.sqrt(2 * p * (1 - p))[:, None])
    assert all(sums[0][i, j] == ((( a1[:, i] >= 0) & (a1[:, j] >= 0)).sum(), pytest.approx(w[:, i] @ w[:, j])) for i, j in sums[0])
    # Wide ranges for few pairs, narrow ones for many; all of it follows from the counts.
    assert packed.block_width(10**6, 500_000, 64 << 20) > packed.block_width(10**9, 500_000, 64 << 20) > packed.block_width(10**11, 500_000, 64 << 20)
    assert packed.block_width(0, 1, 64 << 20) == 4 and packed.block_width(10**12, 10_000, 64 << 20) == 256


def test_moments_merge_without_loss():
    rng = np.random.default_rng(5)
    keys, x, y = rng.integers(0, 4, 500), rng.normal(1e6, 1, 500), rng.normal(size=(500, 3)) + 1e5
    y[rng.random(y.shape) < 0.3] = np.nan
    held = {}
    for at in range(0, 500, 90):
        k, m = moments_of(keys[at : at + 90], x[at : at + 90], y[at : at + 90])
        for i, key in enumerate(k.tolist()):
            held[key] = merged(held[key], m[:, i]) if key in held else m[:, i]
    for key, m in held.items():
        for j in range(3):
            use = (keys == key) & ~np.isnan(y[:, j])
            a, b = x[use], y[use, j]
            assert m[:, j] == pytest.approx([use.sum(), a.mean(), b.mean(), ((a - a.mean()) ** 2).sum(), ((b - b.mean()) ** 2).sum(), ((a - a.mean()) * (b - b.mean())).sum()], rel=1e-7)


def test_many_phenotypes_equal_one_by_one(spark, capsys):
    rng = np.random.default_rng(6)
    names = [f"t.{k}" for k in range(5)]
    rows = []
    for i in range(160):
        y = [float(v) if rng.random() > 0.15 else None for v in rng.normal(size=5)]
        y[0] = 400.0 if i == 3 else y[0]
        rows.append((f"p{i}", float(i % 3), float(rng.normal(50, 9)) if i % 11 else None, i % 13 > 0, *y))
    people = spark.createDataFrame(rows, "iid string, sex double, age double, row_complete boolean, " + ", ".join(f"`{x}` double" for x in names))
    for covariates, group, scope in ((["sex", "age"], None, "all"), (["age"], "sex", "selected"), ([], None, "all")):
        got = {x.iid: x["values"] for x in residualise_many(people, names, covariates, group, scope).collect()}
        for k, name in enumerate(names):
            one = dict(map(tuple, residualise(people, name, covariates, group, scope).collect()))
            assert {i: v[k] for i, v in got.items() if v[k] is not None} == {i: pytest.approx(v, abs=1e-9) for i, v in one.items()}, (name, covariates)
    with pytest.raises(ValueError, match="too few"):
        residualise_many(people.limit(3), names, ["sex", "age"])
    with pytest.raises(ValueError, match="depend"):
        residualise_many(people.withColumn("twice", F.col("age") * 2), names, ["age", "twice"])
    adjusted = residualise_many(people, names, ["sex", "age"], keep=("age",))
    assert adjusted.columns == ["iid", "age", "values"]
    pairs = spark.createDataFrame([(f"p{i}", f"p{j}", float(rng.uniform(-0.1, 0.4))) for i in range(165) for j in range(i) if rng.random() < 0.1], "iid1 string, iid2 string, grm double")
    products = saved(products_many(pairs, adjusted))
    assert products.count() == pairs.count()
    cuts = intervals(spark, [(-0.05, 0.1), (0.05, 0.3), (0.39999, 0.4), (5, 6)])
    many = he_regression_many(products, cuts, names)
    plan = plan_of(many, capsys)
    assert plan.count("MapInArrow") == plan.count("FileScan") == 1
    found = {(x.phenotype, x.interval): x for x in many.collect()}
    bins = {(x.phenotype, x.bin): x for x in binned_stats_many(products, names, width=0.05, low=-0.05, high=0.3).collect()}
    wide = {x.bin: x for x in binned_stats_many(products, names, width=0.05, low=-0.05, high=0.3, wide=True).collect()}
    near = lambda v: None if v is None else pytest.approx(v, rel=1e-6, abs=1e-9)
    for k, name in enumerate(names):
        single = products.select("iid1", "iid2", "grm", F.col("values")[k].alias("y"))
        for x in he_regression(single, cuts).collect():
            y = found[name, x.interval]
            assert all(y[c] == near(x[c]) for c in ("n_pairs", "intercept", "slope", "r_squared", "mse", "intercept_se", "slope_se")), (name, x)
        one = binned_stats(single, ["y"], width=0.05, low=-0.05, high=0.3).collect()
        assert len(one) == len(wide)
        for x in one:
            y, z = bins[name, x.bin], wide[x.bin]
            assert (y.grm_bin, y.grm_mean, y.grm_n, y["mean"], y.n, y.se) == tuple(map(near, (x.grm_bin, x.grm_mean, x.grm_n, x.y_mean, x.y_n, x.y_se)))
            assert (z.grm_n, z[f"{name}_mean"], z[f"{name}_n"], z[f"{name}_se"]) == tuple(map(near, (x.grm_n, x.y_mean, x.y_n, x.y_se)))


def test_midpoints_below_zero(spark):
    frame = spark.createDataFrame([(a, 5, 1.0, 0.5, 1.5, 0.2) for a in ("-0.500--0.050", "-0.100-0.300", "0.100-0.300")], "interval string, n_pairs long, slope double, slope_ci_lower double, slope_ci_upper double, r_squared double")
    assert sorted(x.midpoint for x in summarise(frame).collect()) == pytest.approx([-0.275, 0.1, 0.2])
    exact = summarise(frame.withColumns({"lo": F.lit(0.12345), "hi": F.lit(0.12347)})).first().midpoint
    assert exact == pytest.approx(0.12346)


def test_counts_ride_along(spark, tmp_path):
    (tmp_path / "g").write_text("IID1 IID2 N GRM\na b 1 0.5\nc d\ne f 1 NA\n")
    (tmp_path / "j").write_text("iid1 iid2 grm y_product\na b 0.1 -\nc d 0.2 2\ne f . 3\n")
    watch = Watch()
    grm, joined = read_grm(spark, str(tmp_path / "g"), watch), read_joined_pairs(spark, str(tmp_path / "j"), watch=watch)
    people = spark.createDataFrame([("a", 1.0), ("b", 2.0)], "iid string, y double")
    assert crossprods(grm, people, ["y"], watch=watch).count() == 2 and joined.count() == 3
    assert watch.values() == {"read_grm": {"n_lines": 3, "n_short": 1}, "read_grm_values": {"n_missing": 1}, "read_joined_pairs": {"n_lines": 3, "n_excluded": 2}, "crossprods": {"n_pairs": 2, "n_with_value": 1, "n_without_value": 1}}
    assert watch.frame(spark).count() == 8
    with pytest.raises(ValueError, match="watched already"):
        read_grm(spark, str(tmp_path / "g"), watch)


def text_of(folder):
    parts = [p.read_text().splitlines() for p in sorted(folder.glob("part-*"))]
    return [x for p in parts for x in p[1:]]


@pytest.mark.parametrize("traits", [1, 2])
def test_a_study_from_files_keeps_the_order_of_lines(spark, tmp_path, traits):
    rng = np.random.default_rng(7)
    n, v = 60, 40
    a1, rows = random_genotypes(rng, n, v, 0)
    codes = pack_genotypes(spark.createDataFrame(rows, "sample_idx int, variant_id int, a1 int"), n).withColumnRenamed("variant_id", "variant_idx")
    write_genotypes(codes, str(tmp_path / "x.bed"))
    (tmp_path / "x.fam").write_text("".join(f"f s{k} 0 0 0 -9\n" for k in range(n)))
    listed = [tuple(rng.choice(n, 2, replace=False).tolist()) for _ in range(400)]
    listed += [(b, a) for a, b in listed[:30]]
    (tmp_path / "pairs").write_text("IID1 IID2\n" + "".join(f"s{a} s{b}\n" for a, b in listed))
    order = rng.permutation(n).tolist()
    y = rng.normal(size=(n, 2))
    (tmp_path / "y").write_text("IID\tone\ttwo\n" if traits == 2 else "IID\tone\n")
    with (tmp_path / "y").open("a") as file:
        file.writelines(f"s{k}\t" + "\t".join(map(repr, y[k, :traits].tolist())) + "\n" for k in range(n) if k != 9)
    age = rng.normal(50, 5, n).tolist()
    (tmp_path / "c").write_text("IID sex age pc\n" + "".join(f"s{k} {k % 2} {age[k]!r} 1\n" for k in order))
    watch = Watch()
    out = study(spark, str(tmp_path / "out"), str(tmp_path / "pairs"), str(tmp_path / "y"), str(tmp_path / "c"), intervals(spark, [(-1, 0.1), (0, 1)]), prefix=str(tmp_path / "x"), positions="1,2", width=0.1, low=-1, high=1, replicates=20, watch=watch)
    assert out["results"].count() == 2 * traits and watch.values()["read_pairs"] == {"n_lines": 430, "n_short": 0}
    # Relatedness by numpy, from the genotypes' own frequencies.
    p = np.nanmean(a1, 0) / 2
    w = (a1 - 2 * p) / np.sqrt(2 * p * (1 - p))
    lines = [x.split("\t") for x in text_of(tmp_path / "out" / "relatedness.tsv")]
    assert [tuple(x[:2]) for x in lines] == [(f"s{a}", f"s{b}") for a, b in listed]
    assert [float(x[3]) for x in lines] == pytest.approx([np.nanmean(w[a] * w[b]) for a, b in listed])
    # Residuals of the complete people in the order of the covariates' file, standardised within either sex.
    x = np.column_stack((np.ones(n), np.arange(n) % 2, np.array(age)))
    use = [k for k in range(n) if k != 9]
    z = np.full((n, traits), math.nan)
    for t in range(traits):
        r = y[use, t] - x[use] @ np.linalg.lstsq(x[use], y[use, t], rcond=None)[0]
        for s in (0, 1):
            own = [i for i, k in enumerate(use) if k % 2 == s]
            z[[use[i] for i in own], t] = (r[own] - r[own].mean()) / r[own].std(ddof=1)
    lines = [q.split("\t") for q in text_of(tmp_path / "out" / "residuals.tsv")]
    assert [q[0] for q in lines] == [f"s{k}" for k in order if traits == 2 or k != 9]
    assert [float(q[1]) for q in lines if q[1] != "NA"] == pytest.approx([z[k, 0] for k in order if k != 9], abs=1e-6)
    lines = [q.split("\t") for q in text_of(tmp_path / "out" / "products.tsv")]
    assert [tuple(q[:2]) for q in lines] == [(f"s{a}", f"s{b}") for a, b in listed]
    for t in range(traits):
        assert [math.nan if q[2 + t] == "NA" else float(q[2 + t]) for q in lines] == pytest.approx([z[a, t] * z[b, t] for a, b in listed], nan_ok=True)
    once = {frozenset(x): x for x in reversed(listed)}.values()
    g = {x: np.nanmean(w[x[0]] * w[x[1]]) for x in once}
    own = [x for x in once if 0 <= g[x] < 1 and 9 not in x]
    slope = np.polyfit([g[x] for x in own], [z[x[0], 0] * z[x[1], 0] for x in own], 1)[0]
    found = out["results"].filter("interval = '0.000-1.000'").orderBy("interval", *(["phenotype"] if traits == 2 else [])).first()
    assert (found.n_pairs, found.slope) == (len(own), pytest.approx(slope))
    assert sum(int(q.split("\t")[2]) for q in text_of(tmp_path / "out" / "bins.tsv")) == traits * len(g)
    assert ("summary" in out) == (traits == 1)


def test_written_columns_and_order(spark, tmp_path):
    frame = spark.createDataFrame([(k, f"x{k}", k / 3) for k in range(200)], "o long, a string, b double").repartition(7)
    write_tsv(frame, str(tmp_path / "o"), ["o"], 2, {"b": "B.x", "a": "A"})
    assert text_of(tmp_path / "o") == [f"{k / 3:.2f}\tx{k}" for k in range(200)]
    assert next(iter(sorted((tmp_path / "o").glob("part-*")))).read_text().startswith("B.x\tA\n")
