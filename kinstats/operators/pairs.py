"""Pairs of individuals: identifiers, orientation, joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import saved
from ..watch import Watch, count_if, watched


def col(name: str) -> Column:
    return F.col(f"`{name}`")


def first_of_each(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Of rows with equal keys the first in ``order``; minima are taken before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*map(col, keys)).agg(F.min_by(F.struct(*map(col, rest)), col(order)).alias("_first"))
    return best.select(*map(col, keys), *(F.col(f"_first.`{c}`").alias(c) for c in rest)).select(*map(col, df.columns))


def last_of_each(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """For each key and each other column, its last value in ``order`` that is not null."""
    rest = [c for c in df.columns if c not in (*keys, order)]
    return df.groupBy(*map(col, keys)).agg(*(F.max_by(col(c), F.when(col(c).isNotNull(), col(order))).alias(c) for c in rest), F.max(col(order)).alias(order))


def canonical(df: DataFrame, a: str, b: str) -> DataFrame:
    """The smaller of the two in ``a``."""
    return df.withColumns({a: F.least(col(a), col(b)), b: F.greatest(col(a), col(b))})


def needed_samples(pairs: DataFrame, a: str = "iid1", b: str = "iid2") -> DataFrame:
    """iid of everyone in a pair."""
    return pairs.select(F.explode(F.array(col(a), col(b))).alias("iid")).distinct()


def unknown_ids(pairs: DataFrame, samples: DataFrame) -> DataFrame:
    """iid in pairs that no sample has."""
    return needed_samples(pairs).join(samples.select("iid"), "iid", "left_anti")


#: Tables of people up to so many bytes, measured, go whole to all tasks; larger ones are shuffled.
BROADCAST_BYTES = 64 << 20
#: A person in more pairs than this has them dealt to several tasks where people are shuffled.
HOT_PAIRS = 1_000_000


def measured(df: DataFrame) -> int:
    """Bytes of ``df``'s values: eight for a number, the length and sixteen more for text and for arrays of numbers."""
    wide = [(c, F.octet_length(col(c)) if t in ("string", "binary") else 8 * F.size(col(c))) for c, t in df.dtypes if t in ("string", "binary") or t.startswith("array")]
    found = df.agg(F.count("*").alias("n"), *(F.sum(n).alias(f"s{k}") for k, (_, n) in enumerate(wide))).first()
    return found["n"] * (8 * (len(df.columns) - len(wide)) + 16 * len(wide)) + sum(found[f"s{k}"] or 0 for k in range(len(wide)))


def one_of_each(people: DataFrame, columns: list[str], order: str | None) -> DataFrame:
    """iid and ``columns``: of a person that is listed several times the first in ``order``; without it such a person fails the job."""
    people = people.filter("iid is not null")
    if order:
        return first_of_each(people.select("iid", *map(col, dict.fromkeys([*columns, order]))), ["iid"], order).select("iid", *map(col, columns))
    values = F.struct(*map(col, columns))
    once = F.when(F.count("*") == 1, F.any_value(values)).otherwise(F.raise_error(F.concat_ws(" ", F.lit("people list"), F.col("iid"), F.lit("twice; give an order"))))
    return people.groupBy("iid").agg(once.alias("_once")).select("iid", *(F.col(f"_once.`{c}`").alias(c) for c in columns))


def _dealt(pairs: DataFrame, people: DataFrame, key: str, other: str, how: str, hot_pairs: int) -> DataFrame:
    """``pairs`` with the columns of the person in ``key``; one in very many pairs is there several times, for a part of the pairs each."""
    hot = pairs.groupBy(F.col(key).alias("_iid")).agg(F.count("*").alias("_n")).filter(F.col("_n") > hot_pairs).select("_iid", F.ceil(F.col("_n") / hot_pairs).cast("int").alias("_pieces"))
    if not hot.limit(1).collect():
        return pairs.join(people.withColumnRenamed("iid", key), key, how)
    hot = saved(hot)
    left = pairs.join(hot, F.col(key) == F.col("_iid"), "left").withColumn("_piece", F.coalesce(F.pmod(F.xxhash64(other), F.col("_pieces")), F.lit(0)).cast("int")).drop("_iid", "_pieces")
    right = people.join(hot, F.col("iid") == F.col("_iid"), "left").withColumn("_piece", F.explode(F.sequence(F.lit(0), F.coalesce("_pieces", F.lit(1)) - 1))).drop("_iid", "_pieces").withColumnRenamed("iid", key)
    return left.join(right, [key, "_piece"], how).drop("_piece")


def with_people(pairs: DataFrame, people: DataFrame, columns: list[str], order: str | None = None, how: str = "left", broadcast_bytes: int = BROADCAST_BYTES, hot_pairs: int = HOT_PAIRS) -> DataFrame:
    """``pairs`` (iid1, iid2 and others) with ``_a0``, ``_a1`` and so on, the ``columns`` of the first person, and ``_b0`` and so on of the second.

    The table of people, if need be without those in no pair, is measured: up to ``broadcast_bytes`` no pair is shuffled for it, beyond they meet by id, and the pairs
    of somebody in more than ``hot_pairs`` of them are dealt to several tasks.
    """
    side = one_of_each(people, columns, order)
    few = measured(side) <= broadcast_bytes
    if not few and broadcast_bytes:
        # Tasks name each person of theirs once, which is little beside the pairs; those in some pair may be few enough.
        side = saved(side.join(needed_samples(pairs), "iid", "left_semi"))
        few = measured(side) <= broadcast_bytes
    for key, other, letter in (("iid1", "iid2", "_a"), ("iid2", "iid1", "_b")):
        own = side.select("iid", *(col(c).alias(f"{letter}{k}") for k, c in enumerate(columns)))
        pairs = pairs.join(F.broadcast(own.withColumnRenamed("iid", key)), key, how) if few else _dealt(pairs, own, key, other, how, hot_pairs)
    return pairs


def resolve_pairs(pairs: DataFrame, samples: DataFrame, on_unknown: str = "error", **limits: int) -> DataFrame:
    """``pairs`` with idx1 <= idx2, the samples' places. Unknown people raise an error, with ``fail`` when the result is computed, or with ``drop`` lose their pairs; ``limits`` as for ``with_people``."""
    if on_unknown == "error":
        some = unknown_ids(pairs, samples).limit(5).collect()
        if some:
            raise ValueError(f"pairs name people that are no samples, such as {', '.join(str(x[0]) for x in some)}")
    found = with_people(pairs, samples, ["sample_idx"], how="left" if on_unknown == "fail" else "inner", **limits).withColumnsRenamed({"_a0": "idx1", "_b0": "idx2"})
    if on_unknown == "fail":
        known = lambda idx, iid: F.coalesce(col(idx), F.raise_error(F.concat(F.lit("pairs name people that are no samples, such as "), F.coalesce(col(iid).cast("string"), F.lit("null")))).cast("int")).alias(idx)
        found = found.select(*map(col, pairs.columns), known("idx1", "iid1"), known("idx2", "iid2"))
    return canonical(found, "idx1", "idx2").select(*map(col, pairs.columns), "idx1", "idx2")


def crossprods(pairs: DataFrame, phenotypes: DataFrame, names: list[str], order: str | None = None, keep: tuple[str, ...] = (), watch: Watch | None = None, **limits: int) -> DataFrame:
    """iid1, iid2, the columns ``keep`` of ``pairs`` and ``<name>_crossprod`` for each phenotype; null where either person has no value. All pairs stay.

    Of a person that ``phenotypes`` lists several times the first in ``order`` counts; without it such a person fails the job.
    """
    joined = with_people(pairs.select("iid1", "iid2", *map(col, keep)), phenotypes, names, order, **limits)
    out = joined.select("iid1", "iid2", *map(col, keep), *((F.col(f"_a{k}") * F.col(f"_b{k}")).alias(f"{x}_crossprod") for k, x in enumerate(names)))
    return watched(watch, out, "crossprods", **value_counts([f"{x}_crossprod" for x in names]))


def value_counts(values: list[str]) -> dict[str, Column]:
    """Pairs, those with some of ``values`` and those with none, as aggregates."""
    some = F.lit(False)
    for v in values:
        some = some | col(v).isNotNull()
    return {"n_pairs": F.count("*"), "n_with_value": count_if(some), "n_without_value": count_if(~some)}


def join_pairs(grm: DataFrame, products: DataFrame, values: list[str], order: str | None = None) -> DataFrame:
    """``grm`` (iid1, iid2, grm) with ``values`` of the same two people in ``products``, in whichever order either side names them.

    Pairs without products keep nulls. With ``order``, of repeated pairs the first in ``grm`` and the last values in
    ``products`` count; without it all rows of ``grm`` stay, and a pair that ``products`` names twice fails the job.
    """
    low, high = F.least("iid1", "iid2").alias("_lo"), F.greatest("iid1", "iid2").alias("_hi")
    left = grm.select("*", low, high)
    right = products.select(low, high, *map(col, values), *([col(order)] if order else []))
    if order:
        left = first_of_each(left, ["_lo", "_hi"], order)
        right = last_of_each(right, ["_lo", "_hi"], order).drop(order)
    else:
        once = lambda v: F.when(F.count("*") == 1, F.any_value(col(v))).otherwise(F.raise_error(F.concat_ws(" ", F.lit("products name the pair"), F.any_value("_lo"), F.any_value("_hi"), F.lit("twice; give an order")))).alias(v)
        right = right.groupBy("_lo", "_hi").agg(*map(once, values))
    return left.join(right, ["_lo", "_hi"], "left").drop("_lo", "_hi", *([order] if order else []))


def pair_products(grm: DataFrame, phenotypes: DataFrame, names: str | list[str], order: str | None = None, keep: tuple[str, ...] = (), people_order: str | None = None, watch: Watch | None = None, once: bool = False, **limits: int) -> DataFrame:
    """``grm`` (iid1, iid2, grm, and the columns ``keep``) with ``<name>_crossprod``, its own two people's products: two joins on people, none of pairs.

    A pair that is listed several times, either way round, counts once: the first in ``order``, or without it the row with
    the least relatedness. Where ``grm`` is known to have each pair ``once``, no pair is shuffled for that. Of people that are
    listed several times the first in ``people_order`` counts.
    """
    names = [names] if isinstance(names, str) else names
    own = list(dict.fromkeys(["iid1", "iid2", "grm", *keep]))
    rows = grm.select(*map(col, own))
    if not once:
        first = F.struct(*([col(order).alias("_order")] if order else []), F.col("grm"), F.col("iid1"), F.col("iid2"), *map(col, keep))
        rows = grm.groupBy(F.least("iid1", "iid2").alias("_lo"), F.greatest("iid1", "iid2").alias("_hi")).agg(F.min(first).alias("_first")).select(*(F.col(f"_first.`{c}`").alias(c) for c in own))
    joined = with_people(rows, phenotypes, names, people_order, **limits)
    out = joined.select(*map(col, own), *((F.col(f"_a{k}") * F.col(f"_b{k}")).alias(f"{x}_crossprod") for k, x in enumerate(names)))
    return watched(watch, out, "pair_products", **value_counts([f"{x}_crossprod" for x in names]), n_grm=F.count("grm"))


def store_pairs(df: DataFrame, table: str, buckets: int | None = None, order: str | None = None, by: tuple[str, ...] = ("lo", "hi")) -> DataFrame:
    """``df`` (iid1, iid2 and others) as a table in the warehouse, with lo and hi, the two people in order, in ``buckets`` by these (or by ``by``) and sorted in them.

    Tables with as many buckets join without being shuffled again. With ``order``, of a pair that is listed several times,
    either way round, the first row is stored.
    """
    spark = df.sparkSession
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    df = df.withColumns({"lo": F.least("iid1", "iid2"), "hi": F.greatest("iid1", "iid2")})
    df = first_of_each(df, ["lo", "hi"], order) if order else df
    df.repartition(buckets, *by).write.bucketBy(buckets, *by).sortBy(*by).saveAsTable(table)
    return spark.table(table)


def join_stored(grm: DataFrame, products: DataFrame, values: list[str]) -> DataFrame:
    """As ``join_pairs``, for stored pairs; ``products`` must hold a pair once."""
    return grm.join(products.select("lo", "hi", *map(col, values)), ["lo", "hi"], "left")
