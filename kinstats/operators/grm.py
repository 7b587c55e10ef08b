"""Genetic relatedness of listed pairs, without the matrix of all pairs.

Here from long genotypes: those of few variants, all of them copies from 0 to 2, are packed and go to all tasks; others meet by
joins alone, with a row for each pair and variant. ``packed`` has the same from packed rows. A pair that is listed several times, or either way round, is judged alike and has a row each time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.statistics import dosage_weight
from ..watch import Watch, count_if, watched

LEAST_DEVIATION = 1e-8
#: How missing genotypes count: not at all for the pair, or as the variant's mean, over all variants that vary.
MISSING = ("exclude", "mean")


def allele_freqs(genotypes: DataFrame) -> DataFrame:
    """variant_id, freq of the counted allele and n_obs, from (sample_id, variant_id, a1)."""
    return genotypes.groupBy("variant_id").agg((F.avg("a1") / 2).alias("freq"), F.count("a1").alias("n_obs"))


def align_freqs(variants: DataFrame, freqs: DataFrame, key: str = "snp_id", strict: bool = True, watch: Watch | None = None) -> DataFrame:
    """``variants`` (key, a1) with ``p``, the frequency of a1: ``freq`` if that allele was counted, else one minus it.

    With ``strict``, variants without a frequency, or with several, are an error.
    """
    out = variants.join(freqs.select(key, "counted_allele", "freq"), key, "left").withColumn("p", F.when(F.col("counted_allele") == F.col("a1"), F.col("freq")).otherwise(1 - F.col("freq")))
    if strict:
        bad = out.groupBy(key).agg(F.count("*").alias("n"), F.count("freq").alias("k")).filter("n > 1 or k = 0").limit(1).collect()
        if bad:
            raise ValueError(f"{bad[0][0]} has {bad[0]['k']} frequencies; files whose rows belong together can be aligned by position")
    flipped = F.col("counted_allele") != F.col("a1")
    out = watched(watch, out, "align_freqs", n_variants=F.count("*"), n_flipped=count_if(flipped), n_fixed=count_if(~varies(F.col("p"))))
    return out.drop("counted_allele", "freq")


def align_by_position(variants: DataFrame, freqs: DataFrame, watch: Watch | None = None) -> DataFrame:
    """As ``align_freqs``, for files whose rows belong together by ``variant_idx``; both must have as many."""
    n, k = variants.count(), freqs.count()
    if n != k:
        raise ValueError(f"{n} variants and {k} frequencies")
    return align_freqs(variants, freqs, "variant_idx", watch=watch)


def allele_metrics(variants: DataFrame, freqs: DataFrame, key: str = "snp_id") -> DataFrame:
    """One row: variants (key, a1, a2), those whose frequency is of the other allele, of neither allele, and those that do not vary."""
    joined = variants.join(freqs.select(key, "counted_allele", "freq"), key)
    other = F.col("counted_allele") != F.col("a1")
    p = F.col("freq")
    return joined.agg(F.count("*").alias("n_variants"), F.count_if(other).alias("n_flipped"), F.count_if(other & (F.col("counted_allele") != F.col("a2"))).alias("n_neither"), F.count_if(~varies(p)).alias("n_fixed"))


def varies(p):
    return F.sqrt(2 * p * (1 - p)) >= LEAST_DEVIATION


def usable(freqs: DataFrame) -> DataFrame:
    """Variants whose dosage varies: sqrt(2p(1-p)) is at least 1e-8."""
    return freqs.filter(varies(F.col("p")))


def standardise(genotypes: DataFrame, freqs: DataFrame) -> DataFrame:
    """(sample_id, variant_id, w); variants that do not vary are left out, missing genotypes have no row."""
    return genotypes.filter("a1 is not null").join(usable(freqs).select("variant_id", "p"), "variant_id").select("sample_id", "variant_id", dosage_weight(F.col("a1"), F.col("p")).alias("w"))


def counted(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """Distinct pairs and ``_times``, how often each is listed."""
    return pairs.groupBy(a, b).agg(F.count("*").alias("_times"))


def listed_again(df: DataFrame) -> DataFrame:
    """Each row as often as ``_times`` says."""
    return df.withColumn("_times", F.explode(F.sequence(F.lit(1), F.col("_times")))).drop("_times")


def all_variants(genotypes: DataFrame, freqs: DataFrame) -> int:
    """How many variants of ``genotypes`` vary: what sums are divided by where missing genotypes count as the mean."""
    return genotypes.select("variant_id").distinct().join(usable(freqs).select("variant_id"), "variant_id", "left_semi").count()


def how(missing: str) -> bool:
    """Whether missing genotypes count as the mean."""
    if missing not in MISSING:
        raise ValueError(f"missing is one of {', '.join(MISSING)}")
    return missing == "mean"


def grm_for_pairs(pairs: DataFrame, genotypes: DataFrame, freqs: DataFrame, missing: str = "exclude") -> DataFrame:
    """id1, id2, n_snps, grm for every listed pair: the mean product of weights over the variants that both have; null without one.

    With ``missing`` mean, a missing genotype counts as the mean and the sum is divided by all variants that vary.
    """
    from .packed import grm_from_few  # which needs what is above

    n = all_variants(genotypes, freqs) if how(missing) else None
    found = grm_from_few(pairs, genotypes, freqs, n)
    if found is not None:
        return found
    weights = standardise(genotypes, freqs)
    a = weights.select(F.col("sample_id").alias("id1"), "variant_id", F.col("w").alias("w1"))
    b = weights.select(F.col("sample_id").alias("id2"), "variant_id", F.col("w").alias("w2"))
    pairs = counted(pairs, "id1", "id2")
    sums = pairs.select("id1", "id2").join(a, "id1").join(b, ["id2", "variant_id"]).groupBy("id1", "id2").agg(F.count("*").alias("n_snps"), F.sum(F.col("w1") * F.col("w2")).alias("s"))
    return divided(listed_again(pairs.join(sums, ["id1", "id2"], "left")), n)


def divided(found: DataFrame, n: int | None = None) -> DataFrame:
    """``found`` with n_snps and grm from its sums (n_snps, s); ``n``: what all sums are divided by."""
    rest = [c for c in found.columns if c not in ("n_snps", "s")]
    if n is not None:
        return found.select(*rest, F.lit(n).cast("long").alias("n_snps"), (F.when(F.lit(n > 0), F.coalesce("s", F.lit(0.0)) / F.lit(float(max(n, 1))))).alias("grm"))
    return found.select(*rest, F.coalesce("n_snps", F.lit(0)).cast("long").alias("n_snps"), F.when(F.col("n_snps") > 0, F.try_divide("s", "n_snps")).alias("grm"))
