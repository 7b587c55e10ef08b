"""From files of genotypes, samples, variants, frequencies and pairs to relatedness."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.grm import align_by_position, align_freqs
from ..operators.packed import grm_from_packed
from ..operators.pairs import resolve_pairs
from ..sources import find_freqs, read_freqs, read_genotypes, read_pairs, read_samples, read_variants
from ..sources.text import ORDER
from ..storage import saved
from ..watch import Watch


def relatedness(spark: SparkSession, prefix: str, pairs: str, freqs: str | None = None, by_position: bool = False, layout: str = "iid", missing: str = "exclude", watch: Watch | None = None, order: bool = True) -> DataFrame:
    """iid1, iid2, n_snps, grm and (with ``order``) file_order of the pairs listed in the file ``pairs``, from ``<prefix>.bed``, ``.fam``, ``.bim`` and frequencies.

    Frequencies are those of the file ``freqs``, else of ``<prefix>.afreq`` or ``.frq``; where there is none, they are counted in
    the genotypes themselves. They belong to variants by name or, with ``by_position``, by row. Every listed line has a
    row, repeated ones too.
    """
    kept = ("iid1", "iid2", *([ORDER] if order else []))
    samples = saved(read_samples(spark, f"{prefix}.fam", watch))
    # Lines are read once and stay where they are; one that names somebody unknown fails the job.
    listed = resolve_pairs(read_pairs(spark, pairs, layout, watch=watch), samples, on_unknown="fail").select("idx1", "idx2", *kept)
    n = samples.count()
    codes = read_genotypes(spark, f"{prefix}.bed", n).withColumnRenamed("variant_idx", "variant_id")
    try:
        path = freqs or find_freqs(spark, prefix)
    except FileNotFoundError:
        path = None
    known = None
    if path:
        variants, told = read_variants(spark, f"{prefix}.bim", watch), read_freqs(spark, path)
        aligned = align_by_position(variants, told, watch) if by_position else align_freqs(variants, told, watch=watch)
        known = aligned.select(F.col("variant_idx").alias("variant_id"), "p")
    return grm_from_packed(listed, codes, known, n, missing, keep=kept).select("iid1", "iid2", "n_snps", "grm", *kept[2:])
