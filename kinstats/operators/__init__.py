"""Operators on samples, variants, pairs and phenotypes."""

from .binning import binned_stats
from .grm import align_by_position, align_freqs, allele_freqs, allele_metrics, grm_for_pairs, standardise, usable
from .he import bootstrap_ci, he_regression, interval_counts, intervals, summarise
from .many import binned_stats_many, he_regression_many, products_many, residualise_many
from .packed import allele_freqs_packed, grm_from_packed, pack_genotypes, unpack_genotypes, with_own_freqs
from .pairs import canonical, crossprods, first_of_each, join_pairs, join_stored, last_of_each, needed_samples, pair_products, resolve_pairs, store_pairs, unknown_ids, with_people
from .residuals import (
    complete_cases, covariates_at, drop_outliers, fit_linear, join_covariates, residual_metrics, residualise, with_residuals, zscore_by_group,
)

__all__ = [
    "align_by_position", "align_freqs", "allele_freqs", "allele_freqs_packed", "allele_metrics", "binned_stats", "binned_stats_many", "bootstrap_ci", "canonical", "complete_cases",
    "covariates_at", "crossprods", "drop_outliers", "first_of_each", "fit_linear", "grm_for_pairs", "grm_from_packed",
    "he_regression", "he_regression_many", "interval_counts", "intervals", "join_covariates", "join_pairs", "join_stored", "last_of_each", "needed_samples", "pack_genotypes",
    "pair_products", "products_many", "residual_metrics", "residualise", "residualise_many", "resolve_pairs", "standardise", "store_pairs", "summarise", "unknown_ids", "unpack_genotypes", "usable",
    "with_own_freqs", "with_people", "with_residuals", "zscore_by_group",
]
