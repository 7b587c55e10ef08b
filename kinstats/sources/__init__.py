"""Readers and writers of the file formats."""

from .bed import GenotypeSource, read_genotypes, write_genotypes
from .text import (
    find_freqs, numbered_lines, read_covariates, read_crossprods, read_freqs, read_grm, read_joined_pairs, read_pairs,
    read_phenotype, read_phenotypes, read_results, read_samples, read_variants, write_tsv,
)

__all__ = [
    "GenotypeSource", "find_freqs", "numbered_lines", "read_covariates", "read_crossprods", "read_freqs", "read_genotypes", "read_grm",
    "read_joined_pairs", "read_pairs", "read_phenotype", "read_phenotypes", "read_results", "read_samples", "read_variants", "write_genotypes", "write_tsv",
]
