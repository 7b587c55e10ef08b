"""Column expressions."""

from .numbers import missing_or_number, number, words_of
from .statistics import bin_index, bin_label, dosage_weight

__all__ = ["bin_index", "bin_label", "dosage_weight", "missing_or_number", "number", "words_of"]
