"""Whole analyses, put together from operators."""

from .heritability import heritability, products_of, run_metrics
from .relatedness import relatedness
from .study import study

__all__ = ["heritability", "products_of", "relatedness", "run_metrics", "study"]
