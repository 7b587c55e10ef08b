"""Query of benchmark decontamination: all documents against all passages."""

from .common import table
from .lsa import matches


def op2_benchmark_decontamination(spark, sf_dir):
    return matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {"op2_benchmark_decontamination": op2_benchmark_decontamination}
ORACLES = {}
