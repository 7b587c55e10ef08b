"""Query of periodic runs over all documents."""

from .common import table
from .runs import digest


def op11_periodic_runs(spark, sf_dir):
    return digest(table(spark, sf_dir, "documents"))


QUERIES = {"op11_periodic_runs": op11_periodic_runs}
ORACLES = {}
