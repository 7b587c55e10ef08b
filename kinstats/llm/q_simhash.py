"""Query of SimHash near-duplicates over all documents."""

from .common import table
from .simhash import near_duplicates


def op8_simhash_near_dedup(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "documents"))


QUERIES = {"op8_simhash_near_dedup": op8_simhash_near_dedup}
ORACLES = {}
