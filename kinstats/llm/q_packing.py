"""Query of best-fit packing."""

from .common import table
from .packing import best_fit


def op10_best_fit_packing(spark, sf_dir):
    import public_tokenizers

    return best_fit(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


QUERIES = {"op10_best_fit_packing": op10_best_fit_packing}
ORACLES = {}
