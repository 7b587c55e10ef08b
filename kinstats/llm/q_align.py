"""Query of the alignment of two tokenizers over all documents."""

from .align import digest
from .common import table


def op13_tokenizer_alignment(spark, sf_dir):
    import public_tokenizers

    return digest(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


QUERIES = {"op13_tokenizer_alignment": op13_tokenizer_alignment}
ORACLES = {}
