"""Query of exact de-duplication over all documents."""

from .common import table
from .contentsort import marked


def op12_exact_dedup(spark, sf_dir):
    return marked(table(spark, sf_dir, "documents"), ["doc_id"])


QUERIES = {"op12_exact_dedup": op12_exact_dedup}
SQL = r"""
WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents),
g AS (SELECT t, min(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256 FROM d JOIN g USING (t)
"""
ORACLES = {"op12_exact_dedup": SQL}
