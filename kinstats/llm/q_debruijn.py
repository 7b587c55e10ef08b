"""Query of word-span de-duplication over all documents."""

from .common import table
from .debruijn import digest


def op7_substring_dedup(spark, sf_dir):
    return digest(table(spark, sf_dir, "documents"))


QUERIES = {"op7_substring_dedup": op7_substring_dedup}

SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT doc_id, i, array_to_string(w[i:i + 19], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, CAST(len(w) AS BIGINT) - 18)) AS i FROM d)),
late AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY g ORDER BY doc_id, i) AS r FROM g) WHERE r > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS j FROM late),
w AS (SELECT doc_id, unnest(w) AS x, unnest(range(1, CAST(len(w) AS BIGINT) + 1)) AS j FROM d),
k AS (SELECT doc_id, string_agg(x, ' ' ORDER BY j) AS t, count(*) AS n FROM w ANTI JOIN gone USING (doc_id, j) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(len(d.w) - coalesce(k.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(k.t, '')) AS kept_sha256
FROM d LEFT JOIN k USING (doc_id)
"""
ORACLES = {"op7_substring_dedup": SQL}
