"""Query of byte-span de-duplication over all documents."""

from .common import table
from .runindex import digest


def op4_suffix_array_dedup(spark, sf_dir):
    return digest(table(spark, sf_dir, "documents"))


QUERIES = {"op4_suffix_array_dedup": op4_suffix_array_dedup}
#: All windows as blobs; removed starts join to spans, and what lies between them is put together again.
SQL = """
WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS h, CAST(strlen(coalesce(text, '')) AS BIGINT) AS n FROM documents),
w AS (SELECT doc_id, i, array_slice(h, i + 1, i + 50) AS g FROM (SELECT doc_id, h, unnest(range(0, n - 49)) AS i FROM d)),
f AS (SELECT g, min(doc_id) AS first FROM w GROUP BY g),
s AS (SELECT doc_id, i FROM w JOIN f USING (g) WHERE first < doc_id),
r AS (SELECT doc_id, i, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) <= 50 THEN 0 ELSE 1 END AS new FROM s),
q AS (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM r),
spans AS (SELECT doc_id, min(i) AS a, max(i) + 50 AS b FROM q GROUP BY doc_id, k),
kept AS (SELECT doc_id, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS a, a AS b FROM (SELECT doc_id, a, b FROM spans UNION ALL SELECT doc_id, n, n FROM d)),
t AS (SELECT doc_id, string_agg(CASE WHEN b > a THEN hex(array_slice(h, a + 1, b)) ELSE '' END, '' ORDER BY a, b) AS h FROM kept JOIN d USING (doc_id) GROUP BY doc_id),
c AS (SELECT doc_id, sum(b - a) AS removed, count(*) AS k FROM spans GROUP BY doc_id)
SELECT d.doc_id, n AS n_bytes, CAST(coalesce(removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(k, 0) AS BIGINT) AS n_spans, sha256(unhex(t.h)) AS kept_sha256
FROM d JOIN t USING (doc_id) LEFT JOIN c USING (doc_id)
"""
ORACLES = {"op4_suffix_array_dedup": SQL}
