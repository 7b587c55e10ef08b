"""Query of the quality rules over all documents."""

from pyspark.sql import functions as F

from . import quality as q
from .common import table


def op1_quality_rules(spark, sf_dir):
    """The cascade over all documents, ordered by what a sample of them says that its rules cost and reject. All counts are columns of the result, so it reads those."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    ready = {name: F.col(name) for name in q.COUNTS}
    rules = q.in_order(docs, q.RULES)
    counted = q.measure(docs).withColumn("base_failed", q.cascade(q.BASE, None, ready))
    return counted.select("doc_id", *q.COUNTS, "base_failed", (~F.col("base_failed") & ~q.cascade(rules, None, ready)).alias("kept"))


#: By rows and windows instead of arrays: words, lines and three-word windows are unnested and counted.
SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
n AS (SELECT doc_id, t, w, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
        CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
        list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
wins AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d)),
rep AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM wins) WHERE c > 1),
cov AS (SELECT doc_id, count(DISTINCT j) AS n_repeat_words FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS j FROM rep) GROUP BY doc_id),
f AS (SELECT n.doc_id, n_words, word_chars, n_symbols, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
        CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words FROM n LEFT JOIN cov USING (doc_id)),
b AS (SELECT *, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed FROM f)
SELECT *, (NOT base_failed AND NOT (n_words > 1000000 OR word_chars < 3 * n_words OR word_chars > 10 * n_words
    OR 10 * n_symbols > n_words OR (n_dup_lines >= 3 AND 10 * n_dup_lines > n_words))) AS kept FROM b
"""

QUERIES = {"op1_quality_rules": op1_quality_rules}
ORACLES = {"op1_quality_rules": SQL}
