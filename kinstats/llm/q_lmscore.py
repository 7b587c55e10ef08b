"""Query of language-model scoring: documents labelled as good are the target, all documents the background."""

from pyspark.sql import functions as F

from .common import table
from .lmscore import score


def op6_lm_scoring(spark, sf_dir):
    out = score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").filter("quality = 1").select("doc_id"))
    return out.select("doc_id", "n_tokens", *(F.round(c, 6).alias(c) for c in ("target_loss", "background_loss", "score")))


#: By words themselves: tokens are unnested, counted in all, in the target, and in their own document, and joined again.
SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(lower(coalesce(text, '')), '[^\x20\x09-\x0D]+') AS ws, doc_id IN (SELECT doc_id FROM labels WHERE quality = 1) AS t FROM documents),
k AS (SELECT r, t, i, ws[i] AS w, CASE WHEN i > 1 THEN ws[i - 1] ELSE ' ' END AS v FROM (SELECT r, t, ws, unnest(range(1, len(ws) + 1)) AS i FROM d)),
wc AS (SELECT w, count(*) AS c, count(*) FILTER (WHERE t) AS ct FROM k GROUP BY w UNION ALL SELECT ' ', count(*), count(*) FILTER (WHERE t) FROM k WHERE i = 1),
pc AS (SELECT v, w, count(*) AS c, count(*) FILTER (WHERE t) AS ct FROM k GROUP BY v, w),
ow AS (SELECT r, w, count(*) AS o FROM k GROUP BY r, w UNION ALL SELECT r, ' ', 1 FROM k WHERE i = 1),
od AS (SELECT r, v, w, count(*) AS o FROM k GROUP BY r, v, w),
n AS (SELECT count(*) AS c, count(*) FILTER (WHERE t) AS ct, count(DISTINCT w) AS size FROM k),
l AS (SELECT k.r, count(*) OVER (PARTITION BY k.r) AS own, CASE WHEN k.t THEN 1 ELSE 0 END AS t, wc.c AS wc, wc.ct AS wt, ow.o AS wo, vc.c AS vc, vc.ct AS vt, ov.o AS vo, pc.c AS pc, pc.ct AS pt, od.o AS po
    FROM k JOIN wc ON wc.w = k.w JOIN ow ON ow.r = k.r AND ow.w = k.w JOIN wc vc ON vc.w = k.v JOIN ow ov ON ov.r = k.r AND ov.w = k.v
    JOIN pc ON pc.v = k.v AND pc.w = k.w JOIN od ON od.r = k.r AND od.v = k.v AND od.w = k.w),
p AS (SELECT r, pt - t * po AS pt, (wt - t * wo + 1.0::DOUBLE) / (n.ct - t * own + size) AS qt, vt - t * vo AS vt, pc - po AS pb, (wc - wo + 1.0::DOUBLE) / (n.c - own + size) AS qb, vc - vo AS vb FROM l, n),
s AS (SELECT r, count(*) AS n_tokens, avg(-ln((pt + 20 * qt) / (greatest(vt, pt) + 20))) AS target_loss, avg(-ln((pb + 20 * qb) / (greatest(vb, pb) + 20))) AS background_loss FROM p GROUP BY r)
SELECT doc_id, CAST(coalesce(n_tokens, 0) AS BIGINT) AS n_tokens, round(target_loss, 6) AS target_loss, round(background_loss, 6) AS background_loss, round(target_loss - background_loss, 6) AS score FROM d LEFT JOIN s USING (r)
"""

QUERIES = {"op6_lm_scoring": op6_lm_scoring}
ORACLES = {"op6_lm_scoring": SQL}
