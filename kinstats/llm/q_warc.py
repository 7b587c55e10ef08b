"""Query of the WARC writer: writes all pages and reads them back."""

import uuid

from .common import shared_dir, table
from .warc import read_warc, write_warc


def op5_warc_round_trip(spark, sf_dir):
    folder = write_warc(table(spark, sf_dir, "pages"), f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}")
    return read_warc(spark, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


QUERIES = {"op5_warc_round_trip": op5_warc_round_trip}
#: The 160 bits of SHA-1 are eight times 20 bits, each of which gives four letters.
SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h, sha1(coalesce(html, '')) AS x, strlen(coalesce(html, '')) AS n FROM pages),
d AS (SELECT *, list_aggregate(flatten(list_transform(range(8), lambda i: list_transform([15, 10, 5, 0],
        lambda b: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((CAST('0x' || substr(x, 5 * i + 1, 5) AS BIGINT) >> b) & 31 AS BIGINT) + 1, 1)))), 'string_agg', '') AS payload_digest FROM p),
f AS (SELECT x, min(page_id) AS first FROM p GROUP BY x)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, payload_digest, CASE WHEN first IS NULL OR page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
    CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to FROM d JOIN f USING (x)
"""
ORACLES = {"op5_warc_round_trip": SQL}
