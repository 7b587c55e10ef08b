"""Query of the URL filters over all pages."""

from .common import table
from .urlrules import judge

RULES = {"org/": "allow", "example.org/es/": "block", "example.org/en/1": "block", "com/fr/": "allow", "com/de/": "block"}


def op9_url_filters(spark, sf_dir):
    return judge(table(spark, sf_dir, "pages"), RULES)


def _subsets(items: str) -> str:
    return f"unnest(list_transform(range(1, CAST(pow(2, len({items})) AS BIGINT)), lambda m: list_filter({items}, lambda x, i: (m >> (i - 1)) & 1 = 1)))"


#: Mining by force: all combinations of the tokens of each labelled url are counted, rules are those with the support and
#: confidence, and combinations find them again.
SQL = rf"""
WITH u AS (SELECT page_id, url, regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 1) AS h, regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 2) AS path FROM pages),
p AS (SELECT page_id, url, translate(h, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, path FROM u),
d AS (SELECT *, CASE WHEN (host = 'example.org' OR host LIKE '%.example.org') AND starts_with(path, '/en/1') THEN 'example.org/en/1' WHEN (host = 'example.org' OR host LIKE '%.example.org') AND starts_with(path, '/es/') THEN 'example.org/es/'
    WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/de/') THEN 'com/de/' WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/fr/') THEN 'com/fr/'
    WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/') THEN 'org/' END AS rule FROM p),
s AS (SELECT *, CASE WHEN rule IN ('org/', 'com/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block' END AS said FROM d),
t AS (SELECT DISTINCT url, said, list_sort(list_distinct(list_concat(list_transform(list_filter(string_split(host, '.'), lambda x: x <> ''), lambda x: 'host=' || x),
    list_transform(list_filter(string_split(path, '/'), lambda x: x <> '' AND NOT regexp_matches(x, '[0-9]')), lambda x: 'path=' || x),
    list_transform(list_filter([regexp_extract(path, '\.([A-Za-z]+)$', 1)], lambda x: x <> ''), lambda x: 'ending=' || x),
    list_transform(list_filter(list_transform(string_split(regexp_extract(url, '(?s)\?([^#]*)', 1), '&'), lambda x: string_split(x, '=')[1]), lambda x: x <> ''), lambda x: 'field=' || x)))) AS items FROM s WHERE url IS NOT NULL),
b AS (SELECT url, said, {_subsets("items")} AS items FROM t),
c AS (SELECT items, said AS verdict, count(*) AS n, sum(count(*)) OVER (PARTITION BY items) AS whole FROM b WHERE said IS NOT NULL GROUP BY items, said),
r AS (SELECT items, verdict, n AS support, n / CAST(whole AS DOUBLE) AS confidence, len(items) AS size FROM c WHERE n >= 0.005 * (SELECT count(*) FROM t WHERE said IS NOT NULL) AND n / CAST(whole AS DOUBLE) >= 0.9),
w AS (SELECT items AS whole_items, verdict, confidence, {_subsets("items")} AS items FROM r),
worse AS (SELECT DISTINCT whole_items, w.verdict FROM w JOIN r ON r.items = w.items AND r.verdict = w.verdict AND r.confidence >= w.confidence AND r.size < len(whole_items)),
kept AS (SELECT r.* FROM r LEFT JOIN worse ON worse.whole_items = r.items AND worse.verdict = r.verdict WHERE worse.verdict IS NULL),
best AS (SELECT url, max(struct_pack(confidence := confidence, support := support, size := size, verdict := verdict)) AS x FROM b JOIN kept USING (items) WHERE said IS NULL GROUP BY url)
SELECT page_id, host, path, rule, coalesce(said, x.verdict, 'allow') AS verdict, CASE WHEN said IS NULL THEN x.confidence END AS mined_confidence FROM s LEFT JOIN best USING (url)
"""

QUERIES = {"op9_url_filters": op9_url_filters}
ORACLES = {"op9_url_filters": SQL}
