"""SQL that repeats the bootstrap: the same random numbers, drawn row by row."""

from __future__ import annotations

MASK = (1 << 32) - 1
#: Multipliers and shifts of the 32-bit finaliser, and the step between words.
FIRST, SECOND, ADD = 0x85EBCA6B, 0xC2B2AE35, 0xE6546B64


def _mixed(source: str, columns: list[str]) -> str:
    """``source`` with its 32-bit ``columns`` scrambled."""
    keep = f"* EXCLUDE ({', '.join(columns)})"
    for shift, factor in ((16, FIRST), (13, SECOND)):
        source = f"(SELECT {keep}, " + ", ".join(f"(xor({c}, {c} >> {shift}) * {factor}::UBIGINT) & {MASK}::UBIGINT AS {c}" for c in columns) + f" FROM {source})"
    return f"(SELECT {keep}, " + ", ".join(f"xor({c}, {c} >> 16) AS {c}" for c in columns) + f" FROM {source})"


def _streams(source: str, words: list[str]) -> str:
    """``source`` with h1 and h2, start and odd step of the stream of ``words`` (columns or numbers)."""
    out = f"(SELECT *, 1::UBIGINT AS h1, 2::UBIGINT AS h2 FROM {source})"
    for word in words:
        out = f"(SELECT * EXCLUDE (h1, h2), xor(h1, CAST({word} AS UBIGINT)) AS h1, xor(h2, CAST({word} AS UBIGINT)) AS h2 FROM {out})"
        out = _mixed(out, ["h1", "h2"])
        out = f"(SELECT * EXCLUDE (h1, h2), (h1 * 5 + {ADD}::UBIGINT) & {MASK}::UBIGINT AS h1, (h2 * 5 + {ADD}::UBIGINT) & {MASK}::UBIGINT AS h2 FROM {out})"
    return f"(SELECT * EXCLUDE (h2), h2 | 1::UBIGINT AS h2 FROM {out})"


def _drawn(source: str, words: list[str], total: str) -> str:
    """A row with the number h for each of the ``total`` draws of each row of ``source``."""
    parts = f"(SELECT *, unnest(range(0, CAST(ceil({total} / 65536.0) AS BIGINT))) AS c FROM {source})"
    each = f"(SELECT *, unnest(range(1, least(65536, {total} - c * 65536) + 1)) AS t FROM {_streams(parts, [*words, 'c'])})"
    return _mixed(f"(SELECT * EXCLUDE (h1, h2, t, c), (h1 + CAST(t AS UBIGINT) * h2) & {MASK}::UBIGINT AS h FROM {each})", ["h"])


def bootstrap_sql(replicates: int = 1000, seed: int = 1, bucket_rows: int = 50_000) -> str:
    """CTEs from ``srk`` (key, x, y) and ``cuts`` to ``boot`` (k and the four bounds)."""
    at = lambda c, q: f"list_sort(list({c}))[{int(q * replicates) + 1}]"
    return f"""inr AS (SELECT k, key, x, y FROM srk JOIN cuts ON x >= lo AND x < hi WHERE x IS NOT NULL AND y IS NOT NULL),
bt AS (SELECT k, count(*) AS n, CAST(ceil(count(*) / {bucket_rows}.0) AS UBIGINT) AS nb, avg(x) AS mx, avg(y) AS my FROM inr GROUP BY k HAVING count(*) >= 2),
br AS (SELECT k, key, CAST(('0x' || substr(md5(key), 1, 8)) AS UBIGINT) % nb AS b, x - mx AS dx, y - my AS dy FROM inr JOIN bt USING (k)),
rk AS (SELECT k, b, dx, dy, row_number() OVER (PARTITION BY k ORDER BY b, key, dx, dy) - 1 AS place, row_number() OVER (PARTITION BY k, b ORDER BY key, dx, dy) - 1 AS own FROM br),
bs AS (SELECT k, b, count(*) AS size FROM rk GROUP BY k, b),
rep AS (SELECT k, n, nb, unnest(range(0, {replicates})) AS r FROM bt),
far AS (SELECT k, r, CAST((h * CAST(n AS UBIGINT)) >> 32 AS BIGINT) AS place FROM {_drawn("(SELECT * FROM rep WHERE nb > 1)", [str(seed), "1", "k", "r"], "n")}),
wanted AS (SELECT k, b, r, count(*) AS m FROM far JOIN rk USING (k, place) GROUP BY k, b, r UNION ALL SELECT k, 0::UBIGINT, r, n FROM rep WHERE nb = 1),
near AS (SELECT k, b, r, CAST((h * CAST(size AS UBIGINT)) >> 32 AS BIGINT) AS own FROM {_drawn("(SELECT * FROM wanted JOIN bs USING (k, b))", [str(seed), "2", "k", "b", "r"], "m")}),
bm AS (SELECT k, r, count(*) AS n, sum(dx) AS sx, sum(dy) AS sy, sum(dx * dx) AS sxx, sum(dx * dy) AS sxy FROM near JOIN rk USING (k, b, own) GROUP BY k, r),
bv AS (SELECT *, sxx - sx * sx / n AS vx FROM bm),
bl AS (SELECT *, CASE WHEN vx <= 1e-12 * sxx THEN 0 ELSE (sxy - sx * sy / n) / vx END AS slope FROM bv),
bf AS (SELECT k, slope, CASE WHEN vx <= 1e-12 * sxx THEN 0 ELSE my + sy / bl.n - slope * (mx + sx / bl.n) END AS intercept FROM bl JOIN bt USING (k)),
boot AS (SELECT k, {at("intercept", 0.025)} AS intercept_ci_lower, {at("intercept", 0.975)} AS intercept_ci_upper, {at("slope", 0.025)} AS slope_ci_lower, {at("slope", 0.975)} AS slope_ci_upper FROM bf GROUP BY k)"""
