"""Quality rules as a short-circuit cascade, in DataFrame functions only.

``measure`` adds counts of the words, symbols and repetitions of each text. ``in_order`` measures on a sample what each
count costs and how much each rule rejects, and orders the rules by rejections per cost of the counts that no rule
before has asked for. ``cascade`` nests them: a count is made once, when the first rule asks for it, and only for
documents that all earlier rules kept. The order never changes a verdict, only what it costs.

Defined cases: a null or empty text has no words and all counts are 0, so it fails the rule of the least words; texts of
any length are counted whole; rules that reject equally much for their cost stay in the given order, and a sample that
rejects nothing puts the cheapest first; an empty table gives an empty result; repeated rows are judged alike; columns
that clash with the new ones are replaced in ``measure``'s output.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let

SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50


def words(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), "[ \\t-\\r]+"), lambda w: w != "")


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit("[^ \\t-\\r]+")), F.lit(0)).cast("long")


def word_chars(text: Column) -> Column:
    return F.coalesce(F.length(F.translate(text, SPACES, "")), F.lit(0)).cast("long")


def n_symbols(text: Column) -> Column:
    return F.coalesce(F.length(text) - F.length(F.translate(text, SYMBOLS, "")), F.lit(0)).cast("long")


def n_dup_lines(text: Column) -> Column:
    lines = F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: x.rlike("[^ \\t-\\r]"))
    return let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long")


def n_repeat_words(text: Column) -> Column:
    """Words in windows of three that occur twice or more in the text.

    Windows are compared by 64-bit hash. Only where a hash repeats are they sorted with their places; the places of
    repeated windows, in order, then cover three words each, less what the next one covers too.
    """

    def covered(hashes: Column) -> Column:
        pairs = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def starts(p: Column) -> Column:
            same = lambda x, j: (F.get(p, j - 1)["h"] == x["h"]) | (F.get(p, j + 1)["h"] == x["h"])
            return F.array_sort(F.transform(F.filter(p, lambda x, j: F.coalesce(same(x, j), F.lit(False))), lambda x: x["i"]))

        return let(let(pairs, starts), lambda s: F.aggregate(F.transform(s, lambda x, j: F.least(F.lit(3), F.coalesce(F.get(s, j + 1) - x, F.lit(3)))), F.lit(0), lambda a, b: a + b))

    def windows(ws: Column) -> Column:
        hashes = F.transform(F.sequence(F.lit(0), F.size(ws) - 3), lambda i: F.xxhash64(F.get(ws, i), F.get(ws, i + 1), F.get(ws, i + 2)))
        return let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), 0).otherwise(covered(h)))

    return let(words(text), lambda ws: F.when(F.size(ws) < 4, 0).otherwise(windows(ws))).cast("long")


COUNTS: dict[str, Callable[[Column], Column]] = {"n_words": n_words, "word_chars": word_chars, "n_symbols": n_symbols, "n_dup_lines": n_dup_lines, "n_repeat_words": n_repeat_words}


@dataclass(frozen=True)
class Rule:
    """A document is rejected where ``rejects``, given the counts by name, is true."""

    name: str
    rejects: Callable[[Callable[[str], Column]], Column]


#: Usual limits of public web corpora, over the counts above.
BASE = [Rule("few_words", lambda c: c("n_words") < MIN_WORDS), Rule("repeated_words", lambda c: 100 * c("n_repeat_words") > 50 * c("n_words"))]
RULES = [
    Rule("many_words", lambda c: c("n_words") > 1_000_000),
    Rule("short_words", lambda c: c("word_chars") < 3 * c("n_words")),
    Rule("long_words", lambda c: c("word_chars") > 10 * c("n_words")),
    Rule("symbols", lambda c: 10 * c("n_symbols") > c("n_words")),
    Rule("repeated_lines", lambda c: (c("n_dup_lines") >= 3) & (10 * c("n_dup_lines") > c("n_words"))),
]


def asks(rule: Rule) -> list[str]:
    """Names of the counts that a rule uses."""
    names: list[str] = []
    rule.rejects(lambda name: names.append(name) or F.lit(0))
    return list(dict.fromkeys(names))


def measure(docs: DataFrame) -> DataFrame:
    """``docs`` with a column for each count."""
    return docs.withColumns({name: count(F.col("text").cast("string")) for name, count in COUNTS.items()})


def cascade(rules: list[Rule], text: Column | None, ready: dict[str, Column] | None = None) -> Column:
    """True where some rule rejects; each rule runs only where those before it did not. ``ready``: counts that are there."""
    ready = ready or {}
    if not rules:
        return F.lit(False)
    missing = [name for name in asks(rules[0]) if name not in ready]
    if missing:
        return let(COUNTS[missing[0]](text), lambda x: cascade(rules, text, ready | {missing[0]: x}))
    return F.when(F.coalesce(rules[0].rejects(lambda name: ready[name]), F.lit(False)), True).otherwise(cascade(rules[1:], text, ready))


def seconds(sample: DataFrame, value: Column | None, runs: int = 3) -> float:
    """The least time of several runs over ``sample``, after one that compiles; without a value: what any run takes."""
    wanted = sample.agg(F.count("text") if value is None else F.sum(value))
    wanted.first()
    took = []
    for _ in range(runs):
        began = time.perf_counter()
        wanted.first()
        took.append(time.perf_counter() - began)
    return min(took)


def profile(sample: DataFrame, rules: list[Rule], ready: list[str] | None = None) -> list[tuple[float, float, Rule]]:
    """(rejections per second, seconds, rule) over ``sample``, the best first; counts that are ``ready``, or that an earlier rule asks for, cost nothing."""
    text, known = F.col("text").cast("string"), set(ready or [])
    base = seconds(sample, None)
    cost = {name: max(seconds(sample, COUNTS[name](text)) - base, 1e-4) for name in {x for r in rules for x in asks(r)} - known}
    shares = measure(sample.select("text")).agg(*(F.avg(F.coalesce(r.rejects(F.col), F.lit(False)).cast("double")) for r in rules)).first() if rules else ()
    left, out = list(zip(rules, [x or 0.0 for x in shares], strict=True)), []
    while left:
        spent = lambda rule: 1e-4 + sum(cost[x] for x in asks(rule) if x not in known)
        best = min(left, key=lambda x: (-x[1] / spent(x[0]), spent(x[0])))
        out.append((best[1] / spent(best[0]), spent(best[0]), best[0]))
        known |= set(asks(best[0]))
        left.remove(best)
    return out


def in_order(docs: DataFrame, rules: list[Rule], ready: list[str] | None = None, sample_rows: int = 500) -> list[Rule]:
    """Rules by rejections per cost on about ``sample_rows`` random rows, few of which any task sends; the order affects cost only."""
    share = min(1.0, 4 * sample_rows / max(1, docs.count()))
    sample = docs.select("text").sample(share, 7).orderBy(F.rand(7)).limit(sample_rows).cache()
    try:
        sample.count()
        return [rule for _, _, rule in profile(sample, rules, ready)]
    finally:
        sample.unpersist()


def keep_good(docs: DataFrame, sample_rows: int = 500) -> DataFrame:
    """The rows of ``docs`` that no rule rejects, with their columns as they are."""
    return docs.filter(~cascade(in_order(docs, BASE + RULES, sample_rows=sample_rows), F.col("text").cast("string")))
