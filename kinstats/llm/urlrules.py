"""URL filters: a list of host and path rules, and association rules mined from the urls that the list decides.

Defined cases: a null url, or one without ``://``, has an empty host and path and no tokens, so no rule fits and the
default verdict holds; empty paths fit no rule (a rule's path starts with a slash); equal urls get equal verdicts; no
labelled urls, or no rule that passes the thresholds: the default verdict; other columns are ignored. Of listed rules that
fit, the longest decides, of equally long ones the first by name; of mined rules the surest, then that of the most urls,
of the most tokens, and the later verdict by name. Very long urls are cut into all of their tokens; rules can be of any
number of them. Equal urls with different verdicts cannot be, as verdicts follow from the url.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"
LABEL = "label="


def host(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, PARTS, 1), F.lit("")), UPPER, LOWER)


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, PARTS, 2), F.lit(""))


def first_rule(rules: dict[str, str], host: Column, path: Column) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; ``rules``: "host/path" -> verdict. A rule fits its host, all subdomains, and paths that start with its own."""
    name = verdict = None
    for rule, said in sorted(rules.items(), key=lambda x: (-len(x[0]), x[0])):
        at, _, rest = rule.partition("/")
        fits = ((host == at) | host.endswith(f".{at}")) & path.startswith(f"/{rest}")
        name = F.when(fits, rule) if name is None else name.when(fits, rule)
        verdict = F.when(fits, said) if verdict is None else verdict.when(fits, said)
    none = F.lit(None).cast("string")
    return (none, none) if name is None else (name, verdict)


def tokens(url: Column) -> Column:
    """Distinct tokens: every suffix-free label of the host, the top domain, path segments without digits, names of query fields, and whether there is a fragment."""
    labels = F.filter(F.split(host(url), r"\."), lambda x: x != "")
    segments = F.filter(F.split(path(url), "/"), lambda x: (x != "") & ~x.rlike("[0-9]"))
    endings = F.filter(F.split(F.regexp_extract(path(url), r"\.([A-Za-z]+)$", 1), "/"), lambda x: x != "")
    fields = F.filter(F.transform(F.split(F.regexp_extract(url, r"(?s)\?([^#]*)", 1), "&"), lambda x: F.split(x, "=")[0]), lambda x: x != "")
    of = lambda kind, xs: F.transform(xs, lambda x: F.concat(F.lit(f"{kind}="), x))
    return F.array_distinct(F.coalesce(F.concat(of("host", labels), of("path", segments), of("ending", endings), of("field", fields)), F.array().cast("array<string>")))


def classes_of(labelled: DataFrame, least: int) -> DataFrame:
    """(token, class, verdict, n) of the tokens of distinct ``labelled`` (url, verdict) that ``least`` urls have, ``n`` in number: tokens of the very same
    urls, told apart by 128 bits of hash, are one class, named by the first; ``verdict`` is null where its urls have several."""
    of_urls = [F.count("*").alias("n"), F.bit_xor(F.xxhash64("url")).alias("a"), F.bit_xor(F.xxhash64(F.lit(1), "url")).alias("b")]
    same = F.when(F.min("verdict") == F.max("verdict"), F.min("verdict")).alias("verdict")
    found = labelled.select("url", "verdict", F.explode(tokens(F.col("url"))).alias("token")).groupBy("token").agg(*of_urls, same).filter(F.col("n") >= least)
    return found.groupBy("n", "a", "b", "verdict").agg(F.sort_array(F.collect_list("token")).alias("tokens")).select(F.explode("tokens").alias("token"), F.col("tokens")[0].alias("class"), "verdict", "n")


def without_contained(sets: DataFrame, confidence: float) -> DataFrame:
    """Of ``sets`` (items, verdict, confidence, support), which hold every set that they contain, the rules of the confidence that hold no rule of fewer items for the same verdict that is as sure.

    The surest rule inside a set is that of the sets with one item less, or inside one of these, so sizes are taken in turn
    and each set asks for as many others as it has items.
    """
    from .common import cut

    sets = cut(sets.withColumn("size", F.size("items")))
    rule = F.when(F.col("confidence") >= confidence, F.col("confidence"))
    known = cut(sets.filter("size = 1").select("items", "verdict", "confidence", "support", F.lit(None).cast("double").alias("inside"), rule.alias("top")))
    done = [known]
    for size in range(2, (sets.agg(F.max("size")).first()[0] or 0) + 1):
        level = sets.filter(F.col("size") == size)
        places = F.explode(F.sequence(F.lit(0), F.lit(size - 1))).alias("k")
        less = level.select(F.col("items").alias("whole"), "verdict", places).select("whole", "verdict", F.expr("filter(whole, (x, i) -> i <> k)").alias("items"))
        inside = less.join(known.select("items", "verdict", "top"), ["items", "verdict"]).groupBy(F.col("whole").alias("items"), "verdict").agg(F.max("top").alias("inside"))
        known = cut(level.join(inside, ["items", "verdict"], "left").select("items", "verdict", "confidence", "support", "inside", F.greatest(rule, "inside").alias("top")))
        done.append(known)
    out = done[0]
    for x in done[1:]:
        out = out.union(x)
    return out.filter((F.col("confidence") >= confidence) & (F.col("inside").isNull() | (F.col("inside") < F.col("confidence")))).drop("inside", "top")


def mine(labelled: DataFrame, support: float = 0.005, confidence: float = 0.9, least_count: int = 1) -> tuple[DataFrame, DataFrame]:
    """Rules (rule_id, items, verdict, confidence, support) over classes of tokens, and the classes (token, class), from all of ``labelled`` (url, verdict).

    FP-growth runs on all distinct urls. A rule stays if it has the confidence and the support, as a share of the urls and in
    ``least_count`` of them, and no rule of fewer tokens for the same verdict, contained in it, is as sure. Tokens that the
    very same urls have would make two to the power of their number of rules; they count as one, as a rule needs no two of
    them. A token whose urls all have one verdict is a rule by itself and in no longer one, so FP-growth is given the others.
    """
    from pyspark.ml.fpm import FPGrowth

    from .common import cut

    labelled = cut(labelled.filter("url is not null").groupBy("url").agg(F.min("verdict").alias("verdict")))
    n = labelled.count()
    least = max(1, least_count, math.ceil(support * n))
    classes = cut(classes_of(labelled, least))
    single = classes.filter("verdict is not null").groupBy("class", "verdict").agg(F.max("n").alias("support")).select(F.array("class").alias("items"), "verdict", F.lit(1.0).alias("confidence"), "support")
    # The tokens of a class have the same urls, so its name, one of them, stands for it.
    held = labelled.select("url", F.explode(tokens(F.col("url"))).alias("class")).join(classes.filter("verdict is null and token = class").select("class"), "class").groupBy("url").agg(F.collect_list("class").alias("items"))
    baskets = labelled.join(held, "url", "left").select(F.array_append(F.coalesce("items", F.array().cast("array<string>")), F.concat(F.lit(LABEL), "verdict")).alias("items"))
    sets = FPGrowth(itemsCol="items", minSupport=min(1.0, (least - 0.5) / max(1, n)), minConfidence=confidence).fit(baskets).freqItemsets
    labels = F.filter("items", lambda x: x.startswith(LABEL))
    rest = F.array_sort(F.filter("items", lambda x: ~x.startswith(LABEL)))
    sets = sets.select(rest.alias("items"), labels.alias("labels"), "freq")
    alone = sets.filter(F.size("labels") == 0).select("items", F.col("freq").alias("all"))
    both = sets.filter((F.size("labels") == 1) & (F.size("items") > 0)).join(alone, "items").select("items", F.substring(F.col("labels")[0], len(LABEL) + 1, 1 << 20).alias("verdict"), (F.col("freq") / F.col("all")).alias("confidence"), F.col("freq").alias("support"))
    return without_contained(both, confidence).unionByName(single).withColumn("rule_id", F.xxhash64("verdict", "items")), classes.select("token", "class")


def match(urls: DataFrame, rules: DataFrame, classes: DataFrame) -> DataFrame:
    """url and the verdict of the surest rule of whose classes it has a token each, for the distinct ``url`` that have one."""
    index = rules.select("rule_id", "verdict", "confidence", "support", F.size("items").alias("size"), F.explode("items").alias("class"))
    found = urls.select("url").filter("url is not null").distinct().select("url", F.explode(tokens(F.col("url"))).alias("token")).join(classes, "token").select("url", "class").distinct()
    full = found.join(index, "class").groupBy("url", "rule_id", "size", "verdict", "confidence", "support").agg(F.count("*").alias("n")).filter("n = size")
    return full.groupBy("url").agg(F.max(F.struct("confidence", "support", "size", "verdict")).alias("best")).select("url", F.col("best.verdict").alias("mined"), F.col("best.confidence").alias("mined_confidence"))


def judge(pages: DataFrame, rules: dict[str, str], default: str = "allow", support: float = 0.005, confidence: float = 0.9, least_count: int = 1) -> DataFrame:
    """page_id, host, path, rule, verdict, and the confidence of the mined rule where that decides."""
    from .common import cut

    at, rest = host(F.col("url")), path(F.col("url"))
    rule, said = first_rule(rules, F.col("host"), F.col("path"))
    pages = pages.select("page_id", F.col("url").cast("string").alias("url")).withColumns({"host": at, "path": rest}).withColumns({"rule": rule, "said": said})
    mined, classes = mine(pages.filter("said is not null").select("url", F.col("said").alias("verdict")), support, confidence, least_count)
    mined = cut(mined)
    # Only pages that are undecided and have a url are joined. The verdicts are a table, so that Spark can split a url that very many pages have.
    undecided = F.col("said").isNull() & F.col("url").isNotNull()
    verdicts = cut(match(pages.filter(undecided), mined, classes))
    found = pages.filter(undecided).join(verdicts, "url", "left").select("page_id", "host", "path", "rule", F.coalesce("mined", F.lit(default)).alias("verdict"), "mined_confidence")
    rest = pages.filter(~undecided).select("page_id", "host", "path", "rule", F.coalesce("said", F.lit(default)).alias("verdict"), F.lit(None).cast("double").alias("mined_confidence"))
    return rest.union(found)
