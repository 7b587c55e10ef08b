"""Connected components of a graph given as links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, saved


def components(links: DataFrame, rounds: int = 50, large: int = 10_000_000) -> DataFrame:
    """(node, component): for every node of ``links`` (a, b), the smallest node that can be reached.

    Each round hangs every node on the smallest of its neighbours, first the larger ones, then the smaller ones. Minima are
    taken before the shuffle, so a node with very many neighbours is one row for each task there. From ``large`` links on,
    minima are written as a table, with which links are joined in a shuffle of their own: Spark splits the links of such a
    node over several tasks then. Rounds end when nothing changes.
    """
    links = cut(links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    told = saved if links.count() >= large else lambda df: df
    seen = None
    for _ in range(rounds):
        sides = links.select(F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("x")).select("x.*")
        low = told(sides.groupBy("u").agg(F.least("u", F.min("v")).alias("m")))
        # Larger neighbours go to the least of the neighbourhood, and so does the node itself.
        large_side = sides.join(low, "u").select(F.greatest("u", "v").alias("u"), F.col("m").alias("v")).filter("u <> v")
        low = told(large_side.groupBy("u").agg(F.min("v").alias("m")))
        small = large_side.join(low, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x")).select("x.*")
        links = cut(small.filter("u <> v").distinct())
        now = links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"no end after {rounds} rounds")
    return links.groupBy("u").agg(F.min("v").alias("component")).select(F.col("u").alias("node"), "component").union(links.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
