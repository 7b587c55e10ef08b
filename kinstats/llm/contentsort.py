"""Exact copies of documents by a content sort, in DataFrame functions only.

Texts are equal when they are identical after each run of ASCII white space has become one space. Rows are dealt to
ranges by sampled splitters over the normalised text (its first 64 characters, then a hash, so that a splitter has a
bounded size), each range is sorted by the whole text, and the window over it holds neighbours against each other in
full: equal ones are a group, of which the smallest doc_id stays.

A text that more than a share of all rows have would fill a range of its own. Such texts are known by exact counts of
hashes; their rows are dealt in pieces by doc_id, each piece is sorted on its own, and only the pieces' first rows, as
many as there are pieces, meet again with their whole texts. There are at most eight pieces for each shuffle partition.

Defined cases: a null text counts as empty and equals one; a text of white space alone is one space, which is not empty;
of rows with equal text and equal doc_id one stays, whichever; a null doc_id counts as larger than any other, and is
kept only where its group has no other; very long texts are sorted and compared whole; an empty table gives an empty
result; columns that clash with the new ones are replaced. Rows that are alike in text and doc_id are never dealt apart.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import saved

#: White space that is not a single space already.
RUNS = "[\\t-\\r][ \\t-\\r]*| [ \\t-\\r]+"
FOUND = ["keep_id", "group_size", "kept", "text_sha256"]


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), RUNS, " ")


def _with_pieces(rows: DataFrame) -> DataFrame:
    """``rows`` (h, doc_id) with ``piece``: -1, or where very many rows share a hash, which part of them a row is in."""
    spark = rows.sparkSession
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    counts = saved(rows.groupBy("h").agg(F.count("*").alias("n")))
    most = max(1, (counts.agg(F.sum("n")).first()[0] or 0) // (4 * partitions))
    # At most 4 * partitions hashes have more than the mean of a quarter of a partition.
    hot = F.broadcast(counts.filter(F.col("n") > most).select("h", F.ceil(F.col("n") / most).alias("_pieces")))
    piece = F.when(F.col("_pieces").isNotNull(), F.pmod(F.xxhash64("doc_id"), F.col("_pieces")))
    return rows.join(hot, "h", "left").withColumn("piece", F.coalesce(piece.cast("int"), F.lit(-1))).drop("_pieces")


def grouped(rows: DataFrame) -> DataFrame:
    """``rows`` (_own, doc_id, norm, head, h, piece) dealt to ranges and sorted, with what neighbours of equal text and piece have in common; ``_k`` is 1 in the first of them."""
    group = Window.partitionBy("head", "h", "piece", "norm")
    first = group.orderBy(F.col("doc_id").asc_nulls_last())
    return rows.repartitionByRange("head", "h", "piece").select(
        "_own", "h", "piece", "norm", F.row_number().over(first).alias("_k"), F.first("doc_id").over(first).alias("keep_id"),
        F.count("*").over(group).alias("group_size"), F.sha2("norm", 256).alias("text_sha256"),
    )


def marked(docs: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """The ``columns`` of ``docs`` (all if not given) with keep_id, group_size, kept and text_sha256."""
    columns = [c for c in (docs.columns if columns is None else columns) if c not in FOUND]
    own = F.struct(*(F.col(f"`{c}`") for c in columns)).alias("_own")
    text = docs.select("doc_id", own, normalised(F.col("text")).alias("norm"))
    rows = saved(text.select("doc_id", "_own", "norm", F.substring("norm", 1, 64).alias("head"), F.xxhash64("norm").alias("h")))
    found = grouped(_with_pieces(rows))
    found = saved(found.withColumn("norm", F.when((F.col("piece") >= 0) & (F.col("_k") == 1), F.col("norm"))))
    # The first rows of pieces of one text, compared in full again.
    pieces = found.filter("norm is not null")
    whole = Window.partitionBy("h", "norm")
    best = whole.orderBy(F.col("keep_id").asc_nulls_last(), "piece")
    joined = pieces.select("h", "piece", "text_sha256", F.first("keep_id").over(best).alias("_keep"), F.sum("group_size").over(whole).alias("_size"), (F.row_number().over(best) == 1).alias("_here"))
    out = found.drop("norm").join(joined, ["h", "piece", "text_sha256"], "left")
    once = (F.col("_k") == 1) & F.coalesce("_here", F.lit(True))
    return out.select("_own.*", F.when(F.col("_size").isNull(), F.col("keep_id")).otherwise(F.col("_keep")).alias("keep_id"), F.coalesce("_size", "group_size").alias("group_size"), once.alias("kept"), "text_sha256")


def without_copies(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, with their columns as they are."""
    taken = docs.withColumn("_all", F.struct(*(F.col(f"`{c}`") for c in docs.columns)))
    return marked(taken, ["_all"]).filter("kept").select("_all.*")
