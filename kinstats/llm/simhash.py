"""Near-duplicates by SimHash, with tables of distances to pivots.

``fingerprints`` gives every document the SimHash of its word shingles. ``fingerprint_links`` finds all pairs of distinct
fingerprints that differ in few bits: two such fingerprints agree in all but ``max_bits`` of the blocks they are cut
into, which gives the keys of an equi-join; of the pairs that meet there, those whose distances to some pivot differ by
more than ``max_bits`` are discarded (their own distance cannot be smaller), and the rest is verified bit by bit. Where
a key is shared by more than ``hot`` fingerprints, its members are linked through neighbours at one bit instead: two
fingerprints at two bits or fewer have one in common, and all that share a neighbour are that close; the least of them
stands for all, so a group of any size gives rows in proportion.

Defined cases: a null or blank text has fingerprint zero and links like any other; equal fingerprints are one node;
texts of any length are hashed whole, some 65,000 shingles at a time; repeated rows are documents of equal fingerprint; a null doc_id gets the component of its fingerprint, and is null only
where all ids of that are; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, pieces, text_bytes
from .components import components

SEED = 42


def shingle_hashes(text: bytes, size: int) -> list[int]:
    """XXH64 of all shingles of ``size`` words (A-Z lowered, joined by spaces); of the whole sequence where it is shorter."""
    from xxhash import xxh64_intdigest

    words = text.lower().split()
    if not words:
        return []
    joined = b" ".join(words)
    starts, at = [], 0
    for w in words:
        starts.append(at)
        at += len(w) + 1
    last = max(0, len(words) - size)
    ends = [*starts[size:], at] if last else [at]
    return [xxh64_intdigest(joined[i : j - 1], SEED) for i, j in zip(starts[: last + 1], ends, strict=True)]


def majority(hashes: np.ndarray) -> int:
    """64 bits, each set if over half of the hashes have it."""
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        some = hashes[at : at + (1 << 16)]
        counts += np.unpackbits(some.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, size: int = 3) -> DataFrame:
    """doc_id and the fingerprint as a signed long."""

    def run(batches):
        for whole in batches:
            for batch in pieces(whole, "text"):
                found = [majority(np.array(shingle_hashes(x, size), np.uint64)) for x in text_bytes(batch.column(1))]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.array(found, np.uint64).view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, fp long")


def pivots(n: int, seed: int = 11) -> list[int]:
    """Reference fingerprints."""
    return np.random.default_rng(seed).integers(-(1 << 63), (1 << 63) - 1, n, np.int64).tolist()


def distances(fp: Column, references: list[int]) -> Column:
    """The row of the pivot table."""
    return F.array(*(F.bit_count(fp.bitwiseXOR(F.lit(p))).cast("byte") for p in references))


def near_in_table(a: Column, b: Column, n: int, most: int) -> Column:
    """No coordinate differs by more than ``most``."""
    out = F.lit(True)
    for k in range(n):
        out = out & (F.abs(a[k] - b[k]) <= most)
    return out


def block_keys(fp: Column, max_bits: int, blocks: int) -> Column:
    """All choices of ``blocks - max_bits`` of the blocks that ``fp`` is cut into, as (choice, bits) in one long."""
    cuts = np.linspace(0, 64, blocks + 1).astype(int)
    masks = []
    for chosen in combinations(range(blocks), blocks - max_bits):
        mask = sum(((1 << (cuts[k + 1] - cuts[k])) - 1) << int(cuts[k]) for k in chosen)
        masks.append(int(np.uint64(mask).view(np.int64)) if mask >= 1 << 63 else int(mask))
    return F.array(*(F.struct(F.lit(k).alias("choice"), fp.bitwiseAND(F.lit(m)).alias("bits")) for k, m in enumerate(masks)))


def fingerprint_links(nodes: DataFrame, max_bits: int = 2, blocks: int = 4, n_pivots: int = 16, hot: int = 64) -> DataFrame:
    """Links (a, b) between ``node`` of fingerprints ``fp`` (distinct) of at most ``max_bits`` (2 or fewer) differing bits:
    all of them, but for those in crowded keys, where the least fingerprint at one bit stands between."""
    if max_bits > 2:
        raise ValueError("neighbours at one bit link fingerprints at two bits or fewer")
    references = pivots(n_pivots)
    keyed = nodes.select("node", "fp", F.explode(block_keys(F.col("fp"), max_bits, blocks)).alias("key")).select("node", "fp", "key.choice", "key.bits")
    sizes = keyed.groupBy("choice", "bits").agg(F.count("*").alias("size")).filter("size > 1")
    shared = cut(keyed.join(sizes, ["choice", "bits"]))
    calm = shared.filter(F.col("size") <= hot).withColumn("table", distances(F.col("fp"), references))
    a, b = calm.alias("a"), calm.alias("b")
    near = near_in_table(F.col("a.table"), F.col("b.table"), n_pivots, max_bits)
    pairs = a.join(b, (F.col("a.choice") == F.col("b.choice")) & (F.col("a.bits") == F.col("b.bits")) & (F.col("a.fp") < F.col("b.fp")) & near)
    pairs = pairs.filter(F.bit_count(F.col("a.fp").bitwiseXOR(F.col("b.fp"))) <= max_bits).select(F.col("a.node").alias("a"), F.col("b.node").alias("b"))
    crowded = shared.filter(F.col("size") > hot).select("node", "fp").distinct()
    flips = [0] + [int(np.uint64(1 << k).view(np.int64)) for k in range(64)] if max_bits == 2 else [0]
    around = crowded.select("node", F.explode(F.array(*(F.col("fp").bitwiseXOR(F.lit(x)) for x in flips))).alias("at"))
    least = around.groupBy("at").agg(F.min("node").alias("least"), F.count("*").alias("size")).filter("size > 1")
    stars = around.join(least, "at").filter("node <> least").select(F.col("node").alias("a"), F.col("least").alias("b"))
    if max_bits == 1:
        stars = crowded.select("node", "fp", F.explode(F.array(*(F.col("fp").bitwiseXOR(F.lit(1 << k if k < 63 else -(1 << 63))) for k in range(64)))).alias("at")).join(crowded.select(F.col("node").alias("b"), F.col("fp").alias("at")), "at").select(F.col("node").alias("a"), "b")
    return pairs.union(stars).distinct()


def near_duplicates(docs: DataFrame, size: int = 3, max_bits: int = 2) -> DataFrame:
    """doc_id, fingerprint (hexadecimal) and component_id of every row."""
    marked = cut(fingerprints(docs, size))
    nodes = cut(marked.groupBy("fp").agg(F.min("doc_id").alias("node")))
    # A fingerprint whose ids are all null has no node; it takes no part in components.
    found = components(fingerprint_links(nodes.filter("node is not null"), max_bits))
    classes = nodes.join(found, "node", "left").select("fp", F.coalesce("component", "node").alias("component_id"))
    return marked.join(classes, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
