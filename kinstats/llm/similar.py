"""Groups of documents whose sets of word shingles are similar, on top of SimHash fingerprints and pivot tables.

``near_duplicates`` (``simhash``) links fingerprints at two bits; documents whose shingle sets have a Jaccard similarity
of 0.8 lie some ten bits apart. Here texts of equal words are one node; nodes that agree in two minima of their
shingle hashes, in one of ``bands`` draws, are candidates (a pair at 0.8 misses all ten draws once in 27,000); candidates
whose pivot distances or fingerprints, of distinct shingles, differ by more than ``max_bits`` are discarded (a pair at
0.8 does so once in 30,000), and the rest is verified on the shingle sets.

A draw that more than ``hot`` nodes share is not paired all with all. Its nodes are compared with ``sampled`` of them
first; then, with the components that these and all other links give, each node outside the draw's largest component
is compared with the nodes of other components (``crossing``). Links inside a component change nothing, so none is lost.

Defined cases: a text shorter than a shingle is one shingle; null and blank texts are equal to each other; rows of
equal doc_id stay or go together, and go only if all their texts do; texts of any length are taken whole; null ids count as the largest, each text as one of
its own; an empty table gives an empty result; columns of other names are kept.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import mixed, pieces, saved, text_bytes
from .components import components
from .simhash import distances, majority, near_in_table, pivots, shingle_hashes

LAST = (1 << 63) - 1
SKETCH = "doc long, same long, other long, fp long, draws array<long>"
#: Which bits of an id's hash are its places in a bitmap.
SHIFTS = (0, 32)


def sketches(docs: DataFrame, size: int, bands: int, seed: int = 3) -> DataFrame:
    """For each document: two hashes of its words, its fingerprint, and ``bands`` draws of two minima each."""
    factors = np.random.default_rng(seed).integers(0, 1 << 63, 2 * bands, np.uint64) | np.uint64(1)

    def run(batches):
        import xxhash

        for whole in batches:
            for batch in pieces(whole, "text", 1 << 20):
                out = [[], [], [], []]
                for text in text_bytes(batch.column(1)):
                    hashes = np.unique(np.array(shingle_hashes(text, size), np.uint64))  # a set, as the similarity is of sets
                    words = b" ".join(text.lower().split())
                    with np.errstate(over="ignore"):
                        least = np.array([(hashes * f).min() if len(hashes) else 0 for f in factors], np.uint64)
                        draws = mixed(least[0::2] * np.uint64(3) + mixed(least[1::2]) + np.arange(bands, dtype=np.uint64))
                    for column, value in zip(out, (xxhash.xxh64_intdigest(words, 1), xxhash.xxh64_intdigest(words, 2), majority(hashes), draws.view(np.int64).tolist()), strict=True):
                        column.append(value)
                signed = [pa.array(np.array(x, np.uint64).view(np.int64)) for x in out[:3]]
                yield pa.RecordBatch.from_arrays([batch.column(0), *signed, pa.array(out[3], pa.list_(pa.int64()))], ["doc", "same", "other", "fp", "draws"])

    return docs.select("doc", "text").mapInArrow(run, SKETCH)


def bitmap(ids: DataFrame, bits: int = 1 << 23) -> bytes:
    """``bits`` bits (a power of two), of which each ``doc`` of ``ids`` sets two; however many ids there are, no more reach the driver."""
    at = ids.select(F.explode(F.array(*(F.shiftright(F.xxhash64("doc"), k).bitwiseAND(F.lit(bits - 1)) for k in SHIFTS))).alias("at"))
    found = at.groupBy(F.shiftright("at", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at & 63 as int))")).alias("set")).toArrow()
    words = np.zeros(bits // 64, np.int64)
    words[found.column("word").to_numpy()] = found.column("set").to_numpy()
    return words.tobytes()


def shingle_sets(docs: DataFrame, size: int, wanted: DataFrame, bits: int = 1 << 23) -> DataFrame:
    """doc and its distinct shingles, as 32-bit hashes, of the documents that are in ``wanted``.

    Texts are not sent: each task passes over those that a bitmap of the wanted ids rules out, and of the others their
    sets meet ``wanted``, which decides.
    """
    marks = docs.sparkSession.sparkContext.broadcast(bitmap(wanted, bits))

    def run(batches):
        words = np.frombuffer(marks.value, np.int64)
        for whole in batches:
            hashes = whole.column(2).to_numpy()
            kept = np.ones(len(hashes), bool)
            for k in SHIFTS:
                at = (hashes >> k) & (bits - 1)
                kept &= (words[at >> 6] >> (at & 63)) & 1 == 1
            for batch in pieces(whole.filter(pa.array(kept)), "text", 1 << 20):
                sets = [np.unique((np.array(shingle_hashes(x, size), np.uint64) >> np.uint64(32)).astype(np.uint32)).view(np.int32) for x in text_bytes(batch.column(1))]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.list_(pa.int32()))], ["doc", "set"])

    return docs.select("doc", "text", F.xxhash64("doc").alias("hash")).mapInArrow(run, "doc long, set array<int>").join(wanted, "doc", "left_semi")


def similar(a: Column, b: Column, similarity: float) -> Column:
    """Whether two arrays of distinct items have at least that Jaccard similarity; sizes alone decide first."""
    both = F.size(F.array_intersect(a, b))
    sizes = F.least(F.size(a), F.size(b)) >= similarity * F.greatest(F.size(a), F.size(b)) - 1e-9
    return sizes & (both >= similarity * (F.size(a) + F.size(b) - both) - 1e-9)


def verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    a, b = sets.select(F.col("doc").alias("a"), F.col("set").alias("a_set")), sets.select(F.col("doc").alias("b"), F.col("set").alias("b_set"))
    return pairs.join(a, "a").join(b, "b").filter(similar(F.col("a_set"), F.col("b_set"), similarity)).select("a", "b")


def crossing(held: DataFrame, similarity: float, max_bits: int, side: int = 512) -> DataFrame:
    """(a, b): links between the nodes of a draw outside its largest component and those of other components.

    ``held`` has draw, node, fp, component, the draw's ``largest`` component, and set. About ``side`` nodes outside meet about as
    many of the draw in a task of their own; each set is looked up once in all of the others' items, not once for each of them.
    """
    tasks = 4 * int(held.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    away = F.col("component") != F.col("largest")
    work = held.groupBy("draw").agg(F.ceil(F.count_if(away) / side).cast("int").alias("outs"), F.ceil(F.count("*") / side).cast("int").alias("alls")).filter("outs > 0")
    dealt = saved(held.join(work, "draw"))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    own = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    rest = ("node", "fp", "component", "set")
    outside = dealt.filter(away).select("draw", own("outs").alias("i"), every("alls").alias("j"), *rest)
    against = dealt.select("draw", every("outs").alias("i"), own("alls").alias("j"), *rest)

    def between(key, left, right):
        a, b = [], []
        if left.num_rows and right.num_rows:
            fps, parts, nodes = (right[c].to_numpy() for c in ("fp", "component", "node"))
            values, at = np.unique(right["set"].combine_chunks().flatten().to_numpy(), return_inverse=True)
            sizes = pc.list_value_length(right["set"]).to_numpy()
            ends = np.cumsum(sizes)
            for node, fp, part, items in zip(*(left[c].to_numpy() for c in ("node", "fp", "component")), left["set"].combine_chunks(), strict=True):
                near = (parts != part) & (np.bitwise_count((fps ^ fp).view(np.uint64)) <= max_bits)
                if not near.any():
                    continue
                items = items.values.to_numpy()
                found = np.searchsorted(values, items)
                there = np.zeros(len(values) + 1, bool)
                there[found[values[np.minimum(found, len(values) - 1)] == items] if len(values) else found[:0]] = True
                shared = np.concatenate(([0], np.cumsum(there[at], dtype=np.int64)))
                both = shared[ends] - shared[ends - sizes]
                for other in nodes[near & (both >= similarity * (len(items) + sizes - both) - 1e-9)].tolist():
                    a.append(min(int(node), other))
                    b.append(max(int(node), other))
        return pa.table([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    keys = ("draw", "i", "j")
    return outside.repartition(tasks, *keys).groupBy(*keys).cogroup(against.repartition(tasks, *keys).groupBy(*keys)).applyInArrow(between, "a long, b long")


def groups(docs: DataFrame, size: int = 5, similarity: float = 0.8, bands: int = 10, max_bits: int = 22, n_pivots: int = 16, hot: int = 64, sampled: int = 8, side: int = 512) -> DataFrame:
    """(doc, node): every document and the least of its group; ``docs`` has doc and text."""
    sketched = saved(sketches(docs, size, bands))
    nodes = sketched.groupBy("same", "other").agg(F.min("doc").alias("node"), F.min_by(F.struct("fp", "draws"), "doc").alias("s"))
    drawn = nodes.select("node", "s.fp", F.explode("s.draws").alias("draw"))
    shared = saved(drawn.join(drawn.groupBy("draw").agg(F.count("*").alias("size")).filter("size > 1"), "draw"))
    references = pivots(n_pivots)
    tabled = shared.withColumn("table", distances(F.col("fp"), references))
    near = near_in_table(F.col("a.table"), F.col("b.table"), n_pivots, max_bits) & (F.bit_count(F.col("a.fp").bitwiseXOR(F.col("b.fp"))) <= max_bits)
    calm, crowded = tabled.filter(F.col("size") <= hot), tabled.filter(F.col("size") > hot)
    pairs = calm.alias("a").join(calm.alias("b"), (F.col("a.draw") == F.col("b.draw")) & (F.col("a.node") < F.col("b.node")) & near).select(F.col("a.node").alias("a"), F.col("b.node").alias("b"))
    some = crowded.groupBy("draw").agg(*(F.min_by(F.struct("node", "fp", "table"), F.xxhash64("node", F.lit(k))).alias(f"s{k}") for k in range(sampled)))
    some = some.select("draw", F.explode(F.array_distinct(F.array(*(f"s{k}" for k in range(sampled))))).alias("s")).select("draw", "s.*")
    first = crowded.alias("a").join(some.alias("b"), (F.col("a.draw") == F.col("b.draw")) & (F.col("a.node") != F.col("b.node")) & near).select(F.least("a.node", "b.node").alias("a"), F.greatest("a.node", "b.node").alias("b"))
    pairs = saved(pairs.union(first).distinct())
    wanted = saved(pairs.select(F.explode(F.array("a", "b")).alias("doc")).union(crowded.select(F.col("node").alias("doc"))).distinct())
    sets = saved(shingle_sets(docs, size, wanted).dropDuplicates(["doc"]))
    links = saved(verified(pairs, sets, similarity))
    if not crowded.isEmpty():
        held = saved(crowded.select("node", "draw", "fp", "table").join(components(links), "node", "left").withColumn("component", F.coalesce("component", "node")))
        largest = held.groupBy("draw", "component").agg(F.count("*").alias("n")).groupBy("draw").agg(F.max_by("component", F.struct("n", "component")).alias("largest"))
        held = saved(held.join(largest, "draw").join(sets.select(F.col("doc").alias("node"), "set"), "node"))
        links = saved(links.union(crossing(held, similarity, max_bits, side)))
    found = components(links)
    classes = nodes.select("same", "other", "node").join(found, "node", "left").select("same", "other", F.coalesce("component", "node").alias("node"))
    return sketched.select("doc", "same", "other").join(classes, ["same", "other"]).select("doc", "node").distinct()


def one_of_each(docs: DataFrame, size: int = 5, similarity: float = 0.8) -> DataFrame:
    """The rows of ``docs`` without those whose document is in the group of a smaller doc_id."""
    doc = F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST) - F.pmod(F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))), F.lit(1 << 40)))
    keyed = docs.select(doc.alias("doc"), F.col("text").cast("string").alias("text"))
    gone = groups(keyed, size, similarity).groupBy("doc").agg(F.min(F.col("node")).alias("node"), F.max("node").alias("last")).filter("last < doc").select(F.col("doc").alias("_gone"))
    return docs.join(gone, doc == F.col("_gone"), "left_anti")
