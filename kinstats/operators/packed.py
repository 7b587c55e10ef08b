"""Genotypes packed to two bits a sample: frequencies, and relatedness of listed pairs, without unpacking to rows.

Pairs are judged in tiles, the pairs of one range of samples with another. Where a sixteenth of a tile's cells or more are
listed, one matrix product of weights, and one of what is there, gives them all; elsewhere pairs gather their two rows.
Genotypes of few variants and checked size go to all tasks, and the pairs stay where they are. Else a list of pairs of checked
length goes to all tasks, and the genotypes stay; of longer ones the tiles meet the genotypes of their two ranges in the
shuffle, and the driver sees no pair.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..storage import saved
from .grm import counted, divided, how, listed_again, usable, varies
from .pairs import with_people

#: Two-bit codes 0 to 3 as copies of A1; -1 is missing.
CODES = np.array([2, -1, 1, 0], np.int8)
#: A byte of four missing samples.
NONE = 0x55
_FOUR = CODES[(np.arange(256)[:, None] >> np.arange(0, 8, 2)) & 3].astype(np.int64)
#: For each byte, the copies of A1 in its four samples and how many of them are there.
COPIES, SEEN = np.where(_FOUR < 0, 0, _FOUR).sum(1), (_FOUR >= 0).sum(1)
#: One in so many cells of a tile must be listed for a matrix product.
DENSE = 16
PARTIAL = "idx1 int, idx2 int, n long, s double"
#: Up to so many variants, and so many bytes of packed rows, genotypes go to all tasks.
FEW_VARIANTS, ALL_BYTES = 4096, 32 << 20
#: So many pairs are judged at once by a task that holds all genotypes.
PAIRS_AT_ONCE = 1 << 18
#: Places on a side of the tiles that a task cuts its pairs into; a tile of sums has the square of it at most.
TILE_WIDTH = 1024


def pack_genotypes(genotypes: DataFrame, samples: int) -> DataFrame:
    """(variant_id, codes) from long genotypes with sample places 0 to ``samples`` - 1: four samples a byte, low bits first.

    A sample without a row for a variant is missing there; one with several rows, or with a place beyond the last, is an
    error. Bytes are put together per variant and quarter of a byte before any row is gathered.
    """
    code = F.when(F.col("a1").isNull(), 1).when(F.col("a1") == 2, 0).when(F.col("a1") == 1, 2).otherwise(3)
    shift = F.pow(F.lit(4), F.col("sample_idx") % 4)
    place = F.when((F.col("sample_idx") >= 0) & (F.col("sample_idx") < samples), F.col("sample_idx")).otherwise(F.raise_error(F.concat(F.lit("no place among the samples: "), F.coalesce(F.col("sample_idx").cast("string"), F.lit("null")))).cast("int"))
    parts = genotypes.select("variant_id", F.floor(place / 4).cast("int").alias("byte"), (code * shift).cast("int").alias("bits"), (3 * shift).cast("int").alias("there"))
    once = F.when(F.sum("there") == F.bit_or("there"), F.sum("bits")).otherwise(F.raise_error(F.concat(F.lit("a sample has several genotypes of variant "), F.any_value("variant_id").cast("string"))).cast("int"))
    bytes_ = parts.groupBy("variant_id", "byte").agg(once.cast("int").alias("value"), F.bit_or("there").alias("there"))
    width = -(-samples // 4)

    def lay(key, rows):
        out = np.full(width, NONE, np.uint8)
        at, there = rows["byte"].to_numpy(), rows["there"].to_numpy().astype(np.uint8)
        out[at] = (out[at] & ~there) | rows["value"].to_numpy().astype(np.uint8)
        return pa.table({"variant_id": pa.array([key[0].as_py()], pa.int32()), "codes": pa.array([out.tobytes()], pa.binary())})

    return bytes_.groupBy("variant_id").applyInArrow(lay, "variant_id int, codes binary")


def unpack_genotypes(packed: DataFrame, samples: int) -> DataFrame:
    """(variant_id, sample_idx, a1) from packed rows: null where missing."""
    everyone = np.arange(samples)

    def run(batches):
        for batch in batches:
            for variant, codes in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                a1 = decode(matrix([codes]), everyone)[0]
                yield pa.RecordBatch.from_arrays([pa.array([variant] * samples, pa.int32()), pa.array(everyone, pa.int32()), pa.array(a1.astype(np.int32), mask=a1 < 0)], ["variant_id", "sample_idx", "a1"])

    return packed.select("variant_id", "codes").mapInArrow(run, "variant_id int, sample_idx int, a1 int")


def matrix(rows: list[bytes]) -> np.ndarray:
    """Packed rows of one length, one below the other."""
    if len({len(x) for x in rows}) > 1:
        raise ValueError("packed rows differ in length")
    return np.frombuffer(b"".join(rows), np.uint8).reshape(len(rows), -1)


def decode(packed: np.ndarray, samples: np.ndarray) -> np.ndarray:
    """Copies of A1 (variant x sample; -1 missing) of the given samples."""
    return CODES[(packed[:, samples // 4] >> (2 * (samples % 4)).astype(np.uint8)) & 3]


def allele_counts(packed: np.ndarray, samples: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each packed row, the copies of A1 and the samples that are there, by a table of all bytes; what the last byte has beyond the last sample does not count."""
    full, rest = divmod(samples, 4)
    if packed.shape[1] != full + bool(rest):
        raise ValueError(f"rows of {packed.shape[1]} bytes do not hold {samples} samples")
    copies, seen = COPIES[packed[:, :full]].sum(1), SEEN[packed[:, :full]].sum(1)
    if rest:
        last = (packed[:, -1] & ((1 << 2 * rest) - 1)) | (NONE & ~((1 << 2 * rest) - 1) & 0xFF)
        copies, seen = copies + COPIES[last], seen + SEEN[last]
    return copies, seen


def with_own_freqs(packed: DataFrame, samples: int) -> DataFrame:
    """``packed`` (variant_id, codes) with ``p``, the frequency of A1 among the samples that are there (null without any), and their number ``n_obs``: no row moves."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                copies, seen = allele_counts(matrix(batch.column(1).to_pylist()), samples)
                p = copies / np.maximum(2 * seen, 1)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(p, mask=seen == 0), pa.array(seen)], ["variant_id", "codes", "p", "n_obs"])

    narrow = packed.select(F.col("variant_id").cast("int").alias("variant_id"), "codes")
    return narrow.mapInArrow(run, "variant_id int, codes binary, p double, n_obs long")


def allele_freqs_packed(packed: DataFrame, samples: int) -> DataFrame:
    """As ``allele_freqs``, from packed rows of ``samples`` samples: variant_id, freq and n_obs."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                copies, seen = allele_counts(matrix(batch.column(1).to_pylist()), samples)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(copies / np.maximum(2 * seen, 1), mask=seen == 0), pa.array(seen)], ["variant_id", "freq", "n_obs"])

    return packed.select(F.col("variant_id").cast("int").alias("variant_id"), "codes").mapInArrow(run, "variant_id int, freq double, n_obs long")


def distinct(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different values in order, and which of them each value is; without sorting where the values lie close together."""
    low, last = (int(values.min()), int(values.max())) if len(values) else (0, 0)
    if last - low > 8 * len(values) + 1024:
        return np.unique(values, return_inverse=True)
    there = np.zeros(last - low + 1, bool)
    there[values - low] = len(values) > 0
    return np.flatnonzero(there).astype(values.dtype) + low, (np.cumsum(there, dtype=np.int32) - 1)[values - low]


class Tile:
    """Sums of the pairs (rows of ``listed``, places in the weights that ``add`` gets) over all variants that are added."""

    def __init__(self, listed: np.ndarray, count: bool, at_once: int = 1 << 14):
        self.rows, self.i = distinct(listed[:, 0])
        self.cols, self.j = distinct(listed[:, 1])
        self.listed, self.count, self.at_once = listed, count, at_once
        self.dense = DENSE * len(listed) >= len(self.rows) * len(self.cols)
        shape = (len(self.rows), len(self.cols)) if self.dense else len(listed)
        self.total, self.n, self.whole = np.zeros(shape), np.zeros(shape if count else 0, np.int32), 0

    def add(self, w: np.ndarray, there: np.ndarray | None) -> None:
        """``w``: weights (sample x variant, 0 where missing); ``there``: whether a genotype is there, None if all are."""
        self.whole += w.shape[1] if there is None else 0
        if self.dense:
            self.total += w[self.rows] @ w[self.cols].T
            if self.count and there is not None:
                here = there.astype(np.float32)
                self.n += (here[self.rows] @ here[self.cols].T).astype(np.int32)
            return
        for c in range(0, len(self.listed), self.at_once):
            i, j = self.listed[c : c + self.at_once].T
            self.total[c : c + self.at_once] += np.einsum("pv,pv->p", w[i], w[j])
            if self.count and there is not None:
                self.n[c : c + self.at_once] += (there[i] & there[j]).sum(1)

    def sums(self) -> tuple[np.ndarray, np.ndarray]:
        """(n, s) of the listed pairs; n is 0 where it was not to be counted."""
        at = (self.i, self.j) if self.dense else slice(None)
        n = self.n[at].astype(np.int64) + self.whole if self.count else np.zeros(len(self.listed), np.int64)
        return n, self.total[at]


def weigh(codes: np.ndarray, p: np.ndarray, samples: np.ndarray, tiles: list[Tile], at_once: int = 1 << 22) -> None:
    """Adds packed rows with frequencies ``p`` to all tiles; few variants at a time where samples are many."""
    some = max(4, min(64, at_once // max(1, len(samples))))
    for b in range(0, len(codes), some):
        own = p[b : b + some, None]
        a1 = decode(codes[b : b + some], samples)
        there = a1 >= 0
        # One row a sample, so that a pair's two rows are read whole.
        w = np.ascontiguousarray(np.where(there, (a1 - 2 * own) / np.sqrt(2 * own * (1 - own)), 0.0).T)
        there = None if there.all() else np.ascontiguousarray(there.T)
        for tile in tiles:
            tile.add(w, there)


def _partials(listed: np.ndarray, n: np.ndarray, s: np.ndarray):
    for c in range(0, len(listed), 1 << 16):
        part = slice(c, c + (1 << 16))
        yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(listed[part, 0]), pa.int32()), pa.array(np.ascontiguousarray(listed[part, 1]), pa.int32()), pa.array(n[part]), pa.array(s[part])], ["idx1", "idx2", "n", "s"])


def in_tiles(listed: np.ndarray, width: int) -> list[np.ndarray]:
    """``listed`` (places among the samples) cut into tiles of ``width`` places."""
    if not len(listed):
        return []
    key = (listed[:, 0] // width).astype(np.int64) << 32 | (listed[:, 1] // width).astype(np.int64)
    order = np.argsort(key, kind="stable")
    cuts = np.flatnonzero(np.diff(key[order])) + 1
    return [listed[x] for x in np.split(order, cuts)]


def _with_all_pairs(pairs: DataFrame, rows: DataFrame, count: bool, width: int) -> DataFrame:
    """Partial sums where each task holds all pairs; their number has been checked."""
    shared = pairs.sparkSession.sparkContext.broadcast(pairs.toPandas().to_numpy(np.int32).reshape(-1, 2))

    def run(batches):
        samples, at = np.unique(shared.value, return_inverse=True)
        tiles = [Tile(x, count) for x in in_tiles(at.reshape(-1, 2), width)]
        for batch in batches:
            if batch.num_rows:
                weigh(matrix(batch.column(1).to_pylist()), batch.column(2).to_numpy(), samples, tiles)
        for tile in tiles:
            yield from _partials(samples[tile.listed], *tile.sums())

    return rows.select("variant_id", "codes", "p").mapInArrow(run, PARTIAL)


def one_tile(codes: np.ndarray, p: np.ndarray, listed: np.ndarray, count: bool) -> tuple[np.ndarray, np.ndarray]:
    """(n, s) of the pairs ``listed``, places among the samples of ``codes``."""
    samples, place = distinct(listed.ravel())
    tile = Tile(place.reshape(-1, 2), count)
    weigh(codes, p, samples, [tile], 1 << 20)
    return tile.sums()


def tiled_sums(codes: np.ndarray, p: np.ndarray, listed: np.ndarray, count: bool) -> tuple[np.ndarray, np.ndarray]:
    """As ``one_tile``, for any number of pairs: in tiles of ``TILE_WIDTH`` places, so that no more than a tile's sums are held."""
    n, s = np.zeros(len(listed), np.int64), np.zeros(len(listed))
    key = (listed[:, 0] // TILE_WIDTH).astype(np.int64) << 32 | (listed[:, 1] // TILE_WIDTH).astype(np.int64)
    order = np.argsort(key, kind="stable")
    for part in np.split(order, np.flatnonzero(np.diff(key[order])) + 1):
        for c in range(0, len(part), TILE_WIDTH * TILE_WIDTH):
            at = part[c : c + TILE_WIDTH * TILE_WIDTH]
            n[at], s[at] = one_tile(codes, p, listed[at], count)
    return n, s


def places(table: pa.Table | pa.RecordBatch) -> np.ndarray:
    """The columns idx1 and idx2 side by side; a null or negative place is an error."""
    out = np.stack([pc.fill_null(table[c], -1).to_numpy(zero_copy_only=False) if isinstance(table, pa.RecordBatch) else pc.fill_null(table[c], -1).to_numpy() for c in ("idx1", "idx2")], 1)
    if (out < 0).any():
        raise ValueError("pairs have places that are null or below zero")
    return out


def held(rows: DataFrame) -> pa.Table | None:
    """``rows`` (variant_id, codes, p) in order of variants, if they are few and small enough to go to all tasks; of others no more than ``FEW_VARIANTS`` are looked at."""
    some = saved(rows.limit(FEW_VARIANTS + 1))
    n, size = some.agg(F.count("*"), F.sum(F.octet_length("codes"))).first()
    return some.toArrow().sort_by("variant_id") if n <= FEW_VARIANTS and (size or 0) <= ALL_BYTES else None


def in_blocks(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.Table]:
    """The batches put together to ``rows`` rows or somewhat more."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= rows:
            yield pa.Table.from_batches(held)
            held, n = [], 0
    if n:
        yield pa.Table.from_batches(held)


def _with_all_genotypes(pairs: DataFrame, rows: pa.Table, mean: bool, n: int) -> DataFrame:
    """``pairs`` (idx1, idx2 and others) with n_snps and grm, where each task holds all genotypes: no pair is shuffled, and one that is listed again is judged again."""
    shared = pairs.sparkSession.sparkContext.broadcast((matrix(rows["codes"].to_pylist()), rows["p"].to_numpy()) if len(rows) else None)
    names = [*pairs.columns, "n_snps", "grm"]

    def run(batches):
        codes, p = shared.value or (np.zeros((0, 0), np.uint8), np.zeros(0))
        for block in in_blocks(batches, PAIRS_AT_ONCE):
            listed = places(block)
            # A sample beyond the last has no genotype.
            known = (listed < 4 * codes.shape[1]).all(1)
            count, total = np.zeros(len(listed), np.int64), np.zeros(len(listed))
            if known.all():
                count, total = one_tile(codes, p, listed, not mean)
            elif known.any():
                count[known], total[known] = one_tile(codes, p, listed[known], not mean)
            if mean:
                count[:] = n
            out = block.append_column("n_snps", pa.array(count)).append_column("grm", pa.array(total / np.maximum(count, 1), mask=count == 0))
            yield from out.combine_chunks().to_batches(max_chunksize=1 << 16)

    return pairs.mapInArrow(run, T.StructType([*pairs.schema.fields, T.StructField("n_snps", T.LongType()), T.StructField("grm", T.DoubleType())])).select(*names)


def numbered(ids: DataFrame) -> DataFrame:
    """``ids`` (one column, each value once) with ``place``, from 0; only partitions' sizes meet on the driver."""
    name = ids.columns[0]
    parted = saved(ids.withColumn("_part", F.spark_partition_id()))
    at, starts = 0, []
    for part, n in sorted(map(tuple, parted.groupBy("_part").count().collect())):
        starts.append((part, at))
        at += n
    starts = parted.sparkSession.createDataFrame(starts, "_part int, _start int")
    return saved(parted.withColumn("_k", F.row_number().over(Window.partitionBy("_part").orderBy(name))).join(F.broadcast(starts), "_part").select(name, (F.col("_start") + F.col("_k") - 1).cast("int").alias("place")))


def grm_from_few(pairs: DataFrame, genotypes: DataFrame, freqs: DataFrame, n: int | None) -> DataFrame | None:
    """What ``grm_for_pairs`` gives, from packed rows that go to all tasks: a join on people for either side, none of variants.

    None if there are too many variants or samples for that, if a genotype is no number of copies from 0 to 2, or if a
    sample has several of a variant. ``n``: what all sums are divided by.
    """
    spark = pairs.sparkSession
    there = genotypes.filter("a1 is not null").select("sample_id", "variant_id", "a1")
    known = there.select("variant_id").distinct().join(usable(freqs).select("variant_id", F.col("p").cast("double").alias("p")), "variant_id").limit(FEW_VARIANTS + 1).collect()
    if len(known) > FEW_VARIANTS or len({x["variant_id"] for x in known}) < len(known):
        return None
    people = numbered(there.select("sample_id").distinct())
    samples = people.count()
    if len(known) * -(-samples // 4) > ALL_BYTES:
        return None
    copies = F.coalesce(F.col("a1").isin(0, 1, 2), F.lit(False))
    if there.groupBy("sample_id", "variant_id").agg(F.count("*").alias("n"), F.bool_and(copies).alias("copies")).filter("n > 1 or not copies").limit(1).collect():
        return None
    order = spark.createDataFrame([(x["variant_id"], k) for k, x in enumerate(known)], T.StructType([there.schema["variant_id"], T.StructField("v", T.IntegerType())]))
    long = there.join(F.broadcast(order), "variant_id").join(people, "sample_id").select(F.col("v").alias("variant_id"), F.col("place").alias("sample_idx"), "a1")
    p = [x["p"] for x in known]
    rows = pack_genotypes(long, samples).toArrow().sort_by("variant_id") if known else pa.table({"variant_id": pa.array([], pa.int32()), "codes": pa.array([], pa.binary())})
    rows = rows.append_column("p", pa.array([p[k] for k in rows["variant_id"].to_pylist()], pa.float64()))
    found = with_people(pairs.select(F.col("id1").alias("iid1"), F.col("id2").alias("iid2")), people.withColumnRenamed("sample_id", "iid"), ["place"])
    # Who has no genotype has a place beyond the last.
    place = lambda c: F.coalesce(c, F.lit((1 << 31) - 1))
    found = found.select(place("_a0").alias("idx1"), place("_b0").alias("idx2"), F.col("iid1").alias("id1"), F.col("iid2").alias("id2"))
    return _with_all_genotypes(found, rows, n is not None, n or 0).select("id1", "id2", "n_snps", "grm")


def block_width(n_pairs: int, samples: int, group_bytes: int) -> int:
    """Samples in a range, a multiple of four: as many that tiles are sent about as many bytes of pairs as of genotypes.

    With wide ranges, fewer tiles ask for the same genotypes, but a tile's variants fill more groups, each of which asks for
    all of its pairs.
    """
    wanted = samples * (group_bytes / (16 * max(1, n_pairs))) ** 0.5
    return 4 * max(1, -(-int(min(max(wanted, 256), max(samples, 4))) // 4))


#: Bytes a value of the steps between the pairs of a list, by kind.
_STEPS = (np.uint8, np.uint16, np.uint32, np.uint64)
LISTS = "block1 int, block2 int, part int, n long, kind int, steps binary"


def as_list(keys: np.ndarray) -> tuple[int, bytes]:
    """Sorted numbers as compressed steps, which are few bits each where numbers lie close together, and the steps' kind."""
    steps = np.diff(keys, prepend=0)
    kind = next(k for k, t in enumerate(_STEPS) if not len(steps) or int(steps.max()) <= np.iinfo(t).max)
    return kind, pa.compress(steps.astype(_STEPS[kind]).tobytes(), "zstd", asbytes=True)


def from_list(n: int, kind: int, steps: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(pa.decompress(steps, n * np.dtype(_STEPS[kind]).itemsize, "zstd"), _STEPS[kind]), dtype=np.int64)


def rows_a_list(width: int) -> int:
    """So many first samples a list has pairs of, so that there are some millions of different ones at most."""
    return max(1, min(width, (1 << 22) // width))


def in_lists(pairs: DataFrame, width: int) -> DataFrame:
    """``pairs`` (idx1, idx2) as compressed lists, by tile of ``width`` places and part of its first samples: a byte or so a pair where tiles are full.

    A pair is there as often as it is listed, in some order.
    """
    high = rows_a_list(width)

    def run(batches):
        for block in in_blocks(batches, 4 * PAIRS_AT_ONCE):
            listed = places(block).astype(np.int64)
            one, two = listed[:, 0] // width, listed[:, 1] // width
            # First samples in order of their tiles and parts: what a list holds lies together.
            order = np.lexsort((listed[:, 1], listed[:, 0], two))
            listed, one, two = listed[order], one[order], two[order]
            own = listed[:, 0] % width
            part = own // high
            heads = np.flatnonzero(np.concatenate(([True], (np.diff(one) != 0) | (np.diff(two) != 0) | (np.diff(part) != 0))))
            keys, ends, out = own * width + listed[:, 1] % width, np.append(heads[1:], len(own)), []
            for a, b in zip(heads.tolist(), ends.tolist(), strict=True):
                out.append((int(one[a]), int(two[a]), int(part[a]), b - a, *as_list(keys[a:b])))
            for c in range(0, len(out), 4096):
                yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out[c : c + 4096]], t) for k, t in enumerate((pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.binary()))], ["block1", "block2", "part", "n", "kind", "steps"])

    return pairs.select("idx1", "idx2").mapInArrow(run, LISTS)


def listed_in(lists: pa.Table, width: int) -> np.ndarray:
    """The pairs of some lists of one tile as keys, sorted: the first sample's place in its range times ``width`` and the second's."""
    columns = [lists[c].to_pylist() for c in ("n", "kind", "steps")]
    return np.sort(np.concatenate([np.zeros(0, np.int64), *(from_list(*x) for x in zip(*columns, strict=True))]), kind="stable")


def pairs_once(pairs: DataFrame, width: int = 1 << 12) -> DataFrame:
    """(idx1, idx2) of each pair of ``pairs`` once, whichever way round and however often it is listed, the smaller place first.

    Lists of pairs are compressed before they are shuffled.
    """
    turned = F.col("idx1") > F.col("idx2")
    ordered = pairs.select(*(F.when(turned, F.col(b)).otherwise(F.col(a)).cast("int").alias(a) for a, b in (("idx1", "idx2"), ("idx2", "idx1"))))

    def once(key, lists):
        keys = np.unique(listed_in(lists, width))
        return pa.table([pa.array((keys // width + key[0].as_py() * width).astype(np.int32)), pa.array((keys % width + key[1].as_py() * width).astype(np.int32))], names=["idx1", "idx2"])

    return in_lists(ordered, width).groupBy("block1", "block2", "part").applyInArrow(once, "idx1 int, idx2 int")


def _by_sample_ranges(pairs: DataFrame, rows: DataFrame, count: bool, samples_a_block: int, group_bytes: int, tile_pairs: int) -> DataFrame:
    """idx1, idx2, n_snps and s of every listed pair, where the pairs of two ranges of samples meet the genotypes of these, some variants at a time.

    Pairs are shuffled as compressed lists. Tiles of more than ``tile_pairs`` pairs are dealt in pieces by their first samples.
    """
    width = samples_a_block // 4
    parts = max(1, -(-rows.count() * 2 * width // group_bytes))
    lists = saved(in_lists(pairs, samples_a_block))
    # As many rows as there are pairs of ranges with pairs.
    tiles = saved(lists.groupBy("block1", "block2").agg(F.least(F.ceil(F.sum("n") / tile_pairs), F.count_distinct("part")).cast("int").alias("pieces")))

    def ranges(batches):
        for batch in batches:
            out = []
            for variant, codes, p in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                out += [(k, variant, codes[at : at + width], p) for k, at in enumerate(range(0, len(codes), width))]
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], t) for k, t in enumerate((pa.int32(), pa.int32(), pa.binary(), pa.float64()))], ["block", "variant_id", "codes", "p"])

    cut = rows.select("variant_id", "codes", "p").mapInArrow(ranges, "block int, variant_id int, codes binary, p double")
    wanted = tiles.select(F.col("block1").alias("low"), F.col("block2").alias("high"), F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)).alias("some"), F.array_distinct(F.array("block1", "block2")).alias("both"))
    needed = cut.join(wanted.withColumn("block", F.explode("both")).drop("both"), "block").withColumn("share", F.pmod(F.xxhash64("variant_id"), F.lit(parts)))
    dealt = lists.join(tiles, ["block1", "block2"]).withColumn("piece", F.pmod("part", "pieces")).withColumn("share", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))))

    def add(key, left, right):
        keys, times = np.unique(listed_in(left, samples_a_block), return_counts=True)
        listed = np.stack((keys // samples_a_block, keys % samples_a_block), 1)
        n, s = np.zeros(len(listed), np.int64), np.zeros(len(listed))
        one, two = (right.filter(pc.equal(right["block"], k)).sort_by("variant_id") for k in key[:2])
        if len(listed) and one.num_rows and two.num_rows:
            pad = bytes([NONE])
            codes = [a.ljust(width, pad) + b.ljust(width, pad) for a, b in zip(one["codes"].to_pylist(), two["codes"].to_pylist(), strict=True)]
            n, s = tiled_sums(matrix(codes), one["p"].to_numpy(), listed + np.array([0, samples_a_block]), count)
        whole = listed + np.array([[x.as_py() * samples_a_block for x in key[:2]]]) if len(listed) else listed
        columns = [whole[:, 0].astype(np.int32), whole[:, 1].astype(np.int32), times, n, s]
        return pa.table([pa.array(np.ascontiguousarray(x)) for x in columns], names=["idx1", "idx2", "_times", "n", "s"])

    sums = dealt.groupBy("block1", "block2", "piece", "share").cogroup(needed.groupBy("low", "high", "some", "share")).applyInArrow(add, "idx1 int, idx2 int, _times long, n long, s double")
    if parts == 1:
        return listed_again(sums.select("idx1", "idx2", "_times", F.col("n").alias("n_snps"), "s"))
    return listed_again(sums.groupBy("idx1", "idx2").agg(F.max("_times").alias("_times"), F.sum("n").alias("n_snps"), F.sum("s").alias("s")))


def grm_from_packed(pairs: DataFrame, packed: DataFrame, freqs: DataFrame | None = None, samples: int | None = None, missing: str = "exclude", max_pairs: int = 2_000_000, samples_a_block: int | None = None, group_bytes: int = 64 << 20, keep: tuple[str, ...] = (), tile_pairs: int = 1 << 20) -> DataFrame:
    """As ``grm_for_pairs``, for pairs of sample places (idx1, idx2) and packed genotypes (variant_id, codes); with the columns ``keep`` of ``pairs``.

    Without ``freqs``, frequencies are those of the ``samples`` samples that the rows hold, found as the rows are read.
    Genotypes of few variants and bytes (``held``) go to all tasks, unless ``samples_a_block`` asks for ranges of samples. Else up
    to ``max_pairs`` different pairs (8 bytes each) go to all tasks; more are dealt by ranges of samples, whose width follows
    from the numbers of pairs and samples (``block_width``) unless ``samples_a_block``, a multiple of four, gives it.
    """
    pairs = pairs.select(F.col("idx1").cast("int").alias("idx1"), F.col("idx2").cast("int").alias("idx2"), *keep)
    if freqs is None:
        if samples is None:
            raise ValueError("without frequencies the number of samples is needed")
        rows = with_own_freqs(packed, samples).filter(varies(F.col("p"))).select("variant_id", "codes", "p")
    else:
        rows = packed.join(usable(freqs).select("variant_id", "p"), "variant_id").select("variant_id", "codes", "p")
    mean = how(missing)
    if samples_a_block is None and (whole := held(rows)) is not None:
        return _with_all_genotypes(pairs, whole, mean, len(whole))
    n = rows.count() if mean else None
    listed, size = pairs.select("idx1", "idx2"), None
    if max_pairs or samples_a_block is None:
        listed = saved(listed)
        size = listed.agg(F.count("*").alias("n"), F.max(F.greatest("idx1", "idx2")).alias("last")).first()
    width = samples_a_block or block_width(size["n"], (size["last"] or 0) + 1, group_bytes)
    if size and size["n"] <= max_pairs:
        some = saved(counted(listed, "idx1", "idx2"))
        sums = _with_all_pairs(some.select("idx1", "idx2"), rows, not mean, width).groupBy("idx1", "idx2").agg(F.sum("n").alias("n_snps"), F.sum("s").alias("s"))
        found = listed_again(some.join(sums, ["idx1", "idx2"], "left"))
    else:
        found = _by_sample_ranges(listed, rows, not mean, width, group_bytes, tile_pairs)
    found = divided(found, n).select("idx1", "idx2", "n_snps", "grm")
    return pairs.join(found.dropDuplicates(["idx1", "idx2"]), ["idx1", "idx2"]).select(*pairs.columns, "n_snps", "grm") if keep else found
