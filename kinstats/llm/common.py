"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import saved, shared_dir


__all__ = ["cut", "let", "mixed", "pieces", "saved", "shared_dir", "table", "text_bytes", "word_hashes"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """The same rows, written to the shared folder and without their lineage."""
    spark = df.sparkSession
    folder = shared_dir(spark)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)
    return df.checkpoint()


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once, even where ``body`` uses it inside lambdas."""
    return F.transform(F.array(value), body)[0]


def text_bytes(column: pa.ChunkedArray | pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column; null is empty."""
    binary = column.cast(pa.binary() if pa.types.is_string(column.type) else pa.large_binary())
    return [x or b"" for x in binary.to_pylist()]


def pieces(batch: pa.RecordBatch, column: str, size: int = 4 << 20):
    """Slices of ``batch`` that hold about ``size`` bytes of ``column``, one row at least."""
    lengths = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(column))), 0).to_pylist()  # no copies of the texts
    at = held = 0
    for i, n in enumerate(lengths):
        if held and held + n > size:
            yield batch.slice(at, i - at)
            at, held = i, 0
        held += n
    if at < len(lengths):
        yield batch.slice(at)


def word_hashes(words: list[bytes], cache: dict[bytes, int], limit: int = 400_000) -> np.ndarray:
    """64-bit hashes of words; ``cache`` keeps those of frequent ones."""
    import xxhash

    if len(cache) > limit:
        cache.clear()
    hashed = xxhash.xxh3_64_intdigest
    out = []
    for w in words:
        h = cache.get(w)
        if h is None:
            cache[w] = h = hashed(w)
        out.append(h)
    return np.array(out, np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit integers (the finaliser of a public 64-bit hash)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
        x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
        return x ^ (x >> np.uint64(33))
