"""Documents in compressed blocks, and what blocks and buckets send each other, on numpy arrays."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .common import text_bytes

SENT = "bucket int, block long, step int, data binary"


def squeezed(*arrays: np.ndarray) -> bytes:
    """Arrays of one length, byte plane by byte plane, compressed."""
    import zstandard

    n = len(arrays[0])
    planes = [np.ascontiguousarray(x).view(np.uint8).reshape(n, x.itemsize).T.tobytes() for x in arrays]
    return zstandard.compress(n.to_bytes(8, "little") + b"".join(planes), 3)


def unsqueezed(data: bytes, *kinds: str) -> list[np.ndarray]:
    import zstandard

    data = zstandard.decompress(data)
    n, at, out = int.from_bytes(data[:8], "little"), 8, []
    for kind in map(np.dtype, kinds):
        size = n * kind.itemsize
        out.append(np.ascontiguousarray(np.frombuffer(data, np.uint8, size, at).reshape(kind.itemsize, n).T).view(kind).ravel())
        at += size
    return out


def steps(x: np.ndarray) -> np.ndarray:
    """Differences of numbers in order."""
    return np.diff(x, prepend=x.dtype.type(0))


def packed(docs: DataFrame, bytes_a_block: int) -> DataFrame:
    """(block, data): rows of documents (doc, doc_id, text) put together to blocks, as they come."""
    import zstandard

    def run(batches):
        held, size, k = [], 0, 0
        part = TaskContext.get().partitionId() << 32

        def block():
            doc = np.array([x[0] for x in held], np.int64)
            named = np.array([x[1] is not None for x in held], np.uint8)
            lengths = np.array([len(x[2]) for x in held], np.int64)
            head = squeezed(doc, named, lengths)
            body = zstandard.compress(b"".join([x[2] for x in held]), 3)
            return pa.RecordBatch.from_arrays([pa.array([part + k]), pa.array([len(head).to_bytes(8, "little") + head + body], pa.binary())], ["block", "data"])

        for batch in batches:
            for row in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), text_bytes(batch.column(2)), strict=True):
                held.append(row)
                size += len(row[2]) + 16
                if size >= bytes_a_block:
                    yield block()
                    held, size, k = [], 0, k + 1
        if held:
            yield block()

    return docs.select("doc", "doc_id", "text").mapInArrow(run, "block long, data binary")


class Block:
    """Documents of a block: ids, whether they have one, lengths, and the texts end to end."""

    def __init__(self, rows):
        import zstandard

        data = rows["data"][0].as_py()
        size = 8 + int.from_bytes(data[:8], "little")
        self.doc, self.named, self.lengths = unsqueezed(data[8:size], "i8", "u1", "i8")
        self.text = zstandard.decompress(data[size:])
        self.starts = np.cumsum(self.lengths) - self.lengths


def by_bucket(bucket: np.ndarray):
    """(bucket, slice) for each run of an ordered array."""
    if not len(bucket):
        return
    heads = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1])))
    for i, j in zip(heads, [*heads[1:], len(bucket)], strict=True):
        yield int(bucket[i]), slice(int(i), int(j))


def sent(rows: list[tuple]):
    return pa.table([pa.array([x[k] for x in rows], t) for k, t in enumerate((pa.int32(), pa.int64(), pa.int32(), pa.binary()))], ["bucket", "block", "step", "data"])


def told(replies, step: int, *kinds: str) -> list[np.ndarray]:
    """What arrived of a step, in order of buckets."""
    own = replies.filter(pc.equal(replies["step"], step)).sort_by("bucket")["data"].to_pylist()
    parts = [unsqueezed(x, *kinds) for x in own]
    return [np.concatenate([np.zeros(0, kind), *(x[k] for x in parts)]) for k, kind in enumerate(kinds)]
