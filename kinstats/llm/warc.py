"""Deterministic sharded WARC writer, and a reader of what it wrote.

Records are sorted by (page_id, digest, url). A job over ids, digests and sizes alone cuts this order into shards of
about ``shard_bytes`` of payload, ``MAX_SHARDS`` at most; a second job compresses each record once, as its own gzip
member, and sends it to its shard, whose task rolls to a new file where ``roll_bytes`` of compressed records are
reached. Shards follow from the table alone, not from how Spark cut it, and so do the files. They are written under a
temporary name, renamed, and listed in a manifest that appears last: a folder without ``MANIFEST.json`` is not complete.

Defined cases: a null html is an empty payload; a null url leaves out the target header; control characters and spaces
in urls are percent-encoded; of equal payloads the smallest page_id is the response, so repeated rows with that very
page_id are responses all; a null page_id sorts first and never is what others refer to; rows that are equal in all
columns and fill several shards are dealt to these in turn (only how many are in which may vary); a payload of any
length is one record; an empty table gives a folder with a manifest only; other columns are ignored.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import re
import uuid
import zlib
from bisect import bisect_left, bisect_right

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import saved

READ = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, digest_ok boolean"
NO_ID = "none"
#: Shards at most, and what a record counts besides its payload when they are cut.
MAX_SHARDS, OVERHEAD = 1 << 16, 512
STATS = "stats"


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def member(data: bytes) -> bytes:
    """A gzip member whose last byte is zero (an empty member follows where it is not), so that files can be written line by line."""
    out = gzip.compress(data, 6, mtime=0)
    return out if out[-1] == 0 else out + gzip.compress(b"", 6, mtime=0)


def record(kind: str, record_id: str, date: str, block: bytes, content_type: str, more: dict[str, str]) -> bytes:
    head = {"WARC-Type": kind, "WARC-Record-ID": f"<{record_id}>", "WARC-Date": date, **more, "WARC-Block-Digest": f"sha1:{base32_sha1(block)}", "Content-Type": content_type, "Content-Length": str(len(block))}
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head.items()).encode() + b"\r\n" + block + b"\r\n\r\n"


def page_record(page_id, url, payload: bytes | None, refers_to, date: str, sha: bytes, size: int = 0) -> bytes:
    """The record of a page; ``sha`` is its payload's digest; ``refers_to`` is the page_id of the response with the same payload, whose ``size`` then stands for it; null if it is this one."""
    digest = base64.b32encode(sha).decode()
    if payload is not None:
        size = len(payload)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    more = {} if url is None else {"WARC-Target-URI": re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)}
    more["WARC-Payload-Digest"] = f"sha1:{digest}"
    name = f"urn:page:{NO_ID if page_id is None else page_id}"
    if refers_to is None:
        return record("response", name, date, http + payload, "application/http; msgtype=response", more)
    more |= {"WARC-Refers-To": f"<urn:page:{refers_to}>", "WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"}
    return record("revisit", name, date, http, "application/http; msgtype=response", more)


def revisits(keys: DataFrame, min_bytes: int) -> DataFrame:
    """(page_id, sha, first) of pages with the payload of a smaller page_id; only ids and digests take part."""
    large = keys.filter(F.col("bytes") >= min_bytes).select("page_id", "sha")
    firsts = large.groupBy("sha").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).filter("n > 1").select("sha", "first")
    return large.join(firsts, "sha").filter((F.col("page_id").isNull() | (F.col("page_id") != F.col("first"))) & F.col("first").isNotNull()).distinct()


def key_of(page_id, sha: bytes, place: int) -> tuple:
    """Place of a page in the order of records; ``place`` stands for its url."""
    return (page_id is not None, page_id or 0, bytes(sha), place)


def shard_starts(keys: DataFrame, shard_bytes: int) -> list[tuple]:
    """Key of the first record of each shard, in order."""
    spark = keys.sparkSession
    order = [F.col("page_id").asc_nulls_first(), F.col("sha").asc(), F.col("place").asc()]

    def measured(batches):
        part, at = TaskContext.get().partitionId(), 0
        for batch in batches:
            weight = batch.column(3).to_numpy() + OVERHEAD
            starts = at + weight.cumsum() - weight
            at += int(weight.sum())
            yield pa.RecordBatch.from_arrays([pa.array([part] * len(weight), pa.int32()), pa.array(starts), pa.array(weight), *batch.columns[:3]], ["part", "at", "weight", "page_id", "sha", "place"])

    partitions = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ordered = keys.select("page_id", "sha", "place", "bytes").repartitionByRange(partitions, *order).sortWithinPartitions(*order)
    sizes = saved(ordered.mapInArrow(measured, "part int, at long, weight long, page_id long, sha binary, place long"))
    base, bases = 0, []
    for part, size in sorted(map(tuple, sizes.groupBy("part").agg(F.sum("weight")).collect())):  # a row for each partition
        bases.append((part, base))
        base += size
    shard_bytes = max(shard_bytes, -(-base // MAX_SHARDS))
    placed = sizes.join(F.broadcast(spark.createDataFrame(bases, "part int, base long")), "part").withColumn("start", F.col("base") + F.col("at"))
    shards = placed.groupBy((F.col("start") / shard_bytes).cast("long").alias("shard")).agg(F.min_by(F.struct("page_id", "sha", "place"), "start").alias("key"))
    return [key_of(*x["key"]) for x in shards.orderBy("shard").collect()]  # MAX_SHARDS rows at most


def write_warc(pages: DataFrame, folder: str, shard_bytes: int = 64 << 20, roll_bytes: int = 256 << 20, min_bytes: int = 0, date: str = "2000-01-01T00:00:00Z") -> str:
    """Writes ``pages`` as WARC files below ``folder`` and returns ``folder``.

    Payloads are compressed once and shuffled once, in that form.
    """
    spark = pages.sparkSession
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("payload"))
    pages = pages.select("*", F.unhex(F.sha1("payload")).alias("sha"), F.xxhash64("url").alias("place"))
    keys = saved(pages.select("page_id", "sha", "place", F.octet_length("payload").cast("long").alias("bytes")))
    later = saved(revisits(keys, min_bytes))
    starts = shard_starts(keys, shard_bytes)
    shared = spark.sparkContext.broadcast(starts)
    columns = "shard int, page_id long, sha binary, place long, url string, bytes long, data binary, first long"
    names = [x.split()[0] for x in columns.split(", ")]

    def span(low: tuple, high: tuple) -> range:
        """Shards with records from ``low`` to ``high``."""
        return range(max(0, bisect_left(shared.value, low) - 1), max(1, bisect_right(shared.value, high)))

    def compressed(batches):
        turn = TaskContext.get().partitionId()
        for batch in batches:
            rows = list(zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True))
            shards = []
            for page_id, _, _, sha, place in rows:
                key = key_of(page_id, sha, place)
                at, stop = bisect_left(shared.value, key), bisect_right(shared.value, key)
                some = range(at, stop) if at < stop else range(max(0, stop - 1), max(1, stop))
                turn += 1
                shards.append(some[turn % len(some)])
            data = [member(page_record(page_id, url, payload, None, date, sha)) for page_id, url, payload, sha, _ in rows]
            nulls = pa.nulls(len(rows), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(shards, pa.int32()), batch.column(0), batch.column(3), batch.column(4), batch.column(1), pa.array([len(x[2]) for x in rows], pa.int64()), pa.array(data, pa.binary()), nulls], names)

    def told(batches):
        """What a shard must know of revisits, one row in each shard that has records of the page and payload."""
        for batch in batches:
            ids, shas, firsts = (x.to_pylist() for x in batch.columns)
            where = [span(key_of(i, s, -1 << 63), key_of(i, s, (1 << 63) - 1)) for i, s in zip(ids, shas, strict=True)]
            at = pa.array([k for k, x in enumerate(where) for _ in x], pa.int64())
            none = lambda kind: pa.nulls(len(at), kind)  # noqa: E731, B023
            yield pa.RecordBatch.from_arrays([pa.array([k for x in where for k in x], pa.int32()), batch.column(0).take(at), batch.column(1).take(at), none(pa.int64()), none(pa.string()), none(pa.int64()), none(pa.binary()), batch.column(2).take(at)], names)

    def finish(batches):
        said, files = None, Rolled(roll_bytes, date)
        for batch in batches:
            for shard, page_id, sha, _, url, n, data, first in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if data is None:
                    said = page_id, sha, first
                    continue
                if said and said[:2] == (page_id, sha):
                    data = member(page_record(page_id, url, None, said[2], date, sha, n))
                files.add(shard, page_id, data)
            yield files.batch()
        files.close()
        yield files.batch()

    rows = pages.mapInArrow(compressed, columns).unionByName(later.select("page_id", "sha", "first").mapInArrow(told, columns))
    within = rows.repartitionById(max(1, len(starts)), "shard").sortWithinPartitions("shard", F.col("page_id").asc_nulls_first(), "sha", F.col("data").isNull().desc(), "place", F.col("url").asc_nulls_first())
    done = within.mapInArrow(finish, "name string, at long, data binary").sortWithinPartitions("name", "at")
    temporary = f"{folder}/_temporary-{uuid.uuid4().hex}"
    done.select(F.col("data").cast("string").alias("value"), "name").write.partitionBy("name").option("lineSep", "\0").option("compression", "none").text(temporary)
    commit(spark, temporary, folder)
    return folder


class Rolled:
    """Records of a task's shards, as rows (name, at, data) of files with a file's own record before its first; each file
    ends with a row of the partition ``STATS`` that says what is in it. The writer ends rows with the zero byte that ``data`` lacks."""

    def __init__(self, roll_bytes: int, date: str):
        self.roll_bytes, self.date, self.shard, self.file, self.rows = roll_bytes, date, None, 0, []
        self.stats = None

    def add(self, shard: int, page_id, data: bytes) -> None:
        if shard != self.shard or self.stats["bytes"] >= self.roll_bytes:
            self.close()
            self.file = 0 if shard != self.shard else self.file + 1
            self.shard, self.at = shard, 0
            name = f"{shard:06d}-{self.file:04d}"
            self.stats = {"file": name_of(name), "records": 0, "bytes": 0, "first": page_id, "last": page_id}
            self.hash = hashlib.sha1()
            self.put(name, member(record("warcinfo", f"urn:file:{name}", self.date, b"format: WARC File Format 1.1\r\n", "application/warc-fields", {"WARC-Filename": name_of(name)})))
        self.put(f"{shard:06d}-{self.file:04d}", data)
        self.stats["records"] += 1
        self.stats["last"] = page_id

    def put(self, name: str, data: bytes) -> None:
        self.rows.append((name, self.at, data[:-1]))
        self.at += 1
        self.stats["bytes"] += len(data)
        self.hash.update(data)

    def close(self) -> None:
        if self.stats:
            self.rows.append((STATS, self.shard, json.dumps(self.stats | {"sha1": self.hash.hexdigest()}).encode()))

    def batch(self) -> pa.RecordBatch:
        rows, self.rows = self.rows, []
        return pa.RecordBatch.from_arrays([pa.array([x[k] for x in rows], t) for k, t in enumerate((pa.string(), pa.int64(), pa.binary()))], ["name", "at", "data"])


def commit(spark: SparkSession, temporary: str, folder: str) -> None:
    """Renames the files below ``temporary`` into ``folder``, as a committer does, and writes the manifest last."""
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path
    fs = path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    files = []
    if fs.exists(path(f"{temporary}/name={STATS}")):
        told = spark.read.option("lineSep", "\0").text(f"{temporary}/name={STATS}")
        files = sorted((json.loads(x[0]) for x in told.toLocalIterator()), key=lambda x: x["file"])
    at = {x.getPath().getParent().getName().removeprefix("name="): x for x in fs.globStatus(path(f"{temporary}/name=*/part-*")) or []}
    for x in files:
        found = at[x["file"].removeprefix("pages-").removesuffix(".warc.gz")]
        if found.getLen() != x["bytes"]:
            raise OSError(f"{x['file']} has {found.getLen()} bytes of {x['bytes']}")
        if not fs.rename(found.getPath(), path(f"{folder}/{x['file']}")):
            raise OSError(f"{x['file']} is there already")
    out = fs.create(path(f"{folder}/_MANIFEST.tmp"), True)
    out.write(bytearray(json.dumps({"files": files}, indent=1).encode()))
    out.close()
    fs.rename(path(f"{folder}/_MANIFEST.tmp"), path(f"{folder}/MANIFEST.json"))
    fs.delete(path(temporary), True)


def name_of(name: str) -> str:
    return f"pages-{name}.warc.gz"


def members(data: bytes):
    """Uncompressed members of a gzip file, in turn."""
    view, at = memoryview(data), 0
    while at < len(view):
        one, parts = zlib.decompressobj(31), []
        while not one.eof and at < len(view):  # a little at a time: what a member leaves over is copied
            parts.append(one.decompress(view[at : at + 65536]))
            at += min(65536, len(view) - at)
        at -= len(one.unused_data)
        yield b"".join(parts)


def records(data: bytes):
    """(headers, block) of each record of a WARC file with a gzip member for each record."""
    for text in members(data):
        if text:
            head, _, rest = text.partition(b"\r\n\r\n")
            headers = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
            yield headers, rest[: int(headers["Content-Length"])]


def id_in(urn: str):
    name = urn.strip("<>").rpartition(":")[2]
    return None if name == NO_ID else int(name)


def read_warc(spark: SparkSession, folder: str) -> DataFrame:
    """A row for each response or revisit record of the files below ``folder``; fails where one does not match its digests."""

    def parse(batches):
        for batch in batches:
            for data in batch.column(0):
                out = []
                for head, block in records(data.as_py()):
                    if head["WARC-Type"] not in ("response", "revisit"):
                        continue
                    http, _, payload = block.partition(b"\r\n\r\n")
                    size = int(re.search(rb"\r\nContent-Length: (\d+)", http)[1])
                    digest = head["WARC-Payload-Digest"].removeprefix("sha1:")
                    good = head["WARC-Block-Digest"] == f"sha1:{base32_sha1(block)}" and (head["WARC-Type"] == "revisit" or (len(payload), base32_sha1(payload)) == (size, digest))
                    if not good:
                        raise ValueError(f"record {head['WARC-Record-ID']} does not match its digests")
                    out.append((id_in(head["WARC-Record-ID"]), head.get("WARC-Target-URI"), size, digest, head["WARC-Type"], id_in(head["WARC-Refers-To"]) if "WARC-Refers-To" in head else None, good))
                yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], t) for k, t in enumerate((pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.bool_()))], [x.split()[0] for x in READ.split(", ")])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").load(folder)
    return files.select("content").mapInArrow(parse, READ)
