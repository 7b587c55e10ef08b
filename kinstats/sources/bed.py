"""Packed genotypes: a matrix of two bits a sample, a row for each variant, in one file or in a folder of files.

Rows are read by ranges of bytes through the file systems that Arrow knows (mounted folders and object stores), and only the
rows that are asked for. Stores that Spark alone reaches give whole files of a folder instead, of which only those with
wanted rows are read. A folder is written in two phases: tasks write under a temporary name, and the driver checks that
the rows are all there before any file gets its own.

Which rows are wanted is an argument of the reader. Spark 4.1 can push filters to Python sources, but keeps those of the last
query for every later one on the same frame, whose rows are then missing; so the sources here take none.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

#: The first three bytes of a variant-major file.
MAGIC = bytes([0x6C, 0x1B, 0x01])
FORMAT, UNFINISHED = "packed_genotypes", "_temporary"
SCHEMA = "variant_idx int, codes binary"
Spans = list[tuple[int, int]]


def store(path: str) -> tuple[fs.FileSystem, str]:
    """Arrow's file system of ``path``, and the path in it."""
    if "://" in path and not path.startswith("file:"):
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path.removeprefix("file://").removeprefix("file:")


def bed_files(path: str) -> list[tuple[str, int]]:
    """(name, bytes) of the file, or of the genotype files of the folder by name."""
    files, own = store(path)
    info = files.get_file_info(own)
    if info.type == fs.FileType.File:
        return [(own, info.size)]
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    found = files.get_file_info(fs.FileSelector(own))
    if any(x.base_name.startswith(UNFINISHED) for x in found):
        raise ValueError(f"{path} has not been written to its end")
    return sorted((x.path, x.size) for x in found if x.type == fs.FileType.File and x.base_name.endswith(".bed"))


def rows_in(name: str, size: int, width: int) -> int:
    n, rest = divmod(size - len(MAGIC), width)
    if rest or n < 0:
        raise ValueError(f"{name} ends within a row of {width} bytes")
    return n


def common(a: Spans, b: Spans) -> Spans:
    """What two lists of ranges, each in order and apart, have in common."""
    out, i, j = [], 0, 0
    while i < len(a) and j < len(b):
        first, stop = max(a[i][0], b[j][0]), min(a[i][1], b[j][1])
        if first < stop:
            out.append((first, stop))
        i, j = (i + 1, j) if a[i][1] < b[j][1] else (i, j + 1)
    return out


def merged_spans(spans: Spans) -> Spans:
    """The same rows as ranges in order and apart."""
    out: Spans = []
    for first, stop in sorted(x for x in spans if x[0] < x[1]):
        if out and first <= out[-1][1]:
            out[-1] = (out[-1][0], max(stop, out[-1][1]))
        else:
            out.append((first, stop))
    return out


class Range(InputPartition):
    """Rows ``first`` to ``stop`` of a file, with ``before`` rows in the files before it."""

    def __init__(self, path: str, first: int, stop: int, before: int):
        super().__init__((path, first, stop, before))
        self.path, self.first, self.stop, self.before = path, first, stop, before


class GenotypeReader(DataSourceReader):
    """Reads a file, or the files of a folder by name, one after the other."""

    def __init__(self, options: dict):
        self.path, self.samples = options["path"], int(options["samples"])
        self.each = int(options.get("variantsPerPartition", 4096))
        self.width = -(-self.samples // 4)
        self.wanted: Spans = [tuple(x) for x in json.loads(options.get("variants", "[[0, 4294967296]]"))]

    def partitions(self) -> list[Range]:
        out, before = [], 0
        files, _ = store(self.path)
        for name, size in bed_files(self.path):
            with files.open_input_file(name) as file:
                if file.read(3) != MAGIC:
                    raise ValueError(f"{name} does not start as a variant-major genotype file")
            n = rows_in(name, size, self.width)
            for first, stop in common(self.wanted, [(before, before + n)]):
                out += [Range(name, at - before, min(stop, at + self.each) - before, before) for at in range(first, stop, self.each)]
            before += n
        return out or [Range(self.path, 0, 0, 0)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        if partition.first == partition.stop:
            return
        files, _ = store(self.path)
        with files.open_input_file(partition.path) as file:
            for at in range(partition.first, partition.stop, 256):
                some = min(256, partition.stop - at)
                data = file.read_at(some * self.width, len(MAGIC) + at * self.width)
                if len(data) < some * self.width:
                    raise ValueError(f"{partition.path} is shorter than it was")
                yield batch_of(data, self.width, partition.before + at)


def batch_of(data: bytes, width: int, first: int) -> pa.RecordBatch:
    n = len(data) // width
    rows = [data[k * width : (k + 1) * width] for k in range(n)]
    return pa.RecordBatch.from_arrays([pa.array(range(first, first + n), pa.int32()), pa.array(rows, pa.binary())], ["variant_idx", "codes"])


@dataclass
class Written(WriterCommitMessage):
    """Files of a task: (name, first row, rows), and the bytes of a row."""

    files: list[tuple[str, int, int]]
    width: int | None


class GenotypeWriter(DataSourceArrowWriter):
    """Writes rows in order of ``variant_idx``; files appear in the folder when all are known to be whole."""

    def __init__(self, options: dict):
        self.path, self.most = options["path"], int(options.get("bytesPerFile", 256 << 20))
        files, own = store(self.path)
        if files.get_file_info(own).type != fs.FileType.NotFound:
            raise FileExistsError(self.path)
        self.own, self.temporary = own, f"{own}/{UNFINISHED}-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        files, _ = store(self.path)
        files.create_dir(self.temporary)
        out, held, size, first, width, at = [], [], 0, None, None, None

        def close():
            name = f"{self.temporary}/{uuid.uuid4().hex}"
            with files.open_output_stream(name) as file:
                file.write(MAGIC + b"".join(held))
            out.append((name, first, len(held)))

        for batch in iterator:
            for idx, codes in zip(batch.column("variant_idx").to_pylist(), batch.column("codes").to_pylist(), strict=True):
                if idx is None or codes is None:
                    raise ValueError("a row without variant_idx or codes")
                if width is not None and len(codes) != width:
                    raise ValueError(f"variant {idx} has {len(codes)} bytes, others {width}")
                if at is not None and idx != at + 1:
                    raise ValueError(f"variant {idx} follows {at}")
                if held and size + len(codes) > self.most:
                    close()
                    held, size = [], 0
                if not held:
                    first = idx
                held.append(codes)
                size, width, at = size + len(codes), len(codes), idx
        if held:
            close()
        return Written(out, width)

    def commit(self, messages: list[Written | None]) -> None:
        files, _ = store(self.path)
        parts = sorted((first, n, name) for x in messages if x for name, first, n in x.files)
        widths = {x.width for x in messages if x and x.width is not None}
        at = 0
        problem = f"rows of {sorted(widths)} bytes" if len(widths) > 1 else None
        for first, n, _ in parts:
            if first != at and problem is None:
                problem = f"variant {first} follows {at - 1}" if at else f"the first variant is {first}"
            at = first + n
        if problem:
            files.delete_dir(self.own)
            raise ValueError(f"{self.path} was not written: {problem}")
        for k, (_, _, name) in enumerate(parts):
            files.move(name, f"{self.own}/part-{k:05d}.bed")
        files.create_dir(self.own)
        if files.get_file_info(self.temporary).type != fs.FileType.NotFound:
            files.delete_dir(self.temporary)

    def abort(self, messages: list[Written | None]) -> None:
        files, _ = store(self.path)
        if files.get_file_info(self.own).type != fs.FileType.NotFound:
            files.delete_dir(self.own)


class GenotypeSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> GenotypeReader:
        return GenotypeReader(self.options)

    def writer(self, schema, overwrite: bool) -> GenotypeWriter:
        return GenotypeWriter(self.options)


def known_to_arrow(path: str) -> bool:
    try:
        store(path)
    except (pa.ArrowException, OSError, ValueError):
        return False
    return True


def in_spans(variants: Spans) -> Column:
    """Whether ``variant_idx`` lies in one of the ranges."""
    found = F.lit(False)
    for first, stop in variants:
        found = found | ((F.col("variant_idx") >= first) & (F.col("variant_idx") < stop))
    return found


def whole_files(spark: SparkSession, path: str, samples: int, variants: Spans | None = None) -> DataFrame:
    """As ``read_genotypes``, through Spark's own reader of whole files, of which each must be below two GB: only files with wanted rows are read."""
    width = -(-samples // 4)
    listed = spark.read.format("binaryFile").option("pathGlobFilter", "*.bed").load(path)
    starts, at = {}, 0
    for name, size in sorted((x.path, x.length) for x in listed.select("path", "length").collect()):
        n = rows_in(name, size, width)
        if variants is None or common(variants, [(at, at + n)]):
            starts[name] = at
        at += n
    if not starts:
        return spark.createDataFrame([], SCHEMA)

    def run(batches):
        for batch in batches:
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if data[: len(MAGIC)] != MAGIC:
                    raise ValueError(f"{name} does not start as a variant-major genotype file")
                for k in range(len(MAGIC), len(data), 256 * width):
                    yield batch_of(data[k : k + 256 * width], width, starts[name] + (k - len(MAGIC)) // width)

    out = spark.read.format("binaryFile").load(list(starts)).select("path", "content").mapInArrow(run, SCHEMA)
    return out if variants is None else out.filter(in_spans(variants))


def read_genotypes(spark: SparkSession, path: str, samples: int, variants_per_partition: int = 4096, variants: tuple[int, int] | Spans | None = None) -> DataFrame:
    """variant_idx and the packed codes of ``samples`` samples; with ``variants``, a range or several, only rows from its first number up to its second, not included, are read."""
    if variants is not None:
        variants = [variants] if isinstance(variants, tuple) else variants
        variants = merged_spans(variants)
    if not known_to_arrow(path):
        return whole_files(spark, path, samples, variants)
    spark.dataSource.register(GenotypeSource)
    reader = spark.read.format(FORMAT).option("samples", samples).option("variantsPerPartition", variants_per_partition)
    return (reader if variants is None else reader.option("variants", json.dumps(variants))).load(path)


def write_genotypes(packed: DataFrame, path: str, bytes_per_file: int = 256 << 20) -> None:
    """Packed rows (variant_idx, codes) as a folder of genotype files in order of ``variant_idx``.

    Numbers must be all from 0 on, each once, and rows equally long; else nothing is written and an error says what is
    wrong. Attempts of tasks that fail or are overtaken leave no file.
    """
    spark = packed.sparkSession
    spark.dataSource.register(GenotypeSource)
    rows = packed.select(F.col("variant_idx").cast("int").alias("variant_idx"), "codes").repartitionByRange("variant_idx").sortWithinPartitions("variant_idx")
    rows.write.format(FORMAT).mode("append").option("bytesPerFile", bytes_per_file).save(path)
