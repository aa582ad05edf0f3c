"""Files of fixed-width values as tables: flags, index entries and signature matrices, read by ranges and written in parallel.

Layouts, all little-endian:

* ``flags``: a byte for each document, in the order of its group, and no header;
* ``index``: a magic of 8 bytes, then records of u32 group, u32 item number and u64 bucket value. An end before a record, or in
  its first four bytes, is the end; inside the rest of one it is an IoError;
* ``matrix``: the magic, u64 documents, u32 n-gram size, u32 bands, u32 hashes of a band, then every document's first hash, every document's
  second one, and so on. A file that ends too early is an IoError, and what lies behind the matrix is ignored.

A path is a file or a folder of part files, whose names are in the order of their rows. A task reads a range of rows, of a matrix
the same range under every hash, and a row's place is known from sizes alone, without a count or a window. Writers' tasks
have files of their own under a temporary name; they are moved together when all are whole and leave no gap.

Unsigned 64-bit values are longs of the same bits. The magic is a parameter, so files of other tools of these layouts can be read and made.
Files are opened by pyarrow, whose file systems (file, hdfs, s3, gs) are those that paths may name.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from ..config import INDEX_SPLITS, ConfigError, InvalidFormat, IoError, MinHashConfig

FORMAT = "winnower_records"
SIGNATURE_MAGIC, INDEX_MAGIC = "WNWsigs1", "WNWindx1"
SCHEMAS = {
    "flags": "global_idx long, flag string",
    "index": "split int, group long, item_number long, bucket_value long",
    "matrix": "item_number long, signature array<long>",
}
HEADER = struct.Struct("<8sQIII")
RECORD = np.dtype([("group", "<u4"), ("item_number", "<u4"), ("bucket_value", "<u8")])
#: Bytes of a task's range, and documents of a matrix that are turned at once: part files have as many.
RANGE_BYTES = 64 << 20
MATRIX_ROWS = 16_384


@dataclass
class Range(InputPartition):
    """Rows ``first`` to ``first + n`` of a file whose first row is at ``base``."""

    file: str
    first: int
    n: int
    base: int
    width: int = 0
    total: int = 0
    split: int = 0


@dataclass
class Part(WriterCommitMessage):
    """What a task wrote: (name, first row, rows)."""

    files: list[tuple[str, int, int]]


def _opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def _files(path: str) -> list[fs.FileInfo]:
    """The file, or the folder's part files in the order of their names."""
    system, at = _opened(path)
    info = system.get_file_info(at)
    if info.type == fs.FileType.File:
        return [info]
    if info.type == fs.FileType.NotFound:
        raise IoError(f"there is no {path}")
    found = system.get_file_info(fs.FileSelector(at))
    return sorted((f for f in found if f.type == fs.FileType.File and f.base_name[0] not in "._"), key=lambda f: f.base_name)


def _bytes(source, at: int, n: int) -> bytes:
    found = source.read_at(n, at)
    if len(found) < n:
        raise IoError(f"the file ends {n - len(found)} bytes too early")
    return found


def matrix_header(system: fs.FileSystem, file: str, size: int, magic: str) -> tuple[int, MinHashConfig]:
    """Documents and parameters of a matrix."""
    with system.open_input_file(file) as source:
        if size < 8:
            raise IoError(f"{file} ends within its header")
        if (found := _bytes(source, 0, 8)) != magic.encode():
            raise InvalidFormat(f"{file} begins with {found!r}")
        if size < HEADER.size:
            raise IoError(f"{file} ends within its header")
        _, n, *parameters = HEADER.unpack(_bytes(source, 0, HEADER.size))
    config = MinHashConfig(*parameters)
    if size < HEADER.size + 8 * n * config.total_hashes:
        raise IoError(f"{file} ends within its matrix")
    return n, config


def _index_records(system: fs.FileSystem, file: str, size: int, magic: str) -> int:
    with system.open_input_file(file) as source:
        if size < 8:
            raise IoError(f"{file} ends within its header")
        if (found := _bytes(source, 0, 8)) != magic.encode():
            raise InvalidFormat(f"{file} begins with {found!r}")
    whole, rest = divmod(size - 8, RECORD.itemsize)
    if rest >= 4:
        raise IoError(f"{file} ends within a record")
    return whole


class RecordReader(DataSourceReader):
    def __init__(self, options: dict):
        self.layout, self.path, self.magic = options["layout"], options["path"], options.get("magic", "")
        self.range_bytes = int(options.get("rangeBytes", RANGE_BYTES))
        self.splits = [int(x) for x in options.get("splits", f"0,{INDEX_SPLITS - 1}").split(",")]

    def partitions(self) -> list[Range]:
        if self.layout == "index":
            return self._index_ranges()
        system, _ = _opened(self.path)
        out, base = [], 0
        for f in _files(self.path):
            n, width = f.size, 0
            if self.layout == "matrix":
                n, config = matrix_header(system, f.path, f.size, self.magic)
                width = config.total_hashes
            step = max(1, self.range_bytes // max(1, 8 * width if self.layout == "matrix" else 1))
            out += [Range(f.path, low, min(step, n - low), base, width, n) for low in range(0, n, step)]
            base += n
        return out or [Range("", 0, 0, 0)]

    def _index_ranges(self) -> list[Range]:
        """Files ``{path}.idx.{split}`` of the splits asked for, and parts of them."""
        system, at = _opened(self.path)
        folder, _, stem = at.rpartition("/")
        out = []
        for f in sorted(system.get_file_info(fs.FileSelector(folder or ".")), key=lambda f: f.path):
            if f.type != fs.FileType.File or not f.base_name.startswith(f"{stem}.idx."):
                continue
            split = int(f.base_name[len(stem) + 5 :].split(".")[0])
            if not self.splits[0] <= split <= self.splits[1]:
                continue
            n, step = _index_records(system, f.path, f.size, self.magic), max(1, self.range_bytes // RECORD.itemsize)
            out += [Range(f.path, low, min(step, n - low), 0, split=split) for low in range(0, n, step)]
        return out or [Range("", 0, 0, 0)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        p = partition
        if not p.n:
            return
        system, _ = _opened(self.path)
        with system.open_input_file(p.file) as source:
            if self.layout == "flags":
                for low in range(p.first, p.first + p.n, 1 << 20):
                    data = np.frombuffer(_bytes(source, low, min(1 << 20, p.first + p.n - low)), np.uint8)
                    flags = pa.StringArray.from_buffers(len(data), pa.py_buffer(np.arange(len(data) + 1, dtype=np.int32)), pa.py_buffer(data))
                    yield pa.RecordBatch.from_arrays([pa.array(np.arange(p.base + low, p.base + low + len(data))), flags], names=["global_idx", "flag"])
            elif self.layout == "index":
                rows = np.frombuffer(_bytes(source, 8 + RECORD.itemsize * p.first, RECORD.itemsize * p.n), RECORD)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(p.n, p.split, np.int32)), pa.array(rows["group"].astype(np.int64)), pa.array(rows["item_number"].astype(np.int64)), pa.array(rows["bucket_value"].astype("<u8").view(np.int64))],
                    names=["split", "group", "item_number", "bucket_value"],
                )
            else:
                found = np.empty((p.n, p.width), np.int64)
                for k in range(p.width):
                    found[:, k] = np.frombuffer(_bytes(source, HEADER.size + 8 * (k * p.total + p.first), 8 * p.n), "<i8")
                items = pa.array(np.arange(p.base + p.first, p.base + p.first + p.n))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(p.n + 1, dtype=np.int32) * np.int32(p.width)), pa.array(found.reshape(-1)))
                yield pa.RecordBatch.from_arrays([items, lists], names=["item_number", "signature"])


class RecordWriter(DataSourceArrowWriter):
    def __init__(self, options: dict, overwrite: bool):
        if not overwrite:
            raise ConfigError("files are written as a whole: use mode overwrite")
        self.layout, self.path, self.magic = options["layout"], options["path"].rstrip("/"), options.get("magic", "")
        self.parameters = [int(x) for x in options.get("parameters", "0,0,0").split(",")]
        self.temporary = f"{self.path}._temporary-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Part:
        system, folder = _opened(self.temporary)
        system.create_dir(folder, recursive=True)
        out: list[tuple[str, int, int]] = []

        def put(name: str, first: int, n: int, *data: bytes) -> None:
            with system.open_output_stream(f"{folder}/{name}") as sink:
                for d in data:
                    sink.write(d)
            out.append((name, first, n))

        if self.layout == "index":
            self._write_index(iterator, system, folder, out)
            return Part(out)
        held: list[pa.RecordBatch] = []
        for batch in iterator:
            held.append(batch)
            if self.layout == "matrix":
                while sum(b.num_rows for b in held) >= MATRIX_ROWS:
                    every = pa.Table.from_batches(held)
                    self._put_part(every.slice(0, MATRIX_ROWS), put)
                    held = every.slice(MATRIX_ROWS).to_batches()
        if sum(b.num_rows for b in held):
            self._put_part(pa.Table.from_batches(held), put)
        return Part(out)

    def _put_part(self, rows: pa.Table, put) -> None:
        """A part file of rows without a gap."""
        place = rows.column(0).combine_chunks().to_numpy()
        first, n = int(place[0]), len(place)
        if not np.array_equal(place, np.arange(first, first + n)):
            raise InvalidFormat(f"rows from {first} on have a gap or stand twice")
        values = rows.column(1).combine_chunks()
        if self.layout == "flags":
            data = "".join(values.to_pylist()).encode()
            if len(data) != n:
                raise InvalidFormat("a flag isn't one byte")
            put(f"part-{first:020d}", first, n, data)
            return
        width = self.parameters[1] * self.parameters[2]
        flat = values.flatten().to_numpy()
        if len(flat) != n * width or not (np.diff(values.offsets.to_numpy()) == width).all():
            raise InvalidFormat(f"a signature hasn't {width} hashes")
        put(f"part-{first:020d}", first, n, HEADER.pack(self.magic.encode(), n, *self.parameters), np.ascontiguousarray(flat.reshape(n, width).T).astype("<i8").tobytes())

    def _write_index(self, iterator: Iterator[pa.RecordBatch], system: fs.FileSystem, folder: str, out: list) -> None:
        """Rows come by split: a file for each."""
        sink, at, n, own = None, -1, 0, uuid.uuid4().hex
        for batch in iterator:
            split = batch.column(0).to_numpy()
            rows = np.empty(len(split), RECORD)
            for i, c in enumerate(RECORD.names):
                rows[c] = batch.column(i + 1).to_numpy().astype(np.int64).view(np.uint64)
            bounds = np.flatnonzero(np.append(True, split[1:] != split[:-1]))
            for low, high in zip(bounds, np.append(bounds[1:], len(split)), strict=True):
                if split[low] != at:
                    if sink:
                        sink.close()
                        out.append((f"{at:05d}-{own}", at, n))
                    at, n = int(split[low]), 0
                    sink = system.open_output_stream(f"{folder}/{at:05d}-{own}")
                    sink.write(self.magic.encode())
                sink.write(rows[low:high].tobytes())
                n += int(high - low)
        if sink:
            sink.close()
            out.append((f"{at:05d}-{own}", at, n))

    def commit(self, messages: list[Part | None]) -> None:
        """Checks that parts leave no gap, and puts them in place of what was there."""
        system, folder = _opened(self.temporary)
        system.create_dir(folder, recursive=True)
        _, target = _opened(self.path)
        parts = sorted((f for m in messages if m for f in m.files), key=lambda f: (f[1], f[0]))
        if self.layout == "index":
            parent, _, stem = target.rpartition("/")
            for f in system.get_file_info(fs.FileSelector(parent or ".")):
                if f.type == fs.FileType.File and f.base_name.startswith(f"{stem}.idx."):
                    system.delete_file(f.path)
            seen: dict[int, int] = {}
            for name, split, _ in parts:
                seen[split] = seen.get(split, -1) + 1
                system.move(f"{folder}/{name}", f"{target}.idx.{split:05d}" + (f".{seen[split]:05d}" if seen[split] else ""))
            system.delete_dir(folder)
            return
        at = 0
        for _, first, n in parts:
            if first != at:
                raise InvalidFormat(f"rows {at} to {first} are missing")
            at += n
        if not parts:
            with system.open_output_stream(f"{folder}/part-{0:020d}") as sink:
                if self.layout == "matrix":
                    sink.write(HEADER.pack(self.magic.encode(), 0, *self.parameters))
        # A task that was run twice leaves a file under the same name; what no message names isn't moved.
        info = system.get_file_info(target)
        if info.type == fs.FileType.Directory:
            system.delete_dir(target)
        elif info.type == fs.FileType.File:
            system.delete_file(target)
        system.move(folder, target)

    def abort(self, messages: list[Part | None]) -> None:
        system, folder = _opened(self.temporary)
        if system.get_file_info(folder).type == fs.FileType.Directory:
            system.delete_dir(folder)


class Records(DataSource):
    """spark.read.format("winnower_records") with the options path, layout, magic and, of an index, splits."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMAS[self.options["layout"]]

    def reader(self, schema: StructType) -> RecordReader:
        return RecordReader(dict(self.options))

    def writer(self, schema: StructType, overwrite: bool) -> RecordWriter:
        return RecordWriter(dict(self.options), overwrite)


def _read(spark: SparkSession, path: str, layout: str, **options: str) -> DataFrame:
    spark.dataSource.register(Records)
    return spark.read.format(FORMAT).options(layout=layout, **options).load(path)


def _write(df: DataFrame, path: str, layout: str, **options: str) -> None:
    df.sparkSession.dataSource.register(Records)
    df.write.format(FORMAT).options(layout=layout, **options).mode("overwrite").save(path)


def write_flag_file(flags: DataFrame, path: str) -> None:
    """Flags (global_idx, flag) of a group, which must be dense from 0, replacing what was there."""
    rows = flags.select(F.col("global_idx").cast("long"), "flag")
    _write(rows.repartitionByRange("global_idx").sortWithinPartitions("global_idx"), path, "flags")


def read_flag_file(spark: SparkSession, path: str) -> DataFrame:
    return _read(spark, path, "flags")


def write_merged_flags(flags: DataFrame, basenames: list[str]) -> list[str]:
    """The merged flags (group_idx, global_idx, flag) of each group to ``{basename}.dup.merge``; the paths."""
    paths = [f"{b}.dup.merge" for b in basenames]
    for g, p in enumerate(paths):
        write_flag_file(flags.filter(F.col("group_idx") == g), p)
    return paths


def write_index_files(index: DataFrame, basename: str, *, magic: str = INDEX_MAGIC) -> None:
    """Index entries to ``{basename}.idx.{split}``, replacing what was there. A split that is dealt to several tasks has as many files."""
    rows = index.select("split", F.col("group").cast("long"), F.col("item_number").cast("long"), "bucket_value")
    _write(rows.hint("rebalance", "split").sortWithinPartitions("split", "group", "item_number", "bucket_value"), basename, "index", magic=magic)


def read_index_files(spark: SparkSession, basename: str, *, start: int = 0, end: int = INDEX_SPLITS - 1, magic: str = INDEX_MAGIC) -> DataFrame:
    """split, group, item_number and bucket_value of the splits asked for; splits without a file have no entry."""
    return _read(spark, basename, "index", magic=magic, splits=f"{start},{end}")


def write_signature_files(signatures: DataFrame, path: str, config: MinHashConfig, *, magic: str = SIGNATURE_MAGIC) -> None:
    """Signatures (item_number, signature), dense from 0, as matrices of at most MATRIX_ROWS documents, replacing what was there."""
    rows = signatures.select(F.col("item_number").cast("long"), F.col("signature").cast("array<long>").alias("signature"))
    parameters = f"{config.ngram_size},{config.num_buckets},{config.band_size}"
    _write(rows.repartitionByRange("item_number").sortWithinPartitions("item_number"), path, "matrix", magic=magic, parameters=parameters)


def signature_parameters(path: str, *, magic: str = SIGNATURE_MAGIC) -> tuple[int, MinHashConfig]:
    """Documents and parameters of stored matrices, from their headers; ConfigError where these differ or there is none."""
    system, _ = _opened(path)
    found = [matrix_header(system, f.path, f.size, magic) for f in _files(path)]
    if not found:
        raise ConfigError(f"{path} has no matrix")
    if len({c for _, c in found}) > 1:
        raise ConfigError(f"different parameters: {sorted({str(c) for _, c in found})}")
    return sum(n for n, _ in found), found[0][1]


def read_signature_files(spark: SparkSession, path: str, *, magic: str = SIGNATURE_MAGIC) -> tuple[DataFrame, MinHashConfig]:
    """item_number and signature of every document, and the parameters they were made with."""
    _, config = signature_parameters(path, magic=magic)
    return _read(spark, path, "matrix", magic=magic), config
