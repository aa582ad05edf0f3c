"""Deterministic sharded WARC writer and its reader.

Records are dealt to shards by ranges of their id. How many shards there are follows from the payloads' bytes, and their
bounds are order statistics of a hash-selected set of ids: both are functions of the data alone. A task writes one shard in
order of (id, url, digest), rolls a file when its compressed
size passes ``roll_bytes``, writes under a temporary name and renames when the file is complete. The manifest, one
row for each record, is a Parquet table that Spark's committer publishes last; readers open what it lists and
nothing else, so files of lost or repeated attempts are harmless, and a repeated attempt writes the same bytes.

Defined cases: a null payload is empty. Null ids come first, revisit the record of an equal payload that has the largest
id, and never serve as a response that others revisit: where no record of a payload has an id, all are responses.
Records of equal payload that tie for the largest id are all responses. Null urls become ``urn:page:<id>``.
Further columns of the input aren't archived. An empty table makes an empty manifest and no file.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shared_root, table

#: The date of every record, unless the caller gives another: a writer's clock would make files differ.
DATE = "2020-01-01T00:00:00Z"
ROLL_BYTES = 32_000_000
#: Payload bytes of a shard, and how many shards there are at most: beyond that number shards grow, so that what the
#: driver holds of their bounds doesn't.
SHARD_BYTES = 32_000_000
MAX_SHARDS = 16_384
#: Ids selected by hash for each bound between shards.
IDS_PER_SHARD = 32
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MANIFEST = "page_id long, file string, offset long, length long"
RECORD = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


class WarcError(ValueError):
    """An archive doesn't hold what its headers say."""


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}/{digest}')}>"


def make_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str) -> bytes:
    """One record, uncompressed. ``refers_to`` makes it a revisit, whose block has HTTP headers and no payload."""
    digest = base32_sha1(payload)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    uri = quote(url, safe=":/?#[]@!$&'()*+,;=%~") if url else f"urn:page:{'' if page_id is None else page_id}"
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {record_id(page_id, digest)}",
        f"WARC-Date: {date}",
        f"WARC-Target-URI: {uri}",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"WARC-Block-Digest: sha1:{base32_sha1(block)}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if page_id is not None:
        head.append(f"X-Page-ID: {page_id}")
    if refers_to is not None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers_to, digest)}", f"X-Refers-To-Page-ID: {refers_to}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(data: bytes) -> dict:
    """A record's fields; WarcError where a length or digest doesn't hold."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise WarcError("not a WARC/1.1 record")
    fields = dict(x.split(": ", 1) for x in lines[1:])
    size = int(fields["Content-Length"])
    block = rest[:size]
    if len(block) != size or rest[size:] != b"\r\n\r\n":
        raise WarcError("cut record")
    if "sha1:" + base32_sha1(block) != fields["WARC-Block-Digest"]:
        raise WarcError("block digest doesn't match")
    http, _, payload = block.partition(b"\r\n\r\n")
    length = int(next(x for x in http.decode().split("\r\n") if x.startswith("Content-Length: "))[16:])
    kind, digest = fields["WARC-Type"], fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if kind == "response" and (len(payload) != length or base32_sha1(payload) != digest):
        raise WarcError("payload doesn't match its digest")
    number = lambda x: int(fields[x]) if x in fields else None
    return {"page_id": number("X-Page-ID"), "url": fields["WARC-Target-URI"], "payload_bytes": length, "payload_digest": digest, "record_type": kind, "refers_to": number("X-Refers-To-Page-ID"), "payload": payload if kind == "response" else None}


class _Files:
    """The files of one shard, each under a temporary name until it is complete."""

    def __init__(self, folder: str, shard: int, roll: int):
        self.fs, self.path = pafs.FileSystem.from_uri(folder)
        self.shard, self.roll, self.number, self.out = shard, roll, -1, None

    def add(self, data: bytes) -> tuple[str, int, int]:
        if self.out is None:
            self.number += 1
            self.name = f"shard-{self.shard:06d}-{self.number:05d}.warc.gz"
            self.temporary = f"{self.path}/.{self.name}.{uuid.uuid4().hex}.tmp"
            self.out, self.size = self.fs.open_output_stream(self.temporary, compression=None), 0
        packer = zlib.compressobj(6, zlib.DEFLATED, 31)
        member = packer.compress(data) + packer.flush()
        self.out.write(member)
        at, self.size = self.size, self.size + len(member)
        name = self.name
        if self.size >= self.roll:
            self.close()
        return name, at, len(member)

    def close(self) -> None:
        if self.out is None:
            return
        self.out.close()
        self.out, final = None, f"{self.path}/{self.name}"
        if self.fs.type_name != "local" and self.fs.get_file_info(final).type != pafs.FileType.NotFound:
            self.fs.delete_file(final)  # an earlier attempt's, of the same bytes
        self.fs.move(self.temporary, final)


def shard_bounds(keys: DataFrame, shards: int) -> list[tuple[int, int]]:
    """At most ``shards`` - 1 bounds in (id, tie) order, at even ranks of those keys whose hash falls below a share
    of all that leaves IDS_PER_SHARD for each shard: bounded in number, the same for the same rows."""
    rows = keys.count()
    wanted = shards * IDS_PER_SHARD
    share = max(1, rows // wanted)
    found = sorted(tuple(r) for r in keys.filter(F.pmod(F.xxhash64("page_key", "tie"), F.lit(share)) == 0).select("page_key", "tie").distinct().collect())
    if not found:
        return []
    return sorted({found[i * len(found) // shards] for i in range(1, shards)})


def write_archives(pages: DataFrame, folder: str, *, shards: int | None = None, roll_bytes: int = ROLL_BYTES, min_revisit_bytes: int = 0, date: str = DATE) -> DataFrame:
    """Write columns page_id, url, html of ``pages`` as WARC files below ``folder``; the manifest, read back."""
    spark = pages.sparkSession
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.col("url").cast("string").alias("url"),
        F.coalesce(F.encode("html", "UTF-8"), F.lit(b"")).alias("payload"),
    ).withColumn("digest", F.unhex(F.sha1("payload")))
    rows = rows.withColumn("page_key", F.coalesce("page_id", F.lit(-(2**63)))).withColumn("tie", F.xxhash64(F.coalesce("url", F.lit("")), "digest"))
    narrow = rows.select("page_id", "page_key", "tie", "digest", F.length("payload").alias("size"))
    if shards is None:
        total = narrow.agg(F.coalesce(F.sum(F.col("size").cast("long")), F.lit(0))).first()[0]
        shards = min(MAX_SHARDS, max(1, -(-total // SHARD_BYTES)))
    bounds = shard_bounds(narrow, shards)
    low = np.array(bounds, np.int64).reshape(-1, 2)

    @F.pandas_udf("int")
    def shard_of(key: pd.Series, tie: pd.Series) -> pd.Series:
        at = np.searchsorted(low[:, 0], key.to_numpy(), "left")
        until = np.searchsorted(low[:, 0], key.to_numpy(), "right")
        out = until.copy()
        for i in np.flatnonzero(at != until):  # the id is a bound itself: the tie decides
            out[i] = at[i] + np.searchsorted(low[at[i] : until[i], 1], tie.iloc[i], "right")
        return pd.Series(out.astype(np.int32))

    # Narrow rows decide what is a revisit; payloads are shuffled once, with those decisions before them.
    same = narrow.filter(F.col("size") >= min_revisit_bytes)
    groups = same.groupBy("digest").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("n")).filter("n > 1 and refers_to is not null").drop("n")
    revisits = same.join(groups, "digest").filter("page_id is null or page_id <> refers_to").select("page_key", "tie", "digest", "refers_to").distinct()
    order = ["shard", "page_key", "tie", "digest", "rank"]
    both = rows.select("page_key", "tie", "digest", F.lit(1).alias("rank"), F.lit(None).cast("long").alias("refers_to"), "page_id", "url", "payload").unionByName(
        revisits.select("page_key", "tie", "digest", F.lit(0).alias("rank"), "refers_to"), allowMissingColumns=True
    )
    dealt = both.withColumn("shard", shard_of("page_key", "tie")).repartitionById(shards, "shard").sortWithinPartitions(*order)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, told = None, None
        for batch in batches:
            out = []
            for i in range(batch.num_rows):  # one page at a time as Python objects
                r = {name: batch.column(k)[i].as_py() for k, name in enumerate(batch.schema.names)}
                key = (r["page_key"], r["tie"], r["digest"])
                if r["rank"] == 0:
                    told = (key, r["refers_to"])
                    continue
                if files is None or files.shard != r["shard"]:
                    if files:
                        files.close()
                    files = _Files(folder, r["shard"], roll_bytes)
                refers = told[1] if told and told[0] == key and told[1] != r["page_id"] else None
                name, at, size = files.add(make_record(r["page_id"], r["url"], r["payload"], refers, date))
                out.append({"page_id": r["page_id"], "file": name, "offset": at, "length": size})
            yield pa.RecordBatch.from_pylist(out, manifest_arrow)
        if files:
            files.close()

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    manifest_arrow = to_arrow_schema(StructType.fromDDL(MANIFEST))
    system, path = pafs.FileSystem.from_uri(folder)
    system.create_dir(path, recursive=True)
    dealt.select(*order, "refers_to", "page_id", "url", "payload").mapInArrow(write, MANIFEST).write.parquet(f"{folder}/manifest")
    return spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")


def read_archives(spark: SparkSession, folder: str) -> DataFrame:
    """The records of the files that the manifest lists, one row each, every digest checked."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    schema = to_arrow_schema(StructType.fromDDL(RECORD))
    files = spark.read.schema(MANIFEST).parquet(f"{folder}/manifest").groupBy("file").agg(F.sum("length").alias("size"), F.count("*").alias("n"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, path = pafs.FileSystem.from_uri(folder)
        for batch in batches:
            for name, size, n in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                seen, out, held = 0, [], 0
                with system.open_input_stream(f"{path}/{name}", compression=None) as f:
                    unpack, data, rest = zlib.decompressobj(31), [], b""
                    total = 0
                    while chunk := rest or f.read(1 << 20):
                        total += 0 if rest else len(chunk)
                        data.append(unpack.decompress(chunk))
                        rest = b""
                        if unpack.eof:
                            record = parse_record(b"".join(data))
                            rest, unpack, data = unpack.unused_data, zlib.decompressobj(31), []
                            out.append(record)
                            seen, held = seen + 1, held + record["payload_bytes"]
                            if held > 4_000_000 or len(out) > 5000:
                                yield pa.RecordBatch.from_pylist(out, schema)
                                out, held = [], 0
                if seen != n or total != size or data:
                    raise WarcError(f"{name} holds {seen} records in {total} bytes; the manifest has {n} in {size}")
                yield pa.RecordBatch.from_pylist(out, schema)

    # A given number of partitions, for file names are too small to be dealt out by their size; by a hash, for Spark
    # would otherwise stay with the partitions of the aggregate, which it coalesces.
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    return files.select("file", "size", "n").repartition(tasks, F.xxhash64("file")).mapInArrow(read, RECORD)


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``pages`` written as WARC archives in the shared folder and read back."""
    folder = f"{shared_root(spark)}/warc-{uuid.uuid4().hex}"
    write_archives(table(spark, sf_dir, "pages"), folder)
    return read_archives(spark, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
