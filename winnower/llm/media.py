"""Media columns: baseline JPEG thumbnails, and texts stored as JPEG samples.

Null bytes give ``status`` 'null', bytes that aren't a readable baseline JPEG give 'bad'; their other fields are
null. Nothing is dropped, and every other column of the input stays as it is.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import jpeg
from .common import table, text_or_empty

PAD_BYTE = b"\x20"
#: Bytes that a task encodes or decodes at once.
CHUNK_BYTES = 2_000_000
THUMB = "status string, images int, width int, height int, thumb_width int, thumb_height int, thumb binary, thumb_sha256 string, dhash string"


def _chunks(values: list[bytes | None]) -> Iterator[list[bytes | None]]:
    part, size = [], 0
    for v in values:
        part.append(v)
        size += len(v or b"")
        if size >= CHUNK_BYTES:
            yield part
            part, size = [], 0
    if part:
        yield part


def read_images(values: list[bytes | None]) -> list[dict]:
    """Dimensions, thumbnail and hashes of each value, which holds one or more JPEGs one after another."""
    out, images, owner = [{"status": "null"} for _ in values], [], []
    for i, data in enumerate(values):
        if data is None:
            continue
        try:
            at, own = 0, []
            while at < len(data) or not own:
                image = jpeg.parse(data, at)
                own.append((data, image))
                at = image.end
            images += own
            owner += [i] * len(own)
            out[i] = {"status": "ok", "images": len(own), "width": own[0][1].width, "height": sum(x[1].height for x in own)}
        except jpeg.JpegError:
            out[i] = {"status": "bad"}
    thumbs: dict[int, list] = {}
    for i, thumb in zip(owner, jpeg.thumbnails(images), strict=True):  # None where a scan is broken
        thumbs.setdefault(i, []).append(thumb)
    for i, parts in thumbs.items():
        if any(x is None for x in parts) or len({x.shape[1] for x in parts}) > 1:
            out[i] = {"status": "bad"}
            continue
        thumb = np.concatenate(parts)
        data = thumb.tobytes()
        out[i] |= {"thumb_width": thumb.shape[1], "thumb_height": thumb.shape[0], "thumb": data, "thumb_sha256": hashlib.sha256(data).hexdigest(), "dhash": f"{jpeg.difference_hash(thumb):016x}"}
    return out


def _output(df: DataFrame, more: str, drop: tuple[str, ...] = ()) -> tuple[list[int], object]:
    """Positions of the columns that stay, by place and not by name, and the schema with ``more`` after them."""
    from pyspark.sql.types import StructType, _parse_datatype_string

    keep = [i for i, f in enumerate(df.schema.fields) if f.name not in drop]
    new = _parse_datatype_string(more).fields
    return keep, StructType([df.schema.fields[i] for i in keep] + new)


def thumbnails(df: DataFrame, column: str = "media", *, keep_media: bool = True) -> DataFrame:
    """``df`` with a struct column ``image``: status, dimensions, the DC-only luminance thumbnail and its hashes."""
    from pyspark.sql.pandas.types import to_arrow_schema

    keep, schema = _output(df, f"image struct<{THUMB.replace(' ', ':').replace(',:', ',')}>", () if keep_media else (column,))
    at, arrow = df.columns.index(column), to_arrow_schema(schema)
    kind = arrow.field(len(arrow) - 1).type

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            low = 0
            for part in _chunks(batch.column(at).to_pylist()):
                cut = batch.slice(low, len(part))
                low += len(part)
                yield pa.RecordBatch.from_arrays([cut.column(i) for i in keep] + [pa.array(read_images(part), kind)], schema=arrow)

    return df.mapInArrow(decode, schema)


def store_text(df: DataFrame, text: str = "text", media: str = "media") -> DataFrame:
    """``df`` with its text column replaced by ``media``: the padded UTF-8 bytes as DC terms of JPEG blocks.

    Null and empty texts become one row of padding. ``n_bytes`` is the unpadded length.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    keep, schema = _output(df, f"n_bytes long, {media} binary", (text,))
    at, arrow = df.columns.index(text), to_arrow_schema(schema)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            low = 0
            for part in _chunks(batch.column(at).cast(pa.binary()).to_pylist()):
                cut = batch.slice(low, len(part))
                low += len(part)
                size = [len(x or b"") for x in part]
                full = [(x or b"") + PAD_BYTE * (max(1, -(-n // jpeg.ROW_BLOCKS)) * jpeg.ROW_BLOCKS - n) for x, n in zip(part, size, strict=True)]
                yield pa.RecordBatch.from_arrays([cut.column(i) for i in keep] + [pa.array(size, pa.int64()), pa.array(jpeg.encode(full), pa.binary())], schema=arrow)

    return df.mapInArrow(encode, schema)


def op10_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text of ``documents`` stored as JPEG blocks and read back by the thumbnail decoder."""
    docs = table(spark, sf_dir, "documents").select("doc_id", text_or_empty().alias("text"))
    read = thumbnails(store_text(docs)).withColumn("payload", F.col("image.thumb"))
    tail = F.substring("payload", -16, 16)
    return read.select(
        "doc_id",
        "n_bytes",
        F.length("payload").cast("long").alias("payload_bytes"),
        F.col("image.thumb_sha256").alias("payload_sha256"),
        F.crc32(tail).alias("tail_crc32"),
        F.length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        F.format_string("images=%d;size=%dx%d;thumb=%dx%d;dhash=%s", "image.images", "image.width", "image.height", "image.thumb_width", "image.thumb_height", "image.dhash").alias("feature"),
    )


__all__ = ["op10_media_columns", "read_images", "store_text", "thumbnails"]
