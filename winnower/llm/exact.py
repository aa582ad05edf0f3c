"""Exact dedup by progressive refinement: length, then a hash of the beginning, then a hash of the whole text.

One scan puts down each row's length and the hash of its first characters, and no text. Rows that share neither with another
row are alone, and settled. The keys of the rest are set as bits in a bitmap of bounded size, which goes to every task of a second scan: only
texts whose bit is set are hashed in whole, and only these rows are shuffled. A bit that several keys share costs a hash and
changes nothing. With more keys than the bitmap can tell apart, more texts are hashed, up to all of them; it never grows.

Groups are aggregated before the shuffle. A group of 1 / HOT of the rows or more, of which there can't be more than HOT, is
broadcast to its rows; all others are joined by digest, so no task has a third of all rows.

Texts are equal when they are identical after lower-casing A-Z only, and SHA-256 stands for the whole text.

Defined cases: null texts equal empty ones. Of equal texts the row with the largest id stays; null ids are below
all others and make a group's ``keep_id`` null where no row has one. Rows that are repeated as a whole count each, carry the same
result, and drop_exact() leaves one of them. An empty table gives no rows. Columns beside id and text aren't read,
and drop_exact() keeps them whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import joined_by_digest, staged, table

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Characters that the second refinement hashes.
PREFIX_CHARS = 256
#: Bits of the bitmap of shared keys at most (16 MB), how many a key gets below that, and bits of one of its rows.
MAX_BITS = 1 << 27
BITS_PER_KEY = 16
ROW_BITS = 32_768


def normal(text: Column) -> Column:
    """Null as empty, A-Z in lower case and nothing else changed. lower() does that to texts of ASCII alone, and faster."""
    text = F.coalesce(text, F.lit(""))
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def _key(text: Column, prefix_chars: int) -> list[Column]:
    """The first two refinements. Neither needs the whole text in lower case: A-Z are one byte in both cases."""
    text = F.coalesce(text, F.lit(""))
    return [F.octet_length(text).cast("long").alias("length"), F.xxhash64(normal(F.left(text, F.lit(prefix_chars)))).alias("prefix")]


def refined(docs: DataFrame, text_col: str = "text", *, prefix_chars: int = PREFIX_CHARS) -> DataFrame:
    """length, prefix and n of the keys that several rows share, as a written table: what length leaves, and of that what
    the beginning leaves."""
    keys = staged(docs.select(*_key(F.col(text_col), prefix_chars)).groupBy("length", "prefix").agg(F.count("*").alias("n")), "keys")
    lengths = keys.groupBy("length").agg(F.sum("n").alias("of_length")).filter("of_length > 1").select("length")
    return staged(keys.filter("n > 1").join(lengths, "length", "left_semi"), "shared-keys")


def _place(bits: int) -> Column:
    return F.pmod(F.xxhash64("length", "prefix"), F.lit(bits)) + 1


def _bitmap(shared: DataFrame) -> tuple[DataFrame, int]:
    """Rows (bucket, bitmap) of at most MAX_BITS / ROW_BITS, and the number of bits that keys are dealt to."""
    bits = min(MAX_BITS, max(ROW_BITS, 1 << (BITS_PER_KEY * shared.count()).bit_length()))
    place = _place(bits)
    rows = shared.select(F.bitmap_bucket_number(place).alias("bucket"), F.bitmap_bit_position(place).alias("at"))
    return rows.groupBy("bucket").agg(F.bitmap_construct_agg("at").alias("bitmap")), bits


def _is_set(bitmap: Column, at: Column) -> Column:
    byte = F.conv(F.hex(F.substring(bitmap, F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return F.coalesce(F.getbit(byte, F.pmod(at, F.lit(8)).cast("int")) == 1, F.lit(False))


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, prefix_chars: int = PREFIX_CHARS, hash_all: bool = False, carry: tuple[Column, ...] = ()) -> DataFrame:
    """doc_id and ``digest`` of every row, null where length or beginning already tell that a row is alone. With
    ``hash_all`` also ``hash`` of every text, which groups nothing. Columns of ``carry`` come along."""
    bitmap, bits = _bitmap(refined(docs, text_col, prefix_chars=prefix_chars))
    place = _place(bits)
    rows = docs.select(*carry, F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), *_key(F.col(text_col), prefix_chars))
    rows = rows.withColumn("bucket", F.bitmap_bucket_number(place)).withColumn("at", F.bitmap_bit_position(place))
    near = rows.join(F.broadcast(bitmap), "bucket", "left").withColumn("near", _is_set(F.col("bitmap"), F.col("at"))).drop("bucket", "at", "bitmap", "length", "prefix")
    whole = F.unhex(F.sha2(normal(F.col("text")), 256))
    if hash_all:
        return near.withColumn("hash", whole).withColumn("digest", F.when(F.col("near"), F.col("hash"))).drop("near", "text")
    return near.withColumn("digest", F.when(F.col("near"), whole)).drop("near", "text")


def grouped(rows: DataFrame) -> DataFrame:
    """keep_id, group_size and kept beside the columns of a written table that digests() made."""
    alone = rows.filter("digest is null").select("*", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"))
    met = rows.filter("digest is not null")
    groups = met.groupBy("digest").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    found = alone.unionByName(joined_by_digest(met, staged(groups, "groups"), "digest", "group_size"))
    return found.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("keep_id")))


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, prefix_chars: int = PREFIX_CHARS, hash_all: bool = False) -> DataFrame:
    """doc_id, keep_id, group_size and kept of every row; ``digest`` and, with ``hash_all``, ``hash`` as digests() has them."""
    return grouped(staged(digests(docs, id_col, text_col, prefix_chars=prefix_chars, hash_all=hash_all), "digests"))


def drop_exact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, prefix_chars: int = PREFIX_CHARS) -> DataFrame:
    """``docs`` with one row of each group of equal texts, all its columns as they were. Only rows that may have a copy
    are moved."""
    packed = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"), F.struct(*(docs[c] for c in docs.columns)).alias("row"))
    rows = digests(packed, prefix_chars=prefix_chars, carry=(F.col("row"),))
    met = rows.filter("digest is not null")
    stays = met.groupBy("digest").agg(F.max("doc_id").alias("keep_id"))
    ids = stays.select(F.col("digest").alias("of"), "keep_id")
    # Repeated rows are collapsed before they are moved, and a group of many ids is spread by its ids.
    one = met.dropDuplicates(["digest", "doc_id"]).join(ids, (F.col("digest") == F.col("of")) & F.col("doc_id").eqNullSafe(F.col("keep_id")))
    return rows.filter("digest is null").select("row.*").unionByName(one.select("row.*"))


def op11_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of ``documents`` with the row of its text that stays."""
    found = exact_groups(table(spark, sf_dir, "documents"), hash_all=True)
    return found.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("hash")).alias("text_sha256"))


SQL = f"""
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size, doc_id = max(doc_id) OVER same AS kept, sha256(norm) AS text_sha256
FROM (SELECT doc_id, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS norm FROM documents) WINDOW same AS (PARTITION BY norm)
"""
