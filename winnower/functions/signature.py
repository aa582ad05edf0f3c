"""MinHash signatures and band values over character n-grams.

The hash family is seeded XXH3-64, which Spark lacks, so this is an Arrow function. With many seeds it hashes each distinct n-gram
of a chunk once for each seed, for texts share most of their n-grams, and looks at those texts alone that have one of the least hashes: a
text of many n-grams has its minimum among these but in one case of millions, in which all of its n-grams are looked at. With few seeds it
hashes every n-gram, for telling them apart would take longer.
Unsigned 64-bit values travel as the signed longs of the same bits.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType

from ..config import MinHashConfig
from .xxh3 import Rows

U64 = np.uint64
MAX = U64(0xFFFFFFFFFFFFFFFF)
#: n-grams of texts that are hashed at once: tables of this size stay in a core's cache.
CHUNK_GRAMS = 500_000
#: Hashes of a signature up to which n-grams aren't told apart, and n-grams that are hashed at once then; bytes of texts whose n-grams are told
#: apart together for more.
FEW_HASHES = 8
FEW_GRAMS = 100_000
MANY_GRAMS = 8 << 20
#: Rows that are hashed at once.
HASHED_ROWS = 8192
#: Least distinct n-grams of the classes of texts, and how many of a text of the least are looked at in expectation.
CLASSES = (0, 128, 512, 2048, 8192)
LOOKED_AT = 16
#: Texts of a batch that are hashed before the next are taken from it, and as many where n-grams are told apart: these share more of them.
ROWS_AT_ONCE = 1024
MANY_ROWS = 4096
#: Bytes of values of one length that are hashed together.
HASH_BYTES = 4 << 20


def _chunk_grams(texts: list[bytes], n: int, distinct: bool = True) -> tuple[np.ndarray, np.ndarray, list[Rows]]:
    """(text, n-gram) numbers of each n-gram of a text once, texts together, and the n-grams by length in bytes; without
    ``distinct`` each as often as it stands there, under numbers of their own."""
    nothing = np.zeros(0, np.int64), np.zeros(0, np.int64), []
    data = np.frombuffer(b"".join(texts), np.uint8)
    sizes = np.array([len(t) for t in texts], np.int64)
    starts = np.flatnonzero((data & 0xC0) != 0x80)  # of characters
    if not n or len(starts) < n:
        return nothing
    owner = np.searchsorted(np.cumsum(sizes), starts, "right")
    inside = owner[: len(starts) - n + 1] == owner[n - 1 :]
    low, high, owner = starts[: len(starts) - n + 1][inside], np.append(starts, len(data))[n:][inside], owner[: len(starts) - n + 1][inside]
    if not len(low):
        return nothing
    length = high - low
    ids = np.empty(len(low), np.int64)
    tables, count = [], 0
    for size in np.unique(length).tolist():
        at = np.flatnonzero(length == size)
        rows = data[low[at][:, None] + np.arange(size)]
        if not distinct:
            tables.append(Rows(rows))
            ids[at] = count + np.arange(len(at))
            count += len(at)
            continue
        if size <= 8:
            packed = np.zeros((len(at), 8), np.uint8)
            packed[:, :size] = rows
            keys = packed.view(np.uint64).reshape(-1)
        else:
            keys = np.ascontiguousarray(rows).view(f"V{size}").reshape(-1)
        _, first, inverse = np.unique(keys, return_index=True, return_inverse=True)
        tables.append(Rows(rows[first]))
        ids[at] = count + inverse.reshape(-1)
        count += len(first)
    if not distinct:
        return owner, ids, tables
    pairs = np.sort(owner * count + ids)
    pairs = pairs[np.append(True, pairs[1:] != pairs[:-1])]
    return pairs // count, pairs % count, tables


def _table_digests(tables: list[Rows], seed: int, out: np.ndarray) -> np.ndarray:
    at = 0
    for t in tables:
        t.digest(seed, out[at : at + t.n])
        at += t.n
    return out


@dataclass
class _Told:
    """The distinct n-grams of texts by length in bytes, in ``tables``, and ``owner``: the texts that have n-gram i are
    owner[low[i] : high[i]]."""

    owner: np.ndarray
    low: np.ndarray
    high: np.ndarray
    tables: list[Rows]


def _encoded(grams: np.ndarray) -> tuple[np.ndarray, list[Rows]]:
    """The order of rows of code points by length in UTF-8, and their bytes."""
    known, place = np.unique(grams, return_inverse=True)
    each = [chr(c).encode() for c in known.tolist()]
    size = np.array([len(c) for c in each], np.int64)[place.reshape(grams.shape)]
    data = np.frombuffer(b"".join(c.ljust(4) for c in each), np.uint8).reshape(-1, 4)[place.reshape(grams.shape)]
    begin, total = np.cumsum(size, axis=1) - size, size.sum(axis=1)
    order, tables = np.argsort(total, kind="stable"), []
    for length in np.unique(total).tolist():
        at = order[np.searchsorted(total[order], length) : np.searchsorted(total[order], length, "right")]
        rows = np.zeros((len(at), length), np.uint8)
        for c in range(grams.shape[1]):
            for k in range(4):
                have = np.flatnonzero(size[at, c] > k)
                rows[have, begin[at[have], c] + k] = data[at[have], c, k]
        tables += [Rows(rows[i : i + HASHED_ROWS]) for i in range(0, len(rows), HASHED_ROWS)]
    return order, tables


def _told(texts: list[bytes], n: int) -> _Told | None:
    """None where no text has an n-gram."""
    sizes = np.array([len(t.decode()) for t in texts], np.int64)
    points = np.frombuffer(b"".join(texts).decode().encode("utf-32-le"), np.uint32)
    count = len(points) - n + 1
    if n <= 0 or count <= 0:
        return None
    alphabet = np.flatnonzero(np.bincount(points))
    bits, of = max(1, (len(alphabet) - 1).bit_length()), (len(texts) - 1).bit_length()
    if n * bits + of > 64:  # then an n-gram and its text aren't one number
        owner, ids, tables = _chunk_grams(texts, n)
        if not len(ids):
            return None
        keyed = np.sort(ids.astype(np.uint64) << np.uint64(32) | owner.astype(np.uint64))
        ends = np.cumsum(np.bincount(ids, minlength=sum(t.n for t in tables)))
        return _Told((keyed & np.uint64(0xFFFFFFFF)).astype(np.int32), np.append(0, ends[:-1]), ends, tables)
    owner = np.repeat(np.arange(len(texts), dtype=np.uint64), sizes)
    code = np.zeros(int(alphabet[-1]) + 1, np.uint64)
    code[alphabet] = np.arange(len(alphabet), dtype=np.uint64)
    codes = code[points]
    keyed = codes[:count].copy()
    for k in range(1, n):
        keyed <<= np.uint64(bits)
        keyed |= codes[k : k + count]
    keyed <<= np.uint64(of)
    keyed |= owner[:count]
    keyed = np.sort(keyed[owner[:count] == owner[n - 1 :]])
    if not len(keyed):
        return None
    keyed = keyed[np.append(True, keyed[1:] != keyed[:-1])]
    grams = keyed >> np.uint64(of)
    first = np.flatnonzero(np.append(True, grams[1:] != grams[:-1]))
    grams = grams[first]
    chars = np.stack([grams >> np.uint64(bits * (n - 1 - k)) & np.uint64((1 << bits) - 1) for k in range(n)], axis=1)
    order, tables = _encoded(alphabet[chars.astype(np.int64)])
    return _Told((keyed & np.uint64((1 << of) - 1)).astype(np.int32), first[order], np.append(first[1:], len(keyed))[order], tables)


def _ranges(low: np.ndarray, many: np.ndarray) -> np.ndarray:
    """The numbers from low on, as many as there are, of all ranges."""
    ends = np.cumsum(many, dtype=many.dtype)
    return np.repeat(low - ends + many, many) + np.arange(ends[-1] if len(ends) else 0, dtype=many.dtype)


def _told_signatures(texts: list[bytes], config: MinHashConfig) -> np.ndarray:
    """(texts, total_hashes) minima; MAX where a text has no n-gram."""
    out = np.full((config.total_hashes, len(texts)), MAX, np.uint64)
    told = _told(texts, config.ngram_size)
    if told is None:
        return out.T
    many = np.bincount(told.owner, minlength=len(texts))
    kind = np.searchsorted(CLASSES, many, "right") - 1
    # The least class has so few n-grams that all of them are looked at, text by text.
    small = np.flatnonzero(kind[told.owner] == 0)
    place = np.empty(len(told.owner), np.int32)
    place[_ranges(told.low, told.high - told.low)] = np.repeat(np.arange(len(told.low), dtype=np.int32), told.high - told.low)
    small = small[np.argsort(told.owner[small], kind="stable")]
    small_grams, small_owner = place[small], told.owner[small]
    begin = np.flatnonzero(np.append(True, small_owner[1:] != small_owner[:-1])) if len(small) else small
    classes = []
    for k, least in enumerate(CLASSES[1:], 1):
        if (members := np.flatnonzero(kind == k)).size:
            own = kind[told.owner] == k
            upto = np.append(np.int32(0), np.cumsum(own, dtype=np.int32))
            classes.append((members, told.owner[own], upto[told.low], upto[told.high] - upto[told.low], U64(min(int(LOOKED_AT * ((1 << 64) // least)), int(MAX)))))
    hashes = np.empty(len(told.low), np.uint64)
    for seed in range(config.total_hashes):
        _table_digests(told.tables, seed, hashes)
        row = out[seed]
        if len(small):
            row[small_owner[begin]] = np.minimum.reduceat(hashes[small_grams], begin)
        some = None
        for members, owner, low, number, limit in classes:  # each limit is lower than the one before
            near = np.flatnonzero((hashes if some is None else least) < limit)
            some = near if some is None else some[near]
            least = hashes[some]
            np.minimum.at(row, owner[_ranges(low[some], number[some])], np.repeat(least, number[some]))
            for text in members[row[members] == MAX].tolist():
                row[text] = hashes[place[told.owner == text]].min()
    return out.T


def _chunk_signatures(texts: list[bytes], config: MinHashConfig) -> np.ndarray:
    """(texts, total_hashes) minima; MAX where a text has no n-gram."""
    if config.total_hashes > FEW_HASHES:
        return _told_signatures(texts, config)
    out = np.full((len(texts), config.total_hashes), MAX, np.uint64)
    owner, ids, tables = _chunk_grams(texts, config.ngram_size, False)
    if not len(ids):
        return out
    begin = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
    rows_of = owner[begin]
    hashes, gathered = np.empty(sum(t.n for t in tables), np.uint64), np.empty(len(ids), np.uint64)
    for seed in range(config.total_hashes):
        if len(tables) == 1:  # then numbers are places
            gathered = tables[0].digest(seed)
        else:
            np.take(_table_digests(tables, seed, hashes), ids, out=gathered, mode="clip")
        out[rows_of, seed] = np.minimum.reduceat(gathered, begin)
    return out


def _chunks(texts: list[str], grams: int = CHUNK_GRAMS) -> Iterator[list[bytes]]:
    held, size = [], 0
    for t in texts:
        held.append(t.encode())
        size += len(held[-1])
        if size >= grams:
            yield held
            held, size = [], 0
    if held:
        yield held


def gram_hash_sets(texts: list[str], n: int) -> list[np.ndarray]:
    """The seed-0 hashes of each text's distinct n-grams."""
    out: list[np.ndarray] = []
    for part in _chunks(texts):
        owner, ids, tables = _chunk_grams(part, n)
        hashes = _table_digests(tables, 0, np.empty(sum(t.n for t in tables), np.uint64))[ids] if len(ids) else np.zeros(0, np.uint64)
        bounds = np.searchsorted(owner, np.arange(len(part) + 1))
        out += [np.unique(hashes[a:b]).view(np.int64) for a, b in zip(bounds, bounds[1:], strict=False)]
    return out


def _strings(rows: np.ndarray) -> pa.Array:
    """Rows of equal length in UTF-8."""
    offsets = np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]
    return pa.StringArray.from_buffers(len(rows), pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(rows)))


def gram_counts(texts: DataFrame, n: int) -> DataFrame:
    """gram and n_docs, the rows of ``texts`` (text) that have it: n-grams are told apart and counted in chunks of texts first, which share
    most of them, so what is moved are a chunk's distinct n-grams. Null texts have none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in _pieces(batch.column(0).drop_null()):
                for part in _chunks(piece.to_pylist()):
                    _, ids, tables = _chunk_grams(part, n)
                    counts, at = np.bincount(ids, minlength=1), 0
                    for t in tables:
                        yield pa.RecordBatch.from_arrays([_strings(t.data), pa.array(counts[at : at + t.n])], names=["gram", "n"])
                        at += t.n

    return texts.select("text").mapInArrow(run, "gram string, n long").groupBy("gram").agg(F.sum("n").alias("n_docs"))


def signatures(texts: list[str], config: MinHashConfig) -> np.ndarray:
    """(texts, total_hashes) of unsigned minima."""
    grams = FEW_GRAMS if config.total_hashes <= FEW_HASHES else MANY_GRAMS
    parts = [_chunk_signatures(part, config) for part in _chunks(texts, grams)]
    return np.concatenate(parts) if parts else np.zeros((0, config.total_hashes), np.uint64)


def bands(found: np.ndarray, config: MinHashConfig) -> np.ndarray:
    """(texts, num_buckets) digests of each band's hashes as little-endian bytes."""
    rows, b = len(found), config.band_size
    out = np.zeros((rows, config.num_buckets), np.uint64)
    raw = np.ascontiguousarray(found, "<u8").view(np.uint8).reshape(rows, -1) if found.size else np.zeros((rows, 0), np.uint8)
    for k in range(config.num_buckets):
        out[:, k] = Rows(raw[:, 8 * b * k : 8 * b * (k + 1)]).digest(0)
    return out


def _lists(values: np.ndarray) -> pa.Array:
    rows, width = values.shape
    flat = pa.array(np.ascontiguousarray(values).view(np.int64).reshape(-1))
    return pa.ListArray.from_arrays(pa.array(np.arange(rows + 1, dtype=np.int32) * width), flat)


def _pieces(part: pa.Array, rows: int = ROWS_AT_ONCE) -> Iterator[pa.Array]:
    """A batch in pieces of some rows: what a worker holds beside the batch doesn't grow with it."""
    return (part.slice(low, rows) for low in range(0, len(part), rows))


def _udf(make, config: MinHashConfig):
    rows = ROWS_AT_ONCE if config.total_hashes <= FEW_HASHES else MANY_ROWS

    def run(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for part in texts:
            yield pa.concat_arrays([_lists(make(piece.to_pylist())) for piece in _pieces(part, rows)] or [pa.array([], pa.list_(pa.int64()))])

    run.__annotations__ = {"texts": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, ArrayType(LongType()))


def signature(text: Column | str, config: MinHashConfig = MinHashConfig()) -> Column:
    """array<bigint> of total_hashes minima, band after band."""
    return _udf(lambda texts: signatures(texts, config), config)(text)


def band_values(text: Column | str, config: MinHashConfig = MinHashConfig()) -> Column:
    """array<bigint> of num_buckets band digests; the signature itself stays inside the task."""
    return _udf(lambda texts: bands(signatures(texts, config), config), config)(text)


def gram_hashes(text: Column | str, n: int) -> Column:
    """array<bigint> of the hashes of the distinct n-grams: equal n-grams have equal hashes."""

    def run(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for part in texts:
            yield pa.array(gram_hash_sets(part.to_pylist(), n), pa.list_(pa.int64()))

    run.__annotations__ = {"texts": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, ArrayType(LongType()))(text)


def bands_of_signature(found: Column | str, config: MinHashConfig = MinHashConfig()) -> Column:
    """The same digests from a signature column."""

    def run(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for part in parts:
            flat = part.flatten().to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            yield _lists(bands(flat.reshape(len(part), config.total_hashes), config))

    run.__annotations__ = {"parts": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, ArrayType(LongType()))(found)


def signature_slice(found: Column | str, band: int, config: MinHashConfig = MinHashConfig()) -> Column:
    """The hashes of one band."""
    return F.slice(found, band * config.band_size + 1, config.band_size)


def split_of(bucket_value: Column | str) -> Column:
    """The unsigned value modulo 256."""
    return F.col(bucket_value).bitwiseAND(F.lit(255)).cast("int") if isinstance(bucket_value, str) else bucket_value.bitwiseAND(F.lit(255)).cast("int")


def xxh3_64(value: Column | str, seed: int = 0) -> Column:
    """XXH3-64 of a string's UTF-8 or a binary's bytes as the signed long of the same bits; null stays null.

    A batch's values are hashed together by their length, whatever it is."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for part in batches:
            yield digests(part.cast(pa.binary()), seed)

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, LongType())(value)


def digests(values: pa.BinaryArray, seed: int) -> pa.Array:
    _, places, flat = values.buffers()
    offsets, data = np.frombuffer(places, np.int32)[values.offset : values.offset + len(values) + 1], np.frombuffer(flat or b"", np.uint8)
    length, out = np.diff(offsets), np.zeros(len(values), np.int64)
    # Values of one length and of about HASH_BYTES together are rows of a matrix.
    for size in np.unique(length).tolist():
        at = np.flatnonzero(length == size)
        for low in range(0, len(at), max(1, HASH_BYTES // max(1, size))):
            some = at[low : low + max(1, HASH_BYTES // max(1, size))]
            rows = data[offsets[some].astype(np.int64)[:, None] + np.arange(size)] if size else np.zeros((len(some), 0), np.uint8)
            out[some] = Rows(rows).digest(seed).view(np.int64)
    return pa.array(out, mask=np.asarray(values.is_null()))
