"""SimHash near-duplicates by anchor-point covering.

Two fingerprints within 3 bits of each other are, by pigeonhole, within 1 bit in one of their 32-bit halves. The
anchors of a half are a covering code: the perfect [31,26] Hamming code beside one free bit, of covering radius 1. Each
half is replicated to every anchor within radius + threshold = 2 of it (17 anchors): its home, at distance 1 at
most, is then also an anchor of every half within 1 bit of it. Fingerprints that meet at an anchor are compared over
all 64 bits if one of them is at home there.

Distinct fingerprints alone are compared. An anchor of more than BLOCK of them is split into blocks, and every pair
of blocks becomes a task of its own, so no task holds more than two blocks whatever the group. A task links what
it compares by a spanning forest and not by all pairs. Components come from hash-partitioned joins (graph.py).

Defined cases: null and empty texts have fingerprint zero. Rows with a null id get a fingerprint and a null
component unless a row with an id has a linked fingerprint; then that component. Equal ids count as one
document wherever their fingerprints link. Columns beside id and text aren't read.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType

from .common import staged, table, with_column
from .graph import components

SHINGLE_WORDS = 3
SEED = 42
MAX_BITS = 3
BLOCK = 4096
#: Bytes of hash bits that are counted at once.
COUNT_ROWS = 65_536


def text_hashes(text: bytes, words: int = SHINGLE_WORDS) -> list[int]:
    """XXH64 of each shingle of ``words`` words, repeats included; of the whole sequence where it has fewer."""
    found = text.lower().split()
    if not found:
        return []
    joined, digest = b" ".join(found), xxhash.xxh64_intdigest
    if len(found) <= words:
        return [digest(joined, SEED)]
    ends, at = [], -1
    for w in found:
        at += len(w) + 1
        ends.append(at)
    starts = [0, *(e + 1 for e in ends[: len(ends) - words])]
    return [digest(joined[a:b], SEED) for a, b in zip(starts, ends[words - 1 :], strict=True)]


def fingerprint(text: bytes | None, words: int = SHINGLE_WORDS) -> int:
    """The fingerprint of a text's shingles."""
    return fingerprint_of(np.array(text_hashes(text or b"", words), np.uint64))


def fingerprint_of(hashes: np.ndarray) -> int:
    """64 bits, each 1 if it is set in over half the hashes."""
    if not len(hashes):
        return 0
    counts = np.zeros(64, np.int64)
    for low in range(0, len(hashes), COUNT_ROWS):
        counts += np.unpackbits(hashes[low : low + COUNT_ROWS].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > len(hashes)).tobytes(), "big")


def _fingerprints(texts: list[bytes]) -> pa.Array:
    """The fingerprints' bits as signed longs."""
    return pa.array(np.array([fingerprint(x) for x in texts], np.uint64).view(np.int64))


def _syndromes(half: np.ndarray) -> np.ndarray:
    """Of the low 31 bits: the exclusive-or of the places (1 to 31) of bits that are set; 0 for code words."""
    out = np.zeros(len(half), np.uint32)
    for place in range(1, 32):
        out ^= np.where(half >> np.uint32(place - 1) & np.uint32(1), np.uint32(place), np.uint32(0))
    return out


def _bit(place: np.ndarray) -> np.ndarray:
    """The bit at a place from 1 to 31; 0 for place 0."""
    return np.where(place > 0, np.uint32(1) << np.maximum(place, 1).astype(np.uint32) - np.uint32(1), np.uint32(0)).astype(np.uint32)


def anchors(half: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For 32-bit halves: (n, 17) anchors within distance 2, and whether each is a home (within 1).

    A code word has itself and itself with the free bit flipped. Another half has the nearest code word with either
    value of the free bit, and the 15 code words at distance 2. Places that aren't used repeat the home.
    """
    s = _syndromes(half)
    near = half ^ _bit(s)
    out = np.repeat(near[:, None], 17, axis=1)
    home = np.zeros(out.shape, bool)
    home[:, 0] = True
    out[:, 1] = near ^ np.uint32(1 << 31)
    home[:, 1] = s == 0
    column = np.full(len(half), 2)
    for a in range(1, 32):  # pairs of places whose exclusive-or is the syndrome
        b = s ^ np.uint32(a)
        rows = np.flatnonzero((s > 0) & (b > a))
        out[rows, column[rows]] = half[rows] ^ _bit(np.full(len(rows), a)) ^ _bit(b[rows])
        column[rows] += 1
    return out, home


def _replicas(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for low in range(0, batch.num_rows, 50_000):
            fp = batch.column(0).slice(low, 50_000).to_numpy(zero_copy_only=False).astype(np.int64)
            bits = fp.view(np.uint64)
            for part in (0, 1):
                half = (bits >> np.uint64(32 * part) & np.uint64(0xFFFFFFFF)).astype(np.uint32)
                code, home = anchors(half)
                keep = np.ones(code.shape, bool)
                keep[:, 2:] = code[:, 2:] != code[:, :1]
                key = (code.astype(np.int64) << 1 | part)[keep]
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(np.repeat(fp, keep.sum(axis=1))), pa.array(home[keep])], names=["anchor", "fp", "home"])


def _popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x)


def _forest(fp: np.ndarray, home: np.ndarray, bits: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Places of rows whose links connect what comparisons within one anchor connect: a breadth-first spanning forest."""
    edges, left = [], np.arange(len(fp))
    while len(left) > 1:
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            x = queue.pop()
            hit = (_popcount(fp[left] ^ fp[x]) <= bits) & (home[left] | home[x])
            if hit.any():
                found = left[hit]
                edges.append((np.full(len(found), x), found))
                queue += found.tolist()
                left = left[~hit]
    return edges


def _links(bits: int):
    """Rows (anchor, i, j, fp, home, node), each anchor's together, to links between nodes."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(key: np.ndarray, fp: np.ndarray, home: np.ndarray, node: np.ndarray) -> pa.RecordBatch:
            bounds = np.flatnonzero(np.append(True, (key[1:] != key[:-1]).any(axis=1)))
            sizes = np.diff(np.append(bounds, len(fp)))
            a, b = [], []
            small = np.repeat(sizes <= 16, sizes)
            for shift in range(1, int(min(16, sizes.max()))):  # pairs at this distance in the sorted rows
                same = (key[shift:] == key[:-shift]).all(axis=1) & small[shift:] & (home[shift:] | home[:-shift])
                near = _popcount(fp[:-shift][same] ^ fp[shift:][same]) <= bits
                a.append(node[:-shift][same][near])
                b.append(node[shift:][same][near])
            for low, n in zip(bounds[sizes > 16].tolist(), sizes[sizes > 16].tolist(), strict=True):
                for x, y in _forest(fp[low : low + n], home[low : low + n], bits):
                    a.append(node[low + x])
                    b.append(node[low + y])
            x, y = (np.concatenate(z or [np.zeros(0, np.int64)]) for z in (a, b))
            apart = x != y
            return pa.RecordBatch.from_arrays([pa.array(x[apart]), pa.array(y[apart])], names=["a", "b"])

        held = None
        for batch in batches:
            key = np.stack([batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(3)], axis=1)
            fp = batch.column(3).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            home = batch.column(4).to_numpy(zero_copy_only=False).astype(bool)
            node = batch.column(5).to_numpy(zero_copy_only=False).astype(np.int64)
            if held:
                key, fp, home, node = (np.concatenate([x, y]) for x, y in zip(held, (key, fp, home, node), strict=True))
            if not len(fp):
                continue
            last = int(np.flatnonzero(np.append(True, (key[1:] != key[:-1]).any(axis=1)))[-1])
            held = (key[last:], fp[last:], home[last:], node[last:])
            if last:
                yield flush(key[:last], fp[:last], home[:last], node[:last])
        if held:
            yield flush(*held)

    return compare


def anchored_links(rows: DataFrame, bits: int, block: int = BLOCK) -> DataFrame:
    """Links (a, b) between nodes of a written table (anchor, fp, home, node) that meet at an anchor within ``bits``."""
    crowds = rows.groupBy("anchor").agg(F.count("*").alias("n")).filter("n > 1")
    # Anchors of one fingerprint compare nothing. Of the rest, those beyond a block are dealt to pairs of blocks.
    met = rows.join(crowds, "anchor")
    few = met.filter(F.col("n") <= block).select("anchor", F.lit(0).alias("i"), F.lit(0).alias("j"), "fp", "home", "node")
    parts = F.ceil(F.col("n") / block).cast("int")
    own = F.pmod(F.xxhash64("node"), parts).cast("int")
    many = (
        met.filter(F.col("n") > block)
        .withColumn("own", own)
        .withColumn("other", F.explode(F.sequence(F.lit(0), parts - 1)))
        .select("anchor", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "fp", "home", "node")
    )
    dealt = few.unionByName(many).repartition("anchor", "i", "j").sortWithinPartitions("anchor", "i", "j", "fp")
    return dealt.mapInArrow(_links(bits), "a long, b long").distinct()


def fingerprint_links(fps: DataFrame, *, bits: int = MAX_BITS, block: int = BLOCK) -> DataFrame:
    """Links (a, b) that connect all distinct values of ``fp`` within ``bits`` (3 at most) of each other."""
    if not 0 <= bits <= 3:
        raise ValueError("anchors are laid out for at most 3 bits")
    rows = staged(fps.select("fp").mapInArrow(_replicas, "anchor long, fp long, home boolean"), "anchors")
    return anchored_links(rows.withColumn("node", F.col("fp")), bits, block)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, bits: int = MAX_BITS) -> DataFrame:
    """id, fp and component_id (the smallest id reachable) of every row."""
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    prints = staged(with_column(texts, "text", "fp", LongType(), _fingerprints).drop("text"), "prints")
    least = prints.groupBy("fp").agg(F.min("doc_id").alias("least"))
    # Equal ids with several fingerprints tie these together.
    ties = prints.filter("doc_id is not null").groupBy("doc_id").agg(F.min("fp").alias("a"), F.max("fp").alias("b"), F.count("*").alias("n")).filter("n > 1 and a <> b").select("doc_id", "a")
    tied = ties.join(prints, "doc_id").filter("fp <> a").select("a", F.col("fp").alias("b"))
    groups = components(fingerprint_links(least, bits=bits).unionByName(tied))
    labelled = least.join(groups.select(F.col("node").alias("fp"), "component"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    ids = labelled.groupBy("component").agg(F.min("least").alias("component_id"))
    by_fp = labelled.join(ids, "component").select("fp", "component_id")
    return prints.join(by_fp, "fp").select(F.col("doc_id").alias(id_col), "fp", "component_id")


#: Similar documents: words of a shingle and the least Jaccard similarity.
SIMILAR_WORDS = 5
SIMILARITY = 0.8
#: Room for rounding in the product of the similarity and a size.
EPSILON = 1e-9
#: Longs of a sketch. Groups of more rows than CROWD are first linked by a forest.
SKETCH = 4
CROWD = 16
#: Groups of more rows than FEW compare wide sketches of so many longs too: a short one rules out no two texts of 600 shingles, and
#: pairs grow with the square of a group. Smaller groups put out less than FEW / 2 pairs for each row.
FEW = 4
WIDE = 32
#: Contents (in expectation) by which common shingles are told, one in ORDER_PART of a larger table's, in how many of these such a
#: one is, and how many are kept at most, the most common ones. They set the order of shingles, which any order may be: no pair
#: depends on them. The part grows with the table, for what a fixed number of contents misses is met by ever more texts.
ORDER_ROWS = 8192
ORDER_PART = 8
COMMON = 3
MAX_COMMON = 250_000
#: Pairs that are put out at once, and pairs of wide sketches.
PAIRS_AT_ONCE = 500_000
WIDE_AT_ONCE = 16_384


#: Contents whose hashes' first halves are broadcast at most: 8 MB. More are joined by a shuffle of the texts.
MAX_ENDS = 1_000_000


def _contents(texts: list[bytes]) -> pa.Array:
    """A hash of 128 bits of each text's words, as two longs: equal for texts that differ in case of A-Z and white space alone."""
    found = [xxhash.xxh3_128_digest(b" ".join(t.lower().split()), SEED) for t in texts]
    return pa.array(np.frombuffer(b"".join(found), ">i8").astype(np.int64).reshape(-1, 2).tolist(), pa.list_(pa.int64()))


#: What tells texts apart, as a column.
CONTENT = ArrayType(LongType())


def shingles(text: bytes) -> np.ndarray:
    """Distinct shingle hashes, sorted as longs."""
    return np.unique(np.array(text_hashes(text, SIMILAR_WORDS), np.uint64).view(np.int64))


def _shingle_sets(texts: list[bytes]) -> pa.Array:
    return pa.array([shingles(t) for t in texts], pa.list_(pa.int64()))


def sketch(found: np.ndarray, bits: int) -> np.ndarray:
    """A bit for each place that a set's shingles fall on: whether their number there is odd. Two sketches differ in as
    many bits as the sets in shingles, at most."""
    return np.packbits((np.bincount(found & (bits - 1), minlength=bits) & 1).astype(np.uint8))


def long_sketch(found: np.ndarray) -> bytes:
    """A sketch of four bits or more for each shingle, a power of two; longer ones fold to shorter."""
    return sketch(found, max(64 * SKETCH, 1 << int(4 * len(found) - 1).bit_length() if len(found) else 0)).tobytes()


def _sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs whose long sketches don't rule out that they are similar."""
    for batch in batches:
        keep = []
        for size, x, y in zip(*(batch.column(c).to_pylist() for c in (2, 3, 4)), strict=True):
            x, y = sorted((np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)), key=len)
            apart = x ^ np.bitwise_xor.reduce(y.reshape(-1, len(x)), axis=0)
            keep.append(int(_popcount(apart).sum(dtype=np.int64)) <= size * ((1 - SIMILARITY) / (1 + SIMILARITY)) + EPSILON)
        yield batch.filter(pa.array(keep, pa.bool_())).select(["a", "b"])


def prefix(found: np.ndarray, common: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The first |A| - ceil(t |A|) + 1 shingles in one order of all: by their count among ``common`` (sorted), 0
    elsewhere, then by hash. Two sets of similarity t have one of these in common."""
    n = len(found) - int(np.ceil(SIMILARITY * len(found) - EPSILON)) + 1
    if not len(common):
        return found[:n]
    at = np.minimum(np.searchsorted(common, found), len(common) - 1)
    return found[np.lexsort((found, np.where(common[at] == found, counts[at], 0)))[:n]]


def _prepared(common: np.ndarray, counts: np.ndarray):
    """(doc_id, text) to doc_id, key (the hash of its words), fingerprint, size, sketches and prefix."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(low, 1000) for b in batches for low in range(0, b.num_rows, 1000)):
            texts = batch.column(1).cast(pa.binary()).to_pylist()
            hashes = [np.array(text_hashes(t, SIMILAR_WORDS), np.uint64) for t in texts]
            prints = np.array([fingerprint_of(x) for x in hashes], np.uint64).view(np.int64)
            sets = [np.unique(x.view(np.int64)) for x in hashes]
            bits = np.array([sketch(x, 64 * SKETCH).view(np.int64) for x in sets], np.int64).reshape(-1, SKETCH)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), _contents(texts), pa.array(prints), pa.array([len(x) for x in sets], pa.int64()), *(pa.array(bits[:, i].copy()) for i in range(SKETCH)), pa.array([sketch(x, 64 * WIDE).tobytes() for x in sets], pa.binary()), pa.array([long_sketch(x) for x in sets], pa.binary()), pa.array([prefix(x, common, counts) for x in sets], pa.list_(pa.int64()))],
                names=["doc_id", "key", "fp", "size", *SKETCH_COLUMNS, "wide", "bits", "prefix"],
            )

    return run


SKETCH_COLUMNS = [f"sketch{i}" for i in range(SKETCH)]


def _near(rows: np.ndarray, wide: np.ndarray | None, i, j) -> np.ndarray:
    """Whether the rows (component, node, size, rank, sketch) at i and j aren't connected yet and may be similar: by size, by what
    lies behind the shingle where they meet, in both sets (enough, if it is the first that they share), by sketch and by wide ones."""
    a, b = rows[i], rows[j]
    size, other = a[..., 2], b[..., 2]
    may = (a[..., 0] != b[..., 0]) & (np.minimum(size, other) >= SIMILARITY * np.maximum(size, other) - EPSILON)
    may &= np.minimum(size - a[..., 3], other - b[..., 3]) >= (size + other) * (SIMILARITY / (1 + SIMILARITY)) - EPSILON
    most = (size + other) * ((1 - SIMILARITY) / (1 + SIMILARITY)) + EPSILON
    may &= _apart(a[..., 4:], b[..., 4:]) <= most
    if wide is not None:
        left = np.flatnonzero(may)
        i, j = (np.broadcast_to(np.arange(len(rows))[x], may.shape) for x in (i, j))
        for some in (left[low : low + WIDE_AT_ONCE] for low in range(0, len(left), WIDE_AT_ONCE)):
            may[some] = _apart(wide[i[some]], wide[j[some]]) <= most[some]
    return may


def _apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """In how many bits sketches differ."""
    return _popcount((a ^ b).view(np.uint64)).sum(axis=-1, dtype=np.int64)


def _pairs(rows: np.ndarray, wide: np.ndarray | None, forest: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of one group's rows that may be similar: all pairs, or a spanning forest of them."""
    if not forest:
        for x in range(len(rows) - 1):
            yield np.array([x]), x + 1 + np.flatnonzero(_near(rows, wide, x, slice(x + 1, None)))
        return
    left = np.arange(len(rows))
    while len(left) > 1:
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            x = queue.pop()
            hit = _near(rows, wide, x, left)
            yield np.array([x]), left[hit]
            queue += left[hit].tolist()
            left = left[~hit]


def _candidates(forest: bool):
    """Rows (shingle, i, j, component, node, size, rank, sketch, and the wide one's bytes or nothing), each group's together, to pairs of
    nodes that may be similar."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(values: np.ndarray) -> Iterator[pa.RecordBatch]:
            key, rows = values[:, :3], values[:, 3 : 7 + SKETCH].copy()
            wide = values[:, 7 + SKETCH :].copy() if values.shape[1] > 7 + SKETCH else None
            bounds = np.flatnonzero(np.append(True, (key[1:] != key[:-1]).any(axis=1)))
            sizes = np.diff(np.append(bounds, len(rows)))
            a, b, held = [], [], 0

            def out() -> pa.RecordBatch:
                ends = np.unique(np.stack([np.concatenate(a), np.concatenate(b)], axis=1), axis=0)
                return pa.RecordBatch.from_arrays([pa.array(ends[:, 0].copy()), pa.array(ends[:, 1].copy())], names=["a", "b"])

            def put(x: np.ndarray, y: np.ndarray) -> int:
                x, y = np.broadcast_arrays(rows[x, 1], rows[y, 1])
                a.append(np.minimum(x, y))
                b.append(np.maximum(x, y))
                return len(y)

            small = np.repeat(sizes <= CROWD, sizes)
            for shift in range(1, int(min(CROWD, sizes.max()))):  # pairs at this distance in the sorted rows
                x = np.flatnonzero((key[shift:] == key[:-shift]).all(axis=1) & small[shift:])
                x = x[_near(rows, wide, x, x + shift)]
                held += put(x, x + shift)
            for low, n in zip(bounds[sizes > CROWD].tolist(), sizes[sizes > CROWD].tolist(), strict=True):
                own = rows[low : low + n]
                if (own[:, 0] == own[0, 0]).all():
                    continue
                for x, y in _pairs(own, None if wide is None else wide[low : low + n], forest):
                    held += put(low + x, low + y)
                    if held > PAIRS_AT_ONCE:
                        yield out()
                        a.clear()
                        b.clear()
                        held = 0
            if held:
                yield out()

        kept = None
        for batch in batches:
            values = np.stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns[: 7 + SKETCH]], axis=1)
            if batch.num_columns > 7 + SKETCH:
                wide = np.frombuffer(b"".join(batch.column(7 + SKETCH).to_pylist()), np.int64).reshape(-1, WIDE)
                values = np.concatenate([values, wide], axis=1)
            if kept is not None:
                values = np.concatenate([kept, values])
            if not len(values):
                continue
            key = values[:, :3]
            last = int(np.flatnonzero(np.append(True, (key[1:] != key[:-1]).any(axis=1)))[-1])
            kept = values[last:]
            if last:
                yield from flush(values[:last])
        if kept is not None:
            yield from flush(kept)

    return compare


def _met(prefixes: DataFrame, nodes: DataFrame, least: int, block: int, forest: bool) -> DataFrame:
    """Pairs (a, b) of nodes that may be similar and share a shingle which ``least`` nodes or more, of two components, have in their prefixes.
    Groups beyond a block are dealt to pairs of blocks."""
    known = prefixes.join(nodes.select("content", "component"), "content")
    made = "a long, b long"
    crowds = known.groupBy("shingle").agg(F.count("*").alias("n"), F.min("component").alias("x"), F.max("component").alias("y"))
    crowds = staged(crowds.filter((F.col("n") >= least) & (F.col("x") != F.col("y"))).select("shingle", "n"), "met")
    columns = ["shingle", "i", "j", "component", F.col("content").alias("node"), "size", "rank", *SKETCH_COLUMNS]
    each = lambda rows, more: rows.join(nodes, "content").select(*columns, *more).repartition("shingle", "i", "j").sortWithinPartitions("shingle", "i", "j", "node")
    parts = F.ceil(F.col("n") / block).cast("int")
    own = F.pmod(F.xxhash64("content"), parts).cast("int")
    many = prefixes.join(crowds.filter(F.col("n") > FEW), "shingle").withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), parts - 1)))
    dealt = many.select("shingle", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "content", "rank")
    found = each(dealt, ["wide"]).mapInArrow(_candidates(forest), made)
    if least > FEW:
        return found
    few = prefixes.join(crowds.filter(F.col("n") <= FEW), "shingle").select("shingle", F.lit(0).alias("i"), F.lit(0).alias("j"), "content", "rank")
    return found.unionByName(each(few, []).mapInArrow(_candidates(forest), made))


def _similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep = []
        for i in range(batch.num_rows):
            x, y = (batch.column(c)[i].values.to_numpy() for c in (2, 3))
            both = len(np.intersect1d(x, y, assume_unique=True))
            keep.append(both >= SIMILARITY * (len(x) + len(y) - both) and both > 0)
        yield batch.filter(pa.array(keep, pa.bool_())).select(["a", "b"])


def common_shingles(texts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Shingles (sorted) that many of the texts have, as far as a part of the contents tells, and their counts."""
    part = min(1_000_000, max(int(1_000_000 * ORDER_ROWS / max(1, texts.count())), 1_000_000 // ORDER_PART))
    told = texts.filter(F.pmod(F.xxhash64("text"), F.lit(1_000_000)) < part).distinct()
    counts = with_column(told, "text", "found", ArrayType(LongType()), _shingle_sets).select(F.explode("found").alias("shingle")).groupBy("shingle").agg(F.count("*").alias("n")).filter(F.col("n") >= COMMON)
    counts = staged(counts, "common")
    # The least count that not more than MAX_COMMON have or exceed; counts beyond COMMON * ORDER_ROWS are told as one.
    levels = counts.groupBy(F.least("n", F.lit(COMMON * ORDER_ROWS)).alias("n")).agg(F.count("*").alias("shingles")).collect()
    least, kept = COMMON * ORDER_ROWS + 1, 0
    for n, shingles_of in sorted(levels, reverse=True):
        kept += shingles_of
        if kept > MAX_COMMON:
            break
        least = n
    found = counts.filter(F.col("n") >= least).toArrow()
    shingle, n = (found.column(c).to_numpy().astype(np.int64) for c in ("shingle", "n"))
    order = np.argsort(shingle)
    return shingle[order], n[order]


def similar_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, block: int = BLOCK) -> DataFrame:
    """doc_id, key (what tells its words, two longs), content (a number for each key) and component of every row: documents linked by a Jaccard similarity of their five-word
    shingles of SIMILARITY or more, exactly.

    Texts of equal words are one node, whatever their number. Fingerprints of five-word shingles that anchors bring together
    within MAX_BITS make the first candidates, and nodes that share a shingle of their prefixes meet: crowds of these are first
    linked by a forest of candidates. All of them are verified. Then every pair of nodes that isn't connected by verified
    links and that size and sketch don't rule out is a candidate, and verified, so neither fingerprints nor a forest decide what
    is tried.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    columns = ", ".join(f"{c} long" for c in ["fp", "size", *SKETCH_COLUMNS])
    rows = texts.mapInArrow(_prepared(*common_shingles(texts.select("text"))), f"doc_id long, key array<long>, {columns}, wide binary, bits binary, prefix array<long>")
    # Numbers of contents, fixed by being written.
    nodes = staged(rows.drop("doc_id").dropDuplicates(["key"]).withColumn("content", F.monotonically_increasing_id()), "contents")
    prints = staged(with_column(texts, "text", "key", CONTENT, _contents).drop("text"), "similar")
    every = nodes.select("content", F.posexplode("prefix").alias("rank", "shingle"))
    prefixes = staged(every.join(every.groupBy("shingle").agg(F.count("*").alias("n")).filter("n > 1").select("shingle"), "shingle"), "prefixes")
    alone = nodes.select("content", F.col("content").alias("component"), "size", *SKETCH_COLUMNS, "wide")
    first = _met(prefixes, alone, CROWD + 1, block, True)
    near = _verified(first.unionByName(_near_prints(nodes, block)), nodes, texts)
    crowds = staged(components(near), "crowds").withColumnRenamed("node", "content")
    joined = alone.drop("component").join(crowds, "content", "left").withColumn("component", F.coalesce("component", "content"))
    links = _verified(_met(prefixes, staged(joined, "joined"), 2, block, False), nodes, texts)
    groups = components(near.unionByName(links))
    known = nodes.select("key", "content").join(groups.withColumnRenamed("node", "content"), "content", "left")
    return prints.join(known, "key").select("doc_id", "key", "content", F.coalesce("component", "content").alias("component"))


def _near_prints(nodes: DataFrame, block: int) -> DataFrame:
    """Pairs of nodes that connect all fingerprints within MAX_BITS, and all nodes of equal ones."""
    heads = staged(nodes.groupBy("fp").agg(F.min("content").alias("head")), "prints")
    same = nodes.select("content", "fp").join(heads, "fp").filter("content <> head").select(F.col("head").alias("x"), F.col("content").alias("y"))
    found = fingerprint_links(heads.select("fp"), block=block)
    side = lambda fp, c: heads.select(F.col("fp").alias(fp), F.col("head").alias(c))
    linked = found.join(side("a", "x"), "a").join(side("b", "y"), "b").select("x", "y")
    return linked.unionByName(same).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))


def _verified(pairs: DataFrame, nodes: DataFrame, texts: DataFrame) -> DataFrame:
    """The candidates (a, b) whose shingle sets are similar, as a written table: those that sketches leave are compared."""
    bits = lambda c: nodes.select(F.col("content").alias(c), F.col("size").alias(f"size_{c}"), F.col("bits").alias(f"bits_{c}"))
    both = pairs.distinct().join(bits("a"), "a").join(bits("b"), "b").select("a", "b", (F.col("size_a") + F.col("size_b")).alias("size"), "bits_a", "bits_b")
    tried = staged(both.mapInArrow(_sketched, "a long, b long"), "tried")
    ends = tried.select(F.col("a").alias("content")).union(tried.select("b")).distinct()
    ends = staged(ends.join(nodes.select("content", "key"), "content").withColumn("half", F.col("key")[0]), "ends")
    keyed = with_column(texts.select("text"), "text", "key", CONTENT, _contents)
    if ends.count() <= MAX_ENDS:  # then texts that aren't compared aren't moved: half of a key tells nearly all of them
        keyed = keyed.withColumn("half", F.col("key")[0]).join(F.broadcast(ends.select("half")), "half", "left_semi")
    found = keyed.groupBy("key").agg(F.min("text").alias("text")).join(ends.select("key", "content"), "key").select("content", "text")
    sets = staged(with_column(found, "text", "shingles", ArrayType(LongType()), _shingle_sets).drop("text"), "shingles")
    side = lambda c: sets.select(F.col("content").alias(c), F.col("shingles").alias(f"shingles_{c}"))
    return staged(tried.join(side("a"), "a").join(side("b"), "b").select("a", "b", "shingles_a", "shingles_b").mapInArrow(_similar, "a long, b long"), "similar-links")


def drop_similar(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each group of similar_groups(), that of the least id; null ids come last."""
    rank = lambda c: F.coalesce(c, F.lit(2**63 - 1))
    groups = similar_groups(docs, id_col, text_col).withColumn("rank", rank(F.col("doc_id")))
    # Of each component the least id, and of that id's texts one.
    place, content = (f"{c}_{uuid.uuid4().hex}" for c in ("rank", "content"))  # no column of the input has these names
    best = groups.groupBy("component", "rank").agg(F.min("key").alias(content)).groupBy("component").agg(F.min_by(content, "rank").alias(content), F.min("rank").alias(place))
    keyed = with_column(docs, text_col, content, CONTENT, _contents).withColumn(place, rank(F.col(id_col)))
    kept = keyed.join(best.select(place, content), [place, content])
    return kept.dropDuplicates([place, content]).select(*docs.columns)


def hex_of(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every row of ``documents``."""
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", hex_of(F.col("fp")).alias("fingerprint"), "component_id")
