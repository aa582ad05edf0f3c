"""Embedding near-duplicates by a subspace pigeonhole join.

Unit vectors of cosine c lie at squared distance 2 - 2c. They are rotated by a fixed random orthogonal matrix and split
into blocks of BLOCK_DIMS coordinates. Of two vectors within the whole budget, one block at least lies within its
share of it, in proportion to its dimensions; this holds for any rotation, so no pair is lost. Each block is
range-joined: its first two coordinates, turned onto the block's diagonal directions, cut the plane into cells as
wide as the block's radius; a vector is at home in one cell and visits the forward half of those around it, so a pair meets
in one cell of a block at most. Cells are split into parts, and each pair of parts that holds rows at home is a task. A part
has one in PARTS of all rows, so that no task grows with a cell and rows aren't sent out more often as the table grows; only
where that is more than MAX_ROWS, parts stop growing.

A first pass compares the block's coordinates alone and marks rows that have a candidate in their task; a second one brings
the full vectors of marked rows to the same tasks and verifies every candidate exactly. Of the blocks that
bring a pair together, the one in which it lies nearest counts it. Tasks put out what is linear in their rows: the number of
links of each and a spanning forest of the verified links. No pair is written, however large a crowd is.

Equal vectors are one class and are never paired with each other; class sizes go into the number of links.

Defined cases: null and zero vectors and those with null or infinite components link with nothing. Vectors of other
lengths are compared among themselves. Null ids count as links but never as a component's least id. Rows of equal
ids are vectors of their own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import staged, table
from .graph import components

COSINE = 0.9
BLOCK_DIMS = 16
#: Parts of all rows of cells, and the least and greatest number of rows of a part.
PARTS = 128
LEAST_ROWS = 512
MAX_ROWS = 65_536
#: Bytes of a part's full vectors at most, each held twice, as it is and rotated.
MAX_BYTES = 128 << 20
#: Products that are formed at once, and pairs that are verified one by one at once.
ENTRIES_AT_ONCE = 1 << 20
PAIRS_AT_ONCE = 50_000
#: Of how many products one must be a candidate for blocks to be told apart by products too.
DENSE = 16
#: What rounding may take from a product: what is nearer to a bound than this is computed pair by pair, equally in all tasks.
ROUNDING = 1e-9
#: What rounding may take from a block's distance.
SLACK = 1e-5
SEED = 20240229


def rotation(dims: int) -> np.ndarray:
    """A fixed orthogonal matrix."""
    q, r = np.linalg.qr(np.random.default_rng(SEED).standard_normal((dims, dims)))
    return q * np.sign(np.diag(r))


def blocks(dims: int, width: int = BLOCK_DIMS) -> list[tuple[int, int]]:
    """Bounds of blocks of about ``width`` coordinates."""
    n = max(1, round(dims / width))
    edges = [dims * i // n for i in range(n + 1)]
    return list(zip(edges, edges[1:], strict=False))


def _matrix(column: pa.Array) -> np.ndarray:
    """Vectors of one length as rows of doubles."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def _floats(column: pa.Array) -> np.ndarray:
    """The bytes of binary values, one after another, as single precision."""
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]].view(np.float32)


def _unit(x: np.ndarray) -> np.ndarray:
    scale = np.abs(x).max(axis=1, keepdims=True)
    x = x / scale  # neither squares of huge components overflow nor those of tiny ones vanish
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _deal(cosine: float, width: int):
    """(class, dims, vector) to block rows: one at home and one for each of four neighbouring cells ahead."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch.column(1).to_numpy(zero_copy_only=False)
            for dims in np.unique(sizes):
                at = np.flatnonzero(sizes == dims)
                part = batch.take(pa.array(at))
                x = _unit(_matrix(part.column(2))) @ rotation(int(dims)).T
                names = part.column(0)
                for b, (low, high) in enumerate(blocks(int(dims), width)):
                    y = x[:, low:high]
                    radius = np.sqrt((2 - 2 * cosine) * (high - low) / dims) + SLACK
                    axes = rotation(high - low)[:2]
                    cell = np.floor(y @ axes.T / radius).astype(np.int64)
                    if cell.shape[1] == 1:
                        cell = np.hstack([cell, np.zeros_like(cell)])
                    bytes_of = pa.py_buffer(np.ascontiguousarray(y, np.float32).tobytes())
                    data = pa.FixedSizeBinaryArray.from_buffers(pa.binary(4 * (high - low)), len(y), [None, bytes_of]).cast(pa.binary())
                    for k, (dx, dy) in enumerate(((0, 0), (1, 0), (0, 1), (1, 1), (1, -1))):
                        n = len(at)
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(np.full(n, int(dims), np.int32)), pa.array(np.full(n, b, np.int32)), pa.array(cell[:, 0] + dx), pa.array(cell[:, 1] + dy), pa.array(np.full(n, k == 0)), names, data],
                            names=["dims", "block", "cx", "cy", "home", "class", "y"],
                        )

    return run


DEALT = "dims int, block int, cx long, cy long, home boolean, class long, y binary"
CELL = ["dims", "block", "cx", "cy"]
TASK = [*CELL, "i", "j"]
MARKED = "dims int, block int, cx long, cy long, i int, j int, own int, home boolean, class long"


def _tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of one task after another, each as one batch: its six key columns come first."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.stack([batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(6)], axis=1)
        cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), len(keys)]
        for low, high in zip(cuts, cuts[1:], strict=False):
            key = tuple(keys[low].tolist())
            if key != last and held:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held = []
            last = key
            held.append(batch.slice(low, high - low))
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _sides(row: pa.RecordBatch) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray, np.ndarray]:
    """Which rows of a task meet which, and of each row whether it is at home and its class: rows at home in part i meet rows of
    part j, and the other way round; visitors don't meet each other."""
    i, j = (row.column(c)[0].as_py() for c in (4, 5))
    own, home, name = (row.column(c).to_numpy(zero_copy_only=False) for c in (6, 7, 8))
    home = home.astype(bool)
    left, right = np.flatnonzero(home & (own == i)), np.flatnonzero(own == j)
    sides = [(left, right)] if i == j else [(left, right), (np.flatnonzero(home & (own == j)), np.flatnonzero(~home & (own == i)))]
    return sides, home, name


def _mark(cosine: float, width: int):
    """Rows of tasks (TASK, own, home, class, y) to those that have another row within the block's share of the budget."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _tasks(batches):
            dims, block = (row.column(c)[0].as_py() for c in (0, 1))
            sides, _, name = _sides(row)
            low, high = blocks(dims, width)[block]
            y = _floats(row.column(9)).reshape(-1, high - low)
            budget = (2 - 2 * cosine) * (high - low) / dims + SLACK
            square, one = (y * y).sum(axis=1, keepdims=True), np.ones((len(y), 1), np.float32)
            # One product gives minus the squared distance.
            one_side, other_side = np.hstack([2 * y, -square, -one]), np.hstack([y, one, square])
            marked = np.zeros(len(y), bool)
            for a, b in sides:
                across = np.ascontiguousarray(other_side[b].T)
                for at in range(0, len(a), 256):
                    p = a[at : at + 256]
                    hit = (one_side[p] @ across >= -budget) & (name[p][:, None] != name[b][None, :])
                    marked[p] |= hit.any(axis=1)
                    marked[b] |= hit.any(axis=0)
            if marked.any():
                yield row.filter(pa.array(marked)).select([*TASK, "own", "home", "class"])

    return run


def _doubles(column: pa.Array) -> np.ndarray:
    """The bytes of binary values of one length, as rows of doubles."""
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]].view(np.float64).reshape(len(column), -1)


def spanning(label: np.ndarray, x: np.ndarray, z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which of the edges (x, z) make a spanning forest of them and of what the labels connect already, and the labels afterwards.

    In every round each label takes one edge to a lesser one, so no circle closes, and at most half of the labels that have
    edges are left."""
    at, taken = np.arange(len(x)), []
    while True:
        a, b = label[x[at]], label[z[at]]
        apart = a != b
        if not apart.any():
            return np.concatenate(taken) if taken else at[:0], label
        at, a, b = at[apart], a[apart], b[apart]
        high, first = np.unique(np.maximum(a, b), return_index=True)
        taken.append(at[first])
        to = np.arange(len(label))
        to[high] = np.minimum(a, b)[first]
        while not np.array_equal(further := to[to], to):
            to = further
        label = to[label]


def _linked(cosine, bounds, block, unit, rotated, name, home, a, b, one_part) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Some rows of ``a`` after others, and which rows of ``b`` each is linked with and ``block`` counts, as 1 in a matrix.

    Where many are candidates, products of the blocks tell which one a pair lies nearest in; what they leave open, and all
    where few are, is verified pair by pair."""
    across = np.ascontiguousarray(unit[b].T)
    sides: list = []

    def nearest(p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Squared distance by coordinate in the block, and the least one in the others."""
        if not sides:
            for low, high in bounds:
                z = rotated[b, low:high]
                sides.append((np.ascontiguousarray(z.T), (z * z).sum(axis=1)))
        own, least = None, np.full((len(p), len(b)), np.inf)
        for k, (low, high) in enumerate(bounds):
            x = rotated[p, low:high]
            found = ((x * x).sum(axis=1)[:, None] + sides[k][1][None, :] - 2 * (x @ sides[k][0])) / (high - low)
            if k == block:
                own = found
            else:
                np.minimum(least, found, out=least)
        return own, least

    step = max(1, ENTRIES_AT_ONCE // max(1, len(b)))
    for at in range(0, len(a), step):
        p = a[at : at + step]
        product = unit[p] @ across
        near = (product >= cosine - ROUNDING) & (name[p][:, None] != name[b][None, :])
        if one_part:  # two rows at home in one part meet twice
            near &= ~home[b][None, :] | (name[p][:, None] < name[b][None, :])
        if not (n := np.count_nonzero(near)):
            continue
        counted = np.zeros(near.shape)
        if n * DENSE > near.size:
            own, least = nearest(p)
            counted[near & (product >= cosine + ROUNDING) & (own < least - ROUNDING)] = 1
            near &= (counted == 0) & (own <= least + ROUNDING)
        r, c = np.nonzero(near)
        for k in range(0, len(r), PAIRS_AT_ONCE):
            i, j = r[k : k + PAIRS_AT_ONCE], c[k : k + PAIRS_AT_ONCE]
            good = (unit[p[i]] * unit[b[j]]).sum(axis=1) >= cosine
            i, j = i[good], j[good]
            square = (rotated[p[i]] - rotated[b[j]]) ** 2
            parts = np.stack([square[:, low:high].sum(axis=1) / (high - low) for low, high in bounds], axis=1)
            mine = parts.argmin(axis=1) == block
            counted[i[mine], j[mine]] = 1
        yield p, counted


def _count(cosine: float, width: int):
    """Marked rows of tasks (TASK, own, home, class, unit, rotated, n) to (class, other, links): the links that this task counts
    for a class, by rows without an other, and the edges of a spanning forest of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _tasks(batches):
            dims, block = (row.column(c)[0].as_py() for c in (0, 1))
            bounds = blocks(dims, width)
            sides, home, name = _sides(row)
            unit, rotated = (_doubles(row.column(c)) for c in (9, 10))
            n = row.column(11).to_numpy(zero_copy_only=False)
            links, label = np.zeros(len(name), np.int64), np.arange(len(name))
            ends = [np.zeros((0, 2), np.int64)]
            for a, b in sides:
                for p, counted in _linked(cosine, bounds, block, unit, rotated, name, home, a, b, len(sides) == 1):
                    links[p] += (counted @ n[b].astype(np.float64)).astype(np.int64)
                    links[b] += (n[p].astype(np.float64) @ counted).astype(np.int64)
                    r, c = np.nonzero(counted)
                    kept, label = spanning(label, p[r], b[c])
                    ends.append(np.stack([name[p[r[kept]]], name[b[c[kept]]]], axis=1))
            ends = np.concatenate(ends)
            some = np.flatnonzero(links)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.append(name[some], ends[:, 0])), pa.array([*[None] * len(some), *ends[:, 1].tolist()], pa.int64()), pa.array(np.append(links[some], np.zeros(len(ends), np.int64)))],
                names=["class", "other", "links"],
            )

    return run


def _full(cosine: float):
    """(class, vector, n) to class, unit vector, rotated vector and n."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = pa.compute.list_value_length(batch.column(1)).to_numpy(zero_copy_only=False)
            for dims in np.unique(sizes):
                part = batch.take(pa.array(np.flatnonzero(sizes == dims)))
                u = _unit(_matrix(part.column(1)))
                both = [pa.array([r.tobytes() for r in m], pa.binary()) for m in (u, u @ rotation(int(dims)).T)]
                yield pa.RecordBatch.from_arrays([part.column(0), *both, part.column(2)], names=["class", "unit", "rotated", "n"])

    return run


def links(classes: DataFrame, cosine: float = COSINE, *, width: int = BLOCK_DIMS, task_rows: int | None = None) -> DataFrame:
    """A written table (class, other, links) of the classes (class, dims, vector, n), distinct vectors of which there are n each:
    how many vectors of other classes are linked with each of a class, in rows without an other that add up, and links
    (class, other) that connect all that is linked."""
    dealt = staged(classes.select("class", "dims", "vector").mapInArrow(_deal(cosine, width), DEALT), "blocks")
    if task_rows is None:
        task_rows = min(MAX_ROWS, max(LEAST_ROWS, dealt.count() // PARTS))
    crowds = dealt.groupBy(*CELL).agg(F.count("*").alias("n"), F.count(F.when(F.col("home"), 1)).alias("homes")).filter("n > 1 and homes > 0")
    rows = F.least(F.lit(float(task_rows)), F.greatest(F.lit(1.0), F.floor(MAX_BYTES / (16 * F.col("dims"))).cast("double")))
    parts = F.ceil(F.col("n") / rows).cast("int")
    met = dealt.join(crowds, CELL).withColumn("parts", parts).withColumn("own", F.pmod(F.xxhash64("class", "home"), F.col("parts")).cast("int"))
    paired = met.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select(*CELL, F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "home", "class", "y")
    tasks = paired.repartition(*TASK).sortWithinPartitions(*TASK)
    marked = staged(tasks.mapInArrow(_mark(cosine, width), MARKED), "marked")
    full = classes.select("class", "vector", "n").mapInArrow(_full(cosine), "class long, unit binary, rotated binary, n long")
    again = marked.join(full, "class").select(*TASK, "own", "home", "class", "unit", "rotated", "n").repartition(*TASK).sortWithinPartitions(*TASK)
    return staged(again.mapInArrow(_count(cosine, width), "class long, other long, links long"), "links")


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", *, cosine: float = COSINE, task_rows: int | None = None) -> DataFrame:
    """id, n_links, component_id and kept of every row."""
    finite = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))
    rows = vectors.select(F.col(id_col).alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vector"))
    good = F.col("vector").isNotNull() & F.forall("vector", finite) & F.exists("vector", lambda v: v != 0)
    rows = rows.withColumn("vector", F.when(good, F.col("vector")))
    grouped = rows.filter("vector is not null").groupBy("vector").agg(F.min("vec_id").alias("least"), F.count("*").alias("n"))
    # Ids of classes, fixed by being written.
    classes = staged(grouped.select(F.monotonically_increasing_id().alias("class"), F.size("vector").alias("dims"), "vector", "least", "n"), "classes")
    found = links(classes, cosine, task_rows=task_rows)
    degree = found.filter("other is null").groupBy("class").agg(F.sum("links").alias("linked"))
    groups = components(found.filter("other is not null").select(F.col("class").alias("a"), F.col("other").alias("b")))
    named = classes.select("class", "least", "n", "vector").join(degree, "class", "left").join(groups.withColumnRenamed("node", "class"), "class", "left")
    named = named.select("class", "least", "vector", (F.col("n") - 1 + F.coalesce("linked", F.lit(0))).alias("n_links"), F.coalesce("component", "class").alias("component"))
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    known = named.join(least, "component").select("vector", "n_links", "component_id")
    out = rows.join(known, "vector", "left").select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.select(F.col("vec_id").alias(id_col), "n_links", "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)).alias("kept"))


def op8_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links, component and survivor of every row of ``embeddings``."""
    return near_duplicates(table(spark, sf_dir, "embeddings"))
