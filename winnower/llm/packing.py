"""Best-fit packing: length patterns fitted by non-negative least squares, residuals packed best-fit.

Tokenizing is one pass without a shuffle. Each task numbers the pieces of each length that it meets, and counts per task
and length, summed up over tasks, turn these numbers into global ranks without moving the pieces.

What the driver plans with is the histogram of lengths, at most ``size`` numbers whatever the corpus. Lengths are put into
classes of GRID tokens; patterns of up to three documents whose classes fill a sequence are enumerated, their repeat
counts fitted to the class histogram by non-negative least squares (Lawson and Hanson's active set), and rounded down.
Documents take a pattern's slots where their lengths fill a sequence to the last token. All that is left, small
documents above all, goes by decreasing length into the tightest gap that holds it, groups of equal sequences at a time. The plan is a list of
ranges: rank r of length L is in sequence base + (r - low) // times. Its length depends on ``size`` alone.

Only documents longer than ``size`` are cut; the first piece takes the remainder and the others are full.

Defined cases: null and empty texts are the end token alone. Repeated rows are packed as documents of their own. An empty
table gives no rows. Columns beside id and text aren't read.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import staged, table

SIZE = 2048
GRID = 16
PATTERN_DOCS = 3
#: Share of a fitted count that is used: what remains keeps every length at hand for the gaps.
SHARE = 0.9
#: Documents of a share of one in SMALL of a sequence, or less, are kept for gaps.
SMALL = 4
END = 0
TOKENIZER = "byte_bpe_50k.json"
PIECE = "part long, doc_id long, piece int, start long, length long, ids_crc32 long, nth long"
#: A run of so many characters without a break goes to the tokenizer itself, whose merges take n log n time.
LONG_RUN = 1000
SPACES = re.compile(r"\s{%d}" % LONG_RUN)


@lru_cache(maxsize=4)
def _encoders(path: str):
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(path)
    added = [t.content for t in slow.get_added_tokens_decoder().values()]
    fast, ranks = None, Path(path).with_suffix(".tiktoken")
    if ranks.exists():
        import base64

        import public_tokenizers
        import tiktoken

        found = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.open("rb"))}
        fast = tiktoken.Encoding(ranks.stem, pat_str=public_tokenizers.PATTERN, mergeable_ranks=found, special_tokens={})
    return slow, fast, added


def token_ids(text: str, path: str) -> np.ndarray:
    """The ids that the tokenizer gives without adding special tokens; those that the text itself spells out are found.

    Where the vocabulary also exists as ranks, these give the same ids in a third of the time. They know no special
    token, and long runs take them quadratic time: such texts go to the tokenizer itself.
    """
    slow, fast, added = _encoders(path)
    if fast is None or any(x in text for x in added) or len(text) >= LONG_RUN and (max(map(len, text.split()), default=0) >= LONG_RUN or SPACES.search(text)):
        return np.array(slow.encode(text, add_special_tokens=False).ids, np.uint32)
    return np.asarray(fast.encode_to_numpy(text, disallowed_special=()), np.uint32)


def cut(length: int, size: int = SIZE) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces."""
    if length <= size:
        return [(0, length)]
    first = length % size or size
    return [(0, first), *((at, size) for at in range(first, length, size))]


def tokenized(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE, tokenizer: str | None = None) -> DataFrame:
    """A written table of pieces, numbered within each task (``part``) and length."""
    if tokenizer is None:
        import public_tokenizers

        tokenizer = str(public_tokenizers.path(TOKENIZER))
    schema = pa.schema([("part", pa.int64()), ("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("nth", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, met = TaskContext.get().partitionId(), np.zeros(size + 1, np.int64)
        for batch in batches:
            out: list[list] = [[] for _ in range(6)]
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = np.append(token_ids(text, tokenizer), np.uint32(END)).astype("<u4")
                for k, (start, n) in enumerate(cut(len(ids), size)):
                    for column, value in zip(out, (doc, k, start, n, zlib.crc32(ids[start : start + n].tobytes()), int(met[n])), strict=True):
                        column.append(value)
                    met[n] += 1
            yield pa.RecordBatch.from_arrays([pa.array([part] * len(out[0]), pa.int64())] + [pa.array(c, f.type) for c, f in zip(out, list(schema)[1:], strict=True)], schema=schema)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return staged(rows.mapInArrow(run, PIECE), "pieces")


def nnls(columns: np.ndarray, target: np.ndarray, rounds: int = 2000) -> np.ndarray:
    """Counts x >= 0 of patterns that minimise the squared misfit of the class histogram, by active sets.

    ``columns`` has up to PATTERN_DOCS class indices for each pattern, padded by -1.
    """
    n = len(target)
    x = np.zeros(len(columns))
    if not len(columns) or not target.any():
        return x
    safe = np.where(columns < 0, n, columns)

    def column(j: int) -> np.ndarray:
        out = np.zeros(n + 1)
        np.add.at(out, safe[j], 1)
        return out[:n]

    active: list[int] = []
    dense = np.zeros((n, 0))
    tolerance = 1e-7 * max(1.0, target.max())
    for _ in range(rounds):
        gap = np.append(target - (dense @ x[active] if active else 0), 0.0)
        gain = gap[safe].sum(axis=1)
        gain[active] = -np.inf
        j = int(gain.argmax())
        if gain[j] <= tolerance:
            break
        active.append(j)
        dense = np.hstack([dense, column(j)[:, None]])
        while active:
            gram = dense.T @ dense + 1e-9 * np.eye(len(active))
            z = np.linalg.solve(gram, dense.T @ target)
            if (z > 0).all():
                x[active] = z
                break
            now = x[active]
            bad = z <= 0
            step = min(1.0, float((now[bad] / np.maximum(now[bad] - z[bad], 1e-300)).min()))
            x[active] = now + step * (z - now)
            keep = x[active] > 1e-9
            x[[a for a, k in zip(active, keep, strict=True) if not k]] = 0
            active = [a for a, k in zip(active, keep, strict=True) if k]
            dense = dense[:, keep]
    return x


def patterns(classes: np.ndarray, full: int) -> np.ndarray:
    """All multisets of at most PATTERN_DOCS of the classes (from 1) that fill a sequence of ``full`` classes, padded by -1."""
    have = np.zeros(full + 1, bool)
    have[classes] = True
    out = [(full, -1, -1)] if have[full] else []
    out += [(a, full - a, -1) for a in range(1, full // 2 + 1) if have[a] and have[full - a]]
    for a in np.flatnonzero(have[: full // 3 + 1]).tolist():
        if a:
            b = np.arange(a, (full - a) // 2 + 1)
            b = b[have[b] & have[full - a - b]]
            out += [(a, x, full - a - x) for x in b.tolist()]
    return np.array(out, np.int64).reshape(-1, PATTERN_DOCS)


class Plan:
    """Groups of equal sequences: how many, the gap that each has left, and runs (length, times, offset)."""

    def __init__(self, size: int):
        self.size, self.groups = size, []

    def add(self, count: int, lengths: list[int]) -> None:
        group = [count, self.size, []]
        for n in lengths:
            self._put(group, n, 1)
        self.groups.append(group)

    def _put(self, group: list, length: int, times: int) -> None:
        group[2] = [*group[2], (length, times, self.size - group[1])]
        group[1] -= length * times

    def best_fit(self, left: np.ndarray) -> None:
        """Put ``left`` pieces of each length, the longest first, where the gap they leave is least."""
        gaps: dict[int, list[list]] = defaultdict(list)
        open_gaps = np.zeros(self.size + 1, bool)
        for g in self.groups:
            gaps[g[1]].append(g)
            open_gaps[g[1]] = True
        for n in range(self.size, 0, -1):
            count = int(left[n])
            while count:
                fit = n + int(open_gaps[n:].argmax()) if open_gaps[n:].any() else None
                if fit is None:
                    times = min(self.size // n, count)  # a new group of sequences, each filled with this length
                    many = count // times
                    group = [many, self.size, []]
                    self._put(group, n, times)
                    self.groups.append(group)
                    count -= many * times
                else:
                    group = gaps[fit].pop()
                    open_gaps[fit] = bool(gaps[fit])
                    times = min(fit // n, max(1, count // group[0]))
                    many = min(group[0], count // times)
                    if many < group[0]:  # the rest of the group keeps its gap
                        rest = [group[0] - many, group[1], group[2]]
                        group[0] = many
                        self.groups.append(rest)
                        gaps[fit].append(rest)
                        open_gaps[fit] = True
                    self._put(group, n, times)
                    count -= many * times
                gaps[group[1]].append(group)
                open_gaps[group[1]] = True

    def ranges(self) -> dict[str, np.ndarray]:
        """For each length, consecutive ranges of ranks: where they begin, and what they are given."""
        rows, base = [], 0
        for count, _, runs in self.groups:
            for length, times, offset in runs:
                rows.append((length, count * times, base, times, offset))
            base += count
        rows.sort()
        out = np.array(rows, np.int64).reshape(-1, 5)
        low = np.cumsum(out[:, 1]) - out[:, 1]
        first = np.searchsorted(out[:, 0], out[:, 0], "left")
        return {"length": out[:, 0], "low": low - low[first] if len(out) else low, "base": out[:, 2], "times": out[:, 3], "offset": out[:, 4]}


def _fill(out: Plan, left: np.ndarray, slots: list[int], rest: int, grid: int) -> None:
    """Up to ``rest`` sequences of a pattern's classes, from lengths that fill them to the last token: all slots but
    the last take a length of their class, the last takes what is missing. What doesn't come out even is left."""
    first = range(slots[0] * grid, (slots[0] - 1) * grid, -1)
    second = range(slots[1] * grid, (slots[1] - 1) * grid, -1) if len(slots) > 2 else (0,)
    for a in first:
        for b in second:
            c = out.size - a - b
            need = Counter(n for n in (a, b, c) if n)
            many = min([rest, *(int(left[n]) // k for n, k in need.items())]) if len(slots) > 1 else 0
            if many > 0:
                out.add(many, sorted(need.elements(), reverse=True))
                for n, k in need.items():
                    left[n] -= many * k
                rest -= many
            if not rest:
                return


def plan(histogram: np.ndarray, size: int = SIZE, grid: int = GRID) -> Plan:
    """Pack ``histogram[n]`` pieces of each length n."""
    left, out = histogram.astype(np.int64).copy(), Plan(size)
    if left[size]:  # full pieces need no pattern
        out.add(int(left[size]), [size])
        left[size] = 0
    if size % grid == 0 and size > grid:
        full = size // grid
        of = -(-np.arange(size + 1) // grid)
        smallest = full // SMALL + 1
        wanted = np.bincount(of, weights=left, minlength=full + 1)
        shapes = patterns(np.flatnonzero(wanted[smallest:]) + smallest, full)
        counts = np.floor(nnls(shapes, wanted) * SHARE + 1e-6).astype(np.int64)
        for j in np.argsort(-counts, kind="stable").tolist():
            if counts[j] > 0:
                _fill(out, left, [int(c) for c in shapes[j] if c > 0], int(counts[j]), grid)
    out.best_fit(left)
    return out


def pack(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE, tokenizer: str | None = None) -> DataFrame:
    """A row for each piece: id, piece, start, length, ids_crc32, sequence_id and offset."""
    pieces = tokenized(docs, id_col=id_col, text_col=text_col, size=size, tokenizer=tokenizer)
    per_part = staged(pieces.groupBy("length", "part").agg(F.count("*").alias("n")), "lengths")
    histogram = np.zeros(size + 1, np.int64)
    for n, count in per_part.groupBy("length").agg(F.sum("n")).collect():  # at most ``size`` rows
        histogram[n] = count
    where = plan(histogram, size).ranges()
    before = F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    # Counts by task and length grow with the corpus: they are merged with the pieces, never broadcast.
    ranked = pieces.join(per_part.select("length", "part", F.coalesce(before, F.lit(0)).alias("before")).hint("merge"), ["length", "part"])
    keys = where["length"] << 44 | where["low"]
    held = docs.sparkSession.sparkContext.broadcast((keys, where["low"], where["base"], where["times"], where["offset"]))
    out = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, low, base, times, offset = held.value
        for batch in batches:
            length, rank = (batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (3, 5))
            at = np.searchsorted(keys, length << 44 | rank, "right") - 1
            k = rank - low[at]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(5)), pa.array(base[at] + k // times[at]), pa.array(offset[at] + k % times[at] * length)], schema=out)

    placed = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("nth")).alias("rank"))
    found = placed.mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
    return found.withColumnRenamed("doc_id", id_col)


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents`` packed into sequences of at most 2048 tokens."""
    return pack(table(spark, sf_dir, "documents"))
