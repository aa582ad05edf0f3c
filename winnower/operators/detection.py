"""Candidates from shared bands, verified, and how many similar pairs the bands find.

What is compared are classes: documents of equal n-gram sets, which have equal bands, are one. A bucket's classes meet by pairs of
blocks, (bucket, i, j), so no task grows with a bucket; candidates are then verified on the n-gram sets. Beside them stand
all pairs of classes at a threshold, found without bands: of pairs of similarity s, r bands of b hashes should find
1 - (1 - s^b)^r.

Defined cases: documents without an n-gram are one class. Fewer than two classes have no pair. Null texts fail, as in
signatures. Bands of no hash are equal for all, so every pair is a candidate; without a band there is none.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import MinHashConfig
from ..functions.signature import band_values
from ..staging import written
from .dedup import explode_bands
from .similarity import _in_blocks, _nodes, linked_nodes, named_nodes, verified

#: Intervals of similarity.
BINS = 20


def expected(similarity: Column, config: MinHashConfig) -> Column:
    """The probability that a pair shares a band."""
    return 1 - F.pow(1 - F.pow(similarity, F.lit(float(config.band_size))), F.lit(float(config.num_buckets)))


def band_candidates(banded: DataFrame, idx: str = "idx") -> DataFrame:
    """i < j and n_bands of the rows (idx, bands) that share n_bands > 0 of their bands, at the same places."""
    rows = explode_bands(banded, F.col(idx).alias("idx")).select("idx", F.struct("bucket_idx", "bucket_value").alias("bucket"))
    return _in_blocks(rows, "bucket").groupBy("i", "j").agg(F.count("*").alias("n_bands"))


@dataclass
class Detection:
    """``members``: idx and class, by its least idx. ``candidates``: i < j (classes), n_bands and similarity of those that share a
    band. ``similar``: i < j and similarity of all classes at ``threshold`` or more, bands or not. Each is found when it is first
    asked for."""

    _members: Callable[[], DataFrame]
    _candidates: Callable[[], DataFrame]
    _similar: Callable[[], DataFrame]
    config: MinHashConfig
    threshold: float

    @cached_property
    def members(self) -> DataFrame:
        return self._members()

    @cached_property
    def candidates(self) -> DataFrame:
        return self._candidates()

    @cached_property
    def similar(self) -> DataFrame:
        return self._similar()

    def by_similarity(self, bins: int = BINS) -> DataFrame:
        """bin (of similarity, from bin / bins on), n_candidates, n_similar and expected_rate (what share of the similar pairs
        should be candidates, on average). The last two are null in bins that begin below the threshold, where similar pairs
        weren't all looked for."""
        at = F.floor(F.col("similarity") * bins).cast("int").alias("bin")
        similar = self.similar  # first, so that classes are numbered once
        found = self.candidates.groupBy(at).agg(F.count("*").alias("n_candidates"))
        every = similar.groupBy(at).agg(F.count("*").alias("n_similar"), F.round(F.avg(expected(F.col("similarity"), self.config)), 6).alias("expected_rate"))
        whole = F.col("bin") / bins >= self.threshold
        joined = found.join(every, "bin", "full").withColumn("n_candidates", F.coalesce("n_candidates", F.lit(0)))
        return joined.select("bin", "n_candidates", F.when(whole, F.col("n_similar")).alias("n_similar"), F.when(whole, F.col("expected_rate")).alias("expected_rate"))


def detect(docs: DataFrame, config: MinHashConfig, *, threshold: float) -> Detection:
    """Candidates of the bands of documents (idx, text) and the pairs that they should find, ``threshold`` > 0."""
    if not 0 < threshold <= 1:
        raise ValueError("a threshold above 0 and up to 1 is needed: below it every pair is similar")
    docs = docs.select("idx", "text")
    made: dict[bool, tuple[DataFrame, DataFrame]] = {}

    def numbered(compared: bool) -> tuple[DataFrame, DataFrame]:
        """Classes and their documents. What classes are compared by is made where all of them are; then it serves for candidates too."""
        if not compared and True in made:
            return made[True]
        if compared not in made:
            made[compared] = _nodes(docs, config.ngram_size, threshold if compared else 0.0)
        return made[compared]

    def heads(nodes: DataFrame) -> DataFrame:
        return nodes.select("node", F.col("idx").alias("class"))

    def members() -> DataFrame:
        nodes, every = numbered(False)
        return every.join(heads(nodes), "node").select("idx", "class")

    def candidates() -> DataFrame:
        nodes, _ = numbered(False)
        # Texts are hashed where they are read, copies too: what is joined to the classes is narrow.
        hashed = written(docs.select("idx", band_values("text", config).alias("bands")), "bands")
        banded = written(hashed.join(nodes.select("idx", "node"), "idx").select("node", "bands"), "class-bands")
        shared = written(band_candidates(banded, "node"), "band-candidates")
        checked = verified(shared.select(F.col("i").alias("a"), F.col("j").alias("b")), nodes, docs, config.ngram_size)
        found = checked.join(shared.select(F.col("i").alias("a"), F.col("j").alias("b"), "n_bands"), ["a", "b"])
        return written(named_nodes(found, heads(nodes)), "candidates")

    def similar() -> DataFrame:
        nodes, _ = numbered(True)
        return written(named_nodes(linked_nodes(nodes, threshold, docs, config.ngram_size), heads(nodes)), "similar")

    return Detection(members, candidates, similar, config, threshold)
