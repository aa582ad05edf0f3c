"""Signatures of few hashes, batches in pieces and counts of n-grams, against plain loops."""

from __future__ import annotations

import random
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from winnower.config import MinHashConfig
from winnower.functions import signature
from winnower.functions.signature import _lists, _pieces, bands, gram_counts, signatures
from winnower.functions.xxh3 import digest

TEXTS = ["", "abc", "abcde", "aaaaaaaa", "äöü€ abc 日本語 abcde", "abcdeabcde", "x" * 50, "日本語テキスト日本語テキスト", "plain words and plain words"]


@pytest.mark.parametrize("few", [0, 32])
@pytest.mark.parametrize("n", [0, 1, 5])
def test_signatures_of_few_and_of_many_hashes(monkeypatch, few, n):
    monkeypatch.setattr(signature, "FEW_HASHES", few)
    monkeypatch.setattr(signature, "FEW_GRAMS", 20)  # several chunks
    grams = [{t[i : i + n].encode() for i in range(len(t) - n + 1)} if n else set() for t in TEXTS]
    wanted = [[min((digest(g, seed) for g in own), default=2**64 - 1) for seed in range(6)] for own in grams]
    assert signatures(TEXTS, MinHashConfig(n, 3, 2)).tolist() == wanted


def test_a_batch_is_hashed_in_pieces():
    """Five times the rows in a batch: the same results, and little more memory than the narrow result takes."""
    rng, config, most = random.Random(1), MinHashConfig(5, 100, 8), []
    base = "".join(rng.choice("abcdefgh") for _ in range(3000))
    for rows in (1500, 7500):
        part = pa.array([base[i % 2900 : i % 2900 + 40] for i in range(rows)])
        assert [len(p) for p in _pieces(part)] == [min(1024, rows - at) for at in range(0, rows, 1024)]
        make = signature._udf.__code__  # the column's function takes its pieces one by one
        assert "_pieces" in str([c.co_names for c in make.co_consts if hasattr(c, "co_names")])
        tracemalloc.start()
        out = pa.concat_arrays([_lists(bands(signatures(p.to_pylist(), config), config)) for p in _pieces(part)])
        most.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
        assert len(out) == rows
    assert most[1] < 2 * most[0]
    whole = bands(signatures(part.to_pylist()[:1100], config), config).view(np.int64)
    assert np.array_equal(np.array(out.slice(0, 1100).to_pylist()), whole)


@pytest.mark.parametrize("n", [1, 5, 9])
def test_counts_of_grams(spark, n):
    texts = [*TEXTS, None, "a\0b\0c\0\0\0d", "a\0b\0c\0\0"] * 3
    wanted = Counter(g for t in texts if t is not None for g in {t[i : i + n] for i in range(len(t) - n + 1)})
    found = gram_counts(spark.createDataFrame([(t,) for t in texts], "text string").repartition(3), n)
    plan = found._jdf.queryExecution().toString()
    assert {r.gram: r.n_docs for r in found.collect()} == wanted and "Generate" not in plan


@pytest.mark.parametrize("looked_at", [16, 0.02])  # with the latter most minima are missed at first
@pytest.mark.parametrize("letters", ["abcdefgh ", "abé€\U0001f600日 ", "".join(chr(0x4E00 + i) for i in range(9000))])
def test_minima_of_texts_of_all_classes(monkeypatch, looked_at, letters):
    """Texts of every class of size, some with most n-grams in common, one class without a text and texts without an n-gram."""
    monkeypatch.setattr(signature, "CLASSES", (0, 8, 30, 100, 5000))
    monkeypatch.setattr(signature, "LOOKED_AT", looked_at)
    monkeypatch.setattr(signature, "HASHED_ROWS", 70)
    rng = random.Random(9)
    base = "".join(rng.choice(letters) for _ in range(400))
    texts = ["", "abc", *(base[i : i + size] for i, size in enumerate((5, 6, 11, 12, 29, 34, 35, 90, 104, 105, 300, 300)))]
    grams = [{t[i : i + 5].encode() for i in range(len(t) - 4)} for t in texts]
    wanted = [[min((digest(g, seed) for g in own), default=2**64 - 1) for seed in range(40)] for own in grams]
    assert signatures(texts, MinHashConfig(5, 10, 4)).tolist() == wanted


def test_few_n_grams_are_looked_at(monkeypatch):
    """Of texts that share their n-grams each is hashed once for a seed, and few of a text's are looked at."""
    rng, hashed, looked = random.Random(2), [], []
    words = ["".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(40)]
    texts = [" ".join(rng.choice(words) for _ in range(700)) for _ in range(60)]
    of, ranges = signature._table_digests, signature._ranges
    monkeypatch.setattr(signature, "_table_digests", lambda tables, seed, out: hashed.append(len(out)) or of(tables, seed, out))
    monkeypatch.setattr(signature, "_ranges", lambda low, many: looked.append(int(many.sum())) or ranges(low, many))
    grams = [len({t[i : i + 5] for i in range(len(t) - 4)}) for t in texts]
    signatures(texts, MinHashConfig(5, 10, 10))
    assert max(hashed) == len({t[i : i + 5] for t in texts for i in range(len(t) - 4)}) and len(hashed) == 100
    assert sum(looked[1:]) < 100 * sum(grams) / 5
