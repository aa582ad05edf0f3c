"""Candidates of bands against all pairs by brute force, and the rate at which bands find them."""

from __future__ import annotations

import random
from itertools import combinations

import numpy as np
from pyspark.sql import functions as F

from winnower.config import MinHashConfig
from winnower.functions.signature import bands, signatures
from winnower.operators import similarity
from winnower.operators.detection import band_candidates, detect, expected

CONFIG = MinHashConfig(5, 4, 3)


def _grams(text: str) -> frozenset:
    return frozenset(text[i : i + 5] for i in range(len(text) - 4))


def _texts() -> list[str]:
    """Edited copies in several degrees, equal texts, texts without an n-gram, and other texts of the same n-grams."""
    rng, found = random.Random(5), ["", "abc", "", "zz", "aaaaa", "aaaaaaa"]
    for _ in range(6):
        base = "".join(rng.choice("abcdefgh ") for _ in range(300))
        found += [base, base]
        for edits in (1, 2, 5, 10, 20):
            text = list(base)
            for at in rng.sample(range(300), edits):
                text[at] = "x"
            found.append("".join(text))
    return found


def _brute(texts: list[str], config: MinHashConfig):
    """class of each text; bands shared and similarity of each pair of classes."""
    sets = [_grams(t) for t in texts]
    first = {s: i for i, s in reversed(list(enumerate(sets)))}
    made = bands(signatures(texts, config), config)
    pairs = {}
    for a, b in combinations(sorted(first.values()), 2):
        both = len(sets[a] & sets[b])
        pairs[a, b] = (int((made[a] == made[b]).sum()), both / (len(sets[a] | sets[b]) or 1))
    return [first[s] for s in sets], pairs


def test_candidates_similar_pairs_and_bins(spark):
    texts = _texts()
    classes, pairs = _brute(texts, CONFIG)
    found = detect(spark.createDataFrame(list(enumerate(texts)), "idx long, text string"), CONFIG, threshold=0.5)
    assert sorted((r.idx, r["class"]) for r in found.members.collect()) == list(enumerate(classes))
    assert {(r.i, r.j): (r.n_bands, r.similarity) for r in found.candidates.collect()} == {p: v for p, v in pairs.items() if v[0]}
    assert {(r.i, r.j): r.similarity for r in found.similar.collect()} == {p: s for p, (_, s) in pairs.items() if s >= 0.5}
    wanted = {}
    for n, s in pairs.values():
        row = wanted.setdefault(int(s * 20), [0, []])
        row[0] += n > 0
        if s >= 0.5:
            row[1].append(1 - (1 - s**3) ** 4)
    wanted = {k: (n, len(r) or None, round(float(np.mean(r)), 6) if r else None) for k, (n, r) in wanted.items() if n or r}
    assert {r.bin: (r.n_candidates, r.n_similar, r.expected_rate) for r in found.by_similarity().collect()} == wanted


def test_bands_find_about_the_share_that_is_expected(spark):
    """A hundred bases of one edited copy each: what is found stays within four standard deviations."""
    rng, texts, config = random.Random(11), [], MinHashConfig(5, 4, 8)
    for _ in range(100):
        base = [rng.choice("abcdefghijklmnop ") for _ in range(400)]
        edited = list(base)
        for at in rng.sample(range(400), 10):
            edited[at] = "#"
        texts += ["".join(base), "".join(edited)]
    found = detect(spark.createDataFrame(list(enumerate(texts)), "idx long, text string"), config, threshold=0.5)
    near = found.similar.select("i", "j", expected(F.col("similarity"), config).alias("p")).collect()
    hit = {(r.i, r.j) for r in found.candidates.collect()}
    p = np.array([r.p for r in near])
    assert len(near) == 100
    assert abs(sum((r.i, r.j) in hit for r in near) - p.sum()) < 4 * np.sqrt((p * (1 - p)).sum())


def test_a_bucket_of_many_classes_is_dealt_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(similarity, "BLOCK", 7)
    rows = spark.createDataFrame([(i, [1, i % 3]) for i in range(60)], "idx long, bands array<long>")
    found = {(r.i, r.j): r.n_bands for r in band_candidates(rows).collect()}
    assert found == {(i, j): 1 + (i % 3 == j % 3) for i, j in combinations(range(60), 2)}


def test_no_documents_one_document_and_no_bands(spark):
    for texts in ([], ["a text of one"]):
        docs = spark.createDataFrame(list(enumerate(texts)), "idx long, text string")
        found = detect(docs, CONFIG, threshold=0.6)
        assert not found.candidates.count() and not found.similar.count() and not found.by_similarity().count()
    docs = spark.createDataFrame([(0, "one text of some words"), (1, "another text of words")], "idx long, text string")
    assert not detect(docs, MinHashConfig(5, 0, 2), threshold=0.6).candidates.count()
    assert [r.n_bands for r in detect(docs, MinHashConfig(5, 3, 0), threshold=0.6).candidates.collect()] == [3]


def test_candidates_are_found_without_all_similar_pairs(spark, monkeypatch):
    """Nor are sketches or rare n-grams made for them; both parts are right in either order."""
    from winnower.operators import detection

    texts = _texts()
    _, pairs = _brute(texts, CONFIG)
    docs = spark.createDataFrame(list(enumerate(texts)), "idx long, text string")
    linked, asked = detection.linked_nodes, []
    monkeypatch.setattr(detection, "linked_nodes", lambda nodes, *rest: asked.append(nodes.columns) or linked(nodes, *rest))
    found = detect(docs, CONFIG, threshold=0.5)
    assert {(r.i, r.j): r.n_bands for r in found.candidates.collect()} == {p: n for p, (n, _) in pairs.items() if n}
    assert not asked
    assert {(r.i, r.j) for r in found.similar.collect()} == {p for p, (_, s) in pairs.items() if s >= 0.5}
    assert len(asked) == 1
