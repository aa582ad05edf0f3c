"""Crowds of linked vectors, and texts whose hashes share a half."""

from __future__ import annotations

import numpy as np
import pytest

from winnower.llm import embeddings, simhash


def test_spanning_forest_connects_what_edges_and_labels_do():
    rng = np.random.default_rng(3)
    for nodes, edges in ((1, 0), (2, 1), (50, 30), (400, 390), (400, 5000)):
        x, z = rng.integers(0, nodes, edges), rng.integers(0, nodes, edges)
        label = np.arange(nodes)
        half = edges // 2
        kept = []
        for low, high in ((0, half), (half, edges)):
            some, label = embeddings.spanning(label, x[low:high], z[low:high])
            kept += (some + low).tolist()
        want = list(range(nodes))
        for i in range(edges):
            a, b = want[x[i]], want[z[i]]
            want = [min(a, b) if w in (a, b) else w for w in want]
        assert label.tolist() == want
        assert len(kept) == nodes - len(set(want))


@pytest.mark.parametrize(("dims", "task_rows"), [(64, None), (64, 100), (8, 64)])
def test_crowd_of_vectors_around_the_bound_equals_all_cosines(spark, dims, task_rows):
    """A third of all vectors in a crowd whose cosines lie on both sides of the bound, exact copies, and others."""
    rng = np.random.default_rng(dims)
    centre = rng.standard_normal(dims)
    crowd = centre / np.linalg.norm(centre) + rng.standard_normal((400, dims)) * (0.33 / np.sqrt(dims))
    tight = rng.standard_normal(dims) + rng.standard_normal((200, dims)) * 0.001
    rows = np.concatenate([crowd, tight, tight[:20], rng.standard_normal((500, dims))])
    unit = rows / np.linalg.norm(rows, axis=1, keepdims=True)
    linked = unit @ unit.T >= 0.9
    np.fill_diagonal(linked, False)
    label = np.arange(len(rows))
    while True:
        least = np.minimum(label, np.where(linked, label[None, :], len(rows)).min(axis=1))
        if (least == label).all():
            break
        label = least
    assert 0.1 < linked[:400, :400].mean() < 0.9
    frame = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(rows)], "vec_id long, embedding array<double>")
    found = embeddings.near_duplicates(frame, task_rows=task_rows).collect()
    assert {r.vec_id: (r.n_links, r.component_id) for r in found} == {i: (int(linked[i].sum()), int(label[i])) for i in range(len(rows))}


def test_long_vectors_have_smaller_parts(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "MAX_BYTES", 16 * 64 * 40)
    test_crowd_of_vectors_around_the_bound_equals_all_cosines(spark, 64, None)


def test_texts_whose_hashes_share_a_half_stay_apart(spark, monkeypatch):
    """With one first half for all, as if hashes of 64 bits had met, different texts are still told apart and compared rightly."""
    import pyarrow as pa

    real = simhash._contents
    # Sent to workers by value, so they have it too.
    monkeypatch.setattr(simhash, "_contents", lambda texts: pa.array([[7, x[1]] for x in real(texts).to_pylist()], pa.list_(pa.int64())))
    words = [f"w{i}" for i in range(200)]
    texts = [" ".join(words), " ".join([*words[:100], "x", *words[101:]]), " ".join(words).upper(), " ".join(words[::-1]), " ".join(words[::-1][:190]), "alone", "", None]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    kept = sorted(r.doc_id for r in simhash.drop_similar(rows).collect())
    assert kept == [0, 3, 5, 6]


@pytest.mark.parametrize("part", [8, 1])
def test_candidates_of_a_passage_grow_no_faster_than_the_texts(spark, monkeypatch, part):
    """Texts of 700 words, a tenth of them with one passage and each fortieth with a near copy, and a crowd made of six passages alone, in tables
    of 400 and 2,000: no more candidates for each text in the larger one, whether the order of shingles knows passages or none, and
    every link is found."""
    made, met, wanted = [], simhash._verified, []

    def counted(pairs, nodes, texts):
        made[-1] += pairs.count()
        return met(pairs, nodes, texts)

    monkeypatch.setattr(simhash, "_verified", counted)
    monkeypatch.setattr(simhash, "ORDER_ROWS", 20)
    if part == 1:
        monkeypatch.setattr(simhash, "MAX_COMMON", 0)
    for n in (400, 2000):
        rng = np.random.default_rng(n)
        passage = [f"p{x}" for x in range(80)]
        texts = []
        for i in range(n):
            words = [f"w{i}x{x}" for x in range(700)]
            if i % 10 == 0:
                words[100:180] = passage
            texts.append(words)
            if i % 40 == 0:
                texts.append([*words[:300], "other", *words[301:]])
        for i in range(n // 10):  # alike in over half of their words, and not linked
            texts.append([w for b in rng.permutation(6) for w in [f"q{b}y{x}" for x in range(70)]] + [f"v{i}x{x}" for x in range(280)])
        wanted.append(n + n // 10)
        made.append(0)
        rows = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(texts)], "doc_id long, text string").repartition(5)
        found = simhash.similar_groups(rows).select("component").distinct().count()
        assert found == wanted[-1]
    assert made[1] <= 6 * max(made[0], 100), made
