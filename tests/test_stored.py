"""Stored signatures and indices, split ranges, sinks and sources: what goes through files, and its errors."""

from __future__ import annotations

from collections import defaultdict

import pytest
import xxhash
from pyspark.sql import functions as F

from winnower.config import ConfigError, InvalidFormat, IoError, MinHashConfig
from winnower.functions.signature import bands, signatures
from winnower.operators.apply import apply_whole
from winnower.operators.dedup import dedup, dedup_bands, flags_of, compute_bands, read_bands, read_index, write_bands, write_index
from winnower.operators.merge import MergeSource, check_range, either, merge
from winnower.operators.similarity import pairwise_similarity, similar_classes, similar_pairs, write_pairs
from winnower.sources.jsonl import check_jsonl, from_table, read_jsonl, read_lines, write_lines
from winnower.sources.manifest import read_path_list, read_src

SMALL = MinHashConfig(3, 3, 2)
TEXTS = ["the first text of all", "another text of words", "the first text of all", "something else, and longer", "another text of words", "ab"]


def _docs(spark, texts, path="a"):
    return spark.createDataFrame([(path, i, t) for i, t in enumerate(texts)], "file_path string, item_number long, text string")


def _flags(result) -> str:
    return "".join(r.flag for r in result.flags.orderBy("global_idx").collect())


def _brute_flags(texts, config, reverse=False):
    """Of each text whether an earlier (in reverse: later) one shares a band."""
    found = bands(signatures(texts, config), config)
    out = []
    for i, row in enumerate(found):
        others = found[i + 1 :] if reverse else found[:i]
        out.append("D" if (others == row).any() else " ")
    return "".join(out)


def test_dedup_from_stored_signatures(spark, tmp_path):
    paths = [str(tmp_path / "a"), str(tmp_path / "b")]
    assert write_bands(_docs(spark, TEXTS[:3], "a"), paths[0], SMALL) == 3
    assert write_bands(_docs(spark, TEXTS[3:], "b"), paths[1], SMALL) == 3
    banded, config = read_bands(spark, paths)
    assert config == SMALL
    for reverse in (False, True):
        assert _flags(dedup_bands(banded, reverse=reverse)) == _brute_flags(TEXTS, SMALL, reverse)
    assert _flags(dedup_bands(banded, order=["b", "a"])) == _brute_flags(TEXTS[3:] + TEXTS[:3], SMALL)


def test_stored_signatures_must_agree(spark, tmp_path):
    write_bands(_docs(spark, TEXTS), str(tmp_path / "a"), SMALL)
    write_bands(_docs(spark, TEXTS), str(tmp_path / "b"), MinHashConfig(3, 3, 4))
    with pytest.raises(ConfigError):
        read_bands(spark, [str(tmp_path / "a"), str(tmp_path / "b")])
    with pytest.raises(ConfigError):
        read_bands(spark, [])
    spark.read.parquet(str(tmp_path / "a")).withColumn("bands", F.slice("bands", 1, 2)).write.parquet(str(tmp_path / "c"))
    with pytest.raises(InvalidFormat):
        read_bands(spark, [str(tmp_path / "c")])
    _docs(spark, TEXTS).write.parquet(str(tmp_path / "d"))
    with pytest.raises(InvalidFormat):
        read_bands(spark, [str(tmp_path / "d")])


def test_default_flags_against_brute_force(spark):
    docs = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").orderBy("doc_id").select("text").limit(60).collect()]
    config = MinHashConfig()
    rows = spark.createDataFrame(list(enumerate(docs)), "global_idx long, text string")
    found = "".join(r.flag for r in flags_of(compute_bands(rows, config)).orderBy("global_idx").collect())
    assert found == _brute_flags(docs, config)
    text = min((t for t in docs if len(t) > 40), key=len)
    grams = {text[i : i + 5].encode() for i in range(len(text) - 4)}
    hashes = [min(xxhash.xxh3_64_intdigest(g, s) for g in grams) for s in range(config.total_hashes)]
    wanted = [xxhash.xxh3_64_intdigest(b"".join(h.to_bytes(8, "little") for h in hashes[k * 20 : k * 20 + 20])) for k in range(40)]
    assert bands(signatures([text], config), config)[0].tolist() == wanted


def test_an_index_is_written_by_split_and_read_back(spark, tmp_path):
    found = dedup(_docs(spark, TEXTS), SMALL)
    path = str(tmp_path / "index")
    write_index(found.index, path)
    columns = ["group", "item_number", "bucket_value", "bucket_idx", "global_idx", "split"]
    rows = sorted(map(tuple, found.index.select(*columns).collect()))
    assert sorted(map(tuple, read_index(spark, path).select(*columns).collect())) == rows and len(rows) == 3 * _brute_flags(TEXTS, SMALL).count(" ")
    middle = sorted(r[5] for r in rows)[len(rows) // 2]
    part = read_index(spark, path, start=middle, end=middle)
    assert {r.split for r in part.collect()} == {middle}
    files = part.select("_metadata.file_path").distinct().collect()
    assert len(files) >= 1 and all(f"split={middle}" in f.file_path for f in files)
    none = next(s for s in range(256) if s not in {r[5] for r in rows})
    assert read_index(spark, path, start=none, end=none).count() == 0


def _group(spark, texts, path="a"):
    found = dedup(_docs(spark, texts, path), SMALL)
    return MergeSource(found.index, found.flags)


def _merged(result):
    out = defaultdict(str)
    for r in result.orderBy("group_idx", "global_idx").collect():
        out[r.group_idx] += r.flag
    return dict(out)


def _brute_merge(groups, start, end, reverse):
    """Flags of groups of one source each, and marks, bucket by bucket."""
    flags, buckets = [], defaultdict(list)
    for g, texts in enumerate(groups):
        found, own = bands(signatures(texts, SMALL), SMALL), _brute_flags(texts, SMALL)
        flags.append(list(own))
        for i, row in enumerate(found):
            for v in row.tolist() if own[i] == " " else ():
                if start <= v % 256 <= end:
                    buckets[v].append((g, i))
    marks = 0
    for entries in buckets.values():
        if len({g for g, _ in entries}) > 1:
            for g, i in sorted(entries, reverse=reverse)[1:]:
                flags[g][i] = "D"
                marks += 1
    return {g: "".join(f) for g, f in enumerate(flags)}, marks


@pytest.mark.parametrize(("start", "end", "reverse"), [(0, 255, False), (0, 255, True), (0, 99, False), (100, 255, True), (200, 100, False)])
def test_merge_of_split_ranges(spark, start, end, reverse):
    groups = [TEXTS[:4], [TEXTS[1], "only here it stands", TEXTS[0]], ["only here it stands", "x", TEXTS[3]]]
    merged = merge([_group(spark, g) for g in groups], start=start, end=end, reverse=reverse)
    wanted, marks = _brute_merge(groups, start, end, reverse)
    assert _merged(merged.flags) == wanted and merged.cross.first()[0] == marks


def test_ranges_compose(spark):
    sources = [_group(spark, TEXTS), _group(spark, TEXTS[2:] + ["more"])]
    whole = merge(sources)
    parts = [merge(sources, start=a, end=b) for a, b in ((0, 63), (64, 255))]
    assert _merged(either(parts[0].flags, parts[1].flags)) == _merged(whole.flags)
    assert sum(p.cross.first()[0] for p in parts) == whole.cross.first()[0]


def test_slots_by_place_in_the_group(spark):
    """Two sources in a group: item numbers mark the wrong document, places don't."""
    both = _docs(spark, ["own words alone", "and others here"], "a").unionByName(_docs(spark, ["a text that two groups have", "last of all"], "b"))
    first = dedup(both, SMALL)
    sources = [_group(spark, ["a text that two groups have"]), MergeSource(first.index, first.flags)]
    assert _merged(merge(sources).flags)[1] == "D   "
    assert _merged(merge(sources, compat=False).flags)[1] == "  D "
    check_range(sources, compat=False)
    short = MergeSource(first.index, first.flags.filter("global_idx < 1"))
    with pytest.raises(InvalidFormat):
        check_range([short])


def test_lines_are_written_in_order(spark, tmp_path):
    rows = spark.createDataFrame([(i, f"line {i}") for i in range(500)], "global_idx long, value string").repartition(7)
    assert write_lines(rows, str(tmp_path / "out")) == 500
    parts = sorted((tmp_path / "out").glob("part-*"))
    assert "".join(p.read_text() for p in parts) == "".join(f"line {i}\n" for i in range(500))


def test_pairs_are_written_with_six_decimals_in_order(spark, tmp_path):
    docs = spark.createDataFrame([(0, "x", "hello world again"), (1, "y", "hello world again!"), (2, "z", "hello world")], "item_number long, id string, text string")
    assert write_pairs(pairwise_similarity(docs, n=3, threshold=0.4), str(tmp_path / "pairs")) == 3
    lines = "".join(p.read_text() for p in sorted((tmp_path / "pairs").glob("part-*"))).splitlines()
    assert lines == ["0.937500\tx\ty", "0.600000\tx\tz", "0.562500\ty\tz"]


def test_counts_of_what_is_applied(spark):
    lines = spark.createDataFrame([(i, f"line {i}") for i in range(6)], "item_number long, value string")
    found = dedup(_docs(spark, TEXTS), SMALL)
    assert apply_whole(lines, found.flags).count() == _brute_flags(TEXTS, SMALL).count(" ")


def test_path_lists_and_bad_source_lines(spark, tmp_path):
    listed = tmp_path / "list"
    listed.write_text("  b.hash \n\n\ta.hash\n   \n")
    assert read_path_list(spark, str(listed)) == ["b.hash", "a.hash"]
    for text in ("no tab here\n", "-1\ta\n", "x\ta\n"):
        bad = tmp_path / f"src{len(text)}"
        bad.write_text(text)
        with pytest.raises(InvalidFormat):
            read_src(spark, str(bad))


def test_invalid_utf8_is_refused(spark, tmp_path):
    bad = tmp_path / "bad.jsonl"
    bad.write_bytes(b'{"text": "good"}\n{"text": "\xff\xfe"}\n')
    with pytest.raises(IoError):
        check_jsonl(spark, str(bad))
    with pytest.raises(Exception, match="UTF-8"):
        read_jsonl(spark, str(bad)).collect()


def test_items_are_numbered_over_many_partitions(spark, tmp_path):
    source = tmp_path / "lines.txt"
    source.write_text("\n".join("" if i % 5 == 0 else f"line {i}" for i in range(3000)) + "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    try:
        rows = sorted((r.item_number, r.value) for r in read_lines(spark, str(source)).collect())
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert rows == list(enumerate(f"line {i}" for i in range(3000) if i % 5))
    table = spark.createDataFrame([(i, f"s{i % 3}") for i in range(1000)], "k long, source string").repartition(9)
    numbered = from_table(table, order_col="k", source_col="source", text_col=None, keep=("k",)).collect()
    assert all(r.item_number == r.k // 3 for r in numbered) and len(numbered) == 1000


def test_similar_pairs_against_brute_force(spark):
    """Thresholds, sizes, equal texts, empty sets, and groups that are split into blocks."""
    import random

    from winnower.operators import similarity

    rng = random.Random(5)
    base = ["".join(rng.choice("abcdefgh ") for _ in range(rng.randint(5, 60))) for _ in range(25)]
    texts = [t[: rng.randint(1, len(t))] + "".join(rng.choice("abc") for _ in range(rng.randint(0, 6))) for t in base for _ in range(3)] + ["ab", "", "xy"] + [base[0]] * 12
    rows = spark.createDataFrame(list(enumerate(texts)), "idx long, text string").repartition(3)
    sets = [{t[i : i + 3] for i in range(len(t) - 2)} for t in texts]
    like = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
    old, similarity.BLOCK = similarity.BLOCK, 5
    try:
        for threshold in (1.0, 0.8, 0.3, 0.0):
            wanted = {(i, j): like(sets[i], sets[j]) for j in range(len(texts)) for i in range(j) if like(sets[i], sets[j]) >= threshold}
            found = {(r.i, r.j): r.similarity for r in similar_pairs(rows, n=3, threshold=threshold).collect()}
            assert found == pytest.approx(wanted)
            if threshold:
                classes = [min(k for k, other in enumerate(sets) if other == s) for s in sets]
                links = {(i, j) for i, j in wanted if classes[i] == i and classes[j] == j}
                made = similar_classes(rows, n=3, threshold=threshold)
                assert {(r.i, r.j) for r in made.links.collect()} == links
                assert {(r.idx, r["class"], r.n_links) for r in made.by_document().collect()} == {(k, c, sum(c in p for p in links)) for k, c in enumerate(classes)}
        assert not similar_classes(rows, n=3, threshold=1.5).links.count()
        assert similar_pairs(rows, n=3, threshold=1.5).count() == 0
    finally:
        similarity.BLOCK = old
