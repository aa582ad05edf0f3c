"""Behaviour of n-grams, signatures, flags, merging, filtering and similarity on small inputs."""

from __future__ import annotations

import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from winnower.config import ConfigError, InvalidFormat, JsonError, MinHashConfig, MissingField
from winnower.functions.ngrams import char_ngrams, jaccard_similarity
from winnower.functions.signature import signatures
from winnower.functions.xxh3 import digest
from winnower.operators.apply import apply_each, apply_whole
from winnower.operators.dedup import check_same_config, dedup
from winnower.operators.merge import MergeSource, merge
from winnower.operators.similarity import pairwise_similarity
from winnower.sources.jsonl import check_jsonl, read_jsonl
from winnower.sources.manifest import read_src, write_src

SMALL = MinHashConfig(3, 3, 2)


def _docs(spark, texts, path="a"):
    return spark.createDataFrame([(path, i, t) for i, t in enumerate(texts)], "file_path string, item_number long, text string")


def _flags(result) -> str:
    return "".join(r.flag for r in result.flags.orderBy("global_idx").collect())


@pytest.mark.parametrize(
    ("text", "n", "wanted"),
    [("plum", 3, ["plu", "lum"]), ("fig", 7, []), ("kiwi", 4, ["kiwi"]), ("", 2, []), ("oak", 1, ["o", "a", "k"]), ("oak", 0, []), ("é漢x", 2, ["é漢", "漢x"]), ("🜁🜂z🜃", 3, ["🜁🜂z", "🜂z🜃"])],
)
def test_ngrams(spark, text, n, wanted):
    row = spark.createDataFrame([(text,)], "t string").select(char_ngrams("t", n).alias("g")).first()
    assert list(row.g) == wanted


@settings(max_examples=200, deadline=None)
@given(st.binary(max_size=600), st.integers(0, 2**64 - 1))
def test_hash_equals_the_public_library(data, seed):
    assert digest(data, seed) == xxhash.xxh3_64_intdigest(data, seed)


def test_signature_is_the_least_hash_of_each_seed():
    texts = ["hello world", "ab", "こんにちは世界"]
    found = signatures(texts, SMALL)
    for text, row in zip(texts, found, strict=True):
        grams = {text[i : i + 3].encode() for i in range(len(text) - 2)}
        wanted = [min((xxhash.xxh3_64_intdigest(g, s) for g in grams), default=2**64 - 1) for s in range(SMALL.total_hashes)]
        assert [int(x) % 2**64 for x in row] == wanted


@pytest.mark.parametrize(("reverse", "wanted"), [(False, " DD "), (True, "DD  ")])
def test_flags_of_equal_texts(spark, reverse, wanted):
    same = "the quick brown fox jumps over the lazy dog"
    found = dedup(_docs(spark, [same, same, same, "0123456789 9876543210"]), MinHashConfig(5, 4, 4), reverse=reverse)
    assert _flags(found) == wanted
    assert tuple(found.stats().first()) == (4, 2, 50.0)
    assert found.index.count() == 2 * 4
    assert found.index.filter("split <> (bucket_value & 255)").count() == 0


def test_two_sources_in_the_given_order(spark):
    docs = _docs(spark, ["one same text here"], "b").unionByName(_docs(spark, ["one same text here"], "a"))
    found = dedup(docs, SMALL, order=["b", "a"])
    assert [(r.file_path, r.item_count, r.offset) for r in found.sources.orderBy("source_idx").collect()] == [("b", 1, 0), ("a", 1, 1)]
    assert _flags(found) == " D"
    with pytest.raises(ConfigError):
        dedup(docs, SMALL, order=[])


def test_configurations_must_agree():
    assert check_same_config([SMALL, SMALL]) == SMALL
    for bad in ([], [SMALL, MinHashConfig()]):
        with pytest.raises(ConfigError):
            check_same_config(bad)


@pytest.mark.parametrize(("reverse", "wanted"), [(False, [" ", "D", "D"]), (True, ["D", "D", " "])])
def test_merge_keeps_one_group(spark, reverse, wanted):
    groups = []
    for _ in range(3):
        found = dedup(_docs(spark, ["a text that all three groups hold"]), SMALL)
        groups.append(MergeSource(found.index, found.flags))
    merged = merge(groups, reverse=reverse)
    assert [r.flag for r in merged.flags.orderBy("group_idx").collect()] == wanted
    assert merged.cross.first()[0] > 0


def test_apply(spark):
    lines = spark.createDataFrame([(i, f'{{"id": {i}}}') for i in range(3)], "item_number long, value string")
    flags = spark.createDataFrame([(0, " "), (1, "D"), (2, " ")], "global_idx long, flag string")
    assert [r.global_idx for r in apply_whole(lines, flags).orderBy("global_idx").collect()] == [0, 2]
    assert apply_whole(lines.filter("item_number < 2"), flags).count() == 1  # fewer lines than flags
    with pytest.raises(InvalidFormat):
        apply_whole(lines, flags.filter("global_idx < 2"))
    sources = spark.createDataFrame([(0, 2, "a", 0), (1, 1, "b", 2)], "source_idx int, item_count long, file_path string, offset long")
    assert [r.global_idx for r in apply_each(lines.filter("item_number < 1"), flags, sources, "b").collect()] == [2]


@pytest.mark.parametrize(("a", "b", "wanted"), [("planet", "planes", 4 / 6), ("moon", "moon", 1.0), ("moon", "sky", 0.0), ("", "", 1.0), ("moon", "", 0.0)])
def test_jaccard(spark, a, b, wanted):
    row = spark.createDataFrame([(a, b)], "a string, b string").select(jaccard_similarity("a", "b", 2).alias("s")).first()
    assert row.s == pytest.approx(wanted)


def test_pairwise_similarity(spark):
    docs = spark.createDataFrame([(0, "x", "hello world again"), (1, "y", "hello world again!"), (2, "z", "something else")], "item_number long, id string, text string")
    found = pairwise_similarity(docs, n=3, threshold=0.3).collect()
    assert [(r.id_a, r.id_b) for r in found] == [("x", "y")]
    assert pairwise_similarity(docs, n=3, threshold=0.99).count() == 0
    assert pairwise_similarity(docs, n=3, threshold=0.0).count() == 3


def test_jsonl(spark, tmp_path):
    good = tmp_path / "good.jsonl"
    good.write_text('{"text": "a"}\n\n{"id": 7, "text": "b"}\r\n{"id": "s", "text": "c"}\n')
    rows = read_jsonl(spark, str(good), id_field="id").orderBy("item_number").collect()
    assert [(r.item_number, r.text, r.id) for r in rows] == [(0, "a", "0"), (1, "b", "7"), (2, "c", "s")]
    for text, error in (("not json\n", JsonError), ('{"body": "a"}\n', MissingField), ('{"text": 1}\n', MissingField)):
        bad = tmp_path / f"{error.__name__}{len(text)}.jsonl"
        bad.write_text(text)
        with pytest.raises(error):
            check_jsonl(spark, str(bad))


def test_manifest_round_trip(spark, tmp_path):
    found = dedup(_docs(spark, ["one text", "another text"], "a").unionByName(_docs(spark, ["a third"], "b")), SMALL)
    write_src(found.sources, str(tmp_path / "src"))
    again = read_src(spark, str(tmp_path / "src")).orderBy("source_idx")
    columns = ["source_idx", "item_count", "file_path", "offset"]
    assert [tuple(r) for r in again.select(*columns).collect()] == [(0, 2, "a", 0), (1, 1, "b", 2)]


def test_empty_tables(spark):
    none = _docs(spark, ["x"]).limit(0)
    found = dedup(none, SMALL)
    assert found.flags.count() == 0
    assert tuple(found.stats().first()) == (0, 0, None)
    assert none.select(F.col("item_number").alias("item_number"), F.lit("i").alias("id"), "text").transform(pairwise_similarity).count() == 0
