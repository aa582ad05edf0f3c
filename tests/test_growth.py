"""Stored indices that grow, files of fixed-width values, ranks, streams, and the edges of flags and merges."""

from __future__ import annotations

import random
import re
import struct
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from winnower.config import ConfigError, MinHashConfig
from winnower.functions.signature import bands, bands_of_signature, signature, signatures, xxh3_64
from winnower.operators import generations
from winnower.operators.dedup import compute_bands, dedup, flags_of
from winnower.operators.merge import MergeSource, merge, merge_tables, write_index_table
from winnower.operators.ranks import ranked
from winnower.plans import catalog
from winnower.sources import binary
from winnower.streaming.flags import flag_batch, flag_stream, stream_flags

SMALL = MinHashConfig(3, 3, 2)
TEXTS = ["a text that two groups have", "own words alone", "and others here", "a text that two groups have!", "", "ab", "one more of them", "own words alone"]


def _docs(spark, texts, path="a"):
    return spark.createDataFrame([(path, i, t) for i, t in enumerate(texts)], "file_path string, item_number long, text string")


def _group(spark, texts):
    found = dedup(_docs(spark, texts), SMALL)
    return MergeSource(found.index, found.flags)


def _string(flags, *order):
    return "".join(r.flag for r in flags.orderBy(*order).collect())


def _own(texts, config=SMALL):
    """Flags of one group, band by band."""
    seen, out = set(), ""
    for row in bands(signatures(texts, config), config).tolist():
        keys = set(enumerate(row))
        out += "D" if keys & seen else " "
        seen |= keys
    return out


@pytest.mark.parametrize(("config", "wanted"), [(MinHashConfig(3, 0, 2), "    "), (MinHashConfig(3, 2, 0), " DDD"), (MinHashConfig(0, 2, 2), " DDD"), (MinHashConfig(3, 2, 2), "  D ")])
def test_flags_of_degenerate_parameters(spark, config, wanted):
    texts = ["alpha beta", "gamma delta", "alpha beta", "epsilon"]
    rows = spark.createDataFrame(list(enumerate(texts)), "global_idx long, text string")
    banded = compute_bands(rows, config)
    assert _string(flags_of(banded), "global_idx") == wanted == _own(texts, config)
    assert dedup(_docs(spark, texts), config).flags.filter("flag = ' '").count() == wanted.count(" ")


def test_a_mark_without_a_flag_is_refused(spark):
    flags = spark.createDataFrame([(0, " ")], "global_idx long, flag string")
    entry = lambda item, value: (0, item, value, 0, item, value % 256)
    index = lambda *rows: spark.createDataFrame(list(rows), "group int, item_number int, bucket_value long, bucket_idx int, global_idx long, split int")
    first = MergeSource(index(entry(0, 7)), flags)
    for compat in (True, False):
        with pytest.raises(Exception, match="item 99 is out of bounds for group 1"):
            merge([first, MergeSource(index(entry(99, 7)), flags)], compat=compat).flags.collect()
        assert _string(merge([first, MergeSource(index(entry(99, 8)), flags)], compat=compat).flags, "group_idx") == "  "  # never marked
        assert _string(merge([first, MergeSource(index(entry(99, 7)), flags)], start=8, compat=compat).flags, "group_idx") == "  "


@pytest.mark.parametrize("name", ["minhash_signature", "band_digests"])
def test_signatures_are_made_once(spark, sf, name):
    plan = catalog.QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1
    assert plan.index("ArrowEvalPython") < plan.index("Exchange")  # behind the dealing, not on the scan's one partition


def test_what_is_numbered_is_hashed_once(spark, sf, monkeypatch, tmp_path):
    """A file for each batch that the kernel sees tells how many rows were hashed."""
    from winnower.functions import signature as kernel

    def counting(make, folder=str(tmp_path)):
        from collections.abc import Iterator

        import pyarrow as pa
        from pyspark.sql.types import ArrayType, LongType

        def run(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
            import uuid

            for part in texts:
                open(f"{folder}/{len(part)}-{uuid.uuid4().hex}", "w").close()
                yield kernel._lists(make(part.to_pylist()))

        run.__annotations__ = {"texts": Iterator[pa.Array], "return": Iterator[pa.Array]}
        return F.arrow_udf(run, ArrayType(LongType()))

    monkeypatch.setattr(kernel, "_udf", counting)
    count = lambda t: spark.read.parquet(f"{sf}/{t}.parquet").count()
    for name, wanted in (("minhash_signature", count("documents")), ("dedup_stored", count("documents")), ("index_rows", count("documents")), ("merge_forward", count("documents") + count("conversations"))):
        for f in tmp_path.iterdir():
            f.unlink()
        catalog.QUERIES[name](spark, sf).collect()
        assert sum(int(f.name.split("-")[0]) for f in tmp_path.iterdir()) == wanted, name


GROUPS = [TEXTS, [TEXTS[1], "only here it stands", TEXTS[0], "xy"], ["only here it stands", "x", TEXTS[3], TEXTS[6], "new"], ["new", "newer than new"]]


def _arrivals(groups, gone=()):
    """Flags of groups that come one after the other. ``gone`` has (after group, group, item)."""
    seen, out = defaultdict(set), []
    for g, texts in enumerate(groups):
        own, found = _own(texts), bands(signatures(texts, SMALL), SMALL).tolist()
        values = {i: set(row) for i, row in enumerate(found) if own[i] == " "}
        before = set().union(*seen.values()) if seen else set()
        out.append("".join("D" if own[i] == "D" or values[i] & before else " " for i in range(len(texts))))
        seen |= {(g, i): v for i, v in values.items()}
        for after, h, i in gone:
            if after == g:
                seen.pop((h, i), None)
    return out


@pytest.mark.parametrize(("compacted", "gone"), [((), ((1, 0, 0), (1, 0, 1), (2, 1, 1))), ((1,), ((1, 0, 0), (1, 0, 1), (2, 1, 1))), ((0, 2), ())])
def test_groups_are_flagged_as_they_come(spark, tmp_path, compacted, gone):
    path, found = f"file://{tmp_path}/index", []
    generations.create(spark, path, SMALL)
    for g, texts in enumerate(GROUPS):
        own = _group(spark, texts)
        found.append(_string(generations.flag_group(spark, path, own), "global_idx"))
        assert generations.append(spark, path, own.index) == g
        if rows := [(h, i) for after, h, i in gone if after == g]:
            generations.drop_documents(spark, path, spark.createDataFrame(rows, "group int, global_idx long"))
        if g in compacted:
            generations.compact(spark, path)
            assert len(generations.state(spark, path).generations) == 1 and not generations.state(spark, path).tombstones
    assert found == _arrivals(GROUPS, gone)
    with pytest.raises(ConfigError):
        generations.create(spark, path, MinHashConfig())
    generations.create(spark, path, SMALL)
    assert generations.state(spark, path).next_group == len(GROUPS)


def test_a_probe_skips_files_and_unfinished_steps(spark, tmp_path):
    path = f"file://{tmp_path}/index"
    generations.create(spark, path, SMALL)
    rng = random.Random(3)
    old = ["".join(rng.choice("abcdefghij ") for _ in range(60)) for _ in range(200)]
    generations.append(spark, path, _group(spark, old).index)
    generations.append(spark, path, _group(spark, [f"wholly other words {i * i}" for i in range(50)]).index)
    own = _group(spark, [old[7], "none of these words"])
    hits = generations.candidates(spark, path, own.index)
    only = generations.needed_slices(hits)
    files = lambda df: {f for r in df.select("_metadata.file_path").distinct().collect() for f in r}
    folder = next(iter(only))
    every = spark.read.schema(generations.ENTRIES).parquet(f"{path}/generations/{folder}")
    read = every.filter(F.col("slice").isin(only[folder]))
    assert len(only) == 1 and len(files(read)) <= 3 < len(files(every))
    plan = generations.stored_entries(spark, path, only)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and re.search(r"PartitionFilters: \[.*slice", plan)
    assert _string(generations.flag_group(spark, path, own), "global_idx") == "D "
    # A generation that the log doesn't name isn't there.
    generations._write(spark, path, own.index.select("group", "item_number", "bucket_value", "bucket_idx", "global_idx", "split"))
    assert _string(generations.flag_group(spark, path, _group(spark, ["none of these words"])), "global_idx") == " "


@pytest.mark.parametrize(("start", "end", "reverse"), [(64, 191, False), (0, 255, True), (200, 100, True)])
def test_stored_indices_are_merged_where_they_lie(spark, start, end, reverse):
    sources = [_group(spark, g) for g in GROUPS[:3]]
    named = []
    for g, s in enumerate(sources):
        named.append((f"stored_{start}_{end}_{reverse}_{g}".lower(), s.flags))
        write_index_table(s.index, named[-1][0], buckets=2)
    found, wanted = merge_tables(spark, named, start=start, end=end, reverse=reverse), merge(sources, start=start, end=end, reverse=reverse)
    assert sorted(map(tuple, found.flags.collect())) == sorted(map(tuple, wanted.flags.collect()))
    assert found.cross.first()[0] == wanted.cross.first()[0]
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = merge_tables(spark, named[:2], start=start, end=end, reverse=reverse).flags._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    if start <= end:
        # Values of several groups and marks are moved; an entry's scan is joined without an exchange above it.
        assert re.search(r"PartitionFilters: \[isnotnull\(split", plan) and "Bucketed: true" in plan
        lines = plan.splitlines()
        depth = lambda x: len(x) - len(x.lstrip(" :+-*|"))
        for i, line in enumerate(lines):
            if "FileScan parquet spark_catalog" in line:
                above, at = [], depth(line)
                for x in reversed(lines[:i]):
                    if depth(x) < at:
                        above.append(x.strip(" :+-*"))
                        at = depth(x)
                join = next(k for k, x in enumerate(above) if "Join" in x)
                assert not any(x.startswith("Exchange") for x in above[:join])


def test_flag_files(spark, tmp_path):
    rows = [(i, "D" if i % 7 == 3 else " ") for i in range(5000)]
    path = f"file://{tmp_path}/a.dup"
    for part in (rows, rows[:10], []):  # each replaces the one before
        binary.write_flag_file(spark.createDataFrame(part, "global_idx long, flag string").repartition(5), path)
        assert sorted(map(tuple, binary.read_flag_file(spark, path).collect())) == part
        assert b"".join(p.read_bytes() for p in sorted((tmp_path / "a.dup").iterdir()) if p.suffix != ".crc") == "".join(f for _, f in part).encode()
    with pytest.raises(Exception, match="InvalidFormat"):
        binary.write_flag_file(spark.createDataFrame([r for r in rows if r[0] != 17], "global_idx long, flag string").coalesce(1), path)
    with pytest.raises(Exception, match="InvalidFormat"):
        binary.write_flag_file(spark.createDataFrame(rows[5:], "global_idx long, flag string"), path)
    assert binary.read_flag_file(spark, path).count() == 0  # what was there stays, and nothing beside it
    assert [p.name for p in tmp_path.iterdir()] == ["a.dup"]
    (tmp_path / "one.dup").write_bytes(b" D ")
    assert [r.flag for r in binary.read_flag_file(spark, str(tmp_path / "one.dup")).orderBy("global_idx").collect()] == [" ", "D", " "]


def test_index_files(spark, tmp_path, monkeypatch):
    found = dedup(_docs(spark, TEXTS), SMALL).index
    base = f"file://{tmp_path}/own"
    columns = ["split", "group", "item_number", "bucket_value"]
    wanted = sorted(map(tuple, found.select(*columns).collect()))
    for _ in range(2):  # the second replaces the first
        binary.write_index_files(found, base)
        assert sorted(map(tuple, binary.read_index_files(spark, base).collect())) == wanted
    middle = wanted[len(wanted) // 2][0]
    assert {r.split for r in binary.read_index_files(spark, base, start=middle, end=middle).collect()} == {middle}
    record = struct.pack("<IIQ", 1, 2, 2**64 - 3)
    file = tmp_path / "made.idx.00253"
    for tail, error in ((b"", None), (record[:3], None), (record[:4], "IoError"), (record[:15], "IoError")):
        file.write_bytes(b"MAGIC-01" + 3 * record + tail)
        read = lambda: binary.read_index_files(spark, f"{tmp_path}/made", magic="MAGIC-01").collect()
        if error:
            with pytest.raises(Exception, match=error):
                read()
        else:
            assert [tuple(r) for r in read()] == 3 * [(253, 1, 2, -3)]
    file.write_bytes(b"MAGIC-02")
    with pytest.raises(Exception, match="InvalidFormat"):
        read()
    file.write_bytes(b"MAG")
    with pytest.raises(Exception, match="IoError"):
        read()


def test_signature_matrices(spark, tmp_path, monkeypatch):
    path = f"file://{tmp_path}/m"
    rows = spark.createDataFrame(list(enumerate(TEXTS)), "item_number long, text string").repartition(3).select("item_number", signature("text", SMALL).alias("signature"))
    binary.write_signature_files(rows, path, SMALL)
    found, config = binary.read_signature_files(spark, path)
    wanted = signatures(TEXTS, SMALL).view(np.int64)
    assert config == SMALL and binary.signature_parameters(path) == (len(TEXTS), SMALL)
    assert [list(r.signature) for r in found.orderBy("item_number").collect()] == wanted.tolist()
    for r, b in ((6, 1), (2, 3), (1, 6)):  # one stored signature, banded anew
        other = MinHashConfig(3, r, b)
        again = [list(x.v) for x in found.orderBy("item_number").select(bands_of_signature("signature", other).alias("v")).collect()]
        assert again == bands(wanted.view(np.uint64), other).view(np.int64).tolist()
    binary.write_signature_files(rows.limit(0), path, SMALL)
    assert binary.read_signature_files(spark, path)[0].count() == 0 and binary.signature_parameters(path) == (0, SMALL)
    header = struct.pack("<8sQIII", b"MAGIC-01", len(TEXTS), 3, 3, 2)
    file = tmp_path / "one"
    file.write_bytes(header + np.ascontiguousarray(wanted.T).tobytes() + b"more")  # surplus bytes are ignored
    read = lambda: binary.read_signature_files(spark, str(file), magic="MAGIC-01")
    assert [list(r.signature) for r in read()[0].orderBy("item_number").collect()] == wanted.tolist()
    for data, error in ((b"MAGIC-02" + header[8:], "InvalidFormat"), (header[:20], "IoError"), (header[:5], "IoError"), (header + bytes(8), "IoError")):
        file.write_bytes(data)
        with pytest.raises(Exception) as raised:
            read()
        assert type(raised.value).__name__ == error
    two = tmp_path / "two"
    two.mkdir()
    for name, n in (("a", 3), ("b", 4)):
        (two / name).write_bytes(struct.pack("<8sQIII", b"MAGIC-01", 0, n, 3, 2))
    with pytest.raises(ConfigError):
        binary.signature_parameters(str(two), magic="MAGIC-01")


@pytest.mark.parametrize("partitions", [1, 17])
def test_ranks_within_keys(spark, partitions):
    """A third of all rows has one key, another third one key and one place."""
    rng = random.Random(1)
    rows = [(("hot" if i % 3 == 0 else "same" if i % 3 == 1 else rng.choice([None, "x", "y", f"k{i}"])), None if i % 50 == 0 else 5 if i % 3 == 1 else rng.randrange(900)) for i in range(3000)]
    df = spark.createDataFrame(rows, "k string, rank_of long").repartition(4)
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    try:
        found = ranked(df, ["k"], ["rank_of"]).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    by = defaultdict(list)
    for r in found:
        by[r.k].append((r["rank"], -1 if r.rank_of is None else r.rank_of))
    assert Counter((r.k, r.rank_of) for r in found) == Counter(rows)
    for held in by.values():
        assert [x for x, _ in sorted(held)] == list(range(1, len(held) + 1)) and [y for _, y in sorted(held)] == sorted(y for _, y in held)
    assert ranked(df.limit(0), ["k"], ["rank_of"]).count() == 0


def test_a_hot_bucket_is_ranked_by_many_tasks(spark, monkeypatch):
    from winnower.operators import ranks

    kept = {}
    monkeypatch.setattr(ranks, "written", lambda df, name, old=ranks.written: kept.setdefault(name, old(df, name)))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # which deals by bytes, and these are few
    try:
        ranked(spark.range(30_000).select((F.col("id") % 3).alias("k"), "id"), ["k"], ["id"]).count()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    tasks = kept["ranked"].filter("c0 = 0").groupBy("part").count().collect()
    assert len(tasks) >= 3 and max(r["count"] for r in tasks) <= 6_000


@pytest.mark.parametrize("cuts", [[8], [3, 1, 4]])
def test_flags_of_a_stream(spark, tmp_path, cuts):
    """Any cut into batches, with the query stopped between them, gives the flags of the whole; a batch that runs twice changes nothing."""
    path, at = f"file://{tmp_path}", 0
    for n in cuts:
        spark.createDataFrame([(i, TEXTS[i]) for i in range(at, at + n)], "doc_id long, text string").coalesce(1).write.mode("append").parquet(f"{path}/in")
        at += n
        flag_stream(spark.readStream.schema("doc_id long, text string").parquet(f"{path}/in"), f"{path}/out", SMALL).awaitTermination()
    assert _string(stream_flags(spark, f"{path}/out"), "doc_id") == _own(TEXTS)
    last = spark.createDataFrame([(i, TEXTS[i]) for i in range(at - cuts[-1], at)], "doc_id long, text string")
    flag_batch(last, len(cuts) - 1, f"{path}/out", SMALL)
    assert _string(stream_flags(spark, f"{path}/out"), "doc_id") == _own(TEXTS)


def test_hash_column_equals_the_public_library(spark, monkeypatch):
    rng = random.Random(7)
    values = [None, "", "é", *("".join(rng.choice("abcé🎉 ") for _ in range(n)) for n in (1, 3, 4, 8, 9, 16, 17, 128, 129, 240, 241, 1024, 1025, 5000, 100_000)), "same", "same"]
    df = spark.createDataFrame([(v,) for v in values], "t string").coalesce(1)
    for seed in (0, 2**63 + 11):
        wanted = [None if v is None else xxhash.xxh3_64_intdigest(v.encode(), seed) for v in values]
        for column in (F.col("t"), F.encode("t", "UTF-8")):
            found = [r.h for r in df.select(xxh3_64(column, seed).alias("h")).collect()]
            assert [None if h is None else h % 2**64 for h in found] == wanted


def test_parameters_are_checked_without_a_row(spark, tmp_path):
    from winnower.operators import dedup as own

    a, b = f"file://{tmp_path}/a", f"file://{tmp_path}/b"
    assert own.write_bands(_docs(spark, TEXTS), a, SMALL) == len(TEXTS)
    own.write_bands(_docs(spark, TEXTS, "b"), b, MinHashConfig(3, 2, 2))
    # The rows of a are spoiled: what is checked at once are the parameters beside them.
    spoiled = spark.read.parquet(a).withColumn("bands", F.slice("bands", 1, 2)).collect()
    spark.createDataFrame(spoiled, spark.read.parquet(a).schema).write.mode("append").parquet(a)
    rows, config = own.read_bands(spark, [a])
    assert config == SMALL
    with pytest.raises(Exception, match="InvalidFormat"):
        rows.collect()
    with pytest.raises(ConfigError):
        own.read_bands(spark, [a, b])
    rows, config = own.read_bands(spark, [b, b])
    assert config.num_buckets == 2 and rows.count() == 2 * len(TEXTS) and set(rows.columns) == {"file_path", "item_number", "bands"}
