"""Registered queries of the near-duplicate engine and the SQL they are held against.

Every query reads a whole table. CHECKED is small enough for SQL to follow hash by hash; ``dedup_default`` has the
default parameters, which SQL can't follow, and is held against known counts in the tests.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import DUPLICATE, MinHashConfig
from ..functions.ngrams import char_ngrams
from ..functions.signature import band_values, bands_of_signature, gram_counts, signature, signature_slice, xxh3_64
from ..operators import generations, similarity
from ..operators.apply import apply_each, apply_whole
from ..operators.detection import Detection, detect
from ..operators.dedup import DedupResult, dedup_bands, explode_bands, flags_of, index_entries, read_bands, read_index, split_histogram, write_bands, write_index
from ..operators.merge import MergeResult, MergeSource, either, merge, merge_tables, write_index_table
from ..operators.similarity import similar_classes, similar_pairs, write_pairs
from ..operators.ranks import ranked
from ..sources.binary import read_flag_file, read_index_files, read_signature_files, write_index_files, write_merged_flags, write_signature_files
from ..sources.jsonl import from_table, read_jsonl, write_lines
from ..sources.manifest import manifest, read_src, write_src
from . import oracle
from ..streaming.flags import flag_stream, stream_flags
from ..staging import dealt, shared_folder, written

CHECKED = MinHashConfig(5, 4, 2)
#: Bands whose rate of detection lies between 0 and 1 for similarities of 0.5 to 0.9.
DETECTING = MinHashConfig(5, 4, 8)
TARGET = "src1"
LATER = "src15"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents")


def _dealt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id and text, dealt to all cores: a file may be one partition, and hashing is what takes time."""
    return dealt(_documents(spark, sf_dir).select("doc_id", "text"))


def _new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def _by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbered band values of the documents of each source. Texts are hashed where they are read; what is numbered and written is
    narrow."""
    rows = dealt(_documents(spark, sf_dir).select("source", "doc_id", "text")).select("source", "doc_id", band_values("text", CHECKED).alias("bands"))
    return from_table(written(rows, "hashed"), order_col="doc_id", source_col="source", text_col=None, keep=("doc_id", "bands"))


def ngram_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    grams, distinct = F.col("grams"), F.size(F.array_distinct("grams"))
    rows = _dealt(spark, sf_dir).select("doc_id", char_ngrams("text", 5).alias("grams"))
    return rows.select("doc_id", F.size(grams).cast("long").alias("n_grams"), distinct.cast("long").alias("n_distinct"), F.get(grams, F.lit(0)).alias("first_gram"), F.element_at(F.when(F.size(grams) > 0, grams), -1).alias("last_gram"))


def gram_frequencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gram_counts(_dealt(spark, sf_dir), 5)


def minhash_signature(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _dealt(spark, sf_dir).select("doc_id", signature("text", CHECKED).alias("sig"))
    return rows.select("doc_id", F.posexplode_outer("sig").alias("seed", "hash")).filter("seed is not null")  # see explode_bands()


def band_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _dealt(spark, sf_dir).select("doc_id", bands_of_signature(signature("text", CHECKED), CHECKED).alias("bands"))
    return explode_bands(rows, "doc_id")


def _flags(spark: SparkSession, sf_dir: str, config: MinHashConfig, reverse: bool = False) -> DataFrame:
    banded = written(_dealt(spark, sf_dir).select("doc_id", band_values("text", config).alias("bands")), "bands")
    return flags_of(banded, reverse=reverse, idx="doc_id")


def dedup_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flags(spark, sf_dir, CHECKED)


def dedup_reverse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flags(spark, sf_dir, CHECKED, reverse=True)


def dedup_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flags(spark, sf_dir, MinHashConfig())


def _group(spark: SparkSession, sf_dir: str) -> DedupResult:
    return dedup_bands(_by_source(spark, sf_dir), stored=True)


def dedup_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _group(spark, sf_dir).stats()


def index_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _group(spark, sf_dir).index.select("group", "item_number", "bucket_value", "split")


def index_split_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split_histogram(_group(spark, sf_dir).index)


def source_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest(_documents(spark, sf_dir).select(F.col("source").alias("file_path")))


def unique_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _by_source(spark, sf_dir)
    found = dedup_bands(docs, stored=True)
    lines = docs.join(found.sources.select("file_path", "offset"), "file_path").select((F.col("offset") + F.col("item_number")).alias("item_number"), "doc_id")
    # Flags are applied to narrow rows; texts are joined to what stays.
    return apply_whole(lines, found.flags).join(_documents(spark, sf_dir).select("doc_id", "text"), "doc_id").select("global_idx", "doc_id", "text")


def unique_of_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _by_source(spark, sf_dir)
    found = dedup_bands(docs, stored=True)
    own = docs.filter(F.col("file_path") == TARGET).drop("bands")
    texts = _documents(spark, sf_dir).filter(F.col("source") == TARGET).select("doc_id", "text")
    return apply_each(own, found.flags, found.sources, TARGET).join(texts, "doc_id").select("global_idx", "doc_id", "text")


def unique_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The unique documents' lines, written in order and read back."""
    path = _new_folder(spark, "lines")
    write_lines(unique_documents(spark, sf_dir).select("global_idx", F.to_json(F.struct("doc_id", "text")).alias("value")), path)
    return spark.read.option("lineSep", "\n").text(path).select(F.get_json_object("value", "$.doc_id").cast("long").alias("doc_id"), F.get_json_object("value", "$.text").alias("text"))


def dedup_stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flags from two stored signature tables, whose parameters are held against each other."""
    docs = _documents(spark, sf_dir).withColumn("later", F.col("source") >= TARGET)
    paths = []
    for later in (False, True):
        rows = dealt(docs.filter(F.col("later") == later).select("source", "doc_id", "text"))
        paths.append(_new_folder(spark, "signatures"))
        write_bands(rows.select(F.col("source").alias("file_path"), F.col("doc_id").alias("item_number"), "text"), paths[-1], CHECKED)
    banded, _ = read_bands(spark, paths)
    placed = from_table(banded, order_col="item_number", source_col="file_path", text_col=None, keep=("bands",))
    return dedup_bands(placed, stored=True).flags


def index_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The index, written by split, and splits 16 to 199 of it read back."""
    path = _new_folder(spark, "index")
    write_index(_group(spark, sf_dir).index, path)
    return read_index(spark, path, start=16, end=199).select("group", "item_number", "bucket_value", "split")


def src_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _new_folder(spark, "src")
    write_src(source_manifest(spark, sf_dir), path)
    return read_src(spark, path)


def signature_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hashes of band 1."""
    rows = _dealt(spark, sf_dir).select("doc_id", signature_slice(signature("text", CHECKED), 1, CHECKED).alias("band"))
    return rows.select("doc_id", F.col("band")[0].alias("first"), F.col("band")[1].alias("second"))


def jaccard_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = similar_pairs(_dealt(spark, sf_dir).withColumnRenamed("doc_id", "idx"), n=5, threshold=0.6)
    return pairs.select(F.col("i").alias("doc_a"), F.col("j").alias("doc_b"), "similarity")


def _pairwise(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _dealt(spark, sf_dir).select(F.col("doc_id").alias("item_number"), F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("id"), "text")
    return similarity.pairwise_similarity(rows, n=5, threshold=0.8)


def pairwise_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pairwise(spark, sf_dir)


def similar_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's class of equal n-gram sets and to how many other classes that is similar; copies aren't expanded to pairs."""
    found = similar_classes(_dealt(spark, sf_dir).withColumnRenamed("doc_id", "idx"), n=5, threshold=0.6).by_document()
    return found.select(F.col("idx").alias("doc_id"), F.col("class").alias("class_id"), "n_links")


def all_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every pair of benchmark items: a threshold of 0."""
    rows = _table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("idx"), "text")
    return similar_pairs(rows, n=5, threshold=0.0).select(F.col("i").alias("item_a"), F.col("j").alias("item_b"), "similarity")


def pair_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs written as text lines and read back."""
    path = _new_folder(spark, "pairs")
    write_pairs(_pairwise(spark, sf_dir), path)
    return spark.read.option("lineSep", "\n").text(path)


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of conversations with an id that is in their order."""
    talk = _table(spark, sf_dir, "conversations").select(F.concat_ws("/", F.lpad(F.col("conv_id").cast("string"), 12, "0"), F.lpad(F.col("turn").cast("string"), 6, "0")).alias("doc_id"), "text")
    return talk


def _sources(spark: SparkSession, sf_dir: str) -> list[MergeSource]:
    """Documents and conversations as two groups of one source each."""
    return _groups_of([_documents(spark, sf_dir), _turns(spark, sf_dir)])


def _groups_of(tables: list[DataFrame]) -> list[MergeSource]:
    """Tables (doc_id, text) as groups of one source each."""
    sources = []
    for rows in tables:
        hashed = dealt(rows.select("doc_id", "text")).select("doc_id", band_values("text", CHECKED).alias("bands"))
        banded = from_table(written(hashed, "hashed"), order_col="doc_id", text_col=None, keep=("bands",)).select(F.col("item_number").alias("global_idx"), F.lit(0).alias("source_idx"), "item_number", "bands")
        flags = written(flags_of(banded), "flags")
        sources.append(MergeSource(index_entries(banded, flags), flags))
    return sources


def _groups(spark: SparkSession, sf_dir: str, **how: bool) -> MergeResult:
    return merge(_sources(spark, sf_dir), **how)


def merge_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _groups(spark, sf_dir).flags


def merge_reverse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _groups(spark, sf_dir, reverse=True).flags


def merge_cross(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _groups(spark, sf_dir).cross


def merge_by_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Buckets keyed by band and value, slots by place in the group."""
    return _groups(spark, sf_dir, compat=False).flags


def merge_split_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Splits 64 to 191 alone."""
    return merge(_sources(spark, sf_dir), start=64, end=191).flags


def merge_composed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All splits in two ranges, whose flags are put together."""
    sources = _sources(spark, sf_dir)
    return either(merge(sources, end=127).flags, merge(sources, start=128).flags)


def merge_stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Splits 64 to 191 of two stored indices, which are matched in the buckets they are stored in."""
    stored = []
    for s in _sources(spark, sf_dir):
        stored.append((f"index_{uuid.uuid4().hex}", s.flags))
        write_index_table(s.index, stored[-1][0], buckets=4)
    return merge_tables(spark, stored, start=64, end=191).flags


def dedup_incremental(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three groups, each flagged as it comes by what is stored of those before it: documents of earlier sources, of later ones,
    conversations. The index is compacted before the third."""
    docs, path = _documents(spark, sf_dir), _new_folder(spark, "generations")
    generations.create(spark, path, CHECKED)
    found = None
    for g, own in enumerate(_groups_of([docs.filter(F.col("source") < LATER), docs.filter(F.col("source") >= LATER), _turns(spark, sf_dir)])):
        if g == 2:
            generations.compact(spark, path)
        flags = generations.flag_group(spark, path, own).select(F.lit(g).alias("group_idx"), "global_idx", "flag")
        generations.append(spark, path, own.index)
        found = flags if found is None else found.unionByName(flags)
    return found


def dedup_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that arrive in four parts by id, flagged by a streaming query that is stopped and started again between them."""
    docs, path = _documents(spark, sf_dir).select("doc_id", "text"), _new_folder(spark, "stream")
    top = docs.agg(F.max("doc_id")).first()[0] or 0
    cuts = [0, top // 5, top // 2, top // 4 * 3, top + 1]
    for low, high in zip(cuts, cuts[1:], strict=False):
        dealt(docs.filter((F.col("doc_id") >= low) & (F.col("doc_id") < high))).write.mode("append").parquet(f"{path}/in")
        flag_stream(spark.readStream.schema(docs.schema).parquet(f"{path}/in"), f"{path}/out", CHECKED).awaitTermination()
    return stream_flags(spark, f"{path}/out")


def bucket_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's place in each of its buckets."""
    banded = written(_dealt(spark, sf_dir).select("doc_id", band_values("text", CHECKED).alias("bands")), "bands")
    return ranked(explode_bands(banded, "doc_id"), ["bucket_idx", "bucket_value"], ["doc_id"])


def _numbered_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    hashed = written(_dealt(spark, sf_dir).select("doc_id", signature("text", CHECKED).alias("signature")), "signatures")
    return from_table(hashed, order_col="doc_id", text_col=None, keep=("doc_id", "signature"))


def rebanded_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signatures written once as matrices and read back twice: flags by four bands of two hashes and by eight bands of one."""
    numbered, path = _numbered_signatures(spark, sf_dir), _new_folder(spark, "matrix")
    write_signature_files(numbered, path, CHECKED)
    found = None
    for r, b in ((CHECKED.num_buckets, CHECKED.band_size), (CHECKED.total_hashes, 1)):
        rows, _ = read_signature_files(spark, path)
        banding = MinHashConfig(CHECKED.ngram_size, r, b)
        banded = written(rows.select("item_number", bands_of_signature("signature", banding).alias("bands")), "bands")
        flags = flags_of(banded, idx="item_number").select(F.lit(r).alias("num_buckets"), "item_number", "flag")
        found = flags if found is None else found.unionByName(flags)
    return found.join(numbered.select("item_number", "doc_id"), "item_number").select("num_buckets", "doc_id", "flag")


def merged_flag_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Merged flags of both groups, each a file of one byte for a document, read back by ranges."""
    base = _new_folder(spark, "groups")
    paths = write_merged_flags(written(merge_forward(spark, sf_dir), "merged"), [f"{base}-{g}" for g in (0, 1)])
    first, second = (read_flag_file(spark, p).withColumn("group_idx", F.lit(g)) for g, p in enumerate(paths))
    return first.unionByName(second).select("group_idx", "global_idx", "flag")


def index_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The index as files of fixed-width records, one for each split, read back."""
    base = _new_folder(spark, "records")
    write_index_files(_group(spark, sf_dir).index, f"{base}")
    rows = read_index_files(spark, base)
    return rows.select(F.col("group").cast("int"), F.col("item_number").cast("int"), "bucket_value", "split")


def text_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """XXH3-64 of whole texts under two seeds."""
    return _dealt(spark, sf_dir).select("doc_id", xxh3_64("text").alias("hash"), xxh3_64("text", 2024).alias("seeded"))


def _detected(spark: SparkSession, sf_dir: str) -> Detection:
    return detect(_dealt(spark, sf_dir).withColumnRenamed("doc_id", "idx"), DETECTING, threshold=0.6)


def band_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct n-gram sets, by the least document that has each, that share a band, and how similar they are."""
    return _detected(spark, sf_dir).candidates.select(F.col("i").alias("doc_a"), F.col("j").alias("doc_b"), "n_bands", "similarity")


def band_detection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many similar pairs the bands find, by similarity, and what share they should."""
    return _detected(spark, sf_dir).by_similarity()


def short_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flags of the documents without an n-gram, whose signatures are equal: all but the first are duplicates of it."""
    short = _documents(spark, sf_dir).filter(F.length("text") < CHECKED.ngram_size).select("doc_id")
    return _flags(spark, sf_dir, CHECKED).join(short, "doc_id").select("doc_id", (F.col("flag") == DUPLICATE).alias("duplicate"))


def jsonl_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents written as JSON lines and read back by the strict reader."""
    path = _new_folder(spark, "jsonl")
    _documents(spark, sf_dir).select(F.to_json(F.struct(F.col("doc_id").cast("string").alias("id"), "text")).alias("value")).write.text(path)
    rows = read_jsonl(spark, path, id_field="id")
    return rows.select(F.col("id").cast("long").alias("doc_id"), "text", F.length("text").cast("long").alias("n_chars"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        ngram_counts, gram_frequencies, minhash_signature, band_digests, dedup_forward, dedup_reverse, dedup_default, dedup_stats, index_rows,
        index_split_histogram, source_manifest, unique_documents, unique_of_source, jaccard_pairs, merge_forward, merge_reverse, merge_cross,
        short_documents, jsonl_roundtrip, dedup_stored, index_roundtrip, src_roundtrip, signature_band, unique_lines, pairwise_similarity, pair_lines, all_pairs,
        merge_by_band, merge_split_range, merge_composed, merge_stored, dedup_incremental,
        dedup_stream, bucket_ranks, rebanded_flags, merged_flag_files, index_files, text_hashes,
        band_pairs, band_detection, similar_documents,
    )
}

_BANDS = oracle.bands(5, CHECKED.num_buckets)


def _dups(keeper: str) -> str:
    return f"dup AS (SELECT DISTINCT doc_id FROM (SELECT doc_id, {keeper}(doc_id) OVER (PARTITION BY bucket_idx, bucket_value) AS keeper FROM band) WHERE doc_id <> keeper)"


def _flagged(keeper: str) -> str:
    return f"WITH {_BANDS},\n{_dups(keeper)}\nSELECT d.doc_id, CASE WHEN x.doc_id IS NULL THEN ' ' ELSE 'D' END AS flag FROM documents d LEFT JOIN dup x ON d.doc_id = x.doc_id"


# Documents in the order of sources, then ids: ``g`` is the place in the group.
_PLACED = "placed AS (SELECT row_number() OVER (ORDER BY source, doc_id) - 1 AS g, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS item, dense_rank() OVER (ORDER BY source) - 1 AS src, doc_id, source, text FROM documents)"
_GROUP = f"""WITH {_BANDS}, {_PLACED},
pband AS (SELECT p.g, p.item, p.src, b.bucket_idx, b.bucket_value FROM band b JOIN placed p USING (doc_id)),
dup AS (SELECT DISTINCT g FROM (SELECT g, min(g) OVER (PARTITION BY bucket_idx, bucket_value) AS keeper FROM pband) WHERE g <> keeper),
idx AS (SELECT CAST(src AS INTEGER) AS "group", CAST(item AS INTEGER) AS item_number, bucket_value, CAST(bucket_value & 255 AS INTEGER) AS split FROM pband WHERE g NOT IN (SELECT g FROM dup))"""
_BOTH = f"""WITH both_groups AS (
  SELECT 0 AS grp, row_number() OVER (ORDER BY doc_id) - 1 AS item, text FROM documents
  UNION ALL SELECT 1, row_number() OVER (ORDER BY conv_id, turn) - 1, text FROM conversations),
keyed_docs AS (SELECT grp * 1000000000000 + item AS k, text FROM both_groups),
{oracle.bands(5, CHECKED.num_buckets, "keyed_docs", "k")},
gband AS (SELECT k // 1000000000000 AS grp, k % 1000000000000 AS item, bucket_idx, bucket_value FROM band),
dup AS (SELECT DISTINCT grp, item FROM (SELECT grp, item, min(item) OVER (PARTITION BY grp, bucket_idx, bucket_value) AS keeper FROM gband) WHERE item <> keeper),
entries AS (SELECT * FROM gband WHERE (grp, item) NOT IN (SELECT (grp, item) FROM dup) AND bucket_value & 255 BETWEEN 0 AND 255),
ranked AS (SELECT grp, item, min(grp) OVER w <> max(grp) OVER w AS crosses, row_number() OVER (PARTITION BY bucket_value ORDER BY grp, item) AS up,
  row_number() OVER (PARTITION BY bucket_value ORDER BY grp DESC, item DESC) AS down FROM entries WINDOW w AS (PARTITION BY bucket_value))"""


# A band of one hash is told by the hash: the digest of its eight bytes is a one-to-one mixing.
_REBANDED = f"""WITH {_BANDS},
any_band AS (SELECT {CHECKED.num_buckets} AS num_buckets, doc_id, bucket_idx, bucket_value::VARCHAR AS v FROM band UNION ALL SELECT {CHECKED.total_hashes}, doc_id, seed, hash::VARCHAR FROM signature),
dup AS (SELECT DISTINCT num_buckets, doc_id FROM (SELECT num_buckets, doc_id, min(doc_id) OVER (PARTITION BY num_buckets, bucket_idx, v) AS keeper FROM any_band) WHERE doc_id <> keeper)
SELECT n.num_buckets, d.doc_id, CASE WHEN x.doc_id IS NULL THEN ' ' ELSE 'D' END AS flag FROM documents d, (VALUES ({CHECKED.num_buckets}), ({CHECKED.total_hashes})) n(num_buckets)
LEFT JOIN dup x ON x.doc_id = d.doc_id AND x.num_buckets = n.num_buckets"""
_INCREMENTAL = f"""WITH all_groups AS (
  SELECT CASE WHEN source < '{LATER}' THEN 0 ELSE 1 END AS grp, row_number() OVER (PARTITION BY source < '{LATER}' ORDER BY doc_id) - 1 AS item, text FROM documents
  UNION ALL SELECT 2, row_number() OVER (ORDER BY conv_id, turn) - 1, text FROM conversations),
keyed_docs AS (SELECT grp * 1000000000000 + item AS k, text FROM all_groups),
{oracle.bands(5, CHECKED.num_buckets, "keyed_docs", "k")},
gband AS (SELECT k // 1000000000000 AS grp, k % 1000000000000 AS item, bucket_idx, bucket_value FROM band),
dup AS (SELECT DISTINCT grp, item FROM (SELECT grp, item, min(item) OVER (PARTITION BY grp, bucket_idx, bucket_value) AS keeper FROM gband) WHERE item <> keeper),
entries AS (SELECT *, min(grp) OVER (PARTITION BY bucket_value) AS earliest FROM gband WHERE (grp, item) NOT IN (SELECT (grp, item) FROM dup))
SELECT CAST(grp AS INTEGER) AS group_idx, item AS global_idx, CASE WHEN (grp, item) IN (SELECT (grp, item) FROM dup) OR (grp, item) IN (SELECT (grp, item) FROM entries WHERE earliest < grp) THEN 'D' ELSE ' ' END AS flag FROM all_groups"""


def _merged(rank: str) -> str:
    return f"""{_BOTH}
SELECT CAST(grp AS INTEGER) AS group_idx, item AS global_idx, CASE WHEN (grp, item) IN (SELECT (grp, item) FROM dup) OR (grp, item) IN (SELECT (grp, item) FROM ranked WHERE crosses AND {rank} > 1) THEN 'D' ELSE ' ' END AS flag FROM both_groups"""


_MANIFEST = """SELECT CAST(row_number() OVER (ORDER BY source) - 1 AS INTEGER) AS source_idx, n AS item_count, source AS file_path,
  CAST(coalesce(sum(n) OVER (ORDER BY source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset" FROM (SELECT source, count(*) AS n FROM documents GROUP BY source)"""
_JACCARD = f"""WITH g AS (SELECT DISTINCT doc_id, gram FROM ({oracle.gram_rows(5)})), n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
c AS (SELECT a.doc_id AS doc_a, b.doc_id AS doc_b, count(*) AS both_have FROM g a JOIN g b ON a.gram = b.gram AND a.doc_id < b.doc_id GROUP BY 1, 2),
s AS (SELECT doc_a, doc_b, both_have / (x.n + y.n - both_have) AS similarity FROM c JOIN n x ON x.doc_id = doc_a JOIN n y ON y.doc_id = doc_b
  UNION ALL SELECT a.doc_id, b.doc_id, 1.0 FROM documents a JOIN documents b ON a.doc_id < b.doc_id AND length(a.text) < 5 AND length(b.text) < 5)"""
_CLASS_PAIRS = f"""g AS (SELECT DISTINCT doc_id, gram FROM ({oracle.gram_rows(5, "class_docs")})),
c AS (SELECT a.doc_id AS doc_a, b.doc_id AS doc_b, count(*) AS both_have FROM g a JOIN g b ON a.gram = b.gram AND a.doc_id < b.doc_id GROUP BY 1, 2),
s AS (SELECT doc_a, doc_b, both_have / (x.n + y.n - both_have) AS similarity FROM c JOIN heads x ON x.doc_id = doc_a JOIN heads y ON y.doc_id = doc_b)"""
_CLASSES = f"""WITH sets AS (SELECT d.doc_id, coalesce(grams, []) AS grams FROM documents d LEFT JOIN (SELECT doc_id, list(DISTINCT gram ORDER BY gram) AS grams FROM ({oracle.gram_rows(5)}) GROUP BY doc_id) USING (doc_id)),
heads AS (SELECT min(doc_id) AS doc_id, any_value(len(grams)) AS n FROM sets GROUP BY grams),
class_docs AS (SELECT doc_id, n, text FROM heads JOIN documents USING (doc_id))"""
_DETECTED = f"""{_CLASSES},
{oracle.signatures(5, DETECTING.total_hashes, "class_docs")},
bucket AS (SELECT doc_id, seed // {DETECTING.band_size} AS bucket_idx, list(hash ORDER BY seed) AS v FROM signature GROUP BY 1, 2),
shared AS (SELECT a.doc_id AS doc_a, b.doc_id AS doc_b, count(*) AS n_bands FROM bucket a JOIN bucket b ON a.bucket_idx = b.bucket_idx AND a.v = b.v AND a.doc_id < b.doc_id GROUP BY 1, 2),
{_CLASS_PAIRS},
found AS (SELECT doc_a, doc_b, n_bands, coalesce(similarity, 0.0::DOUBLE) AS similarity FROM shared LEFT JOIN s USING (doc_a, doc_b))"""
_GRAMS = "list_transform(range(1, length(text) - 3), lambda i: substring(text, i, 5))"

ORACLE_SQL: dict[str, str] = {
    "ngram_counts": f"SELECT doc_id, CAST(len(x) AS BIGINT) AS n_grams, CAST(len(list_distinct(x)) AS BIGINT) AS n_distinct, x[1] AS first_gram, x[len(x)] AS last_gram FROM (SELECT doc_id, {_GRAMS} AS x FROM documents)",
    "gram_frequencies": f"SELECT gram, count(*) AS n_docs FROM (SELECT DISTINCT doc_id, gram FROM ({oracle.gram_rows(5)})) GROUP BY gram",
    "minhash_signature": f"WITH {oracle.signatures(5, CHECKED.total_hashes)}\nSELECT doc_id, seed, {oracle.signed('hash')} AS hash FROM signature",
    "band_digests": f"WITH {_BANDS}\nSELECT * FROM band",
    "dedup_forward": _flagged("min"),
    "dedup_reverse": _flagged("max"),
    "dedup_stats": f"{_GROUP}\nSELECT t AS total_documents, d AS duplicate_count, CASE WHEN t > 0 THEN CAST(d AS DOUBLE) / t * 100 END AS duplicate_rate FROM (SELECT count(*) AS t FROM documents), (SELECT count(*) AS d FROM dup)",
    "index_rows": f'{_GROUP}\nSELECT "group", item_number, bucket_value, split FROM idx',
    "index_split_histogram": f"{_GROUP}\nSELECT split, count(*) AS entries FROM idx GROUP BY split",
    "source_manifest": _MANIFEST,
    "src_roundtrip": _MANIFEST,
    "unique_documents": f"{_GROUP}\nSELECT g AS global_idx, doc_id, text FROM placed WHERE g NOT IN (SELECT g FROM dup)",
    "unique_of_source": f"{_GROUP}\nSELECT g AS global_idx, doc_id, text FROM placed WHERE source = '{TARGET}' AND g NOT IN (SELECT g FROM dup)",
    "jaccard_pairs": f"{_JACCARD}\nSELECT * FROM s WHERE similarity >= 0.6",
    "band_pairs": f"{_DETECTED}\nSELECT doc_a, doc_b, n_bands, similarity FROM found",
    "band_detection": f"""{_DETECTED}
SELECT bin, coalesce(n, 0) AS n_candidates, n_similar, expected_rate FROM (SELECT CAST(floor(similarity * 20) AS INTEGER) AS bin, count(*) AS n FROM found GROUP BY 1)
FULL JOIN (SELECT CAST(floor(similarity * 20) AS INTEGER) AS bin, count(*) AS n_similar, round(avg(1 - pow(1 - pow(similarity, {DETECTING.band_size}), {DETECTING.num_buckets})), 6) AS expected_rate
  FROM s WHERE similarity >= 0.6 GROUP BY 1) USING (bin)""",
    "similar_documents": f"""{_CLASSES},
{_CLASS_PAIRS},
links AS (SELECT class_id, count(*) AS n FROM (SELECT unnest([doc_a, doc_b]) AS class_id FROM s WHERE similarity >= 0.6) GROUP BY 1)
SELECT doc_id, class_id, coalesce(n, 0) AS n_links FROM (SELECT doc_id, min(doc_id) OVER (PARTITION BY grams) AS class_id FROM sets) LEFT JOIN links USING (class_id)""",
    "pairwise_similarity": f"{_JACCARD}\nSELECT similarity, 'd' || doc_a AS id_a, 'd' || doc_b AS id_b FROM s WHERE similarity >= 0.8",
    "all_pairs": f"""WITH g AS (SELECT DISTINCT item_id, gram FROM ({oracle.gram_rows(5, "benchmark", "item_id")})), n AS (SELECT item_id, count(*) AS n FROM g GROUP BY item_id),
c AS (SELECT a.item_id AS item_a, b.item_id AS item_b, count(*) AS both_have FROM g a JOIN g b ON a.gram = b.gram AND a.item_id < b.item_id GROUP BY 1, 2)
SELECT a.item_id AS item_a, b.item_id AS item_b, CASE WHEN x.n IS NULL AND y.n IS NULL THEN 1.0 ELSE coalesce(both_have, 0) / (coalesce(x.n, 0) + coalesce(y.n, 0) - coalesce(both_have, 0)) END AS similarity
FROM benchmark a JOIN benchmark b ON a.item_id < b.item_id LEFT JOIN c ON item_a = a.item_id AND item_b = b.item_id LEFT JOIN n x ON x.item_id = a.item_id LEFT JOIN n y ON y.item_id = b.item_id""",
    "pair_lines": f"{_JACCARD}\nSELECT printf('%.6f', similarity) || chr(9) || 'd' || doc_a || chr(9) || 'd' || doc_b AS value FROM s WHERE similarity >= 0.8",
    "dedup_stored": f"{_GROUP}\nSELECT g AS global_idx, CASE WHEN g IN (SELECT g FROM dup) THEN 'D' ELSE ' ' END AS flag FROM placed",
    "index_roundtrip": f'{_GROUP}\nSELECT "group", item_number, bucket_value, split FROM idx WHERE split BETWEEN 16 AND 199',
    "signature_band": f"WITH {oracle.signatures(5, CHECKED.total_hashes)}\nSELECT a.doc_id, {oracle.signed('a.hash')} AS first, {oracle.signed('b.hash')} AS second FROM signature a JOIN signature b ON a.doc_id = b.doc_id AND a.seed = {CHECKED.band_size} AND b.seed = {CHECKED.band_size + 1}",
    "unique_lines": f"{_GROUP}\nSELECT doc_id, text FROM placed WHERE g NOT IN (SELECT g FROM dup)",
    "merge_by_band": _merged("up").replace("PARTITION BY bucket_value", "PARTITION BY bucket_idx, bucket_value"),
    "merge_split_range": _merged("up").replace("BETWEEN 0 AND 255", "BETWEEN 64 AND 191"),
    "merge_composed": _merged("up"),
    "dedup_stream": _flagged("min"),
    "bucket_ranks": f"WITH {_BANDS}\nSELECT doc_id, bucket_idx, bucket_value, row_number() OVER (PARTITION BY bucket_idx, bucket_value ORDER BY doc_id) AS rank FROM band",
    "merged_flag_files": _merged("up"),
    "index_files": f'{_GROUP}\nSELECT "group", item_number, bucket_value, split FROM idx',
    "rebanded_flags": _REBANDED,
    "merge_stored": _merged("up").replace("BETWEEN 0 AND 255", "BETWEEN 64 AND 191"),
    "dedup_incremental": _INCREMENTAL,
    "merge_forward": _merged("up"),
    "merge_reverse": _merged("down"),
    "merge_cross": f"{_BOTH}\nSELECT count(*) AS cross_duplicates FROM ranked WHERE crosses AND up > 1",
    "short_documents": "SELECT doc_id, doc_id <> min(doc_id) OVER () AS duplicate FROM documents WHERE length(text) < 5",
    "jsonl_roundtrip": "SELECT doc_id, text, CAST(length(text) AS BIGINT) AS n_chars FROM documents",
}
