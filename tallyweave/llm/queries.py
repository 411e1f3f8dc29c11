"""The queries of this folder, one for each operator, with DuckDB SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyweave.llm import bpe, common, compaction, fertility, htmltext, infill, langid, licences, mixing, neighbours, ranking, shinglejoin, vectordedup, warc


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of all vectors: cosine 0.93 or more within a label. Kept: the smallest id of a component."""
    found = vectordedup.near_vectors(_read(spark, sf_dir, "embeddings"), least=0.93)
    return found.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


#: Every machine has the public vocabularies at the same place.
BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
#: Piece model, byte ranks and the byte vocabulary's pattern.
FERTILITY = (public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op2_tokenizer_fertility(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures and verdict of every document, whole texts; ``reasons`` names the measures outside their bands."""
    return fertility.quality(_read(spark, sf_dir, "documents"), FERTILITY).drop("lang")


def op3_compacted_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sixteen arrivals, compacted; what the last version holds, with digests of the texts.

    An error where compaction leaves a run of one tier, or where its version holds other rows than the one before.
    """
    store = compaction.Store(spark, common.scratch(spark, "store"))
    docs = compaction.arrivals_of(_read(spark, sf_dir, "documents"))
    store.append_batches(docs, F.col("arrival"))
    before, after = store.manifest(), store.compact()
    # a sum over all columns: neither changed texts nor pairs of equal rows can go unseen
    rows = lambda v: store.read(v).agg(F.count("*"), F.sum(F.xxhash64(*docs.columns).cast("decimal(38,0)"))).first()
    if compaction.plan_bins(after.shards) or rows(before.version) != rows(after.version):
        raise RuntimeError("compaction left a run of shards, or changed rows")
    store.vacuum()
    sized = store.read().withColumn("n_bytes", F.octet_length("text").cast("long")).withColumn("text_sha256", F.sha2(F.encode("text", "UTF-8"), 256))
    return sized.select("doc_id", "arrival", "n_bytes", "text_sha256", "lang", "source", "n_chars")


def op4_language_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of all documents, learned from those that are not held out."""
    docs = _read(spark, sf_dir, "documents")
    out = F.coalesce(langid.held_out(F.col("doc_id")), F.lit(False))
    found = langid.identify(docs, langid.train(docs.where(~out)))
    return found.select("doc_id", out.alias("held_out"), "lang_pred", "score", F.size("spans").alias("n_spans"))


#: The pages have no date of their own; their records carry this one.
CAPTURED = "2024-01-01T00:00:00Z"


def op5_warc_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written as an archive, read back record by record, and what the records say of each capture."""
    path = common.scratch(spark, "archive")
    warc.write_archive(_read(spark, sf_dir, "pages"), path, min_bytes=0, date=CAPTURED)
    found = warc.captures(warc.parse(warc.restore(spark, path)))
    common.drop(spark, path)
    return found.select(F.col("page_id").cast("long"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast("long"))


def op6_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded: number of tokens, digests of ids and of the decoded text."""
    return bpe.round_trip(_read(spark, sf_dir, "documents"), BYTE_BPE)


def op7_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return htmltext.extract(_read(spark, sf_dir, "pages"))


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best licence template of every place in every document that one matches."""
    return licences.scan(_read(spark, sf_dir, "documents"))


def op9_shingle_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose sets of 3-word shingles have a Jaccard coefficient of 0.9 or more, as components."""
    return shinglejoin.shingle_components(_read(spark, sf_dir, "documents"), width=3, percent=90)


def op10_poisson_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents replicated to weights tempered by the square root of their sources' sizes, in shuffled order."""
    return mixing.mix(_read(spark, sf_dir, "documents"))


def op11_threshold_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best of all documents for every benchmark item."""
    return ranking.rank(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op12_nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest of all vectors for every vector whose id is divisible by 20 (the stated set of queries)."""
    vectors = _read(spark, sf_dir, "embeddings")
    return neighbours.nearest(vectors, vectors.where("vec_id % 20 = 0"))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents cut and put together for filling in the middle; digests of the outputs and of the texts rebuilt from them."""
    made = infill.fill_in_middle(_read(spark, sf_dir, "documents"))
    sha = lambda c: F.sha2(F.encode(c, "UTF-8"), 256)
    digests = (sha(F.col("output")).alias("output_sha256"), sha(infill.restored(F.col("output"), F.col("form"))).alias("restored_sha256"))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", *digests)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_vector_dedup": op1_vector_dedup,
        "op2_tokenizer_fertility": op2_tokenizer_fertility,
        "op3_compacted_shards": op3_compacted_shards,
        "op4_language_spans": op4_language_spans,
        "op5_warc_archive": op5_warc_archive,
        "op6_bpe_round_trip": op6_bpe_round_trip,
        "op7_main_text": op7_main_text,
        "op8_license_scan": op8_license_scan,
        "op9_shingle_join": op9_shingle_join,
        "op10_poisson_mix": op10_poisson_mix,
        "op11_threshold_search": op11_threshold_search,
        "op12_nearest_vectors": op12_nearest_vectors,
        "op13_fill_in_middle": op13_fill_in_middle,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op3_compacted_shards": compaction.ORACLE_SQL,
        "op5_warc_archive": warc.ORACLE_SQL,
        "op8_license_scan": licences.oracle_sql(),
        "op10_poisson_mix": mixing.ORACLE_SQL,
        "op11_threshold_search": ranking.ORACLE_SQL,
        "op13_fill_in_middle": infill.ORACLE_SQL,
    }
