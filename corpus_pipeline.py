"""A training-data pipeline over ``documents``: STAGES in order, each written as Parquet and read again.

Language ID drops documents without a language or with a doubtful one; quality rules drop what fails them; of near
duplicates one document stays; sources are mixed to target weights by replication; the last stage tokenises. Every row is
judged by itself, whether its id is null or shared with others.

Null texts and texts without words go in the first stages. An empty table gives an empty table with the same columns.
Texts are judged whole, however long. Columns of the input besides the five of DOC_COLUMNS are not carried, so no name
can clash. Of rows that repeat each other one stays. Each stage's input must be a written table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyweave.llm import bpe, common, fertility, langid, mixing, queries, shinglejoin

DOC_COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Documents whose language has a lower score go.
MIN_LANGUAGE_SCORE = 0.5
#: Near duplicates: words of a shingle, and the similarity in percent.
SHINGLE_WORDS, SIMILARITY = 5, 80
#: Rejected rows and groups up to this number (8 MB a column) are told to all tasks; more are joined by a shuffle.
MAX_BROADCAST_ROWS = 1_000_000
#: Files of a stage's input whose paths are told to all tasks (some 20 MB); the paths of more are joined by a shuffle.
MAX_BROADCAST_FILES = 100_000


def _numbered(docs: DataFrame) -> DataFrame:
    """The documents with a ``row`` number, so that verdicts meet the rows that they were passed on.

    A row's number is that of its file, in order of the paths, and its place in the file, as the Parquet reader gives it:
    every read gives the same, whatever the splits and however many cores there are at the time. The files are those of
    which the driver holds the list anyway. An input that is not read from files is refused.
    """
    if not docs.inputFiles():
        raise ValueError("a stage reads documents that are written")
    at = docs.metadataColumn("_metadata")
    placed = docs.select(*DOC_COLUMNS, at["file_path"].alias("file"), at["row_index"].alias("place"))
    paths = sorted(r["file"] for r in placed.select("file").distinct().collect())
    files, _ = common.written(docs.sparkSession.createDataFrame(list(enumerate(paths)), "nr long, file string"), "files")
    files = F.broadcast(files) if len(paths) <= MAX_BROADCAST_FILES else files
    return placed.join(files, "file").select(*DOC_COLUMNS, (F.col("nr") * (1 << 40) + F.col("place")).alias("row"))


def _keep(rows: DataFrame, verdicts: DataFrame) -> DataFrame:
    """The rows without those that ``verdicts`` (row, kept) reject."""
    rejected, _ = common.written(verdicts.where("not kept").select(F.col("row").alias("rejected")), "rejected")
    rejected = F.broadcast(rejected) if rejected.count() <= MAX_BROADCAST_ROWS else rejected
    kept = rows.join(rejected, F.col("row") == F.col("rejected"), "left_anti").select(*DOC_COLUMNS)
    return common.compacted(kept)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows = _numbered(docs)
    found = langid.identify(rows, langid.train(docs), key="row")
    return _keep(rows, found.select("row", ((F.col("lang_pred") != "und") & (F.col("score") >= MIN_LANGUAGE_SCORE)).alias("kept")))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows = _numbered(docs)
    return _keep(rows, fertility.quality(rows, queries.FERTILITY, key="row").select("row", "kept"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of a group of linked rows one stays: that with the smallest id (null ids last), of rows that share it the first."""
    rows = _numbered(docs)
    found = shinglejoin.shingle_components(rows, key="row", width=SHINGLE_WORDS, percent=SIMILARITY)
    placed, _ = common.written(found.select("row", "component_id").join(rows.select("row", "doc_id"), "row"), "places")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row")).alias("first")
    groups = placed.groupBy("component_id").agg(F.count("*").alias("k"), first).where("k > 1").select("component_id", "first")
    groups, _ = common.written(groups, "groups")
    groups = F.broadcast(groups) if groups.count() <= MAX_BROADCAST_ROWS else groups
    return _keep(rows, placed.join(groups, "component_id").select("row", (F.col("row") == F.col("first.row")).alias("kept")))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return common.compacted(mixing.mix(docs.select(*DOC_COLUMNS), keep_draw=False))


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return common.compacted(bpe.encode(docs, queries.BYTE_BPE, carry=["doc_id", "lang", "source", "n_chars"]))


STAGES = [
    ("language_id", language_id),
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("mix_sources", mix_sources),
    ("tokenise", tokenise),
]
#: Language models, vocabularies and components are beyond SQL; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs, path = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for _, stage in STAGES:
        out, new = common.written(stage(spark, docs, sf_dir), "stage")
        if path:
            common.drop(spark, path)
        docs, path = out, new
    return docs
