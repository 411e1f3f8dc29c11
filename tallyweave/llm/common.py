"""Shared folder, written intermediates and connected components for the operators of this folder."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


_KEPT: dict[str, Callable[[], None]] = {}


def keep_only(owner: str, forget: Callable[[], None]) -> None:
    """Called in a Python worker by the operator that keeps something between tasks; what others keep there goes.

    Workers outlive stages, and the words that one operator has seen are of no use to the next.
    """
    others = [k for k in _KEPT if k != owner]
    for other in others:
        _KEPT.pop(other)()
    _KEPT[owner] = forget
    if others:
        gc.collect()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # where the C library has it: give freed pages back
        if trim:
            trim(0)


def decoded(column: pa.Array) -> Iterator[str | None]:
    """The texts of a string column one at a time; bytes that are no UTF-8 become U+FFFD."""
    for value in column.cast(pa.binary()):
        raw = value.as_py()
        yield None if raw is None else raw.decode("utf-8", "replace")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the session's ``spark.checkpoint.dir`` names it.

    Where the setting is absent, a session with a local master gets a temporary folder (tests); any other master is
    refused, because a machine-local folder would not be seen by other machines.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    spark.conf.set("spark.checkpoint.dir", f"file://{tempfile.mkdtemp(prefix='shared-')}")
    return spark.conf.get("spark.checkpoint.dir")


def file_system(spark: SparkSession, path: str):
    """Hadoop's file system of a path, and the path as Hadoop's object."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    where = jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(conf), where


def scratch(spark: SparkSession, kind: str) -> str:
    """A new path in the shared folder; it is deleted when the session's JVM ends, if ``drop`` has not done so."""
    path = f"{shared_dir(spark)}/{kind}-{uuid.uuid4().hex}"
    fs, where = file_system(spark, path)
    fs.mkdirs(where.getParent())
    fs.deleteOnExit(where)
    return path


def drop(spark: SparkSession, *paths: str) -> None:
    for path in paths:
        fs, where = file_system(spark, path)
        fs.delete(where, True)


#: Partitions are put together until this much input stands behind each of them.
SPLIT_BYTES = 16 << 20


def compacted(df: DataFrame) -> DataFrame:
    """The same rows in fewer partitions where these would be tiny, so that a write makes no swarm of small files.

    At least two partitions stay for each core, and one for every ``SPLIT_BYTES`` of the tables that are read; nothing
    is shuffled. On large inputs there are more splits of more bytes than that, and nothing changes.
    """
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    size = sum(int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))
    return df.coalesce(min(max(2 * df.sparkSession.sparkContext.defaultParallelism, -(-size // SPLIT_BYTES)), (1 << 31) - 1))


def written(df: DataFrame, kind: str) -> tuple[DataFrame, str]:
    """Cut the lineage: write to the shared folder and read again. Survives the loss of any executor."""
    spark, path = df.sparkSession, scratch(df.sparkSession, kind)
    compacted(df).write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def connected_components(edges: DataFrame) -> tuple[DataFrame, str]:
    """Components of an undirected graph given as rows (a, b) of comparable ids.

    Alternates the large-star and small-star rewirings until the edges are stars around each component's smallest id.
    Every step is a partial aggregate, which is written, plus an equi-join of two plain tables, so that the rows of a
    hub with very many neighbours are dealt to several tasks by adaptive execution. Every round is written to the
    shared folder. Returns (node, component) for the nodes that occur in an edge, and the path that holds it.
    Self-loops and repeated edges have no effect.
    """
    spark = edges.sparkSession
    stars = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    stars, path = written(stars, "edges")
    while True:
        # done when every node has one parent at most, and no parent has one
        ends = stars.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down"))
        ends = ends.unionByName(stars.select(F.col("b").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
        per_node = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
        if not per_node.where("up > 1 or up = 1 and down = 1").limit(1).count():
            break
        both = stars.unionByName(stars.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least, least_path = written(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), "least")
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large, large_path = written(large, "edges")
        lower, lower_path = written(large.groupBy("a").agg(F.min("b").alias("m")), "least")
        small = large.join(lower, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))
        new, new_path = written(small.distinct(), "edges")
        drop(spark, path, least_path, large_path, lower_path)
        stars, path = new, new_path
    nodes = stars.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return nodes.unionByName(stars.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()), path
