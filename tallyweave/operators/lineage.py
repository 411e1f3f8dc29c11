"""Cutting the lineage of iterative operators, and numbering rows in a global order."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _shared(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names; only a session with a local master gets one of its own."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = f"file://{tempfile.mkdtemp(prefix='shared-')}"
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def file_at(spark: SparkSession, path: str):
    """Hadoop's file system of a path, and the path as its object."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def create_once(spark: SparkSession, path: str, content: bytes) -> bool:
    """A file with this content where none is yet; False where there is one, which stays as it is.

    It appears whole, by a rename that refuses to overwrite; the file system must have one (HDFS and local ones do).
    """
    jvm = spark.sparkContext._jvm
    fs, draft = file_at(spark, f"{path}.{uuid.uuid4().hex}.draft")
    out = fs.create(draft, False)
    out.write(content)
    out.close()
    _, final = file_at(spark, path)
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(final.toUri(), spark.sparkContext._jsc.hadoopConfiguration())
    try:
        context.rename(fs.makeQualified(draft), fs.makeQualified(final), spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0))
        return True
    except Exception:
        fs.delete(draft, False)
        if fs.exists(final):
            return False
        raise


def folder(spark: SparkSession, kind: str) -> str:
    """A new path in the folder that driver and executors share, which goes when the session's JVM ends."""
    path = f"{_shared(spark)}/{kind}-{uuid.uuid4().hex}"
    fs, where = file_at(spark, path)
    fs.mkdirs(where)
    fs.deleteOnExit(where)
    return path


def cut(df: DataFrame, *gone: DataFrame) -> DataFrame:
    """The rows written to the shared folder and read again, so that a lost executor costs no more than a step.

    ``gone`` are earlier cuts that nothing reads any more; their files are deleted once the new ones are written.
    """
    path = folder(df.sparkSession, "cut")
    df.write.mode("overwrite").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._cut_path = path
    drop(*gone)
    return out


def drop(*gone: DataFrame) -> None:
    for df in gone:
        path = getattr(df, "_cut_path", None)
        if path:
            fs, where = file_at(df.sparkSession, path)
            fs.delete(where, True)


#: Rows of a partition, about, where a step sorts or gathers whole partitions.
PART_ROWS = 1_000_000


def dealt(n_rows: int, *sides: tuple[DataFrame, str | tuple[str, ...]]) -> list[DataFrame]:
    """Each side dealt by its keys to the same number of partitions, which grows with the rows, so a task's memory does not."""
    n = 1
    for df, _ in sides:
        n = max(n, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n_rows // PART_ROWS))
    return [df.repartition(n, *([keys] if isinstance(keys, str) else keys)) for df, keys in sides]


def numbered(rows: DataFrame, *order: Column | str, name: str = "position") -> DataFrame:
    """The rows with their place, from 1, in a global order that no two rows share.

    One range-partitioned sort; rows are numbered within their partitions, and each partition's number of rows moves those
    behind it. The order must decide between all rows; null comes first.
    """
    place = F.monotonically_increasing_id()  # partition and place in it, as the sorted rows are written
    placed = cut(rows.orderBy(*order).withColumn("__at", place))
    part = F.shiftright("__at", 33)
    sizes = sorted((r["part"], r["n"]) for r in placed.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect())  # one row for each partition
    before, listed = 0, []
    for p, n in sizes:
        listed.append((p, before))
        before += n
    offsets = F.broadcast(rows.sparkSession.createDataFrame(listed, "__part long, __before long"))
    inside = F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))
    return placed.join(offsets, part == F.col("__part")).withColumn(name, F.col("__before") + inside + 1).drop("__at", "__part", "__before")
