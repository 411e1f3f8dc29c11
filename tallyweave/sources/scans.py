"""Scans and sinks beside the driver tables: whole texts, tolerant JSON, blobs of points, upserts, guarded writes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyweave.functions import scalars as S
from tallyweave.operators import lineage

# Languages by file extension.
LANGUAGES = {"cs": "csharp", "js": "javascript", "sql": "sql", "bas": "vb6", "java": "java", "cob": "cobol", "cbl": "cobol", "f90": "fortran", "f": "fortran", "adb": "ada", "ads": "ada"}

RESULT = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("leg_dist", T.ArrayType(T.DoubleType())),
        T.StructField("total", T.DoubleType()),
        T.StructField("valid", T.BooleanType()),
        T.StructField("est", T.LongType()),
        T.StructField("feasible", T.BooleanType()),
        T.StructField("go", T.BooleanType()),
        T.StructField("messages", T.ArrayType(T.StringType())),
    ]
)
REQUEST = "struct<id: string, party: string, class: string, launch: bigint, desired: bigint, points: array<struct<lat: double, lon: double>>>"


def language_of(path: Column) -> Column:
    pairs = [F.lit(x) for k, v in LANGUAGES.items() for x in (k, v)]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), S.file_extension(path)), F.lit("unknown"))


def source_files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """Whole files below a path: path, language, content and its SHA-256."""
    read = spark.read.text(path, wholetext=True, recursiveFileLookup=True, pathGlobFilter=glob)
    out = read.select(F.input_file_name().alias("path"), F.col("value").alias("content"))
    return out.select("path", language_of(F.col("path")).alias("language"), "content", S.sha256(F.col("content")).alias("content_sha256"))


def source_texts(spark: SparkSession, texts: dict[str, str]) -> DataFrame:
    rows = spark.createDataFrame(list(texts.items()), "path string, content string")
    return rows.select("path", language_of(F.col("path")).alias("language"), "content", S.sha256(F.col("content")).alias("content_sha256"))


def vectors(spark: SparkSession, path: str, *, lines: bool = False) -> DataFrame:
    """A corpus of test vectors from JSON arrays (or lines): input, reference and baseline output, label, all in one row."""
    schema = f"id string, tags array<string>, input {REQUEST}, reference_output string, baseline_output string, expected_divergent boolean"
    return spark.read.schema(schema).json(path, multiLine=not lines)


def with_labels(vectors: DataFrame, labels: DataFrame, key: str) -> DataFrame:
    """Vectors with their labels, matched by key, never by place; an error where either side lacks a row of the other."""
    one, two = vectors.withColumn("__left", F.lit(True)), labels.withColumn("__right", F.lit(True))
    both = one.join(two, key, "full")
    alone = F.col("__left").isNull() | F.col("__right").isNull()
    checked = F.when(alone, F.raise_error(F.concat(F.lit("no partner of "), F.col(key).cast("string"))).cast("boolean")).otherwise(F.lit(True))
    return both.where(checked).drop("__left", "__right")


def tolerant_result(json: Column) -> Column:
    """A result struct from JSON text: missing or mistyped fields take their defaults; ``parsed`` tells bad JSON apart."""
    raw = F.from_json(json, RESULT)
    ok = F.coalesce(F.get_json_object(json, "$").startswith("{"), F.lit(False))
    default = {"id": F.lit(""), "leg_dist": F.array().cast("array<double>"), "total": F.lit(0.0), "valid": F.lit(False), "est": F.lit(0).cast("bigint"), "feasible": F.lit(False), "go": F.lit(False), "messages": F.array().cast("array<string>")}
    return F.struct(*[F.coalesce(raw[k], v).alias(k) for k, v in default.items()], ok.alias("parsed"))


def array_length(json: Column, path: str) -> Column:
    """The length of a JSON array at a path; 0 for anything else."""
    return F.coalesce(F.json_array_length(F.get_json_object(json, path)), F.lit(0))


def points_of_blob(rows: DataFrame, key: str, blob: str) -> DataFrame:
    """Rows (key, seq, lat, lon) of a text of points, ``;`` between points and ``,`` within; what is no number is null."""
    each = rows.select(key, F.posexplode(F.split(F.col(blob), ";")).alias("seq", "p")).where(F.trim("p") != "")
    part = lambda i: F.get(F.split("p", ","), F.lit(i)).try_cast("double")
    return each.select(key, "seq", part(0).alias("lat"), part(1).alias("lon"))


def upsert(target: DataFrame, source: DataFrame, *keys: str) -> DataFrame:
    """The target with the source's rows in place of those of the same key, and its new rows. Keys that the source repeats are refused."""
    new = lineage.cut(source.select(*target.columns))  # read three times, made once
    new, old = lineage.dealt(new.count() + target.count(), (new, keys), (target, keys))
    twice = new.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1").limit(1).collect()
    if twice:
        raise ValueError(f"the source repeats the key {tuple(twice[0][k] for k in keys)}")
    return new.unionByName(old.join(new.select(*keys), list(keys), "left_anti").select(*target.columns))


def orphans(child: DataFrame, parent: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    """Child rows whose parent is missing."""
    return child.join(parent.select(F.col(parent_key).alias(child_key)), child_key, "left_anti")


def guarded(base: str, path: str) -> str:
    """A path below a base folder; one that leaves it is refused."""
    parts = [p for p in path.split("/") if p not in ("", ".")]
    if path.startswith("/") or "://" in path or ".." in parts:
        raise ValueError(f"{path} leaves {base}")
    return "/".join([base.rstrip("/"), *parts])


def write_below(df: DataFrame, base: str, path: str, fmt: str = "json") -> str:
    """Write below a base folder only."""
    where = guarded(base, path)
    df.write.mode("errorifexists").format(fmt).save(where)
    return where


def attach_recorded(tasks: DataFrame, recorded: DataFrame, *, missing: str = "error") -> DataFrame:
    """Tasks with their recorded result, by the hash of unit, language and stack (columns of both).

    ``missing``: "error" raises for a task without one, "null" leaves it null.
    """
    key = S.sha256(F.concat_ws("|", "unit", "language", "stack"))
    out = tasks.withColumn("record_key", key).join(recorded.select(F.col("key").alias("record_key"), "result"), "record_key", "left")
    if missing == "error":
        out = out.withColumn("result", F.coalesce("result", F.raise_error(F.concat(F.lit("no record of "), F.col("record_key"))).cast("string")))
    return out
