"""Security review of source files, by language: rows (rule, title, severity, location "path:line")."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyweave.functions import scalars as S
from tallyweave.operators import textscan as X

LOOK_AHEAD = 6


def _found(rows: DataFrame, rule: str, title: str, severity: str) -> DataFrame:
    return rows.select(F.lit(rule).alias("rule"), F.lit(title).alias("title"), F.lit(severity).alias("severity"), F.concat_ws(":", "path", "line_no").alias("location"))


def _first(rows: DataFrame) -> DataFrame:
    return rows.groupBy("path").agg(F.min("line_no").alias("line_no"))


def security_findings(files: DataFrame, *, skip_comments: tuple[str, ...] = ("sql", "javascript")) -> DataFrame:
    """Findings in files (path, language, content); lines that are comments are skipped in the given languages.

    In C#: connection strings, secrets and disabled certificate checks line by line, and the first command whose text
    is concatenated within a few lines. In SQL and JavaScript the first line of each kind.
    """
    lines = X.lines(files.withColumn("content", F.replace("content", F.lit("\r\n"), F.lit("\n"))), "content", "path", "language")
    code = lines.where(X.not_comment() | ~F.col("language").isin(*skip_comments)) if skip_comments else lines
    of = lambda language: code.where(F.col("language") == language)
    has = lambda p: F.col("line").rlike(S.ascii_words(p))
    w = Window.partitionBy("path").orderBy("line_no").rangeBetween(0, LOOK_AHEAD - 1)
    built = of("csharp").withColumn("joined", F.max(has(X.CONCATENATION).cast("int")).over(w) == 1).where(has(X.COMMAND) & F.col("joined"))
    parts = [
        _found(of("csharp").where(has(X.CONNECTION_LITERAL)), "hardcoded-credentials", "Connection string in a literal", "CAT II"),
        _found(of("csharp").where(has(X.EMBEDDED_SECRET)), "hardcoded-credentials", "Secret in a literal", "CAT I"),
        _found(of("csharp").where(has(X.CERTIFICATE_BYPASS)), "certificate-validation", "Certificates are not validated", "CAT II"),
        _found(_first(built), "sql-injection", "Command text is concatenated", "CAT I"),
        _found(_first(of("sql").where(has(X.BLOB_PARSING))), "input-validation", "A delimited text is parsed without checks", "CAT II"),
        _found(_first(of("sql").where(has(X.DYNAMIC_SQL))), "sql-injection", "SQL is executed from a built string", "CAT I"),
        _found(_first(of("javascript").where(has(X.HTML_BUILDING))), "output-encoding", "HTML is built from strings", "CAT II"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def in_scope(location: Column, extension: str = ".cs") -> Column:
    """Whether the file of a location, without its line, has the extension."""
    return F.lower(F.regexp_replace(location, r":\d+$", "")).endswith(extension)


def reconcile(before: DataFrame, after: DataFrame) -> DataFrame:
    """Findings before with their disposition; only rules that still fire in C# files after count as residual."""
    out = X.dispositions(before, after.where(in_scope(F.col("location"))), "rule", in_scope(F.col("location")))
    gone = F.col("disposition") == "Remediated"
    return out.withColumn("location", F.when(gone, "(remediated)").otherwise(F.col("location"))).orderBy("rule", "location")


def accepted(files: DataFrame) -> DataFrame:
    """Rows (language, total, parsed, rate): files in which a heuristic parse finds what their language must have."""
    text = F.col("content")
    ok = (
        F.when(F.col("language") == "javascript", S.braces_balanced(text) & text.rlike(X.SCRIPT_FUNCTION))
        .when(F.col("language") == "sql", text.rlike(X.SQL_PROCEDURE) | text.rlike(X.SQL_TABLE) | text.rlike(S.ascii_words(r"(?i)\b(INSERT|SELECT|UPDATE|DELETE|MERGE)\b")))
        .when(F.col("language") == "vb6", text.rlike("(?i)Attribute VB_Name|Option Explicit") & text.rlike(X.BASIC_PROCEDURE))
        .otherwise(S.braces_balanced(text))
    )
    got = files.groupBy("language").agg(F.count("*").alias("total"), F.sum(F.coalesce(ok, F.lit(False)).cast("bigint")).alias("parsed"))
    return got.withColumn("rate", F.when(F.col("total") > 0, F.col("parsed") / F.col("total")).otherwise(0.0))


def declared(files: DataFrame) -> DataFrame:
    """Rows (path, language, line_no, symbol): declarations by the language's pattern, brackets stripped."""
    by = {"javascript": (X.SCRIPT_FUNCTION,), "sql": (X.SQL_PROCEDURE, X.SQL_TABLE), "vb6": (X.BASIC_PROCEDURE,)}
    lines = X.lines(files, "content", "path", "language")
    found = [F.when(F.col("language") == k, F.regexp_extract_all("line", F.lit(p), F.lit(1))).otherwise(F.array().cast("array<string>")) for k, ps in by.items() for p in ps]
    return lines.select("path", "language", "line_no", F.explode(F.concat(*found)).alias("s")).select("path", "language", "line_no", F.translate("s", "[]", "").alias("symbol"))
