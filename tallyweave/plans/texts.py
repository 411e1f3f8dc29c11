"""Queries over texts and JSON: catalogues, scanners, findings, matching, tolerant reads, upserts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyweave.functions import scalars as S
from tallyweave.operators import differential as D
from tallyweave.operators import lineage
from tallyweave.operators import matching as M
from tallyweave.operators import textscan as X
from tallyweave.sources import exchange, scans
from tallyweave.sources.tables import table

#: Pages whose markup builds or runs script.
SCRIPTED = r"<script|innerHTML|\.html\("
CALL = r"([A-Za-z_$][A-Za-z0-9_$]*)\s*\("


def doc_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", S.sha256(F.col("text")).alias("content_sha256"), S.line_count(F.col("text")).alias("n_lines"), F.length("text").alias("n_code_points"))


def accept_rate_by_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of pages whose braces balance and that hold a call, by the page's language."""
    pages = table(spark, sf_dir, "pages").withColumn("lang", F.regexp_extract("html", r'<html lang="([a-z]+)"', 1))
    ok = S.braces_balanced(F.col("html")) & F.col("html").rlike(CALL)
    got = pages.groupBy("lang").agg(F.count("*").alias("total"), F.sum(F.coalesce(ok, F.lit(False)).cast("bigint")).alias("parsed"))
    return got.select("lang", "total", "parsed", F.when(F.col("total") > 0, F.col("parsed") / F.col("total")).otherwise(0.0).alias("rate"))


def keyword_complexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return pages.select("page_id", S.keyword_complexity(F.col("html"), X.KEYWORDS_SCRIPT).alias("complexity"), S.line_count(F.col("html")).alias("loc"))


def page_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.symbols(table(spark, sf_dir, "pages"), "html", "page_id", CALL).distinct()


def _findings(spark: SparkSession, sf_dir: str, patterns: tuple[X.Pattern, ...]) -> DataFrame:
    found = X.findings(table(spark, sf_dir, "documents"), "text", "doc_id", patterns, skip_comments=True)
    return X.highest_per_place(found, "doc_id").select("doc_id", "line_no", "name", "family", "severity", "weak", "quantum_vulnerable")


_SECRETS = (*X.SECRETS, X.ASSIGNED_SECRET)


def secret_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _findings(spark, sf_dir, _SECRETS)


def algo_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _findings(spark, sf_dir, X.ALGORITHMS)


def html_findings_first_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.first_lines(table(spark, sf_dir, "pages"), "html", "page_id", SCRIPTED)


def finding_disposition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings in documents by what the benchmark items still hold; documents in English or German are in scope."""
    docs = table(spark, sf_dir, "documents")
    before = X.highest_per_place(X.findings(docs, "text", "doc_id", (*_SECRETS, *X.ALGORITHMS), skip_comments=True, keep=("lang",)), "doc_id")
    after = X.findings(table(spark, sf_dir, "benchmark"), "text", "item_id", (*_SECRETS, *X.ALGORITHMS), skip_comments=True)
    out = X.dispositions(before, after, "name", F.col("lang").isin("en", "de"))
    return out.select("doc_id", "line_no", "name", "severity", "disposition")


def _rules() -> list[X.Rule]:
    has = lambda p: F.col("text").rlike(p)
    return [
        X.Rule("licence-notice", "Constraint", "The text names the licence that it is under.", 0.93, has("(?i)licensed under|under the [A-Z]+ license")),
        X.Rule("all-rights-reserved", "Constraint", "All rights are reserved.", 0.92, has("(?i)all rights reserved")),
        X.Rule("contact-address", "Validation", "The text holds an address of electronic mail.", 0.88, has(r"[A-Za-z0-9._-]+@[A-Za-z0-9-]+\.[A-Za-z]+")),
        X.Rule("numeric-limit", "Calculation", "The text states a number with decimals.", 0.80, has(r"[0-9]+\.[0-9]+")),
        X.Rule("long-lines", "Routing", "The text has many lines.", 0.85, F.size(F.split("text", "\n")) > 20),
    ]


def rule_recognition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.recognise(table(spark, sf_dir, "documents"), "doc_id", _rules()).select("doc_id", "rule", "category", "confidence")


def _toks(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Benchmark items and documents with keywords; the category is the order of magnitude of the keyword set."""
    out = []
    for name, key in (("benchmark", "item_id"), ("documents", "doc_id")):
        toks = M.with_tokens(table(spark, sf_dir, name), key, "text", F.lit(""))
        out.append(toks.withColumn("category", F.when(F.size("toks") < 20, "short").when(F.size("toks") < 40, "medium").otherwise("long")))
    return out[0], out[1]


def keyword_jaccard_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    gold, found = _toks(spark, sf_dir)
    return M.similar_pairs(gold, found, "category").select("category", "l_id", "r_id", "shared", "jaccard")


def greedy_match_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    gold, found = map(lineage.cut, _toks(spark, sf_dir))  # read twice, made once
    matches = M.greedy_match(M.similar_pairs(gold, found, "category"), "category")
    return M.match_score(matches, gold, found, "category")


def label_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity as a detector of low quality, with both conventions for empty ratios."""
    labels = table(spark, sf_dir, "labels")
    args = (F.col("toxic") == 1, F.col("quality") == 0)
    full, none = D.confusion(labels, *args, 1.0), D.confusion(labels, *args, 0.0)
    tag = lambda d, v: d.withColumn("vacuous", F.lit(v))
    return tag(full, 1.0).unionByName(tag(none, 0.0))


def tolerant_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Properties of events, every tenth text cut short: whether it parses, and a number with its default."""
    events = table(spark, sf_dir, "events")
    text = F.when(F.pmod("event_id", F.lit(10)) == 0, F.substring("props", 1, 3)).otherwise(F.col("props"))
    result = scans.tolerant_result(F.replace(text, F.lit('"k"'), F.lit('"est"')))
    listed = F.concat(F.lit('{"a":{"l":['), F.array_join(F.transform(F.sequence(F.lit(1), F.pmod("user_id", F.lit(4)) + 1), lambda i: i.cast("string")), ","), F.lit("]}}"))
    return events.select("event_id", result["parsed"].alias("parsed"), result["est"].alias("k"), result["valid"].alias("valid"), scans.array_length(listed, "$.a.l").alias("n"))


def recorded_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as tasks: recorded results by the hash of unit, language and stack; those of the last regions were not recorded."""
    tasks = table(spark, sf_dir, "nation").select(F.col("n_name").alias("unit"), F.lit("cs").alias("language"), F.col("n_regionkey").cast("string").alias("stack"))
    key = S.sha256(F.concat_ws("|", "unit", "language", "stack"))
    recorded = tasks.where("stack < 3").select(key.alias("key"), F.concat(F.lit("result of "), "unit").alias("result"))
    return scans.attach_recorded(tasks, recorded, missing="null").select("unit", "record_key", "result")


def lines_of_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The line of the middle of every document, of a place before its start and of one behind its end."""
    docs = table(spark, sf_dir, "documents")
    line = lambda offset: S.line_of(F.col("text"), offset)
    return docs.select("doc_id", line(F.floor(F.length("text") / 2).cast("int")).alias("middle"), line(F.lit(-5)).alias("first"), line(F.length("text") + 9).alias("last"))


def written_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of the parts written as files below a folder and scanned again, whole: languages, hashes, and their order by path."""
    base = lineage.folder(spark, "sources")
    parts = table(spark, sf_dir, "part").groupBy("p_brand").agg(F.array_join(F.sort_array(F.collect_list("p_name")), "\n").alias("doc"))
    parts = parts.select(F.concat(F.translate("p_brand", "#", "_"), F.lit(".sql")).alias("file"), "doc")
    where = exchange.write_documents(parts, base, "scan/of/parts")
    found = scans.source_files(spark, where, "*.txt").withColumn("path", F.regexp_extract("path", r"file=([^/]+)/", 1))
    hashed = found.select("path", scans.language_of(F.col("path")).alias("language"), S.sha256(F.regexp_replace("content", "\n$", "")).alias("sha256"))
    return lineage.numbered(hashed, "path").withColumn("position", F.col("position").cast("int"))


def corpus_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as test vectors in a JSON corpus, written and read again; a baseline output of another length than the reference's is told."""
    base = lineage.folder(spark, "corpus")
    points = lambda n: F.transform(F.sequence(F.lit(1), n), lambda i: F.struct(i.cast("double").alias("lat"), (i * 2).cast("double").alias("lon")))
    n = F.floor(F.col("o_totalprice") / 100_000).cast("int") + 1
    output = lambda k: F.to_json(F.struct(F.transform(F.sequence(F.lit(1), k), lambda i: i.cast("double")).alias("leg_dist"), F.lit(True).alias("valid")))
    rows = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").cast("string").alias("id"), F.array("o_orderpriority").alias("tags"), F.struct(F.col("o_orderkey").cast("string").alias("id"), points(n).alias("points")).alias("input"),
        output(n).alias("reference_output"), output(F.when(F.col("o_orderstatus") == "P", n + 1).otherwise(n)).alias("baseline_output"), (F.col("o_orderstatus") == "P").alias("expected_divergent"),
    )
    where = scans.write_below(rows, base, "corpus")
    read = scans.vectors(spark, where, lines=True)
    legs = lambda c: F.size(scans.tolerant_result(F.col(c))["leg_dist"])
    return read.select(F.col("id").cast("bigint").alias("id"), F.size("input.points").alias("n_points"), F.element_at("tags", 1).alias("tag"), (legs("reference_output") != legs("baseline_output")).alias("mismatch"), "expected_divergent")


def blob_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points written to a text and read again; every seventh has no number for its second part."""
    events = table(spark, sf_dir, "events")
    second = F.when(F.pmod("event_id", F.lit(7)) == 0, F.lit("x")).otherwise(F.pmod("event_id", F.lit(13)).cast("string"))
    blobs = events.select("event_id", F.concat(F.col("user_id").cast("string"), F.lit(","), second, F.lit(";1,2;")).alias("blob"))
    return scans.points_of_blob(blobs, "event_id", "blob")


def _settled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with lines, with the status that their lines give them."""
    lines, orders = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linestatus"), table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    # the largest of texts is found by a sort of whole partitions
    lines, orders = lineage.dealt(lines.count(), (lines, "l_orderkey"), (orders, "o_orderkey"))
    lines = lines.groupBy("l_orderkey").agg(F.max("l_linestatus").alias("status"))
    return orders.join(lines, F.col("o_orderkey") == F.col("l_orderkey")).select("o_orderkey", "o_custkey", F.concat(F.lit("lines:"), "status").alias("o_orderstatus"))


def upsert_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All orders as the target; what their lines say of their status is the source."""
    target = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    return scans.upsert(target, _settled(spark, sf_dir), "o_orderkey")


def orphan_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of orders that are no longer open."""
    orders = table(spark, sf_dir, "orders").where("o_orderstatus = 'O'")
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    return scans.orphans(lines, orders, "l_orderkey", "o_orderkey").groupBy("l_orderkey").agg(F.count("*").alias("n_lines"))


def whole_text_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in whole documents, matches over several lines included."""
    found = X.whole_text_findings(table(spark, sf_dir, "documents"), "text", "doc_id", _SECRETS)
    return found.select("doc_id", "line_no", "name", "severity", S.sha256(F.col("matched")).alias("matched_sha256"))


def gold_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as rules in Turtle, with comments and quoted signs, read again; those of the last regions name no known category."""
    category = F.element_at(F.array(*[F.lit(c) for c in ("Constraint", "Routing", "Validation", "Calculation", "Unknown")]), F.col("n_regionkey") + 1)
    refs = F.when(F.col("n_nationkey") > 9, F.concat(F.lit(' ; w:sourceRef "a.cs" ; w:sourceRef "b'), F.col("n_nationkey").cast("string"), F.lit('.cs"'))).otherwise("")
    expression = F.when(F.col("n_nationkey") < 5, F.concat(F.lit(' ; w:expression "x < '), F.col("n_nationkey").cast("string"), F.lit('"'))).otherwise("")
    name = F.col("n_name")
    text = F.concat(
        F.lit("r:"), name, F.lit(" a w:Rule ; # first\n  w:category \""), category, F.lit('" ; rdfs:label "'), name, F.lit('" ;\n  w:statement "a # within '), name, F.lit('"'), expression, refs
    )
    return M.parse_turtle(table(spark, sf_dir, "nation").select(text.alias("t")), "t").select("category", "label", "statement", "expression", F.array_join("refs", "|").alias("refs"))


def _sql(p: str) -> str:
    return p.replace("'", "''")


def _findings_sql(name: str, source: str, key: str, patterns: tuple[X.Pattern, ...]) -> str:
    rank = {"Critical": 4, "High": 3, "Medium": 2, "Low": 1}
    hits = " UNION ALL ".join(
        f"SELECT {key}, line_no, '{p.name}' AS name, '{p.family}' AS family, '{p.severity}' AS severity, {rank[p.severity]} AS rank, {str(p.weak).lower()} AS weak, {str(p.quantum_vulnerable).lower()} AS quantum_vulnerable"
        f" FROM {name}_lines WHERE regexp_matches(line, '{_sql(p.regex)}')"
        for p in patterns
    )
    return f"""{name}_lines AS (
  SELECT {key}, line, line_no FROM (SELECT {key}, unnest(string_split(text, chr(10))) AS line, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS line_no FROM {source})
  WHERE NOT regexp_matches(line, '^\\s*(--|//|/\\*|\\*)')
), {name} AS ({hits}), {name}_top AS (
  SELECT * FROM {name} QUALIFY row_number() OVER (PARTITION BY {key}, line_no, family ORDER BY rank DESC, name) = 1
)"""


_TOKS_SQL = f"""
WITH words AS (
  SELECT 'b' AS t, item_id AS id, list_distinct(list_filter(string_split_regex(lower(text), '[^a-z0-9]+'), lambda w: w <> '' AND NOT list_contains({S.STOPWORDS!r}, w) AND (length(w) > 1 OR regexp_matches(w, '^[0-9]')))) AS toks FROM benchmark
  UNION ALL
  SELECT 'd', doc_id, list_distinct(list_filter(string_split_regex(lower(text), '[^a-z0-9]+'), lambda w: w <> '' AND NOT list_contains({S.STOPWORDS!r}, w) AND (length(w) > 1 OR regexp_matches(w, '^[0-9]')))) FROM documents
), c AS (
  SELECT *, len(toks) AS n, CASE WHEN len(toks) < 20 THEN 'short' WHEN len(toks) < 40 THEN 'medium' ELSE 'long' END AS category FROM words
), pairs AS (
  SELECT b.category, b.id AS l_id, d.id AS r_id, len(list_intersect(b.toks, d.toks)) AS shared, b.n + d.n AS both_n
  FROM c b JOIN c d ON b.t = 'b' AND d.t = 'd' AND b.category = d.category
), near AS (
  SELECT category, l_id, r_id, CAST(shared AS BIGINT) AS shared, shared / CAST(both_n - shared AS DOUBLE) AS jaccard FROM pairs WHERE shared > 0 AND shared / CAST(both_n - shared AS DOUBLE) >= 0.18
)"""
_BRACES_SQL = """
WITH p AS (
  SELECT page_id, regexp_extract(html, '<html lang="([a-z]+)"', 1) AS lang, regexp_replace(html, '[^{}()]', '', 'g') AS marks, regexp_matches(html, '([A-Za-z_$][A-Za-z0-9_$]*)\\s*\\(') AS has_call FROM pages
), m AS (
  SELECT page_id, unnest(range(1, length(marks) + 1)) AS i, marks FROM p
), r AS (
  SELECT page_id, i, sum(CASE substr(marks, i, 1) WHEN '{' THEN 1 WHEN '}' THEN -1 ELSE 0 END) OVER w AS c, sum(CASE substr(marks, i, 1) WHEN '(' THEN 1 WHEN ')' THEN -1 ELSE 0 END) OVER w AS q
  FROM m WINDOW w AS (PARTITION BY page_id ORDER BY i)
), b AS (SELECT page_id, min(c) >= 0 AND min(q) >= 0 AND arg_max(c, i) = 0 AND arg_max(q, i) = 0 AS ok FROM r GROUP BY page_id)
SELECT lang, count(*) AS total, CAST(sum(CASE WHEN coalesce(ok, true) AND has_call THEN 1 ELSE 0 END) AS BIGINT) AS parsed,
  sum(CASE WHEN coalesce(ok, true) AND has_call THEN 1 ELSE 0 END) / CAST(count(*) AS DOUBLE) AS rate FROM p LEFT JOIN b USING (page_id) GROUP BY lang
"""

QUERIES = {
    "doc_catalog": doc_catalog,
    "accept_rate_by_lang": accept_rate_by_lang,
    "keyword_complexity": keyword_complexity,
    "page_symbols": page_symbols,
    "secret_findings": secret_findings,
    "algo_findings": algo_findings,
    "html_findings_first_line": html_findings_first_line,
    "finding_disposition": finding_disposition,
    "rule_recognition": rule_recognition,
    "keyword_jaccard_pairs": keyword_jaccard_pairs,
    "greedy_match_f1": greedy_match_f1,
    "label_confusion": label_confusion,
    "tolerant_json": tolerant_json,
    "blob_points": blob_points,
    "recorded_results": recorded_results,
    "lines_of_offsets": lines_of_offsets,
    "written_sources": written_sources,
    "corpus_vectors": corpus_vectors,
    "upsert_orders": upsert_orders,
    "orphan_lines": orphan_lines,
    "whole_text_secrets": whole_text_secrets,
    "gold_rules": gold_rules,
}
_ALL = (*_SECRETS, *X.ALGORITHMS)
_TOP = "SELECT doc_id, CAST(line_no AS INTEGER) AS line_no, name, family, severity, weak, quantum_vulnerable FROM f_top"
ORACLES = {
    "doc_catalog": "SELECT doc_id, sha256(text) AS content_sha256, CAST(len(string_split(text, chr(10))) AS INTEGER) AS n_lines, CAST(length(text) AS INTEGER) AS n_code_points FROM documents",
    "accept_rate_by_lang": _BRACES_SQL,
    "keyword_complexity": "SELECT page_id, CAST(1 + "
    + " + ".join(f"len(regexp_extract_all(html, '(?i){_sql(p)}'))" for p in X.KEYWORDS_SCRIPT)
    + " AS INTEGER) AS complexity, CAST(len(string_split(html, chr(10))) AS INTEGER) AS loc FROM pages",
    "page_symbols": "SELECT DISTINCT page_id, CAST(line_no AS INTEGER) AS line_no, symbol FROM (SELECT page_id, line_no, unnest(regexp_extract_all(line, '([A-Za-z_$][A-Za-z0-9_$]*)\\s*\\(', 1)) AS symbol FROM (SELECT page_id, unnest(string_split(html, chr(10))) AS line, unnest(range(1, len(string_split(html, chr(10))) + 1)) AS line_no FROM pages))",
    "secret_findings": "WITH " + _findings_sql("f", "documents", "doc_id", _SECRETS) + _TOP,
    "algo_findings": "WITH " + _findings_sql("f", "documents", "doc_id", X.ALGORITHMS) + _TOP,
    "html_findings_first_line": "SELECT page_id, CAST(min(line_no) AS INTEGER) AS first_line, CAST(count(*) AS INTEGER) AS n_lines FROM (SELECT page_id, unnest(string_split(html, chr(10))) AS line, unnest(range(1, len(string_split(html, chr(10))) + 1)) AS line_no FROM pages) WHERE regexp_matches(line, '<script|innerHTML|\\.html\\(') AND NOT regexp_matches(line, '^\\s*(--|//|/\\*|\\*)') GROUP BY page_id",
    "finding_disposition": "WITH "
    + _findings_sql("f", "documents", "doc_id", _ALL)
    + ", "
    + _findings_sql("g", "benchmark", "item_id", _ALL)
    + "SELECT doc_id, CAST(line_no AS INTEGER) AS line_no, name, severity, CASE WHEN lang NOT IN ('en', 'de') THEN 'OutOfScope' WHEN name IN (SELECT name FROM g) THEN 'Residual' ELSE 'Remediated' END AS disposition FROM f_top JOIN documents USING (doc_id)",
    "rule_recognition": """SELECT doc_id, rule, category, confidence FROM documents, (VALUES
  ('licence-notice', 'Constraint', 0.93::DOUBLE, '(?i)licensed under|under the [A-Z]+ license'), ('all-rights-reserved', 'Constraint', 0.92::DOUBLE, '(?i)all rights reserved'),
  ('contact-address', 'Validation', 0.88::DOUBLE, '[A-Za-z0-9._-]+@[A-Za-z0-9-]+\\.[A-Za-z]+'), ('numeric-limit', 'Calculation', 0.80::DOUBLE, '[0-9]+\\.[0-9]+'), ('long-lines', 'Routing', 0.85::DOUBLE, '')
) r(rule, category, confidence, pattern) WHERE CASE WHEN rule = 'long-lines' THEN len(string_split(text, chr(10))) > 20 ELSE regexp_matches(text, pattern) END""",
    "keyword_jaccard_pairs": _TOKS_SQL + "SELECT * FROM near",
    "greedy_match_f1": _TOKS_SQL.replace("WITH words", "WITH RECURSIVE words")
    + """, ranked AS (SELECT category, l_id, r_id, row_number() OVER (PARTITION BY category ORDER BY jaccard DESC, l_id, r_id) AS rank FROM near
), lists AS (SELECT category, list({'l': l_id, 'r': r_id} ORDER BY rank) AS l FROM ranked GROUP BY category), steps AS (
  SELECT category, 0 AS k, CAST([] AS BIGINT[]) AS ls, CAST([] AS BIGINT[]) AS rs, l FROM lists
  UNION ALL
  SELECT category, k + 1, CASE WHEN list_contains(ls, l[k + 1].l) OR list_contains(rs, l[k + 1].r) THEN ls ELSE list_append(ls, l[k + 1].l) END,
    CASE WHEN list_contains(ls, l[k + 1].l) OR list_contains(rs, l[k + 1].r) THEN rs ELSE list_append(rs, l[k + 1].r) END, l FROM steps WHERE k < len(l)
), matched AS (SELECT category, len(ls) AS matched FROM steps WHERE k = len(l)), n AS (
  SELECT category, count(*) FILTER (WHERE t = 'b') AS expected, count(*) FILTER (WHERE t = 'd') AS found FROM c GROUP BY category
), r AS (
  SELECT category, expected, found, CAST(coalesce(matched, 0) AS BIGINT) AS matched, CASE WHEN found > 0 THEN coalesce(matched, 0) / CAST(found AS DOUBLE) ELSE 0.0 END AS precision,
    CASE WHEN expected > 0 THEN coalesce(matched, 0) / CAST(expected AS DOUBLE) ELSE 0.0 END AS recall FROM n LEFT JOIN matched USING (category)
) SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0.0 END AS f1 FROM r""",
    "label_confusion": """WITH c AS (
  SELECT CAST(sum(CASE WHEN toxic = 1 AND quality = 0 THEN 1 ELSE 0 END) AS BIGINT) AS tp, CAST(sum(CASE WHEN toxic = 1 AND quality <> 0 THEN 1 ELSE 0 END) AS BIGINT) AS fp,
    CAST(sum(CASE WHEN toxic <> 1 AND quality = 0 THEN 1 ELSE 0 END) AS BIGINT) AS fn, CAST(sum(CASE WHEN toxic <> 1 AND quality <> 0 THEN 1 ELSE 0 END) AS BIGINT) AS tn FROM labels
), r AS (
  SELECT c.*, v AS vacuous, CASE WHEN tp + fp > 0 THEN tp / CAST(tp + fp AS DOUBLE) ELSE v END AS precision, CASE WHEN tp + fn > 0 THEN tp / CAST(tp + fn AS DOUBLE) ELSE v END AS recall
  FROM c, (VALUES (1.0::DOUBLE), (0.0::DOUBLE)) t(v)
) SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0.0 END AS f1 FROM r""",
    "tolerant_json": "SELECT event_id, json_valid(t) AS parsed, coalesce(CASE WHEN json_valid(t) THEN TRY_CAST(json_extract_string(t, '$.k') AS BIGINT) END, 0) AS k, false AS valid, CAST(user_id % 4 + 1 AS INTEGER) AS n FROM (SELECT event_id, user_id, CASE WHEN event_id % 10 = 0 THEN substr(props, 1, 3) ELSE props END AS t FROM events)",
    "recorded_results": "SELECT n_name AS unit, sha256(concat_ws('|', n_name, 'cs', n_regionkey)) AS record_key, CASE WHEN n_regionkey < 3 THEN 'result of ' || n_name END AS result FROM nation",
    "lines_of_offsets": "SELECT doc_id, CAST(1 + length(h) - length(replace(h, chr(10), '')) AS INTEGER) AS middle, CAST(CASE WHEN text IS NOT NULL THEN 1 END AS INTEGER) AS first, CAST(1 + length(text) - length(replace(text, chr(10), '')) AS INTEGER) AS last FROM (SELECT *, substr(text, 1, CAST(length(text) // 2 AS INTEGER)) AS h FROM documents)",
    "written_sources": "SELECT replace(p_brand, '#', '_') || '.sql' AS path, 'sql' AS language, sha256(string_agg(p_name, chr(10) ORDER BY p_name)) AS sha256, CAST(row_number() OVER (ORDER BY replace(p_brand, '#', '_') || '.sql') AS INTEGER) AS position FROM part GROUP BY p_brand",
    "corpus_vectors": "SELECT o_orderkey AS id, CAST(floor(o_totalprice / 100000) AS INTEGER) + 1 AS n_points, o_orderpriority AS tag, o_orderstatus = 'P' AS mismatch, o_orderstatus = 'P' AS expected_divergent FROM orders",
    "blob_points": "SELECT event_id, 0 AS seq, CAST(user_id AS DOUBLE) AS lat, CASE WHEN event_id % 7 = 0 THEN NULL ELSE CAST(event_id % 13 AS DOUBLE) END AS lon FROM events UNION ALL SELECT event_id, 1, 1.0, 2.0 FROM events",
    "upsert_orders": "SELECT o_orderkey, o_custkey, coalesce('lines:' || status, o_orderstatus) AS o_orderstatus FROM orders LEFT JOIN (SELECT l_orderkey, max(l_linestatus) AS status FROM lineitem GROUP BY 1) ON o_orderkey = l_orderkey",
    "orphan_lines": "SELECT l_orderkey, count(*) AS n_lines FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O') GROUP BY l_orderkey",
    "whole_text_secrets": " UNION ALL ".join(
        f"""SELECT doc_id, CAST(1 + list_sum(list_transform(parts[1:i], lambda x: length(x) - length(replace(x, chr(10), '')))) AS INTEGER) AS line_no, '{p.name}' AS name, '{p.severity}' AS severity, sha256(found[i]) AS matched_sha256
  FROM (SELECT doc_id, parts, found, unnest(range(1, len(found) + 1)) AS i FROM (SELECT doc_id, string_split(regexp_replace(text, '({_sql(p.regex)})', chr(1) || '\\1', 'g'), chr(1)) AS parts, regexp_extract_all(text, '({_sql(p.regex)})', 1) AS found FROM documents WHERE regexp_matches(text, '{_sql(p.regex)}')))"""
        for p in _SECRETS
    ),
    "gold_rules": """SELECT ['Constraint', 'Routing', 'Validation', 'Calculation'][n_regionkey + 1] AS category, n_name AS label, 'a # within ' || n_name AS statement,
  CASE WHEN n_nationkey < 5 THEN 'x < ' || n_nationkey END AS expression, CASE WHEN n_nationkey > 9 THEN 'a.cs|b' || n_nationkey || '.cs' ELSE '' END AS refs FROM nation WHERE n_regionkey < 4""",
}
