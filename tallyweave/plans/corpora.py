"""Queries over generated routes, and over source files made of the parts of the catalogue."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyweave.functions import scalars as S
from tallyweave.operators import corpus as C
from tallyweave.operators import differential as D
from tallyweave.operators import review as V
from tallyweave.sources import scans
from tallyweave.sources.tables import table

#: Languages of the parts' source files by type; a part of another type has no file.
EXTENSIONS = {"ECONOMY": "cs", "SMALL": "js", "MEDIUM": "sql", "PROMO": "bas"}


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A route for every customer, with the outputs of the three models."""
    return C.evaluate(C.routes_of(table(spark, sf_dir, "customer"), "c_custkey"), F.col("tag") == "anti-meridian")


def route_diff_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every customer's route; the candidate repairs the wrap at the date line and keeps the rest."""
    report = D.report(_vectors(spark, sf_dir), C.oracles())
    return report.withColumn("max_rel_error", F.round("max_rel_error", 9))


def route_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.by_tag(_vectors(spark, sf_dir))


def route_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields in which the candidate differs from the baseline's recorded outputs, counted."""
    return C.replay_mismatches(C.record(_vectors(spark, sf_dir), "base"), "cand").groupBy("field").agg(F.count("*").alias("n"))


def divergent_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.checked_share(C.by_tag(_vectors(spark, sf_dir)))


def client_copy_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Routes by tag for which a copy of the decision that lacks the clause on arrivals says otherwise than the baseline."""
    v = _vectors(spark, sf_dir)
    return v.groupBy("tag").agg(F.sum((F.col("base_valid") != F.col("base_go")).cast("bigint")).alias("n_drifted"))


def _files(spark: SparkSession, sf_dir: str, after: bool = False) -> DataFrame:
    """Small source files of the parts; large sizes bring constructions that a review finds. ``after``: as rewritten."""
    size = F.col("p_size")
    text = lambda *lines: F.concat_ws("\n", *[F.lit(x) if isinstance(x, str) else x for x in lines])
    pick = lambda least, yes, no: F.when(size > least, yes).otherwise(no)
    connection = "  string c = Settings.Connection;" if after else '  string c = "Server=db;Integrated Security=true";'
    content = (
        F.when(F.col("p_type") == "ECONOMY", text("class Store {", connection, pick(30, "  TrustServerCertificate = true;", "  // TrustServerCertificate = true"), "}"))
        .when(F.col("p_type") == "SMALL", text("// innerHTML = a", "function draw(row) {", pick(20, "  el.innerHTML = row;", "  el.text = row;"), pick(45, "", "}")))
        .when(F.col("p_type") == "MEDIUM", text(pick(10, "CREATE TABLE [dbo].[Load] (id INT)", "GRANT ALL TO me"), pick(20, "EXEC(@sql)", "-- EXEC(@sql)")))
        .otherwise(text(pick(25, 'Attribute VB_Name = "Grid"', "Rem no name"), "Public Function Wrap(x)"))
    )
    extension = F.try_element_at(F.create_map(*[F.lit(x) for kv in EXTENSIONS.items() for x in kv]), F.col("p_type"))
    path = F.concat(F.lit("app/"), F.col("p_partkey").cast("string"), F.lit("."), extension)
    rows = table(spark, sf_dir, "part").where(extension.isNotNull()).select(path.alias("path"), content.alias("content"))
    return rows.select("path", scans.language_of(F.col("path")).alias("language"), "content", S.sha256(F.col("content")).alias("content_sha256"))


def security_review(spark: SparkSession, sf_dir: str) -> DataFrame:
    before, after = (V.security_findings(_files(spark, sf_dir, after)) for after in (False, True))
    return V.reconcile(before, after)


def source_accept_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.accepted(_files(spark, sf_dir))


def source_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.declared(_files(spark, sf_dir))


QUERIES = {
    "route_diff_report": route_diff_report,
    "route_divergence": route_divergence,
    "route_replay": route_replay,
    "divergent_share": divergent_share,
    "client_copy_drift": client_copy_drift,
    "security_review": security_review,
    "source_accept_rate": source_accept_rate,
    "source_symbols": source_symbols,
}

_RANGES = {s.tag: s for s in C.SHAPES}
_CASE = lambda f: "CASE tag " + " ".join(f"WHEN '{t}' THEN {f(s)!r}::DOUBLE" for t, s in _RANGES.items()) + " END"
_U = lambda name: f"CAST(('0x' || substr(md5('2024:' || id || ':' || {name}), 1, 10)) AS BIGINT) / 1099511627776.0::DOUBLE"
_SUM = lambda x: f"list_reduce(list_prepend(0.0::DOUBLE, {x}), lambda a, b: a + b)"
_WRAP = lambda x: f"CASE WHEN {x} > 180 THEN {x} - 360 WHEN {x} < -180 THEN {x} + 360 ELSE {x} END"
_DIST = lambda dlon: f"3440.065::DOUBLE * sqrt(pow(radians({dlon}) * cos(radians((points[i].lat + points[i + 1].lat) / 2)), 2) + pow(radians(points[i + 1].lat - points[i].lat), 2))"
_REL = lambda a, b: f"abs({a} - {b}) / greatest(abs({a}), abs({b}), 1e-12::DOUBLE)"
_EPOCHS = "[" + ", ".join(map(str, S.BOUNDARY_EPOCHS)) + "]"
_BEARING = """(degrees(atan2(sin(radians({d})) * cos(radians(q.lat)), cos(radians(p.lat)) * sin(radians(q.lat)) - sin(radians(p.lat)) * cos(radians(q.lat)) * cos(radians({d})))) + 360) % 360"""


def _tag_case() -> str:
    upto, out = 0, []
    for s in C.SHAPES:
        upto += C.TAG_COUNTS[s.tag]
        out.append(f"WHEN (id * {C.STEP}) % {sum(C.TAG_COUNTS.values())} < {upto} THEN '{s.tag}'")
    return "CASE " + " ".join(out) + " END"


_ROUTES_SQL = f"""
WITH t AS (SELECT c_custkey AS id FROM customer), s AS (SELECT id, {_tag_case()} AS tag FROM t), a AS (
  SELECT id, tag, CAST(floor({_CASE(lambda s: s.legs[0])} + {_U("'legs'")} * ({_CASE(lambda s: s.legs[1])} - {_CASE(lambda s: s.legs[0])} + 1)) AS INTEGER) AS legs,
    {_CASE(lambda s: s.heading[0])} + {_U("'heading'")} * ({_CASE(lambda s: s.heading[1])} - {_CASE(lambda s: s.heading[0])}) AS heading, {_CASE(lambda s: s.stray)} AS stray,
    CASE WHEN tag = 'degenerate-route' THEN CASE WHEN {_U("'still'")} < 0.5 THEN {_RANGES["degenerate-route"].stride[0]!r}::DOUBLE ELSE {_RANGES["degenerate-route"].stride[1]!r}::DOUBLE END
      ELSE {_CASE(lambda s: s.stride[0])} + {_U("'stride'")} * ({_CASE(lambda s: s.stride[1])} - {_CASE(lambda s: s.stride[0])}) END AS stride,
    20 * (2 * {_U("'lat'")} - 1) AS lat0, {_CASE(lambda s: s.start_lon[0])} + {_U("'lon'")} * ({_CASE(lambda s: s.start_lon[1])} - {_CASE(lambda s: s.start_lon[0])}) AS lon0,
    {_U("'late'")} < {_CASE(lambda s: s.late)} AS late FROM s
), b AS (
  SELECT *, list_transform(range(1, legs + 1), lambda i: radians(heading + (2 * ({_U("'stray:' || i")}) - 1) * stray)) AS turns FROM a
), c AS (
  SELECT *, {_SUM("list_transform(turns, lambda h: cos(h) * stride)")} AS north FROM b
), d AS (
  SELECT *, CASE WHEN abs(lat0 + north) > abs(lat0 - north) THEN -1.0::DOUBLE ELSE 1.0::DOUBLE END AS flip FROM c
), e AS (
  SELECT *, list_transform(range(0, legs + 1), lambda k: {{'lat': greatest(least(lat0 + flip * {_SUM("list_transform(turns[1:k], lambda h: cos(h) * stride)")}, 85.0::DOUBLE), -85.0::DOUBLE), 'lon': lon0 + {_SUM("list_transform(turns[1:k], lambda h: sin(h) * stride)")}}}) AS raw FROM d
), f AS (
  SELECT id, tag, late, legs, list_transform(raw, lambda p: {{'lat': p.lat, 'lon': {_WRAP("p.lon")}}}) AS points FROM e
), g AS (
  SELECT *, list_transform(range(1, legs + 1), lambda i: {_DIST(_WRAP("(points[i + 1].lon - points[i].lon)"))}) AS ref_legs,
    list_transform(range(1, legs + 1), lambda i: round({_DIST("(points[i + 1].lon - points[i].lon)")}, 8)) AS base_legs FROM f
), h AS (
  SELECT *, {_SUM("ref_legs")} AS ref_total, {_SUM("base_legs")} AS base_total,
    len(list_filter(range(1, legs + 1), lambda i: abs(points[i + 1].lat - points[i].lat) > 22 OR abs({_WRAP("(points[i + 1].lon - points[i].lon)")}) > 22)) AS n_far,
    list_transform(range(1, legs + 1), lambda i: list_transform([{{'p': points[i], 'q': points[i + 1]}}], lambda x: {_BEARING.format(d=_WRAP("(x.q.lon - x.p.lon)")).replace("q.lat", "x.q.lat").replace("p.lat", "x.p.lat")})[1]) AS bearings FROM g
), j AS (
  SELECT *, len(list_filter(range(1, legs), lambda i: CASE WHEN abs(bearings[i + 1] - bearings[i]) % 360 > 180 THEN 360 - abs(bearings[i + 1] - bearings[i]) % 360 ELSE abs(bearings[i + 1] - bearings[i]) % 360 END > 120)) AS n_turns,
    CAST(trunc((ref_total / 0.15::DOUBLE) * (0.2::DOUBLE + 0.7::DOUBLE * ({_U("'ahead'")}))) AS BIGINT) AS ahead FROM h
), k AS (
  SELECT *, CASE tag WHEN 'leap-second' THEN {_EPOCHS}[CAST(floor({_U("'boundary'")} * 5) AS INTEGER) + 1] - ahead WHEN 'overflow' THEN {C.OVERFLOW_LAUNCH} - ahead ELSE {C.QUIET_LAUNCH} END AS launch FROM j
), l AS (
  SELECT *, launch + CAST(round_even(ref_total / 0.15::DOUBLE, 0) AS BIGINT) AS rounded, launch + CAST(trunc(base_total / 0.15::DOUBLE) AS BIGINT) AS base_eta, n_far = 0 AND n_turns = 0 AS valid FROM k
), m AS (
  SELECT *, rounded + len(list_filter({_EPOCHS}, lambda b: b > least(launch, rounded) AND b <= greatest(launch, rounded))) AS ref_eta FROM l
), n AS (
  SELECT *, abs(ref_eta - (ref_eta + CASE WHEN late THEN 120 ELSE 0 END)) <= 120 AS ref_feasible, abs(base_eta - (ref_eta + CASE WHEN late THEN 120 ELSE 0 END)) <= 120 AS base_feasible,
    list_max(list_transform(range(1, legs + 1), lambda i: {_REL("base_legs[i]", "ref_legs[i]")})) AS leg_rel, {_REL("base_total", "ref_total")} AS total_rel, tag = 'anti-meridian' AS fixed FROM m
), o AS (
  SELECT *, valid <> valid OR base_feasible <> ref_feasible OR (valid AND base_feasible) <> (valid AND ref_feasible) OR greatest(leg_rel, total_rel) > 1e-9::DOUBLE AS divergent,
    CASE WHEN NOT fixed OR leg_rel <= 1e-9::DOUBLE THEN 0 ELSE 1 END AS legs_vote, CASE WHEN NOT fixed OR total_rel <= 1e-9::DOUBLE THEN 0 ELSE 1 END AS total_vote, CASE WHEN NOT fixed OR base_eta = ref_eta THEN 0 ELSE 1 END AS eta_vote,
    CASE WHEN NOT fixed OR base_feasible = ref_feasible THEN 0 ELSE 1 END AS feasible_vote, CASE WHEN NOT fixed OR (valid AND base_feasible) = (valid AND ref_feasible) THEN 0 ELSE 1 END AS go_vote,
    CASE WHEN fixed THEN leg_rel ELSE 0.0::DOUBLE END AS legs_rel, CASE WHEN fixed THEN total_rel ELSE 0.0::DOUBLE END AS all_rel FROM n
)"""
_ROUTE_ORACLES = (
    ("valid", "discrete", "0", "0.0::DOUBLE", "true"), ("go", "discrete", "go_vote", "0.0::DOUBLE", "true"), ("feasible", "discrete", "feasible_vote", "0.0::DOUBLE", "true"), ("eta", "discrete", "eta_vote", "0.0::DOUBLE", "true"),
    ("point_count", "discrete", "0", "0.0::DOUBLE", "true"), ("message_count", "discrete", "go_vote", "0.0::DOUBLE", "true"), ("leg_distances", "continuous", "legs_vote", "legs_rel", "true"), ("total_distance", "continuous", "total_vote", "all_rel", "true"),
    ("property:anti-meridian", "continuous", "legs_vote", "legs_rel", "tag = 'anti-meridian'"), ("property:leap-second", "discrete", "eta_vote", "0.0::DOUBLE", "tag = 'leap-second'"), ("property:precision", "continuous", "total_vote", "all_rel", "tag = 'precision-drift'"),
)
_LN20, _LN1000 = D.math.log(1 / (1 - 0.95)), D.math.log(1 / (1 - 0.999))
_FILES_SQL = "WITH f AS (SELECT 'app/' || p_partkey || CASE p_type WHEN 'ECONOMY' THEN '.cs' WHEN 'SMALL' THEN '.js' WHEN 'MEDIUM' THEN '.sql' ELSE '.bas' END AS path, p_type, p_size FROM part WHERE p_type IN ('ECONOMY', 'SMALL', 'MEDIUM', 'PROMO'))"
ORACLES = {
    "route_diff_report": _ROUTES_SQL
    + ", votes AS ("
    + " UNION ALL ".join(f"SELECT id, '{n}' AS oracle, '{k}' AS kind, {v} AS vote, {r} AS rel FROM o WHERE {w}" for n, k, v, r, w in _ROUTE_ORACLES)
    + f"""), totals AS (SELECT count(*) AS vectors_total, count(*) FILTER (WHERE c = 0) AS vectors_passed, count(*) FILTER (WHERE c = 1) AS intentional_vectors FROM (SELECT max(vote) AS c FROM votes GROUP BY id))
SELECT oracle, kind, count(*) AS evaluated, CAST(0 AS BIGINT) AS violations, CAST(sum(vote) AS BIGINT) AS intentional, round(max(rel), 9) AS max_rel_error, sum(vote) > 0 AS is_intentional, any_value(vectors_total) AS vectors_total,
  any_value(vectors_passed) AS vectors_passed, any_value(intentional_vectors) AS intentional_vectors, CAST(0 AS BIGINT) AS violating_vectors, CAST(0 AS BIGINT) AS total_violations,
  any_value({_LN20!r}::DOUBLE / vectors_passed) AS bound, any_value({_LN1000!r}::DOUBLE / vectors_passed) AS secondary_bound FROM votes, totals GROUP BY oracle, kind""",
    "route_divergence": _ROUTES_SQL + " SELECT tag, count(*) AS n, count(*) FILTER (WHERE divergent) AS divergent FROM o GROUP BY tag",
    "route_replay": _ROUTES_SQL
    + """, r AS (SELECT unnest(list_filter([CASE WHEN eta_vote = 1 THEN 'eta' END, CASE WHEN feasible_vote = 1 THEN 'feasible' END, CASE WHEN go_vote = 1 THEN 'go' END, CASE WHEN go_vote = 1 THEN 'messages' END, CASE WHEN total_vote = 1 THEN 'distances' END], lambda x: x IS NOT NULL)) AS field FROM o)
SELECT field, count(*) AS n FROM r GROUP BY field""",
    "divergent_share": _ROUTES_SQL + " SELECT count(*) AS n, count(*) FILTER (WHERE divergent) AS divergent, count(*) FILTER (WHERE divergent) / CAST(count(*) AS DOUBLE) AS share FROM o",
    "client_copy_drift": _ROUTES_SQL + " SELECT tag, count(*) FILTER (WHERE valid AND NOT base_feasible) AS n_drifted FROM o GROUP BY tag",
    "security_review": _FILES_SQL
    + """SELECT 'hardcoded-credentials' AS rule, 'Connection string in a literal' AS title, 'CAT II' AS severity, '(remediated)' AS location, 'Remediated' AS disposition FROM f WHERE p_type = 'ECONOMY'
UNION ALL SELECT 'certificate-validation', 'Certificates are not validated', 'CAT II', path || ':3', 'Residual' FROM f WHERE p_type = 'ECONOMY'
UNION ALL SELECT 'output-encoding', 'HTML is built from strings', 'CAT II', path || ':3', 'OutOfScope' FROM f WHERE p_type = 'SMALL' AND p_size > 20
UNION ALL SELECT 'sql-injection', 'SQL is executed from a built string', 'CAT I', path || ':2', 'OutOfScope' FROM f WHERE p_type = 'MEDIUM' AND p_size > 20""",
    "source_accept_rate": _FILES_SQL
    + """, g AS (SELECT CASE p_type WHEN 'ECONOMY' THEN 'csharp' WHEN 'SMALL' THEN 'javascript' WHEN 'MEDIUM' THEN 'sql' ELSE 'vb6' END AS language,
  CASE p_type WHEN 'ECONOMY' THEN true WHEN 'SMALL' THEN p_size <= 45 WHEN 'MEDIUM' THEN p_size > 10 ELSE p_size > 25 END AS ok FROM f)
SELECT language, count(*) AS total, count(*) FILTER (WHERE ok) AS parsed, count(*) FILTER (WHERE ok) / CAST(count(*) AS DOUBLE) AS rate FROM g GROUP BY language""",
    "source_symbols": _FILES_SQL
    + """SELECT path, 'javascript' AS language, 2 AS line_no, 'draw' AS symbol FROM f WHERE p_type = 'SMALL' UNION ALL SELECT path, 'sql', 1, 'dbo.Load' FROM f WHERE p_type = 'MEDIUM' AND p_size > 10
UNION ALL SELECT path, 'vb6', 2, 'Wrap' FROM f WHERE p_type = 'PROMO'""",
}
