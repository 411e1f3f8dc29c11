"""Queries over orders, lines and routes: differential reports, bounds, geometry, sums."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyweave.functions import scalars as S
from tallyweave.operators import differential as D
from tallyweave.operators import kernels as K
from tallyweave.operators import ordered as O
from tallyweave.sources.tables import table


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.order_vectors(table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem"))


def _oracles() -> list[D.Oracle]:
    c = F.col
    discrete = lambda name, out: D.Oracle(name, "discrete", D.discrete_vote(c(f"base_{out}"), c(f"cand_{out}"), c(f"ref_{out}")))
    total = D.continuous_vote(c("base_total"), c("cand_total"), c("ref_total"))
    total_rel = S.relative_error(c("base_total"), c("cand_total"))
    # line by line: other numbers of lines are a violation, and so is a value that neither the baseline nor the reference has
    lines = D.array_vote(c("base_values"), c("cand_values"), c("ref_values"))
    line, line_rel = lines["vote"], lines["rel"]
    units = D.discrete_vote(c("base_units"), c("cand_units"), c("ref_units"))
    return [
        discrete("big_order", "big"),
        discrete("within_units", "ok"),
        discrete("has_return", "returned"),
        discrete("handling_units", "units"),
        discrete("line_count", "lines"),
        discrete("message_count", "messages"),
        D.Oracle("line_values", "continuous", line, line_rel),
        D.Oracle("total_value", "continuous", total, total_rel),
        D.Oracle("property:long-order", "continuous", total, total_rel, c("lines") >= 8),
        D.Oracle("property:returned", "discrete", units, None, c("returned") == 1),
        D.Oracle("property:urgent", "continuous", line, line_rel, c("urgent")),
    ]


def _votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.vector_votes(_vectors(spark, sf_dir), _oracles(), "o_orderkey")


def diff_oracle_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.report(_vectors(spark, sf_dir), _oracles())


def diff_vector_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _votes(spark, sf_dir).select("o_orderkey", "n_violations", "class")


def _divergent() -> tuple[F.Column, F.Column]:
    """Operational divergence of baseline and reference, and a cheaper detector that looks at totals and units."""
    total = S.relative_error(F.col("base_total"), F.col("ref_total")) > S.RELATIVE_TOLERANCE
    flips = (F.col("base_ok") != F.col("ref_ok")) | (F.col("base_big") != F.col("ref_big"))
    return total | (F.col("lines_off") > 0) | flips, total | flips


def divergence_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    expected, detected = _divergent()
    return D.confusion(_vectors(spark, sf_dir), detected, expected, 1.0, "o_orderpriority")


def latent_defects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Divergent vectors by class, each class listed although it has none; first matching class counts."""
    expected, _ = _divergent()
    v = _vectors(spark, sf_dir).where(expected)
    label = F.when(F.col("base_ok") != F.col("ref_ok"), "units-flip").when(F.col("base_big") != F.col("ref_big"), "limit-flip").when(F.col("lines") >= 8, "drift").otherwise("rounding")
    counts = v.groupBy(label.alias("tag")).agg(F.count("*").alias("n"))
    listed = spark.range(1).select(F.explode(F.array(*[F.lit(t) for t in ("drift", "limit-flip", "rounding", "units-flip")])).alias("tag"))
    return listed.join(counts, "tag", "left").select("tag", F.coalesce("n", F.lit(0)).alias("divergent_vectors"))


def confidence_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    per = table(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(F.count("*").alias("n"))
    return per.select("o_orderpriority", "n", S.upper_bound(F.col("n"), 0.95).alias("bound_95"), S.upper_bound(F.col("n"), 0.999).alias("bound_999"))


def composed_bound(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = confidence_bounds(spark, sf_dir).withColumn("sensitivity", F.substring("o_orderpriority", 1, 1).cast("int"))
    return D.composed_bound(parts, "sensitivity", "bound_95").select(F.round("composed_bound", 9).alias("composed_bound"))


def _legs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.legs(K.route_points(table(spark, sf_dir, "events")), "user_id", "ts", "event_id")


def leg_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _legs(spark, sf_dir).select("user_id", "leg", F.round("distance", 6).alias("distance"), F.round("raw_distance", 6).alias("raw_distance"))


def leg_bearing_turn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _legs(spark, sf_dir).select("user_id", "leg", F.round("bearing", 6).alias("bearing"), F.round("turn", 6).alias("turn"))


def route_validity_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = O.route_decisions(_legs(spark, sf_dir), "user_id")
    return got.select("user_id", "n_legs", "valid", F.array_join("messages", "|").alias("messages"))


def eta_with_boundaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arrivals of every route for launches near the boundary epochs, with the decision of both models."""
    got = O.route_decisions(_legs(spark, sf_dir), "user_id").withColumn("total", F.round("total", 6))
    launch = F.element_at(F.array(*[F.lit(e).cast("bigint") for e in S.BOUNDARY_EPOCHS]), (F.pmod("user_id", F.lit(5)) + 1).cast("int")) - 3600 * F.pmod("user_id", F.lit(100000))
    got = got.withColumn("launch", launch)
    ref, base = O.arrival(F.col("total"), F.col("launch"))
    desired = base + F.pmod(F.col("user_id"), F.lit(3)) * 60
    out = got.select("user_id", "launch", ref.alias("ref_eta"), base.alias("base_eta"), desired.alias("desired"))
    feasible = lambda c: F.abs(F.col(c) - F.col("desired")) <= S.ARRIVAL_TOLERANCE_SEC
    return out.select("user_id", "launch", "ref_eta", "base_eta", feasible("ref_eta").alias("ref_feasible"), feasible("base_eta").alias("base_feasible"))


_LINE_ORDER = ("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")


def ordered_sum_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order totals summed from left to right after rounding each line, against the exact sum."""
    lines = table(spark, sf_dir, "lineitem").withColumn("units", K.line_units())
    rounded = S.half_even_div(F.col("units"), K.UNITS_PER_CENT) / 100.0
    got = lines.groupBy("l_orderkey").agg(O.ordered_sum(rounded, *_LINE_ORDER).alias("running_total"), F.sum("units").alias("units"))
    exact = F.col("units") / 10000.0
    off = S.relative_error(F.col("running_total"), exact) > S.RELATIVE_TOLERANCE
    return got.select("l_orderkey", "running_total", exact.alias("exact_total"), off.alias("drifted"))


def running_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact units of every order's lines, added up line by line."""
    lines = table(spark, sf_dir, "lineitem").withColumn("units", K.line_units())
    upto = Window.partitionBy("l_orderkey").orderBy(*_LINE_ORDER).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return lines.select("l_orderkey", F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*_LINE_ORDER)).alias("at_line"), F.sum("units").over(upto).alias("running_units"))


def array_vote_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Array votes of three leg lists: the candidate drops the last element of every tenth route and repairs every third."""
    legs = _legs(spark, sf_dir).groupBy("user_id").agg(F.sort_array(F.collect_list(F.struct("leg", F.round("distance", 6).alias("d"), F.round("raw_distance", 6).alias("r")))).alias("l"))
    legs = legs.select("user_id", F.transform("l", lambda e: e["d"]).alias("ref"), F.transform("l", lambda e: e["r"]).alias("base"))
    fixed = F.when(F.pmod("user_id", F.lit(3)) == 0, F.col("ref")).otherwise(F.col("base"))
    cand = F.when(F.pmod("user_id", F.lit(10)) == 0, F.slice(fixed, 1, F.greatest(F.size(fixed) - 1, F.lit(0)))).otherwise(fixed)
    vote = D.array_vote(F.col("base"), cand, F.col("ref"))
    return legs.select("user_id", vote.alias("v")).select("user_id", F.col("v.vote").alias("vote"), (F.col("v.rel") == float("inf")).alias("broken"))


_LN20, _LN1000 = math.log(1 / (1 - 0.95)), math.log(1 / (1 - 0.999))

_VECTORS_SQL = """
WITH each_line AS (
  SELECT l_orderkey, CAST(CAST(l_extendedprice AS DECIMAL(14,2)) * 100 AS BIGINT) * (100 - CAST(CAST(l_discount AS DECIMAL(4,2)) * 100 AS BIGINT)) AS exact,
    l_returnflag = 'R' AS returned, l_returnflag, l_partkey FROM lineitem
), rounded_line AS (
  SELECT *, (exact // 100 + CASE WHEN 2 * (exact % 100) > 100 OR (2 * (exact % 100) = 100 AND (exact // 100) % 2 = 1) THEN 1 ELSE 0 END) * 100 AS rounded FROM each_line
), rel_line AS (
  SELECT *, abs(exact / 10000.0::DOUBLE - rounded / 10000.0::DOUBLE) / greatest(abs(exact / 10000.0::DOUBLE), abs(rounded / 10000.0::DOUBLE), 1e-12::DOUBLE) AS rel FROM rounded_line
), per AS (
  SELECT l_orderkey, count(*) AS lines, count(l_orderkey) AS base_lines, count(l_partkey) AS cand_lines, count(*) FILTER (WHERE returned) > 0 AS base_returned, max(l_returnflag) >= 'R' AS cand_returned, CAST(sum(exact) AS BIGINT) AS exact, CAST(sum(rounded) AS BIGINT) AS rounded, max(CAST(returned AS INT)) AS returned, max(rel) AS line_rel,
    CAST(sum(CASE WHEN rel > 1e-9::DOUBLE THEN 1 ELSE 0 END) AS BIGINT) AS lines_off FROM rel_line GROUP BY l_orderkey
), v0 AS (
  SELECT o_orderkey, o_orderpriority, coalesce(lines, 0) AS ref_lines, coalesce(base_lines, 0) AS base_lines, coalesce(cand_lines, 0) AS cand_lines, coalesce(returned, 0) = 1 AS ref_returned,
    coalesce(base_returned, false) AS base_returned, coalesce(cand_returned, false) AS cand_returned, coalesce(lines, 0) AS lines, coalesce(exact, 0) AS exact, coalesce(rounded, 0) AS rounded, coalesce(returned, 0) AS returned,
    coalesce(line_rel, 0) AS line_rel, coalesce(lines_off, 0) AS lines_off, o_orderpriority = '1-URGENT' AS urgent
  FROM orders LEFT JOIN per ON o_orderkey = l_orderkey
), v1 AS (
  SELECT *, CASE WHEN urgent THEN exact ELSE rounded END AS chosen, rounded // 10000000 AS base_units,
    exact // 10000000 + CASE WHEN 2 * (exact % 10000000) > 10000000 OR (2 * (exact % 10000000) = 10000000 AND (exact // 10000000) % 2 = 1) THEN 1 ELSE 0 END AS ref_units FROM v0
), v2 AS (
  SELECT *, CASE WHEN urgent THEN ref_units ELSE base_units END AS cand_units, exact / 10000.0::DOUBLE AS ref_total, rounded / 10000.0::DOUBLE AS base_total, chosen / 10000.0::DOUBLE AS cand_total,
    exact > 1500000000 AS ref_big, rounded > 1500000000 AS base_big, chosen > 1500000000 AS cand_big FROM v1
), v3 AS (
  SELECT *, ref_units <= 120 AS ref_ok, base_units <= 120 AS base_ok, cand_units <= 120 AS cand_ok FROM v2
), v AS (
  SELECT *, CAST(ref_big AS INT) + CAST(NOT ref_ok AS INT) AS ref_messages, CAST(base_big AS INT) + CAST(NOT base_ok AS INT) AS base_messages,
    CAST(cand_big AS INT) + CAST(NOT cand_ok AS INT) AS cand_messages,
    abs(base_total - cand_total) / greatest(abs(base_total), abs(cand_total), 1e-12::DOUBLE) AS bc,
    abs(cand_total - ref_total) / greatest(abs(cand_total), abs(ref_total), 1e-12::DOUBLE) AS cr,
    abs(base_total - ref_total) / greatest(abs(base_total), abs(ref_total), 1e-12::DOUBLE) AS br, coalesce(lines_vote, 0) AS lines_vote, coalesce(lines_rel, 0.0::DOUBLE) AS lines_rel
  FROM v3 LEFT JOIN (
    SELECT o_orderkey AS k, max(CASE WHEN c_b <= 1e-9::DOUBLE THEN 0 WHEN c_r <= 1e-9::DOUBLE AND rel > 1e-9::DOUBLE THEN 1 ELSE 2 END) AS lines_vote, max(c_b) AS lines_rel FROM (
      SELECT o_orderkey, rel, abs(c - b) / greatest(abs(c), abs(b), 1e-12::DOUBLE) AS c_b, abs(c - r) / greatest(abs(c), abs(r), 1e-12::DOUBLE) AS c_r FROM (
        SELECT o_orderkey, rel, exact / 10000.0::DOUBLE AS r, rounded / 10000.0::DOUBLE AS b, CASE WHEN o_orderpriority = '1-URGENT' THEN exact ELSE rounded END / 10000.0::DOUBLE AS c FROM rel_line JOIN orders ON o_orderkey = l_orderkey))
    GROUP BY 1) ON k = o_orderkey
)"""


def _sql_discrete(out: str) -> str:
    return f"CASE WHEN cand_{out} = base_{out} THEN 0 WHEN cand_{out} = ref_{out} AND base_{out} <> ref_{out} THEN 1 ELSE 2 END"


_SQL_TOTAL = "CASE WHEN bc <= 1e-9::DOUBLE THEN 0 WHEN cr <= 1e-9::DOUBLE AND br > 1e-9::DOUBLE THEN 1 ELSE 2 END"
_SQL_LINE, _SQL_LINE_REL = "lines_vote", "lines_rel"
_SQL_ORACLES = [
    ("big_order", "discrete", _sql_discrete("big"), "0.0::DOUBLE", "true"),
    ("within_units", "discrete", _sql_discrete("ok"), "0.0::DOUBLE", "true"),
    ("has_return", "discrete", _sql_discrete("returned"), "0.0::DOUBLE", "true"),
    ("handling_units", "discrete", _sql_discrete("units"), "0.0::DOUBLE", "true"),
    ("line_count", "discrete", _sql_discrete("lines"), "0.0::DOUBLE", "true"),
    ("message_count", "discrete", _sql_discrete("messages"), "0.0::DOUBLE", "true"),
    ("line_values", "continuous", _SQL_LINE, _SQL_LINE_REL, "true"),
    ("total_value", "continuous", _SQL_TOTAL, "bc", "true"),
    ("property:long-order", "continuous", _SQL_TOTAL, "bc", "lines >= 8"),
    ("property:returned", "discrete", _sql_discrete("units"), "0.0::DOUBLE", "returned = 1"),
    ("property:urgent", "continuous", _SQL_LINE, _SQL_LINE_REL, "urgent"),
]
def votes_sql(parsed: str = "true") -> str:
    """Common tables ``votes`` and ``classes``; where the condition does not hold, the candidate cannot be read."""
    each = [
        f"SELECT o_orderkey, '{n}' AS oracle, '{k}' AS kind, CASE WHEN {parsed} THEN {v} ELSE 2 END AS vote, CASE WHEN {parsed} THEN {r} ELSE 0.0::DOUBLE END AS rel FROM v WHERE {w}" + (f" AND {parsed}" if w != "true" else "")
        for n, k, v, r, w in _SQL_ORACLES
    ]
    return f"""{_VECTORS_SQL}, votes AS ({" UNION ALL ".join(each)}), classes AS (
  SELECT o_orderkey, CAST(sum(CASE WHEN vote = 2 THEN 1 ELSE 0 END) AS INTEGER) AS n_violations,
    CASE WHEN max(vote) = 2 THEN 'violation' WHEN max(vote) = 1 THEN 'intentional' ELSE 'pass' END AS class FROM votes GROUP BY o_orderkey
)"""


_LEGS_SQL = """
WITH points AS (
  SELECT user_id, event_id, ts, ((event_id * 37) % 1200) / 10.0::DOUBLE - 60.0::DOUBLE AS lat, ((event_id * 101) % 3600) / 10.0::DOUBLE - 180.0::DOUBLE AS lon FROM events
), led AS (
  SELECT user_id, lat, lon, row_number() OVER w - 1 AS leg, lead(lat, 1) OVER w AS lat2, lead(lon, 1) OVER w AS lon2, lead(lat, 2) OVER w AS lat3, lead(lon, 2) OVER w AS lon3
  FROM points WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)
), wrapped AS (
  SELECT *, CASE WHEN lon2 - lon > 180 THEN lon2 - lon - 360 WHEN lon2 - lon < -180 THEN lon2 - lon + 360 ELSE lon2 - lon END AS d1,
    CASE WHEN lon3 - lon2 > 180 THEN lon3 - lon2 - 360 WHEN lon3 - lon2 < -180 THEN lon3 - lon2 + 360 ELSE lon3 - lon2 END AS d2 FROM led WHERE lat2 IS NOT NULL
), angles AS (
  SELECT *, 3440.065::DOUBLE * sqrt((radians(d1) * cos(radians((lat + lat2) / 2.0::DOUBLE))) * (radians(d1) * cos(radians((lat + lat2) / 2.0::DOUBLE))) + radians(lat2 - lat) * radians(lat2 - lat)) AS distance,
    3440.065::DOUBLE * sqrt((radians(lon2 - lon) * cos(radians((lat + lat2) / 2.0::DOUBLE))) * (radians(lon2 - lon) * cos(radians((lat + lat2) / 2.0::DOUBLE))) + radians(lat2 - lat) * radians(lat2 - lat)) AS raw_distance,
    (degrees(atan2(sin(radians(d1)) * cos(radians(lat2)), cos(radians(lat)) * sin(radians(lat2)) - sin(radians(lat)) * cos(radians(lat2)) * cos(radians(d1)))) + 360.0::DOUBLE) % 360.0::DOUBLE AS bearing,
    (degrees(atan2(sin(radians(d2)) * cos(radians(lat3)), cos(radians(lat2)) * sin(radians(lat3)) - sin(radians(lat2)) * cos(radians(lat3)) * cos(radians(d2)))) + 360.0::DOUBLE) % 360.0::DOUBLE AS bearing2
  FROM wrapped
), legs AS (
  SELECT user_id, leg, distance, raw_distance, abs(lat2 - lat) AS dlat, abs(d1) AS dlon, bearing,
    CASE WHEN abs(bearing2 - bearing) % 360.0::DOUBLE > 180 THEN 360.0::DOUBLE - abs(bearing2 - bearing) % 360.0::DOUBLE ELSE abs(bearing2 - bearing) % 360.0::DOUBLE END AS turn FROM angles
)"""
_DECISIONS_SQL = (
    _LEGS_SQL
    + """, decisions AS (
  SELECT user_id, count(*) AS n_legs, list_reduce(list_prepend(0.0::DOUBLE, list(distance ORDER BY leg)), lambda x, y: x + y) AS total,
    coalesce(list('LEG_OUT_OF_BOX:' || leg ORDER BY leg) FILTER (WHERE dlat > 22 OR dlon > 22), []) AS boxes,
    coalesce(list('TURN_EXCEEDED:' || (leg + 1) ORDER BY leg) FILTER (WHERE turn > 120), []) AS turns FROM legs GROUP BY user_id
)"""
)

def report_sql(parsed: str = "true") -> str:
    return f"""{votes_sql(parsed)}, t AS (
  SELECT count(*) AS vectors_total, CAST(sum(CASE WHEN class = 'pass' THEN 1 ELSE 0 END) AS BIGINT) AS vectors_passed,
    CAST(sum(CASE WHEN class = 'intentional' THEN 1 ELSE 0 END) AS BIGINT) AS intentional_vectors, CAST(sum(CASE WHEN class = 'violation' THEN 1 ELSE 0 END) AS BIGINT) AS violating_vectors,
    CAST(sum(n_violations) AS BIGINT) AS total_violations FROM classes
)
SELECT oracle, kind, count(*) AS evaluated, CAST(sum(CASE WHEN vote = 2 THEN 1 ELSE 0 END) AS BIGINT) AS violations, CAST(sum(CASE WHEN vote = 1 THEN 1 ELSE 0 END) AS BIGINT) AS intentional,
  max(rel) AS max_rel_error, max(vote) FILTER (WHERE vote = 1) IS NOT NULL AS is_intentional, any_value(vectors_total) AS vectors_total, any_value(vectors_passed) AS vectors_passed,
  any_value(intentional_vectors) AS intentional_vectors, any_value(violating_vectors) AS violating_vectors, any_value(total_violations) AS total_violations,
  any_value(CASE WHEN total_violations = 0 THEN {_LN20!r}::DOUBLE / vectors_passed ELSE total_violations / CAST(vectors_total AS DOUBLE) END) AS bound,
  any_value(CASE WHEN total_violations = 0 THEN {_LN1000!r}::DOUBLE / vectors_passed END) AS secondary_bound
FROM votes, t GROUP BY oracle, kind
"""


QUERIES = {
    "diff_oracle_report": diff_oracle_report,
    "diff_vector_class": diff_vector_class,
    "divergence_confusion": divergence_confusion,
    "latent_defects": latent_defects,
    "confidence_bounds": confidence_bounds,
    "composed_bound": composed_bound,
    "leg_distance": leg_distance,
    "leg_bearing_turn": leg_bearing_turn,
    "route_validity_messages": route_validity_messages,
    "eta_with_boundaries": eta_with_boundaries,
    "ordered_sum_drift": ordered_sum_drift,
    "array_vote_rows": array_vote_rows,
    "running_totals": running_totals,
}
_EXPECTED_SQL, _DETECTED_SQL = (
    "(br > 1e-9::DOUBLE OR lines_off > 0 OR base_ok <> ref_ok OR base_big <> ref_big)",
    "(br > 1e-9::DOUBLE OR base_ok <> ref_ok OR base_big <> ref_big)",
)
ORACLES = {
    "diff_oracle_report": report_sql(),
    "diff_vector_class": votes_sql() + "SELECT o_orderkey, n_violations, class FROM classes",
    "divergence_confusion": _VECTORS_SQL
    + f""", c AS (
  SELECT o_orderpriority, CAST(sum(CASE WHEN {_DETECTED_SQL} AND {_EXPECTED_SQL} THEN 1 ELSE 0 END) AS BIGINT) AS tp, CAST(sum(CASE WHEN {_DETECTED_SQL} AND NOT {_EXPECTED_SQL} THEN 1 ELSE 0 END) AS BIGINT) AS fp,
    CAST(sum(CASE WHEN NOT {_DETECTED_SQL} AND {_EXPECTED_SQL} THEN 1 ELSE 0 END) AS BIGINT) AS fn, CAST(sum(CASE WHEN NOT {_DETECTED_SQL} AND NOT {_EXPECTED_SQL} THEN 1 ELSE 0 END) AS BIGINT) AS tn
  FROM v GROUP BY o_orderpriority
), r AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp / CAST(tp + fp AS DOUBLE) ELSE 1.0 END AS precision, CASE WHEN tp + fn > 0 THEN tp / CAST(tp + fn AS DOUBLE) ELSE 1.0 END AS recall FROM c)
SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0.0 END AS f1 FROM r
""",
    "latent_defects": _VECTORS_SQL
    + f""", d AS (
  SELECT CASE WHEN base_ok <> ref_ok THEN 'units-flip' WHEN base_big <> ref_big THEN 'limit-flip' WHEN lines >= 8 THEN 'drift' ELSE 'rounding' END AS tag, count(*) AS n FROM v WHERE {_EXPECTED_SQL} GROUP BY 1
) SELECT t.tag, coalesce(n, 0) AS divergent_vectors FROM (VALUES ('drift'), ('limit-flip'), ('rounding'), ('units-flip')) t(tag) LEFT JOIN d USING (tag)
""",
    "confidence_bounds": f"SELECT o_orderpriority, count(*) AS n, {_LN20!r}::DOUBLE / count(*) AS bound_95, {_LN1000!r}::DOUBLE / count(*) AS bound_999 FROM orders GROUP BY o_orderpriority",
    "composed_bound": f"SELECT round(sum(CAST(substr(o_orderpriority, 1, 1) AS INT) * b), 9) AS composed_bound FROM (SELECT o_orderpriority, {_LN20!r}::DOUBLE / count(*) AS b FROM orders GROUP BY o_orderpriority)",
    "leg_distance": _LEGS_SQL + "SELECT user_id, CAST(leg AS INTEGER) AS leg, round(distance, 6) AS distance, round(raw_distance, 6) AS raw_distance FROM legs",
    "leg_bearing_turn": _LEGS_SQL + "SELECT user_id, CAST(leg AS INTEGER) AS leg, round(bearing, 6) AS bearing, round(turn, 6) AS turn FROM legs",
    "route_validity_messages": _DECISIONS_SQL
    + """SELECT user_id, n_legs, len(boxes) = 0 AND len(turns) = 0 AS valid,
  array_to_string(list_concat(list_concat(boxes, turns), CASE WHEN len(boxes) = 0 AND len(turns) = 0 THEN [] ELSE ['ROUTE_INVALID'] END), '|') AS messages FROM decisions""",
    "eta_with_boundaries": _DECISIONS_SQL
    + """, e AS (
  SELECT user_id, round(total, 6) AS total, [1000000000, 1100000000, 1200000000, 2000000000, 4000000000][CAST(user_id % 5 + 1 AS INTEGER)] - 3600 * (user_id % 100000) AS launch FROM decisions
), n AS (
  SELECT *, launch + CAST(round_even(total / 0.15::DOUBLE, 0) AS BIGINT) AS rounded, launch + CAST(trunc(total / 0.15::DOUBLE) AS BIGINT) AS base_eta FROM e
), a AS (
  SELECT *, rounded + (SELECT count(*) FROM (VALUES (1000000000), (1100000000), (1200000000), (2000000000), (4000000000)) b(e) WHERE b.e > least(launch, rounded) AND b.e <= greatest(launch, rounded)) AS ref_eta FROM n
)
SELECT user_id, launch, ref_eta, base_eta, abs(ref_eta - (base_eta + (user_id % 3) * 60)) <= 120 AS ref_feasible, abs((user_id % 3) * 60) <= 120 AS base_feasible FROM a""",
    "ordered_sum_drift": _VECTORS_SQL
    + """, sums AS (
  SELECT r.l_orderkey, list_reduce(list_prepend(0.0::DOUBLE, list(r.rounded // 100 / 100.0::DOUBLE ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice)), lambda x, y: x + y) AS running_total,
    CAST(sum(r.exact) AS BIGINT) / 10000.0::DOUBLE AS exact_total
  FROM (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, e AS exact, (e // 100 + CASE WHEN 2 * (e % 100) > 100 OR (2 * (e % 100) = 100 AND (e // 100) % 2 = 1) THEN 1 ELSE 0 END) * 100 AS rounded
    FROM (SELECT *, CAST(CAST(l_extendedprice AS DECIMAL(14,2)) * 100 AS BIGINT) * (100 - CAST(CAST(l_discount AS DECIMAL(4,2)) * 100 AS BIGINT)) AS e FROM lineitem)) r
  GROUP BY r.l_orderkey
) SELECT l_orderkey, running_total, exact_total, abs(running_total - exact_total) / greatest(abs(running_total), abs(exact_total), 1e-12::DOUBLE) > 1e-9::DOUBLE AS drifted FROM sums""",
    "running_totals": """WITH u AS (SELECT *, CAST(CAST(l_extendedprice AS DECIMAL(14,2)) * 100 AS BIGINT) * (100 - CAST(CAST(l_discount AS DECIMAL(4,2)) * 100 AS BIGINT)) AS units FROM lineitem)
SELECT l_orderkey, CAST(row_number() OVER w AS INTEGER) AS at_line, CAST(sum(units) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice ROWS UNBOUNDED PRECEDING) AS BIGINT) AS running_units
FROM u WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice)""",
    "array_vote_rows": _LEGS_SQL
    + """, e AS (
  SELECT user_id, leg, count(*) OVER (PARTITION BY user_id) AS n, round(distance, 6) AS r, round(raw_distance, 6) AS b, CASE WHEN user_id % 3 = 0 THEN round(distance, 6) ELSE round(raw_distance, 6) END AS c FROM legs
), w AS (
  SELECT user_id, n, abs(b - c) / greatest(abs(b), abs(c), 1e-12::DOUBLE) AS bc, abs(c - r) / greatest(abs(c), abs(r), 1e-12::DOUBLE) AS cr, abs(b - r) / greatest(abs(b), abs(r), 1e-12::DOUBLE) AS br FROM e
)
SELECT user_id, CASE WHEN user_id % 10 = 0 AND any_value(n) > 0 THEN 2 ELSE max(CASE WHEN bc <= 1e-9::DOUBLE THEN 0 WHEN cr <= 1e-9::DOUBLE AND br > 1e-9::DOUBLE THEN 1 ELSE 2 END) END AS vote,
  user_id % 10 = 0 AS broken FROM w GROUP BY user_id""",
}
