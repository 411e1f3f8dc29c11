"""Queries over graphs and scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from tallyweave.operators import graph as G
from tallyweave.operators import scoring as R
from tallyweave.operators import spectral as SP
from tallyweave.sources.tables import table

_EVENT_ORDER = {"view": 0, "click": 1, "purchase": 2, "login": 3, "logout": 4}


def _transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Consecutive events of a user with more than a small value, as edges between event types of that user."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    name = lambda c: F.concat_ws(":", F.col("user_id").cast("string"), c)
    led = table(spark, sf_dir, "events").select("user_id", "event_type", F.lead("event_type").over(w).alias("next"))
    return led.where("next is not null").select(name(F.col("event_type")).alias("src"), name(F.col("next")).alias("dst"), F.lit("Calls").alias("kind"))


def fan_in(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = _transitions(spark, sf_dir)
    nodes = edges.select(F.col("src").alias("id")).unionByName(edges.select(F.col("dst").alias("id"))).distinct()
    return G.fan_in(nodes, edges)


def _flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines from a supplier's nation to a customer's, counted, as edges between nations."""
    orders, lines = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    cust = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("dst"))
    supp = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("src"))
    got = lines.select("l_orderkey", "l_suppkey").join(orders.select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey"), "l_orderkey").join(cust, "o_custkey").join(supp, "l_suppkey")
    return got.groupBy("src", "dst").agg(F.count("*").alias("weight")).withColumn("kind", F.when(F.pmod(F.col("src") + F.col("dst"), F.lit(3)) == 0, "Calls").when(F.pmod(F.col("src") + F.col("dst"), F.lit(3)) == 1, "References").otherwise("DataAccess"))


def contract_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    nations = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_regionkey").alias("unit"))
    return G.contract(_flows(spark, sf_dir), nations)


def _affinity(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_regionkey").alias("label"))
    return G.affinity(labels, _flows(spark, sf_dir))


def affinity_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _affinity(spark, sf_dir)


def spectral_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return SP.spectral_clusters(_affinity(spark, sf_dir).withColumn("graph", F.lit(1)), "graph")


def _users(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Users as modules; edges follow from the ids: back to a third, on to a multiple."""
    users = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("id")).agg(F.count("*").alias("n"))
    a = users.select(F.col("id").alias("src"), F.floor(F.col("id") / 3).cast("bigint").alias("dst"))
    b = users.select(F.col("id").alias("src"), (F.col("id") * 3 + 1).alias("dst"))
    return users, a.unionByName(b).where("src <> dst").withColumn("kind", F.lit("Calls")).withColumn("weight", F.lit(1))


def strong_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    users, edges = _users(spark, sf_dir)
    return G.strong_components(users, edges)


def _acyclic(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    users, edges = _users(spark, sf_dir)
    return users, edges.where("src > dst")


def topo_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.levels(*_acyclic(spark, sf_dir))


def priority_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    users, edges = _acyclic(spark, sf_dir)
    return G.priority_order(users.select("id", (F.pmod(F.col("n"), F.lit(10)) / 10.0).alias("risk")), edges)


def majority_event(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.majority(table(spark, sf_dir, "events"), "user_id", "event_type", _EVENT_ORDER)


def lead_member(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The customer of each nation with the most orders; ties by key."""
    cust = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    counts = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"))
    both = cust.join(counts, "c_custkey", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    best = F.min(F.struct((-F.col("n")).alias("less"), "c_custkey")).alias("b")
    return both.groupBy("c_nationkey").agg(best).select("c_nationkey", F.col("b.c_custkey").alias("c_custkey"), (-F.col("b.less")).alias("n_orders"))


_KINDS = {0: "vb6", 1: "sql", 2: "javascript", 3: "csharp", 4: "java"}


def _risks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as modules: size as complexity, lines as fan-out, suppliers as coupling, returns as rules."""
    lines = table(spark, sf_dir, "lineitem")
    per = lines.groupBy("l_partkey").agg(F.count("*").alias("lines"), F.countDistinct("l_suppkey").alias("suppliers"), F.sum((F.col("l_returnflag") == "R").cast("bigint")).alias("returns"))
    part = table(spark, sf_dir, "part").join(per, F.col("p_partkey") == F.col("l_partkey"), "left")
    n = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("double")
    language = F.element_at(F.array(*[F.lit(v) for v in _KINDS.values()]), (F.pmod("p_partkey", F.lit(5)) + 1).cast("int"))
    critical = R.criticality(F.when(F.col("p_size") > 40, 0.95).when(F.col("p_size") > 25, 0.80).when(F.col("p_size") > 10, 0.70).otherwise(0.50), n("returns"))
    risk = R.risk(F.col("p_size").cast("double"), n("lines"), critical, F.lit(0.0), n("suppliers"), language, F.length("p_name").cast("double"), F.lit(3.0))
    return part.select("p_partkey", "p_brand", F.round(risk, 9).alias("risk"))


def risk_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _risks(spark, sf_dir).select("p_partkey", "risk")


def unit_max_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _risks(spark, sf_dir).groupBy("p_brand").agg(F.coalesce(F.max("risk"), F.lit(0.0)).alias("risk"), F.count("*").alias("members"))


_AGENTS = [
    ("local-large", True, 22.0, 14.0, {"complexity": 0.70, "crypto": 0.62, "contextSize": 0.55}),
    ("local-small", True, 14.0, 18.0, {"complexity": 0.55, "crypto": 0.45, "contextSize": 0.40}),
    ("remote-large", False, 47.0, 5.0, {"complexity": 0.95, "crypto": 0.90, "contextSize": 0.95}),
    ("remote-small", False, 34.0, 8.0, {"complexity": 0.85, "crypto": 0.80, "contextSize": 0.80}),
]


def thompson_route(spark: SparkSession, sf_dir: str, sovereign_only: bool = False) -> DataFrame:
    agents = spark.createDataFrame(_AGENTS, "agent string, sovereign boolean, alpha double, beta double, weights map<string, double>")
    size = F.length("text") / 10000.0
    tasks = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("task"), F.create_map(F.lit("contextSize"), size, F.lit("complexity"), F.lit(0.5)).alias("features"))
    got = R.thompson_routes(tasks, agents, seed=2024, sovereign_only=sovereign_only)
    return got.select("task", "agent", F.round("sampled", 9).alias("sampled"), F.round("posterior_mean", 9).alias("posterior_mean"))


def sovereign_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same tasks where only local agents may be used."""
    return thompson_route(spark, sf_dir, sovereign_only=True)


def task_capabilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    features = F.create_map(F.lit("crypto"), F.length("text") / 2000.0)
    return docs.select("doc_id", F.array_join(R.capabilities(features, F.col("lang") == "de"), "|").alias("capabilities"))


def routing_strategy(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    features = F.create_map(F.lit("contextSize"), F.length("text") / 5000.0, F.lit("complexity"), F.lit(0.5))
    return docs.select("doc_id", R.strategy(features, F.col("lang") == "de").alias("strategy"))


_FLOWS_SQL = """
WITH flows AS (
  SELECT s_nationkey AS src, c_nationkey AS dst, count(*) AS weight FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2
)"""
_USERS_SQL = """
users AS (SELECT user_id AS id, count(*) AS n FROM events GROUP BY 1), arcs AS (
  SELECT id AS src, id // 3 AS dst FROM users WHERE id <> id // 3 AND id // 3 IN (SELECT id FROM users)
  UNION SELECT id, id * 3 + 1 FROM users WHERE id * 3 + 1 IN (SELECT id FROM users)
)"""
_SAT = lambda v, cap: f"least(greatest({v} / {cap}::DOUBLE, 0.0::DOUBLE), 1.0::DOUBLE)"
_RISK_SQL = f"""
WITH per AS (
  SELECT l_partkey, count(*) AS lines, count(DISTINCT l_suppkey) AS suppliers, sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS returns FROM lineitem GROUP BY 1
), m AS (
  SELECT p_partkey, p_brand, CAST(p_size AS DOUBLE) AS cc, CAST(coalesce(lines, 0) AS DOUBLE) AS fan, CAST(coalesce(suppliers, 0) AS DOUBLE) AS coupling, CAST(coalesce(returns, 0) AS DOUBLE) AS rules, CAST(length(p_name) AS DOUBLE) AS loc,
    CASE WHEN p_size > 40 THEN 0.95::DOUBLE WHEN p_size > 25 THEN 0.80::DOUBLE WHEN p_size > 10 THEN 0.70::DOUBLE ELSE 0.50::DOUBLE END AS base,
    [1.0::DOUBLE, 0.6, 0.4, 0.2, 0.3][CAST(p_partkey % 5 + 1 AS INTEGER)] AS obscurity, [0.9::DOUBLE, 0.7, 0.6, 0.5, 0.5][CAST(p_partkey % 5 + 1 AS INTEGER)] AS gap
  FROM part LEFT JOIN per ON p_partkey = l_partkey
), r AS (
  SELECT p_partkey, p_brand, round(least(greatest(0.0::DOUBLE + 0.20::DOUBLE * {_SAT("cc", "30.0")} + 0.18::DOUBLE * {_SAT("fan", "30.0")}
    + 0.17::DOUBLE * least(greatest(base + {_SAT("rules", "4.0")} * 0.20::DOUBLE, 0.0::DOUBLE), 1.0::DOUBLE) + 0.15::DOUBLE * 1.0::DOUBLE + 0.12::DOUBLE * {_SAT("coupling", "8.0")}
    + 0.08::DOUBLE * obscurity + 0.05::DOUBLE * (0.6::DOUBLE * {_SAT("loc", "200.0")} + 0.4::DOUBLE * {_SAT("3.0::DOUBLE", "6.0")}) + 0.05::DOUBLE * gap, 0.0::DOUBLE), 1.0::DOUBLE), 9) AS risk FROM m
)"""

QUERIES = {
    "fan_in": fan_in,
    "contract_edges": contract_edges,
    "affinity_pairs": affinity_pairs,
    "spectral_split": spectral_split,
    "strong_components": strong_components,
    "topo_levels": topo_levels,
    "priority_order": priority_order,
    "majority_event": majority_event,
    "lead_member": lead_member,
    "risk_score": risk_score,
    "unit_max_risk": unit_max_risk,
    "thompson_route": thompson_route,
    "sovereign_route": sovereign_route,
    "routing_strategy": routing_strategy,
    "task_capabilities": task_capabilities,
}
def _gamma_sql(name: str, shape: str) -> str:
    """The first accepted of the tries, for shapes from 1."""
    u = lambda k: f"((CAST(('0x' || substr(sha256('2024:' || {name} || ':g:' || i), {1 + 12 * k}, 12)) AS BIGINT) + 0.5::DOUBLE) / 281474976710656.0::DOUBLE)"
    d = f"({shape} - 1.0::DOUBLE / 3.0::DOUBLE)"
    x = f"(sqrt(-2.0::DOUBLE * ln({u(0)})) * cos(2.0::DOUBLE * pi() * {u(1)}))"
    tries = f"list_transform(range(1, 41), lambda i: {{'x': {x}, 'u': {u(2)}, 'w': 1.0::DOUBLE + 1.0::DOUBLE / sqrt(9.0::DOUBLE * {d}) * {x}}})"
    good = f"list_filter({tries}, lambda r: CASE WHEN r.w > 0 THEN ln(r.u) < 0.5::DOUBLE * r.x * r.x + {d} * (1.0::DOUBLE - r.w * r.w * r.w + ln(r.w * r.w * r.w)) ELSE false END)"
    return f"list_transform({good}[1:1], lambda r: {d} * (r.w * r.w * r.w))[1]"


def _route_sql(agents: list[tuple]) -> str:
    return (
        "WITH agents(agent, alpha, beta, complexity, size) AS (VALUES "
    + ", ".join(f"('{a}', {x}::DOUBLE, {y}::DOUBLE, {w['complexity']}::DOUBLE, {w['contextSize']}::DOUBLE)" for a, _, x, y, w in agents)
        + f"""), t AS (
  SELECT doc_id AS task, length(text) / 10000.0::DOUBLE AS s, agent, alpha, beta, complexity, size, doc_id || ':' || agent AS name FROM documents, agents
), d AS (SELECT *, {_gamma_sql("name || ':a'", "alpha")} AS ga, {_gamma_sql("name || ':b'", "beta")} AS gb, (s * size + 0.5::DOUBLE * complexity) / (s + 0.5::DOUBLE) AS match FROM t
) SELECT task, agent, round(ga / (ga + gb) * match, 9) AS sampled, round(alpha / (alpha + beta) * match, 9) AS posterior_mean FROM d QUALIFY row_number() OVER (PARTITION BY task ORDER BY ga / (ga + gb) * match DESC, alpha / (alpha + beta) * match DESC, agent) = 1"""
    )


ORACLES = {
    "thompson_route": _route_sql(_AGENTS),
    "sovereign_route": _route_sql([a for a in _AGENTS if a[1]]),
    "task_capabilities": "SELECT doc_id, CASE WHEN length(text) / 2000.0::DOUBLE >= 0.5 AND NOT lang = 'de' THEN 'code|analysis' ELSE 'code' END AS capabilities FROM documents",
    "priority_order": "WITH RECURSIVE "
    + _USERS_SQL
    + """, down AS (SELECT src, dst FROM arcs WHERE src > dst), u AS (SELECT id, (n % 10) / 10.0::DOUBLE AS risk, (SELECT count(*) FROM down WHERE src = id) AS needs FROM users), o AS (
  SELECT row_number() OVER (ORDER BY risk, needs, id) AS rank, id FROM u
), s AS (
  SELECT o.rank, o.id, coalesce(list(d.rank) FILTER (WHERE d.rank IS NOT NULL), []) AS needs FROM o LEFT JOIN down ON src = o.id LEFT JOIN o d ON d.id = dst GROUP BY o.rank, o.id
), all_units AS (SELECT list({'rank': rank, 'needs': needs} ORDER BY rank) AS l FROM s), steps AS (
  SELECT 0 AS k, CAST([] AS BIGINT[]) AS done, l FROM all_units
  UNION ALL
  SELECT k + 1, list_append(done, list_filter(l, lambda x: NOT list_contains(done, x.rank) AND list_has_all(done, x.needs))[1].rank), l FROM steps WHERE k < len(l)
) SELECT id, CAST(position AS INTEGER) AS position FROM (SELECT unnest(done) AS rank, unnest(range(1, len(done) + 1)) AS position FROM steps WHERE k = len(l)) JOIN o USING (rank)""",
    "fan_in": """WITH led AS (
  SELECT user_id, event_type, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nxt FROM events
), e AS (SELECT DISTINCT user_id || ':' || event_type AS src, user_id || ':' || nxt AS dst FROM led WHERE nxt IS NOT NULL), n AS (SELECT src AS id FROM e UNION SELECT dst FROM e)
SELECT n.id, count(e.src) AS fan_in FROM n LEFT JOIN e ON e.dst = n.id GROUP BY n.id""",
    "contract_edges": _FLOWS_SQL + "SELECT a.n_regionkey AS src, b.n_regionkey AS dst, CAST(sum(greatest(1, weight)) AS BIGINT) AS weight FROM flows JOIN nation a ON src = a.n_nationkey JOIN nation b ON dst = b.n_nationkey WHERE a.n_regionkey <> b.n_regionkey GROUP BY 1, 2",
    "affinity_pairs": _FLOWS_SQL
    + """SELECT i, j, sum(w) AS w FROM (
  SELECT a.n_nationkey AS i, b.n_nationkey AS j, 3.0::DOUBLE AS w FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey
  UNION ALL SELECT least(src, dst), greatest(src, dst), CASE (src + dst) % 3 WHEN 0 THEN 1.0::DOUBLE WHEN 1 THEN 0.5::DOUBLE ELSE 0.25::DOUBLE END FROM flows WHERE src <> dst) GROUP BY 1, 2""",
    "strong_components": "WITH RECURSIVE "
    + _USERS_SQL
    + ", reach AS (SELECT id AS a, id AS b FROM users UNION SELECT r.a, e.dst FROM reach r JOIN arcs e ON r.b = e.src) SELECT x.a AS id, min(x.b) AS component FROM reach x JOIN reach y ON x.a = y.b AND x.b = y.a GROUP BY x.a",
    "topo_levels": "WITH RECURSIVE "
    + _USERS_SQL
    + ", d AS (SELECT id, 0 AS level FROM users UNION SELECT e.src, d.level + 1 FROM d JOIN arcs e ON e.dst = d.id WHERE e.src > e.dst) SELECT id, CAST(max(level) AS INTEGER) AS level FROM d GROUP BY id",
    "majority_event": "SELECT user_id, event_type, n FROM (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY n DESC, CASE event_type "
    + " ".join(f"WHEN '{k}' THEN {v}" for k, v in _EVENT_ORDER.items())
    + f" ELSE {len(_EVENT_ORDER)} END, event_type) = 1",
    "lead_member": "SELECT c_nationkey, c_custkey, n AS n_orders FROM (SELECT c_nationkey, c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY c_nationkey ORDER BY n DESC, c_custkey) = 1",
    "risk_score": _RISK_SQL + "SELECT p_partkey, risk FROM r",
    "unit_max_risk": _RISK_SQL + "SELECT p_brand, max(risk) AS risk, count(*) AS members FROM r GROUP BY p_brand",
    "routing_strategy": "SELECT doc_id, CASE WHEN lang = 'de' THEN 'efficiency' WHEN length(text) / 5000.0::DOUBLE >= 0.7::DOUBLE THEN 'capability' ELSE 'balanced' END AS strategy FROM documents",
}
