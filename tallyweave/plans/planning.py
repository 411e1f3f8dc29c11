"""Queries from dependency graphs to units, concerns, counters, recognised rules and ordered findings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyweave.functions import scalars as S
from tallyweave.operators import graph as G
from tallyweave.operators import kernels as K
from tallyweave.operators import lineage
from tallyweave.operators import ordered as O
from tallyweave.operators import planning as P
from tallyweave.operators import textscan as X
from tallyweave.plans import governance, graphs, texts
from tallyweave.sources.tables import table

#: A nation calls another one where this many per cent of an average flow, or more, go there.
STRONG_FLOW = 112
CASCADE = (("money", ("price", "pay", "cost")), ("access", ("password", "secret", "login")), ("rights", ("licen", "copyright", "rights")), ("contact", ("@", "http")))
ORDER = ("view", "click", "purchase", "signup", "error")
LEAD = "purchase"


def _nations(spark: SparkSession, sf_dir: str) -> DataFrame:
    regions = table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("n_regionkey"), F.concat(F.lit("type:"), "r_name").alias("type_id"))
    return table(spark, sf_dir, "nation").join(F.broadcast(regions), "n_regionkey").select(F.col("n_name").alias("id"), F.col("n_nationkey").cast("string").alias("name"), "type_id")


def _calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strong flows of lines: the supplier's nation calls the customer's, by its key."""
    flows = graphs._flows(spark, sf_dir).select("src", "dst", "weight")
    mean = flows.agg(F.sum("weight").alias("total"), F.count("*").alias("n"))
    strong = flows.join(F.broadcast(mean), F.col("weight") * F.col("n") * 100 >= F.col("total") * STRONG_FLOW)  # one row
    names = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("src"), F.col("n_name").alias("id"))
    return strong.join(F.broadcast(names), "src").select("id", F.col("dst").cast("string").alias("called"))


def _created(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations of suppliers in debt create a command, the others a list."""
    names = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_name").alias("id"))
    low = table(spark, sf_dir, "supplier").groupBy("s_nationkey").agg(F.min("s_acctbal").alias("least"))
    return low.join(F.broadcast(names), "s_nationkey").select("id", F.when(F.col("least") < 0, "Data.SqlCommand").otherwise("List").alias("type_name"))


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.dependency_edges(_nations(spark, sf_dir), _calls(spark, sf_dir), _created(spark, sf_dir))


def dependency_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _edges(spark, sf_dir)


def _components(spark: SparkSession, sf_dir: str) -> DataFrame:
    methods = _nations(spark, sf_dir)
    nodes = methods.select("id").unionByName(methods.select(F.col("type_id").alias("id")).distinct())
    return G.strong_components(nodes, P.coupling_arcs(_edges(spark, sf_dir), methods))


def coupling_arcs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.coupling_arcs(_edges(spark, sf_dir), _nations(spark, sf_dir))


def coupled_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.units_of(_components(spark, sf_dir))


def single_modules(spark: SparkSession, sf_dir: str) -> DataFrame:
    users, edges = graphs._users(spark, sf_dir)
    return P.alone(users, G.strong_components(users, edges))


def _concerns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users as members; every day of the week is a rule of each kind of event that names the users who caused it then.

    A rule comes in parts of some users each, so no array grows with the table; a user is named by one part only.
    """
    events = table(spark, sf_dir, "events")
    rules = events.groupBy(F.dayofweek("ts").alias("rule"), F.col("event_type").alias("concern"), F.floor(F.col("user_id") / 500)).agg(F.collect_set("user_id").alias("refs"))
    users = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("id")).agg(F.count("*").alias("fan_out"))
    name = F.concat(F.lit("user "), F.col("id").cast("string"))
    return P.assign_concerns(users.select("id", name.alias("name")), rules, users, P.first_match(F.col("name"), (("view", ("1",)), ("click", ("2",)))), ORDER, LEAD)


def concern_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _concerns(spark, sf_dir)


def named_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    risks = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("id")).agg(F.max("value").alias("risk"))
    got = P.named_units(_concerns(spark, sf_dir), risks, ORDER, "click")
    return got.select("unit", F.col("place").cast("int").alias("place"), F.array_join(F.transform("members", lambda m: m.cast("string")), ",").alias("members"), "risk")


def rules_per_module(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every day of the week with every kind of event is a rule that names its users."""
    events = table(spark, sf_dir, "events")
    rules = events.groupBy(F.concat_ws(":", F.dayofweek("ts").cast("string"), "event_type").alias("rule"), F.floor(F.col("user_id") / 500)).agg(F.collect_set("user_id").alias("refs"))
    return P.rules_per_module(rules, events.select(F.col("user_id").alias("id")).distinct())


def keyword_concern(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first concern whose words a document holds, and whether its tags (language, source) name English."""
    docs = table(spark, sf_dir, "documents").withColumn("tags", F.array("lang", "source"))
    return docs.select("doc_id", P.first_match(F.col("text"), CASCADE).alias("concern"), P.has_tag(F.col("tags"), "EN").alias("english"))


def type_complexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Brands as types and parts as their methods: size, suppliers, lines, letters of the name."""
    per = table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.countDistinct("l_suppkey").alias("coupling"), F.count("*").alias("fan_out"))
    parts = table(spark, sf_dir, "part").join(per, F.col("p_partkey") == F.col("l_partkey"), "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    return P.type_complexity(parts.select(F.col("p_brand").alias("type_id"), F.col("p_size").cast("bigint").alias("complexity"), zero("coupling"), zero("fan_out"), F.length("p_name").alias("nesting")))


def fixed_point(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points of routes in whole units, the wrapped difference of longitude to the next, and whether a box holds them."""
    points = K.route_points(table(spark, sf_dir, "events"))
    units = points.select("user_id", "event_id", "ts", P.to_units(F.col("lat")).alias("lat"), P.to_units(F.col("lon")).alias("lon"))
    ahead = F.lead("lon").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return units.select("event_id", "lat", "lon", P.wrapped_units(ahead - F.col("lon")).alias("dlon"), P.in_box(F.col("lat"), F.col("lon"), (-300_000, -900_000, 300_000, 900_000)).alias("inside"))


def route_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Legs of no length, and changes of hemisphere, of each user's route; an event at the place of the one before stands still."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    points = K.route_points(table(spark, sf_dir, "events")).withColumn("lat", F.floor(F.col("lat") / 30) * 30.0).withColumn("lon", F.floor(F.col("lon") / 90) * 90.0)
    legs = O.legs(points, "user_id", "ts", "event_id")
    south = points.select("user_id", (F.row_number().over(w) - 1).alias("leg"), (F.col("lat") < 0).alias("south"))
    return P.quiet_legs(legs.join(south, ["user_id", "leg"]), "user_id")


def items_by_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = table(spark, sf_dir, "benchmark").select(F.col("item_id").cast("string").alias("id"), F.col("text").alias("statement"), F.lit(None).cast("string").alias("expression"))
    return P.items_by_words(rules, DEFECTS)


DEFECTS = (("D1", "articles are dropped", ("the ", " und ")), ("D2", "numbers are cut", ("0.5", "1e9")), ("D3", "names are lost", ("ción", "schaft")), ("D4", "never", ("no text holds this",)))


def unbroken_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many entries of every chain stand before its first break; in chains with a system turn the third link is damaged."""
    stored = governance._chain(spark, sf_dir)
    damaged = (F.col("seq") == 2) & (F.substring("entry_hash", 1, 1) < "8")
    stored = stored.withColumn("prev_hash", F.when(damaged, F.reverse("prev_hash")).otherwise(F.col("prev_hash")))
    kept = P.upto_break(stored, governance.L.verify_chain(stored, "conv_id"), "conv_id")
    return kept.groupBy("conv_id").agg(F.count("*").alias("n"), F.max_by("entry_hash", "seq").alias("head"))


def ordered_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings numbered by place, then line and name; edges between regions numbered by their ends."""
    found = texts.secret_findings(spark, sf_dir).select(F.concat(F.lit("doc:"), F.lpad(F.col("doc_id").cast("string"), 12, "0")).alias("place"), F.col("line_no").cast("bigint").alias("line_no"), "name")
    edges = graphs.contract_edges(spark, sf_dir).select(F.concat(F.lit("edge:"), F.col("src").cast("string")).alias("place"), F.col("dst").cast("bigint").alias("line_no"), F.col("weight").cast("string").alias("name"))
    order = ("place", "line_no", "name")
    both = lineage.numbered(found.select(*order), *order).unionByName(lineage.numbered(edges.select(*order), *order))
    return both.withColumn("position", F.col("position").cast("int"))


def rule_statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = {"VIEW": "A page is seen.", "Purchase": "Something is paid."}
    events = table(spark, sf_dir, "events")
    return events.groupBy("event_type").agg(F.count("*").alias("n")).select("event_type", "n", P.statement_of(F.col("event_type"), known, "No statement.").alias("statement"))


# Parts of source texts that a recogniser stands for: a part of the catalogue holds those whose place divides its size.
FRAGMENTS = (
    "double d = EarthRadiusNm * Math.Sqrt(x * x + y * y);", "totalDistance += legs;", "long eta = launchEpochSec + distance / NominalSpeed;",
    "while (d > 180) d -= 360;", "if (dlat > MaxLegDLat || dlon > MaxLegDLon) return;", "if (turn > MaxTurnDeg) return;",
    "bool near = Math.Abs(eta - desiredTot) <= TotTol;", "routeValid = false;", "for (int i = 0; i < n; i++) { b = lats[i + 1]; }",
    'if (kind == "A" && place == "B") goNoGo = false;', 'var range = new Dictionary<string, double> { { "A", 900 } };', "const double MaxLegNm = 1500;",
)


def _sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = F.array(*[F.when(F.pmod("p_size", F.lit(i)) == 0, F.lit(f)) for i, f in enumerate(FRAGMENTS, 1)])
    return table(spark, sf_dir, "part").select("p_partkey", F.concat_ws("\n", F.concat(F.lit("void "), F.regexp_replace("p_name", " ", "_"), F.lit("() {")), F.array_join(F.array_compact(held), "\n"), F.lit("}")).alias("content"))


def source_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twelve recognisers over small source texts of the parts."""
    return X.recognise(_sources(spark, sf_dir), "p_partkey", X.structural_rules("content")).select("p_partkey", "rule", "category", "confidence")


_EDGES_SQL = f"""flows AS (
  SELECT s_nationkey AS src, c_nationkey AS dst, count(*) AS weight FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2
), methods AS (SELECT n_name AS id, n_nationkey AS k, 'type:' || r_name AS type_id FROM nation JOIN region ON n_regionkey = r_regionkey
), called AS (
  SELECT a.id AS src, b.id AS dst, a.type_id AS src_type, b.type_id AS dst_type FROM flows JOIN methods a ON src = a.k JOIN methods b ON dst = b.k
  WHERE weight * (SELECT count(*) FROM flows) * 100 >= (SELECT sum(weight) FROM flows) * {STRONG_FLOW} AND a.id <> b.id
), touching AS (SELECT id, type_id FROM methods WHERE k IN (SELECT s_nationkey FROM supplier GROUP BY 1 HAVING min(s_acctbal) < 0)
), edges AS (
  SELECT id AS src, type_id AS dst, 'References' AS kind FROM methods UNION SELECT src, dst, 'Calls' FROM called UNION SELECT src_type, dst_type, 'References' FROM called WHERE src_type <> dst_type
  UNION SELECT id, 'external:database', 'DataAccess' FROM touching UNION SELECT type_id, 'external:database', 'DataAccess' FROM touching
), arcs AS (
  SELECT src, dst FROM edges WHERE kind <> 'DataAccess' UNION SELECT dst, src FROM edges WHERE kind = 'References' AND src IN (SELECT id FROM methods)
)"""
_COMPONENTS_SQL = (
    "WITH RECURSIVE "
    + _EDGES_SQL
    + """, nodes AS (SELECT id FROM methods UNION SELECT type_id FROM methods), reach AS (SELECT id AS a, id AS b FROM nodes UNION SELECT r.a, e.dst FROM reach r JOIN arcs e ON r.b = e.src
), components AS (SELECT x.a AS id, min(x.b) AS component FROM reach x JOIN reach y ON x.a = y.b AND x.b = y.a GROUP BY x.a), sizes AS (SELECT component, count(*) AS members FROM components GROUP BY 1)"""
)
_CONCERNS_SQL = """WITH named AS (SELECT DISTINCT user_id AS id, event_type AS concern, dayofweek(ts) AS rule FROM events), users AS (SELECT user_id AS id, count(*) AS fan_out, max(value) AS risk FROM events GROUP BY 1
), leader AS (SELECT id FROM users WHERE id IN (SELECT id FROM named WHERE concern = 'purchase') ORDER BY fan_out DESC, id LIMIT 1
), votes AS (SELECT id, concern, count(*) AS n FROM named WHERE concern <> 'purchase' GROUP BY 1, 2
), most AS (SELECT id, concern FROM votes QUALIFY row_number() OVER (PARTITION BY id ORDER BY n DESC, CASE concern WHEN 'view' THEN 1 WHEN 'click' THEN 2 WHEN 'purchase' THEN 3 WHEN 'signup' THEN 4 ELSE 5 END) = 1
), concerns AS (
  SELECT u.id, u.risk, CASE WHEN u.id IN (SELECT id FROM leader) THEN 'purchase' WHEN m.concern IS NOT NULL THEN m.concern WHEN contains(CAST(u.id AS VARCHAR), '1') THEN 'view' WHEN contains(CAST(u.id AS VARCHAR), '2') THEN 'click' ELSE 'shared' END AS concern
  FROM users u LEFT JOIN most m USING (id)
)"""
_WORDS = lambda c, ws: " OR ".join(f"contains(lower({c}), '{w.lower()}')" for w in ws)

QUERIES = {
    "dependency_graph": dependency_graph,
    "coupling_arcs": coupling_arcs,
    "coupled_units": coupled_units,
    "single_modules": single_modules,
    "concern_assignment": concern_assignment,
    "named_units": named_units,
    "rules_per_module": rules_per_module,
    "keyword_concern": keyword_concern,
    "type_complexity": type_complexity,
    "fixed_point": fixed_point,
    "route_counters": route_counters,
    "items_by_words": items_by_words,
    "unbroken_prefix": unbroken_prefix,
    "ordered_findings": ordered_findings,
    "rule_statements": rule_statements,
    "source_rules": source_rules,
}
_POINTS_SQL = "SELECT user_id, event_id, ts, ((event_id * 37) % 1200) / 10.0::DOUBLE - 60.0::DOUBLE AS lat, ((event_id * 101) % 3600) / 10.0::DOUBLE - 180.0::DOUBLE AS lon FROM events"
ORACLES = {
    "dependency_graph": f"WITH {_EDGES_SQL} SELECT * FROM edges",
    "coupling_arcs": f"WITH {_EDGES_SQL} SELECT * FROM arcs",
    "coupled_units": _COMPONENTS_SQL + f" SELECT id, 'unit:' || component AS unit, members, members >= {P.CUT_FROM} AS cut FROM components JOIN sizes USING (component)",
    "single_modules": "WITH RECURSIVE "
    + graphs._USERS_SQL
    + ", reach AS (SELECT id AS a, id AS b FROM users UNION SELECT r.a, e.dst FROM reach r JOIN arcs e ON r.b = e.src) SELECT id FROM users WHERE id NOT IN (SELECT x.a FROM reach x JOIN reach y ON x.a = y.b AND x.b = y.a WHERE x.a <> x.b)",
    "concern_assignment": _CONCERNS_SQL + " SELECT id, concern FROM concerns",
    "named_units": _CONCERNS_SQL
    + """, owned AS (SELECT id, risk, CASE WHEN concern = 'shared' THEN 'click' ELSE concern END AS concern FROM concerns)
SELECT 'unit:' || concern AS unit, CASE concern WHEN 'view' THEN 1 WHEN 'click' THEN 2 WHEN 'purchase' THEN 3 WHEN 'signup' THEN 4 ELSE 5 END AS place, string_agg(CAST(id AS VARCHAR), ',' ORDER BY id) AS members, max(risk) AS risk FROM owned GROUP BY concern""",
    "rules_per_module": "SELECT user_id AS id, count(DISTINCT dayofweek(ts) || ':' || event_type) AS n_rules FROM events GROUP BY 1",
    "keyword_concern": "SELECT doc_id, CASE " + " ".join(f"WHEN {_WORDS('text', ws)} THEN '{label}'" for label, ws in CASCADE) + " END AS concern, coalesce(lower(lang) = 'en', false) OR coalesce(lower(source) = 'en', false) AS english FROM documents",
    "type_complexity": """SELECT p_brand AS type_id, CAST(sum(p_size) AS BIGINT) AS complexity, CAST(sum(coalesce(coupling, 0)) AS BIGINT) AS coupling, CAST(sum(coalesce(fan_out, 0)) AS BIGINT) AS fan_out,
  CAST(max(length(p_name)) AS INTEGER) AS nesting, CAST(max(p_size) AS BIGINT) AS worst FROM part LEFT JOIN (SELECT l_partkey, count(DISTINCT l_suppkey) AS coupling, count(*) AS fan_out FROM lineitem GROUP BY 1) ON p_partkey = l_partkey GROUP BY 1""",
    "fixed_point": f"""WITH p AS ({_POINTS_SQL}), u AS (SELECT user_id, event_id, ts, CAST(round_even(lat * 10000, 0) AS BIGINT) AS lat, CAST(round_even(lon * 10000, 0) AS BIGINT) AS lon FROM p
), d AS (SELECT *, lead(lon) OVER (PARTITION BY user_id ORDER BY ts, event_id) - lon AS raw FROM u)
SELECT event_id, lat, lon, CASE WHEN raw > 1800000 THEN raw - 3600000 WHEN raw < -1800000 THEN raw + 3600000 ELSE raw END AS dlon, lat BETWEEN -300000 AND 300000 AND lon BETWEEN -900000 AND 900000 AS inside FROM d""",
    "route_counters": f"""WITH p AS ({_POINTS_SQL}), q AS (SELECT user_id, event_id, ts, floor(lat / 30) AS lat, floor(lon / 90) AS lon FROM p
), l AS (SELECT user_id, ts, event_id, lat, lead(lat) OVER w AS lat2, lead(lon) OVER w - lon AS dlon FROM q WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)
), s AS (SELECT *, lag(lat < 0) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM l WHERE lat2 IS NOT NULL)
SELECT user_id, CAST(sum(CASE WHEN lat2 = lat AND dlon = 0 THEN 1 ELSE 0 END) AS BIGINT) AS still, CAST(sum(CASE WHEN (lat < 0) <> before THEN 1 ELSE 0 END) AS BIGINT) AS crossings FROM s GROUP BY user_id""",
    "items_by_words": " UNION ALL ".join(f"SELECT '{i}' AS item, '{w}' AS weakness, 'Open' AS status WHERE EXISTS (SELECT 1 FROM benchmark WHERE {_WORDS('text', ws)})" for i, w, ws in DEFECTS),
    "unbroken_prefix": governance._LINKS_SQL + " SELECT conv_id, count(*) AS n, arg_max(entry_hash, seq) AS head FROM chain c WHERE seq < 2 OR conv_id NOT IN (SELECT conv_id FROM chain WHERE seq = 2 AND entry_hash[1] < '8') GROUP BY conv_id",
    "ordered_findings": f"""WITH f AS ({texts.ORACLES["secret_findings"]}), e AS ({graphs.ORACLES["contract_edges"]}), b AS (
  SELECT 'doc:' || lpad(CAST(doc_id AS VARCHAR), 12, '0') AS place, CAST(line_no AS BIGINT) AS line_no, name FROM f UNION ALL SELECT 'edge:' || src, CAST(dst AS BIGINT), CAST(weight AS VARCHAR) FROM e
) SELECT *, CAST(row_number() OVER (PARTITION BY place[1:4] ORDER BY place, line_no, name) AS INTEGER) AS position FROM b""",
    "rule_statements": "SELECT event_type, count(*) AS n, CASE event_type WHEN 'view' THEN 'A page is seen.' WHEN 'purchase' THEN 'Something is paid.' ELSE 'No statement.' END AS statement FROM events GROUP BY event_type",
    "source_rules": "SELECT p_partkey, rule, category, confidence FROM part JOIN (VALUES "
    + ", ".join(f"({i}, '{r.name}', '{r.category}', {r.confidence}::DOUBLE)" for i, r in enumerate(X.STRUCTURAL, 1))
    + ") r(i, rule, category, confidence) ON p_size % i = 0",
}
