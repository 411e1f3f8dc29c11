"""Queries over documents written and read again, requests, claims, candidates that fail, and publishing."""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyweave.functions import scalars as S
from tallyweave.operators import differential as D
from tallyweave.operators import ledger as L
from tallyweave.operators import reporting as P
from tallyweave.operators import runner as M
from tallyweave.plans import governance, graphs, numeric
from tallyweave.plans import planning as N
from tallyweave.sources import exchange as E
from tallyweave.sources import scans
from tallyweave.sources.tables import table


def report_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The differential report through its document, with the number of notes."""
    back = E.read_report(E.report_document(numeric.diff_oracle_report(spark, sf_dir)))
    return back.select(*E.REPORT_ORACLE, *E.REPORT_TOTALS, F.size("notes").alias("n_notes"))


def _roots(entries: DataFrame) -> DataFrame:
    listed = entries.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("seq", "entry_hash"))).alias("l"))
    return listed.select("conv_id", L.merkle_root(F.transform("l", lambda e: e["entry_hash"])).alias("root"))


def ledger_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every chain through its document: root, count and entries, verified after reading."""
    entries = governance.ledger_entries(spark, sf_dir)
    back = E.read_ledgers(E.ledger_documents(entries, _roots(entries), "conv_id"), "conv_id")
    checked = L.verify_chain(back, "conv_id").select("conv_id", "valid")
    return back.join(checked, "conv_id").select("conv_id", "root", "n", "seq", "action", "actor", "payload_sha", "prev_hash", "entry_hash", "valid")


def gates_before_and_after(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ledger as it stands before the gates and after: the chain of decisions follows on what was written first."""
    first = spark.range(1).select(F.lit("run").alias("chain"), F.lit("0").alias("place"), F.lit("Discovery").alias("action"), F.lit("engine").alias("actor"), F.lit("report").alias("payload"))
    gates = P.gate_decisions(governance._evidence(spark, sf_dir))
    gates = gates.select(F.lit("run").alias("chain"), F.concat(F.lit("1"), "gate").alias("place"), F.lit("GateDecision").alias("action"), F.concat(F.lit("gate:"), "gate").alias("actor"), F.col("passed").cast("string").alias("payload"))
    stage = lambda name, rows: L.append_chain(rows, "chain", "place", "action", "actor", "payload").select(F.lit(name).alias("stage"), "seq", "action", "actor", "prev_hash", "entry_hash")
    return stage("before", first).unionByName(stage("after", first.unionByName(gates)))


def _units(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    nations = table(spark, sf_dir, "nation").groupBy(F.col("n_regionkey").alias("k")).agg(F.sort_array(F.collect_list("n_name")).alias("members"))
    units = nations.select(F.concat(F.lit("unit:"), F.col("k").cast("string")).alias("unit"), "members", (F.col("k") / 8.0).alias("risk"), (F.col("k") + 1).cast("int").alias("position"))
    edges = graphs.contract_edges(spark, sf_dir)
    return units, edges.select(F.concat(F.lit("unit:"), F.col("src").cast("string")).alias("src"), F.concat(F.lit("unit:"), F.col("dst").cast("string")).alias("dst"), "weight")


def plan_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Units and edges of a plan through its document, as rows of one table."""
    units, edges = E.read_plan(E.plan_document(*_units(spark, sf_dir)))
    a = units.select("unit", F.lit(None).cast("string").alias("dst"), F.array_join("members", ",").alias("members"), "risk", F.col("position").cast("bigint").alias("n"))
    return a.unionByName(edges.select(F.col("src").alias("unit"), "dst", F.lit(None).cast("string").alias("members"), F.lit(None).cast("double").alias("risk"), F.col("weight").alias("n")))


def discovery_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as modules: a document for each brand, read back as counts by type and a digest of ids."""
    modules = table(spark, sf_dir, "part").select("p_brand", F.col("p_partkey").alias("id"), F.col("p_type").alias("kind"), F.col("p_size").alias("complexity"), F.lit(None).cast("double").alias("risk"))
    docs = E.discovery_documents(modules, "p_brand")
    parsed = docs.select("p_brand", F.from_json("doc", "modules array<struct<id: bigint, kind: string, complexity: int, risk: double>>, kinds map<string, bigint>", {"mode": "FAILFAST"}).alias("d"))
    ids = F.array_join(F.transform("d.modules", lambda m: m["id"].cast("string")), ",")
    return parsed.select("p_brand", S.sha256(ids).alias("ids_sha256"), F.size("d.modules").alias("n"), F.inline(F.transform(F.map_entries("d.kinds"), lambda e: F.struct(e["key"].alias("kind"), e["value"].alias("n_kind")))))


def latent_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    doc = E.latent_document(numeric.latent_defects(spark, sf_dir).select("tag", F.col("divergent_vectors").alias("n")))
    parsed = doc.select(F.from_json("doc", "total bigint, classes array<struct<tag: string, n: bigint>>", {"mode": "FAILFAST"}).alias("d"))
    return parsed.select(F.col("d.total").alias("total"), F.inline("d.classes"))


def result_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as result texts, keys in a fixed order."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_orderstatus") == "F").alias("valid"), F.unix_timestamp(F.col("o_orderdate").cast("timestamp")).alias("est"), F.nullif("o_orderpriority", F.lit("5-LOW")).alias("message"))
    return orders.select("id", E.result_text("id", "valid", "est", "message").alias("doc"))


def ir_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Schema nodes of four layers as JSON-LD: fields, calls, rules and accesses of the dependency graph."""
    nodes = P.layered_nodes(P.schema_document(table(spark, sf_dir, "nation"), "nation table"), N.dependency_graph(spark, sf_dir), N.rule_statements(spark, sf_dir).select(F.col("event_type").alias("rule"), F.lit("Validation").alias("category"), "statement"))
    docs = E.ir_documents(nodes, "1.0")
    parsed = docs.select("module", "file", F.from_json("doc", "version string, nodes array<struct<layer: string, node_id: string, type: string, name: string>>", {"mode": "FAILFAST"}).alias("d"))
    return parsed.select("module", "file", F.inline("d.nodes")).groupBy("module", "file", "layer", "type").agg(F.count("*").alias("n"))


def _requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests as texts, one for each event; those of errors end early."""
    events = table(spark, sf_dir, "events")
    point = lambda k: F.concat(F.lit('{"lat":'), F.pmod(F.col("event_id") * k, F.lit(90)).cast("string"), F.lit(',"lon":'), F.pmod(F.col("user_id") * k, F.lit(180)).cast("string"), F.lit("}"))
    text = F.concat(
        F.lit('{"id":"E'), F.col("event_id").cast("string"), F.lit('","party":"'), F.col("event_type"), F.lit('","launch":'), (1_000_000_000 + F.col("event_id")).cast("string"),
        F.lit(',"points":['), point(3), F.lit(","), point(7), F.lit("]}"),
    )
    cut = F.substring(text, F.lit(1), (F.lit(5) + F.pmod(F.col("event_id"), F.lit(90))).cast("int"))
    return events.select("event_id", F.when(F.col("event_type") == "error", cut).otherwise(text).alias("text"))


def request_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both readings of requests: one keeps what stands before a fault, the older one only the id."""
    return _requests(spark, sf_dir).select("event_id", E.parse_request(F.col("text")).alias("r"), E.parse_request_strict(F.col("text")).alias("s")).select(
        "event_id", "r.ok", "r.id", "r.party", "r.launch", "r.n_points", "r.message", F.col("s.launch").alias("strict_launch"), F.col("s.n_points").alias("strict_points")
    )


def claims_in_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims that documents make, gathered into JSON by source and some ids, read again and audited."""
    docs = table(spark, sf_dir, "documents")
    status = F.when(F.col("lang") == "en", "A").when(F.col("lang") == "de", "E").when(F.col("lang") == "fr", "P").when(F.col("lang") == "es", "X")
    claim = F.struct(
        F.concat(F.when(F.col("n_chars") > 200, "C-").otherwise("c"), F.floor(F.col("doc_id") / 2).cast("string")).alias("claim_id"), F.col("text").alias("claim_text"), F.col("source").alias("source"),
        F.lit("quant").alias("claim_type"), status.alias("status"), F.when(F.col("n_chars") > 1000, "preliminary").alias("label"), F.when(F.col("n_chars") > 400, "doc.txt").alias("evidence"),
    )
    texts = docs.groupBy("source", F.floor(F.col("doc_id") / 100)).agg(E.to_text(F.struct(F.collect_list(claim).alias("claims"))).alias("doc"))
    return P.audit_claims(E.claims_of(texts)).groupBy("issue").agg(F.count("*").alias("n"))


def unparsed_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The differential report of a candidate that writes its results as texts, and cuts those of low priority short."""
    vectors = numeric._vectors(spark, sf_dir)
    text = F.concat(F.lit('{"id":"'), F.col("o_orderkey").cast("string"), F.lit('","valid":true,"est":'), F.col("cand_units").cast("string"), F.lit("}"))
    made = vectors.withColumn("text", F.when(F.col("o_orderpriority") == "5-LOW", F.substring(text, 1, 9)).otherwise(text))
    read = made.withColumn("result", scans.tolerant_result(F.col("text"))).withColumn("cand_units", F.col("result.est"))
    return D.report(read, numeric._oracles(), F.col("result.parsed"))


def _units_model(batch: pa.RecordBatch) -> pa.Array:
    """The candidate's units; it fails where it has no lines to divide by."""
    lines = batch.column("lines")
    return pc.multiply(pc.divide(batch.column("cand_units"), lines), lines) if not pc.all(pc.greater(lines, 0)).as_py() else batch.column("cand_units")


def failing_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Votes of a candidate model that raises for orders without lines: its output is null there, so nothing is parsed."""
    vectors = numeric._vectors(spark, sf_dir)
    ran = M.run_safely(vectors, _units_model, "long").withColumn("cand_units", F.col("output"))
    return D.vector_votes(ran, numeric._oracles(), "o_orderkey", F.col("error").isNull()).select("o_orderkey", "n_violations", "class", F.size("votes").alias("n_votes"))


def publish_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users' events as requests with points: those whose id is a nation's key are there already; rows by table."""
    points = F.sort_array(F.collect_list(F.struct(F.col("event_id").alias("o"), F.struct((F.col("value") * 1.0).alias("lat"), (F.col("value") * 2.0).alias("lon")).alias("p"))))
    requests = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("id")).agg(F.max("event_type").alias("party"), F.transform(points, lambda x: x["p"]).alias("points"))
    parents = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("bigint").alias("id"), F.col("n_name").alias("party"))
    children = spark.createDataFrame([], "id bigint, seq int, lat double, lon double")
    out = []
    for name, on in (("on", True), ("off", False)):
        p, c, m = E.publish(requests, parents, children, on)
        out += [d.agg(F.count("*").alias("n"), F.sum("id").alias("ids")).select(F.lit(f"{t}:{name}").alias("part"), "n", F.coalesce("ids", F.lit(0)).alias("ids")) for t, d in (("parents", p), ("children", c), ("messages", m))]
    got = out[0]
    for d in out[1:]:
        got = got.unionByName(d)
    return got


_ID = "regexp_extract(text, '\"id\"\\s*:\\s*\"([^\"\\\\]*)\"', 1)"
_REPORT = numeric.ORACLES["diff_oracle_report"]
_DOC_STATUS = "CASE lang WHEN 'en' THEN 'A' WHEN 'de' THEN 'E' WHEN 'fr' THEN 'P' WHEN 'es' THEN 'X' END"

QUERIES = {
    "report_round_trip": report_round_trip,
    "ledger_round_trip": ledger_round_trip,
    "gates_before_and_after": gates_before_and_after,
    "plan_round_trip": plan_round_trip,
    "discovery_documents": discovery_documents,
    "latent_round_trip": latent_round_trip,
    "result_documents": result_documents,
    "ir_documents": ir_documents,
    "request_parse": request_parse,
    "claims_in_json": claims_in_json,
    "unparsed_report": unparsed_report,
    "failing_model": failing_model,
    "publish_rows": publish_rows,
}
ORACLES = {
    "report_round_trip": f"SELECT *, CAST(1 + CAST(total_violations > 0 AS INT) + CAST(intentional_vectors > 0 AS INT) AS INTEGER) AS n_notes FROM ({_REPORT})",
    "ledger_round_trip": governance._LINKS_SQL
    + """, m AS (
  SELECT conv_id, list(entry_hash ORDER BY seq) AS h FROM chain GROUP BY conv_id
  UNION ALL
  SELECT conv_id, list_transform(range(0, CAST(ceil(len(h) / 2.0) AS BIGINT)), lambda i: sha256(h[2 * i + 1] || coalesce(h[2 * i + 2], h[2 * i + 1]))) FROM m WHERE len(h) > 1
) SELECT conv_id, h[1] AS root, CAST(count(*) OVER (PARTITION BY conv_id) AS INTEGER) AS n, seq, action, actor, payload_sha, prev_hash, entry_hash, true AS valid FROM chain JOIN (SELECT * FROM m WHERE len(h) = 1) USING (conv_id)""",
    "gates_before_and_after": f"""WITH RECURSIVE g AS ({governance.ORACLES["gate_eval"]}), t AS (
  SELECT 'run' AS chain, '0' AS place, 'Discovery' AS action, 'engine' AS actor, 'report' AS payload UNION ALL SELECT 'run', '1' || gate, 'GateDecision', 'gate:' || gate, CAST(passed AS VARCHAR) FROM g
), r AS (SELECT row_number() OVER (ORDER BY place) - 1 AS seq, action, actor, sha256(payload) AS p FROM t), c AS (
  SELECT seq, action, actor, 'GENESIS' AS prev_hash, sha256(concat_ws('|', seq, action, actor, p, 'GENESIS')) AS entry_hash FROM r WHERE seq = 0
  UNION ALL SELECT r.seq, r.action, r.actor, c.entry_hash, sha256(concat_ws('|', r.seq, r.action, r.actor, r.p, c.entry_hash)) FROM r JOIN c ON r.seq = c.seq + 1
) SELECT 'before' AS stage, * FROM c WHERE seq = 0 UNION ALL SELECT 'after', * FROM c""",
    "plan_round_trip": graphs._FLOWS_SQL
    + """SELECT 'unit:' || n_regionkey AS unit, NULL AS dst, string_agg(n_name, ',' ORDER BY n_name) AS members, n_regionkey / 8.0::DOUBLE AS risk, CAST(n_regionkey + 1 AS BIGINT) AS n FROM nation GROUP BY n_regionkey
UNION ALL SELECT 'unit:' || a.n_regionkey, 'unit:' || b.n_regionkey, NULL, NULL, CAST(sum(greatest(1, weight)) AS BIGINT) FROM flows JOIN nation a ON src = a.n_nationkey JOIN nation b ON dst = b.n_nationkey WHERE a.n_regionkey <> b.n_regionkey GROUP BY 1, 2""",
    "discovery_documents": """WITH b AS (SELECT p_brand, sha256(string_agg(CAST(p_partkey AS VARCHAR), ',' ORDER BY p_partkey)) AS ids_sha256, CAST(count(*) AS INTEGER) AS n FROM part GROUP BY 1)
SELECT p_brand, ids_sha256, any_value(n) AS n, p_type AS kind, count(*) AS n_kind FROM part JOIN b USING (p_brand) GROUP BY p_brand, ids_sha256, p_type""",
    "latent_round_trip": f"SELECT CAST(sum(divergent_vectors) OVER () AS BIGINT) AS total, tag, divergent_vectors AS n FROM ({numeric.ORACLES['latent_defects']})",
    "result_documents": """SELECT o_orderkey AS id, '{"id":' || o_orderkey || ',"valid":' || CAST(o_orderstatus = 'F' AS VARCHAR) || ',"est":' || CAST(epoch(o_orderdate) AS BIGINT) || ',"message":' || CASE WHEN o_orderpriority = '5-LOW' THEN 'null' ELSE '"' || o_orderpriority || '"' END || '}' AS doc FROM orders""",
    "ir_documents": f"""WITH {N._EDGES_SQL}, n AS (
  SELECT 'dataFlow' AS layer, unnest(['VARIABLE', 'STRING_OP', 'VARIABLE']) AS type UNION ALL SELECT 'controlFlow', 'SEQUENCE' FROM edges WHERE kind = 'Calls' UNION ALL SELECT 'infrastructure', 'DB_QUERY' FROM edges WHERE kind = 'DataAccess'
  UNION ALL SELECT 'businessLogic', 'VALIDATION' FROM (SELECT DISTINCT event_type FROM events)
) SELECT 'nation table' AS module, 'nation_table.ir.json' AS file, layer, type, count(*) AS n FROM n GROUP BY 3, 4""",
    "request_parse": f"""WITH t AS (
  SELECT event_id, event_type, '{{"id":"E' || event_id || '","party":"' || event_type || '","launch":' || (1000000000 + event_id) || ',"points":[{{"lat":' || (event_id * 3) % 90 || ',"lon":' || (user_id * 3) % 180 || '}},{{"lat":' || (event_id * 7) % 90 || ',"lon":' || (user_id * 7) % 180 || '}}]}}' AS text FROM events
), r AS (SELECT event_id, CASE WHEN event_type = 'error' THEN substr(text, 1, CAST(5 + event_id % 90 AS INTEGER)) ELSE text END AS text FROM t), p AS (
  SELECT event_id, coalesce(json_valid(text), false) AS ok, {_ID} AS id, {_ID.replace('"id"', '"party"')} AS party, coalesce(TRY_CAST(regexp_extract(text, '"launch"\\s*:\\s*(-?[0-9]+)\\s*[,}}]', 1) AS BIGINT), 0) AS launch,
    CAST(len(regexp_extract_all(text, '\\{{"lat":[^{{}}]*\\}}')) AS INTEGER) AS n_points FROM r
) SELECT *, CASE WHEN NOT ok THEN '{E.PARSE_MESSAGE}' END AS message, CASE WHEN ok THEN launch ELSE 0 END AS strict_launch, CAST(CASE WHEN ok THEN n_points ELSE 0 END AS INTEGER) AS strict_points FROM p""",
    "claims_in_json": f"""WITH c AS (
  SELECT CASE WHEN n_chars > 200 THEN 'C-' ELSE 'c' END || doc_id // 2 AS id, text AS t, source, {_DOC_STATUS} AS status, n_chars > 1000 AS label, n_chars > 400 AS evidence FROM documents
), d AS (SELECT *, count(*) OVER (PARTITION BY id) AS n FROM c), i AS (
  SELECT unnest(list_filter([CASE WHEN n > 1 THEN 'duplicate claim_id' END, CASE WHEN NOT regexp_matches(id, '^C-[A-Z0-9][A-Z0-9-]*$') THEN 'malformed claim_id' END, CASE WHEN coalesce(trim(t, ' '), '') = '' THEN 'missing claim_text' END,
    CASE WHEN coalesce(trim(source, ' '), '') = '' THEN 'missing source' END, CASE WHEN status IS NULL THEN 'missing status' END, CASE WHEN status = 'X' THEN 'unknown status' END,
    CASE WHEN status = 'P' AND NOT coalesce(label, false) THEN 'status P without label' END, CASE WHEN status = 'A' AND NOT coalesce(evidence, false) THEN 'status A without evidence' END], lambda x: x IS NOT NULL)) AS issue FROM d
) SELECT issue, count(*) AS n FROM i GROUP BY 1""",
    "unparsed_report": numeric.report_sql("o_orderpriority <> '5-LOW'"),
    "failing_model": numeric.votes_sql("lines > 0") + " SELECT o_orderkey, n_violations, class, n_votes FROM classes JOIN (SELECT o_orderkey, CAST(count(*) AS INTEGER) AS n_votes FROM votes GROUP BY 1) USING (o_orderkey)",
    "publish_rows": """WITH u AS (SELECT user_id AS id, count(*) AS k, user_id IN (SELECT n_nationkey FROM nation) AS known FROM events GROUP BY 1), n AS (SELECT count(*) AS n, sum(n_nationkey) AS ids FROM nation)
SELECT 'parents:on' AS part, n.n + count(*) FILTER (WHERE NOT known) AS n, CAST(n.ids + coalesce(sum(id) FILTER (WHERE NOT known), 0) AS BIGINT) AS ids FROM u, n GROUP BY n.n, n.ids
UNION ALL SELECT 'children:on', CAST(coalesce(sum(k) FILTER (WHERE NOT known), 0) AS BIGINT), CAST(coalesce(sum(id * k) FILTER (WHERE NOT known), 0) AS BIGINT) FROM u
UNION ALL SELECT 'messages:on', count(*) FILTER (WHERE known), CAST(coalesce(sum(id) FILTER (WHERE known), 0) AS BIGINT) FROM u
UNION ALL SELECT 'parents:off', n, CAST(ids AS BIGINT) FROM n UNION ALL SELECT 'children:off', 0, 0 UNION ALL SELECT 'messages:off', count(*), CAST(sum(id) AS BIGINT) FROM u""",
}
