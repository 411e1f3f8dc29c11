"""Queries over ledgers, gates, controls, claims, schemas and rendered documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyweave.operators import ledger as L
from tallyweave.operators import reporting as P
from tallyweave.plans import numeric, texts
from tallyweave.sources import render
from tallyweave.sources.tables import table


_FIELDS = ("conv_id", "turn", "role", "actor", "text")


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").withColumn("actor", F.concat(F.lit("conv:"), F.col("conv_id").cast("string")))


def _chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.append_chain(_turns(spark, sf_dir), *_FIELDS)


def ledger_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _chain(spark, sf_dir)


def ledger_head(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last hash of every chain, in the binding form and in the weaker one."""
    return L.heads(_turns(spark, sf_dir), *_FIELDS)


def ledger_verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chains of which every third had its second payload changed, and every fifth its third entry's link."""
    second = (F.pmod("conv_id", F.lit(3)) == 0) & (F.col("seq") == 1)
    third = (F.pmod("conv_id", F.lit(5)) == 0) & (F.col("seq") == 2)
    stored = _chain(spark, sf_dir)
    stored = stored.withColumn("payload_sha", F.when(second, F.reverse("payload_sha")).otherwise(F.col("payload_sha")))
    stored = stored.withColumn("prev_hash", F.when(third, F.reverse("prev_hash")).otherwise(F.col("prev_hash")))
    return L.verify_chain(stored, "conv_id")


def merkle_root(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    leaf = F.sha2(F.encode(F.coalesce("text", F.lit("")), "UTF-8"), 256)
    listed = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", leaf.alias("h")))).alias("l"))
    return listed.select("conv_id", L.merkle_root(F.transform("l", lambda e: e["h"])).alias("root"))


# The keys of the gates' evidence.
EVIDENCE = {
    "humanApproved": "true", "boundaryApproved": " TRUE ", "unitScope": "orders", "diffReviewed": "true", "rulesHonored": "true", "compiledClean": "yes",
    "oracleHarnessRuns": "true", "ruleF1": "0.85", "catoBundle": "true", "continuousWithinTolerance": "true", "catoDeltaReviewed": "true",
}


def _evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence for each gate, from the differential report and counts of documents."""
    report = numeric.diff_oracle_report(spark, sf_dir).where("kind = 'discrete'").agg(F.sum("violations").cast("string").alias("v"))
    fixed = F.create_map(*[F.lit(x) for kv in EVIDENCE.items() for x in kv])
    gates = F.array(*[F.lit(g) for g in (*P.GATES, "Unknown")])
    return report.select(F.explode(gates).alias("gate"), F.map_concat(fixed, F.create_map(F.lit("discreteViolations"), F.coalesce("v", F.lit("0")))).alias("evidence"))


def gate_eval(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.gate_decisions(_evidence(spark, sf_dir)).select("gate", "passed")


def gate_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The gates' decisions, appended to one chain."""
    rows = P.gate_decisions(_evidence(spark, sf_dir)).withColumns({"chain": F.lit("gates"), "action": F.lit("GateDecision"), "actor": F.concat(F.lit("gate:"), F.col("gate"))})
    return L.append_chain(rows, "chain", "gate", "action", "actor", "payload").select("chain", "seq", "action", "actor", "prev_hash", "entry_hash")


_RULE_OF = {"assigned-secret": "hardcoded-credentials", "inline-password": "hardcoded-credentials", "api-key": "hardcoded-credentials", "connection-string": "hardcoded-credentials"}


def _rule_of() -> F.Column:
    out = F.lit("certificate-validation")
    for name, rule in _RULE_OF.items():
        out = F.when(F.col("name") == name, rule).otherwise(out)
    return out


def _controls(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = texts.finding_disposition(spark, sf_dir).select(_rule_of().alias("rule"))
    scripted = texts.html_findings_first_line(spark, sf_dir).select(F.lit("output-encoding").alias("rule"))
    return P.control_evidence(found.unionByName(scripted))


def control_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _controls(spark, sf_dir).select("control_id", "control_name", F.array_join("evidence", "|").alias("evidence"))


_DEFECTS = ("Lines are rounded before they are summed.", "Units are truncated, not rounded.")


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings counted by rule and disposition, known defects, and latent defect classes."""
    found = texts.finding_disposition(spark, sf_dir).groupBy(F.col("name").alias("rule"), "severity", "disposition").agg(F.count("*").alias("n"))
    found = found.select("rule", "severity", "disposition", F.concat(F.col("disposition"), F.lit(": "), F.col("n").cast("string"), F.lit(" places")).alias("place"))
    defects = spark.range(1).select(F.explode(F.array(*[F.lit(d) for d in _DEFECTS])).alias("statement"))
    latent = numeric.latent_defects(spark, sf_dir).select("tag", F.col("divergent_vectors").alias("n"))
    return P.remediation_items(found, defects, latent)


def remediation_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _items(spark, sf_dir)


def _claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as claims: what they lack follows from their status, priority and price."""
    orders = table(spark, sf_dir, "orders")
    status = F.when(F.col("o_orderstatus") == "F", "A").when(F.col("o_orderstatus") == "O", "E").when(F.col("o_totalprice") > 400_000, "X").when(F.col("o_totalprice") > 50_000, "P")
    return orders.select(
        F.concat(F.when(F.col("o_orderpriority") == "5-LOW", "c").otherwise("C-"), F.col("o_custkey").cast("string")).alias("claim_id"),
        F.when(F.col("o_totalprice") > 20_000, "sums are exact").otherwise(" ").alias("claim_text"), F.nullif("o_orderpriority", F.lit("1-URGENT")).alias("source"), F.lit("quant").alias("claim_type"),
        status.alias("status"), F.when(F.col("o_totalprice") > 200_000, "preliminary").alias("label"), F.when(F.col("o_totalprice") > 90_000, "src/a.py:12").alias("evidence"),
    )


def claims_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.audit_claims(_claims(spark, sf_dir))


def claim_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = F.when(F.col("status").isin("A", "E", "P"), F.col("status")).otherwise("other")
    return _claims(spark, sf_dir).groupBy(known.alias("status")).agg(F.count("*").alias("n"))


#: What may follow an artifact's path.
TAILS = (":12", ":3-9", "#top", " (partial)", ":\u00a72.1", ":main()", "?x=1 ", "")


def clean_artifacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files named after parts, with a tail by their size."""
    tail = F.element_at(F.array(*[F.lit(t) for t in TAILS]), F.pmod("p_size", F.lit(len(TAILS))) + 1)
    rows = table(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit("results/"), F.col("p_name"), F.lit(".json"), tail).alias("path"))
    return rows.select("p_partkey", "path", P.clean_artifact(F.col("path")).alias("cleaned"))


def schema_ir(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.schema_document(table(spark, sf_dir, "embeddings"), "embeddings").unionByName(P.schema_document(table(spark, sf_dir, "orders"), "orders"))


def schema_ir_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    good = schema_ir(spark, sf_dir)
    bad = spark.createDataFrame([("orders", "orders.x", "NOTHING", "", True, "orders.none"), ("orders", "orders.o_orderkey", "VARIABLE", "o_orderkey", True, "orders")], good.schema)
    return P.schema_errors(good.unionByName(bad))


def render_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions as units with the flows between them."""
    from tallyweave.plans import graphs

    units = table(spark, sf_dir, "region").select(F.concat(F.lit("unit-"), F.col("r_regionkey").cast("string")).alias("id"), F.col("r_name").alias("name"), (F.col("r_regionkey") / 5.0).alias("risk"), (F.col("r_regionkey") + 1).alias("position"))
    edges = graphs.contract_edges(spark, sf_dir).select(F.concat(F.lit("unit-"), F.col("src").cast("string")).alias("src"), F.concat(F.lit("unit-"), F.col("dst").cast("string")).alias("dst"), "weight")
    return render.flow_chart(units, edges)


def render_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kinds of events as rules in Turtle; statements hold quotes, tabs, line breaks and backslashes."""
    share = F.col("n") / 8.0 - F.floor(F.col("n") / 8.0)
    rules = table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n")).select(
        F.concat(F.lit("rule-"), "event_type").alias("rule"), F.when(F.col("event_type") > "f", "Routing").otherwise("Constraint").alias("category"),
        F.concat(F.lit('say "'), "event_type", F.lit('"\tthen\\stop\n'), F.col("n").cast("string")).alias("statement"), share.alias("confidence"),
    )
    return render.turtle(rules)


def render_controls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return render.yaml_controls(_controls(spark, sf_dir))


def render_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return render.csv_items(_items(spark, sf_dir))


def bill_of_materials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The brands as parts of a product, each with the number of its members as version."""
    parts = table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("name")).agg(F.count("*").cast("string").alias("version"))
    return render.bill_of_materials(parts, "catalogue", "1.0.0", "catalogue|1.0.0")


_LINKS_SQL = """
WITH RECURSIVE t AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS seq, coalesce(role, '') AS action, 'conv:' || conv_id AS actor, sha256(coalesce(text, '')) AS payload_sha FROM conversations
), chain AS (
  SELECT t.*, 'GENESIS' AS prev_hash, sha256(concat_ws('|', seq, action, actor, payload_sha, 'GENESIS')) AS entry_hash, sha256(payload_sha || '|' || repeat('0', 64)) AS weak FROM t WHERE seq = 0
  UNION ALL
  SELECT t.*, c.entry_hash, sha256(concat_ws('|', t.seq, t.action, t.actor, t.payload_sha, c.entry_hash)), sha256(t.payload_sha || '|' || c.weak) FROM t JOIN chain c ON t.conv_id = c.conv_id AND t.seq = c.seq + 1
)"""
_FOUND_SQL = texts.ORACLES["finding_disposition"]
_CONTROLS_SQL = f"""
WITH d AS ({_FOUND_SQL}), fired AS (
  SELECT DISTINCT CASE WHEN name IN ('assigned-secret', 'inline-password', 'api-key', 'connection-string') THEN 'hardcoded-credentials' ELSE 'certificate-validation' END AS rule FROM d
  UNION SELECT DISTINCT 'output-encoding' FROM pages WHERE regexp_matches(html, '<script|innerHTML|\\.html\\(')
), catalog(rule, control_id) AS (VALUES {", ".join(f"('{r}', '{c}')" for r, cs in P.RULE_CONTROLS.items() for c in cs)}
), names(control_id, control_name) AS (VALUES {", ".join(f"('{k}', '{v}')" for k, v in P.CONTROL_NAMES.items())}
), e AS (
  SELECT control_id, rule AS evidence FROM fired JOIN catalog USING (rule) UNION SELECT * FROM (VALUES {", ".join(f"('{c}', '{e}')" for c, e in P.STANDING)})
), controls AS (SELECT control_id, any_value(control_name) AS control_name, string_agg(evidence, '|' ORDER BY evidence) AS evidence FROM e JOIN names USING (control_id) GROUP BY control_id)"""
_YAML = lambda c: f"""CASE WHEN regexp_matches({c}, '^$|^\\s|\\s$|[:#\\-{{}}\\[\\],&*!|>''"%@`]') THEN '"' || replace(replace({c}, '\\', '\\\\'), '"', '\\"') || '"' ELSE {c} END"""
_CSV = lambda c: f"""CASE WHEN regexp_matches({c}, '[,"\n\r]') THEN '"' || replace({c}, '"', '""') || '"' ELSE {c} END"""
_ITEMS_SQL = f"""
WITH found AS ({_FOUND_SQL}), s AS (
  SELECT name AS rule, severity, disposition, disposition || ': ' || count(*) || ' places' AS place FROM found GROUP BY name, severity, disposition
), latent AS ({numeric.ORACLES["latent_defects"]}), items AS (
  SELECT 'ITEM-S-' || lpad(CAST(row_number() OVER (ORDER BY rule, place) AS VARCHAR), 3, '0') AS id, '[' || rule || ' / ' || severity || '] ' || place || ' [disposition: ' || disposition || ']' AS weakness,
    CASE WHEN disposition = 'Remediated' THEN 'Remediated' ELSE 'Open' END AS status,
    CASE WHEN disposition = 'Remediated' THEN NULL WHEN disposition = 'OutOfScope' THEN 'Follow-on increment (out of scope)' ELSE 'Change-recommended' END AS schedule FROM s
  UNION ALL SELECT 'ITEM-C-' || lpad(CAST(row_number() OVER (ORDER BY x) AS VARCHAR), 3, '0'), x, 'Open', 'Change-recommended' FROM (VALUES {", ".join(f"('{d}')" for d in _DEFECTS)}) t(x)
  UNION ALL SELECT 'ITEM-L-' || lpad(CAST(row_number() OVER (ORDER BY tag) AS VARCHAR), 3, '0'), 'Latent defect class ''' || tag || ''': ' || divergent_vectors || ' divergent vectors', 'Open', 'Change-recommended' FROM latent
)"""
_FLOW_SQL = """
WITH e AS (
  SELECT 'unit-' || a.n_regionkey AS src, 'unit-' || b.n_regionkey AS dst, CAST(count(*) AS BIGINT) AS weight
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation a ON s_nationkey = a.n_nationkey JOIN nation b ON c_nationkey = b.n_nationkey
  WHERE a.n_regionkey <> b.n_regionkey GROUP BY 1, 2
), u AS (SELECT 'unit-' || r_regionkey AS id, r_name AS name, r_regionkey / 5.0::DOUBLE AS risk, r_regionkey + 1 AS position FROM region), l AS (
  SELECT 1 AS part, id AS key, '    ' || replace(id, '-', '_') || '["' || position || '. ' || name || '<br/>' || id || '<br/>risk=' || printf('%.3f', risk) || '"]' AS line FROM u
  UNION ALL SELECT 2, src || '>' || dst, '    ' || replace(src, '-', '_') || ' -->|"' || weight || '"| ' || replace(dst, '-', '_') FROM e
  UNION ALL SELECT 3, id, '    class ' || replace(id, '-', '_') || ' ' || CASE WHEN risk >= 0.66 THEN 'high' WHEN risk >= 0.40 THEN 'med' ELSE 'low' END || ';' FROM u
) SELECT 'flowchart LR' || chr(10) || string_agg(line, chr(10) ORDER BY part, key) || chr(10) AS doc FROM l"""

_CLAIMS_SQL = """
WITH c AS (
  SELECT CASE WHEN o_orderpriority = '5-LOW' THEN 'c' ELSE 'C-' END || o_custkey AS claim_id, o_totalprice > 20000 AS worded, o_orderpriority <> '1-URGENT' AS sourced,
    CASE WHEN o_orderstatus = 'F' THEN 'A' WHEN o_orderstatus = 'O' THEN 'E' WHEN o_totalprice > 400000 THEN 'X' WHEN o_totalprice > 50000 THEN 'P' END AS status,
    o_totalprice > 200000 AS labelled, o_totalprice > 90000 AS proven FROM orders
)"""
_GATES_SQL = f"""WITH r AS ({numeric.ORACLES["diff_oracle_report"]}), v AS (SELECT sum(violations) AS n FROM r WHERE kind = 'discrete')
SELECT gate, CASE gate WHEN 'KG1' THEN true WHEN 'KG2' THEN n = 0 WHEN 'Design' THEN true WHEN 'Translation' THEN false WHEN 'Acceptance' THEN n = 0 ELSE false END AS passed
FROM v, (VALUES ('KG1'), ('KG2'), ('Design'), ('Translation'), ('Acceptance'), ('Unknown')) g(gate)"""
_SCHEMA_SQL = """
WITH cols AS (SELECT table_name AS module, column_name AS name, data_type AS t, column_index AS i FROM duckdb_columns() WHERE table_name IN ('embeddings', 'orders')), nodes AS (
  SELECT module, module || '.' || name AS node_id, CASE WHEN t LIKE '%[]' THEN 'COLLECTION' WHEN t IN ('DOUBLE', 'FLOAT') THEN 'FLOATING_POINT' WHEN t = 'VARCHAR' THEN 'STRING_OP' WHEN t LIKE 'TIMESTAMP%' OR t = 'DATE' THEN 'DATE_TIME' ELSE 'VARIABLE' END AS type,
    name, true AS nullable, module AS parent FROM cols
)
"""

QUERIES = {
    "ledger_entries": ledger_entries,
    "ledger_head": ledger_head,
    "ledger_verify": ledger_verify,
    "merkle_root": merkle_root,
    "gate_eval": gate_eval,
    "gate_ledger": gate_ledger,
    "control_evidence": control_evidence,
    "remediation_items": remediation_items,
    "claims_audit": claims_audit,
    "claim_status": claim_status,
    "clean_artifacts": clean_artifacts,
    "schema_ir": schema_ir,
    "schema_ir_errors": schema_ir_errors,
    "render_flow": render_flow,
    "render_rules": render_rules,
    "render_controls": render_controls,
    "render_items": render_items,
    "bill_of_materials": bill_of_materials,
}
ORACLES = {
    "ledger_entries": _LINKS_SQL + "SELECT conv_id, seq, action, actor, payload_sha, prev_hash, entry_hash FROM chain",
    "ledger_head": _LINKS_SQL + "SELECT conv_id, arg_max(entry_hash, seq) AS head, count(*) AS n, arg_max(weak, seq) AS weak_head FROM chain GROUP BY conv_id",
    "ledger_verify": _LINKS_SQL
    + """, stored AS (
  SELECT conv_id, seq, action, actor, CASE WHEN conv_id % 3 = 0 AND seq = 1 THEN reverse(payload_sha) ELSE payload_sha END AS payload_sha,
    CASE WHEN conv_id % 5 = 0 AND seq = 2 THEN reverse(prev_hash) ELSE prev_hash END AS prev_hash, entry_hash FROM chain
), checked AS (
  SELECT *, coalesce(lag(entry_hash) OVER (PARTITION BY conv_id ORDER BY seq), 'GENESIS') AS expected, sha256(concat_ws('|', seq, action, actor, payload_sha, prev_hash)) AS again FROM stored
), r AS (SELECT *, CASE WHEN prev_hash <> expected THEN 'prevhash' WHEN entry_hash <> again THEN 'entryhash' END AS reason FROM checked)
SELECT conv_id, count(*) AS n, count(reason) = 0 AS valid, CAST(min(seq) FILTER (WHERE reason IS NOT NULL) AS INTEGER) AS first_break, arg_min(reason, seq) FILTER (WHERE reason IS NOT NULL) AS reason FROM r GROUP BY conv_id""",
    "merkle_root": """WITH RECURSIVE m AS (
  SELECT conv_id, list(sha256(coalesce(text, '')) ORDER BY turn) AS h FROM conversations GROUP BY conv_id
  UNION ALL
  SELECT conv_id, list_transform(range(0, CAST(ceil(len(h) / 2.0) AS BIGINT)), lambda i: sha256(h[2 * i + 1] || coalesce(h[2 * i + 2], h[2 * i + 1]))) FROM m WHERE len(h) > 1
) SELECT conv_id, h[1] AS root FROM m WHERE len(h) = 1""",
    "gate_eval": _GATES_SQL,
    "control_evidence": _CONTROLS_SQL + "SELECT control_id, control_name, evidence FROM controls",
    "remediation_items": _ITEMS_SQL + "SELECT id, weakness, status, schedule FROM items",
    "claims_audit": _CLAIMS_SQL
    + """, d AS (SELECT *, count(*) OVER (PARTITION BY claim_id) AS n FROM c), i AS (
  SELECT claim_id, unnest(list_filter([CASE WHEN n > 1 THEN 'duplicate claim_id' END, CASE WHEN claim_id[1] = 'c' THEN 'malformed claim_id' END, CASE WHEN NOT worded THEN 'missing claim_text' END, CASE WHEN NOT sourced THEN 'missing source' END,
    CASE WHEN status IS NULL THEN 'missing status' END, CASE WHEN status = 'X' THEN 'unknown status' END, CASE WHEN status = 'P' AND NOT labelled THEN 'status P without label' END, CASE WHEN status = 'A' AND NOT proven THEN 'status A without evidence' END], lambda x: x IS NOT NULL)) AS issue FROM d
) SELECT claim_id, issue FROM i""",
    "claim_status": _CLAIMS_SQL + " SELECT CASE WHEN status IN ('A', 'E', 'P') THEN status ELSE 'other' END AS status, count(*) AS n FROM c GROUP BY 1",
    "clean_artifacts": f"SELECT p_partkey, 'results/' || p_name || '.json' || {list(TAILS)!r}[CAST(p_size % 8 + 1 AS INTEGER)] AS path, 'results/' || p_name || '.json' AS cleaned FROM part",
    "gate_ledger": f"""WITH RECURSIVE g AS ({_GATES_SQL}), evidence AS (
  SELECT '{{' || string_agg('"' || k || '":"' || v || '"', ',' ORDER BY k) || '}}' AS json FROM (SELECT * FROM (VALUES {", ".join(f"('{k}', '{v}')" for k, v in EVIDENCE.items())}) t(k, v) UNION ALL SELECT 'discreteViolations', CAST(sum(violations) AS VARCHAR) FROM ({numeric.ORACLES["diff_oracle_report"]}) WHERE kind = 'discrete')
), e AS (
  SELECT gate, '{{"gate":"' || gate || '","passed":' || CAST(passed AS VARCHAR) || ',"evidence":' || (SELECT json FROM evidence) || '}}' AS payload FROM g
), r AS (SELECT row_number() OVER (ORDER BY gate) - 1 AS seq, 'GateDecision' AS action, 'gate:' || gate AS actor, sha256(payload) AS p FROM e), c AS (
  SELECT seq, action, actor, 'GENESIS' AS prev_hash, sha256(concat_ws('|', seq, action, actor, p, 'GENESIS')) AS entry_hash FROM r WHERE seq = 0
  UNION ALL SELECT r.seq, r.action, r.actor, c.entry_hash, sha256(concat_ws('|', r.seq, r.action, r.actor, r.p, c.entry_hash)) FROM r JOIN c ON r.seq = c.seq + 1
) SELECT 'gates' AS chain, * FROM c""",
    "schema_ir": _SCHEMA_SQL + "SELECT * FROM nodes",
    "schema_ir_errors": "SELECT * FROM (VALUES ('orders.x', 'unknown type'), ('orders.x', 'missing name'), ('orders.x', 'unknown parent'), ('orders.o_orderkey', 'repeated id'), ('orders.o_orderkey', 'repeated id')) t(node_id, error)",
    "render_rules": """WITH r AS (SELECT event_type AS e, count(*) AS n FROM events GROUP BY 1), b AS (
  SELECT 'rule-' || e AS rule, 'r:rule_' || e || ' a w:Rule ;' || chr(10) || '    w:category "' || CASE WHEN e > 'f' THEN 'Routing' ELSE 'Constraint' END || '" ;' || chr(10) || '    w:statement "say \\"' || e || '\\"\\tthen\\\\stop\\n' || n || '" ;' || chr(10)
    || '    w:confidence "' || printf('%.3f', n / 8.0::DOUBLE - floor(n / 8.0::DOUBLE)) || '" .' AS t FROM r
) SELECT '@prefix w: <urn:rules#> .' || chr(10) || '@prefix r: <urn:rule#> .' || chr(10) || chr(10) || string_agg(t, chr(10) || chr(10) ORDER BY rule) || chr(10) AS doc FROM b""",
    "render_flow": _FLOW_SQL,
    "render_controls": _CONTROLS_SQL
    + f""", y AS (SELECT control_id, control_name, list_transform(string_split(evidence, '|'), lambda x: '      - ' || {_YAML("x")}) AS l FROM controls)
SELECT 'controls:' || chr(10) || string_agg('  - id: ' || {_YAML("control_id")} || chr(10) || '    name: ' || {_YAML("control_name")} || chr(10) || '    evidence:' || chr(10) || array_to_string(l, chr(10)), chr(10) ORDER BY control_id) || chr(10) AS doc FROM y""",
    "render_items": _ITEMS_SQL
    + f"SELECT 'id,weakness,status,schedule' || chr(10) || string_agg({_CSV('id')} || ',' || {_CSV('weakness')} || ',' || {_CSV('status')} || ',' || {_CSV("coalesce(schedule, '')")}, chr(10) ORDER BY id) || chr(10) AS doc FROM items",
    "bill_of_materials": """WITH p AS (SELECT p_brand AS name, CAST(count(*) AS VARCHAR) AS version FROM part GROUP BY 1), h AS (SELECT sha256('catalogue|1.0.0') AS h)
SELECT '{"bomFormat":"CycloneDX","specVersion":"1.5","serialNumber":"urn:uuid:' || substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-' || substr(h, 13, 4) || '-' || substr(h, 17, 4) || '-' || substr(h, 21, 12)
  || '","version":1,"metadata":{"timestamp":"1970-01-01T00:00:00Z","component":{"type":"application","bom-ref":"catalogue","name":"catalogue","version":"1.0.0"}},"components":['
  || (SELECT string_agg('{"type":"library","bom-ref":"' || name || '@' || version || '","name":"' || name || '","version":"' || version || '","purl":"pkg:generic/' || name || '@' || version || '"}', ',' ORDER BY name, version) FROM p) || ']}' AS doc FROM h""",
}
