"""Controls, remediation items, gates, claim audits and schema documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyweave.functions import scalars as S
from tallyweave.operators.lineage import numbered

# Which control a kind of finding is evidence for.
CONTROL_NAMES = {
    "AU-10": "Non-repudiation",
    "CM-8": "System Component Inventory",
    "IA-5": "Authenticator Management",
    "SA-11": "Developer Testing and Evaluation",
    "SA-15": "Development Process, Standards, and Tools",
    "SC-13": "Cryptographic Protection",
    "SC-28": "Protection of Information at Rest",
    "SC-8": "Transmission Confidentiality and Integrity",
    "SI-10": "Information Input Validation",
    "SR-3": "Supply Chain Controls and Processes",
}
RULE_CONTROLS = {
    "sql-injection": ("SI-10", "SA-11"),
    "input-validation": ("SI-10",),
    "output-encoding": ("SI-10",),
    "hardcoded-credentials": ("IA-5", "SC-28"),
    "certificate-validation": ("SC-8", "SC-13"),
}
#: Controls that hold whenever the report is made, with their evidence.
STANDING = (("AU-10", "provenance.json"), ("CM-8", "sbom.json"), ("SA-15", "sbom.json"), ("SA-11", "findings-before.json"), ("SA-11", "findings-after.json"), ("SR-3", "sbom.json"))

# The gates and what their evidence must show.
GATES = ("KG1", "KG2", "Design", "Translation", "Acceptance")
# Node types of schema documents.
CONTROL_FLOW_TYPES = ("SEQUENCE", "BRANCH", "FOR_LOOP", "WHILE_LOOP", "DO_UNTIL", "SWITCH", "TRY_CATCH", "PARALLEL", "PIPELINE", "EVENT_HANDLER", "STATE_MACHINE", "COROUTINE")
BUSINESS_LOGIC_TYPES = ("RULE", "CONSTRAINT", "INVARIANT", "VALIDATION", "CALCULATION", "CLASSIFICATION", "ROUTING", "AUTHORIZATION", "AUDIT", "NOTIFICATION")
INFRASTRUCTURE_TYPES = ("FILE_IO", "DB_QUERY", "API_CALL", "MESSAGE_SEND", "MESSAGE_RECEIVE", "STREAM_PROCESS", "BATCH_JOB", "TIMER", "LOGGING", "CONFIGURATION")
DATA_FLOW_TYPES = ("VARIABLE", "CONSTANT", "PARAMETER", "RETURN_VALUE", "ASSIGNMENT", "ARITHMETIC", "COMPARISON", "CAST", "AGGREGATE", "COLLECTION", "RECORD", "FIXED_DECIMAL", "FLOATING_POINT", "STRING_OP", "DATE_TIME")


def rows_of(spark: SparkSession, columns: str, rows: list[tuple]) -> DataFrame:
    """A small constant table."""
    return spark.createDataFrame(rows, columns)


def control_evidence(findings: DataFrame, rule: str = "rule") -> DataFrame:
    """Rows (control_id, control_name, evidence sorted): rules that fired and standing evidence, by control."""
    spark = findings.sparkSession
    catalog = rows_of(spark, "rule string, control_id string", [(r, c) for r, cs in RULE_CONTROLS.items() for c in cs])
    names = rows_of(spark, "control_id string, control_name string", list(CONTROL_NAMES.items()))
    fired = findings.select(F.col(rule).alias("rule")).distinct().join(F.broadcast(catalog), "rule").select("control_id", F.col("rule").alias("evidence"))
    every = fired.unionByName(rows_of(spark, "control_id string, evidence string", list(STANDING)))
    got = every.groupBy("control_id").agg(F.sort_array(F.collect_set("evidence")).alias("evidence"))
    return got.join(F.broadcast(names), "control_id").select("control_id", "control_name", "evidence")


def with_ids(rows: DataFrame, prefix: str, *order: str) -> DataFrame:
    """The rows with an ``id`` of prefix and three digits at least, from 1 in the stated order, which is global."""
    return numbered(rows, *order, name="nr").withColumn("id", F.format_string(f"{prefix}-%03d", "nr")).drop("nr")


def remediation_items(findings: DataFrame, defects: DataFrame, latent: DataFrame) -> DataFrame:
    """Rows (id, weakness, status, schedule) of three sections.

    ``findings`` (rule, severity, place, disposition), ``defects`` (statement), ``latent`` (tag, n).
    """
    # Statuses and schedules of items; the weaknesses' wording is this library's own.
    done = F.col("disposition") == "Remediated"
    schedule = F.when(done, F.lit(None).cast("string")).when(F.col("disposition") == "OutOfScope", "Follow-on increment (out of scope)").otherwise("Change-recommended")
    text = F.concat(F.lit("["), F.col("rule"), F.lit(" / "), F.col("severity"), F.lit("] "), F.col("place"), F.lit(" [disposition: "), F.col("disposition"), F.lit("]"))
    s = with_ids(findings, "ITEM-S", "rule", "place", "severity", "disposition").select("id", text.alias("weakness"), F.when(done, "Remediated").otherwise("Open").alias("status"), schedule.alias("schedule"))
    c = with_ids(defects, "ITEM-C", "statement").select("id", F.col("statement").alias("weakness"), F.lit("Open").alias("status"), F.lit("Change-recommended").alias("schedule"))
    counted = F.concat(F.lit("Latent defect class '"), F.col("tag"), F.lit("': "), F.col("n").cast("string"), F.lit(" divergent vectors"))
    l = with_ids(latent, "ITEM-L", "tag").select("id", counted.alias("weakness"), F.lit("Open").alias("status"), F.lit("Change-recommended").alias("schedule"))  # noqa: E741
    return s.unionByName(c).unionByName(l)


def gate_passed(gate: Column, evidence: Column) -> Column:
    """Whether a gate's evidence (map of strings) lets it pass. Missing or malformed evidence, or an unknown gate: no."""
    v = lambda k: F.try_element_at(evidence, F.lit(k))
    yes = lambda *ks: [S.is_true(v(k)) for k in ks]
    number = lambda k, kind: F.trim(v(k)).try_cast(kind)
    every = lambda *cs: F.coalesce(F.forall(F.array(*cs), lambda c: c), F.lit(False))
    no_violation = F.coalesce(number("discreteViolations", "int") == 0, F.lit(False))
    # The keys of each gate's evidence.
    rules = {
        "KG1": every(F.coalesce(number("ruleF1", "double") >= 0.85, F.lit(False)), *yes("oracleHarnessRuns")),
        "KG2": every(no_violation, *yes("catoBundle")),
        "Design": every(*yes("humanApproved", "boundaryApproved"), S.given(v("unitScope"))),
        "Translation": every(*yes("humanApproved", "diffReviewed", "rulesHonored", "compiledClean")),
        "Acceptance": every(no_violation, *yes("humanApproved", "continuousWithinTolerance", "catoDeltaReviewed")),
    }
    out = F.lit(False)
    for name, rule in rules.items():
        out = F.when(gate == name, rule).otherwise(out)
    return out


def gate_decisions(gates: DataFrame) -> DataFrame:
    """Rows (gate, passed, payload): the payload is canonical, with keys in order, and goes to the ledger."""
    passed = gate_passed(F.col("gate"), F.col("evidence"))
    ordered = F.map_from_entries(F.array_sort(F.map_entries("evidence")))
    payload = F.to_json(F.struct("gate", passed.alias("passed"), ordered.alias("evidence")), {"ignoreNullFields": "false"})
    return gates.select("gate", passed.alias("passed"), payload.alias("payload"))


def clean_artifact(path: Column) -> Column:
    """An artifact's path without fragment, query, remark in parentheses and trailing line, section or call."""
    p = F.substring_index(F.substring_index(F.substring_index(path, "#", 1), "?", 1), " (", 1)
    return F.trim(F.regexp_replace(p, r":(?:\d+(?:-\d+)?|§[\w.\-]+|[A-Za-z_]+\(\))[^/:]*$", ""))


def audit_claims(claims: DataFrame) -> DataFrame:
    """Rows (claim_id, issue) for what is wrong with claims (claim_id, claim_text, source, claim_type, status, label, evidence)."""
    w = Window.partitionBy("claim_id")
    empty = lambda c: F.coalesce(F.trim(c) == "", F.lit(True))
    c = F.col
    known = F.coalesce(c("status").isin("A", "E", "P"), F.lit(False))
    checks = [
        (c("claim_id").isNotNull() & (F.count("*").over(w) > 1), "duplicate claim_id"),
        (~F.coalesce(c("claim_id").rlike("^C-[A-Z0-9][A-Z0-9-]*$"), F.lit(False)), "malformed claim_id"),
        (empty(c("claim_text")), "missing claim_text"),
        (empty(c("source")), "missing source"),
        (empty(c("status")), "missing status"),
        (~empty(c("status")) & ~known, "unknown status"),
        ((c("status") == "P") & empty(c("label")), "status P without label"),
        ((c("status") == "A") & empty(c("evidence")), "status A without evidence"),
    ]
    issues = F.array_compact(F.array(*[F.when(cond, F.lit(text)) for cond, text in checks]))
    return claims.select("claim_id", issues.alias("i")).select("claim_id", F.explode("i").alias("issue"))


def schema_document(df: DataFrame, module: str) -> DataFrame:
    """A data-flow node for every field of a schema, nested ones included: module, node_id, type, name, nullable, parent."""
    rows: list[tuple] = []

    def kind(t: T.DataType) -> str:
        names = {T.StructType: "RECORD", T.ArrayType: "COLLECTION", T.MapType: "COLLECTION", T.DecimalType: "FIXED_DECIMAL", T.DoubleType: "FLOATING_POINT", T.FloatType: "FLOATING_POINT", T.StringType: "STRING_OP", T.DateType: "DATE_TIME", T.TimestampType: "DATE_TIME", T.TimestampNTZType: "DATE_TIME"}
        return next((v for k, v in names.items() if isinstance(t, k)), "VARIABLE")

    def walk(t: T.DataType, parent: str) -> None:
        if isinstance(t, T.StructType):
            for f in t.fields:
                node = f"{parent}.{f.name}"
                rows.append((module, node, kind(f.dataType), f.name, f.nullable, parent))
                walk(f.dataType, node)
        elif isinstance(t, T.ArrayType):
            walk(t.elementType, f"{parent}[]")

    walk(df.schema, module)
    return rows_of(df.sparkSession, "module string, node_id string, type string, name string, nullable boolean, parent string", rows)


LAYERS = {"controlFlow": CONTROL_FLOW_TYPES, "dataFlow": DATA_FLOW_TYPES, "businessLogic": BUSINESS_LOGIC_TYPES, "infrastructure": INFRASTRUCTURE_TYPES}


def layered_nodes(fields: DataFrame, edges: DataFrame, rules: DataFrame) -> DataFrame:
    """Rows (module, layer, node_id, type, name): fields as data flow, calls as control flow, accesses, rules by category.

    ``fields`` comes from ``schema_document`` and names the module, ``edges`` has (src, dst, kind), ``rules`` (rule,
    category, statement). A category that is no type of a rule counts as RULE.
    """
    module = fields.select("module").limit(1)
    node = lambda layer, i, kind, name: (F.lit(layer).alias("layer"), i.alias("node_id"), kind.alias("type"), name.alias("name"))
    arrow = F.concat_ws("->", "src", "dst")
    known = F.when(F.upper("category").isin(*BUSINESS_LOGIC_TYPES), F.upper("category")).otherwise("RULE")
    parts = [
        fields.select(*node("dataFlow", F.col("node_id"), F.col("type"), F.col("name"))),
        edges.where("kind = 'Calls'").select(*node("controlFlow", arrow, F.lit("SEQUENCE"), F.col("dst"))),
        edges.where("kind = 'DataAccess'").select(*node("infrastructure", arrow, F.lit("DB_QUERY"), F.col("src"))),
        rules.select(*node("businessLogic", F.concat(F.lit("rule:"), "rule"), known, F.col("statement"))),
    ]
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    return rows.withColumn("one", F.lit(1)).join(F.broadcast(module.withColumn("one", F.lit(1))), "one").select("module", "layer", "node_id", "type", "name")  # one row


def layer_errors(nodes: DataFrame) -> DataFrame:
    """Rows (node_id, error) of layered nodes whose layer, or whose type within it, is not known, or that lack a name."""
    types = F.create_map(*[x for k, v in LAYERS.items() for x in (F.lit(k), F.array(*[F.lit(t) for t in v]))])
    allowed = F.try_element_at(types, F.col("layer"))
    wrong = [(allowed.isNull(), "unknown layer"), (F.coalesce(~F.array_contains(allowed, F.col("type")), F.lit(False)), "unknown type"), (~S.given(F.col("name")), "missing name")]
    return nodes.select("node_id", F.explode(F.array_compact(F.array(*[F.when(c, F.lit(t)) for c, t in wrong]))).alias("error"))


def schema_errors(nodes: DataFrame) -> DataFrame:
    """Rows (node_id, error) of nodes with an unknown type, an empty name, a repeated id or a parent that is none."""
    w = Window.partitionBy("node_id")
    ids = nodes.select(F.col("node_id").alias("__p")).distinct()
    known = nodes.withColumn("n", F.count("*").over(w)).join(ids, F.regexp_replace("parent", r"(\[\])+$", "") == F.col("__p"), "left")
    checks = [
        (~F.coalesce(F.col("type").isin(*DATA_FLOW_TYPES), F.lit(False)), "unknown type"),
        (~S.given(F.col("name")), "missing name"),
        (F.col("n") > 1, "repeated id"),
        (F.col("__p").isNull() & (F.regexp_replace("parent", r"(\[\])+$", "") != F.col("module")), "unknown parent"),
    ]
    return known.select("node_id", F.explode(F.array_compact(F.array(*[F.when(c, F.lit(t)) for c, t in checks]))).alias("error"))
