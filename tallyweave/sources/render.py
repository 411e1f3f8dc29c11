"""Deterministic documents from small result tables: flow charts, Turtle, YAML, CSV, JSON, bills of material.

Each renderer gives one row with the whole text, lines in a stated order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyweave.functions import scalars as S

HIGH_RISK, MEDIUM_RISK = 0.66, 0.40


def document(lines: DataFrame, order: tuple[str, ...], line: Column, header: str = "", footer: str = "", separator: str = "\n") -> DataFrame:
    """One row ``doc``: header, the lines in order, footer."""
    listed = F.sort_array(F.collect_list(F.struct(*order, line.alias("__line"))))
    body = F.array_join(F.transform(listed, lambda e: e["__line"]), separator)
    return lines.agg(F.concat(F.lit(header), body, F.lit(footer)).alias("doc"))


def flow_chart(units: DataFrame, edges: DataFrame) -> DataFrame:
    """Units (id, name, risk, position) and edges (src, dst, weight) as a flow chart with classes by risk."""
    node = S.node_id(F.col("id"))
    risk = F.format_string("%.3f", F.col("risk"))
    label = F.concat(F.col("position").cast("string"), F.lit(". "), F.col("name"), F.lit("<br/>"), F.col("id"), F.lit("<br/>risk="), risk)
    level = F.when(F.col("risk") >= HIGH_RISK, "high").when(F.col("risk") >= MEDIUM_RISK, "med").otherwise("low")
    part = lambda n, key, text: (F.lit(n).alias("part"), key.alias("key"), text.alias("line"))
    quoted = F.replace(label, F.lit('"'), F.lit("&quot;"))
    a = units.select(*part(1, F.col("id"), F.concat(F.lit("    "), node, F.lit('["'), quoted, F.lit('"]'))))
    b = edges.select(*part(2, F.concat_ws(">", "src", "dst"), F.concat(F.lit("    "), S.node_id(F.col("src")), F.lit(' -->|"'), F.col("weight").cast("string"), F.lit('"| '), S.node_id(F.col("dst")))))
    c = units.select(*part(3, F.col("id"), F.concat(F.lit("    class "), node, F.lit(" "), level, F.lit(";"))))
    return document(a.unionByName(b).unionByName(c), ("part", "key"), F.col("line"), "flowchart LR\n", "\n")


def turtle(rules: DataFrame) -> DataFrame:
    """Rules (rule, category, statement, confidence) as Turtle."""
    field = lambda name, value: F.concat(F.lit(f"    w:{name} "), S.turtle_literal(value))
    text = F.concat(
        F.lit("r:"), F.regexp_replace("rule", r"[^\p{L}\p{N}]", "_"), F.lit(" a w:Rule ;\n"), field("category", F.col("category")), F.lit(" ;\n"),
        field("statement", F.col("statement")), F.lit(" ;\n"), field("confidence", F.format_string("%.3f", F.col("confidence"))), F.lit(" ."),
    )
    return document(rules, ("rule",), text, "@prefix w: <urn:rules#> .\n@prefix r: <urn:rule#> .\n\n", "\n", "\n\n")


def yaml_controls(controls: DataFrame) -> DataFrame:
    """Controls (control_id, control_name, evidence) as YAML."""
    items = F.array_join(F.transform("evidence", lambda e: F.concat(F.lit("      - "), S.yaml_scalar(e))), "\n")
    text = F.concat(F.lit("  - id: "), S.yaml_scalar(F.col("control_id")), F.lit("\n    name: "), S.yaml_scalar(F.col("control_name")), F.lit("\n    evidence:\n"), items)
    return document(controls, ("control_id",), text, "controls:\n", "\n")


def csv_items(items: DataFrame) -> DataFrame:
    """Items (id, weakness, status, schedule) as CSV, fields quoted only where they must be."""
    fields = [S.csv_field(F.coalesce(F.col(c), F.lit(""))) for c in ("id", "weakness", "status", "schedule")]
    return document(items, ("id",), F.concat_ws(",", *fields), "id,weakness,status,schedule\n", "\n")


def bill_of_materials(parts: DataFrame, name: str, version: str, seed: str) -> DataFrame:
    """Parts (name, version) as a CycloneDX document with a fixed time and a serial number from a seed."""
    entry = F.to_json(F.struct(F.lit("library").alias("type"), F.concat_ws("@", "name", "version").alias("bom-ref"), "name", "version", F.concat(F.lit("pkg:generic/"), F.col("name"), F.lit("@"), F.col("version")).alias("purl")))
    meta = F.to_json(
        F.struct(F.lit("1970-01-01T00:00:00Z").alias("timestamp"), F.struct(F.lit("application").alias("type"), F.lit(name).alias("bom-ref"), F.lit(name).alias("name"), F.lit(version).alias("version")).alias("component"))
    )
    listed = F.sort_array(F.collect_list(F.struct("name", "version", entry.alias("e"))))
    got = parts.agg(F.array_join(F.transform(listed, lambda x: x["e"]), ",").alias("components"))
    head = F.concat(F.lit('{"bomFormat":"CycloneDX","specVersion":"1.5","serialNumber":"urn:uuid:'), S.hash_uuid(F.lit(seed)), F.lit('","version":1,"metadata":'), meta)
    return got.select(F.concat(head, F.lit(',"components":['), F.col("components"), F.lit("]}")).alias("doc"))


def is_bill_of_materials(doc: Column) -> Column:
    """Whether a text is JSON with the marks of a CycloneDX document."""
    parsed = F.from_json(doc, "bomFormat string, specVersion string, components array<string>")
    return F.coalesce((parsed["bomFormat"] == "CycloneDX") & (parsed["specVersion"] != "") & parsed["components"].isNotNull(), F.lit(False))
