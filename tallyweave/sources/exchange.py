"""JSON documents in and out: reports, plans, ledgers, results, schema documents; requests and claims that are read."""

from __future__ import annotations

import os
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyweave.functions import scalars as S
from tallyweave.sources import scans

#: Nulls are written, so that every key stands in every document.
WRITTEN = {"ignoreNullFields": "false"}
CONTEXT = {"@vocab": "urn:ir#", "id": "@id", "type": "@type"}
PARSE_MESSAGE = "REQUEST_UNREADABLE"
REQUEST = "id string, party string, launch bigint, points array<struct<lat: double, lon: double>>"


def to_text(value: Column) -> Column:
    return F.to_json(value, WRITTEN)


def gathered(rows: DataFrame, order: tuple[str, ...], *columns: str) -> Column:
    """The rows of a small table as an array, in a stated order."""
    listed = F.sort_array(F.collect_list(F.struct(*[F.col(c).alias(f"o{i}") for i, c in enumerate(order)], F.struct(*columns).alias("e"))))
    return F.transform(listed, lambda x: x["e"])


REPORT_TOTALS = ("vectors_total", "vectors_passed", "intentional_vectors", "violating_vectors", "total_violations", "bound", "secondary_bound")
REPORT_ORACLE = ("oracle", "kind", "evaluated", "violations", "intentional", "max_rel_error", "is_intentional")


def report_document(report: DataFrame) -> DataFrame:
    """A differential report as one document: totals, bounds, notes, and the oracles in order of their names.

    The notes say what a reader must know: violations, repairs, and that bounds hold for the drawn vectors only.
    """
    totals = report.groupBy(*REPORT_TOTALS).agg(gathered(report, ("oracle",), *REPORT_ORACLE).alias("oracles"))
    count = lambda c: F.col(c).cast("string")
    notes = F.array_compact(
        F.array(
            F.when(F.col("total_violations") > 0, F.concat(count("total_violations"), F.lit(" violations in "), count("violating_vectors"), F.lit(" vectors"))),
            F.when(F.col("intentional_vectors") > 0, F.concat(count("intentional_vectors"), F.lit(" vectors repaired on purpose"))),
            F.lit("bounds hold for vectors drawn alike"),
        )
    )
    return totals.select(to_text(F.struct(*REPORT_TOTALS, notes.alias("notes"), "oracles")).alias("doc"))


def read_report(docs: DataFrame) -> DataFrame:
    """The rows that a report document was made of, with its notes."""
    kinds = {"vectors_total": "bigint", "vectors_passed": "bigint", "intentional_vectors": "bigint", "violating_vectors": "bigint", "total_violations": "bigint", "bound": "double", "secondary_bound": "double"}
    oracle = "oracle: string, kind: string, evaluated: bigint, violations: bigint, intentional: bigint, max_rel_error: double, is_intentional: boolean"
    schema = ", ".join([*[f"{k} {v}" for k, v in kinds.items()], "notes array<string>", f"oracles array<struct<{oracle}>>"])
    return docs.select(F.from_json("doc", schema, {"mode": "FAILFAST"}).alias("d")).select("d.*").select(*REPORT_TOTALS, "notes", F.inline("oracles"))


def ledger_documents(entries: DataFrame, roots: DataFrame, chain: str) -> DataFrame:
    """Rows (chain, doc): a ledger's Merkle root, the number of its entries, and its entries in order of their numbers."""
    record = F.struct(F.col("seq").alias("sequence"), "action", "actor", F.col("payload_sha").alias("payloadSha256"), F.col("prev_hash").alias("prevHash"), F.col("entry_hash").alias("entryHash"))
    listed = entries.groupBy(chain).agg(F.sort_array(F.collect_list(F.struct(F.col("seq").alias("o"), record.alias("e")))).alias("l"))
    both = listed.join(roots.select(chain, "root"), chain)
    return both.select(chain, to_text(F.struct(F.col("root").alias("merkleRoot"), F.size("l").alias("entryCount"), F.transform("l", lambda x: x["e"]).alias("records"))).alias("doc"))


def read_ledgers(docs: DataFrame, chain: str) -> DataFrame:
    """The entries of ledger documents, with root and count; a document that is no ledger raises an error."""
    record = "sequence: bigint, action: string, actor: string, payloadSha256: string, prevHash: string, entryHash: string"
    parsed = F.from_json("doc", f"merkleRoot string, entryCount int, records array<struct<{record}>>", {"mode": "FAILFAST"})
    rows = docs.select(chain, parsed.alias("d")).select(chain, F.col("d.merkleRoot").alias("root"), F.col("d.entryCount").alias("n"), F.inline("d.records"))
    return rows.withColumnsRenamed({"sequence": "seq", "payloadSha256": "payload_sha", "prevHash": "prev_hash", "entryHash": "entry_hash"})


def plan_document(units: DataFrame, edges: DataFrame) -> DataFrame:
    """Units (unit, members, risk, position) and edges (src, dst, weight) as one document, edges in order of their ends."""
    u = units.agg(gathered(units, ("position",), "unit", "members", "risk", "position").alias("units"))
    e = edges.agg(gathered(edges, ("src", "dst"), "src", "dst", "weight").alias("edges"))
    # one row each
    return u.withColumn("one", F.lit(1)).join(e.withColumn("one", F.lit(1)), "one").select(to_text(F.struct("units", F.transform("units", lambda x: x["unit"]).alias("order"), "edges")).alias("doc"))


def read_plan(docs: DataFrame, member: str = "string") -> tuple[DataFrame, DataFrame]:
    unit, edge = f"unit: string, members: array<{member}>, risk: double, position: int", "src: string, dst: string, weight: bigint"
    parsed = docs.select(F.from_json("doc", f"units array<struct<{unit}>>, order array<string>, edges array<struct<{edge}>>", {"mode": "FAILFAST"}).alias("d"))
    return parsed.select(F.inline("d.units")), parsed.select(F.inline("d.edges"))


def bundle(**parts: Column) -> Column:
    """A document of named parts, each a row's column, in the order given."""
    return to_text(F.struct(*[c.alias(k) for k, c in parts.items()]))


def discovery_documents(modules: DataFrame, by: str) -> DataFrame:
    """Rows (by, doc) of modules (by, id, kind, complexity, risk): each group's modules in order, and counts by kind."""
    listed = modules.groupBy(by).agg(gathered(modules, ("id",), "id", "kind", "complexity", "risk").alias("modules"))
    kinds = modules.groupBy(by, "kind").agg(F.count("*").alias("n")).groupBy(by).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("kind", "n")))).alias("kinds"))
    return listed.join(kinds, by).select(by, bundle(modules=F.col("modules"), kinds=F.col("kinds")).alias("doc"))


def latent_document(classes: DataFrame) -> DataFrame:
    """Classes (tag, n) of latent defects as one document, with their total."""
    return classes.agg(to_text(F.struct(F.sum("n").alias("total"), gathered(classes, ("tag",), "tag", "n").alias("classes"))).alias("doc"))


def result_text(*fields: str) -> Column:
    """A result row as JSON, keys in the order given, nulls written."""
    return to_text(F.struct(*fields))


def ir_documents(nodes: DataFrame, version: str) -> DataFrame:
    """Rows (module, file, doc): schema nodes (module, layer, node_id, type, name) as JSON-LD, one file name for each module."""
    context = F.struct(*[F.lit(v).alias(k) for k, v in CONTEXT.items()])
    listed = nodes.groupBy("module").agg(gathered(nodes, ("layer", "node_id"), "layer", "node_id", "type", "name").alias("nodes"))
    return listed.select("module", F.concat(S.safe_name(F.col("module")), F.lit(".ir.json")).alias("file"), to_text(F.struct(context.alias("@context"), F.lit(version).alias("version"), "module", "nodes")).alias("doc"))


def write_documents(docs: DataFrame, base: str, folder: str, file: str = "file", doc: str = "doc") -> str:
    """Write documents below a base folder, each into the folder of its file name; a folder that leaves it is refused."""
    where = scans.guarded(base, folder)
    docs.select(F.col(file).alias("file"), F.col(doc).alias("doc")).write.mode("errorifexists").partitionBy("file").text(where)
    return where


def read_documents(spark: SparkSession, where: str) -> DataFrame:
    return spark.read.text(where, wholetext=True).select("file", F.regexp_replace("value", "\n$", "").alias("doc"))


def parse_request(text: Column) -> Column:
    """A request from JSON text: struct (ok, id, party, launch, n_points, message).

    Text that is no JSON object keeps what stands in it before the fault: the id, party and launch that are complete, and
    the number of complete points; missing ones are "", 0. The message is fixed.
    """
    ok = F.coalesce(F.get_json_object(text, "$").startswith("{"), F.lit(False))
    good = F.from_json(text, REQUEST)
    string = lambda k: F.regexp_extract(text, rf'"{k}"\s*:\s*"([^"\\]*)"', 1)
    number = F.regexp_extract(text, r'"launch"\s*:\s*(-?[0-9]+)\s*[,}]', 1)
    pick = lambda a, b: F.when(ok, a).otherwise(b)
    return F.struct(
        ok.alias("ok"),
        F.coalesce(pick(good["id"], string("id")), F.lit("")).alias("id"),
        F.coalesce(pick(good["party"], string("party")), F.lit("")).alias("party"),
        F.coalesce(pick(good["launch"], F.nullif(number, F.lit("")).cast("bigint")), F.lit(0)).alias("launch"),
        F.coalesce(pick(F.when(good["points"].isNotNull(), F.size(good["points"])), F.regexp_count(text, F.lit(r'\{"lat":[^{}]*\}'))), F.lit(0)).alias("n_points"),
        F.when(~ok, PARSE_MESSAGE).alias("message"),
    )


def parse_request_strict(text: Column) -> Column:
    """The older reading: on a fault only the id is kept, the rest are defaults."""
    full = parse_request(text)
    keep = lambda k, default: F.when(full["ok"], full[k]).otherwise(F.lit(default)).alias(k)
    return F.struct(full["ok"].alias("ok"), full["id"].alias("id"), keep("party", ""), keep("launch", 0), keep("n_points", 0), full["message"].alias("message"))


def claims_of(docs: DataFrame, doc: str = "doc") -> DataFrame:
    """Claims of JSON documents that hold them as an array ``claims``; a document without one gives no rows."""
    fields = "claim_id string, claim_text string, source string, claim_type string, status string, label string, evidence string"
    return docs.select(F.from_json(doc, f"claims array<struct<{fields.replace(' string', ': string')}>>").alias("d")).select(F.inline("d.claims"))


def find_above(start: str, *names: str, levels: int = 12) -> str:
    """The first folder, from a start upwards, that holds all of the names; raises where none does within so many levels."""
    at = os.path.abspath(start)
    for _ in range(levels + 1):
        if all(os.path.exists(os.path.join(at, n)) for n in names):
            return at
        at = os.path.dirname(at)
    raise FileNotFoundError(f"none of {levels} folders above {start} holds {', '.join(names)}")


def listed_files(spark: SparkSession, base: str, paths: list[str]) -> DataFrame:
    """Whole files of a stated list, named by their paths below the base, in the order of the list."""
    one = lambda i, p: spark.read.text(f"{base.rstrip('/')}/{p}", wholetext=True).select(F.lit(i).alias("place"), F.lit(p).alias("path"), F.col("value").alias("content"))
    out = reduce(DataFrame.unionByName, [one(i, p) for i, p in enumerate(paths)])
    return out.select("place", "path", scans.language_of(F.col("path")).alias("language"), "content", S.sha256(F.col("content")).alias("content_sha256"))


def options(argv: list[str], env: dict[str, str], known: dict[str, tuple[str, str]]) -> dict[str, str]:
    """Options from ``--name value``, ``--name=value`` or ``--name`` ("true"), else from the environment, else the default.

    ``known`` maps a name to its variable and default; a name that is not known is refused.
    """
    given, waiting = {}, None
    for word in argv:
        if word.startswith("--"):
            name, sep, value = word[2:].partition("=")
            if name not in known:
                raise ValueError(f"unknown option {word}")
            given[name], waiting = (value, None) if sep else ("true", name)
        elif waiting is None:
            raise ValueError(f"unknown option {word}")
        else:
            given[waiting], waiting = word, None
    return {k: given.get(k, env.get(variable, default)) for k, (variable, default) in known.items()}


def publish(requests: DataFrame, parents: DataFrame, children: DataFrame, enabled: bool) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Requests (id, party, points) appended to parents (id, party) and children (id, seq, lat, lon): both new tables, and messages.

    Set-based: all points go in one append. Publishing is off by default; a request whose id is there already is not
    published, and says so.
    """
    if not enabled:
        return parents, children, requests.select("id", F.lit("publishing is off").alias("message"))
    fresh = requests.join(parents.select("id"), "id", "left_anti")
    rows = fresh.select("id", F.posexplode("points").alias("seq", "p")).select("id", "seq", "p.lat", "p.lon")
    known = requests.select("id").join(fresh.select("id"), "id", "left_anti").select("id", F.lit("the id is there already").alias("message"))
    return parents.unionByName(fresh.select(*parents.columns)), children.unionByName(rows), known


def run_model(rows: DataFrame, model: Callable[[DataFrame], DataFrame], key: str, output: str) -> DataFrame:
    """Outputs of a model (DataFrame to DataFrame) by key; rows that it leaves out have a null output, so count as unparsed."""
    return rows.select(key).join(model(rows).select(key, output), key, "left")


def dispatch(tasks: DataFrame, recorded: DataFrame, mode: str) -> DataFrame:
    """Results of tasks by mode. Offline takes what was recorded; modes that call live models are refused here."""
    if mode.lower() != "offline":
        raise NotImplementedError(f"mode {mode} calls a live model")
    return scans.attach_recorded(tasks, recorded)
