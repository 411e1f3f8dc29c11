"""Edge cases and properties of the library's operators."""

import hashlib
import math
import random

import pytest
from pyspark.sql import functions as F

from tallyweave.functions import scalars as S
from tallyweave.operators import differential as D
from tallyweave.operators import graph as G
from tallyweave.operators import spectral as SP
from tallyweave.operators import ledger as L
from tallyweave.operators import matching as M
from tallyweave.operators import ordered as O
from tallyweave.operators import reporting as P
from tallyweave.operators import scoring as R
from tallyweave.operators import textscan as X


def one(spark, *columns):
    return spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first()


# scalars


def test_relative_error_and_bounds(spark):
    lit = F.lit
    got = one(spark, S.relative_error(lit(0.0), lit(0.0)), S.relative_error(lit(1.0), lit(2.0)), S.upper_bound(lit(0), 0.95), S.upper_bound(lit(2000), 0.95))
    assert got[0] == 0.0 and got[1] == 0.5 and got[2] == math.inf
    assert got[3] == pytest.approx(math.log(20) / 2000)
    with pytest.raises(ValueError):
        S.upper_bound(lit(1), 1.0)


def test_wrap_keeps_both_ends(spark):
    got = one(spark, *[S.wrap_to_180(F.lit(x)) for x in (180.0, -180.0, 181.0, -181.0, 358.0)])
    assert list(got) == [180.0, -180.0, -179.0, 179.0, -2.0]


def test_half_even(spark):
    got = one(spark, *[S.half_even_div(F.lit(n).cast("bigint"), 100) for n in (50, 150, 250, 251, -50, -150, 0)])
    assert list(got) == [0, 2, 2, 3, 0, -2, 0]


def test_antimeridian_distance(spark):
    got = one(spark, S.flat_distance(*map(F.lit, (5.0, 179.0, 5.0, -179.0))), S.flat_distance(*map(F.lit, (5.0, 179.0, 5.0, -179.0)), wrapped=False))
    assert got[0] == pytest.approx(2 * math.radians(1) * math.cos(math.radians(5)) * S.EARTH_RADIUS_NM)
    assert got[1] > 100 * got[0]


def test_boundaries_do_not_depend_on_order(spark):
    b = lambda x, y: S.boundaries_between(F.lit(x).cast("bigint"), F.lit(y).cast("bigint"))
    assert list(one(spark, b(10**9 - 1, 10**9), b(10**9, 10**9 - 1), b(10**9, 10**9 + 1), b(0, 5 * 10**9))) == [1, 1, 0, 5]


def test_text_measures(spark):
    lit = F.lit
    got = one(spark, S.line_of(lit("a\nb\nc"), lit(4)), S.line_of(lit("a"), lit(-3)), S.line_of(lit("a\nb"), lit(99)), S.braces_balanced(lit("{(})")), S.braces_balanced(lit(")(")), S.braces_balanced(lit("")), S.braces_balanced(lit("{")))
    assert list(got) == [3, 1, 2, True, False, True, False]
    tokens, none = one(spark, S.tokens(lit("The box must be 22 x wide, WIDE a")), S.jaccard(F.array().cast("array<string>"), F.array().cast("array<string>")))
    assert sorted(tokens) == ["22", "box", "wide"] and none == 0.0


def test_quoting(spark):
    lit = F.lit
    got = one(spark, S.csv_field(lit('a"b')), S.csv_field(lit("plain")), S.turtle_literal(lit('q"\n\\')), S.yaml_scalar(lit("")), S.yaml_scalar(lit("a: b")), S.yaml_scalar(lit("plain")), S.node_id(lit("1-a")), S.slug(lit(" A b! ")))
    assert list(got) == ['"a""b"', "plain", '"q\\"\\n\\\\"', '""', '"a: b"', "plain", "u_1_a", "a-b"]


# differential


def votes(spark, base, cand, ref):
    b, c, r = (F.array(*map(F.lit, x)).cast("array<double>") for x in (base, cand, ref))
    return tuple(one(spark, D.array_vote(b, c, r))[0])


def test_votes(spark):
    v = lambda b, c, r: one(spark, D.discrete_vote(F.lit(b), F.lit(c), F.lit(r)))[0]
    assert [v(1, 1, 2), v(1, 2, 2), v(1, 2, 1), v(1, 2, 3)] == [D.EQUIVALENT, D.INTENTIONAL, D.VIOLATION, D.VIOLATION]
    w = lambda b, c, r: one(spark, D.continuous_vote(F.lit(b), F.lit(c), F.lit(r)))[0]
    assert [w(1.0, 1.0 + 1e-12, 5.0), w(1.0, 2.0, 2.0), w(1.0, 2.0, 1.0)] == [0, 1, 2]


def test_array_votes(spark):
    assert votes(spark, [], [], []) == (0, 0.0)
    assert votes(spark, [1.0], [1.0, 2.0], [1.0]) == (2, math.inf)
    assert votes(spark, [1.0, 2.0], [1.0, 4.0], [1.0, 4.0]) == (1, 0.5)
    assert votes(spark, [1.0, 2.0], [1.0, 4.0], [1.0])[0] == 2  # nothing to explain the second value


@pytest.mark.parametrize("shift,violations", [(0.0, 0), (1e-6, 1)])
def test_perturbation_is_caught(spark, shift, violations):
    rng = random.Random(1)
    rows = [(i, rng.uniform(1, 1e6)) for i in range(200)]
    df = spark.createDataFrame(rows, "id long, x double").withColumn("y", F.col("x") * (1 + F.when(F.col("id") == 77, shift).otherwise(0.0)))
    got = D.vector_votes(df, [D.Oracle("x", "continuous", D.continuous_vote(F.col("x"), F.col("y"), F.col("x")), S.relative_error(F.col("x"), F.col("y")))], "id")
    report = D.oracle_report(got).first()
    assert report["total_violations"] == violations and report["vectors_total"] == 200
    assert report["bound"] == (pytest.approx(math.log(20) / 200) if not violations else pytest.approx(1 / 200))


def test_oracle_without_rows_is_not_listed(spark):
    df = spark.createDataFrame([(1, 1)], "id long, x int")
    got = D.vector_votes(df, [D.Oracle("a", "discrete", D.discrete_vote(F.col("x"), F.col("x"), F.col("x"))), D.Oracle("b", "discrete", F.lit(2), None, F.col("x") > 5)], "id")
    assert [r["oracle"] for r in D.oracle_report(got).collect()] == ["a"]


def test_confusion_conventions(spark):
    df = spark.createDataFrame([(False, False)], "d boolean, e boolean")
    full, none = (D.confusion(df, F.col("d"), F.col("e"), v).first() for v in (1.0, 0.0))
    assert (full["precision"], full["recall"], full["f1"]) == (1.0, 1.0, 1.0) and (none["precision"], none["recall"], none["f1"]) == (0.0, 0.0, 0.0)


def test_composed_bound_refuses_negative_weights(spark):
    with pytest.raises(Exception, match="negative"):
        D.composed_bound(spark.createDataFrame([(-1, 0.1)], "w int, b double"), "w", "b").collect()


# ordered


def test_short_routes(spark):
    points = spark.createDataFrame([(1, 0, 0.0, 0.0), (2, 0, 1.0, 1.0), (2, 1, 1.0, 1.0), (3, 0, 0.0, 0.0), (3, 1, 30.0, 0.0)], "r int, s int, lat double, lon double")
    got = {x["r"]: x for x in O.route_decisions(O.legs(points, "r", "s"), "r").collect()}
    assert set(got) == {2, 3}  # one point makes no leg
    assert got[2]["total"] == 0.0 and got[2]["valid"] and got[2]["messages"] == []
    assert got[3]["messages"] == ["LEG_OUT_OF_BOX:0", "ROUTE_INVALID"]


def test_ordered_sum_has_the_bits_of_a_loop(spark):
    rng = random.Random(2)
    rows = [(i % 7, i, rng.uniform(-1e9, 1e9)) for i in range(500)]
    df = spark.createDataFrame(rows, "k int, o int, x double").repartition(5)
    for r in df.groupBy("k").agg(O.ordered_sum(F.col("x"), "o").alias("s")).collect():
        total = 0.0
        for k, _, x in rows:
            total = total + x if k == r["k"] else total
        assert r["s"] == total


def test_look_ahead(spark):
    df = spark.createDataFrame([(1, i, i == 0, i == 5) for i in range(8)], "k int, o int, a boolean, b boolean")
    got = lambda n: df.select("o", O.within_next(F.col("a"), F.col("b"), n, F.col("k"), F.col("o")).alias("hit")).where("hit").count()
    assert got(6) == 1 and got(5) == 0


# text


def test_findings_dispositions(spark):
    docs = spark.createDataFrame([(1, "uses MD5 here\n// RC4 in a comment\nRC4 and MD5"), (2, "clean"), (3, None)], "id int, text string")
    found = X.findings(docs, "text", "id", X.ALGORITHMS, skip_comments=True)
    assert {(r["id"], r["line_no"], r["name"]) for r in found.collect()} == {(1, 1, "MD5"), (1, 3, "MD5"), (1, 3, "RC4")}
    after = found.where("name = 'RC4'")
    out = {(r["line_no"], r["name"]): r["disposition"] for r in X.dispositions(found, after, "name", F.col("line_no") < 3).collect()}
    assert out == {(1, "MD5"): "Remediated", (3, "MD5"): "OutOfScope", (3, "RC4"): "OutOfScope"}


def test_first_lines(spark):
    docs = spark.createDataFrame([(1, "// innerHTML = x\na\nb.innerHTML = y\ninnerHTML = z")], "id int, text string")
    assert tuple(X.first_lines(docs, "text", "id", X.HTML_BUILDING).first()) == (1, 3, 2)


# matching


def test_greedy_equals_the_sequential_rule(spark):
    rng = random.Random(3)
    rows = [("c", l, r, rng.choice([0.2, 0.3, 0.4, 0.5])) for l in range(30) for r in range(30) if rng.random() < 0.2]  # noqa: E741
    left, right, expected = set(), set(), set()
    for _, l, r, j in sorted(rows, key=lambda x: (-x[3], x[1], x[2])):  # noqa: E741
        if l not in left and r not in right:
            left.add(l), right.add(r), expected.add((l, r))
    got = M.greedy_match(spark.createDataFrame(rows, "category string, l_id int, r_id int, jaccard double"), "category")
    assert {(r["l_id"], r["r_id"]) for r in got.collect()} == expected


# scoring


def test_risk_range_and_ties(spark):
    lit = F.lit
    big = R.risk(lit(1e9), lit(1e9), lit(1.0), lit(-5.0), lit(1e9), lit("vb6"), lit(1e9), lit(1e9))
    assert one(spark, big, R.criticality(lit(0.95), lit(100.0)))[1] == 1.0
    assert 0.99 <= one(spark, big)[0] <= 1.0
    df = spark.createDataFrame([(1, "b"), (1, "a"), (2, "a"), (2, "a"), (2, "b")], "k int, e string")
    assert {tuple(r) for r in R.majority(df, "k", "e", {"b": 0, "a": 1}).collect()} == {(1, "b", 1), (2, "a", 2)}


def test_routing(spark):
    agents = spark.createDataFrame([("x", True, 2.0, 8.0, {"a": 1.0}), ("y", False, 80.0, 20.0, {"a": 1.0})], "agent string, sovereign boolean, alpha double, beta double, weights map<string, double>")
    tasks = spark.createDataFrame([(str(i), {"a": 1.0}) for i in range(200)], "task string, features map<string, double>")
    first = R.thompson_routes(tasks, agents, 7).collect()
    assert sum(r["agent"] == "y" for r in first) > 190
    assert sorted(map(tuple, first)) == sorted(map(tuple, R.thompson_routes(tasks.repartition(3), agents, 7).collect()))
    assert {r["agent"] for r in R.thompson_routes(tasks, agents, 7, sovereign_only=True).collect()} == {"x"}
    with pytest.raises(ValueError):
        R.thompson_routes(tasks, agents.where("not sovereign"), 7, sovereign_only=True)


# graph


def random_graph(n, m, seed):
    rng = random.Random(seed)
    return [(rng.randrange(n), rng.randrange(n)) for _ in range(m)]


def test_strong_components_by_reachability(spark):
    n, edges = 25, random_graph(25, 35, 4)
    reach = {i: {i} for i in range(n)}
    for _ in range(n):
        for a, b in edges:
            for i in range(n):
                if a in reach[i]:
                    reach[i] |= reach[b]
    expected = {i: min(j for j in range(n) if j in reach[i] and i in reach[j]) for i in range(n)}
    nodes = spark.range(n).select(F.col("id"))
    got = G.strong_components(nodes, spark.createDataFrame(edges, "src long, dst long"))
    assert {r["id"]: r["component"] for r in got.collect()} == expected


def test_levels_and_order(spark):
    edges = [(3, 1), (3, 2), (2, 1), (4, 3), (6, 7), (7, 6)]
    nodes = spark.createDataFrame([(i,) for i in range(1, 8)], "id long")
    arcs = spark.createDataFrame(edges, "src long, dst long")
    assert {r["id"]: r["level"] for r in G.levels(nodes, arcs).collect()} == {1: 0, 5: 0, 2: 1, 3: 2, 4: 3, 6: None, 7: None}
    order = {r["id"]: r["position"] for r in G.priority_order(nodes.withColumn("risk", 1.0 / F.col("id")), arcs).collect()}
    assert sorted(order.values()) == list(range(1, 8))
    assert all(order[d] < order[s] for s, d in edges[:4]) and {order[6], order[7]} == {6, 7}
    assert order[5] == 1  # the least risk of the ready ones


def test_spectral_communities(spark):
    pairs = [(1, i, j, 1.0) for a in (range(0, 5), range(5, 11)) for i in a for j in a if i < j] + [(1, 0, 5, 0.01)]
    got = SP.spectral_clusters(spark.createDataFrame(pairs, "g int, i int, j int, w double"), "g", depth=1)
    sides = {}
    for r in got.collect():
        sides.setdefault(r["cluster"], set()).add(r["node"])
    assert sorted(map(sorted, sides.values())) == [list(range(5)), list(range(5, 11))]


def test_degenerate_spectral():
    import numpy as np

    assert list(SP.fiedler(np.zeros((3, 3)))) == [0, 0, 0] and len(SP.fiedler(np.zeros((1, 1)))) == 1
    assert sorted(SP.bisect(np.zeros((4, 4)))) == [0, 0, 1, 1]


def test_contract_and_affinity(spark):
    edges = spark.createDataFrame([(1, 2, "Calls", 0), (1, 3, "Calls", 2), (1, 9, "Calls", 5)], "src int, dst int, kind string, weight int")
    units = spark.createDataFrame([(1, "a"), (2, "b"), (3, "b")], "id int, unit string")
    assert [tuple(r) for r in G.contract(edges, units).collect()] == [("a", "b", 3)]
    labels = spark.createDataFrame([(1, "x"), (2, "x")], "id int, label string")
    assert {tuple(r) for r in G.affinity(labels, edges.where("dst = 2")).collect()} == {(1, 2, 4.0)}


# ledger


def chain(n):
    prev, out = L.GENESIS, []
    for i in range(n):
        p = hashlib.sha256(f"p{i}".encode()).hexdigest()
        h = hashlib.sha256("|".join([str(i), "act", "me", p, prev]).encode()).hexdigest()
        out.append((1, i, "act", "me", p, prev, h))
        prev = h
    return out


COLUMNS = "k int, seq long, action string, actor string, payload_sha string, prev_hash string, entry_hash string"


def test_chain_of_bytes(spark):
    rows = spark.createDataFrame([(1, i, "act", "me", f"p{i}") for i in range(5)], "k int, o int, action string, actor string, payload string")
    got = L.append_chain(rows, "k", "o", "action", "actor", "payload").orderBy("seq").collect()
    assert [tuple(r) for r in got] == chain(5)


@pytest.mark.parametrize("at,field,value,reason", [(2, 4, "x", "entryhash"), (3, 5, "x", "prevhash"), (1, 1, 9, "sequence"), (None, 0, None, None)])
def test_first_break(spark, at, field, value, reason):
    rows = chain(5)
    if at is not None:
        rows[at] = tuple(value if i == field else v for i, v in enumerate(rows[at]))
    got = L.verify_chain(spark.createDataFrame(rows, COLUMNS), "k").first()
    assert got["valid"] == (at is None) and got["reason"] == reason


def merkle(leaves):
    while len(leaves) > 1:
        leaves = [hashlib.sha256((leaves[i] + leaves[min(i + 1, len(leaves) - 1)]).encode()).hexdigest() for i in range(0, len(leaves), 2)]
    return leaves[0] if leaves else ""


@pytest.mark.parametrize("n", [0, 1, 2, 3, 7, 9])
def test_merkle(spark, n):
    leaves = [hashlib.sha256(str(i).encode()).hexdigest() for i in range(n)]
    array = F.array(*map(F.lit, leaves)).cast("array<string>")
    assert one(spark, L.merkle_root(array))[0] == merkle(leaves)
    rows = spark.createDataFrame(list(enumerate(leaves)), "i long, h string")
    assert L.merkle_root_of_rows(rows, "i", "h") == merkle(leaves)


# gates and reports


@pytest.mark.parametrize(
    "gate,evidence,passed",
    [
        ("KG1", {"ruleF1": "0.85", "oracleHarnessRuns": " True "}, True),
        ("KG1", {"ruleF1": "0.8499", "oracleHarnessRuns": "true"}, False),
        ("KG1", {"oracleHarnessRuns": "true"}, False),
        ("KG2", {"discreteViolations": "0", "catoBundle": "true"}, True),
        ("KG2", {"discreteViolations": "none", "catoBundle": "true"}, False),
        ("Design", {"humanApproved": "true", "boundaryApproved": "true", "unitScope": "  "}, False),
        ("Translation", {}, False),
        ("Unknown", {"humanApproved": "true"}, False),
    ],
)
def test_gates_fail_closed(spark, gate, evidence, passed):
    df = spark.createDataFrame([(gate, evidence)], "gate string, evidence map<string, string>")
    assert df.select(P.gate_passed(F.col("gate"), F.col("evidence"))).first()[0] is passed


def test_schema_document(spark):
    df = spark.createDataFrame([], "a int, b struct<c: array<double>, d: decimal(5, 2)>")
    nodes = P.schema_document(df, "m")
    assert {(r["node_id"], r["type"]) for r in nodes.collect()} == {("m.a", "VARIABLE"), ("m.b", "RECORD"), ("m.b.c", "COLLECTION"), ("m.b.d", "FIXED_DECIMAL")}
    assert P.schema_errors(nodes).count() == 0
