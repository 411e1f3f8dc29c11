"""Graph building, concerns, documents, requests, options and draws on small rows."""

import math
import os

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tallyweave.operators import differential as D
from tallyweave.operators import graph as G
from tallyweave.operators import planning as P
from tallyweave.operators import reporting as R
from tallyweave.operators import scoring as C
from tallyweave.operators import textscan as X
from tallyweave.sources import exchange as E
from tallyweave.sources import scans


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_edges_of_methods_and_types(spark):
    methods = spark.createDataFrame([("m1", "load", "A"), ("m2", "load", "B"), ("m3", "run", "A"), ("m4", "run", "C")], "id string, name string, type_id string")
    calls = spark.createDataFrame([("m3", "load"), ("m3", "run"), ("m3", "absent"), ("m3", "load")], "id string, called string")
    created = spark.createDataFrame([("m1", "Data.SqlCommand"), ("m2", "List"), ("m9", "DbCommand")], "id string, type_name string")
    edges = P.dependency_edges(methods, calls, created)
    got = rows(edges)
    assert [e for e in got if e[2] == "Calls"] == [("m3", "m1", "Calls"), ("m3", "m2", "Calls"), ("m3", "m4", "Calls")]
    assert [e for e in got if e[2] == "DataAccess"] == [("A", P.DATABASE, "DataAccess"), ("m1", P.DATABASE, "DataAccess")]
    assert {e[:2] for e in got if e[2] == "References"} == {("m1", "A"), ("m2", "B"), ("m3", "A"), ("m4", "C"), ("A", "B"), ("A", "C")}
    arcs = set(rows(P.coupling_arcs(edges, methods)))
    assert ("A", "m1") in arcs and ("m1", "A") in arcs and ("A", "B") in arcs and ("B", "A") not in arcs and not any(P.DATABASE in a for a in arcs)
    nodes = methods.select("id").unionByName(methods.select(F.col("type_id").alias("id")).distinct())
    units = {r["id"]: r for r in P.units_of(G.strong_components(nodes, P.coupling_arcs(edges, methods))).collect()}
    assert units["A"]["members"] == 3 and not units["A"]["cut"] and units["m2"]["unit"] == units["B"]["unit"]


def test_concerns(spark):
    members = spark.createDataFrame([("a", "x"), ("b", "x"), ("c", "Publish it"), ("d", "x")], "id string, name string")
    rules = spark.createDataFrame([("r1", "lead", ["a", "b", "z"]), ("r2", "two", ["b", "a"]), ("r3", "one", ["b"]), ("r4", None, ["d"])], "rule string, concern string, refs array<string>")
    fan = spark.createDataFrame([("a", 3), ("b", 3)], "id string, fan_out int")
    by_name = P.first_match(F.col("name"), (("out", ("publish",)),))
    got = P.assign_concerns(members, rules, fan, by_name, ("one", "two", "lead", "out"), "lead")
    assert rows(got) == [("a", "lead"), ("b", "one"), ("c", "out"), ("d", P.SHARED)]
    units = P.named_units(got, spark.createDataFrame([("a", 0.5), ("d", 0.9)], "id string, risk double"), ("one", "two", "lead", "out"), "out").collect()
    assert [(r["unit"], r["members"], r["risk"]) for r in units] == [("unit:one", ["b"], 0.0), ("unit:lead", ["a"], 0.5), ("unit:out", ["c", "d"], 0.9)]


def test_units_to_cut(spark):
    units = spark.createDataFrame([(i, "u", True) for i in range(6)] + [(9, "v", False), (10, "v", False)], "id int, unit string, cut boolean")
    tight = [(a, b, 3.0) for g in ((0, 1, 2), (3, 4)) for a in g for b in g if a < b] + [(2, 3, 0.25), (9, 10, 3.0)]
    got = dict(rows(P.cut_units(units, spark.createDataFrame(tight, "i int, j int, w double"), depth=1)))
    assert got[0] == got[1] == got[2] != got[3] == got[4] and {got[0], got[3]} == {"u/0", "u/1"} and got[5] == "u" and got[9] == got[10] == "v"


def test_labels_without_partners_raise(spark):
    v = spark.createDataFrame([(1, "a"), (2, "b")], "id int, x string")
    assert rows(scans.with_labels(v, spark.createDataFrame([(2, True), (1, False)], "id int, label boolean"), "id")) == [(1, "a", False), (2, "b", True)]
    for bad in ([(1, True)], [(1, True), (2, True), (3, True)]):
        with pytest.raises(Exception, match="no partner"):
            scans.with_labels(v, spark.createDataFrame(bad, "id int, label boolean"), "id").collect()


numbers = st.floats(min_value=-1e6, max_value=1e6, allow_nan=False)


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(numbers, numbers, numbers), min_size=1, max_size=40))
def test_votes_of_generated_numbers(spark, triples):
    """A candidate equal to the baseline is equivalent; a violation is never explained by the reference."""
    df = spark.createDataFrame([(*t, i) for i, t in enumerate(triples)], "b double, c double, r double, i int")
    votes = df.select("b", "c", "r", D.continuous_vote(F.col("b"), F.col("c"), F.col("r")).alias("v"), D.continuous_vote(F.col("b"), F.col("b"), F.col("r")).alias("same")).collect()
    error = lambda x, y: abs(x - y) / max(abs(x), abs(y), 1e-12)
    for x in votes:
        near = error(x["b"], x["c"]) <= 1e-9
        fixed = error(x["c"], x["r"]) <= 1e-9 < error(x["b"], x["r"])
        assert x["same"] == D.EQUIVALENT and x["v"] == (D.EQUIVALENT if near else D.INTENTIONAL if fixed else D.VIOLATION)


def test_words_tags_and_statements(spark):
    df = spark.createDataFrame([("A Price", ["EN"]), ("none", []), (None, None)], "t string, tags array<string>")
    got = df.select(P.first_match(F.col("t"), (("m", ("price",)), ("n", ("none", "price")))).alias("a"), P.has_tag(F.col("tags"), "en").alias("b"), P.statement_of(F.col("t"), {"NONE": "said"}, "?").alias("c")).collect()
    assert [tuple(r) for r in got] == [("m", True, "?"), ("n", False, "said"), (None, False, "?")]


def test_an_unreadable_candidate_violates_all_general_oracles(spark):
    df = spark.createDataFrame([(1, 1, 1, True), (2, 1, None, False), (3, 2, 1, None)], "id int, base int, cand int, parsed boolean")
    vote = D.discrete_vote(F.col("base"), F.col("cand"), F.col("base"))
    oracles = [D.Oracle(str(i), "discrete", vote) for i in range(8)] + [D.Oracle("p", "discrete", vote, None, F.lit(True))]
    got = {r["id"]: (r["n_violations"], len(r["votes"])) for r in D.vector_votes(df, oracles, "id", F.col("parsed")).collect()}
    assert got == {1: (0, 9), 2: (8, 8), 3: (8, 8)}
    model = lambda d: d.where("id = 1").select("id", F.lit("x").alias("o"))
    assert rows(E.run_model(df, model, "id", "o"))[1:] == [(2, None), (3, None)]


def test_matches_over_several_lines(spark):
    text = "a\nServer = db;\n  x\n Password = 1\npwd = 'abc'\npwd='d' pwd = 'ee'"
    df = spark.createDataFrame([(1, text), (2, None), (3, "\x01 pwd = 'q'")], "id int, text string")
    got = rows(X.whole_text_findings(df, "text", "id", X.SECRETS).select("id", "line_no", "name", "matched"))
    assert got == [(1, 2, "connection-string", "Server = db;\n  x\n Password ="), (1, 5, "inline-password", "pwd = 'abc'"), (1, 6, "inline-password", "pwd = 'ee'"), (1, 6, "inline-password", "pwd='d'"), (3, 1, "inline-password", "pwd = 'q'")]


def test_levels_that_stay_open_raise(spark):
    nodes, edges = spark.range(6).toDF("id"), spark.createDataFrame([(i + 1, i) for i in range(5)], "src long, dst long")
    assert rows(G.levels(nodes, edges)) == [(i, i) for i in range(6)] == rows(G.levels(nodes, edges, 6))
    with pytest.raises(RuntimeError):
        G.levels(nodes, edges, 3)


def test_requests(spark):
    texts = ['{"id":"a","party":"p","launch":5,"points":[{"lat":1,"lon":2}]}', '{"id":"a","party":"p","launch":5,"points":[{"lat":1,"lon":2},{"lat":1', '{"id":"a", "launch": 1', "", None, "[1]", "{}"]
    got = [tuple(r["r"]) for r in spark.createDataFrame([(t,) for t in texts], "t string").select(E.parse_request(F.col("t")).alias("r")).collect()]
    m = E.PARSE_MESSAGE
    assert got == [(True, "a", "p", 5, 1, None), (False, "a", "p", 5, 1, m), (False, "a", "", 0, 0, m), (False, "", "", 0, 0, m), (False, "", "", 0, 0, m), (False, "", "", 0, 0, m), (True, "", "", 0, 0, None)]
    old = spark.createDataFrame([(texts[1],)], "t string").select(E.parse_request_strict(F.col("t")).alias("r")).first()["r"]
    assert tuple(old) == (False, "a", "", 0, 0, m)


def test_options_and_folders(tmp_path, spark):
    known = {"mode": ("APP_MODE", "offline"), "fast": ("APP_FAST", "false"), "n": ("APP_N", "1")}
    assert E.options(["--fast", "--n", "3"], {"APP_MODE": "local", "APP_N": "9"}, known) == {"mode": "local", "fast": "true", "n": "3"}
    assert E.options(["--mode=a=b"], {}, known) == {"mode": "a=b", "fast": "false", "n": "1"}
    for bad in (["--other"], ["x"], ["--n", "1", "2"]):
        with pytest.raises(ValueError):
            E.options(bad, {}, known)
    deep = tmp_path / "a" / "b"
    deep.mkdir(parents=True)
    (tmp_path / "mark.json").write_text("{}")
    assert E.find_above(str(deep), "mark.json") == str(tmp_path)
    with pytest.raises(FileNotFoundError):
        E.find_above(str(deep), "mark.json", levels=1)
    (tmp_path / "x.cs").write_text("class X {}")
    assert [tuple(r)[:4] for r in E.listed_files(spark, str(tmp_path), ["x.cs", "mark.json"]).orderBy("place").collect()] == [(0, "x.cs", "csharp", "class X {}"), (1, "mark.json", "unknown", "{}")]
    for bad in ("../x", "/x", "a/../../x", "s3://x"):
        with pytest.raises(ValueError):
            scans.guarded(str(tmp_path), bad)


def test_documents_are_written_one_to_a_file(tmp_path, spark):
    docs = spark.createDataFrame([("a.json", '{"x":\n1}'), ("b.json", "{}")], "file string, doc string")
    where = E.write_documents(docs, f"file://{tmp_path}", "out/docs")
    assert rows(E.read_documents(spark, where)) == [("a.json", '{"x":\n1}'), ("b.json", "{}")] and os.path.isdir(tmp_path / "out" / "docs" / "file=a.json")
    with pytest.raises(Exception):
        E.read_ledgers(spark.createDataFrame([(1, "no json")], "chain int, doc string"), "chain").collect()


def test_gates_payload_is_json(spark):
    df = spark.createDataFrame([("KG1", {"b": 'x"y\\', "a": "1"})], "gate string, evidence map<string, string>")
    payload = R.gate_decisions(df).first()["payload"]
    assert payload == '{"gate":"KG1","passed":false,"evidence":{"a":"1","b":"x\\"y\\\\"}}'


def test_layers(spark):
    nodes = spark.createDataFrame([("controlFlow", "a", "BRANCH", "x"), ("dataFlow", "b", "BRANCH", "x"), ("other", "c", "RULE", "")], "layer string, node_id string, type string, name string")
    assert rows(R.layer_errors(nodes)) == [("b", "unknown type"), ("c", "missing name"), ("c", "unknown layer")]


@pytest.mark.parametrize("alpha,beta", [(3.0, 5.0), (0.5, 0.5), (2.7, 1.2), (47.0, 5.0)])
def test_beta_draws(spark, alpha, beta):
    n = 4000
    got = [r[0] for r in spark.range(n).select(C.beta_sample(1, F.col("id").cast("string"), F.lit(alpha), F.lit(beta))).collect()]
    mean, var = alpha / (alpha + beta), alpha * beta / ((alpha + beta) ** 2 * (alpha + beta + 1))
    assert all(0 <= x <= 1 for x in got) and abs(sum(got) / n - mean) < 6 * math.sqrt(var / n)
    assert abs(sum((x - mean) ** 2 for x in got) / n - var) < 0.15 * var


def test_dispatch(spark):
    tasks = spark.createDataFrame([("u", "l", "s")], "unit string, language string, stack string")
    with pytest.raises(NotImplementedError):
        E.dispatch(tasks, tasks, "Cloud")
    with pytest.raises(Exception, match="no record"):
        E.dispatch(tasks, spark.createDataFrame([], "key string, result string"), "Offline").collect()
