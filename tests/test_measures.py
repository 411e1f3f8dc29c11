"""Range joins, exact sums, models that fail, and reports against plain versions."""

import math
import random
import struct

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tallyweave.operators import differential as D
from tallyweave.operators import exact as X
from tallyweave.operators import ranges as R
from tallyweave.operators import runner as M

# range join


def range_rows(seed):
    rng = random.Random(seed)
    intervals = [(i, a := rng.uniform(-1000, 1000), a + rng.choice([0.0, 0.01, 1.0, 5.0, 40.0, 3000.0, -2.0])) for i in range(150)]
    intervals += [(900, None, 5.0), (901, 5.0, None), (902, 3.0, 3.0), (903, -1e12, 1e12), (904, 0.0, 1.0)]
    points = [rng.choice([rng.uniform(-1100, 1100), float(rng.randrange(-50, 50)), 7.0]) for _ in range(400)] + [None, 0.0, 1.0]
    return intervals, points


@pytest.mark.parametrize(("part", "limit"), [(100_000, 500_000), (20, 0)])
def test_points_in_intervals(spark, monkeypatch, part, limit):
    monkeypatch.setattr(R, "PART", part)
    monkeypatch.setattr(R, "MAX_BROADCAST_BINS", limit)
    intervals, points = range_rows(3)
    i, p = spark.createDataFrame(intervals, "id long, low double, high double"), spark.createDataFrame([(k, x) for k, x in enumerate(points)], "k long, x double")
    got = sorted((r["id"], r["k"]) for r in R.join_points(p, "x", i, "low", "high").collect())
    want = sorted((a, k) for a, lo, hi in intervals if lo is not None and hi is not None for k, x in enumerate(points) if x is not None and lo < x <= hi)
    assert got == want
    counts = {r["id"]: r["n"] for r in R.count_points(p, "x", i, "id", "low", "high").collect()}
    assert counts == {a: sum(w == a for w, _ in want) for a, _, _ in intervals}


def test_ranges_of_nothing(spark):
    i, p = spark.createDataFrame([(1, 2, 3)], "id long, low long, high long"), spark.createDataFrame([(3,)], "x long")
    assert R.join_points(p.where("false"), "x", i, "low", "high").count() == 0
    assert R.join_points(p, "x", i.where("false"), "low", "high").count() == 0
    assert [tuple(r) for r in R.count_points(p, "x", i, "id", "low", "high").collect()] == [(1, 1)]


# exact sums


def double_rows(seed):
    rng = random.Random(seed)
    out = []
    for g in range(40):
        kind = g % 5
        for _ in range(rng.randrange(1, 60)):
            x = {
                0: lambda: rng.uniform(-1, 1) * 10.0 ** rng.randrange(-300, 300), 1: lambda: rng.choice([1e16, -1e16, 1.0, 1e-16]), 2: lambda: struct.unpack("<d", rng.randbytes(8))[0],
                3: lambda: rng.choice([5e-324, -5e-324, 2.0**-1022, 2.0**-400, 2.0**-401, 1.0]), 4: lambda: 2.0 ** rng.randrange(-1074, 1000) * rng.choice([1, -1]),
            }[kind]()
            out.append((g, x if math.isfinite(x) else 0.0))
    return out


def test_exact_sums(spark):
    rows = double_rows(5)
    rows += [(100, None), (101, 0.0), (101, -0.0), (102, 1e308), (102, 1e308), (103, math.inf), (103, 1.0), (104, math.inf), (104, -math.inf), (105, math.nan), (106, -1e308), (106, -1e308), (None, 0.1), (None, 0.2)]
    by = {}
    for g, x in rows:
        by.setdefault(g, []).append(x)
    df = spark.createDataFrame(rows, "g long, x double")
    for parts in (1, 7):
        got = {r["g"]: r["total"] for r in X.exact_sum(df.repartition(parts), "x", "g").collect()}
        assert all(math.fsum(by[g]) == got[g] for g in range(40)) and got.keys() == by.keys()
        assert (got[100], got[101], got[102], got[103], got[106], got[None]) == (None, 0.0, math.inf, math.inf, -math.inf, math.fsum([0.1, 0.2])) and math.isnan(got[104]) and math.isnan(got[105])
    assert X.exact_sum(df.where("g < 40"), "x").collect()[0]["total"] == math.fsum(x for g, x in rows if g is not None and g < 40)
    assert X.exact_sum(df.where("false"), "x").collect()[0]["total"] is None


# models that fail


def test_rows_that_fail_are_told_apart(spark):
    calls = spark.sparkContext.accumulator(0)

    def model(batch):
        calls.add(1)
        if any(v in (17, 18, 500) for v in batch.column("id").to_pylist()):
            raise KeyError("bad row")
        return pa.array([v * 2 for v in batch.column("id").to_pylist()])

    got = {r["id"]: (r["output"], r["error"]) for r in M.run_safely(spark.range(0, 1000, 1, 2), model, "long").collect()}
    assert {i for i, (o, _) in got.items() if o is None} == {17, 18, 500}
    assert all(got[i] == (None, "KeyError: 'bad row'") for i in (17, 18, 500))
    assert all(v == (2 * i, None) for i, v in got.items() if i not in (17, 18, 500))
    assert calls.value < 80
    assert M.run_safely(spark.range(0), model, "long").collect() == []


def test_models_of_the_wrong_length_or_type(spark):
    short = M.run_safely(spark.range(4), lambda b: pa.array([1]), "long").collect()
    assert all(r["output"] == 1 and r["error"] is None for r in short)  # right for single rows
    wrong = M.run_safely(spark.range(3), lambda b: pa.array(["x"] * b.num_rows), "long").collect()
    assert all(r["output"] is None and r["error"].startswith("ArrowInvalid") for r in wrong)
    nulls = M.run_safely(spark.range(3), lambda b: pa.nulls(b.num_rows, pa.string()), "string").collect()
    assert all(r["output"] is None and r["error"] is None for r in nulls)


# reports


@pytest.mark.parametrize("parsed", [None, "ok"])
def test_report_equals_that_of_votes(spark, parsed):
    rng = random.Random(1)
    rows = [(i, rng.randrange(3), rng.randrange(3), rng.randrange(3), [1.0] * rng.randrange(3), [rng.choice([1.0, 2.0])] * rng.randrange(3), [2.0] * 2, rng.choice([True, False, None])) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, b long, c long, r long, bv array<double>, cv array<double>, rv array<double>, ok boolean")
    values = D.array_vote(F.col("bv"), F.col("cv"), F.col("rv"))
    oracles = [
        D.Oracle("a", "discrete", D.discrete_vote(F.col("b"), F.col("c"), F.col("r"))), D.Oracle("v", "continuous", values["vote"], values["rel"]),
        D.Oracle("p", "continuous", values["vote"], values["rel"], F.col("b") == 1), D.Oracle("never", "discrete", F.lit(0), None, F.lit(False)),
    ]
    read = F.col(parsed) if parsed else None
    plain = D.oracle_report(D.vector_votes(df, oracles, "id", read))
    assert sorted(map(tuple, D.report(df, oracles, read).collect()), key=repr) == sorted(map(tuple, plain.collect()), key=repr)
    assert {r["oracle"]: r["violations"] > 0 for r in plain.collect()} == {"a": True, "v": True, "p": True}


# draws


def test_gamma_draws_have_the_moments_of_their_shape(spark):
    from tallyweave.operators import scoring

    n = 20_000
    df = spark.range(n).select("id", F.explode(F.array(*[F.lit(x) for x in (0.3, 1.0, 2.5, 47.0, 1e6)])).alias("shape"))
    draw = scoring.gamma_sample(7, F.col("id").cast("string"), F.col("shape"))
    got = df.select("shape", draw.alias("x")).groupBy("shape").agg(F.avg("x").alias("mean"), F.var_samp("x").alias("var"), F.min("x").alias("least"), F.count("x").alias("n")).collect()
    for r in got:
        k = r["shape"]
        assert r["n"] == n and r["least"] > 0
        assert abs(r["mean"] - k) < 5 * math.sqrt(k / n) and abs(r["var"] / k - 1) < 5 * math.sqrt((2 + 6 / k) / n)
    once, again = (sorted(map(tuple, d.select("id", "shape", draw.alias("x")).collect())) for d in (df, df.repartition(5)))
    assert once == again
    share = spark.range(n).select(scoring.beta_sample(3, F.col("id").cast("string"), F.lit(2.0), F.lit(6.0)).alias("b")).agg(F.avg("b"), F.var_samp("b")).first()
    assert abs(share[0] - 0.25) < 0.005 and abs(share[1] - 0.25 * 0.75 / 9) < 0.001
