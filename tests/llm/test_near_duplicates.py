"""Vectors and shingle sets against brute force, with nulls, copies, ties and clashing columns."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyweave.llm import common, shinglejoin, vectordedup


def components(nodes, links):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in links:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    return {n: find(n) for n in nodes}


# connected components


@pytest.mark.parametrize("seed", [1, 2])
def test_components(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(i, i + 1) for i in range(300, 340)] + [(500, 500 + i) for i in range(40)] + [(7, 7)]
    got, path = common.connected_components(spark.createDataFrame(edges, "a long, b long"))
    nodes = {x for e in edges if e[0] != e[1] for x in e}
    assert {r["node"]: r["component"] for r in got.collect()} == components(nodes, [e for e in edges if e[0] != e[1]])
    common.drop(spark, path)


def test_no_edges(spark):
    got, _ = common.connected_components(spark.createDataFrame([], "a long, b long"))
    assert got.count() == 0


# vectors


def unit(x):
    return x / np.linalg.norm(x)


def vector_rows(dim=64, seed=5):
    rng = np.random.default_rng(seed)
    rows, n = [], 0

    def add(v, label):
        nonlocal n
        rows.append((n, [float(x) for x in v], label))
        n += 1

    for label in (1, 2):
        for _ in range(40):
            base = rng.normal(size=dim)
            for _ in range(int(rng.integers(1, 6))):
                add(base + rng.normal(size=dim) * rng.uniform(0, 0.5), label)
    hub = rng.normal(size=dim)
    for _ in range(60):
        add(hub + rng.normal(size=dim) * 0.05, 1)
    for _ in range(30):
        add(hub, 1)  # exact copies
    add(hub, 2)
    add(hub * 3, 2)  # the same direction
    return rows


def brute(rows, least=0.93):
    links = {i: 0 for i, _, _ in rows}
    edges = []
    for a in range(len(rows)):
        for b in range(a):
            if rows[a][2] == rows[b][2] and unit(np.array(rows[a][1])) @ unit(np.array(rows[b][1])) >= least:
                links[rows[a][0]] += 1
                links[rows[b][0]] += 1
                edges.append((rows[a][0], rows[b][0]))
    return links, components([r[0] for r in rows], edges)


@pytest.mark.parametrize("block", [vectordedup.BLOCK, 16])
def test_vectors_against_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(vectordedup, "BLOCK", block)
    rows = vector_rows()
    links, place = brute(rows)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumns({"n_links": F.lit("clash"), "t": F.lit(0), "bucket": F.lit(1)})
    got = {r["vec_id"]: r for r in vectordedup.near_vectors(df).collect()}
    # float32 inputs: a pair within rounding of the threshold may go either way
    found, true = sum(r["n_links"] for r in got.values()), sum(links.values())
    assert found <= true + 4 and found >= 0.99 * true
    hub = [r[0] for r in rows if r[2] == 1][-90:]
    assert all(got[i]["n_links"] == links[i] and got[i]["component_id"] == place[i] for i in hub)
    exact = {r["vec_id"]: r["n_links"] for r in vectordedup.exact_links(df, df.where("vec_id % 20 = 0")).collect()}
    assert exact == {i: links[i] for i in links if i % 20 == 0}


def test_vectors_that_link_with_nothing(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, None, 1), (2, [], 1), (3, [0.0, 0.0], 1), (4, [1.0, None], 1), (5, [1.0, nan], 1), (6, [inf, 1.0], 1), (7, [1.0, 0.0], None), (8, [1.0, 0.0], 1), (9, [1.0, 0.0, 0.0], 1), (None, [1.0, 0.0], 1), (8, [1.0, 0.0], 1), (10, [5.0], 2), (11, [-5.0], 2)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = sorted(((r["vec_id"] or 0, r["n_links"], r["component_id"]) for r in vectordedup.near_vectors(df).collect()))
    assert len(got) == len(rows) and got[0] == (0, 0, None)
    assert [(i, n) for i, n, _ in got if n] == [(8, 1), (8, 1)]
    assert all(i == c for i, _, c in got[1:])


def test_no_vectors(spark):
    assert vectordedup.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


def test_hadamard():
    x = np.random.default_rng(1).normal(size=(5, 8))
    y = vectordedup.hadamard(x)
    assert np.allclose((y * y).sum(1), (x * x).sum(1)) and np.allclose(vectordedup.hadamard(y), x)
    for plan in vectordedup.PLANS:
        c = vectordedup.codes(x / np.linalg.norm(x, axis=1, keepdims=True), plan)
        assert c.shape == (5, *plan[1:]) and all(len(set(row)) == plan[2] for t in c for row in t)


def test_rotations_follow_the_vectors():
    assert [vectordedup.plan_for(n, 64)[0] for n in (0, 10**5, 10**6, 10**7, 10**8, 10**12)] == [2, 2, 3, 3, 4, 4]


@pytest.mark.parametrize("plan", vectordedup.PLANS)
@pytest.mark.parametrize("width", [64, 300])
def test_recall_at_the_threshold(plan, width):
    rng = np.random.default_rng(width)
    unit = lambda v: v / np.linalg.norm(v, axis=1, keepdims=True)
    x = unit(rng.normal(size=(600, width)))
    z = rng.normal(size=x.shape)
    y = 0.93 * x + np.sqrt(1 - 0.93**2) * unit(z - (z * x).sum(1, keepdims=True) * x)
    a, b = vectordedup.codes(x, plan), vectordedup.codes(y, plan)
    assert ((b == a[:, :, :1]).any((1, 2)) | (a == b[:, :, :1]).any((1, 2))).mean() >= 0.97


@pytest.mark.parametrize("plan", vectordedup.PLANS[1:])
def test_links_by_more_rotations(spark, monkeypatch, plan):
    monkeypatch.setattr(vectordedup, "PLANS", (plan,))
    df = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    found = {r["vec_id"]: r["n_links"] for r in vectordedup.near_vectors(df).collect()}
    exact = {r["vec_id"]: r["n_links"] for r in vectordedup.exact_links(df, df.where("vec_id % 20 = 0")).collect()}
    assert sum(found[i] for i in exact) >= 0.9 * sum(exact.values())


# shingles


def shingles(text, width):
    w = (text or "").encode().lower().split()
    return frozenset([tuple(w)] if 0 < len(w) < width else [tuple(w[i : i + width]) for i in range(len(w) - width + 1)])


def text_rows(seed=7, copies=300):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(300)]
    make = lambda n: [rng.choice(words) for _ in range(n)]
    edit = lambda t, k: [rng.choice(words) if rng.random() < k else w for w in t]
    rows = [" ".join(make(rng.randrange(1, 80))) for _ in range(60)]
    for _ in range(15):
        base = make(rng.randrange(20, 200))
        rows += [" ".join(edit(base, rng.choice([0, 0.005, 0.02, 0.05]))) for _ in range(rng.randrange(2, 6))]
    hot = make(120)
    rows += [" ".join(edit(hot, rng.choice([0.0, 0.004, 0.01, 0.03]))) for _ in range(copies)]  # one large group of near copies
    passage = make(30)
    rows += [" ".join(passage + make(rng.randrange(0, 12))) for _ in range(60)]  # a passage that many share
    rows += ["", None, " \t\n", "One", "one", "two words", "Two words", "TWO words", "É a b", "é a b"]
    return [(i, t) for i, t in enumerate(rows)]


@pytest.mark.parametrize("width,percent,block,hot", [(3, 90, 2048, 200), (5, 80, 2048, 200), (3, 90, 16, 10), (5, 80, 7, 10**6)])
def test_shingles_against_brute_force(spark, monkeypatch, width, percent, block, hot):
    monkeypatch.setattr(shinglejoin, "BLOCK", block)
    monkeypatch.setattr(shinglejoin, "HOT_CLASSES", hot)
    rows = text_rows()
    sets = {i: shingles(t, width) for i, t in rows}
    edges = []
    for a in sets:
        for b in range(a):
            o = len(sets[a] & sets[b])
            if o and 100 * o >= percent * (len(sets[a]) + len(sets[b]) - o):
                edges.append((a, b))
    place = components(sets, edges)
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"n": F.lit("clash"), "id": F.lit(3), "node": F.lit("x")})
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in shinglejoin.shingle_components(df.repartition(7), width=width, percent=percent).collect()}
    assert got == {i: (len(sets[i]), place[i]) for i in sets}


def test_shingle_rows_that_share_or_lack_ids(spark):
    a, b = " ".join(f"a{i}" for i in range(30)), " ".join(f"b{i}" for i in range(30))
    rows = [(5, a), (3, a), (5, b), (9, b), (None, a), (7, None), (7, None), (8, "solo text here")]
    got = sorted((r["doc_id"] or 0, r["n_shingles"], r["component_id"]) for r in shinglejoin.shingle_components(spark.createDataFrame(rows, "doc_id long, text string"), width=3, percent=90).collect())
    assert got == [(0, 28, None), (3, 28, 3), (5, 28, 3), (5, 28, 3), (7, 0, 7), (7, 0, 7), (8, 1, 8), (9, 28, 3)]


def test_a_text_behind_a_longer_one_of_the_same_id(spark):
    """Both texts of an id share all shingles with a third document, which is like the shorter one only."""
    part = {r["id"]: r["p"] for r in spark.range(20, 80).select("id", F.pmod(F.xxhash64("id"), F.lit(shinglejoin.LEADERS)).alias("p")).collect()}
    other = next(i for i in range(21, 80) if part[i] == part[20])  # of one part with it, so that only one of them leads
    short = " ".join(f"s{i}" for i in range(40))
    tail = " ".join(f"t{i}" for i in range(80))
    # the rest of the longer text is frequent, so that what both share is rare and stands in its prefix
    rows = [(20, short + " " + tail), (20, short), (other, short + " end")] + [(100 + i, f"{tail} x{i} y{i} z{i}") for i in range(12)]
    got = {(r["doc_id"], r["component_id"]) for r in shinglejoin.shingle_components(spark.createDataFrame(rows, "doc_id long, text string"), width=3, percent=90).collect()}
    assert {(20, 20), (other, 20)} <= got and (100, 100) in got


def test_very_long_texts(spark):
    rng = random.Random(9)
    words = [f"w{rng.randrange(10**6)}" for _ in range(200_000)]
    other = list(words)
    for i in range(0, len(other), 400):
        other[i] = "edited"
    rows = [(1, " ".join(words)), (2, " ".join(other)), (3, " ".join(words[:60_000])), (4, "short one here"), (5, "short one here")]
    got = sorted(tuple(r) for r in shinglejoin.shingle_components(spark.createDataFrame(rows, "doc_id long, text string"), width=3, percent=90).collect())
    assert [(i, c) for i, _, c in got] == [(1, 1), (2, 1), (3, 3), (4, 4), (5, 4)] and got[0][1] == len(shingles(rows[0][1], 3))


def test_stars_of_a_hub_and_a_chain(spark):
    edges = [(0, i) for i in range(1, 3000)] + [(10_000 + i, 10_001 + i) for i in range(60)] + [(5, 5), (1, 0), (20_000, 20_001)]
    found, path = common.connected_components(spark.createDataFrame(edges, "a long, b long"))
    got = {r["node"]: r["component"] for r in found.collect()}
    assert got == {**{i: 0 for i in range(3000)}, **{10_000 + i: 10_000 for i in range(61)}, 20_000: 20_000, 20_001: 20_000}
    common.drop(spark, path)


def test_no_texts(spark):
    assert shinglejoin.shingle_components(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    with pytest.raises(ValueError):
        shinglejoin.shingle_components(spark.createDataFrame([], "doc_id long, text string"), percent=100)


# writing


def test_small_partitions_are_put_together(spark):
    df = spark.range(1000).repartition(64)
    few = common.compacted(df)
    assert few.rdd.getNumPartitions() <= 2 * spark.sparkContext.defaultParallelism and sorted(r["id"] for r in few.collect()) == list(range(1000))
    out, path = common.written(df, "test")
    assert out.count() == 1000 and len(out.inputFiles()) <= 2 * spark.sparkContext.defaultParallelism
    common.drop(spark, path)


def test_a_worker_keeps_one_operator_at_a_time():
    kept = {"a": 1, "b": 1}
    common.keep_only("a", lambda: kept.pop("a"))
    common.keep_only("a", lambda: kept.pop("a"))
    common.keep_only("b", lambda: kept.pop("b"))
    assert kept == {"b": 1}
    common.keep_only("c", lambda: None)
    assert kept == {}
