"""Orders, components and spectral splits of random graphs against sequential and dense versions."""

import heapq
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyweave.operators import graph as G
from tallyweave.operators import lineage
from tallyweave.operators import spectral as SP


def sequential(units, edges):
    """One heap over all units."""
    key = dict(units)
    waits, users = dict.fromkeys(key, 0), {i: [] for i in key}
    for s, d in set(edges):
        if s in key and d in key:
            waits[s] += 1
            users[d].append(s)
    needs = dict(waits)
    rank = lambda i: float("inf") if key[i] is None else key[i]
    ready = [(rank(i), needs[i], i) for i in key if not waits[i]]
    heapq.heapify(ready)
    order = []
    while ready:
        i = heapq.heappop(ready)[2]
        order.append(i)
        for j in users[i]:
            waits[j] -= 1
            if not waits[j]:
                heapq.heappush(ready, (rank(j), needs[j], j))
    return order + [i for _, i in sorted((rank(i), i) for i in key if i not in set(order))]


@pytest.mark.parametrize(("seed", "n", "m"), [(1, 60, 30), (2, 80, 120), (3, 40, 0), (4, 1, 1)])
def test_priority_order(spark, seed, n, m):
    rng = random.Random(seed)
    units = [(i, rng.choice([None, 0.0, 0.1, 0.5, 0.5, 0.9])) for i in rng.sample(range(1000), n)]
    ids = [i for i, _ in units] + [-1]
    edges = [(rng.choice(ids), rng.choice(ids)) for _ in range(m)]  # cycles, repeats, unknown ends, own ends
    edges = [(max(e), min(e)) if rng.random() < 0.9 else e for e in edges]
    got = G.priority_order(spark.createDataFrame(units, "id long, risk double"), spark.createDataFrame(edges, "src long, dst long"))
    assert [r["id"] for r in got.orderBy("position").collect()] == sequential(units, edges)
    assert sorted(r["position"] for r in got.collect()) == list(range(1, n + 1))


def test_order_of_nothing(spark):
    assert G.priority_order(spark.createDataFrame([], "id long, risk double"), spark.createDataFrame([], "src long, dst long")).collect() == []


def test_weak_components(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(150), rng.randrange(150)) for _ in range(90)] + [(i + 1, i) for i in range(200, 240)]
    place = {i: i for i in range(241)}
    for a, b in edges:
        x, y = place[a], place[b]
        place = {k: (min(x, y) if v in (x, y) else v) for k, v in place.items()}
    got = G.weak_components(spark.range(241), spark.createDataFrame(edges, "src long, dst long"))
    assert {r["id"]: r["component"] for r in got.collect()} == place


def test_numbering(spark):
    df = spark.range(5000).select("id", F.pmod(F.xxhash64("id"), F.lit(97)).alias("a")).repartition(7)
    got = lineage.numbered(df, F.desc("a"), "id").collect()
    want = sorted(((r["a"], r["id"]) for r in df.collect()), key=lambda x: (-x[0], x[1]))
    assert [(r["a"], r["id"]) for r in sorted(got, key=lambda r: r["position"])] == want
    assert sorted(r["position"] for r in got) == list(range(1, 5001))
    assert lineage.numbered(df.where("false"), "id").collect() == []


def graphs():
    rng = random.Random(8)
    path = [("path", i, i + 1, 1.0) for i in range(7)]
    two = [("two", i, j, 1.0 + rng.random()) for a in (range(0, 4), range(4, 9)) for i in a for j in a if i < j] + [("two", 2, 6, 0.3)]
    some = [("some", rng.randrange(10), rng.randrange(10), rng.random()) for _ in range(20)] + [("some", i, i + 1, 0.2) for i in range(9)]
    return [*path, *two, *some, ("one", 5, 5, 3.0), ("none", 1, 2, 0.0)]


def dense(rows, name):
    own = [r for r in rows if r[0] == name]
    nodes = sorted({x for r in own for x in r[1:3]})
    w = np.zeros((len(nodes), len(nodes)))
    for _, i, j, x in own:
        if i != j:
            w[nodes.index(i), nodes.index(j)] += x
            w[nodes.index(j), nodes.index(i)] += x
    return nodes, w


def test_sparse_vectors_against_dense_ones(spark, monkeypatch):
    monkeypatch.setattr(SP, "STEPS", 6)  # fewer than the nodes: some passes
    rows = graphs()
    got = {}
    for r in SP.sparse_fiedler(spark.createDataFrame(rows, "g string, i long, j long, w double"), "g").collect():
        got.setdefault(r["g"], {})[r["node"]] = (r["value"], r["eigenvalue"], r["residual"])
    assert set(got) == {"path", "two", "some", "one", "none"}
    for name in ("path", "two", "some"):
        nodes, w = dense(rows, name)
        v = SP.fiedler(w)
        mine = np.array([got[name][x][0] for x in nodes])
        lap = np.diag(w.sum(1)) - w
        value = got[name][nodes[0]][1]
        assert np.linalg.norm(lap @ mine - value * mine) < 1e-5 * np.linalg.norm(lap) and value == pytest.approx(np.linalg.eigvalsh(lap)[1], abs=1e-6)
        assert np.allclose(mine, v, atol=1e-4) and all((mine >= 0) == (v >= 0))
        assert all(r <= SP.RESIDUAL for _, _, r in got[name].values())
    assert {x: v for x, (v, _, _) in got["one"].items()} == {5: 0.0} and all(v == 0 for v, _, _ in [got["one"][5]])


def test_large_pieces_are_cut_by_the_sparse_way(spark, monkeypatch):
    df = spark.createDataFrame([r for r in graphs() if r[0] in ("two", "path")], "g string, i long, j long, w double")
    want = {(r["g"], r["node"]): r["cluster"] for r in SP.spectral_clusters(df, "g").collect()}
    monkeypatch.setattr(SP, "DENSE_NODES", 7)  # the first cut of both is sparse, their pieces are dense
    got = {(r["g"], r["node"]): r["cluster"] for r in SP.spectral_clusters(df, "g").collect()}
    assert got == want and {c[:1] for c in want.values()} == {"0", "1"}
