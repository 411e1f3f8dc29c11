"""Spectral bisection of many graphs at once.

A graph of at most ``DENSE_NODES`` nodes is cut in one task by a dense eigenvector, many graphs to a task. Beyond that the
vector of the second smallest eigenvalue of the Laplacian comes from Lanczos steps: a product of the sparse matrix with a
vector is one join and one sum, for all graphs together; each step is orthogonalised against the constant and all earlier
ones, and written. A row holds the steps' values of one node, so memory is linear in nodes and edges. Steps are taken anew
from the best vector so far until its residual is small enough.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyweave.operators.lineage import cut, drop

#: Nodes of a graph that is cut in one task: so many squared doubles.
DENSE_NODES = 512
#: Steps of a pass, passes at most, and the residual, as a share of the largest eigenvalue, at which a vector is good.
STEPS, PASSES, RESIDUAL = 24, 40, 1e-7


def fiedler(weights: np.ndarray) -> np.ndarray:
    """Eigenvector of the second smallest eigenvalue of the Laplacian; its first nonzero entry is positive."""
    n = len(weights)
    if n < 2 or not weights.any():
        return np.zeros(n)
    v = np.linalg.eigh(np.diag(weights.sum(1)) - weights)[1][:, 1]
    v[np.abs(v) < 1e-12] = 0.0
    first = v[np.flatnonzero(v)[:1]]
    return -v if len(first) and first[0] < 0 else v


def bisect(weights: np.ndarray) -> np.ndarray:
    """Sides 0 and 1 of the nodes by the vector's sign; a median split where all have one sign."""
    v = fiedler(weights)
    side = (v >= 0).astype(int)
    if len(v) > 1 and side.min() == side.max():
        side = np.zeros(len(v), int)
        side[np.argsort(v, kind="stable")[len(v) // 2 :]] = 1
    return side


def _smallest(pdf: pd.DataFrame) -> pd.DataFrame:
    """Coefficients of the smallest eigenvalue's vector of each graph's tridiagonal matrix, and the residual."""
    rows = pdf.sort_values("k")
    a, b = rows["alpha"].to_numpy(), rows["beta"].to_numpy()
    scale = max(np.abs(a).max(), np.abs(b).max(), 1e-300)
    m = int(np.flatnonzero(b < 1e-12 * scale)[0]) + 1 if (b < 1e-12 * scale).any() else len(a)  # the space is exhausted
    values, vectors = np.linalg.eigh(np.diag(a[:m]) + np.diag(b[: m - 1], 1) + np.diag(b[: m - 1], -1))
    s = vectors[:, 0]
    residual = 0.0 if m < len(a) else float(abs(b[m - 1] * s[-1])) / max(abs(values[-1]), 1e-300)
    return pd.DataFrame({"g": [rows["g"].iloc[0]], "s": [[*s, *([0.0] * (len(a) - m))]], "value": [values[0]], "residual": [residual]})


def sparse_fiedler(pairs: DataFrame, graph: str) -> DataFrame:
    """Rows (graph, node, value, eigenvalue, residual) of graphs given by rows (graph, i, j, w); pairs of a node with itself only name it.

    The residual is a share of the largest eigenvalue seen; a graph without weights has zeros. The entry of the smallest
    node that is not 0 is positive.
    """
    kind = dict(pairs.dtypes)
    own = pairs.select(F.col(graph).alias("g"), F.col("i").alias("u"), F.col("j").alias("v"), F.col("w").cast("double").alias("w"))
    both = own.where("u <> v").unionByName(own.where("u <> v").select("g", F.col("v").alias("u"), F.col("u").alias("v"), "w"))
    edges = cut(both.groupBy("g", "u", "v").agg(F.sum("w").alias("w")).where("w <> 0"))
    nodes = own.select("g", "u").unionByName(own.select("g", F.col("v").alias("u"))).distinct()
    degree = edges.groupBy("g", "u").agg(F.sum("w").alias("d"))
    start = F.pmod(F.xxhash64("g", "u"), F.lit(2**20)) / 2.0**19 - 1.0
    x = cut(nodes.join(degree, ["g", "u"], "left").select("g", "u", F.coalesce("d", F.lit(0.0)).alias("d"), start.alias("x")))
    steps = min(STEPS, x.groupBy("g").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 1)
    done = None
    for _ in range(PASSES):
        # a pass begins with a unit vector at a right angle to the constant
        mean = x.join(x.groupBy("g").agg(F.avg("x").alias("m")), "g").select("g", "u", "d", (F.col("x") - F.col("m")).alias("x"))
        unit = mean.join(mean.groupBy("g").agg(F.sqrt(F.sum(F.col("x") ** 2)).alias("size")), "g")
        basis = cut(unit.select("g", "u", "d", F.array(F.when(F.col("size") > 0, F.col("x") / F.col("size")).otherwise(0.0)).alias("q")))
        three, held = None, basis
        for k in range(steps):
            last = F.element_at("q", k + 1)
            product = edges.join(basis.select("g", F.col("u").alias("v"), last.alias("x")), ["g", "v"]).groupBy("g", "u").agg(F.sum(F.col("w") * F.col("x")).alias("s"))
            r = basis.join(product, ["g", "u"], "left").select("g", "u", "d", "q", (F.col("d") * last - F.coalesce("s", F.lit(0.0))).alias("r"))
            dots = F.array(*[F.sum(F.element_at("q", j + 1) * F.col("r")) for j in range(k + 1)])
            dots = r.groupBy("g").agg(F.avg("r").alias("m"), dots.alias("h"))
            less = F.aggregate(F.zip_with("h", "q", lambda h, q: h * q), F.lit(0.0), lambda a, b: a + b)
            left = cut(r.join(dots, "g").select("g", "u", "d", "q", F.element_at("h", k + 1).alias("alpha"), (F.col("r") - F.col("m") - less).alias("r")), held)
            norms = cut(left.groupBy("g").agg(F.lit(k).alias("k"), F.first("alpha").alias("alpha"), F.sqrt(F.sum(F.col("r") ** 2)).alias("beta")))
            three = norms if three is None else three.unionByName(norms)
            grown = F.concat("q", F.array(F.when(F.col("beta") > 1e-12 * F.abs("alpha"), F.col("r") / F.col("beta")).otherwise(0.0)))
            basis, held = left.drop("alpha").join(norms.drop("k"), "g").select("g", "u", "d", grown.alias("q")), left
        best = cut(three.groupBy("g").applyInPandas(_smallest, f"g {kind[graph]}, s array<double>, value double, residual double"))
        made = F.aggregate(F.zip_with("s", F.slice("q", 1, steps), lambda s, q: s * q), F.lit(0.0), lambda a, b: a + b)
        found = cut(basis.join(best, "g").select("g", "u", "d", made.alias("x"), "value", "residual"), held, x)
        good = cut(found.where(F.col("residual") <= RESIDUAL))
        done = good if done is None else done.unionByName(good)
        x = cut(found.where(F.col("residual") > RESIDUAL), found)
        if x.isEmpty():
            break
    else:
        done = done.unionByName(x)  # as good as it gets: the residual tells
    drop(edges)
    x = F.when(F.abs("x") < 1e-12, 0.0).otherwise(F.col("x"))
    done = done.withColumn("x", x)
    signs = done.where("x <> 0").groupBy("g").agg(F.signum(F.min_by("x", "u")).alias("sign"))
    signed = done.join(signs, "g", "left").select("g", "u", (F.col("x") * F.coalesce("sign", F.lit(1.0))).alias("x"), "value", "residual")
    return signed.select(F.col("g").alias(graph), F.col("u").alias("node"), F.col("x").alias("value"), F.col("value").alias("eigenvalue"), "residual")


def spectral_clusters(pairs: DataFrame, graph: str, depth: int = 2, leaf: int = 2) -> DataFrame:
    """Rows (graph, node, cluster): recursive bisection of each graph given by rows (graph, i, j, w).

    ``cluster`` is the path of sides, such as "01"; pieces of at most ``leaf`` nodes are not cut. A piece beyond
    ``DENSE_NODES`` nodes that has no weights at all is split by a hash.
    """
    kind = dict(pairs.dtypes)
    given = pairs.select(graph, "i", "j", F.col("w").cast("double").alias("w"))
    nodes = given.select(graph, "i").unionByName(given.select(graph, F.col("j").alias("i"))).distinct()
    every = given.where("i <> j").unionByName(nodes.select(graph, "i", F.col("i").alias("j"), F.lit(0.0).alias("w")))  # nodes without edges are named
    todo = cut(every.groupBy(graph, "i", "j").agg(F.sum("w").alias("w")).select(graph, F.lit("").alias("path"), "i", "j", "w"))
    parts = []

    def dense(rest: int):
        def split(pdf: pd.DataFrame) -> pd.DataFrame:
            nodes = sorted(set(pdf["i"]))
            at = {x: k for k, x in enumerate(nodes)}
            w = np.zeros((len(nodes), len(nodes)))
            for i, j, x in zip(pdf["i"], pdf["j"], pdf["w"], strict=True):
                w[at[i], at[j]] += x
                w[at[j], at[i]] += x
            path = [pdf["path"].iloc[0]] * len(nodes)

            def cut_up(own: np.ndarray, level: int) -> None:
                if level == rest or len(own) <= leaf:
                    return
                side = bisect(w[np.ix_(own, own)])
                for s in (0, 1):
                    for k in own[side == s]:
                        path[k] += str(s)
                    cut_up(own[side == s], level + 1)

            cut_up(np.arange(len(nodes)), 0)
            return pd.DataFrame({graph: pdf[graph].iloc[0], "node": nodes, "cluster": path})

        return split

    for level in range(depth):
        sizes = todo.where("i = j").groupBy(graph, "path").agg(F.count("*").alias("n"))
        large = sizes.where(F.col("n") > max(DENSE_NODES, leaf)).select(graph, "path")
        small = todo.join(large, [graph, "path"], "left_anti").groupBy(graph, "path")
        parts.append(cut(small.applyInPandas(dense(depth - level), f"{graph} {kind[graph]}, node {kind['i']}, cluster string")))
        todo = cut(todo.join(large, [graph, "path"], "left_semi"), todo)
        if todo.isEmpty():
            break
        piece = F.to_json(F.struct(graph, "path"))
        found = sparse_fiedler(todo.withColumn("piece", piece).select("piece", "i", "j", "w"), "piece")
        spread = found.groupBy("piece").agg(F.max(F.abs("value")).alias("most"))
        side = F.when(F.col("most") > 0, (F.col("value") >= 0).cast("int")).otherwise(F.pmod(F.xxhash64("node"), F.lit(2)).cast("int"))
        sides = cut(found.join(spread, "piece").select("piece", "node", side.cast("string").alias("side")))
        end = lambda c: sides.select("piece", F.col("node").alias(c), F.col("side").alias(f"{c}_side"))
        cut_up = todo.withColumn("piece", piece).join(end("i"), ["piece", "i"]).join(end("j"), ["piece", "j"]).where("i_side = j_side")
        todo = cut(cut_up.select(graph, F.concat("path", "i_side").alias("path"), "i", "j", "w"), todo, sides)
    out = todo.where("i = j").select(graph, F.col("i").alias("node"), F.col("path").alias("cluster"))
    for p in parts:
        out = out.unionByName(p)
    return out
