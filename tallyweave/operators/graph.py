"""Dependency graphs as two DataFrames: nodes and edges (src, dst, kind, weight)."""

from __future__ import annotations

import heapq

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyweave.operators.lineage import cut, drop, folder, numbered

#: Rounds in which nodes without a way in or out are taken off before the rest is colored.
TRIMS = 3
SAME_LABEL, CALL, REFERENCE, OTHER = 3.0, 1.0, 0.5, 0.25


#: Names that are told to all tasks; more are joined by a shuffle.
MAX_BROADCAST_NAMES = 500_000


def resolve_calls(calls: DataFrame, methods: DataFrame) -> DataFrame:
    """Edges from a caller to every method of the called name, but for the caller itself; no edge twice."""
    called = calls.select(F.col("id").alias("src"), F.col("called").alias("name"))
    # names without a caller or without a method go first: a name that very many methods share would else send them all to one task
    names = cut(called.select("name").distinct().join(methods.select("name").distinct(), "name", "left_semi"))
    known = F.broadcast(names) if names.count() <= MAX_BROADCAST_NAMES else names
    named = methods.select(F.col("id").alias("dst"), "name").join(known, "name", "left_semi")
    return called.join(known, "name", "left_semi").join(named, "name").where("src <> dst").select("src", "dst").distinct()


def known_only(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges both of whose ends are nodes."""
    ids = nodes.select("id").distinct()
    return edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")


def fan_in(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Distinct incoming edges of every node, 0 where there are none."""
    counts = edges.select("src", "dst", "kind").distinct().groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("n"))
    return nodes.select("id").join(counts, "id", "left").select("id", F.coalesce("n", F.lit(0)).alias("fan_in"))


def contract(edges: DataFrame, unit_of: DataFrame) -> DataFrame:
    """Edges between units: weights below 1 count as 1, edges within a unit and to nodes without one go."""
    end = lambda x: unit_of.select(F.col("id").alias(x), F.col("unit").alias(f"{x}_unit"))
    both = edges.join(end("src"), "src").join(end("dst"), "dst").where("src_unit <> dst_unit")
    return both.groupBy(F.col("src_unit").alias("src"), F.col("dst_unit").alias("dst")).agg(F.sum(F.greatest(F.lit(1), F.col("weight"))).alias("weight"))


def affinity(labels: DataFrame, edges: DataFrame) -> DataFrame:
    """Symmetric affinities (i < j): pairs of one label, and edges by their kind, added up."""
    own = labels.alias("a").join(labels.alias("b"), F.expr("a.label = b.label and a.id < b.id")).select(F.col("a.id").alias("i"), F.col("b.id").alias("j"), F.lit(SAME_LABEL).alias("w"))
    kind = F.when(F.col("kind") == "Calls", CALL).when(F.col("kind") == "References", REFERENCE).otherwise(OTHER)
    linked = edges.where("src <> dst").select(F.least("src", "dst").alias("i"), F.greatest("src", "dst").alias("j"), kind.alias("w"))
    return own.unionByName(linked).groupBy("i", "j").agg(F.sum("w").alias("w"))


def strong_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Rows (id, component): the smallest id of the node's strongly connected component.

    Nodes without a way in or without a way out are components; they are trimmed for some rounds. Coloring does the rest:
    the smallest id that reaches a node is its color; within a color, the nodes that reach the color's own node are a
    component. They are removed and the rest goes on. Memory is linear in the edges; what is done is written.
    """
    spark, out = nodes.sparkSession, folder(nodes.sparkSession, "components")
    left, arcs = cut(nodes.select("id").distinct()), cut(known_only(edges.select("src", "dst").where("src <> dst").distinct(), nodes))
    named = left.select("id", F.col("id").alias("component"))
    named.limit(0).write.mode("append").parquet(out)

    def without(gone: DataFrame) -> tuple[DataFrame, DataFrame]:
        rest = cut(left.join(gone, "id", "left_anti"))
        fewer = cut(arcs.join(gone.withColumnRenamed("id", "src"), "src", "left_anti").join(gone.withColumnRenamed("id", "dst"), "dst", "left_anti"))
        drop(left, arcs)
        return rest, fewer

    while not left.isEmpty():
        for _ in range(TRIMS):
            inner = arcs.select(F.col("src").alias("id")).intersect(arcs.select(F.col("dst").alias("id")))
            alone = cut(left.join(inner, "id", "left_anti"))
            if alone.isEmpty():
                break
            alone.select("id", F.col("id").alias("component")).write.mode("append").parquet(out)
            left, arcs = without(alone)
        if left.isEmpty():
            break
        color = cut(left.select("id", F.col("id").alias("color"), F.lit(True).alias("moved")))
        while not color.where("moved").isEmpty():
            reached = arcs.join(color.select(F.col("id").alias("src"), "color"), "src").groupBy(F.col("dst").alias("id")).agg(F.min("color").alias("seen"))
            color = cut(color.join(reached, "id", "left").select("id", F.least("color", "seen").alias("color"), (F.coalesce(F.col("seen") < F.col("color"), F.lit(False))).alias("moved")), color)
        color = color.select("id", "color")
        ends = arcs.join(color.withColumnsRenamed({"id": "src", "color": "c1"}), "src").join(color.withColumnsRenamed({"id": "dst", "color": "c2"}), "dst")
        inner = cut(ends.where("c1 = c2").select("src", "dst", F.col("c1").alias("color")))
        back = front = cut(color.where("id = color"))
        while not front.isEmpty():
            step = inner.join(front.select(F.col("id").alias("dst")), "dst").select(F.col("src").alias("id"), "color").distinct()
            front = cut(step.join(back, "id", "left_anti"))
            back = cut(back.unionByName(front), back)
        back.select("id", F.col("color").alias("component")).write.mode("append").parquet(out)
        left, arcs = without(back.select("id"))
        drop(inner, back)
    return spark.read.schema(named.schema).parquet(out)


def levels(nodes: DataFrame, edges: DataFrame, max_rounds: int | None = None) -> DataFrame:
    """Rows (id, level): 0 for nodes that depend on nothing, else one more than the highest level depended on.

    An edge points to what its source depends on. Peels the nodes without open dependencies, level by level; what is done
    is written. Nodes on or above a cycle get a null level. An error where a caller's ``max_rounds`` end before that is known.
    """
    spark, out = nodes.sparkSession, folder(nodes.sparkSession, "levels")
    left, arcs = cut(nodes.select("id").distinct()), cut(known_only(edges.select("src", "dst").distinct(), nodes))
    level = 0
    while True:
        if level == max_rounds and not left.isEmpty():
            raise RuntimeError(f"levels are open after {max_rounds} rounds")
        free = cut(left.join(arcs.select(F.col("src").alias("id")).distinct(), "id", "left_anti"))
        done = free.isEmpty()
        (left if done else free).withColumn("level", F.lit(None if done else level).cast("int")).write.mode("append").parquet(out)
        if done:
            return spark.read.schema(left.withColumn("level", F.lit(0)).schema).parquet(out)
        left, arcs = cut(left.join(free, "id", "left_anti"), left), cut(arcs.join(free.withColumnRenamed("id", "dst"), "dst", "left_anti"), arcs)
        drop(free)
        level += 1


def weak_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Rows (id, component): the smallest id of what edges connect, whatever their direction.

    Every node hangs itself and its larger neighbours under the smallest neighbour, then its smaller ones, in turns, until
    the edges are stars. Rounds grow with the logarithm of the size, memory with the edges.
    """
    stars = cut(edges.where("src <> dst").select(F.greatest("src", "dst").alias("a"), F.least("src", "dst").alias("b")).distinct())
    while True:
        both = stars.unionByName(stars.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = cut(both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct())
        lower = large.groupBy("a").agg(F.min("b").alias("m"))
        small = cut(large.join(lower, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b")).distinct())
        settled = small.join(stars, ["a", "b"], "left_anti").isEmpty() and small.count() == stars.count()
        drop(stars, large)
        stars = small
        if settled:
            return nodes.select("id").distinct().join(stars.select(F.col("a").alias("id"), F.col("b").alias("component")), "id", "left").select("id", F.coalesce("component", "id").alias("component"))


def _sequence(component: tuple, units: pd.DataFrame, edges: pd.DataFrame) -> pd.DataFrame:
    """The order of one component, and for every unit the largest key up to it."""
    key = {i: (r, n, i) for i, r, n in zip(units["id"], units["risk"], units["needs"], strict=True)}
    waits, users = dict.fromkeys(key, 0), {i: [] for i in key}
    for s, d in zip(edges["src"], edges["dst"], strict=True):
        waits[s] += 1
        users[d].append(s)
    ready = [key[i] for i in key if not waits[i]]
    heapq.heapify(ready)
    out, top = [], None
    while ready:
        now = heapq.heappop(ready)
        top = now if top is None or now > top else top
        out.append((now[2], False, *top, len(out)))
        for j in users[now[2]]:
            waits[j] -= 1
            if not waits[j]:
                heapq.heappush(ready, key[j])
    placed = {row[0] for row in out}
    out += [(i, True, key[i][0], 0, i, 0) for i in key if i not in placed]  # on or behind a cycle
    return pd.DataFrame(out, columns=["id", "late", "top_risk", "top_needs", "top_id", "seq"])


def priority_order(units: DataFrame, edges: DataFrame) -> DataFrame:
    """Rows (id, position from 1): dependencies first; of the units that are ready, least risk, fewest dependencies, id.

    ``units`` has (id, risk), ids once; a null risk comes last. Units on or behind a cycle come after all others, by risk
    and id. What edges connect is ordered by a heap in a task of its own. The whole order merges these orders by their
    least ready units; a unit comes after the largest key of its own component so far and before any larger key, so
    sorting by that key, then by place, is the merge: one range-partitioned sort.
    """
    risk = F.coalesce(F.col("risk").cast("double"), F.lit(float("inf")))
    known = cut(known_only(edges.select("src", "dst").distinct(), units))
    counts = known.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("needs"))
    listed = units.select("id", risk.alias("risk")).join(counts, "id", "left").join(weak_components(units, known), "id")
    listed = cut(listed.select("id", "risk", F.coalesce("needs", F.lit(0)).alias("needs"), "component"))
    # a unit that no edge touches is a component, and needs no task; one that only depends on itself is on a cycle
    touched = known.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
    free = listed.join(touched, "id", "left_anti").select("id", F.lit(False).alias("late"), F.col("risk").alias("top_risk"), F.col("needs").alias("top_needs"), F.col("id").alias("top_id"), F.lit(0).cast("bigint").alias("seq"))
    bound = listed.join(touched, "id", "left_semi")
    arcs = cut(known.join(listed.select(F.col("id").alias("src"), "component"), "src"))
    kind = dict(units.dtypes)["id"]
    made = bound.groupBy("component").cogroup(arcs.groupBy("component")).applyInPandas(_sequence, f"id {kind}, late boolean, top_risk double, top_needs long, top_id {kind}, seq long")
    return numbered(free.unionByName(made), "late", "top_risk", "top_needs", "top_id", "seq").select("id", F.col("position").cast("int").alias("position"))
