"""Weighted risk, votes by count, and routing by sampled success rates."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyweave.functions import scalars as S

# Weights of the eight factors and the values at which a factor is full.
WEIGHTS = {"cyclomatic": 0.20, "depth": 0.18, "criticality": 0.17, "coverage_deficit": 0.15, "coupling": 0.12, "obscurity": 0.08, "age": 0.05, "doc_gap": 0.05}
CC_FULL, DEPTH_FULL, COUPLING_FULL, LOC_FULL, NEST_FULL, RULES_FULL = 30.0, 30.0, 8.0, 200.0, 6.0, 4.0
# How hard a language is to replace, and how little documented.
OBSCURITY = {"vb6": 1.0, "cobol": 1.0, "fortran": 0.9, "ada": 0.8, "sql": 0.6, "javascript": 0.4, "java": 0.3, "csharp": 0.2}
DOC_GAP = {"vb6": 0.9, "cobol": 0.9, "fortran": 0.9, "sql": 0.7, "javascript": 0.6}


#: Agents that a task meets at most, and pairs that a draw tries.
MAX_AGENTS, TRIES = 1000, 40


def lookup(key: Column, table: dict[str, float], default: float) -> Column:
    pairs = [F.lit(x) for k, v in table.items() for x in (k, v)]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), key), F.lit(default))


def criticality(base: Column, rules: Column) -> Column:
    """A base score, raised by up to 0.2 for the rules that refer to the module."""
    return F.least(F.greatest(base + S.saturate(rules, RULES_FULL) * 0.20, F.lit(0.0)), F.lit(1.0))


def age(loc: Column, nesting: Column) -> Column:
    return 0.6 * S.saturate(loc, LOC_FULL) + 0.4 * S.saturate(nesting, NEST_FULL)


def risk(cc: Column, fan_out: Column, critical: Column, coverage: Column, coupling: Column, language: Column, loc: Column, nesting: Column) -> Column:
    """Composite risk in [0, 1]: the weighted sum of eight factors, added in a fixed order."""
    factors = {
        "cyclomatic": S.saturate(cc, CC_FULL),
        "depth": S.saturate(fan_out, DEPTH_FULL),
        "criticality": critical,
        "coverage_deficit": F.least(F.greatest(1.0 - coverage, F.lit(0.0)), F.lit(1.0)),
        "coupling": S.saturate(coupling, COUPLING_FULL),
        "obscurity": lookup(language, OBSCURITY, 0.5),
        "age": age(loc, nesting),
        "doc_gap": lookup(language, DOC_GAP, 0.5),
    }
    total = F.lit(0.0)
    for name, weight in WEIGHTS.items():
        total = total + weight * factors[name]
    return F.least(F.greatest(total, F.lit(0.0)), F.lit(1.0))


def majority(rows: DataFrame, by: str, label: str, order: dict[str, int]) -> DataFrame:
    """The most frequent label of each group; ties go to the label that comes first in ``order``."""
    counts = rows.groupBy(by, label).agg(F.count("*").alias("n"))
    rank = lookup(F.col(label), {k: float(v) for k, v in order.items()}, float(len(order)))
    return counts.groupBy(by).agg(F.min(F.struct((-F.col("n")).alias("less"), rank.alias("rank"), label)).alias("b")).select(by, F.col(f"b.{label}").alias(label), (-F.col("b.less")).alias("n"))


def uniform(seed: int, *what: Column | str) -> Column:
    """A number in (0, 1) from 48 bits of an MD5 of seed and names; the same on every engine and in every rerun."""
    named = [F.lit(w) if isinstance(w, str) else w.cast("string") for w in what]
    digits = F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), *named)), 1, 12)
    return (F.conv(digits, 16, 10).cast("bigint") + 0.5) / float(1 << 48)


def gamma_sample(seed: int, name: Column, shape: Column) -> Column:
    """A draw from the gamma distribution of a positive shape, at a cost that does not depend on the shape.

    A normal x gives v = (1 + c x)^3 with d = shape - 1/3 and c = 1 / sqrt(9 d); d v is accepted if ln u is below
    x^2 / 2 + d (1 - v + ln v), which at least 95 of 100 tries are. Each try takes its three uniforms from one SHA-256 of
    seed, name and number; tries behind the accepted one are not made, and none of ``TRIES`` is accepted with a probability
    below 1e-50. A shape below 1 is drawn one higher and multiplied by u^(1 / shape).
    """
    d = F.when(shape < 1, shape + 1).otherwise(shape) - 1.0 / 3.0
    c = 1.0 / F.sqrt(9.0 * d)
    within = lambda x, f: F.transform(F.array(x), f)[0]  # noqa: E731  a value that is used several times

    def attempt(i: Column) -> Column:
        digits = F.sha2(F.concat_ws(":", F.lit(str(seed)), name, F.lit("g"), i.cast("string")), 256)
        u = lambda h, k: (F.conv(F.substring(h, 1 + 12 * k, 12), 16, 10).cast("bigint") + 0.5) / float(1 << 48)
        drawn = within(digits, lambda h: F.struct((F.sqrt(-2.0 * F.log(u(h, 0))) * F.cos(2.0 * math.pi * u(h, 1))).alias("x"), u(h, 2).alias("u")))
        cubed = within(drawn, lambda r: F.struct(r["x"].alias("x"), r["u"].alias("u"), (1.0 + c * r["x"]).alias("w")))
        value = lambda r: r["w"] * r["w"] * r["w"]
        return within(cubed, lambda r: F.when((r["w"] > 0) & (F.log(r["u"]) < 0.5 * r["x"] * r["x"] + d * (1.0 - value(r) + F.log(value(r)))), d * value(r)))

    first = F.aggregate(F.sequence(F.lit(1), F.lit(TRIES)), F.lit(None).cast("double"), lambda s, i: F.when(s.isNotNull(), s).otherwise(attempt(i)))
    return first * F.when(shape < 1, F.pow(uniform(seed, name, "b"), 1.0 / shape)).otherwise(1.0)


def beta_sample(seed: int, name: Column, alpha: Column, beta: Column) -> Column:
    """A draw from the beta distribution."""
    a, b = gamma_sample(seed, F.concat(name, F.lit(":a")), alpha), gamma_sample(seed, F.concat(name, F.lit(":b")), beta)
    return a / (a + b)


def thompson_routes(tasks: DataFrame, agents: DataFrame, seed: int, *, sovereign_only: bool = False) -> DataFrame:
    """The agent for each task: a sample of its success rate times how its weights match the task's features.

    ``tasks`` has (task, features map), ``agents`` (agent, sovereign, alpha, beta, weights map); there are at most
    ``MAX_AGENTS``, and each task meets all of them. Draws follow from the names of task and agent. Of equal scores the
    larger mean wins, then the name that comes first.
    """
    pool = agents.where("sovereign") if sovereign_only else agents
    n, good = pool.agg(F.count("*"), F.min((F.col("alpha") > 0) & (F.col("beta") > 0))).first()
    if not n or not good or n > MAX_AGENTS:
        raise ValueError(f"no agent is eligible, or one has a parameter that is not positive, or there are more than {MAX_AGENTS}")
    listed = pool.agg(F.collect_list(F.struct("agent", "alpha", "beta", "weights")).alias("pool"))

    def scored(a: Column) -> Column:
        match = S.feature_match(F.col("features"), a["weights"])
        name = F.concat_ws(":", F.col("task").cast("string"), a["agent"])
        sample = beta_sample(seed, name, a["alpha"].cast("double"), a["beta"].cast("double")) * match
        mean = a["alpha"] / (a["alpha"] + a["beta"]) * match
        return F.struct((-sample).alias("less"), (-mean).alias("lower"), a["agent"].alias("agent"))

    # one row of agents
    both = tasks.withColumn("one", F.lit(1)).join(F.broadcast(listed.withColumn("one", F.lit(1))), "one")
    best = both.select("task", F.array_min(F.transform("pool", scored)).alias("b"))
    return best.select("task", F.col("b.agent").alias("agent"), (-F.col("b.less")).alias("sampled"), (-F.col("b.lower")).alias("posterior_mean"))


def capabilities(features: Column, sovereign_only: Column) -> Column:
    """What an agent must be able to do: code, and analysis for tasks that touch cryptography unless only local agents may be used."""
    crypto = F.coalesce(F.try_element_at(features, F.lit("crypto")), F.lit(0.0)) >= 0.5
    return F.array_union(F.array(F.lit("code")), F.when(crypto & ~sovereign_only, F.array(F.lit("analysis"))).otherwise(F.array().cast("array<string>")))


def strategy(features: Column, sovereign_only: Column) -> Column:
    """How a task is routed: efficiency where only local agents may be used, else by cost, capability or balance."""
    value = lambda k: F.coalesce(F.try_element_at(features, F.lit(k)), F.lit(0.0))
    return F.when(sovereign_only, "efficiency").when(value("costSensitivity") >= 0.7, "cost").when((value("complexity") >= 0.7) | (value("contextSize") >= 0.7), "capability").otherwise("balanced")
