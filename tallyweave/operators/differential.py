"""Three-way differential validation: a candidate against a baseline, with a reference to tell repairs from regressions."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyweave.functions import scalars as S

#: Votes by rank, so that the worst of several is their maximum.
EQUIVALENT, INTENTIONAL, VIOLATION = 0, 1, 2
PRIMARY_CONFIDENCE, SECONDARY_CONFIDENCE = 0.95, 0.999


def discrete_vote(base: Column, cand: Column, ref: Column) -> Column:
    """Equal to the baseline: equivalent. Else intentional if only the candidate equals the reference."""
    repaired = cand.eqNullSafe(ref) & ~base.eqNullSafe(ref)
    return F.when(cand.eqNullSafe(base), EQUIVALENT).when(repaired, INTENTIONAL).otherwise(VIOLATION)


def continuous_vote(base: Column, cand: Column, ref: Column, tolerance: float = S.RELATIVE_TOLERANCE) -> Column:
    """As ``discrete_vote``, with equality up to a relative error."""
    within = lambda a, b: S.relative_error(a, b) <= tolerance
    repaired = within(cand, ref) & (S.relative_error(base, ref) > tolerance)
    return F.when(within(base, cand), EQUIVALENT).when(F.coalesce(repaired, F.lit(False)), INTENTIONAL).otherwise(VIOLATION)


def array_vote(base: Column, cand: Column, ref: Column, tolerance: float = S.RELATIVE_TOLERANCE) -> Column:
    """The worst vote and the largest finite error of two arrays: struct (vote, rel).

    Arrays of different lengths are a violation with an infinite error; where the reference is too short, its value is
    NaN, so that it never explains a difference.
    """
    at = F.sequence(F.lit(0), F.size(base) - 1)
    value = lambda a, i: F.coalesce(F.get(a, i), F.lit(float("nan")))

    def one(i: Column) -> Column:
        rel = S.relative_error(F.get(base, i), F.get(cand, i))
        return F.struct(continuous_vote(F.get(base, i), F.get(cand, i), value(ref, i), tolerance).alias("vote"), rel.alias("rel"))

    each = F.transform(at, one)
    folded = F.aggregate(
        each,
        F.struct(F.lit(0).alias("vote"), F.lit(0.0).alias("rel")),
        lambda s, e: F.struct(F.greatest(s["vote"], e["vote"]).alias("vote"), F.when(e["rel"] < float("inf"), F.greatest(s["rel"], e["rel"])).otherwise(s["rel"]).alias("rel")),
    )
    none = F.struct(F.lit(0).alias("vote"), F.lit(0.0).alias("rel"))
    broken = F.struct(F.lit(VIOLATION).alias("vote"), F.lit(float("inf")).alias("rel"))
    return F.when(F.size(base) != F.size(cand), broken).when(F.size(base) == 0, none).otherwise(folded)


@dataclass(frozen=True)
class Oracle:
    """One compared output: a vote column, an error column for continuous ones, and the rows it is evaluated on."""

    name: str
    kind: str
    vote: Column
    rel: Column | None = None
    where: Column | None = None


def vector_votes(vectors: DataFrame, oracles: list[Oracle], key: str, parsed: Column | None = None) -> DataFrame:
    """Rows (key, votes array<struct<oracle, kind, vote, rel>>, n_violations, class); oracles not evaluated are left out.

    Where ``parsed`` does not hold, the candidate gave nothing that can be read (its model failed, or its text is
    broken): every oracle that is evaluated on all rows counts as a violation, the others are not evaluated.
    """
    read = F.lit(True) if parsed is None else F.coalesce(parsed, F.lit(False))
    made = []
    for o in oracles:
        rel = F.coalesce(o.rel, F.lit(0.0)) if o.rel is not None else F.lit(0.0)
        rel = F.when(read & (rel < float("inf")), rel).otherwise(F.lit(0.0))
        vote = F.when(read, o.vote.cast("int")).otherwise(VIOLATION)
        row = F.struct(F.lit(o.name).alias("oracle"), F.lit(o.kind).alias("kind"), vote.alias("vote"), rel.alias("rel"))
        made.append(row if o.where is None else F.when(read & o.where, row))
    votes = F.array_compact(F.array(*made))
    bad = F.size(F.filter("votes", lambda v: v["vote"] == VIOLATION))
    fixed = F.size(F.filter("votes", lambda v: v["vote"] == INTENTIONAL))
    cls = F.when(F.col("n_violations") > 0, "violation").when(fixed > 0, "intentional").otherwise("pass")
    return vectors.select(key, votes.alias("votes")).withColumn("n_violations", bad).withColumn("class", cls)


def report(vectors: DataFrame, oracles: list[Oracle], parsed: Column | None = None) -> DataFrame:
    """``oracle_report`` of the votes of ``vector_votes``, without rows for votes: counts of every oracle are columns of one aggregate."""
    read = F.lit(True) if parsed is None else F.coalesce(parsed, F.lit(False))
    named = {}
    for i, o in enumerate(oracles):
        seen = F.lit(True) if o.where is None else read & F.coalesce(o.where, F.lit(False))
        rel = F.coalesce(o.rel, F.lit(0.0)) if o.rel is not None else F.lit(0.0)
        named[f"v{i}"] = F.when(seen, F.when(read, o.vote.cast("int")).otherwise(VIOLATION))
        named[f"r{i}"] = F.when(seen, F.when(read & (rel < float("inf")), rel).otherwise(F.lit(0.0)))
    rows = vectors.select(*[c.alias(k) for k, c in named.items()])
    worst = F.greatest(*[F.coalesce(f"v{i}", F.lit(0)) for i in range(len(oracles))], F.lit(0))
    flag = lambda c: F.coalesce(F.sum(c.cast("bigint")), F.lit(0))
    is_ = lambda i, vote: F.coalesce(F.col(f"v{i}") == vote, F.lit(False))
    sums = [F.count("*").alias("evaluated"), flag(worst == EQUIVALENT).alias("passed"), flag(worst == INTENTIONAL).alias("fixed"), flag(worst == VIOLATION).alias("bad")]
    for i in range(len(oracles)):
        sums += [F.count(f"v{i}").alias(f"n{i}"), flag(is_(i, VIOLATION)).alias(f"x{i}"), flag(is_(i, INTENTIONAL)).alias(f"y{i}"), F.max(f"r{i}").alias(f"m{i}")]
    got = rows.agg(*sums)
    each = [F.struct(F.lit(o.name).alias("oracle"), F.lit(o.kind).alias("kind"), F.col(f"n{i}").alias("evaluated"), F.col(f"x{i}").alias("violations"), F.col(f"y{i}").alias("intentional"), F.col(f"m{i}").alias("max_rel_error")) for i, o in enumerate(oracles)]
    total = sum((F.col(f"x{i}") for i in range(len(oracles))), F.lit(0))
    totals = F.struct("evaluated", "passed", "fixed", "bad", total.alias("all_violations")).alias("t")
    return _with_bounds(got.select(totals, F.explode(F.filter(F.array(*each), lambda r: r["evaluated"] > 0)).alias("r")))


def oracle_report(votes: DataFrame) -> DataFrame:
    """One row for each evaluated oracle, with the totals and bounds of the whole comparison.

    The per-oracle counts and the totals come from one aggregate: the totals are the group of a ``null`` oracle, and a
    window over the few result rows hands them to the others.
    """
    total = F.struct(F.lit(None).cast("string").alias("oracle"), F.lit(None).cast("string").alias("kind"), F.lit(0).alias("vote"), F.lit(0.0).alias("rel"))
    long = votes.select("n_violations", "class", F.inline(F.concat(F.col("votes"), F.array(total))))
    flag = lambda c: F.sum(c.cast("bigint"))
    agg = long.groupBy("oracle", "kind").agg(
        F.count("*").alias("evaluated"),
        flag(F.col("vote") == VIOLATION).alias("violations"),
        flag(F.col("vote") == INTENTIONAL).alias("intentional"),
        F.max("rel").alias("max_rel_error"),
        flag(F.col("class") == "pass").alias("passed"),
        flag(F.col("class") == "intentional").alias("fixed"),
        flag(F.col("class") == "violation").alias("bad"),
        F.sum("n_violations").alias("all_violations"),
    )
    # a dozen rows at most: one for each oracle and the totals
    listed = agg.agg(F.collect_list(F.struct(*agg.columns)).alias("rows"))
    return _with_bounds(listed.select(F.filter("rows", lambda r: r["oracle"].isNull())[0].alias("t"), F.explode(F.filter("rows", lambda r: r["oracle"].isNotNull())).alias("r")))


def _with_bounds(rows: DataFrame) -> DataFrame:
    """The report's columns from totals ``t`` and an oracle's counts ``r``."""
    clean = F.col("t.all_violations") == 0
    bound = lambda c: F.lit(math.log(1 / (1 - c))) / F.col("t.passed")
    return rows.select(
        "r.oracle", "r.kind", "r.evaluated", "r.violations", "r.intentional", "r.max_rel_error",
        (F.col("r.intentional") > 0).alias("is_intentional"),
        F.col("t.evaluated").alias("vectors_total"), F.col("t.passed").alias("vectors_passed"), F.col("t.fixed").alias("intentional_vectors"), F.col("t.bad").alias("violating_vectors"),
        F.col("t.all_violations").alias("total_violations"),
        F.when(clean, F.when(F.col("t.passed") > 0, bound(PRIMARY_CONFIDENCE)).otherwise(float("inf"))).otherwise(F.col("t.all_violations") / F.greatest(F.col("t.evaluated"), F.lit(1))).alias("bound"),
        F.when(clean, F.when(F.col("t.passed") > 0, bound(SECONDARY_CONFIDENCE)).otherwise(float("inf"))).alias("secondary_bound"),
    )


def confusion(rows: DataFrame, detected: Column, expected: Column, vacuous: float, *keys: str) -> DataFrame:
    """Counts tp, fp, fn, tn with precision, recall and F1; ``vacuous`` is the value of an empty ratio."""
    n = lambda c: F.sum(c.cast("bigint"))
    out = rows.groupBy(*keys).agg(n(detected & expected).alias("tp"), n(detected & ~expected).alias("fp"), n(~detected & expected).alias("fn"), n(~detected & ~expected).alias("tn"))
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(vacuous))
    out = out.withColumn("precision", ratio(F.col("tp"), F.col("tp") + F.col("fp"))).withColumn("recall", ratio(F.col("tp"), F.col("tp") + F.col("fn")))
    both = F.col("precision") + F.col("recall")
    return out.withColumn("f1", F.when(both > 0, 2 * F.col("precision") * F.col("recall") / both).otherwise(F.lit(0.0)))


def composed_bound(parts: DataFrame, weight: str, bound: str) -> DataFrame:
    """The bound of a system from those of its parts, each with a non-negative sensitivity."""
    checked = F.when(F.col(weight) < 0, F.raise_error(F.lit("a negative sensitivity")).cast("double")).otherwise(F.col(weight).cast("double"))
    return parts.agg(F.sum(checked * F.col(bound)).alias("composed_bound"))
