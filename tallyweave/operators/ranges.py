"""Joins of points with intervals, by bins.

An interval goes to the level whose bins are at least as long as it is, so it touches two bins at most, whatever its
length; a point goes to its bin of every level that has intervals, some 60 at most. The smallest bins have the median
length of the intervals, from a sketch. The join is an equi-join by level and bin with an exact check; a bin with many
points is split into parts, and its intervals go to each of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyweave.operators.lineage import cut

#: Points of a part of a bin, about, and split bins that are told to all tasks; the sizes of more are joined by a shuffle.
PART, MAX_BROADCAST_BINS = 100_000, 500_000
#: Levels at most: lengths beyond share the last one.
LEVELS = 60


def join_points(points: DataFrame, at: str, intervals: DataFrame, low: str, high: str) -> DataFrame:
    """All columns of both sides for every point in an interval (low, high]; columns are numbers, and names differ.

    Null ends and points meet nothing; an interval whose end is not behind its start is empty. Bins are whole multiples
    of their length, so values beyond 2^53 of them lose only speed.
    """
    some = intervals.where(F.col(low) < F.col(high))
    length = F.col(high).cast("double") - F.col(low).cast("double")
    middle = some.agg(F.percentile_approx(length, 0.5)).first()[0]
    width = middle if middle and 0 < middle < float("inf") else 1.0
    level = F.least(F.greatest(F.ceil(F.log2(length / width)), F.lit(0)), F.lit(LEVELS)).cast("int")
    bin_of = lambda x, lv: F.floor(x.cast("double") / (F.lit(width) * F.pow(F.lit(2.0), lv)))
    placed = some.withColumn("__level", level)
    known = sorted(r[0] for r in placed.select("__level").distinct().collect())  # LEVELS at most
    ends = F.array_distinct(F.array(bin_of(F.col(low), F.col("__level")), bin_of(F.col(high), F.col("__level"))))
    # rounding, and the last level, may leave bins between the two ends
    bins = F.when(bin_of(F.col(high), F.col("__level")) - bin_of(F.col(low), F.col("__level")) > 1, F.sequence(bin_of(F.col(low), F.col("__level")), bin_of(F.col(high), F.col("__level")))).otherwise(ends)
    left = placed.withColumn("__bin", F.explode(bins))
    right = points.where(F.col(at).isNotNull()).withColumn("__level", F.explode(F.array(*[F.lit(k) for k in known]).cast("array<int>"))).withColumn("__bin", bin_of(F.col(at), F.col("__level")))
    crowded = cut(right.groupBy("__level", "__bin").agg(F.count("*").alias("n")).where(F.col("n") > PART).select("__level", "__bin", F.ceil(F.col("n") / PART).cast("int").alias("__parts")))
    sizes = F.broadcast(crowded) if crowded.count() <= MAX_BROADCAST_BINS else crowded
    parts = F.coalesce("__parts", F.lit(1))
    left = left.join(sizes, ["__level", "__bin"], "left").withColumn("__part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("__parts")
    right = right.join(sizes, ["__level", "__bin"], "left").withColumn("__part", F.floor(F.rand(7) * parts).cast("int")).drop("__parts")
    joined = left.join(right, ["__level", "__bin", "__part"]).where((F.col(at) > F.col(low)) & (F.col(at) <= F.col(high)))
    return joined.drop("__level", "__bin", "__part")


def count_points(points: DataFrame, at: str, intervals: DataFrame, key: str, low: str, high: str) -> DataFrame:
    """Rows (key, n): how many points each interval (low, high] holds, 0 where it holds none."""
    met = join_points(points.select(F.col(at).alias("__at")), "__at", intervals.select(key, low, high), low, high).groupBy(key).agg(F.count("*").alias("n"))
    return intervals.select(key).join(met, key, "left").select(key, F.coalesce("n", F.lit(0)).alias("n"))


def in_order(a: Column, b: Column) -> tuple[Column, Column]:
    """The smaller and the larger of two ends."""
    return F.least(a, b), F.greatest(a, b)
