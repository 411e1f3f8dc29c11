"""Ordered sequences: legs between consecutive points, order-sensitive and exact sums, look-ahead within lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyweave.functions import scalars as S


def legs(points: DataFrame, route: str, *order: str, lat: str = "lat", lon: str = "lon") -> DataFrame:
    """A row for each pair of consecutive points: leg number, distance (wrapped and not), bearing, turn to the next leg.

    All leads share one window, so the points are shuffled and sorted once by route.
    """
    w = Window.partitionBy(route).orderBy(*order)
    ahead = lambda c, n: F.lead(c, n).over(w)
    a, b, c = ((F.col(lat), F.col(lon)), (F.col("lat2"), F.col("lon2")), (F.col("lat3"), F.col("lon3")))
    out = points.select(
        route, lat, lon, (F.row_number().over(w) - 1).alias("leg"),
        ahead(lat, 1).alias("lat2"), ahead(lon, 1).alias("lon2"), ahead(lat, 2).alias("lat3"), ahead(lon, 2).alias("lon3"),
    ).where("lat2 is not null")
    return out.select(
        route, "leg",
        S.flat_distance(*a, *b).alias("distance"),
        S.flat_distance(*a, *b, wrapped=False).alias("raw_distance"),
        F.abs(b[0] - a[0]).alias("dlat"), F.abs(S.wrap_to_180(b[1] - a[1])).alias("dlon"),
        S.bearing(*a, *b).alias("bearing"),
        F.when(F.col("lat3").isNotNull(), S.turn_angle(S.bearing(*a, *b), S.bearing(*b, *c))).alias("turn"),
    )


def ordered_sum(value: Column, *order: str) -> Column:
    """The sum from left to right in a stated order; the same bits on every run."""
    listed = F.sort_array(F.collect_list(F.struct(*order, value.alias("__x"))))
    return F.aggregate(listed, F.lit(0.0), lambda s, e: s + e["__x"])


def exact_sum(value: Column, kind: str = "decimal(38,6)") -> Column:
    """The sum of decimals, whatever the order."""
    return F.sum(value.cast(kind))


def route_decisions(route_legs: DataFrame, route: str) -> DataFrame:
    """Rows (route, n_legs, total, valid, messages): legs out of the box, turns beyond the limit, the verdict."""
    out_of_box = (F.col("dlat") > S.MAX_LEG_DLAT_DEG) | (F.col("dlon") > S.MAX_LEG_DLON_DEG)
    too_sharp = F.coalesce(F.col("turn") > S.MAX_TURN_DEG, F.lit(False))
    bad = route_legs.select(route, "leg", "distance", out_of_box.alias("box"), too_sharp.alias("sharp"))
    listed = lambda flag: F.sort_array(F.collect_list(F.when(F.col(flag), F.col("leg"))))
    got = bad.groupBy(route).agg(F.count("*").alias("n_legs"), ordered_sum(F.col("distance"), "leg").alias("total"), listed("box").alias("boxes"), listed("sharp").alias("turns"))
    valid = (F.size("boxes") == 0) & (F.size("turns") == 0)
    name = lambda text, shift: lambda i: F.concat(F.lit(text), (i + shift).cast("string"))
    messages = F.concat(F.transform("boxes", name("LEG_OUT_OF_BOX:", 0)), F.transform("turns", name("TURN_EXCEEDED:", 1)), F.when(valid, F.array().cast("array<string>")).otherwise(F.array(F.lit("ROUTE_INVALID"))))
    return got.select(route, "n_legs", "total", valid.alias("valid"), messages.alias("messages"))


def arrival(total: Column, launch: Column) -> tuple[Column, Column]:
    """Estimated arrival of the reference and of the baseline.

    The reference rounds the travel time (ties to even) and adds a second for each boundary epoch passed; the baseline
    truncates and adds nothing.
    """
    rounded = launch + F.rint(total / S.SPEED_NM_PER_SEC).cast("bigint")
    return rounded + S.boundaries_between(launch, rounded), launch + (total / S.SPEED_NM_PER_SEC).cast("bigint")


def within_next(flag: Column, ahead: Column, rows: int, by: Column, order: Column) -> Column:
    """Whether ``flag`` holds and ``ahead`` holds in this or one of the next ``rows - 1`` rows."""
    w = Window.partitionBy(by).orderBy(order).rowsBetween(0, rows - 1)
    return flag & F.max(ahead.cast("int")).over(w).cast("boolean")


def chain_links(rows: DataFrame, by: str, order: str, value: str, first: str) -> DataFrame:
    """Each row with the value of the one before it, ``first`` at the start."""
    w = Window.partitionBy(by).orderBy(order)
    return rows.withColumn("previous", F.coalesce(F.lag(value).over(w), F.lit(first)))
