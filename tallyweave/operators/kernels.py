"""Three models of one computation over orders and their lines, and over routes of points.

Money is counted in ten-thousandths, as integers, so that every model is exact on every engine. The reference sums the
exact line values; the baseline rounds every line to cents (ties to even) first, and truncates where the reference
rounds; the candidate follows the baseline but takes the reference's rule for one tag.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyweave.functions import scalars as S

UNITS_PER_CENT = 100
#: A handling unit is this many ten-thousandths; decisions compare totals and units with these limits.
HANDLING = 1_000 * 10_000
BIG_ORDER = 150_000 * 10_000
MAX_UNITS = 120
URGENT = "1-URGENT"


def line_units(price: str = "l_extendedprice", discount: str = "l_discount") -> Column:
    """price * (1 - discount) in ten-thousandths."""
    cents = (F.col(price).cast("decimal(14,2)") * 100).cast("bigint")
    percent = (F.col(discount).cast("decimal(4,2)") * 100).cast("bigint")
    return cents * (100 - percent)


def order_vectors(orders: DataFrame, lines: DataFrame) -> DataFrame:
    """One row for each order, orders without lines included: outputs of the three models and the order's tags.

    Lines are aggregated by order before the join, so each side is shuffled once on the order key.
    """
    exact = line_units()
    each = lines.select(
        "l_orderkey", "l_linenumber", exact.alias("exact"), (S.half_even_div(exact, UNITS_PER_CENT) * UNITS_PER_CENT).alias("rounded"), (F.col("l_returnflag") == "R").alias("returned"), "l_returnflag", "l_partkey"
    )
    rel = S.relative_error((F.col("exact") / 10000.0), (F.col("rounded") / 10000.0))
    per = each.groupBy("l_orderkey").agg(
        F.count("*").alias("lines"), F.sum("exact").alias("exact"), F.sum("rounded").alias("rounded"), F.max(F.col("returned").cast("int")).alias("returned"),
        # each model counts lines and looks for returns in its own way
        F.count("l_orderkey").alias("base_lines"), F.count("l_partkey").alias("cand_lines"),
        F.sum(F.col("returned").cast("int")).alias("n_returned"), F.max("l_returnflag").alias("last_flag"),
        F.sort_array(F.collect_list(F.struct("l_linenumber", "exact", "rounded"))).alias("values"),
        F.max(rel).alias("line_rel"), F.sum((rel > S.RELATIVE_TOLERANCE).cast("bigint")).alias("lines_off"),
    )
    out = orders.join(per, orders["o_orderkey"] == per["l_orderkey"], "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    counted = [zero("base_lines"), zero("cand_lines"), (zero("n_returned") > 0).alias("base_returned"), F.coalesce(F.col("last_flag") >= "R", F.lit(False)).alias("cand_returned")]
    out = out.select("o_orderkey", "o_orderpriority", *counted, zero("lines"), zero("exact"), zero("rounded"), zero("returned"), zero("line_rel"), zero("lines_off"), F.coalesce("values", F.array()).alias("values"), (F.col("o_orderpriority") == URGENT).alias("urgent"))
    # the lines of an order are few; each model has its own values of them
    value = lambda of: F.transform("values", lambda v: of(v) / 10000.0)
    out = out.withColumns({"ref_values": value(lambda v: v["exact"]), "base_values": value(lambda v: v["rounded"]), "cand_values": value(lambda v: F.when(F.col("urgent"), v["exact"]).otherwise(v["rounded"]))}).drop("values")
    out = out.withColumns({"chosen": F.when(F.col("urgent"), F.col("exact")).otherwise(F.col("rounded")), "ref_lines": F.col("lines"), "ref_returned": F.col("returned") == 1})
    trunc = lambda c: ((F.col(c) - F.pmod(F.col(c), F.lit(HANDLING))) / HANDLING).cast("bigint")
    ref_units = S.half_even_div(F.col("exact"), HANDLING)
    out = out.withColumns({"ref_units": ref_units, "base_units": trunc("rounded"), "cand_units": F.when(F.col("urgent"), ref_units).otherwise(trunc("rounded"))})
    for who, total in (("ref", "exact"), ("base", "rounded"), ("cand", "chosen")):
        out = out.withColumns({f"{who}_total": F.col(total) / 10000.0, f"{who}_big": F.col(total) > BIG_ORDER, f"{who}_ok": F.col(f"{who}_units") <= MAX_UNITS})
        out = out.withColumn(f"{who}_messages", F.col(f"{who}_big").cast("int") + (~F.col(f"{who}_ok")).cast("int"))
    return out


def route_points(events: DataFrame) -> DataFrame:
    """Events as points of routes: a user's events in order of time; the position follows from the event's id."""
    lat = (F.pmod(F.col("event_id") * 37, F.lit(1200)) / 10.0) - 60.0
    lon = (F.pmod(F.col("event_id") * 101, F.lit(3600)) / 10.0) - 180.0
    return events.select("user_id", "event_id", "ts", lat.alias("lat"), lon.alias("lon"))
