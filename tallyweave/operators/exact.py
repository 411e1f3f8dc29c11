"""Sums of doubles that are exact and rounded once, the same in any order and partitioning.

A double is a sum of four whole multiples of powers of 2^32 that follow each other; their multiples are summed by power as
whole numbers, with partial aggregates. What is left for each group, some 70 numbers at most, is put together as one whole
number and divided once, which rounds to the nearest double, ties to even.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits of a part; numbers below 2^-400 are first multiplied by 2^SHIFT, so that no power underflows.
BITS, SHIFT = 32, 608


_PART = "array<struct<power: int, high: bigint, low: bigint, odd: double>>"


def parts(x: Column) -> Column:
    """Array of (power, high, low, odd): a finite double as the sum of (high * 2^16 + low) * 2^(BITS * power).

    Two halves of a multiple, since their sums as bigints overflow only beyond 2^47 rows. A value that is not finite is
    ``odd``; a null has a part without any of them.
    """
    finite = ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    tiny = F.abs(x) < F.lit(2.0**-400)
    y = F.when(tiny, x * F.lit(2.0**SHIFT)).otherwise(x)
    top = F.when(y == 0, F.lit(0)).otherwise(F.floor(F.log2(F.abs(y)) / BITS)).cast("int")
    start = F.struct(y.alias("rest"), F.array().cast(_PART).alias("found"))
    part = lambda power, high, low, odd: F.struct(power.cast("int").alias("power"), high.cast("bigint").alias("high"), low.cast("bigint").alias("low"), odd.cast("double").alias("odd"))
    none = F.lit(None)

    def step(s: Column, k: Column) -> Column:
        unit = F.pow(F.lit(2.0), (top - k) * BITS)
        whole = s["rest"] / unit
        whole = F.when(whole < 0, -F.floor(-whole)).otherwise(F.floor(whole)).cast("bigint")  # towards 0: what is left stays exact
        one = part(top - k - F.when(tiny, SHIFT // BITS).otherwise(0), F.shiftright(whole, 16), F.pmod(whole, F.lit(1 << 16)), none)
        return F.struct((s["rest"] - whole.cast("double") * unit).alias("rest"), F.when(whole == 0, s["found"]).otherwise(F.concat(s["found"], F.array(one))).alias("found"))

    found = F.aggregate(F.sequence(F.lit(0), F.lit(3)), start, step, lambda s: s["found"])
    zero, other = F.array(part(F.lit(0), F.lit(0), F.lit(0), none)).cast(_PART), F.array(part(F.lit(0), none, none, x)).cast(_PART)
    return F.when(x == 0, zero).when(finite, found).otherwise(other)


def put_together(powers: list[int], multiples: list[int]) -> float:
    low = min(powers, default=0)
    whole = sum(int(m) << (BITS * (p - low)) for p, m in zip(powers, multiples, strict=True))
    try:
        return whole / (1 << -BITS * low) if low < 0 else float(whole << (BITS * low))
    except OverflowError:
        return float("inf") if whole > 0 else float("-inf")


def exact_sum(rows: DataFrame, value: str, *keys: str, name: str = "total") -> DataFrame:
    """Rows (keys, total): the sum of a double column by group; nulls are left out, a group of nulls only has null.

    NaN, or infinities of both signs, give NaN; one infinity gives it; sums beyond the largest double give an infinity.
    """
    found = rows.select(*keys, F.explode(parts(F.col(value).cast("double"))).alias("p"))
    summed = found.groupBy(*keys, F.col("p.power").alias("__power")).agg(F.sum("p.high").alias("__high"), F.sum("p.low").alias("__low"), F.sum("p.odd").alias("__odd"))
    part = F.when(F.col("__high").isNotNull(), F.struct(F.col("__power").alias("power"), F.col("__high").alias("high"), F.col("__low").alias("low")))
    gathered = summed.groupBy(*keys).agg(F.sum("__odd").alias("__odd"), F.collect_list(part).alias("__parts"))  # one for each power

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(batch.num_columns - 1)
            ends = lists.offsets.to_pylist()
            powers, high, low = (lists.values.field(k).to_pylist() for k in range(3))
            multiples = [(h << 16) + r for h, r in zip(high, low, strict=True)]
            totals = [put_together(powers[a:b], multiples[a:b]) if b > a else None for a, b in zip(ends, ends[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(totals, pa.float64())], [*batch.schema.names[:-1], "__sum"])

    kinds = dict(rows.dtypes)
    sums = gathered.mapInArrow(scan, ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), "__odd double", "__sum double"]))
    return sums.select(*keys, F.when(F.col("__odd").isNotNull(), F.col("__odd")).otherwise(F.col("__sum")).alias(name))
