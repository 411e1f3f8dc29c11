"""Mixing sources to target weights by Poisson replication (DataFrame functions only).

A source that holds the share p of the rows and should hold the share w of the mix gets the repetition rate
``lambda = epochs * w / p``. Each document draws a uniform number from a hash of seed and id, and the inverse of the
Poisson distribution with that mean turns it into a number of copies. The draw depends on nothing else, so a rerun
of a lost task gives the same copies. The copies are then shuffled globally by a hash of seed, id and copy number.
Rows whose id is null or stands in several rows draw, and are shuffled, by their place in the input besides, so they
draw independently too and a hot id is spread over all partitions.

Defined results
---------------
* A null source counts as a source of its own. A source with no target weight gets the weight 0 and so no copies;
  a target weight of a source with no rows is ignored, and the others are not rescaled for it.
* Rows of null and of repeated ids draw one by one. Their places are those of Spark's row numbers over the scan, so
  the same draws need the same files; a row whose id is its own draws the same whatever the files.
* An empty table gives an empty table. Texts are carried, never looked at, however long; columns of any other name pass through.
  Where the draw's columns are kept, input columns of their names give way to them.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyweave.llm import common

#: Sources up to this number are joined by broadcast; each is a row of a name and two numbers. More are shuffled.
MAX_BROADCAST_SOURCES = 10_000
#: Repeated ids up to this number (8 MB) are joined by broadcast. More are shuffled.
MAX_BROADCAST_IDS = 1_000_000
#: The inverse is searched up to mean + 12 * sqrt(mean) + 40; the tail beyond it is less than the draw's resolution.
TAIL_SIGMAS, TAIL_MIN = 12.0, 40
#: Given weights that ask for more copies of each document are refused as a mistake; tempered ones may reach any rate.
MAX_GIVEN_RATE = 700
#: Means up to this are summed from 0.
MAX_PLAIN_MEAN = 700
#: A draw takes 13 hexadecimal digits (52 bits) of an MD5.
DRAW_DIGITS = 13


def uniform(seed: int, key: Column) -> Column:
    """A number in [0, 1) from a hash of seed and key."""
    digits = F.substring(F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string"))), 1, DRAW_DIGITS)
    return F.conv(digits, 16, 10).cast("long") / F.lit(float(16**DRAW_DIGITS))


def poisson_inverse(u: Column, mean: Column) -> Column:
    """The smallest k with P(X <= k) > u for a Poisson X with this mean.

    The terms are summed upwards as ``p(k) = p(k-1) * mean / k``, from k = 0 for means up to ``MAX_PLAIN_MEAN``. Above,
    where exp(-mean) nears 0 in double precision, they are summed from as far below the mean as the search goes above
    it; the first term there is taken by its logarithm, ``log k!`` by Stirling's series.
    """
    reach = F.sqrt(mean) * TAIL_SIGMAS + TAIL_MIN
    low = F.when(mean > MAX_PLAIN_MEAN, F.floor(mean - reach)).otherwise(0).cast("int")
    k = low.cast("double")
    apart = (mean - k) / k
    log_first = k * (F.log1p(apart) - apart) - F.log(2 * math.pi * k) / 2 - 1 / (12 * k) + 1 / (360 * k * k * k)
    first = F.when(mean > MAX_PLAIN_MEAN, F.exp(log_first)).otherwise(F.exp(-mean))
    steps = F.sequence(low + 1, (mean + reach).cast("int"))
    start = F.struct(low.alias("k"), first.alias("p"), first.alias("c"))

    def step(s: Column, i: Column) -> Column:
        p = s["p"] * mean / i
        go = s["c"] <= u
        return F.struct(
            F.when(go, i).otherwise(s["k"]).alias("k"),
            F.when(go, p).otherwise(s["p"]).alias("p"),
            F.when(go, s["c"] + p).otherwise(s["c"]).alias("c"),
        )

    return F.aggregate(steps, start, step, lambda s: s["k"])


def repetition_rates(
    docs: DataFrame, weights: dict[str | None, float] | None, source: str, exponent: float, epochs: float
) -> tuple[DataFrame, int]:
    """Rows (of_source, rate), and how many there are.

    Without given weights a source's weight is in proportion to ``rows ** exponent``.
    """
    counts = docs.groupBy(F.col(f"`{source}`").alias("of_source")).agg(F.count("*").alias("n"))
    power = F.pow(F.col("n").cast("double"), F.lit(float(exponent)))
    sources, total, mass = counts.agg(F.count("*"), F.sum("n"), F.sum(power)).first()
    if weights is None:
        weight = power / F.lit(mass)
    else:
        named = [F.lit(x) for k, v in weights.items() if k is not None for x in (str(k), float(v))]
        given = F.try_element_at(F.create_map(*named), F.col("of_source").cast("string")) if named else F.lit(None)
        weight = F.when(F.col("of_source").isNull(), F.lit(float(weights.get(None, 0)))).otherwise(F.coalesce(given, F.lit(0.0)))
    rate = weight * F.lit(total) * F.lit(float(epochs)) / F.col("n")
    if weights is not None:  # what a caller asks for is checked; what follows from the corpus' size is not
        rate = F.when(rate > MAX_GIVEN_RATE, F.raise_error(F.lit(f"a repetition rate above {MAX_GIVEN_RATE}: lower the source's weight"))).otherwise(rate)
    return counts.select("of_source", rate.alias("rate")), sources


def drawing_names(rows: DataFrame) -> DataFrame:
    """The rows with ``name``, which no other row has: the ``id``, and the row's place where the id is not its own."""
    repeated = rows.where("id is not null").groupBy(F.col("id").alias("shared")).agg(F.count("*").alias("n")).where("n > 1").select("shared")
    repeated, _ = common.written(repeated, "repeated")
    several = repeated.count()
    rows = rows.withColumn("place", F.monotonically_increasing_id())
    alone = F.col("id").isNotNull()
    if several:
        rows = rows.join(F.broadcast(repeated) if several <= MAX_BROADCAST_IDS else repeated, F.col("id") == F.col("shared"), "left")
        alone = alone & F.col("shared").isNull()
    text = F.col("id").cast("string")
    own = F.concat(F.coalesce(text, F.lit("null")), F.lit("#"), F.col("place").cast("string"))
    return rows.select("doc", "source", F.when(alone, text).otherwise(own).alias("name"))


#: Columns of the draw.
DRAW = ("copy_no", "n_copies", "shuffle_key")


def mix(
    docs: DataFrame,
    weights: dict[str | None, float] | None = None,
    *,
    source: str = "source",
    key: str = "doc_id",
    exponent: float = 0.5,
    epochs: float = 1.0,
    seed: int = 20,
    keep_draw: bool = True,
) -> DataFrame:
    """Replicate every document by its Poisson count and shuffle the copies globally.

    ``weights`` maps sources to target shares; without it they are tempered by ``exponent``. ``epochs`` is the size of
    the mix in passes over the input. With ``keep_draw`` the columns ``copy_no`` (from 1), ``n_copies`` and
    ``shuffle_key`` follow the input's. Rows come in order of ``shuffle_key`` within each file.
    """
    rates, sources = repetition_rates(docs, weights, source, exponent, epochs)
    rates = F.broadcast(rates) if sources <= MAX_BROADCAST_SOURCES else rates
    # the input's columns travel as one, so that no name of theirs meets one of the operator's
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc")
    rows = docs.select(whole, F.col(f"`{key}`").alias("id"), F.col(f"`{source}`").alias("source"))
    drawn = drawing_names(rows).join(rates, F.col("source").eqNullSafe(F.col("of_source")))
    drawn = drawn.withColumn("n_copies", poisson_inverse(uniform(seed, F.col("name")), F.col("rate"))).where("n_copies > 0")
    copies = drawn.withColumn("copy_no", F.explode(F.sequence(F.lit(1), F.col("n_copies"))))
    text = F.concat(F.lit(f"{seed}/"), F.col("name"), F.lit("/"), F.col("copy_no").cast("string"))
    copies = copies.select("doc", "copy_no", "n_copies", F.md5(text).alias("shuffle_key"))
    shuffled = copies.repartition("shuffle_key").sortWithinPartitions("shuffle_key")
    names = [c for c in docs.columns if not (keep_draw and c.lower() in DRAW)]
    return shuffled.select(*[F.col("doc").getField(c).alias(c) for c in names], *(DRAW if keep_draw else ()))


ORACLE_SQL = """
WITH RECURSIVE counts AS (
  SELECT source, count(*) AS n FROM documents GROUP BY source
), totals AS (
  SELECT sum(n) AS total, sum(pow(CAST(n AS DOUBLE), 0.5)) AS mass FROM counts
), rates AS (
  SELECT source, pow(CAST(n AS DOUBLE), 0.5) / mass * total * CAST(1.0 AS DOUBLE) / n AS rate FROM counts, totals
), terms(source, rate, k, p, c) AS (
  SELECT source, rate, 0, exp(-rate), exp(-rate) FROM rates
  UNION ALL
  SELECT source, rate, k + 1, p * rate / (k + 1), c + p * rate / (k + 1) FROM terms
  WHERE k < CAST(floor(rate + sqrt(rate) * 12.0 + 40) AS INTEGER)
), spans AS (
  SELECT source, k, coalesce(lag(c) OVER (PARTITION BY source ORDER BY k), CAST(-1 AS DOUBLE)) AS low, c AS high FROM terms
), drawn AS (
  SELECT *, CAST(('0x' || substr(md5('20:' || CAST(doc_id AS VARCHAR)), 1, 13)) AS BIGINT) / CAST(4503599627370496 AS DOUBLE) AS u
  FROM documents
), counted AS (
  SELECT d.doc_id, d.text, d.lang, d.source, d.n_chars, s.k AS n_copies
  FROM drawn d JOIN spans s ON d.source IS NOT DISTINCT FROM s.source AND d.u >= s.low AND d.u < s.high
  WHERE s.k > 0
)
SELECT doc_id, text, lang, source, n_chars, CAST(copy_no AS INTEGER) AS copy_no, CAST(n_copies AS INTEGER) AS n_copies,
  md5('20/' || CAST(doc_id AS VARCHAR) || '/' || CAST(copy_no AS VARCHAR)) AS shuffle_key
FROM counted, LATERAL (SELECT unnest(range(1, n_copies + 1)) AS copy_no)
"""
