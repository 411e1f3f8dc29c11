"""A generated corpus of routes with tags, and the three route models over arrays of points.

Everything follows from hashes of seed and id, so any part of the corpus can be made anywhere, in any number of tasks.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyweave.functions import scalars as S
from tallyweave.operators import differential as D

# The classes of routes and their counts in a corpus of 2000.
TAG_COUNTS = {"nominal": 900, "precision-drift": 350, "degenerate-route": 200, "anti-meridian": 150, "leap-second": 200, "overflow": 200}
BASELINE_DECIMALS = 8
#: A quiet launch, far from all boundary epochs, and the first second that 32 bits without a sign do not hold.
QUIET_LAUNCH, OVERFLOW_LAUNCH = 1_500_000_000, 1 << 32


@dataclass(frozen=True)
class Shape:
    """A class of routes: legs, their stride in degrees and how far headings stray, from one end of a range to the other."""

    tag: str
    legs: tuple[int, int]
    stride: tuple[float, float]
    stray: float = 0.0
    start_lon: tuple[float, float] = (-100.0, 100.0)
    heading: tuple[float, float] = (0.0, 360.0)
    #: Where the launch lies, and the share of rows whose desired arrival is as late as the tolerance allows.
    launch: str = "quiet"
    late: float = 0.0


#: Long legs and short ones, legs of no length or beyond the box, a crossing of the date line, launches near boundaries.
SHAPES = (
    Shape("nominal", (1, 5), (2.0, 9.0), stray=40.0),
    Shape("precision-drift", (10, 30), (0.05, 1.0), stray=20.0),
    Shape("degenerate-route", (1, 2), (0.0, 45.0)),
    Shape("anti-meridian", (1, 3), (3.0, 7.0), stray=5.0, start_lon=(177.5, 179.5), heading=(75.0, 105.0)),
    Shape("leap-second", (1, 4), (3.0, 8.0), stray=30.0, launch="boundary", late=0.6),
    Shape("overflow", (1, 4), (3.0, 8.0), stray=30.0, launch="overflow", late=0.5),
)


def _u(seed: int, *what: Column | str) -> Column:
    """A number in [0, 1) from an MD5 of seed, id and a name, 40 bits of it."""
    named = [F.lit(w) if isinstance(w, str) else w.cast("string") for w in what]
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("id").cast("string"), *named))
    return F.conv(F.substring(digest, 1, 10), 16, 10).cast("bigint") / F.lit(float(1 << 40))


def _field(name: str) -> Column:
    return F.col(f"shape.{name}")


def _within(u: Column, name: str) -> Column:
    """A number in the range of the row's shape."""
    return _field(name)[0] + u * (_field(name)[1] - _field(name)[0])


#: Rows of a table take places of the classes' list by this step, prime to its length, so that neighbours differ.
STEP = 7919


def _shapes(place: Column, n: int) -> Column:
    """The shape of a row by its place among n, the classes in proportion to their counts."""
    def literal(s: Shape) -> Column:
        pair = lambda t: F.array(*[F.lit(float(x)) for x in t])
        whole = {"legs": pair(s.legs), "stride": pair(s.stride), "stray": F.lit(s.stray), "start_lon": pair(s.start_lon), "heading": pair(s.heading)}
        return F.struct(F.lit(s.tag).alias("tag"), F.lit(s.launch).alias("launch"), F.lit(s.late).alias("late"), *[v.alias(k) for k, v in whole.items()])

    total, upto, out = sum(TAG_COUNTS.values()), 0, None
    for s in SHAPES:
        upto += TAG_COUNTS[s.tag]
        here = place * total < F.lit(upto * n)
        out = F.when(here, literal(s)) if out is None else out.when(here, literal(s))
    return out


def routes(spark: SparkSession, n: int = 2000, seed: int = 2024) -> DataFrame:
    """n routes with ids from 0, the classes in proportion, in order of ids."""
    return _made(spark.range(n).withColumn("shape", _shapes(F.col("id"), n)), seed)


def routes_of(rows: DataFrame, key: str, seed: int = 2024) -> DataFrame:
    """A route for every row of a table with integer keys, the classes about in proportion."""
    n = sum(TAG_COUNTS.values())
    # few bytes and much work for each: keys are dealt to a stated number of partitions, which are not put together
    dealt = rows.select(F.col(key).cast("long").alias("id")).repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "id")
    return _made(dealt.withColumn("shape", _shapes(F.pmod(F.col("id") * STEP, F.lit(n)), n)), seed)


def _made(rows: DataFrame, seed: int) -> DataFrame:
    """Rows (id, tag, launch, points, late) of rows (id, shape).

    A route leaves its start on a heading and strays from it leg by leg; points are sums of legs, latitudes are kept
    away from the poles, and longitudes are written within [-180, 180].
    """
    legs = F.floor(_field("legs")[0] + _u(seed, "legs") * (_field("legs")[1] - _field("legs")[0] + 1)).cast("int")
    heading = _within(_u(seed, "heading"), "heading")
    # a stride of a degenerate class is either nothing or beyond the box
    stride = F.when(_field("tag") == "degenerate-route", F.when(_u(seed, "still") < 0.5, _field("stride")[0]).otherwise(_field("stride")[1])).otherwise(_within(_u(seed, "stride"), "stride"))
    # what is the same for all legs goes in by arrays, never within a lambda: there it would be drawn anew for every leg
    strays = F.transform(F.sequence(F.lit(1), legs), lambda i: (2 * _u(seed, "stray", i) - 1) * _field("stray"))
    rows = rows.withColumns({"stride": stride, "strays": strays, "heading": heading})
    turns = F.zip_with(F.array_repeat("heading", F.size("strays")), "strays", lambda h, s: F.radians(h + s))
    steps = F.zip_with(F.array_repeat("stride", F.size("strays")), turns, lambda d, h: F.struct((F.cos(h) * d).alias("north"), (F.sin(h) * d).alias("east")))
    rows = rows.withColumn("steps", steps)
    start_lat, start_lon = 20 * (2 * _u(seed, "lat") - 1), _within(_u(seed, "lon"), "start_lon")
    # sums of the first legs, from none to all, each from the one before
    none = F.array(F.struct(F.lit(0.0).alias("north"), F.lit(0.0).alias("east")))
    last = lambda sums: F.element_at(sums, -1)
    sums = F.aggregate("steps", none, lambda s, d: F.concat(s, F.array(F.struct((last(s)["north"] + d["north"]).alias("north"), (last(s)["east"] + d["east"]).alias("east")))))
    rows = rows.withColumns({"sums": sums, "lat0": start_lat, "lon0": start_lon})

    def point(start: Column, moved: Column) -> Column:
        lat, lon = start["lat"] + start["flip"] * moved["north"], start["lon"] + moved["east"]
        return F.struct(F.greatest(F.least(lat, F.lit(85.0)), F.lit(-85.0)).alias("lat"), S.wrap_to_180(lon).alias("lon"))

    north = last(F.col("sums"))["north"]
    flip = F.when(F.abs(F.col("lat0") + north) > F.abs(F.col("lat0") - north), -1.0).otherwise(1.0)
    start = F.struct(F.col("lat0").alias("lat"), F.col("lon0").alias("lon"), flip.alias("flip"))
    rows = rows.withColumn("points", F.zip_with(F.array_repeat(start, F.size("sums")), "sums", point))
    # a launch near a boundary lies so far before it that half to all of the journey is behind it
    journey = _sum(_next(F.col("points"), lambda a, b: S.flat_distance(*_ends(a, b)))) / S.SPEED_NM_PER_SEC
    epochs = F.array(*[F.lit(e) for e in S.BOUNDARY_EPOCHS])
    boundary = F.element_at(epochs, (F.floor(_u(seed, "boundary") * len(S.BOUNDARY_EPOCHS)) + 1).cast("int")).cast("bigint")
    ahead = (journey * (0.2 + 0.7 * _u(seed, "ahead"))).cast("bigint")
    kinds = F.when(_field("launch") == "boundary", boundary - ahead).when(_field("launch") == "overflow", F.lit(OVERFLOW_LAUNCH) - ahead)
    launch = kinds.otherwise(F.lit(QUIET_LAUNCH)).cast("bigint")
    return rows.select("id", _field("tag").alias("tag"), launch.alias("launch"), "points", (_u(seed, "late") < _field("late")).alias("late"))


def _next(values: Column, f) -> Column:
    """``f`` of every two neighbours; empty for fewer than two."""
    n = F.greatest(F.size(values) - 1, F.lit(0))
    return F.zip_with(F.slice(values, 1, n), F.slice(values, 2, n), f)


def _ends(a: Column, b: Column) -> tuple[Column, ...]:
    return a["lat"], a["lon"], b["lat"], b["lon"]


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x)


def _legs(points: Column, wrapped: bool) -> Column:
    """Exact legs over wrapped longitudes, or rounded ones over plain differences."""
    exact = _next(points, lambda a, b: S.flat_distance(*_ends(a, b), wrapped=wrapped))
    return exact if wrapped else F.transform(exact, lambda x: F.bround(x, BASELINE_DECIMALS))


def evaluate(vectors: DataFrame, repaired: Column) -> DataFrame:
    """Outputs of reference, baseline and candidate: legs, total, arrival, decisions, counts and messages.

    The reference wraps longitudes, sums exact legs, rounds the travel time and adds boundary seconds; the baseline does
    none of that and rounds every leg. The candidate is the baseline, but the reference where ``repaired`` holds. Box and
    turns are judged on wrapped longitudes by all; each model counts them from its own legs, though.
    """
    p = F.col("points")
    apart = {"ref": True, "base": False}
    out = vectors
    for who, wrapped in apart.items():
        out = out.withColumn(f"{who}_legs", _legs(p, wrapped)).withColumn(f"{who}_total", _sum(F.col(f"{who}_legs")))
    far = _next(p, lambda a, b: (F.abs(b["lat"] - a["lat"]) > S.MAX_LEG_DLAT_DEG) | (F.abs(S.wrap_to_180(b["lon"] - a["lon"])) > S.MAX_LEG_DLON_DEG))
    out = out.withColumn("bearings", _next(p, lambda a, b: S.bearing(*_ends(a, b))))
    turns = _next(F.col("bearings"), lambda b1, b2: S.turn_angle(b1, b2) > S.MAX_TURN_DEG)
    out = out.withColumns({"n_far": F.size(F.filter(far, lambda x: x)), "n_turns": F.size(F.filter(turns, lambda x: x))}).drop("bearings")
    rounded = F.col("launch") + F.rint(F.col("ref_total") / S.SPEED_NM_PER_SEC).cast("bigint")
    out = out.withColumn("ref_eta", rounded + S.boundaries_between(F.col("launch"), rounded))
    out = out.withColumn("base_eta", F.col("launch") + (F.col("base_total") / S.SPEED_NM_PER_SEC).cast("bigint"))
    out = out.withColumn("desired", F.col("ref_eta") + F.when(F.col("late"), S.ARRIVAL_TOLERANCE_SEC).otherwise(0))
    for who in apart:
        feasible = F.abs(F.col(f"{who}_eta") - F.col("desired")) <= S.ARRIVAL_TOLERANCE_SEC
        valid = (F.col("n_far") == 0) & (F.col("n_turns") == 0)
        out = out.withColumns({f"{who}_points": F.size(f"{who}_legs") + 1, f"{who}_valid": valid, f"{who}_feasible": feasible, f"{who}_go": valid & feasible})
        out = out.withColumn(f"{who}_messages", F.col("n_far") + F.col("n_turns") + (~F.col(f"{who}_valid")).cast("int") + (~F.col(f"{who}_go")).cast("int"))
    for what in ("legs", "total", "eta", "feasible", "points", "valid", "go", "messages"):
        out = out.withColumn(f"cand_{what}", F.when(repaired, F.col(f"ref_{what}")).otherwise(F.col(f"base_{what}")))
    return out


def oracles() -> list[D.Oracle]:
    """Six discrete and two continuous oracles, and three on the rows of one tag."""
    c = F.col
    of = lambda x: (c(f"base_{x}"), c(f"cand_{x}"), c(f"ref_{x}"))
    discrete = lambda name, what: D.Oracle(name, "discrete", D.discrete_vote(*of(what)))
    legs = D.array_vote(*of("legs"))
    total, rel, eta = D.continuous_vote(*of("total")), S.relative_error(c("base_total"), c("cand_total")), D.discrete_vote(*of("eta"))
    return [
        discrete("valid", "valid"),
        discrete("go", "go"),
        discrete("feasible", "feasible"),
        D.Oracle("eta", "discrete", eta),
        discrete("point_count", "points"),
        discrete("message_count", "messages"),
        D.Oracle("leg_distances", "continuous", legs["vote"], legs["rel"]),
        D.Oracle("total_distance", "continuous", total, rel),
        D.Oracle("property:anti-meridian", "continuous", legs["vote"], legs["rel"], c("tag") == "anti-meridian"),
        D.Oracle("property:leap-second", "discrete", eta, None, c("tag") == "leap-second"),
        D.Oracle("property:precision", "continuous", total, rel, c("tag") == "precision-drift"),
    ]


def distance_error(who: str, other: str) -> Column:
    """The largest relative error over the total and all legs of two models; infinite where they have other numbers of legs."""
    a, b = F.col(f"{who}_legs"), F.col(f"{other}_legs")
    each = F.aggregate(F.zip_with(a, b, lambda x, y: S.relative_error(x, y)), F.lit(0.0), lambda s, x: F.greatest(s, x))
    return F.when(F.size(a) == F.size(b), F.greatest(S.relative_error(F.col(f"{who}_total"), F.col(f"{other}_total")), each)).otherwise(F.lit(float("inf")))


def divergent() -> Column:
    """Whether the baseline differs from the reference in distances or in a decision; an arrival alone does not count."""
    flips = F.lit(False)
    for what in ("valid", "feasible", "go"):
        flips = flips | (F.col(f"base_{what}") != F.col(f"ref_{what}"))
    return flips | (distance_error("base", "ref") > S.RELATIVE_TOLERANCE)


def replay_mismatches(vectors: DataFrame, who: str) -> DataFrame:
    """Rows (id, field) where a model's recorded output (columns ``key_<what>``) is not what the model gives now."""
    checks = {what: ~F.col(f"{who}_{what}").eqNullSafe(F.col(f"key_{what}")) for what in ("eta", "feasible", "valid", "go", "points", "messages")}
    checks["distances"] = (F.size(f"{who}_legs") != F.size("key_legs")) | (S.relative_error(F.col(f"{who}_total"), F.col("key_total")) > S.RELATIVE_TOLERANCE)
    return vectors.select("id", F.explode(F.array_compact(F.array(*[F.when(c, F.lit(k)) for k, c in checks.items()]))).alias("field"))


def record(vectors: DataFrame, who: str) -> DataFrame:
    """The vectors with one model's outputs as the key that later runs are checked against."""
    return vectors.withColumns({f"key_{w}": F.col(f"{who}_{w}") for w in ("legs", "total", "eta", "feasible", "valid", "go", "points", "messages")})


def flipped(vectors: DataFrame, column: str, where: Column) -> DataFrame:
    """A mutant for tests of the comparison: some values of a boolean column turned round."""
    return vectors.withColumn(column, F.when(where, ~F.col(column)).otherwise(F.col(column)))


def perturbed(vectors: DataFrame, column: str, factor: float, where: Column) -> DataFrame:
    """A mutant for tests of the comparison: some values of a column times a factor."""
    return vectors.withColumn(column, F.when(where, F.col(column) * factor).otherwise(F.col(column)))


def by_tag(vectors: DataFrame) -> DataFrame:
    """Rows (tag, n, divergent) of all tags."""
    return vectors.groupBy("tag").agg(F.count("*").alias("n"), F.sum(divergent().cast("bigint")).alias("divergent"))


def checked_share(stats: DataFrame, low: float = 0.10, high: float = 0.25) -> DataFrame:
    """One row (n, divergent, share); an error where the share of divergent vectors leaves its band."""
    got = stats.agg(F.sum("n").alias("n"), F.sum("divergent").alias("divergent")).withColumn("share", F.col("divergent") / F.col("n"))
    outside = F.raise_error(F.format_string("the divergent share %f leaves its band", F.col("share"))).cast("double")
    return got.withColumn("share", F.when(F.col("share").between(low, high), F.col("share")).otherwise(outside))
