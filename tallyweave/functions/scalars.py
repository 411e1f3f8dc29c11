"""Scalar column functions: errors and bounds, geometry, text measures, naming and quoting."""

from __future__ import annotations

import math
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the route model.
EARTH_RADIUS_NM = 3440.065
MAX_LEG_DLAT_DEG = MAX_LEG_DLON_DEG = 22.0
MAX_TURN_DEG = 120.0
SPEED_NM_PER_SEC = 0.15
ARRIVAL_TOLERANCE_SEC = 120
BOUNDARY_EPOCHS = (1_000_000_000, 1_100_000_000, 1_200_000_000, 2_000_000_000, 4_000_000_000)
RELATIVE_TOLERANCE, ABSOLUTE_FLOOR = 1e-9, 1e-12

# Words that carry no meaning when statements are compared.
STOPWORDS = (
    "a an the is are be of to and or not if only each all any must may that this so on in at with without before after every"
    " for from plus its it as by than into then else when where which between up out off near do does using use used per value values"
    " check copy left right along forall abs sum round sqrt cos sin"
).split()


def relative_error(a: Column, b: Column, floor: float = ABSOLUTE_FLOOR) -> Column:
    """|a - b| over the larger magnitude, with a floor for values near zero."""
    return F.abs(a - b) / F.greatest(F.abs(a), F.abs(b), F.lit(max(floor, 1e-12)))


def saturate(value: Column, cap: float) -> Column:
    """value / cap, held to [0, 1]; 0 for a cap that is not positive."""
    return F.lit(0.0) if cap <= 0 else F.least(F.greatest(value / F.lit(float(cap)), F.lit(0.0)), F.lit(1.0))


def upper_bound(n: Column, confidence: float) -> Column:
    """Upper confidence bound of a rate after n trials without a failure; infinite for n <= 0."""
    if not 0 < confidence < 1:
        raise ValueError("the confidence lies between 0 and 1")
    return F.when(n > 0, F.lit(math.log(1.0 / (1.0 - confidence))) / n).otherwise(F.lit(float("inf")))


def half_even_div(n: Column, by: int) -> Column:
    """Integer division of a bigint, ties to the even quotient; exact on every engine."""
    low = F.floor(n / F.lit(by)) if by == 1 else (n - F.pmod(n, F.lit(by))) / F.lit(by)
    q, r = low.cast("bigint"), F.pmod(n, F.lit(by))
    up = (2 * r > by) | ((2 * r == by) & (F.pmod(q, F.lit(2)) == 1))
    return q + up.cast("bigint")


def wrap_to_180(dlon: Column) -> Column:
    """A longitude difference of magnitude up to 540 wrapped to [-180, 180]; both ends stay as they are."""
    return F.when(dlon > 180.0, dlon - 360.0).when(dlon < -180.0, dlon + 360.0).otherwise(dlon)


def flat_distance(lat1: Column, lon1: Column, lat2: Column, lon2: Column, wrapped: bool = True) -> Column:
    """Equirectangular distance in nautical miles."""
    dlon = wrap_to_180(lon2 - lon1) if wrapped else lon2 - lon1
    x = F.radians(dlon) * F.cos(F.radians((lat1 + lat2) / 2.0))
    y = F.radians(lat2 - lat1)
    return F.lit(EARTH_RADIUS_NM) * F.sqrt(x * x + y * y)


def bearing(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Initial bearing in [0, 360)."""
    p, q, d = F.radians(lat1), F.radians(lat2), F.radians(wrap_to_180(lon2 - lon1))
    angle = F.atan2(F.sin(d) * F.cos(q), F.cos(p) * F.sin(q) - F.sin(p) * F.cos(q) * F.cos(d))
    return F.pmod(F.degrees(angle) + 360.0, F.lit(360.0))


def turn_angle(b1: Column, b2: Column) -> Column:
    """Turn between two bearings in [0, 180]."""
    d = F.pmod(F.abs(b2 - b1), F.lit(360.0))
    return F.when(d > 180.0, 360.0 - d).otherwise(d)


def boundaries_between(a: Column, b: Column, epochs: tuple[int, ...] = BOUNDARY_EPOCHS) -> Column:
    """How many epochs lie in (min, max] of two times; the order of the times does not matter."""
    lo, hi = F.least(a, b), F.greatest(a, b)
    listed = F.array(*[F.lit(e).cast("bigint") for e in epochs])
    return F.size(F.filter(listed, lambda e: (e > lo) & (e <= hi)))


def tokens(text: Column) -> Column:
    """Distinct keywords: lower case, alphanumeric, no stop words, no single letters."""
    words = F.split(F.lower(text), "[^a-z0-9]+")
    some = F.array_except(words, F.array(*[F.lit(w) for w in ("", *STOPWORDS)]))  # by a hash set, each word once, in order of first use
    return F.filter(some, lambda w: (F.length(w) > 1) | w.rlike("^[0-9]"))


def jaccard(a: Column, b: Column) -> Column:
    """Jaccard coefficient of two arrays of distinct values; 0 where both are empty."""
    both = F.size(F.array_intersect(a, b))
    return F.coalesce(F.try_divide(both.cast("double"), F.size(a) + F.size(b) - both), F.lit(0.0))


def line_count(text: Column) -> Column:
    return F.size(F.split(text, "\n"))


def line_of(text: Column, offset: Column) -> Column:
    """The line, from 1, of a character offset; offsets outside the text count as its ends."""
    before = F.substring(text, F.lit(1), F.greatest(offset, F.lit(0)))
    return 1 + F.length(before) - F.length(F.replace(before, F.lit("\n"), F.lit("")))


def braces_balanced(text: Column) -> Column:
    """Curly braces and parentheses close in order: no prefix closes more than it opened, and all close in the end."""
    marks = F.split(F.regexp_replace(text, "[^{}()]", ""), "")
    start = F.struct(F.lit(0).alias("c"), F.lit(0).alias("p"), F.lit(True).alias("ok"))

    def step(s: Column, m: Column) -> Column:
        c = s["c"] + F.when(m == "{", 1).when(m == "}", -1).otherwise(0)
        p = s["p"] + F.when(m == "(", 1).when(m == ")", -1).otherwise(0)
        return F.struct(c.alias("c"), p.alias("p"), (s["ok"] & (c >= 0) & (p >= 0)).alias("ok"))

    return F.aggregate(marks, start, step, lambda s: s["ok"] & (s["c"] == 0) & (s["p"] == 0))


def ascii_words(regex: str) -> str:
    """A pattern whose word boundaries know ASCII letters, digits and underscores only, as ``\\w`` does.

    Java up to 18 takes every Unicode letter for part of a word at ``\\b`` (but not in ``\\w``), other engines do not.
    """
    boundary = r"(?:(?<=\w)(?!\w)|(?<!\w)(?=\w))"
    return re.sub(r"\\(.)", lambda m: boundary if m[1] == "b" else m[0], regex, flags=re.S)


def keyword_complexity(text: Column, patterns: tuple[str, ...]) -> Column:
    """1 + the matches of all patterns, letters of either case."""
    total = F.lit(1)
    for p in patterns:
        total = total + F.regexp_count(text, F.lit(f"(?i){ascii_words(p)}"))
    return total


def severity_rank(severity: Column) -> Column:
    """Critical 4, High 3, Medium 2, Low 1, others 0."""
    return F.when(severity == "Critical", 4).when(severity == "High", 3).when(severity == "Medium", 2).when(severity == "Low", 1).otherwise(0)


def sha256(text: Column) -> Column:
    return F.sha2(F.encode(text, "UTF-8"), 256)


def hash_uuid(seed: Column) -> Column:
    """A stable text of UUID shape from the SHA-256 of a seed."""
    h = sha256(seed)
    return F.concat_ws("-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])


def file_extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))


def safe_name(text: Column) -> Column:
    """Everything but letters, digits, dot, dash and underscore becomes an underscore."""
    return F.regexp_replace(text, r"[^A-Za-z0-9._-]", "_")


def slug(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "(^-)|(-$)", "")


def node_id(text: Column) -> Column:
    """An identifier for diagrams: letters, digits and underscores, starting with a letter."""
    s = F.regexp_replace(text, r"[^\p{L}\p{N}]", "_")
    return F.when(s.rlike(r"^\p{L}"), s).otherwise(F.concat(F.lit("u_"), s))


def csv_field(text: Column) -> Column:
    """Quoted where it holds a comma, quote or line break."""
    return F.when(text.rlike("[,\"\n\r]"), F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(text)


def turtle_literal(text: Column) -> Column:
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for raw, escaped in (('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        out = F.replace(out, F.lit(raw), F.lit(escaped))
    return F.concat(F.lit('"'), out, F.lit('"'))


def yaml_scalar(text: Column) -> Column:
    """Quoted where it is empty, has outer blanks or holds a character with a meaning in YAML."""
    special = text.rlike(r"""^$|^\s|\s$|[:#\-{}\[\],&*!|>'"%@`]""")
    quoted = F.concat(F.lit('"'), F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))
    return F.when(special, quoted).otherwise(text)


def is_true(value: Column) -> Column:
    return F.coalesce(F.lower(F.trim(value)) == "true", F.lit(False))


def given(value: Column) -> Column:
    return F.coalesce(F.trim(value) != "", F.lit(False))


def feature_match(features: Column, weights: Column) -> Column:
    """The weight of a feature map by magnitude: sum |f| w / sum |f|; 1 for a map without magnitude."""
    entries = F.map_entries(features)
    total = F.aggregate(entries, F.lit(0.0), lambda s, e: s + F.abs(e["value"]))
    matched = F.aggregate(entries, F.lit(0.0), lambda s, e: s + F.abs(e["value"]) * F.coalesce(F.try_element_at(weights, e["key"]), F.lit(0.0)))
    return F.when(total > 0, matched / total).otherwise(F.lit(1.0))
