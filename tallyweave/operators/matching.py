"""Set-similarity matching of statements and its score."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyweave.functions import scalars as S
from tallyweave.operators.lineage import cut

THRESHOLD = 0.18


# The categories that a rule may have.
CATEGORIES = ("Calculation", "Validation", "Routing", "Constraint")


def similar_pairs(left: DataFrame, right: DataFrame, category: str, threshold: float = THRESHOLD) -> DataFrame:
    """Pairs of one category whose keyword sets have a Jaccard coefficient of at least the threshold.

    Both sides have (id, category, toks). Sides meet by category and keyword where their sizes allow the coefficient, and
    what a pair shares is the number of times that it meets: one join and one sum with partial aggregates. At thresholds as
    low as this prefixes of rare keywords leave hardly anything out, so no set travels and none is compared again; rows of
    a frequent keyword are dealt to several tasks by adaptive execution, and where one side is small it is broadcast.
    """

    def side(d: DataFrame, s: str) -> DataFrame:
        return d.select(category, F.col("id").alias(f"{s}_id"), F.size("toks").alias(f"{s}_n"), F.explode(F.array_distinct("toks")).alias("tok"))

    sizes = F.least("l_n", "r_n") >= threshold * F.greatest("l_n", "r_n") - 1e-9
    met = side(left, "l").join(side(right, "r"), [category, "tok"]).where(sizes)
    pairs = met.groupBy(category, "l_id", "r_id", "l_n", "r_n").agg(F.count("*").alias("shared"))
    return pairs.withColumn("jaccard", F.col("shared") / (F.col("l_n") + F.col("r_n") - F.col("shared"))).where(F.col("jaccard") >= threshold)


def greedy_match(pairs: DataFrame, category: str) -> DataFrame:
    """One-to-one assignment: the best pair left first, by coefficient and then by ids.

    In rounds: a pair that is the best of both its ends would be taken by the sequential rule too, so all such pairs
    are taken at once and the pairs of their ends go. The order of pairs is strict, so the result is the sequential one.
    """
    rank = F.struct((-F.col("jaccard")).alias("less"), "l_id", "r_id")
    left = cut(pairs.select(category, "l_id", "r_id", "jaccard"))
    taken = None
    while True:  # every round takes at least the best pair of all that are left
        best = lambda end: left.groupBy(category, end).agg(F.min(rank).alias("best")).select(category, F.col("best.l_id").alias("l_id"), F.col("best.r_id").alias("r_id"))
        both = best("l_id").intersect(best("r_id"))
        won = cut(left.join(both, [category, "l_id", "r_id"], "left_semi"))
        taken = won if taken is None else taken.unionByName(won)
        left = cut(left.join(won.select(category, "l_id"), [category, "l_id"], "left_anti").join(won.select(category, "r_id"), [category, "r_id"], "left_anti"))
        if left.isEmpty():
            return taken


def match_score(matches: DataFrame, left: DataFrame, right: DataFrame, category: str) -> DataFrame:
    """Precision, recall and F1 of the matches by category: left is what should be found, right what was found."""
    n = lambda d, name: d.groupBy(category).agg(F.count("*").alias(name))
    out = n(left, "expected").join(n(right, "found"), category, "full").join(n(matches, "matched"), category, "left").na.fill(0)
    ratio = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))
    out = out.withColumns({"precision": ratio("matched", "found"), "recall": ratio("matched", "expected")})
    both = F.col("precision") + F.col("recall")
    return out.withColumn("f1", F.when(both > 0, 2 * F.col("precision") * F.col("recall") / both).otherwise(F.lit(0.0)))


def with_tokens(df: DataFrame, key: str, text: str, category: Column) -> DataFrame:
    return df.select(F.col(key).alias("id"), category.alias("category"), S.tokens(F.col(text)).alias("toks"))


def parse_turtle(blocks: DataFrame, text: str) -> DataFrame:
    """Rules of Turtle statements, one block in a row: category, label, statement, expression, references.

    A comment from a # outside quotes to the end of its line is stripped; blocks without a known category give no row.
    """
    bare = F.regexp_replace(F.col(text), r'(?m)^((?:[^"#\n]|"(?:[^"\\]|\\.)*")*)#.*$', "$1")
    value = lambda p: F.nullif(F.regexp_extract("__t", p + r'\s+"((?:[^"\\]|\\.)*)"', 1), F.lit(""))
    out = blocks.withColumn("__t", bare)
    out = out.withColumns({"category": value(":category"), "label": value("rdfs:label"), "statement": value(":statement"), "expression": value(":expression")})
    return out.withColumn("refs", F.regexp_extract_all("__t", F.lit(r':sourceRef\s+"((?:[^"\\]|\\.)*)"'), F.lit(1))).where(F.col("category").isin(*CATEGORIES)).drop("__t")
