"""From methods and calls to a dependency graph, coupled clusters, concerns and named units."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyweave.operators import graph as G
from tallyweave.operators import spectral as SP
from tallyweave.operators.lineage import cut

#: The node that stands for every database.
DATABASE = "external:database"
# Parts of type names that reach a database.
DATA_ACCESS = ("SqlConnection", "SqlCommand", "SqlDataReader", "DbConnection", "DbCommand", "OleDbConnection")
#: Clusters of at least this many members are cut up; smaller ones pass as they are.
CUT_FROM = 4
#: What members without a concern belong to, and the concern that takes them in.
SHARED = "shared"


def any_of(text: Column, *words: str) -> Column:
    """Whether a text holds one of the words, letters of either case."""
    lower, out = F.lower(text), F.lit(False)
    for w in words:
        out = out | lower.contains(w.lower())
    return F.coalesce(out, F.lit(False))


def has_tag(tags: Column, tag: str) -> Column:
    """Whether an array of tags has the tag, letters of either case."""
    return F.coalesce(F.exists(tags, lambda t: F.lower(t) == tag.lower()), F.lit(False))


def first_match(text: Column, cascade: tuple[tuple[str, tuple[str, ...]], ...]) -> Column:
    """The first label of a cascade (label, words) one of whose words a text holds; null where none does."""
    out = F.lit(None).cast("string")
    for label, words in reversed(cascade):
        out = F.when(any_of(text, *words), label).otherwise(out)
    return out


def reaches_data(type_name: Column) -> Column:
    """Whether a created type is one of those that reach a database."""
    return F.coalesce(type_name.rlike("|".join(DATA_ACCESS)), F.lit(False))


def dependency_edges(methods: DataFrame, calls: DataFrame, created: DataFrame) -> DataFrame:
    """Edges (src, dst, kind), each once, of ``methods`` (id, name, type_id), ``calls`` (id, called), ``created`` (id, type_name).

    A method refers to its type; it calls every method of the called name but itself, and then their types refer to each
    other where they differ; what creates a type that reaches a database, and the type it stands in, access the database.
    """
    owner = methods.select("id", "type_id")
    contained = owner.select(F.col("id").alias("src"), F.col("type_id").alias("dst"), F.lit("References").alias("kind"))
    called = cut(G.resolve_calls(calls, methods))  # its size is known then: few calls are broadcast
    ends = called.join(owner.withColumnsRenamed({"id": "src", "type_id": "src_type"}), "src").join(owner.withColumnsRenamed({"id": "dst", "type_id": "dst_type"}), "dst")
    linked = ends.select(
        F.inline(
            F.array_compact(
                F.array(
                    F.struct("src", "dst", F.lit("Calls").alias("kind")),
                    F.when(F.col("src_type") != F.col("dst_type"), F.struct(F.col("src_type").alias("src"), F.col("dst_type").alias("dst"), F.lit("References").alias("kind"))),
                )
            )
        )
    )
    touching = created.where(reaches_data(F.col("type_name"))).select("id").distinct().join(owner, "id")
    access = touching.select(F.explode(F.array("id", "type_id")).alias("src"), F.lit(DATABASE).alias("dst"), F.lit("DataAccess").alias("kind"))
    return contained.unionByName(linked).unionByName(access).distinct()


def coupling_arcs(edges: DataFrame, methods: DataFrame) -> DataFrame:
    """Arcs (src, dst) for strong components: calls and references between types one way, a method and its type both ways.

    The database is left out.
    """
    member = methods.select(F.col("id").alias("src"), F.lit(True).alias("member"))
    known = edges.where((F.col("dst") != DATABASE) & F.col("kind").isin("Calls", "References")).join(member, "src", "left")
    back = F.when((F.col("kind") == "References") & F.col("member"), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst")))
    return known.select(F.inline(F.array_compact(F.array(F.struct("src", "dst"), back)))).distinct()


def units_of(components: DataFrame) -> DataFrame:
    """Rows (id, unit, members, cut) of components (id, component): a component is a unit, from ``CUT_FROM`` members one to cut."""
    sizes = components.groupBy("component").agg(F.count("*").alias("members"))
    both = components.join(sizes, "component")
    return both.select("id", F.concat(F.lit("unit:"), F.col("component").cast("string")).alias("unit"), "members", (F.col("members") >= CUT_FROM).alias("cut"))


def alone(nodes: DataFrame, components: DataFrame) -> DataFrame:
    """Nodes in no component of two or more."""
    large = components.groupBy("component").agg(F.count("*").alias("n")).where("n > 1").select("component")
    return nodes.select("id").join(components.join(large, "component", "left_semi").select("id"), "id", "left_anti")


def cut_units(units: DataFrame, pairs: DataFrame, depth: int = 2) -> DataFrame:
    """Rows (id, unit) of units (id, unit, cut) and affinities (i, j, w): units to cut get the path of their side at the end.

    Members without any affinity within their unit stay in the unit itself.
    """
    end = lambda x: units.where("cut").select(F.col("id").alias(x), F.col("unit").alias(f"{x}_unit"))
    inner = pairs.join(end("i"), "i").join(end("j"), "j").where("i_unit = j_unit").select(F.col("i_unit").alias("graph"), "i", "j", "w")
    parts = SP.spectral_clusters(inner, "graph", depth).select(F.col("node").alias("id"), "cluster")
    return units.join(parts, "id", "left").select("id", F.when(F.col("cluster").isNull(), F.col("unit")).otherwise(F.concat("unit", F.lit("/"), "cluster")).alias("unit"))


def rules_per_module(rules: DataFrame, modules: DataFrame) -> DataFrame:
    """Rows (id, n_rules): how many rules (rule, refs) name each module."""
    named = rules.select("rule", F.explode("refs").alias("id")).distinct().groupBy("id").agg(F.count("*").alias("n"))
    return modules.select("id").join(named, "id", "left").select("id", F.coalesce("n", F.lit(0)).alias("n_rules"))


def references(rules: DataFrame, members: DataFrame) -> DataFrame:
    """Rows (rule, concern, id): the members that a rule's ``refs`` name."""
    return rules.select("rule", "concern", F.explode("refs").alias("id")).join(members.select("id").distinct(), "id", "left_semi")


def assign_concerns(members: DataFrame, rules: DataFrame, fan_out: DataFrame, by_name: Column, order: tuple[str, ...], lead: str) -> DataFrame:
    """Rows (id, concern) of ``members`` (id, name), with ``rules`` (rule, concern, refs) and ``fan_out`` (id, fan_out).

    Of the members that rules of the ``lead`` concern name, the one with the largest fan-out (ties by id) leads and has
    that concern. Any other takes the concern that most other rules give it, ties by ``order``; a member that no rule
    names is judged by its name, ``SHARED`` where that says nothing.
    """
    named = references(rules.where("concern is not null"), members)
    candidates = named.where(F.col("concern") == lead).select("id").distinct().join(fan_out, "id", "left")
    first = candidates.orderBy(F.desc(F.coalesce("fan_out", F.lit(0))), "id").limit(1).select("id", F.lit(lead).alias("leads"))
    rank = F.coalesce(F.array_position(F.array(*[F.lit(c) for c in order]), F.col("concern")).cast("int"), F.lit(0))
    votes = named.where(F.col("concern") != lead).groupBy("id", "concern").agg(F.count("*").alias("n"))
    most = votes.groupBy("id").agg(F.min(F.struct((-F.col("n")).alias("less"), rank.alias("rank"), "concern")).alias("m"))
    out = members.join(F.broadcast(first), "id", "left").join(most.select("id", F.col("m.concern").alias("voted")), "id", "left")
    return out.select("id", F.coalesce("leads", "voted", by_name, F.lit(SHARED)).alias("concern"))


def named_units(concerns: DataFrame, risks: DataFrame, order: tuple[str, ...], shared_into: str) -> DataFrame:
    """Rows (unit, members sorted, risk) of concerns (id, concern), in the order of concerns; ``SHARED`` members join one of them."""
    owned = concerns.select("id", F.when(F.col("concern") == SHARED, shared_into).otherwise(F.col("concern")).alias("concern")).join(risks, "id", "left")
    got = owned.groupBy("concern").agg(F.sort_array(F.collect_list("id")).alias("members"), F.coalesce(F.max("risk"), F.lit(0.0)).alias("risk"))
    place = F.array_position(F.array(*[F.lit(c) for c in order]), F.col("concern"))
    return got.select(F.concat(F.lit("unit:"), F.col("concern")).alias("unit"), place.alias("place"), "members", "risk").orderBy("place")


def type_complexity(methods: DataFrame) -> DataFrame:
    """Rows (type_id, complexity, coupling, fan_out, nesting, worst) of methods with these columns: sums, the deepest nesting, the worst method."""
    total = lambda c: F.sum(c).alias(c)
    return methods.groupBy("type_id").agg(total("complexity"), total("coupling"), total("fan_out"), F.max("nesting").alias("nesting"), F.max("complexity").alias("worst"))


def statement_of(rule: Column, statements: dict[str, str], fallback: str) -> Column:
    """The statement of a rule id, letters of either case, or a fallback."""
    pairs = [F.lit(x) for k, v in statements.items() for x in (k.lower(), v)]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), F.lower(rule)), F.lit(fallback)) if pairs else F.lit(fallback)


def upto_break(entries: DataFrame, checked: DataFrame, chain: str) -> DataFrame:
    """The entries of every chain before its first break, all of an unbroken one; ``checked`` has (chain, first_break)."""
    return entries.join(checked.select(chain, "first_break"), chain).where(F.col("first_break").isNull() | (F.col("seq") < F.col("first_break"))).drop("first_break")


def quiet_legs(legs: DataFrame, route: str) -> DataFrame:
    """Rows (route, still, crossings): legs of no length, and legs from one hemisphere into the other."""
    w = Window.partitionBy(route).orderBy("leg")
    moved = legs.withColumn("before", F.lag("south").over(w))
    return moved.groupBy(route).agg(F.sum((F.col("distance") == 0).cast("bigint")).alias("still"), F.sum(F.coalesce(F.col("south") != F.col("before"), F.lit(False)).cast("bigint")).alias("crossings"))


def to_units(degrees: Column, per_degree: int = 10_000) -> Column:
    """Degrees as whole units of a fixed point scale, ties to even."""
    return F.rint(degrees * per_degree).cast("bigint")


def wrapped_units(delta: Column, per_degree: int = 10_000) -> Column:
    """A difference of longitudes in units, wrapped once into half a turn either way."""
    half = 180 * per_degree
    return F.when(delta > half, delta - 2 * half).when(delta < -half, delta + 2 * half).otherwise(delta)


def in_box(lat: Column, lon: Column, box: tuple[int, int, int, int]) -> Column:
    """Whether a point in units lies in a box (south, west, north, east), its edges included."""
    south, west, north, east = box
    return lat.between(south, north) & lon.between(west, east)


def items_by_words(rules: DataFrame, defects: tuple[tuple[str, str, tuple[str, ...]], ...]) -> DataFrame:
    """Rows (item, weakness, status) of the defects (item, weakness, words) that the text of some rule mentions.

    ``rules`` has (id, statement, expression); one pass finds for every defect whether any of its words occurs.
    """
    text = F.concat_ws("\n", "id", "statement", "expression")
    found = rules.agg(*[F.coalesce(F.max(any_of(text, *words)), F.lit(False)).alias(item) for item, _, words in defects])
    rows = [F.when(F.col(item), F.struct(F.lit(item).alias("item"), F.lit(weakness).alias("weakness"), F.lit("Open").alias("status"))) for item, weakness, _ in defects]
    return found.select(F.inline(F.array_compact(F.array(*rows))))
