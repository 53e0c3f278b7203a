"""Conflicts: restrictions about a common entity, of one kind and unit, whose bounds leave nothing in common."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalars import amount_text, comparable, lower_bound, normalize, upper_bound
from ..schema import Graph
from ..sources.store import FEW, counted, materialize
from .rows import get_by_ids
from .traverse import other_entity, roles

#: What bounds must have in common.
KEY = ["entity", "kind", "unit_key"]
#: Bounds of a key that meet in a task on either side; keys of more are split into so many ranges of values and into parts.
BLOCK, RANGES = 4096, 32


def plain_key(text: Column) -> Column:
    """normalize() of a unit or condition. One word of letters, digits and percent signs is its key in lower case, without the expressions that
    spaces and punctuation need."""
    text = F.coalesce(text, F.lit(""))
    low = F.lower(text)
    return F.when((low == "") | (low.rlike(r"^[\p{L}\p{N}%]+$") & ~low.contains("ё")), low).otherwise(normalize(text))


def bounds(graph: Graph) -> DataFrame:
    """A row for each side of a bound and entity in it: upper ones (edge is where they end) and lower ones (where they start). An exact value is
    both. Either side is made of its own restrictions, so that a read of one derives no others."""
    r = graph.restriction.where(comparable(F.col("value_operator"), F.col("value_number")))

    def side(upper: bool, operators: tuple[str, ...], edge: Column) -> DataFrame:
        some = r.where(F.col("value_operator").isin(*operators)).withColumns({"unit_key": plain_key(F.col("value_unit")), "condition_key": plain_key(F.col("value_condition"))})
        some = roles(some, "kind", "unit_key", "value_operator", "value_number", "value_unit", "condition_key", other_entity())
        return some.select("*", F.lit(upper).alias("upper"), edge.alias("edge"))

    operator, number = F.col("value_operator"), F.col("value_number")
    return side(True, ("<=", "<", "="), upper_bound(operator, number)).unionByName(side(False, (">=", ">", "="), lower_bound(operator, number)))


def split_hot(graph: Graph, sides: DataFrame, block: int, entities: DataFrame | None = None) -> tuple[DataFrame, DataFrame | None]:
    """sides of entities with up to block bounds, whose keys a task can hold, and of those with more, None if there are none. Bounds are
    counted by restrictions, before any id or key is made of them; entities: only these can have sides."""
    r = roles(graph.restriction.where(comparable(F.col("value_operator"), F.col("value_number"))), "value_operator")
    r = r if entities is None else r.join(entities, "entity", "left_semi")
    many = r.groupBy("entity").agg(F.sum(F.when(F.col("value_operator") == "=", 2).otherwise(1)).alias("n")).where(F.col("n") > block)
    hot, n = counted(many.select("entity"), "hot")
    return (sides, None) if n == 0 else (sides.join(hot, "entity", "left_anti"), sides.join(hot, "entity", "left_semi"))


def ranged(sides: DataFrame, key: list[str], block: int) -> DataFrame:
    """sides with the range of its edge (0 to RANGES - 1, in the order of values), the number of parts that a range's lower bounds fall into and
    of those that the upper ones of its key do, and whether it has both. Keys of up to block bounds have one range. Cuts are quantiles of the
    others, found by mergeable summaries."""
    heavy = sides.groupBy(*key).agg(F.count("*").alias("n"), F.count_if("upper").alias("n_upper")).where(F.col("n") > block)
    cuts = sides.join(heavy, key).groupBy(*key).agg(F.percentile_approx("edge", [k / RANGES for k in range(1, RANGES)]).alias("cuts"), F.first("n").alias("n"), F.first("n_upper").alias("n_upper"))
    split = lambda n, size: F.greatest(F.ceil(n / size).cast("int"), F.lit(1))
    lower, upper = F.col("n") - F.col("n_upper"), F.col("n_upper")
    cuts = cuts.select(*key, F.array_distinct("cuts").alias("cuts"), split(lower, RANGES * block).alias("parts"), split(upper, block).alias("meshes"), ((upper > 0) & (lower > 0)).alias("both"))
    cuts = materialize(cuts, "cuts")
    below = F.coalesce(F.size(F.filter("cuts", lambda c: c < F.col("edge"))), F.lit(0))
    split = sides.join(cuts, key, "left").withColumns({"range": below, "last": F.coalesce(F.size("cuts"), F.lit(0)), "parts": F.coalesce("parts", F.lit(1)), "meshes": F.coalesce("meshes", F.lit(1)), "both": F.coalesce("both", F.lit(True))})
    return split.drop("cuts")


def find_conflicts(graph: Graph, ids: DataFrame | None = None, block: int = BLOCK, few: int = FEW) -> DataFrame:
    """(lo, hi, reason, severity) of every conflicting pair, or of those with a restriction of ids.

    Two ranges are disjoint only if one ends below where the other starts, so restrictions with an upper bound meet those with a
    lower bound on entity, kind and unit; pairs of like bounds are never made. A pair with two common entities counts once. Of a key
    with many bounds an upper one meets only ranges of values that are not below its own, and both sides are dealt into parts, so that
    no task holds more than about block bounds of either; a side is repeated by the number of the other, and not at all where there is no other. Up to few ids, and entities of theirs, are broadcast.
    """
    sides, entities = bounds(graph), None
    chosen = None if ids is None else counted(ids.select("id").distinct(), "ids", few)[0]
    if chosen is not None:
        mine = materialize(graph.restriction.join(chosen, "id", "left_semi"), "mine")
        entities, _ = counted(roles(mine).select("entity").distinct(), "entities", few)
        sides = sides.join(entities, "entity", "left_semi")
    light, hot = split_hot(graph, sides, block, entities)
    pairs = _met(light.where("upper"), light.where("not upper"), KEY, chosen)
    if hot is not None:
        hot = ranged(hot, KEY, block).where("both")
        every = lambda low, high: F.explode(F.sequence(low, high))
        part = F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")
        mesh = F.pmod(F.xxhash64("id", F.lit(1)), F.col("meshes")).cast("int")
        uppers = hot.where("upper").withColumns({"s": mesh, "range": every(F.col("range"), F.col("last"))}).withColumn("t", every(F.lit(0), F.col("parts") - 1))
        lowers = hot.where("not upper").withColumn("t", part).withColumn("s", every(F.lit(0), F.col("meshes") - 1))
        pairs = pairs.unionByName(_met(uppers, lowers, [*KEY, "range", "s", "t"], chosen))
    return pairs.select(
        "lo", "hi",
        F.concat(F.col("kind"), F.lit(": "), F.when(F.col("upper") == F.col("lo"), F.col("upper_text")).otherwise(F.col("lower_text")), F.lit(" vs "), F.when(F.col("upper") == F.col("lo"), F.col("lower_text")).otherwise(F.col("upper_text"))).alias("reason"),
        F.when(F.col("same"), "certain").otherwise("possible").alias("severity"),
    )


def _met(uppers: DataFrame, lowers: DataFrame, on: list[str], chosen: DataFrame | None) -> DataFrame:
    """Pairs of upper and lower bounds, all or those with a restriction of chosen (id), each once: one with two common entities is made at
    the smaller one, so that pairs need not be compared with each other."""
    if chosen is not None:
        first = _met(uppers.join(chosen, "id", "left_semi"), lowers, on, None)
        return first.unionByName(_met(uppers.join(chosen, "id", "left_anti"), lowers.join(chosen, "id", "left_semi"), on, None))
    u, v = uppers.alias("u"), lowers.alias("v")
    same = reduce(lambda x, y: x & y, (F.col(f"u.{c}") == F.col(f"v.{c}") for c in on))
    again = F.coalesce((F.col("u.other") == F.col("v.other")) & (F.col("u.other") < F.col("u.entity")), F.lit(False))
    return _pairs(u.join(v, same & (F.col("u.edge") < F.col("v.edge")) & ~again))


def _light_counts(sides: DataFrame) -> DataFrame:
    """(id, n) of keys that a task holds: bounds are shuffled once, by key, and running sums in the order of edges give how many lie wholly
    on the other side, and how many of these share the second entity too, which counts at the smaller one only."""
    # Of equal edges lower bounds come first: they meet neither the upper ones beside them nor are met by them.
    def beyond(key: list[str]):
        w = W.partitionBy(*key).orderBy("edge", "upper")
        lowers = F.sum((~F.col("upper")).cast("long")).over(W.partitionBy(*key)) - F.sum((~F.col("upper")).cast("long")).over(w)
        return F.when(F.col("upper"), lowers).otherwise(F.sum(F.col("upper").cast("long")).over(w))

    rows = sides.where("kind is not null").select("id", *KEY, "upper", "edge", F.when(F.col("entity") < F.col("other"), F.col("other")).alias("second"))
    rows = rows.withColumn("n", beyond(KEY)).withColumn("n", F.col("n") - F.when(F.col("second").isNull(), F.lit(0)).otherwise(beyond([*KEY, "second"])))
    return rows.where("n > 0").select("id", "n")


def _met_counts(sides: DataFrame, key: list[str], block: int) -> DataFrame:
    """(id, n): for each bound how many of its key lie wholly on its other side, without a pair: running sums over distinct values within a
    range, and sums of the ranges before it."""
    rows = ranged(sides, key, block)
    place = [*key, "range"]
    values = rows.groupBy(*place, "edge").agg(F.count_if("upper").alias("u"), F.count_if(~F.col("upper")).alias("l"))
    values = materialize(values, "edges")
    whole = values.groupBy(*place).agg(F.sum("u").alias("u_all"), F.sum("l").alias("l_all"))
    before = W.partitionBy(*key).orderBy("range").rowsBetween(W.unboundedPreceding, -1)
    whole = whole.select(*place, F.coalesce(F.sum("u_all").over(before), F.lit(0)).alias("u_before"), F.coalesce(F.sum("l_all").over(before), F.lit(0)).alias("l_before"), F.sum("l_all").over(W.partitionBy(*key)).alias("l_key"))
    within = W.partitionBy(*place).orderBy("edge")
    at = values.join(whole, place).select(
        *place, "edge", (F.col("l_key") - F.col("l_before") - F.sum("l").over(within.rowsBetween(W.unboundedPreceding, 0))).alias("lowers_above"),
        (F.col("u_before") + F.coalesce(F.sum("u").over(within.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).alias("uppers_below"),
    )
    return rows.join(at, [*place, "edge"]).select("id", F.when(F.col("upper"), F.col("lowers_above")).otherwise(F.col("uppers_below")).alias("n"))


def conflict_counts(graph: Graph, block: int = BLOCK) -> DataFrame:
    """(id, conflicts): how many restrictions each conflicts with, for those with any. Pairs are counted at each common entity, and those with
    two of them once less."""
    light, hot = split_hot(graph, bounds(graph), block)
    counts = _light_counts(light)
    if hot is not None:
        both = hot.where("entity < other").withColumnRenamed("other", "second")
        twice = _met_counts(both, [*KEY, "second"], block).withColumn("n", -F.col("n"))
        counts = counts.unionByName(_met_counts(hot, KEY, block)).unionByName(twice)
    return counts.groupBy("id").agg(F.sum("n").alias("conflicts")).where("conflicts > 0")


def _pairs(joined_sides: DataFrame) -> DataFrame:
    amount = lambda s: amount_text(F.col(f"{s}.value_operator"), F.col(f"{s}.value_number"), F.col(f"{s}.value_unit"))
    return joined_sides.where("u.id <> v.id").select(
        F.least("u.id", "v.id").alias("lo"), F.greatest("u.id", "v.id").alias("hi"), F.col("u.id").alias("upper"), F.col("u.kind").alias("kind"),
        amount("u").alias("upper_text"), amount("v").alias("lower_text"), (F.col("u.condition_key") == F.col("v.condition_key")).alias("same"),
    )


def in_scope(graph: Graph, user_id: str, scenario_id: str) -> DataFrame:
    """(id) of the restrictions on clauses of a user's scenario."""
    docs = graph.document.where((F.col("user_id") == user_id) & (F.col("scenario_id") == scenario_id)).select("doc_id")
    clauses = graph.clause.join(docs, "doc_id", "left_semi").select(F.col("node_id").alias("clause_node_id"), F.col("doc_id").alias("_doc"))
    same = F.col("r.clause_node_id") == F.col("c.clause_node_id")
    if graph.by_document:
        same = same & (F.col("r.doc_id") == F.col("_doc"))
    return graph.restriction.alias("r").join(clauses.alias("c"), same, "left_semi").select("id")


def conflict_pairs(graph: Graph, user_id: str | None = None, scenario_id: str | None = None, restriction: str | None = None, limit: int | None = None) -> DataFrame:
    """Stored conflict edges, by (lo, hi): those of a restriction, those with a side in a user's scenario. A user without a scenario is no scope."""
    pairs = graph.conflict
    if restriction is not None:
        pairs = pairs.where((F.col("lo") == restriction) | (F.col("hi") == restriction))
    if user_id is not None and scenario_id is not None:
        inside = in_scope(graph, user_id, scenario_id).withColumn("inside", F.lit(True))
        for side in ("lo", "hi"):
            pairs = pairs.join(inside.withColumnsRenamed({"id": side, "inside": f"_{side}"}), side, "left")
        pairs = pairs.where("_lo or _hi").drop("_lo", "_hi")
    pairs = pairs.select("lo", "hi", "reason", "severity")
    return pairs if limit is None else pairs.orderBy("lo", "hi").limit(limit)


def hydrate(graph: Graph, pairs: DataFrame) -> DataFrame:
    """Pairs with both sides' rows as structs; a pair of which a side has no full row is left out."""
    pairs, _ = counted(pairs, "pairs")
    rows = get_by_ids(graph, pairs.select(F.col("lo").alias("id")).union(pairs.select("hi")))
    side = lambda name: rows.select(F.col("id").alias(name), F.struct("*").alias(f"{name}_row"))
    return pairs.join(side("lo"), "lo").join(side("hi"), "hi")
