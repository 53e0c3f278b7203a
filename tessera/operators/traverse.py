"""Neighbours of restrictions and bounded walks over them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import clamp_depth
from ..schema import Graph
from ..sources.store import counted, materialize
from .rows import get_by_ids


def roles(restriction: DataFrame, *more: str | Column) -> DataFrame:
    """(id, entity, ...) of both roles of each restriction; one row if they are the same entity."""
    both = F.array_distinct(F.array("subject_normalized", "object_normalized"))
    return restriction.withColumn("entity", F.explode(both)).select("id", "entity", *more).where("entity is not null")


def other_entity() -> Column:
    """The other entity of a role's row (entity), null if both roles have the same one."""
    subject, obj = F.col("subject_normalized"), F.col("object_normalized")
    return F.when(subject != obj, F.when(F.col("entity") == subject, obj).otherwise(subject)).alias("other")


#: Restrictions of one entity that a task pairs with each other; entities of more are split.
BLOCK = 4096


def shares_entity(graph: Graph, ids: DataFrame | None = None, block: int = BLOCK) -> DataFrame:
    """(src, neighbor_id): restrictions with a common entity in any role, from ids or, without them, each pair once (src first).

    The pairs are what is asked for, so an entity of many restrictions has many; its restrictions are dealt into blocks, and each block
    of sources meets all others in tasks of its own. A pair with two common entities is made at the smaller one only.
    """
    r = roles(graph.restriction, other_entity())
    left = r
    if ids is not None:
        left, _ = counted(r.join(counted(ids.select("id").distinct(), "ids")[0], "id", "left_semi"), "sources")
        r = r.join(counted(left.select("entity").distinct(), "entities")[0], "entity", "left_semi")
    hot, n = counted(r.groupBy("entity").count().where(F.col("count") > block).select("entity", F.ceil(F.col("count") / block).cast("int").alias("n")), "hot")

    def pairs(left: DataFrame, r: DataFrame, *on: str) -> DataFrame:
        a, b = left.alias("a"), r.alias("b")
        same = reduce(lambda x, y: x & y, (F.col(f"a.{c}") == F.col(f"b.{c}") for c in ("entity", *on)))
        once = F.col("a.id") < F.col("b.id") if ids is None else F.col("a.id") != F.col("b.id")
        again = F.coalesce((F.col("a.other") == F.col("b.other")) & (F.col("b.other") < F.col("a.entity")), F.lit(False))
        return a.join(b, same & once & ~again).select(F.col("a.id").alias("src"), F.col("b.id").alias("neighbor_id"))

    if n == 0:
        return pairs(left, r)
    light = lambda df: df.join(hot.select("entity"), "entity", "left_anti")
    sources = left.join(hot, "entity").withColumn("part", F.pmod(F.xxhash64("id"), F.col("n")).cast("int"))
    meets = r.join(hot, "entity").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    return pairs(light(left), light(r)).unionByName(pairs(sources, meets, "part"))


def reference_linked(graph: Graph, ids: DataFrame | None = None) -> DataFrame:
    """(src, neighbor_id): restrictions whose clauses refer to each other, in either direction."""
    e = graph.references.where("target_type = 'clause'").select(F.col("src").alias("c"), F.col("target_key").alias("t"))
    e = e.unionByName(e.select(F.col("t").alias("c"), F.col("c").alias("t"))).distinct()
    r = graph.restriction.select("id", "clause_node_id")
    left = r
    if ids is not None:
        left, _ = counted(r.join(counted(ids.select("id").distinct(), "ids")[0], "id", "left_semi"), "sources")
        e, _ = counted(e.join(left.select(F.col("clause_node_id").alias("c")), "c", "left_semi"), "links")
        r = r.join(counted(e.select(F.col("t").alias("clause_node_id")).distinct(), "linked")[0], "clause_node_id", "left_semi")
    pairs = left.select(F.col("id").alias("src"), F.col("clause_node_id").alias("c")).join(e, "c").join(r.select(F.col("id").alias("neighbor_id"), F.col("clause_node_id").alias("t")), "t")
    return pairs.where("src <> neighbor_id").select("src", "neighbor_id").distinct()


def neighbors(graph: Graph, ids: DataFrame) -> DataFrame:
    """(src, neighbor_id, relation) one hop from ids; a pair linked both ways has two rows."""
    shared = shares_entity(graph, ids).withColumn("relation", F.lit("shares_entity"))
    return shared.unionByName(reference_linked(graph, ids).withColumn("relation", F.lit("reference")))


def published(graph: Graph) -> Graph:
    """The graph with what a walk reads of it, the restrictions' ids, entities and clauses, written once; hops read that."""
    slim = graph.restriction.select("id", "subject_normalized", "object_normalized", "clause_node_id")
    links = graph.references.where("target_type = 'clause'").select("src", "target_type", "target_key")
    return graph.with_(restriction=materialize(slim, "walk"), references=materialize(links, "links"))


def step(graph: Graph, frontier: DataFrame) -> DataFrame:
    """(id, relation) of what one hop from restrictions (id) reaches, they themselves too: over their distinct entities and over their
    clauses' distinct links, so that no pair of restrictions is made. relation is shares_entity where both hold."""
    r = roles(graph.restriction)
    mine, _ = counted(graph.restriction.join(counted(frontier.select("id").distinct(), "frontier")[0], "id", "left_semi").select("id", "subject_normalized", "object_normalized", "clause_node_id"), "mine")
    entities, _ = counted(roles(mine).select("entity").distinct(), "entities")
    shared = r.join(entities, "entity", "left_semi").select("id").distinct().withColumn("relation", F.lit("shares_entity"))
    clauses, _ = counted(mine.select(F.col("clause_node_id").alias("c")).distinct(), "clauses")
    e = graph.references.where("target_type = 'clause'").select(F.col("src").alias("c"), F.col("target_key").alias("t"))
    linked = e.unionByName(e.select(F.col("t").alias("c"), F.col("c").alias("t"))).join(clauses, "c", "left_semi").select(F.col("t").alias("clause_node_id")).distinct()
    linked, _ = counted(linked, "linked")
    referred = graph.restriction.join(linked, "clause_node_id", "left_semi").select("id", F.lit("reference").alias("relation"))
    return shared.unionByName(referred).groupBy("id").agg(F.max("relation").alias("relation"))


def walk(graph: Graph, seeds: DataFrame, depth: int) -> DataFrame:
    """(id, hop, relation) of a breadth-first walk from seeds, which have hop 0 and no relation; depth is held between 1 and the cap, so
    the loop has three turns at most, each a few semi joins."""
    reached = materialize(seeds.select("id").distinct().select("id", F.lit(0).alias("hop"), F.lit(None).cast("string").alias("relation")), "reached")
    for hop in range(1, clamp_depth(depth) + 1):
        found = step(graph, reached.where(F.col("hop") == hop - 1))
        fresh = found.join(reached, "id", "left_anti").select("id", F.lit(hop).alias("hop"), "relation")
        reached = materialize(reached.unionByName(fresh), "reached")
    return reached


def graph_around(graph: Graph, root: str, depth: int = 1, slim: Graph | None = None) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) around a restriction: full rows of what is reached, and undirected edges (a, b, relation), each once, of all that
    lies less deep than depth. Pairs are made for the edges alone. slim is the published() graph where there is one already."""
    slim = slim or published(graph)
    reached = walk(slim, slim.restriction.where(F.col("id") == root).select("id"), depth)
    nodes = get_by_ids(graph, reached)
    edges = neighbors(slim, reached.where(F.col("hop") < clamp_depth(depth)))
    return nodes, edges.select(F.least("src", "neighbor_id").alias("a"), F.greatest("src", "neighbor_id").alias("b"), "relation").distinct()


def expand(graph: Graph, ids: DataFrame, depth: int = 1, slim: Graph | None = None) -> DataFrame:
    """(id, relation, hop) of what a walk from ids reaches besides them: the relation of the shallowest hop, shares_entity first."""
    return walk(slim or published(graph), ids, depth).where("hop > 0").select("id", "relation", "hop")


def get_detail(graph: Graph, restriction: str) -> DataFrame:
    """A restriction's row and its direct neighbours' ids with their relation, shares_entity where both hold."""
    spark = graph.restriction.sparkSession
    ids = spark.createDataFrame([(restriction,)], "id string")
    near = neighbors(graph, ids).groupBy("src", "neighbor_id").agg(F.max("relation").alias("relation"))
    near = near.groupBy("src").agg(F.array_sort(F.collect_list(F.struct("neighbor_id", "relation"))).alias("neighbors"))
    return get_by_ids(graph, [restriction]).join(near, F.col("id") == F.col("src"), "left").drop("src")
