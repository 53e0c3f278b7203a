"""Facets of the vocabulary and coverage counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import Graph
from .traverse import roles


def entity_facet(graph: Graph, query: str | None = None, limit: int | None = None, legacy_count: bool = False) -> DataFrame:
    """Entities with how many restrictions use them, most used first. legacy_count counts rows of an optional match: 1 for an unused
    entity, 2 for a restriction that uses one in both roles."""
    e = graph.entity if query is None else graph.entity.where(F.lower("normalized").contains(query.lower()))
    if legacy_count:
        uses = graph.restriction.select(F.explode(F.array("subject_normalized", "object_normalized")).alias("normalized"))
    else:
        uses = roles(graph.restriction).select(F.col("entity").alias("normalized"))
    counts = uses.groupBy("normalized").agg(F.count("*").alias("n"))
    out = e.join(counts, "normalized", "left").select("normalized", "name", "status", "aliases", F.coalesce("n", F.lit(1 if legacy_count else 0)).cast("long").alias("restriction_count"))
    return out if limit is None else out.orderBy(F.desc("restriction_count"), "normalized").limit(limit)


def kind_facet(graph: Graph, legacy_count: bool = False) -> DataFrame:
    """Kinds with how many restrictions have them, most used first."""
    counts = graph.restriction.groupBy(F.col("kind").alias("name")).agg(F.count("*").alias("n"))
    out = graph.kind.join(counts, "name", "left").select("name", "status", "aliases", F.coalesce("n", F.lit(1 if legacy_count else 0)).cast("long").alias("restriction_count"))
    return out.orderBy(F.desc("restriction_count"), "name")


def stats(graph: Graph) -> DataFrame:
    """One row of counts: documents, clauses, references, pending references and restrictions."""
    tables = {"documents": graph.document, "clauses": graph.clause, "references": graph.references, "pending_references": graph.pending, "restrictions": graph.restriction}
    counted = [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n") for name, df in tables.items()]
    rows = counted[0]
    for c in counted[1:]:
        rows = rows.unionByName(c)
    return rows.agg(*(F.max(F.when(F.col("name") == name, F.col("n"))).alias(name) for name in tables))
