"""The restriction row: five joins, the filters and the projection that every read shares."""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import normalize
from ..schema import Graph
from ..sources.store import FEW, counted


@dataclass(frozen=True)
class Filters:
    """Conditions on a restriction; an absent one adds no predicate. subject and object are labels, read as keys or aliases as the vocabulary
    writes them; an empty one is absent."""

    kind: str | None = None
    doc_id: str | None = None
    document_names: list[str] | None = None
    doc_type: str | None = None
    corpus: str | None = None
    lang: str | None = None
    version: str | None = None
    tags: list[str] | None = None
    subject: str | None = None
    object: str | None = None


def joined(graph: Graph) -> DataFrame:
    """Restrictions with clause, document, both entities and kind. A restriction that lacks one of them is no row. Clauses meet their
    documents first, so that what a filter leaves of these is all that restrictions are joined with."""
    r = graph.restriction.drop("version_id").withColumnsRenamed({"doc_id": "_r_doc", "char_start": "own_start", "char_end": "own_end"})
    c = graph.clause.select(F.col("node_id").alias("clause_node_id"), "numbering", "breadcrumb", "tags", "char_start", "char_end", F.col("doc_id").alias("_doc"), F.col("version").alias("_c_version"), F.col("version_id").alias("_c_version_id"))
    d = graph.document.select(F.col("doc_id").alias("_doc"), F.col("doc_id"), "name", "version", "version_id", "doc_type", "corpus", "lang", "user_id", "scenario_id")
    k = graph.kind.select(F.col("name").alias("_kind"))
    placed, same = c.join(d, "_doc").withColumnRenamed("clause_node_id", "_node"), F.col("clause_node_id") == F.col("_node")
    if graph.by_document:
        same = same & (F.col("_r_doc") == F.col("_doc"))
    return with_entities(r, graph).join(placed, same).drop("_node").join(k, F.col("kind") == F.col("_kind"))


def with_entities(r: DataFrame, graph: Graph, few: int = FEW) -> DataFrame:
    """Restrictions of which both entities exist. Nearly all do, so keys are looked up instead of rows: the distinct ones that have no
    entity are broadcast. Only if those are many, or keys of the vocabulary repeat, both entities are joined to the rows."""
    roles = ("subject_normalized", "object_normalized")
    have = graph.entity.groupBy(F.col("normalized").alias("_key")).agg(F.count("*").alias("n"))
    asked = r.select(F.explode(F.array(*roles)).alias("_key")).distinct()
    odd = asked.join(have, "_key", "left").where("n is null or n > 1").select("_key", F.coalesce("n", F.lit(0)).alias("n"))
    odd, n = counted(odd, "odd", few)
    if n == 0:
        return r
    if n > few or not odd.where("n > 1").isEmpty():
        for c in roles:
            r = r.join(graph.entity.select(F.col("normalized").alias("_key")), F.col(c) == F.col("_key")).drop("_key")
        return r
    r = r.where(" and ".join(f"{c} is not null" for c in roles))
    for c in roles:
        r = r.join(odd, F.col(c) == F.col("_key"), "left_anti")
    return r


def meant(graph: Graph, f: Filters) -> Graph:
    """The graph with the restrictions alone whose subject and object the labels of a filter mean."""
    for c, value in (("subject_normalized", f.subject), ("object_normalized", f.object)):
        if value is not None and value != "":
            known = normalize(F.lit(value))
            hit = (F.col("normalized") == known) | F.array_contains(F.coalesce("aliases", F.array().cast("array<string>")), known)
            keys, _ = counted(graph.entity.where(hit).select(F.col("normalized").alias(c)).distinct(), "meant")
            graph = graph.with_(restriction=graph.restriction.join(keys, c, "left_semi"), by_document=graph.by_document)
    return graph


def narrowed(graph: Graph, restriction: DataFrame) -> Graph:
    """The graph around some of its restrictions, which are written once. If they are few, what they need of each table is found by a
    broadcast of their keys, and no table is shuffled."""
    some, n = counted(restriction, "some")
    if n > FEW:
        return graph.with_(restriction=some)
    keys = lambda *columns: F.broadcast(reduce(DataFrame.union, (some.select(F.col(c).alias("_key")) for c in columns)).distinct())
    of = lambda df, column, key: df.join(key, F.col(column) == F.col("_key"), "left_semi")
    clause, _ = counted(of(graph.clause, "node_id", keys("clause_node_id")), "clauses")
    document = of(graph.document, "doc_id", F.broadcast(clause.select(F.col("doc_id").alias("_key")).distinct()))
    entity = of(graph.entity, "normalized", keys("subject_normalized", "object_normalized"))
    return graph.with_(restriction=some, clause=clause, document=document, entity=entity, check_plan=of(graph.check_plan, "restriction_id", keys("id")))


def found(graph: Graph, f: Filters) -> DataFrame:
    """Joined rows under all given filters."""
    return matching(joined(meant(graph, f)), replace(f, subject=None, object=None))


def matching(rows: DataFrame, f: Filters) -> DataFrame:
    """rows under all given filters; for labels they hold the entities' aliases."""
    none = F.array().cast("array<string>")

    def label(key: str, aliases: str, value: str) -> Column:
        known = normalize(F.lit(value))
        return (F.col(key) == known) | F.array_contains(F.coalesce(F.col(aliases), none), known)

    tests = {
        "kind": lambda v: F.col("_kind") == v,
        "doc_id": lambda v: F.col("doc_id") == v,
        "document_names": lambda v: F.col("name").isin(list(v)),
        "doc_type": lambda v: F.col("doc_type") == v,
        "corpus": lambda v: F.col("corpus") == v,
        "lang": lambda v: F.col("lang") == v,
        "version": lambda v: (F.col("_c_version") == v) | (F.col("_c_version_id") == v),
        "tags": lambda v: F.arrays_overlap(F.coalesce("tags", none), F.array(*map(F.lit, v)).cast("array<string>")),
        "subject": lambda v: label("subject_normalized", "_s_aliases", v),
        "object": lambda v: label("object_normalized", "_o_aliases", v),
    }
    for name, test in tests.items():
        value = getattr(f, name)
        if value is not None and not (name in ("subject", "object") and value == ""):
            rows = rows.where(test(value))
    return rows


PLAN_COLUMNS = {
    "schema_version": "check_schema_version", "template": "check_template", "template_version": "check_template_version", "params_json": "check_params_json",
    "requirements_json": "check_requirements_json", "source_json": "check_source_json", "planner_status": "check_planner_status",
    "review_status": "check_review_status", "revision": "check_revision",
}
ROW = [
    "id", "subject", "object", "kind", "kind_status", "extraction_text", "value_operator", "value_number", "value_unit", "value_condition",
    "score", "subject_normalized", "object_normalized", "clause_node_id", "numbering", "breadcrumb", "tags", "char_start", "char_end",
    "doc_id", "name", "version", "version_id", "doc_type", "corpus", "lang", *PLAN_COLUMNS.values(),
]


def project(rows: DataFrame, graph: Graph, score: Column | None = None) -> DataFrame:
    """The 35 columns of a restriction row. The current plan joins last, so that it never removes a row."""
    of, same = [F.col("restriction_id").alias("_plan")], F.col("id") == F.col("_plan")
    if graph.by_document:
        of, same = [*of, F.col("doc_id").alias("_plan_doc")], same & (F.col("_r_doc") == F.col("_plan_doc"))
    plans = graph.check_plan.where("current").select(*of, *(F.col(a).alias(b) for a, b in PLAN_COLUMNS.items()))
    scored = rows.withColumn("score", F.lit(None).cast("double") if score is None else score)
    return scored.join(plans, same, "left").select(*ROW)


READING_ORDER = (F.asc_nulls_last, ("name", "numbering", "id"))


def in_reading_order(rows: DataFrame) -> DataFrame:
    by, columns = READING_ORDER
    return rows.orderBy(*(by(c) for c in columns))


def search_filter(graph: Graph, filters: Filters = Filters(), limit: int | None = None) -> DataFrame:
    """Restrictions under the filters, by document name, numbering and id."""
    rows = project(found(graph, filters), graph)
    return rows if limit is None else in_reading_order(rows).limit(limit)


def get_by_ids(graph: Graph, ids: list[str] | DataFrame) -> DataFrame:
    """Rows of the given ids, a list or a DataFrame (id)."""
    if isinstance(ids, DataFrame):
        some = graph.restriction.join(counted(ids.select("id").distinct(), "ids")[0], "id", "left_semi")
    else:
        some = graph.restriction.where(F.col("id").isin(ids))
    graph = narrowed(graph, some)
    return project(joined(graph), graph)


def nested(rows: DataFrame) -> DataFrame:
    """Rows as callers see them: defaults for absent texts, value, provenance and check plan as structs (null when empty)."""
    text = lambda c, default: F.when(F.coalesce(F.col(c), F.lit("")) == "", F.lit(default)).otherwise(F.col(c)).alias(c)
    value = [F.col(f"value_{c}").alias(c) for c in ("operator", "number", "unit", "condition")]
    has_value = F.coalesce(*(F.col(f"value_{c}").cast("string") for c in ("operator", "number", "unit", "condition"))).isNotNull()
    place = F.struct("doc_id", "name", "version", "version_id", "doc_type", "corpus", "lang", "clause_node_id", "numbering", "breadcrumb", F.coalesce("tags", F.array().cast("array<string>")).alias("tags"), "char_start", "char_end")
    plan = F.struct(*(F.col(b).alias(a) for a, b in PLAN_COLUMNS.items()))
    return rows.select(
        "id", text("subject", ""), text("object", ""), text("kind", ""), text("kind_status", "approved"), text("extraction_text", ""), "score", "subject_normalized", "object_normalized",
        F.when(has_value, F.struct(*value)).alias("value"), place.alias("provenance"), F.when(F.col("check_template").isNotNull(), plan).alias("check_plan"),
    )
