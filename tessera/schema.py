"""Tables of the graph. Edges with one target per source are columns; the others are tables."""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


DOCUMENT = "doc_id string, name string, title string, version string, version_id string, doc_type string, corpus string, lang string, status string, content_hash string, source_uri string, uploaded_at string, node_count int, user_id string, scenario_id string"
CLAUSE = "node_id string, doc_id string, name string, version string, version_id string, kind string, type string, numbering string, breadcrumb string, depth int, order int, char_start int, char_end int, span_id string, tags array<string>, text string"
RESTRICTION = "id string, subject string, object string, kind string, kind_status string, clause_node_id string, doc_id string, version_id string, extraction_text string, char_start int, char_end int, value_operator string, value_number double, value_unit string, value_condition string, subject_normalized string, object_normalized string, embedding array<float>"
ENTITY = "normalized string, name string, aliases array<string>, status string, embedding array<float>"
KIND = "name string, status string, aliases array<string>, embedding array<float>"
PART_OF = "child string, parent string"
REFERENCES = "src string, target_type string, target_key string, scope string, resolved boolean, raw string, target_numbering string"
PENDING = "key string, target_name string, target_numbering string"
CHECK_PLAN = "restriction_id string, revision int, current boolean, schema_version string, template string, template_version int, params_json string, requirements_json string, source_json string, planner_status string, review_status string, author string, reason string, created_at timestamp"
CONFLICT = "lo string, hi string, reason string, severity string, detected_at timestamp"

#: Columns that name a row of each table.
KEYS = {
    "document": ["doc_id"], "clause": ["node_id"], "restriction": ["id"], "entity": ["normalized"], "kind": ["name"], "part_of": ["child", "parent"],
    "references": ["src", "target_type", "target_key"], "pending": ["key"], "check_plan": ["restriction_id", "revision"], "conflict": ["lo", "hi"],
}
SCHEMAS = {
    "document": DOCUMENT, "clause": CLAUSE, "restriction": RESTRICTION, "entity": ENTITY, "kind": KIND, "part_of": PART_OF,
    "references": REFERENCES, "pending": PENDING, "check_plan": CHECK_PLAN, "conflict": CONFLICT,
}


@dataclass(frozen=True)
class Graph:
    document: DataFrame
    clause: DataFrame
    restriction: DataFrame
    entity: DataFrame
    kind: DataFrame
    part_of: DataFrame
    references: DataFrame
    pending: DataFrame
    check_plan: DataFrame
    conflict: DataFrame
    #: A restriction's doc_id is that of its clause and, as one more column, of its plans: reads then meet on it too, so that tables which lie
    #: by document are not shuffled again. Only who makes the tables can promise that; other tables take the promise back.
    by_document: bool = False

    def with_(self, by_document: bool = False, **tables: DataFrame) -> Graph:
        return replace(self, by_document=by_document, **tables)

    def tables(self) -> dict[str, DataFrame]:
        return {name: getattr(self, name) for name in SCHEMAS}


def empty_graph(spark) -> Graph:
    return Graph(**{name: spark.createDataFrame([], text) for name, text in SCHEMAS.items()})


@cache
def table_type(table: str) -> StructType:
    return StructType.fromDDL(SCHEMAS[table])


def conform(df: DataFrame, table: str, *also: str) -> DataFrame:
    """df with exactly a table's columns and types, and also's columns; absent ones are null, others go."""
    have = set(df.columns)
    return df.select(*also, *((F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in table_type(table)))


def problems(graph: Graph, dimension: int | None = None) -> DataFrame:
    """(table, problem, n): null or repeated keys, and vectors whose length is not the one configured. Empty when all is well."""
    parts = []
    for name, df in graph.tables().items():
        keys = KEYS[name]
        absent = df.where(" or ".join(f"`{k}` is null" for k in keys)).groupBy().count()
        twice = df.groupBy(*keys).count().where("count > 1").groupBy().count()
        parts += [absent.select(F.lit(name).alias("table"), F.lit("null key").alias("problem"), "count"), twice.select(F.lit(name).alias("table"), F.lit("repeated key").alias("problem"), "count")]
        if dimension and "embedding" in df.columns:
            odd = df.where(F.col("embedding").isNotNull() & (F.size("embedding") != dimension)).groupBy().count()
            parts.append(odd.select(F.lit(name).alias("table"), F.lit("vector length").alias("problem"), "count"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.where("count > 0").withColumnRenamed("count", "n")
