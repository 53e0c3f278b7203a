"""Vector search, exact lookups of vocabulary nodes, applicable restrictions and the fallback search over clauses."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import checked_limit, normalize
from ..functions.vectors import cosine, nearest, to_query, unit_interval
from ..schema import Graph
from ..sources.store import counted
from .rows import Filters, found, in_reading_order, meant, narrowed, project

#: What a fuzzy match of an entity or a kind must reach.
ENTITY_THRESHOLD, KIND_THRESHOLD = 0.90, 0.88


def fetch_size(limit: int, oversample: int = 5) -> int:
    """Vectors taken before the filters: some of them fall away."""
    return max(checked_limit(limit) * oversample, 50)


def top_vectors(nodes: DataFrame, vector: list[float], k: int, key: str, score_mode: str = "raw") -> DataFrame:
    """The k nodes nearest to a vector, with their score; ties to the smaller key."""
    score = cosine(F.col("embedding"), to_query(vector))
    scored = nodes.withColumn("score", unit_interval(score) if score_mode == "unit" else score).where("score is not null")
    return scored.orderBy(F.desc("score"), key).limit(k)


def top_shared(nodes: DataFrame, vector: list[float], k: int, key: str, column: str, vectors: DataFrame) -> DataFrame:
    """top_vectors() of nodes that name their vector in a table (column, embedding): each vector is scored once, and nodes get its score."""
    scores = vectors.select(column, cosine(F.col("embedding"), to_query(vector)).alias("score")).where("score is not null")
    scores, _ = counted(scores, "scores")
    return nodes.join(scores, column).drop(column).orderBy(F.desc("score"), key).limit(k)


def nearest_nodes(nodes: DataFrame, vector: list[float], key: str, k: int = 1) -> DataFrame:
    """Nearest vocabulary nodes: key, name, status and score."""
    found = top_vectors(nodes, vector, k, key)
    return found.select(*dict.fromkeys([key, "name", "status", "score"]))


def search_vector(graph: Graph, vector: list[float], filters: Filters = Filters(), limit: int = 10, prefilter: bool = False, shared: tuple[str, DataFrame] | None = None) -> DataFrame:
    """Restrictions nearest to a vector. By default the nearest are fetched first and filtered after, as an index does, so fewer than
    limit rows may come; with prefilter the nearest of those under the filters. shared: the column of restrictions that names their vector,
    and the table of vectors, for a search that fetches first."""
    checked_limit(limit)
    if prefilter:
        rows = found(graph, filters)
        rows = rows.withColumn("_score", cosine(F.col("embedding"), to_query(vector))).where("_score is not null")
    else:
        top = top_vectors(graph.restriction, vector, fetch_size(limit), "id") if shared is None else top_shared(graph.restriction, vector, fetch_size(limit), "id", *shared)
        top = top.withColumnRenamed("score", "_score")
        graph = narrowed(graph, top)
        rows = found(graph, filters)
    return project(rows.orderBy(F.desc("_score"), "id").limit(limit), graph, F.col("_score")).orderBy(F.desc("score"), "id")


def exact_nodes(nodes: DataFrame, key: str, label: str) -> DataFrame:
    """The vocabulary node whose key or alias the label is; the one whose key it is first, then by key."""
    hit = (F.col(key) == label) | F.array_contains(F.coalesce("aliases", F.array().cast("array<string>")), label)
    return nodes.where(hit).orderBy(F.desc(F.col(key) == label), key).limit(1)


def targets(graph: Graph, label: str, vector: list[float] | None = None, threshold: float = ENTITY_THRESHOLD, k: int = 5) -> DataFrame:
    """(normalized) of the entities a request means: the label's own key and near entities from the threshold up."""
    one = graph.entity.sparkSession.range(1).select(normalize(F.lit(label)).alias("normalized"))
    if vector is not None:
        near = top_vectors(graph.entity, vector, k, "normalized").where(F.col("score") >= threshold).select("normalized")
        one = one.unionByName(near)
    return one.where("normalized <> ''").distinct()


def applicable(graph: Graph, label: str, filters: Filters = Filters(), vector: list[float] | None = None, threshold: float = ENTITY_THRESHOLD, limit: int | None = 20, strict_object: bool = False) -> DataFrame:
    """Restrictions that apply to an object, by itself or by a near entity. strict_object also demands the label to be the object's
    key or alias, which removes what only a near entity brought."""
    wanted, _ = counted(targets(graph, label, vector, threshold).withColumnRenamed("normalized", "object_normalized"), "targets")
    graph = graph.with_(restriction=graph.restriction.join(wanted, "object_normalized", "left_semi"))
    if strict_object:
        key = graph.entity.sparkSession.range(1).select(normalize(F.lit(label)).alias("k")).first()["k"]
        graph = meant(graph, Filters(object=key))
    graph = narrowed(graph, graph.restriction)
    rows = found(graph, filters)
    rows = project(rows, graph)
    return rows if limit is None else in_reading_order(rows).limit(limit)


def search_clauses(graph: Graph, vector: list[float], vectors: DataFrame, limit: int = 10, doc_id: str | None = None, names: list[str] | None = None, version: str | None = None, tags: list[str] | None = None) -> DataFrame:
    """Clauses nearest to a vector, by a table (node_id, embedding): what a search service outside the graph would return."""
    c = graph.clause
    for value, test in ((doc_id, F.col("doc_id") == doc_id), (version, (F.col("version") == version) | (F.col("version_id") == version))):
        c = c if value is None else c.where(test)
    c = c if names is None else c.where(F.col("name").isin(names))
    c = c if tags is None else c.where(F.arrays_overlap(F.coalesce("tags", F.array().cast("array<string>")), F.array(*map(F.lit, tags)).cast("array<string>")))
    found = c.join(vectors, "node_id").withColumn("score", cosine(F.col("embedding"), to_query(vector))).where("score is not null")
    return found.orderBy(F.desc("score"), "node_id").limit(limit).select("node_id", "doc_id", "name", "text", "score")


def search(graph: Graph, vector: list[float] | None, filters: Filters = Filters(), limit: int = 10, fallback: Callable[[], DataFrame] | None = None, shared: tuple[str, DataFrame] | None = None) -> tuple[DataFrame, DataFrame | None]:
    """(hits, fallback hits): by vector or, without one, a filtered listing. The fallback, such as a text search over clauses, is called only
    when a vector search finds nothing."""
    hits = search_filter_or_vector(graph, vector, filters, limit, shared)
    return hits, (fallback() if vector is not None and fallback is not None and hits.isEmpty() else None)


def respond(rows: DataFrame, limit: int) -> DataFrame:
    """The answer to a request as one row: count, the number of rows after the limit, and items, the rows in their order (500 at most)."""
    few = rows.limit(checked_limit(limit))
    return few.agg(F.count("*").alias("count"), F.collect_list(F.struct("*")).alias("items"))


def search_filter_or_vector(graph: Graph, vector: list[float] | None, filters: Filters, limit: int, shared: tuple[str, DataFrame] | None = None) -> DataFrame:
    from .rows import search_filter

    return search_filter(graph, filters, limit) if vector is None else search_vector(graph, vector, filters, limit, shared=shared)


def nearest_labels(labels: DataFrame, nodes: DataFrame, key: str, k: int = 1, threshold: float | None = None) -> DataFrame:
    """(probe, match, score) of labels (probe, vector) against all vocabulary nodes."""
    return nearest(labels, nodes.select(F.col(key).alias("match"), F.col("embedding").alias("vector")), k, threshold)
