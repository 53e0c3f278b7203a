"""Changes to a graph: merges, links, pruning, deletion and reconciliation. Every function gives new tables; nothing is updated in place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import pending_key
from ..schema import KEYS, Graph, conform
from ..sources.documents import fragments, listing, references, resolve_doc_ids
from ..sources.store import few_keys, few_rows, materialize


def merge(old: DataFrame, new: DataFrame, table: str, old_wins: tuple[str, ...] = (), joined_lists: tuple[str, ...] = (), few: bool = False) -> DataFrame:
    """old with new's rows: by key, a null in new keeps what old has; old_wins columns are set on creation only, joined_lists grow. Of
    several new rows of one key the greatest counts, by its columns from left to right.

    few says that new is a batch beside a large table: it is written once, and if its rows are few by count it is broadcast to old's rows, which
    are not shuffled, and only new rows that found none are added. A larger batch, or without few, both meet in one full join, what a larger
    batch gives being written once, as several steps read it.
    """
    keys = KEYS[table]
    new, old = conform(new, table), conform(old, table)
    rest = [c for c in new.columns if c not in keys]
    new = new.groupBy(*keys).agg(F.max(F.struct(*rest)).alias("_n")) if rest else new.distinct().withColumn("_n", F.struct(F.lit(True)))
    batch = few
    if few:
        new = materialize(new, table)
        few = few_rows(new)
    o = old.select(*keys, F.struct(*rest).alias("_o") if rest else F.struct(F.lit(True)).alias("_o"))

    def pick(c: str) -> Column:
        if c in joined_lists:
            none = F.array().cast(dict(old.dtypes)[c])
            return F.array_union(F.coalesce(f"_o.{c}", none), F.coalesce(f"_n.{c}", none)).alias(c)
        first, second = ("_o", "_n") if c in old_wins else ("_n", "_o")
        return F.coalesce(f"{first}.{c}", f"{second}.{c}").alias(c)

    if few:
        found = o.join(F.broadcast(new.select(*keys)), keys, "left_semi").select(*keys)
        both = o.join(F.broadcast(new), keys, "left").unionByName(new.join(F.broadcast(found), keys, "left_anti"), allowMissingColumns=True)
    else:
        both = o.join(new, keys, "full_outer")
    both = both.select(*(c if c in keys else pick(c) for c in old.columns))
    return materialize(both, table) if batch and not few else both


def upsert_documents(graph: Graph, rows: DataFrame, few: bool = False) -> Graph:
    return graph.with_(document=merge(graph.document, rows, "document", few=few))


def upsert_clauses(graph: Graph, rows: DataFrame, few: bool = False) -> Graph:
    return graph.with_(clause=merge(graph.clause, rows, "clause", few=few))


def upsert_kinds(graph: Graph, rows: DataFrame, few: bool = False) -> Graph:
    return graph.with_(kind=merge(graph.kind, rows, "kind", ("status",), ("aliases",), few))


def upsert_entities(graph: Graph, rows: DataFrame, few: bool = False) -> Graph:
    return graph.with_(entity=merge(graph.entity, rows, "entity", ("name", "status"), ("aliases",), few))


def upsert_restrictions(graph: Graph, rows: DataFrame, few: bool = False) -> Graph:
    """Plans are kept by restriction id, so a restriction that comes back has its plans again."""
    return graph.with_(restriction=merge(graph.restriction, rows, "restriction", few=few))


def upsert_conflicts(graph: Graph, rows: DataFrame, few: bool = False) -> Graph:
    pair = rows.withColumns({"lo": F.least("lo", "hi"), "hi": F.greatest("lo", "hi")})
    return graph.with_(conflict=merge(graph.conflict, pair, "conflict", few=few))


def link_part_of(graph: Graph, edges: DataFrame) -> Graph:
    """Parent edges; a parent that is no clause yet is made one without properties."""
    stubs = edges.select(F.col("parent").alias("node_id")).distinct()
    return graph.with_(part_of=merge(graph.part_of, edges, "part_of"), clause=merge(graph.clause, stubs, "clause"))


def route_references(refs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edges, pending) of references (src, scope, raw, target_name, target_numbering, resolved, target_node_id, target_doc_id): to a
    clause if one is resolved, else to a document, else to a pending name and number."""
    to_clause = F.coalesce("resolved", F.lit(False)) & F.col("target_node_id").isNotNull()
    to_document = F.coalesce("resolved", F.lit(False)) & F.col("target_doc_id").isNotNull()
    key = pending_key(F.col("target_name"), F.col("target_numbering"))
    routed = refs.withColumn("target_type", F.when(to_clause, "clause").when(to_document, "document").otherwise("pending"))
    routed = routed.withColumn("target_key", F.when(to_clause, F.col("target_node_id")).when(to_document, F.col("target_doc_id")).otherwise(key))
    waiting = F.col("target_type") == "pending"
    edges = routed.select("src", "target_type", "target_key", "scope", (~waiting).alias("resolved"), "raw", F.when(~waiting, F.col("target_numbering")).alias("target_numbering"))
    pending = routed.where(waiting).groupBy(F.col("target_key").alias("key")).agg(F.max("target_name").alias("target_name"), F.max("target_numbering").alias("target_numbering"))
    return edges.dropDuplicates(["src", "target_type", "target_key"]), pending


def link_references(graph: Graph, refs: DataFrame) -> Graph:
    """Reference edges with their targets; clauses and documents that are not there yet are made without properties."""
    edges, pending = route_references(refs)
    stub = lambda kind, key: edges.where(F.col("target_type") == kind).select(F.col("target_key").alias(key)).distinct()
    return graph.with_(
        references=merge(graph.references, edges, "references"), pending=merge(graph.pending, pending, "pending"),
        clause=merge(graph.clause, stub("clause", "node_id"), "clause"), document=merge(graph.document, stub("document", "doc_id"), "document"),
    )


def clause_rows(details: DataFrame) -> DataFrame:
    f = "fragment"
    own = [F.col(f"{f}.{c}").alias(c) for c in ("kind", "type", "numbering", "breadcrumb", "depth", "order", "char_start", "char_end", "span_id", "tags", "text")]
    return fragments(details).select(F.col(f"{f}.id").alias("node_id"), "doc_id", "name", "version", "version_id", *own)


def stale_clauses(clause: DataFrame, docs: DataFrame, keep: DataFrame) -> DataFrame:
    """(node_id, doc_id) of clauses of documents (doc_id) that are not in keep (node_id), written once."""
    stale = clause.select("node_id", "doc_id").join(keep.select("node_id").distinct(), "node_id", "left_anti")
    return few_keys(stale.join(docs.select("doc_id").distinct(), "doc_id", "left_semi").select("node_id", "doc_id"), "stale")


def _replaced(details: DataFrame, replace: bool | DataFrame, few: bool) -> tuple[DataFrame, DataFrame]:
    """Documents (doc_id) that lose what they no longer say, and the clauses (node_id) that they say."""
    keep, anew = clause_rows(details).select("node_id"), details.select("doc_id")
    anew = anew if replace is True else anew.join(replace, "doc_id", "left_semi")
    return (few_keys(anew, "anew"), few_keys(keep, "keep")) if few else (anew, keep)


def clauses_after(graph: Graph, details: DataFrame, replace: bool | DataFrame) -> DataFrame:
    """The own clauses of a batch of documents as ingest() would leave them; nothing else of it is worked out."""
    own = upsert_clauses(graph, clause_rows(details), few=True).clause
    return own.join(stale_clauses(own, *_replaced(details, replace, True)).select("node_id"), "node_id", "left_anti")


def ingest(graph: Graph, details: DataFrame, replace: bool | DataFrame = False, backfill: DataFrame | None = None, few: bool = False) -> tuple[Graph, DataFrame]:
    """(graph, counts) with the structure of documents: themselves, clauses, parents and references; replace (for all of them, or for
    those of a table (doc_id)) also removes clauses that a document no longer has. backfill: references (src, ...) for clauses of library documents that name none themselves. Each table is
    merged once, with the targets that are not there yet as rows without properties; few as in merge().
    counts: doc_id, clauses, references, pending, pruned."""
    parts = fragments(details)
    own = references(details).select("src", "reference.*")
    if backfill is not None:
        bare = parts.where("user_id is null and (fragment.references is null or size(fragment.references) = 0) and trim(fragment.text) <> ''")
        found = backfill.join(bare.select(F.col("fragment.id").alias("src")), "src", "left_semi")
        own = own.unionByName(found, allowMissingColumns=True)
    edges, waiting = route_references(own)
    stub = lambda kind, key: conform(edges.where(F.col("target_type") == kind).select(F.col("target_key").alias(key)), kind)
    parents = parts.where("fragment.parent_id is not null").select(F.col("fragment.id").alias("child"), F.col("fragment.parent_id").alias("parent"))
    clauses = conform(clause_rows(details), "clause").unionByName(conform(parents.select(F.col("parent").alias("node_id")), "clause")).unionByName(stub("clause", "node_id"))
    graph = upsert_clauses(upsert_documents(graph, conform(details, "document").unionByName(stub("document", "doc_id")), few), clauses, few)
    graph = graph.with_(
        part_of=merge(graph.part_of, parents, "part_of", few=few), references=merge(graph.references, edges, "references", few=few), pending=merge(graph.pending, waiting, "pending", few=few)
    )
    pruned = None
    if replace is not False:
        graph = graph if few else graph.with_(clause=materialize(graph.clause, "clause"))  # what goes and what stays are both read from it
        graph, pruned = prune(graph, *_replaced(details, replace, few))
    here = parts.select("doc_id", F.col("fragment.id").alias("src"))
    resolved = F.coalesce("resolved", F.lit(False)) & F.coalesce("target_node_id", "target_doc_id").isNotNull()
    linked = own.withColumn("ok", resolved).join(here, "src").groupBy("doc_id").agg(F.count_if("ok").alias("references"), F.count_if(~F.col("ok")).alias("pending"))
    counts = details.select("doc_id").distinct().join(here.groupBy("doc_id").agg(F.count("*").alias("clauses")), "doc_id", "left").join(linked, "doc_id", "left")
    counts = counts.withColumn("pruned", F.lit(0).cast("long")) if pruned is None else counts.join(pruned, "doc_id", "left")
    return graph, counts.na.fill(0, ["clauses", "references", "pending", "pruned"])


def ingest_by_name(graph: Graph, details: DataFrame, name: str, user_id: str | None = None, scenario_id: str | None = None, replace: bool = False) -> tuple[Graph, DataFrame]:
    """ingest() of the source documents of a name, in a user's scenario or the library; nothing found changes nothing."""
    ids = resolve_doc_ids(listing(details), name, user_id, scenario_id)
    return ingest(graph, details.join(ids, "doc_id", "left_semi"), replace)


def get_clauses(graph: Graph, doc_id: str) -> DataFrame:
    """A document's clauses with a text, in reading order."""
    return graph.clause.where((F.col("doc_id") == doc_id) & (F.coalesce("text", F.lit("")) != "")).orderBy("order", "node_id")


def without_restrictions(graph: Graph, gone: DataFrame) -> Graph:
    """The graph without restrictions (id) and their conflict edges. Plans stay."""
    conflict = graph.conflict
    for side in ("lo", "hi"):
        conflict = conflict.join(gone.select(F.col("id").alias(side)), side, "left_anti")
    return graph.with_(restriction=graph.restriction.join(gone.select("id"), "id", "left_anti"), conflict=conflict)


def without_clauses(graph: Graph, gone: DataFrame) -> tuple[Graph, DataFrame]:
    """(graph, restriction ids removed): without clauses (node_id), what was derived from them, and their edges. What goes is written as
    a table of keys, which several tables are cleared by."""
    derived = few_keys(graph.restriction.join(gone.select(F.col("node_id").alias("clause_node_id")), "clause_node_id", "left_semi").select("id"), "gone")
    edges = graph.references.join(gone.select(F.col("node_id").alias("src")), "src", "left_anti")
    dead = gone.select(F.lit("clause").alias("target_type"), F.col("node_id").alias("target_key"))
    edges = edges.join(dead, ["target_type", "target_key"], "left_anti")
    parts = graph.part_of.join(gone.select(F.col("node_id").alias("child")), "child", "left_anti").join(gone.select(F.col("node_id").alias("parent")), "parent", "left_anti")
    left = graph.clause.join(gone.select("node_id"), "node_id", "left_anti")
    return without_restrictions(graph.with_(clause=left, references=edges, part_of=parts), derived), derived


def delete_restrictions(graph: Graph, docs: DataFrame) -> tuple[Graph, DataFrame]:
    """(graph, (doc_id, deleted)) without the restrictions extracted from documents (doc_id)."""
    gone = few_keys(graph.restriction.join(docs.select("doc_id").distinct(), "doc_id", "left_semi").select("id", "doc_id"), "gone")
    return without_restrictions(graph, gone), gone.groupBy("doc_id").agg(F.count("*").alias("deleted"))


def prune(graph: Graph, docs: DataFrame, keep: DataFrame) -> tuple[Graph, DataFrame]:
    """(graph, (doc_id, pruned)) without the clauses of documents (doc_id) that are not in keep (node_id)."""
    stale = stale_clauses(graph.clause, docs, keep)
    graph, _ = without_clauses(graph, stale)
    return graph, stale.groupBy("doc_id").agg(F.countDistinct("node_id").alias("pruned"))


def delete_documents(graph: Graph, docs: DataFrame) -> tuple[Graph, DataFrame]:
    """(graph, (doc_id, clauses, restrictions)) without documents (doc_id), their clauses and what was derived. The vocabulary stays."""
    victims = few_keys(graph.document.join(docs.select("doc_id").distinct(), "doc_id", "left_semi").select("doc_id"), "victims")
    clauses = few_keys(graph.clause.join(victims, "doc_id", "left_semi").select("node_id", "doc_id"), "gone")
    derived = graph.restriction.select("id", F.col("clause_node_id").alias("node_id")).join(clauses, "node_id")
    n_c, n_r = clauses.groupBy("doc_id").agg(F.count("*").alias("clauses")), derived.groupBy("doc_id").agg(F.count("*").alias("restrictions"))
    counts = victims.join(n_c, "doc_id", "left").join(n_r, "doc_id", "left").na.fill(0, ["clauses", "restrictions"])
    left, _ = without_clauses(graph, clauses)
    dead = victims.select(F.lit("document").alias("target_type"), F.col("doc_id").alias("target_key"))
    return left.with_(document=graph.document.join(victims, "doc_id", "left_anti"), references=left.references.join(dead, ["target_type", "target_key"], "left_anti")), counts


def scope_documents(graph: Graph, user_id: str, scenario_id: str) -> DataFrame:
    return graph.document.where((F.col("user_id") == user_id) & (F.col("scenario_id") == scenario_id)).select("doc_id")


def delete_scope(graph: Graph, user_id: str, scenario_id: str) -> tuple[Graph, DataFrame]:
    """(graph, one row of documents, clauses, restrictions) without all documents of a user's scenario."""
    graph, counts = delete_documents(graph, scope_documents(graph, user_id, scenario_id))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c)
    return graph, counts.agg(F.count("*").alias("documents"), total("clauses"), total("restrictions"))


def documents_by_name(graph: Graph, name: str, user_id: str | None = None, scenario_id: str | None = None) -> DataFrame:
    rows = graph.document.where(F.col("name") == name)
    for column, value in (("user_id", user_id), ("scenario_id", scenario_id)):
        rows = rows if value is None else rows.where(F.col(column) == value)
    return rows


def delete_name(graph: Graph, name: str, user_id: str | None = None, scenario_id: str | None = None, versions: list[str] | None = None, document_removed: bool = False) -> tuple[Graph, DataFrame]:
    """(graph, counts) without the documents of a name in a scope: all of them, or those of the given versions; no versions, nothing."""
    rows = documents_by_name(graph, name, user_id, scenario_id)
    if not document_removed:
        rows = rows.where(F.col("version").isin(versions or []) | F.col("version_id").isin(versions or []))
    graph, counts = delete_documents(graph, rows.select("doc_id"))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c)
    return graph, counts.agg(F.count("*").alias("documents"), total("clauses"), total("restrictions"))


def stored_documents(graph: Graph) -> DataFrame:
    return graph.document.select("doc_id", "name", "content_hash", "user_id", "scenario_id")


def sync_state(graph: Graph, doc_id: str | None = None, among: DataFrame | None = None) -> DataFrame:
    """(doc_id, content_hash, restrictions) of one document, of those among (doc_id), or of all."""
    docs, found = graph.document, graph.restriction
    if doc_id is not None:
        docs, found = (t.where(F.col("doc_id") == doc_id) for t in (docs, found))
    if among is not None:
        docs, found = (t.join(among.select("doc_id").distinct(), "doc_id", "left_semi") for t in (docs, found))
    counts = found.groupBy("doc_id").agg(F.count("id").alias("n"))
    return docs.select("doc_id", "content_hash").join(counts, "doc_id", "left").select("doc_id", "content_hash", F.coalesce("n", F.lit(0)).alias("restrictions"))


def guard(states: DataFrame, incoming: DataFrame) -> DataFrame:
    """(doc_id, unchanged) of incoming documents (doc_id, content_hash): known, with restrictions, and the same non-empty hash."""
    s = states.select("doc_id", F.col("content_hash").alias("_hash"), "restrictions")
    same = (F.col("restrictions") > 0) & (F.coalesce("content_hash", F.lit("")) != "") & (F.col("content_hash") == F.col("_hash"))
    return incoming.select("doc_id", "content_hash").join(s, "doc_id", "left").select("doc_id", F.coalesce(same, F.lit(False)).alias("unchanged"))


def reconcile(listing: DataFrame, stored: DataFrame, with_scopes: bool = False) -> DataFrame:
    """(doc_id, action): added, updated (another non-empty hash), unchanged or deleted. Stored documents without content are stubs of
    references and count as absent; a user's documents are not in a listing and are left alone unless with_scopes."""
    have = stored if with_scopes or "user_id" not in stored.columns else stored.where("user_id is null")
    have = have.select("doc_id", F.col("content_hash").alias("_hash"), F.lit(True).alias("_stored"))
    told = listing.where("doc_id is not null and doc_id <> ''").dropDuplicates(["doc_id"]).select("doc_id", "content_hash", F.lit(True).alias("_listed"))
    both = told.join(have, "doc_id", "full_outer")
    stub = F.col("_stored").isNotNull() & F.col("_hash").isNull() & F.col("content_hash").isNotNull()
    changed = (F.coalesce("content_hash", F.lit("")) != "") & ~F.col("content_hash").eqNullSafe(F.col("_hash"))
    action = F.when(F.col("_listed").isNull(), "deleted").when(F.col("_stored").isNull() | stub, "added").when(changed, "updated").otherwise("unchanged")
    return both.select("doc_id", action.alias("action"))


def reconcile_counts(actions: DataFrame) -> DataFrame:
    count = lambda a: F.count_if(F.col("action") == a).alias(a)
    return actions.agg(*(count(a) for a in ("added", "updated", "unchanged", "deleted")))
