"""Restrictions from clause texts: an extractor finds them, set-based steps resolve, identify and write them."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.models import Embedder, embed_column
from ..functions.scalars import absolute, attribute_text, embedding_text, parse_number, restriction_id, value_text
from ..plans.planner import plan_columns, review_status
from ..plans.revisions import append
from ..schema import Graph
from ..sources import store
from ..sources.store import few_keys, materialize
from .conflicts import find_conflicts
from .lifecycle import clauses_after, delete_restrictions, guard, ingest, sync_state, upsert_conflicts, upsert_entities, upsert_kinds, upsert_restrictions
from .search import ENTITY_THRESHOLD, KIND_THRESHOLD
from .vocabulary import resolve_entities, resolve_kinds, vocabulary_changes

#: The class of extractions that are restrictions; others are dropped.
RESTRICTION = "ограничение"
EXTRACTION = "node_id string, doc_id string, order int, seq int, extraction_class string, extraction_text string, attributes map<string,array<string>>, start_pos int, end_pos int"
#: text -> (class, text, attributes, start, end) of each find.
Extractor = Callable[[str], list[tuple[str, str, dict[str, list[str]], int | None, int | None]]]

# Words of a bound, units, and the modal phrases that part a clause.
BOUNDS = {"не менее": ">=", "не более": "<=", "не выше": "<=", "свыше": ">", "более": ">", "менее": "<", "at least": ">=", "at most": "<=", "more than": ">", "less than": "<"}
UNITS = r"%|км|эт\.?|м²|м|шт|m"
MODAL = r"должн[аоы]?|должен|следует|допускается|must|shall"
AMOUNT = re.compile(rf"({'|'.join(BOUNDS)})\s+(\d+(?:[.,]\d+)?)\s*({UNITS})(?![\w])", re.IGNORECASE)
FORBIDDEN = re.compile(r"не допускается\s+(размещ\w+|использ\w+)\s+([^.;]+)", re.IGNORECASE)
DEMANDED = re.compile(r"следует\s+размещ\w+\s+([^.;]+)", re.IGNORECASE)


def rule_extractor(text: str) -> list[tuple[str, str, dict[str, list[str]], int, int]]:
    """The offline default: bans, demands and bounded amounts that a clause states in so many words."""
    head = re.split(rf"(?:не\s+)?(?:{MODAL})", text, maxsplit=1, flags=re.IGNORECASE)[0].strip(" ,.")
    amount = AMOUNT.search(text)
    value = {"value_operator": [BOUNDS[amount[1].lower()]], "value_number": [amount[2]], "value_unit": [amount[3]]} if amount else {}
    out = []
    for m in FORBIDDEN.finditer(text):
        kind = "запрет_размещения" if m[1].lower().startswith("размещ") else "запрет_использования"
        out.append((RESTRICTION, m[0].strip(), {"subject": [head], "object": [m[2].strip()], "kind": [kind]} | value, m.start(), m.start() + len(m[0].strip())))
    for m in [] if out else DEMANDED.finditer(text):
        out.append((RESTRICTION, m[0].strip(), {"subject": [head], "object": ["размещение"], "kind": ["требование_размещения"]} | value, m.start(), m.start() + len(m[0].strip())))
    if amount and not out:
        kind = "минимальная_доля_площади" if amount[3] == "%" else "минимальное_расстояние" if BOUNDS[amount[1].lower()] in (">=", ">") else "предельная_высота"
        out.append((RESTRICTION, amount[0], {"subject": [head], "object": [head.split()[-1] if head else ""], "kind": [kind]} | value, amount.start(), amount.end()))
    return out


def extract(clauses: DataFrame, extractor: Extractor = rule_extractor, tolerant: bool = False) -> DataFrame:
    """Extractions (0 to n a clause) of clauses with a text, by partitions: a model behind the extractor is made once for each. With
    tolerant there is a column error, and a clause that the extractor fails on is one row that says why and fails nothing else."""
    schema = f"{EXTRACTION}, error string" if tolerant else EXTRACTION

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in schema.split(", ")]
        for batch in batches:
            rows = []
            for node, doc, order, text in zip(batch["node_id"], batch["doc_id"], batch["order"], batch["text"]):
                try:
                    found = [(node, doc, order, k, *f) for k, f in enumerate(extractor(text))]
                except Exception as e:  # whatever a model raises
                    if not tolerant:
                        raise
                    found = [(node, doc, order, None, None, None, None, None, None, f"{type(e).__name__}: {e}")]
                rows += found if not tolerant else [r if len(r) == len(names) else (*r, None) for r in found]
            out = pd.DataFrame(rows, columns=names)
            yield out.astype({c: "Int32" for c in ("order", "seq", "start_pos", "end_pos")})

    return clauses.where("text is not null and trim(text) <> ''").select("node_id", "doc_id", "order", "text").mapInPandas(run, schema)


def to_restrictions(extractions: DataFrame) -> DataFrame:
    """Triples with their value from extractions; those of another class or without subject, object or kind are dropped."""
    part = lambda c: attribute_text(F.coalesce(F.col("attributes")[c], F.array().cast("array<string>")))
    blank = lambda c: F.when(c != "", c)
    single = F.when(F.size(F.col("attributes")["value_number"]) == 1, F.col("attributes")["value_number"][0])
    rows = extractions.where(F.col("extraction_class") == RESTRICTION).select(
        "node_id", "doc_id", "order", "seq", F.coalesce("extraction_text", F.lit("")).alias("extraction_text"), "start_pos", "end_pos",
        *(part(c).alias(c) for c in ("subject", "object", "kind")),
        blank(part("value_operator")).alias("value_operator"), parse_number(single).alias("value_number"), blank(part("value_unit")).alias("value_unit"), blank(part("value_condition")).alias("value_condition"),
    )
    return rows.where("subject <> '' and object <> '' and kind <> ''")


@dataclass(frozen=True)
class Models:
    embedder: Embedder
    extractor: Extractor = rule_extractor
    entity_threshold: float = ENTITY_THRESHOLD
    kind_threshold: float = KIND_THRESHOLD


def write_restrictions(graph: Graph, found: DataFrame, models: Models, at: str, few: bool = False) -> tuple[Graph, DataFrame]:
    """(graph, counts) with restrictions written: labels resolved in the order of documents, clauses and finds, ids made of what is said
    where, plans appended (reviewed ones stay) and conflicts of the new restrictions noted. counts: doc_id, restrictions, pending_kinds, conflicts."""
    found = materialize(found, "found")
    turn = F.struct("doc_id", "order", "node_id", "seq")
    mentions = found.select(F.struct(turn.alias("t"), F.lit(0).alias("role")).alias("seq"), F.col("subject").alias("label")).union(found.select(F.struct(turn.alias("t"), F.lit(1).alias("role")).alias("seq"), F.col("object").alias("label")))
    entities = materialize(resolve_entities(mentions, graph.entity, models.embedder, models.entity_threshold), "entities")
    kinds = materialize(resolve_kinds(found.select(F.struct(turn.alias("t"), F.lit(0).alias("role")).alias("seq"), F.col("kind").alias("label")), graph.kind, models.embedder, models.kind_threshold), "kinds")
    graph = upsert_entities(graph, vocabulary_changes(entities, "normalized", "approved"), few)
    graph = upsert_kinds(graph, vocabulary_changes(kinds, "name", "pending"), few)

    def by_label(resolved: DataFrame, label: str, key: str) -> DataFrame:
        return few_keys(resolved.select(F.col("label").alias(label), F.col("key").alias(key)).distinct(), label)

    status = few_keys(graph.kind.select(F.col("name").alias("kind_key"), F.coalesce("status", F.lit("approved")).alias("kind_status")), "status")
    spoken = few_keys(found.select("node_id").distinct(), "spoken")
    clauses = graph.clause.join(spoken, "node_id", "left_semi").select("node_id", "version_id", F.col("char_start").alias("_base"))
    rows = found.join(by_label(entities, "subject", "subject_normalized"), "subject").join(by_label(entities, "object", "object_normalized"), "object")
    rows = rows.join(by_label(kinds, "kind", "kind_key"), "kind").join(status, "kind_key", "left").join(clauses, "node_id")
    value = [F.col(f"value_{c}") for c in ("operator", "number", "unit", "condition")]
    rows = rows.withColumn("id", restriction_id(F.col("node_id"), F.col("subject_normalized"), F.col("object_normalized"), F.col("kind_key"), value_text(*value)))
    rows = rows.withColumns({
        "embedding": embed_column(embedding_text(F.col("subject"), F.col("object"), F.col("kind_key"), *value), models.embedder), "clause_node_id": F.col("node_id"),
        "kind": F.col("kind_key"), "char_start": absolute(F.col("_base"), F.col("start_pos")), "char_end": absolute(F.col("_base"), F.col("end_pos")),
    })
    rows = materialize(rows.dropDuplicates(["id"]), "written")
    graph = upsert_restrictions(graph, rows, few)
    plans = plan_columns(rows).withColumn("review_status", review_status(F.col("planner_status"))).withColumn("created_at", F.lit(at).cast("timestamp"))
    graph = graph.with_(check_plan=append(graph.check_plan, plans, graph.restriction, protect_reviewed=True))
    new = few_keys(find_conflicts(graph, rows.select("id"), few=store.FEW_KEYS).withColumn("detected_at", F.lit(at).cast("timestamp")), "conflicts")
    graph = upsert_conflicts(graph, new, few)
    sides = new.select(F.explode(F.array("lo", "hi")).alias("id"), "lo", "hi")
    n_conflicts = sides.join(rows.select("id", "doc_id"), "id").groupBy("doc_id").agg(F.countDistinct("lo", "hi").alias("conflicts"))
    counts = rows.groupBy("doc_id").agg(F.count("*").alias("restrictions"), F.count_if(F.col("kind_status") == "pending").alias("pending_kinds"))
    return graph, counts.join(n_conflicts, "doc_id", "left").na.fill(0, ["conflicts"])


#: What became of a document: synced, unchanged (its structure is written, nothing is extracted), failed (nothing is written) or deleted.
OUTCOME = "doc_id string, outcome string, clauses long, references long, pending long, pruned long, restrictions long, pending_kinds long, conflicts long, error string"


def sync_documents(graph: Graph, details: DataFrame, models: Models, at: str, anew: DataFrame) -> tuple[Graph, DataFrame]:
    """(graph, outcomes) with source documents ingested and their restrictions extracted; those of anew (doc_id) lose what they no longer
    say. A known document of the same hash with restrictions keeps them if it isn't among anew.

    A document fails by itself: if a fragment has no id or the extractor raises on a clause, the graph keeps what it had of it, its
    outcome says why, and all others are synced.
    """
    details = materialize(details, "details")
    states = guard(sync_state(graph, among=few_keys(details.select("doc_id"), "known")), details).join(anew, "doc_id", "left_anti")
    same = few_keys(states.where("unchanged").select("doc_id"), "unchanged")
    faulty = details.where(F.exists("fragments", lambda f: F.coalesce(f["id"], F.lit("")) == ""))
    broken = few_keys(faulty.select("doc_id", F.lit("a fragment has no id").alias("error")), "broken")
    whole = details.join(broken, "doc_id", "left_anti")
    todo = whole.join(same, "doc_id", "left_anti")
    clauses = clauses_after(graph, todo, anew).join(few_keys(todo.select("doc_id"), "todo"), "doc_id", "left_semi")
    raw = materialize(extract(clauses, models.extractor, tolerant=True), "extracted")
    failed = few_keys(broken.unionByName(raw.where("error is not null").groupBy("doc_id").agg(F.min("error").alias("error"))), "failed")
    good = materialize(whole.join(failed, "doc_id", "left_anti"), "good")
    graph, counts = ingest(graph, good, anew, few=True)
    counts = materialize(counts, "counts")
    synced = good.join(same, "doc_id", "left_anti").select("doc_id")
    graph, _ = delete_restrictions(graph, few_keys(synced.join(anew, "doc_id", "left_semi"), "anew"))
    graph, found = write_restrictions(graph, to_restrictions(raw.where("error is null").join(failed, "doc_id", "left_anti")), models, at, few=True)
    became = same.withColumn("outcome", F.lit("unchanged")).unionByName(synced.withColumn("outcome", F.lit("synced"))).withColumn("error", F.lit(None).cast("string"))
    became = became.unionByName(failed.withColumn("outcome", F.lit("failed")))
    out = became.join(counts, "doc_id", "left").join(found, "doc_id", "left").na.fill(0)
    return graph, materialize(out.select(*(c.split()[0] for c in OUTCOME.split(", "))), "outcomes")


def extract_documents(graph: Graph, docs: DataFrame, models: Models, at: str, replace: bool = False) -> tuple[Graph, DataFrame]:
    """(graph, counts) with the restrictions of documents (doc_id); replace first removes those they have."""
    if replace:
        graph, _ = delete_restrictions(graph, docs)
    clauses = graph.clause.join(docs.select("doc_id").distinct(), "doc_id", "left_semi")
    return write_restrictions(graph, to_restrictions(extract(clauses, models.extractor)), models, at)
