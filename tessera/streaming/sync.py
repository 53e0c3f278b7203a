"""Lifecycle events of documents, in the order of their partition and offset; a batch becomes one new version of the graph."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import asdict, dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery

from ..operators.extract import OUTCOME, Models, sync_documents
from ..operators.lifecycle import delete_documents, reconcile, stored_documents
from ..schema import Graph
from ..sources.documents import listing
from ..sources.event_log import append_events, log_table
from ..sources.store import GraphStore, few_keys, few_rows, materialize, measured_broadcasts, scratch_dir
from .events import EVENT, accepted, read_topic, rejected
from .state import SCOPE, fresh, keyed_state, remembered


def _keyed(events: DataFrame) -> DataFrame:
    """A topic keeps a document's events in one partition, so that partition and offset order them."""
    keys = {f"_{c}": F.coalesce(c, F.lit("")) for c in SCOPE}
    return events.withColumns({**keys, "at": F.struct(F.coalesce("partition", F.lit(0)).alias("p"), F.coalesce("offset", F.lit(0)).alias("o"))})


def writes(events: DataFrame) -> DataFrame:
    """(document_name, user_id, scenario_id, at, replace) of each document with a processed or updated event: the last one's place, and
    whether one of them demands to write anew."""
    rows = _keyed(events).where(F.col("event_type").isin("processed", "updated"))
    best = rows.groupBy(*(f"_{c}" for c in SCOPE)).agg(*(F.first(c).alias(c) for c in SCOPE), F.max("at").alias("at"), F.max(F.col("event_type") == "updated").alias("replace"))
    return best.select(*SCOPE, "at", "replace")


def deletions(events: DataFrame) -> DataFrame:
    """(document_name, user_id, scenario_id, gone, after): versions that delete events name (null: all of them), each once, and whether
    one of these comes after the document's last write. No event of a burst is lost to a later one."""
    keys, rows = [f"_{c}" for c in SCOPE], _keyed(events)
    last = rows.where(F.col("event_type").isin("processed", "updated")).groupBy(*keys).agg(F.max("at").alias("last"))
    rows = rows.where("event_type = 'deleted'").join(last, keys, "left")
    whole = F.coalesce("document_removed", F.lit(False))
    named = F.when(whole, F.array(F.lit(None).cast("string"))).otherwise(F.filter(F.coalesce("versions_removed", F.array().cast("array<string>")), lambda v: v.isNotNull()))
    each = rows.select(*SCOPE, F.explode(named).alias("gone"), (F.col("last").isNull() | (F.col("at") > F.col("last"))).alias("after"))
    return each.groupBy(*SCOPE, "gone").agg(F.max("after").alias("after"))


def in_scope(documents: DataFrame, events: DataFrame) -> DataFrame:
    """(doc_id and the event's columns) of documents that events name in their scope; an event without a scope means library documents."""
    d = documents.select("doc_id", F.col("name").alias("_name"), F.col("version").alias("_version"), F.col("version_id").alias("_version_id"), F.col("user_id").alias("_user"), F.col("scenario_id").alias("_scenario"))
    on = (F.col("_name") == F.col("document_name")) & F.col("_user").eqNullSafe(F.col("user_id")) & F.col("_scenario").eqNullSafe(F.col("scenario_id"))
    return d.join(events, on)


@dataclass
class Reconciled:
    """Documents by what was done with them; skipped, with a reason, if the source could not be read."""

    added: int = 0
    updated: int = 0
    unchanged: int = 0
    deleted: int = 0
    failed: int = 0
    skipped: bool = False
    reason: str | None = None


def _all(parts: list[DataFrame], spark: SparkSession, schema: str) -> DataFrame:
    return reduce(DataFrame.unionByName, parts, spark.createDataFrame([], schema))


class LifecycleSync:
    """Applies batches of events to a store. details: a function that gives the source documents now."""

    def __init__(self, store: GraphStore, details: Callable[[], DataFrame], models: Models, now: Callable[[], str]) -> None:
        self.store, self.details, self.models, self.now = store, details, models, now

    def apply(self, events: DataFrame, batch: int = 0) -> Graph:
        """One batch: all deletions, the documents written by its events as the source has them now, and deletions that came after a
        document's last write once more. Doing it again changes nothing: deleted documents are gone, unchanged ones are guarded
        by their hash, updated ones are written anew under the same ids. Buckets of tables that change are written, and with them what
        became of each document; one that fails stops no other."""
        with measured_broadcasts(self.store.spark), measured_broadcasts(events.sparkSession):
            return self._applied(events)

    def _applied(self, events: DataFrame) -> Graph:
        events = materialize(events, "events")
        before = graph = self.store.load()
        gone, wrote = few_keys(deletions(events), "deletions"), few_keys(writes(events), "writes")
        graph, out = self.without(graph, gone)
        outcomes = [out]
        source = self.details()
        docs = few_keys(in_scope(source, wrote).groupBy("doc_id").agg(F.max("replace").alias("replace")), "named")
        if not docs.isEmpty():
            graph, out = sync_documents(graph, source.join(docs, "doc_id", "left_semi"), self.models, self.now(), docs.where("replace").select("doc_id"))
            outcomes.append(out)
        graph, out = self.without(graph, gone.where("after"))
        self.store.publish(graph, before, _all([*outcomes, out], events.sparkSession, OUTCOME), once=not few_rows(docs))
        return self.store.load()

    def without(self, graph: Graph, gone: DataFrame) -> tuple[Graph, DataFrame]:
        """(graph, outcomes) without the documents of deletions; the same graph if there are none."""
        hit = F.col("gone").isNull() | (F.col("_version") == F.col("gone")) | (F.col("_version_id") == F.col("gone"))
        return self._deleted(graph, few_keys(in_scope(graph.document, gone).where(hit).select("doc_id").distinct(), "gone"))

    def _deleted(self, graph: Graph, docs: DataFrame) -> tuple[Graph, DataFrame]:
        if docs.isEmpty():
            return graph, docs.sparkSession.createDataFrame([], OUTCOME)
        graph, counts = delete_documents(graph, docs)
        none = {c: F.lit(0).cast("long") for c in ("references", "pending", "pruned", "pending_kinds", "conflicts")}
        out = counts.withColumns({"outcome": F.lit("deleted"), "error": F.lit(None).cast("string"), **none})
        return graph, materialize(out.select(*(c.split()[0] for c in OUTCOME.split(", "))), "outcomes")

    def reconcile(self) -> Reconciled:
        """Bring the store to what the source lists: documents that it lacks are added, those of another hash written anew, those no longer
        listed deleted. One that fails is counted, its error kept in the version's outcomes, and it is tried again the next time, as the
        store keeps what it had. A source that cannot be read changes nothing."""
        with measured_broadcasts(self.store.spark):
            return self._reconciled()

    def _reconciled(self) -> Reconciled:
        try:
            source = materialize(self.details(), "source")
        except Exception as e:  # whatever a source raises
            return Reconciled(skipped=True, reason=f"source unreachable: {type(e).__name__}")
        before = graph = self.store.load()
        actions = materialize(reconcile(listing(source.where("user_id is null")), stored_documents(graph)), "actions")
        outcomes = []
        wanted = few_keys(actions.where("action in ('added', 'updated')"), "wanted")
        if not wanted.isEmpty():
            graph, out = sync_documents(graph, source.join(wanted, "doc_id", "left_semi"), self.models, self.now(), wanted.where("action = 'updated'").select("doc_id"))
            outcomes.append(out)
        graph, out = self._deleted(graph, few_keys(actions.where("action = 'deleted'").select("doc_id"), "gone"))
        outcomes = materialize(_all([*outcomes, out], source.sparkSession, OUTCOME), "outcomes")
        if graph is not before or not outcomes.isEmpty():
            self.store.publish(graph, before, outcomes, once=not few_rows(outcomes))
        failed = outcomes.where("outcome = 'failed'").select("doc_id", F.lit(True).alias("failed"))
        done = actions.join(failed, "doc_id", "left").select(F.when(F.col("failed"), "failed").otherwise(F.col("action")).alias("action"))
        return Reconciled(**{r["action"]: r["count"] for r in done.groupBy("action").count().collect()})

    def stream(self, events: DataFrame, checkpoint: str) -> DataStreamWriter:
        """The stream that applies each batch; its checkpoint keeps the place, so that a batch is done at least once."""
        return events.writeStream.foreachBatch(lambda df, batch: self.apply(df, batch) and None).option("checkpointLocation", checkpoint)

    def start(self, decoded: DataFrame, checkpoint: str, rejects: str, **trigger) -> StreamingQuery:
        """Follow a decoded stream (events.read_topic): its events, replays left out by each document's state, are applied batch by batch; what
        is no event is added to the table rejects beside them. Started anew with the same checkpoint it goes on where it was."""
        spark = decoded.sparkSession

        def each(df: DataFrame, batch: int) -> None:
            df = materialize(df, "batch")
            bad = df.where("problem is not null")
            if not bad.isEmpty():  # a folder for each batch: done twice, it is there once
                rejected(bad).write.mode("overwrite").parquet(f"{rejects}/batch={batch}")
            good = df.where("problem is null").select(*(c.split()[0] for c in EVENT.split(", ")))
            if not good.isEmpty():
                self.apply(good, batch)

        told = decoded.where("problem is not null").select(*decoded.columns)
        kept = fresh(accepted(decoded)).withColumns({"value": F.lit(None).cast("string"), "problem": F.lit(None).cast("string")})
        with keyed_state(spark):
            return kept.unionByName(told).writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(**trigger).start()


def document_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's state after a stream over the events table: its events become a topic in two parts, and a query reads each part as
    it is there, the second one started anew from the checkpoint of the first."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    kind = F.when(F.col("event_type") == "signup", "DocumentProcessed").when(F.col("event_type") == "error", "DocumentDeleted").otherwise("DocumentUpdated")
    name = F.get_json_object("props", "$.k")
    value = F.to_json(F.struct(kind.alias("event_type"), name.alias("document_name"), F.lit("1").alias("version"), F.array(F.lit("1")).alias("versions_removed"), F.lit(False).alias("document_removed"), "event_id"))
    rows = events.select("event_id", value.alias("value"), name.alias("name"))
    middle = events.agg(F.percentile_approx("event_id", 0.5)).first()[0]
    root = f"{scratch_dir(spark)}/tessera/stream-{uuid.uuid4().hex}"

    def count(df: DataFrame, batch: int) -> None:
        df.write.format("noop").mode("overwrite").save()

    for part in (rows.where(F.col("event_id") <= middle), rows.where(F.col("event_id") > middle)):
        append_events(part, f"{root}/topic", F.col("name"), "event_id")
        with keyed_state(spark):
            query = fresh(accepted(read_topic(spark, f"{root}/topic"))).writeStream.foreachBatch(count).option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start()
        query.awaitTermination()
    last = log_table(spark, f"{root}/topic").select("partition", "offset", F.get_json_object("value", "$.event_id").cast("long").alias("last_event"))
    states = remembered(spark, f"{root}/checkpoint").join(last, ["partition", "offset"])
    return states.select(F.col("document_name").cast("long").alias("document"), "status", "last_event", "n_events")
