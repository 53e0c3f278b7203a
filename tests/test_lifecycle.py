"""The lifecycle through its own classes: bursts of events, replays, and writers that fail."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tessera.functions.models import hashing_embedder
from tessera.operators.extract import Models, rule_extractor
from tessera.operators.lifecycle import upsert_documents
from tessera.schema import conform, empty_graph
from tessera.sources import store as stores
from tessera.sources.documents import DETAIL
from tessera.sources.store import GraphStore, measured_broadcasts
from tessera.streaming.events import EVENT
from tessera.streaming.sync import LifecycleSync, Reconciled, deletions, writes

TEXT = "Расстояние от школы должно быть не менее 50 м"


def detail(spark, rows):
    """rows: (doc_id, name, version, hash)."""
    out = [{"doc_id": d, "name": n, "version": v, "version_id": v, "content_hash": h, "fragments": [{"id": f"{d}-1", "order": 1, "text": TEXT, "char_start": 0, "char_end": 50, "tags": []}]} for d, n, v, h in rows]
    return spark.createDataFrame(out, DETAIL)


def events(spark, *rows):
    """rows: (type, name, versions, whole)."""
    return spark.createDataFrame([(t, n, None, v, w, None, None, 0, k) for k, (t, n, v, w) in enumerate(rows)], EVENT)


def test_a_burst_of_events_in_order(spark):
    burst = events(spark, ("deleted", "D", ["1"], False), ("deleted", "D", ["2"], False), ("updated", "E", None, None), ("processed", "E", None, None), ("deleted", "E", ["4"], False), ("deleted", "F", None, True), ("processed", "F", None, None))
    got = {(r["document_name"], r["gone"]): r["after"] for r in deletions(burst).collect()}
    assert got == {("D", "1"): True, ("D", "2"): True, ("E", "4"): True, ("F", None): False}
    assert {(r["document_name"], r["replace"], r["at"]["o"]) for r in writes(burst).collect()} == {("E", True, 3), ("F", False, 6)}


def test_batches_replays_and_a_failing_writer(spark, tmp_path, monkeypatch):
    source = [("a1", "D", "1", "h1"), ("a2", "D", "2", "h2"), ("a3", "D", "3", "h3")]
    store = GraphStore(spark, str(tmp_path))
    sync = LifecycleSync(store, lambda: detail(spark, source), Models(hashing_embedder()), lambda: "2024-01-01 00:00:00")
    graph = sync.apply(events(spark, ("processed", "D", None, None)))
    assert sorted(r["doc_id"] for r in graph.document.collect()) == ["a1", "a2", "a3"] and graph.restriction.count() == 3
    burst = events(spark, ("deleted", "D", ["1"], False), ("deleted", "D", ["2"], False))
    # A writer that fails before its mark leaves the version before it.
    real = GraphStore._fs
    with monkeypatch.context() as m:
        m.setattr(GraphStore, "_fs", lambda self, path: real(self, path) if not path.endswith("versions/2.json") else 1 / 0)
        with pytest.raises(ZeroDivisionError):
            sync.apply(burst)
    assert store.version() == 1 and store.load().document.count() == 3
    for _ in range(2):  # the batch again, and once more
        graph = sync.apply(burst)
        assert [r["doc_id"] for r in graph.document.collect()] == ["a3"] and graph.restriction.count() == 1
    first, last = store.mark(1)["tables"], store.mark()["tables"]
    assert first["kind"] == last["kind"] and first["document"] != last["document"]  # what a batch leaves alone is not written again


def test_versions_of_a_store(spark, tmp_path):
    store = GraphStore(spark, str(tmp_path))
    assert store.version() == 0 and store.load().document.count() == 0
    assert store.publish(empty_graph(spark)) == 1
    before = store.load()
    assert store.publish(before, before) == 2 and store.mark(1) == store.mark(2)


def grown(spark, n):
    g = empty_graph(spark)
    docs = spark.range(n).select(F.concat(F.lit("d"), "id").alias("doc_id"), F.lit("name").alias("name"), F.sha1(F.col("id").cast("string")).alias("content_hash"))
    return g.with_(document=conform(docs, "document"))


def size(root):
    return sum(p.stat().st_size for p in root.rglob("*.parquet"))


def test_a_change_of_one_row_writes_one_bucket_at_any_size(spark, tmp_path):
    wrote = []
    for n in (4000, 16000):
        root = tmp_path / str(n)
        store = GraphStore(spark, str(root), bucket_rows=500)
        store.publish(grown(spark, n))
        before, at = store.load(), size(root)
        row = spark.createDataFrame([("d7", "renamed")], "doc_id string, name string")
        store.publish(upsert_documents(before, row), before)
        wrote.append(size(root) - at)
        old, new = store.mark(1)["tables"]["document"], store.mark(2)["tables"]["document"]
        assert old["buckets"] == new["buckets"] == n // 500 and sum(old["parts"][b] != new["parts"][b] for b in new["parts"]) == 1
        now = store.load().document
        assert now.count() == n and [r["name"] for r in now.where("doc_id = 'd7'").collect()] == ["renamed"]
        assert store.load(1).document.where("name = 'renamed'").isEmpty()
        assert store.vacuum(keep=1) > 0 and store.load().document.count() == n
    assert wrote[1] < 1.5 * wrote[0]


def test_a_table_that_grows_is_dealt_anew(spark, tmp_path):
    store = GraphStore(spark, str(tmp_path), bucket_rows=100)
    for n in (50, 300, 900):
        store.publish(grown(spark, n))
        assert store.load().document.count() == n
    assert store.mark()["tables"]["document"]["buckets"] == 16
    store.publish(grown(spark, 0))
    assert store.load().document.count() == 0


def test_two_writers_of_one_version(spark, tmp_path, monkeypatch):
    """The later one fails, and what the first committed stays as it was."""
    first, second = GraphStore(spark, str(tmp_path)), GraphStore(spark, str(tmp_path))
    with monkeypatch.context() as m:
        m.setattr(GraphStore, "version", lambda self: 0)
        first.publish(grown(spark, 5))
        with pytest.raises(RuntimeError):
            second.publish(grown(spark, 9))
    assert first.version() == 1 and first.load().document.count() == 5


def test_merge_takes_a_stated_row_of_several(spark):
    rows = spark.createDataFrame([("d", "a", "t1"), ("d", "b", None), ("d", None, "t9")], "doc_id string, name string, title string")
    got = upsert_documents(empty_graph(spark), rows).document.collect()
    assert [(r["name"], r["title"]) for r in got] == [("b", None)]


def failing():
    def run(text):  # a function of its own, as workers don't import tests
        if "fail" in text:
            raise ValueError("cannot read this")
        return rule_extractor(text)

    return run


def with_text(spark, rows):
    """rows: (doc_id, hash, text, fragment id)."""
    out = [{"doc_id": d, "name": d, "version": "1", "version_id": "1", "content_hash": h, "fragments": [{"id": f, "order": 1, "text": t, "char_start": 0, "char_end": 50, "tags": []}]} for d, h, t, f in rows]
    return spark.createDataFrame(out, DETAIL)


def test_reconcile_counts_failures_and_tries_them_again(spark, tmp_path):
    state = {"rows": [("keep", "h1", TEXT, "k1"), ("chg", "h2", TEXT, "c1"), ("gone", "h3", TEXT, "g1"), ("bad", "h4", TEXT + " fail", "b1"), ("noid", "h5", TEXT, None)]}
    sync = LifecycleSync(GraphStore(spark, str(tmp_path)), lambda: with_text(spark, state["rows"]), Models(hashing_embedder(), failing()), lambda: "2024-01-01 00:00:00")
    assert sync.reconcile() == Reconciled(added=3, failed=2)
    said = {r["doc_id"]: r for r in sync.store.outcomes().collect()}
    assert said["bad"]["error"] == "ValueError: cannot read this" and said["noid"]["error"] == "a fragment has no id"
    assert {d: (r["outcome"], r["clauses"], r["restrictions"]) for d, r in said.items() if d in ("keep", "chg")} == {"keep": ("synced", 1, 1), "chg": ("synced", 1, 1)}
    assert sorted(r["doc_id"] for r in sync.store.load().document.collect()) == ["chg", "gone", "keep"]
    # One is new, one has another hash and fails, one is gone, and one that failed can be read now.
    state["rows"] = [("keep", "h1", TEXT, "k1"), ("chg", "h2-new", TEXT + " fail", "c2"), ("new", "h6", TEXT, "n1"), ("bad", "h4", TEXT, "b1"), ("null", None, TEXT, "u1")]
    assert sync.reconcile() == Reconciled(added=3, unchanged=1, deleted=1, failed=1)
    graph = sync.store.load()
    assert {r["doc_id"]: r["content_hash"] for r in graph.document.collect()} == {"keep": "h1", "chg": "h2", "new": "h6", "bad": "h4", "null": None}
    assert sorted(r["clause_node_id"] for r in graph.restriction.collect()) == ["b1", "c1", "k1", "n1", "u1"]
    assert LifecycleSync(sync.store, lambda: 1 / 0, sync.models, sync.now).reconcile() == Reconciled(skipped=True, reason="source unreachable: ZeroDivisionError")


def test_outcomes_of_an_update(spark, tmp_path):
    """Counters of what a batch wrote: clauses, pruned clauses, references, restrictions, pending kinds and conflicts."""
    parts = [("x1", "Расстояние от школы должно быть не менее 50 м", [("see x2", "Doc", "2", None)]), ("x2", "Расстояние от школы должно быть не более 20 м", [])]
    state = {"parts": parts, "hash": "h1"}

    def source():
        frags = [{"id": i, "order": k, "text": t, "char_start": 0, "char_end": 50, "tags": [], "references": [{"raw": a, "target_name": b, "target_numbering": c, "resolved": bool(d), "target_node_id": d} for a, b, c, d in refs]} for k, (i, t, refs) in enumerate(state["parts"])]
        return spark.createDataFrame([{"doc_id": "x", "name": "X", "content_hash": state["hash"], "fragments": frags}], DETAIL)

    sync = LifecycleSync(GraphStore(spark, str(tmp_path)), source, Models(hashing_embedder()), lambda: "2024-01-01 00:00:00")
    sync.reconcile()
    out = sync.store.outcomes().collect()[0]
    assert (out["clauses"], out["references"], out["pending"], out["pruned"], out["restrictions"]) == (2, 0, 1, 0, 2)
    g = sync.store.load()
    kinds = {r["name"]: r["status"] for r in g.kind.collect()}
    assert out["pending_kinds"] == sum(kinds[r["kind"]] == "pending" for r in g.restriction.collect()) == 2
    assert out["conflicts"] == g.conflict.count() and {r["template"] for r in g.check_plan.collect()} == {"distance_from_source", "presence_within"}
    state.update(parts=parts[:1], hash="h2")
    assert sync.reconcile().updated == 1
    out = sync.store.outcomes().collect()[0]
    assert (out["clauses"], out["pruned"], out["restrictions"]) == (1, 1, 1) and sync.store.load().restriction.count() == 1
    sync.apply(events(spark, ("deleted", "X", None, True)))
    out = sync.store.outcomes().collect()
    assert [(r["outcome"], r["clauses"], r["restrictions"]) for r in out] == [("deleted", 1, 1)]


def broadcasts(spark) -> int:
    """Broadcasts of all queries that the session still knows of."""
    known = spark._jsparkSession.sharedState().statusStore()
    runs = known.executionsList()
    nodes = [known.planGraph(runs.apply(k).executionId()).allNodes() for k in range(runs.size())]
    return sum(graph.apply(k).name() == "BroadcastExchange" for graph in nodes for k in range(graph.size()))


def test_a_batch_is_broadcast_by_count_and_not_by_the_size_of_its_files(spark, tmp_path, monkeypatch):
    """Ids, texts and vectors in a row take few bytes in files and many as hash tables: beyond the limits nothing goes through the driver."""
    plan = lambda few: upsert_documents(grown(spark, 50), grown(spark, 9).document, few)
    assert "BroadcastExchange" in plan(True).document._jdf.queryExecution().executedPlan().toString()
    names = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")
    before = [spark.conf.get(k, None) for k in names]
    for limit in ("FEW_KEYS", "FEW_ROWS"):
        monkeypatch.setattr(stores, limit, -1)  # not even an empty table
    monkeypatch.setattr(stores.counted, "__defaults__", (-1,))
    spark.conf.set(names[1], "-1")  # what a shuffle measures counts for nothing either
    try:
        at = broadcasts(spark)
        rows = [(d, "h1", TEXT, f"{d}1") for d in "abcd"]
        sync = LifecycleSync(GraphStore(spark, str(tmp_path)), lambda: with_text(spark, rows), Models(hashing_embedder(), failing()), lambda: "2024-01-01 00:00:00")
        assert sync.reconcile() == Reconciled(added=4)
        rows[:] = [("a", "h2", TEXT, "a1"), ("b", "h1", TEXT, "b1"), ("c", "h2", TEXT + " fail", "c1")]
        assert sync.reconcile() == Reconciled(updated=1, unchanged=1, deleted=1, failed=1)
        assert broadcasts(spark) == at
        graph = sync.store.load()
        assert {r["doc_id"]: r["content_hash"] for r in graph.document.collect()} == {"a": "h2", "b": "h1", "c": "h1"} and graph.restriction.count() == 3
        assert sorted(map(tuple, plan(True).document.collect())) == sorted(map(tuple, plan(False).document.collect()))
    finally:
        spark.conf.unset(names[1])
    assert [spark.conf.get(k, None) for k in names] == before
    with pytest.raises(ZeroDivisionError), measured_broadcasts(spark):
        assert spark.conf.get(names[0]) == "-1" and spark.conf.get(names[1]) is not None
        1 / 0
    assert [spark.conf.get(k, None) for k in names] == before
