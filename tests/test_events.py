"""Events from a topic in a folder: decoding, offsets, restarts of a stream, and a document's state from batch to batch."""

from __future__ import annotations

import json

from pyspark.sql import functions as F
from test_lifecycle import TEXT, detail

from tessera.functions.models import hashing_embedder
from tessera.operators.extract import Models
from tessera.sources.event_log import append_events, ends, log_table, segments
from tessera.sources.store import GraphStore
from tessera.streaming import events as ev
from tessera.streaming.state import fresh, keyed_state, remembered
from tessera.streaming.sync import LifecycleSync


def put(spark, topic, values, partitions=3):
    """values: (key, JSON value or text)."""
    rows = [(k, key, v if v is None or isinstance(v, str) else json.dumps(v)) for k, (key, v) in enumerate(values)]
    append_events(spark.createDataFrame(rows, "k int, key string, value string"), topic, F.col("key"), "k", partitions=partitions)


def written(name, version=None, kind="DocumentProcessed"):
    return name, {"event_type": kind, "document_name": name} | ({"version": version} if version else {})


def test_a_topic_keeps_order_and_offsets(spark, tmp_path):
    topic = f"{tmp_path}/topic"
    assert log_table(spark, topic).count() == 0
    for turn in range(3):
        put(spark, topic, [(f"k{k % 7}", f"{turn}:{k}\nline") for k in range(50)])
    rows = log_table(spark, topic).collect()
    assert len(rows) == len({(r["partition"], r["offset"]) for r in rows}) == 150
    for p in {r["partition"] for r in rows}:
        mine = [r for r in rows if r["partition"] == p]
        assert sorted(r["offset"] for r in mine) == list(range(len(mine)))
        told = [tuple(map(int, r["value"].removesuffix("\nline").split(":"))) for r in sorted(mine, key=lambda r: r["offset"])]
        assert told == sorted(told)
    assert sum(ends(segments(topic)).values()) == 150


def test_decoding(spark, tmp_path):
    """Fields in any order and unknown ones pass, scopes may be absent; what is no event is listed with the reason."""
    good = [
        {"event_type": "DocumentProcessed", "document_name": "A"}, {"scenario_id": None, "user_id": "u", "document_name": "A", "version": "2", "event_type": "updated", "more": {"x": [1]}},
        {"document_removed": False, "versions_removed": ["1", "2"], "document_name": "A", "event_type": "DocumentDeleted"}, {"document_removed": True, "versions_removed": [], "document_name": "A", "event_type": "deleted"},
    ]
    bad = {
        "no JSON": "{", "no object": "[1, 2]", "unknown kind": {"event_type": "DocumentMoved", "document_name": "A"}, "missing document_name": {"event_type": "processed", "document_name": None},
        "missing version": {"event_type": "updated", "document_name": "A"}, "missing versions_removed": {"event_type": "deleted", "document_name": "A", "document_removed": True},
        "document_name is no string": {"event_type": "processed", "document_name": 5}, "versions_removed is no array<string>": {"event_type": "deleted", "document_name": "A", "versions_removed": [1], "document_removed": True},
        "document_removed is no boolean": {"event_type": "deleted", "document_name": "A", "versions_removed": [], "document_removed": "yes"}, "user_id is no string": {"event_type": "processed", "document_name": "A", "user_id": [1]},
    }
    put(spark, f"{tmp_path}/topic", [("A", v) for v in good] + [("A", v) for v in bad.values()] + [("A", None)])
    rows = ev.decoded(log_table(spark, f"{tmp_path}/topic"))
    got = [tuple(r) for r in ev.accepted(rows).orderBy("offset").collect()]
    assert [g[:7] for g in got] == [("processed", "A", None, None, None, None, None), ("updated", "A", "2", None, None, "u", None), ("deleted", "A", None, ["1", "2"], False, None, None), ("deleted", "A", None, [], True, None, None)]
    assert [r["problem"] for r in ev.rejected(rows).orderBy("offset").collect()] == [*bad, "no JSON"]


def test_kafka_rows_are_decoded_alike(spark, monkeypatch):
    """A stand-in for the reader, as Spark's Kafka package is not here."""
    rows = spark.createDataFrame([(3, 7, bytearray(json.dumps(written("A")[1]), "utf8"), b"k")], "partition int, offset long, value binary, key binary")

    class Reader:
        def format(self, name):
            assert name == "kafka"
            return self

        def option(self, *_):
            return self

        def load(self):
            return rows

    class Session:
        readStream = Reader()

    got = ev.accepted(ev.read_kafka(Session(), "host:1", "document.events")).collect()
    assert [(r["event_type"], r["document_name"], r["partition"], r["offset"]) for r in got] == [("processed", "A", 3, 7)]


def test_state_goes_on_over_batches_and_restarts(spark, tmp_path):
    topic, checkpoint, passed = f"{tmp_path}/topic", f"{tmp_path}/checkpoint", []

    def follow():
        with keyed_state(spark):
            query = fresh(ev.accepted(ev.read_topic(spark, topic))).writeStream.foreachBatch(lambda df, batch: passed.extend((r["document_name"], r["offset"]) for r in df.collect()) or None)
            query = query.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        query.awaitTermination()
        return {(r["document_name"], r["user_id"]): (r["status"], r["n_events"]) for r in remembered(spark, checkpoint).collect()}

    put(spark, topic, [written("A"), written("B"), written("A", "2", "DocumentUpdated")])
    assert follow() == {("A", ""): ("updated", 2), ("B", ""): ("processed", 1)}
    put(spark, topic, [written("A"), ("A", {"event_type": "deleted", "document_name": "A", "versions_removed": [], "document_removed": True, "user_id": "u"})])
    assert follow() == {("A", ""): ("processed", 3), ("B", ""): ("processed", 1), ("A", "u"): ("deleted", 1)}
    assert len(passed) == 5 and "RocksDB" not in spark.conf.get("spark.sql.streaming.stateStore.providerClass", "")


def test_replays_are_left_out(spark, tmp_path):
    """A folder of JSON rows that hold offsets: the second batch brings old offsets again, and one new one."""
    source, passed = tmp_path / "in", []
    source.mkdir()

    def follow(name, offsets):
        (source / name).write_text("".join(json.dumps({"event_type": "processed", "document_name": "A", "partition": 0, "offset": o}) + "\n" for o in offsets))
        with keyed_state(spark):
            query = fresh(spark.readStream.schema(ev.EVENT).json(str(source))).writeStream.foreachBatch(lambda df, batch: passed.append(sorted(r["offset"] for r in df.collect())) or None)
            query = query.option("checkpointLocation", f"{tmp_path}/checkpoint").trigger(availableNow=True).start()
        query.awaitTermination()

    follow("1.json", [0, 1, 2])
    follow("2.json", [1, 2, 3])
    assert passed == [[0, 1, 2], [3]] and [r["n_events"] for r in remembered(spark, f"{tmp_path}/checkpoint").collect()] == [4]


def test_a_topic_drives_the_lifecycle(spark, tmp_path):
    """Two runs of one checkpoint: the second applies what came after the first, and lists what is no event."""
    topic, source = f"{tmp_path}/topic", [("a1", "D", "1", "h1"), ("a2", "D", "2", "h2"), ("e1", "E", "1", "h3")]
    sync = LifecycleSync(GraphStore(spark, f"{tmp_path}/store"), lambda: detail(spark, source), Models(hashing_embedder()), lambda: "2024-01-01 00:00:00")

    def follow():
        sync.start(ev.read_topic(spark, topic), f"{tmp_path}/checkpoint", f"{tmp_path}/rejects", availableNow=True).awaitTermination()
        return sorted(r["doc_id"] for r in sync.store.load().document.collect())

    put(spark, topic, [written("D"), written("E")])
    assert follow() == ["a1", "a2", "e1"] and sync.store.version() == 1
    assert follow() == ["a1", "a2", "e1"] and sync.store.version() == 1  # nothing new
    put(spark, topic, [("D", {"event_type": "DocumentDeleted", "document_name": "D", "versions_removed": ["1"], "document_removed": False}), ("D", "junk")])
    assert follow() == ["a2", "e1"] and sync.store.version() == 2
    assert [(r["value"], r["problem"]) for r in spark.read.parquet(f"{tmp_path}/rejects").collect()] == [("junk", "no JSON")]
    assert sync.store.load().restriction.count() == 2 and TEXT
