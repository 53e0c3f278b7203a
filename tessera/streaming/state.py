"""What a stream remembers of each document: its last event, and by its place which events are replays."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from .events import EVENT

SCOPE = ["document_name", "user_id", "scenario_id"]
#: A document's last event: where it stood, what it was, and how many there were.
REMEMBERED = "partition int, offset long, status string, n_events long"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_FIELDS = [c.split(" ", 1)[0] for c in EVENT.split(", ")]


@contextmanager
def keyed_state(spark: SparkSession):
    """Queries that are started inside keep their state in RocksDB, which transformWithState asks for; the session's setting comes back."""
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_PROVIDER)
        else:
            spark.conf.set(_PROVIDER, before)


class Documents(StatefulProcessor):
    """Lets an event through once. A document's events are in one partition, so one that stands no further than the last event of an earlier
    batch is a replay. Rows of a batch are taken one by one and none is held; events without an offset always pass."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.document = handle.getValueState("document", REMEMBERED)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        known = self.document.get()
        seen = (known[0], known[1]) if known and known[1] is not None else None
        last, n = ((seen, known[2]), known[3]) if known else ((None, None), 0)
        for row in rows:
            place = None if row["offset"] is None else (row["partition"] or 0, row["offset"])
            if seen and place and place <= seen:
                continue
            n += 1
            if last[0] is None or place is None or place > last[0]:
                last = (place, row["event_type"])
            yield Row(**{f: row[f] for f in _FIELDS})
        place, status = last
        self.document.update((place[0] if place else None, place[1] if place else None, status, n))

    def close(self) -> None:
        pass


def fresh(events: DataFrame) -> DataFrame:
    """A stream of events (EVENT) without replays; remembers each document (name, user, scenario; an absent scope is a scope)."""
    keys = {f"_{c}": F.coalesce(c, F.lit("")) for c in SCOPE}
    return events.withColumns(keys).groupBy(*keys).transformWithState(statefulProcessor=Documents(), outputStructType=EVENT, outputMode="Append", timeMode="None")


def remembered(spark: SparkSession, checkpoint: str) -> DataFrame:
    """(document_name, user_id, scenario_id, partition, offset, status, n_events) as the last finished batch of a checkpoint left them; an
    absent scope is empty."""
    state = spark.read.format("statestore").option("path", checkpoint).option("stateVarName", "document").load()
    return state.select(*(F.col(f"key._{c}").alias(c) for c in SCOPE), "value.*")
