"""Lifecycle events as they arrive: JSON values of three kinds, decoded by field name, with a table of those that are none."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.event_log import read_log

EVENT = "event_type string, document_name string, version string, versions_removed array<string>, document_removed boolean, user_id string, scenario_id string, partition int, offset long"
#: Kinds of events by the names they come under, what each must have, and what each may have.
KINDS = {"DocumentProcessed": "processed", "DocumentUpdated": "updated", "DocumentDeleted": "deleted"}
REQUIRED = {"processed": ("document_name",), "updated": ("document_name", "version"), "deleted": ("document_name", "versions_removed", "document_removed")}
OPTIONAL = ("user_id", "scenario_id")
#: What a field's value is called in JSON, by its type.
JSON_TYPES = {"string": ("STRING",), "array<string>": ("ARRAY<STRING>", "ARRAY<VOID>"), "boolean": ("BOOLEAN",)}
_TYPES = dict(c.split(" ", 1) for c in EVENT.split(", "))


def decoded(raw: DataFrame) -> DataFrame:
    """The columns of EVENT, value and problem of raw events (partition, offset, value).

    Fields are found by name, in any order; unknown ones are ignored and a scope may be missing or null. problem is null for an event, else
    says what is wrong: no JSON, no object, another kind, a missing field or one of another type. Nothing is dropped here.
    """
    v = F.try_parse_json("value")
    kind_of = lambda c: F.schema_of_variant(c)
    rows = raw.withColumn("_v", v).withColumn("_shape", kind_of(F.col("_v")))
    rows = rows.withColumn("_is_object", F.coalesce(F.col("_shape").startswith("OBJECT"), F.lit(False)))
    part = lambda name: F.when(F.col("_is_object"), F.try_variant_get("_v", f"$.{name}", "variant"))
    fields = [c for c in _TYPES if c not in ("event_type", "partition", "offset")]
    told = F.when(kind_of(part("event_type")) == "STRING", F.try_variant_get(part("event_type"), "$", "string"))
    kind = reduce(lambda out, k: F.when(told.isin(k, KINDS[k]), KINDS[k]).otherwise(out), KINDS, F.lit(None).cast("string"))
    rows = rows.withColumn("event_type", kind).withColumns({f"_{f}": kind_of(part(f)) for f in fields})
    absent = lambda f: F.coalesce(F.col(f"_{f}"), F.lit("VOID")) == "VOID"
    typed = lambda f: F.col(f"_{f}").isin(*JSON_TYPES[_TYPES[f]])

    def checked(field: str, required: bool) -> Column:
        other = F.when(~absent(field) & ~typed(field), F.lit(f"{field} is no {_TYPES[field]}"))
        return F.when(absent(field), F.lit(f"missing {field}")).otherwise(other) if required else other

    of_kind = [F.when(F.col("event_type") == k, F.coalesce(*(checked(f, f in REQUIRED[k]) for f in (*REQUIRED[k], *OPTIONAL)))) for k in REQUIRED]
    problem = F.coalesce(
        F.when(F.col("_v").isNull(), F.lit("no JSON")), F.when(~F.col("_is_object"), F.lit("no object")), F.when(F.col("event_type").isNull(), F.lit("unknown kind")), *of_kind
    )
    values = [F.when(typed(f), F.try_variant_get("_v", f"$.{f}", _TYPES[f])).alias(f) for f in fields]
    return rows.select("event_type", *values, "partition", "offset", "value", problem.alias("problem"))


def accepted(events: DataFrame) -> DataFrame:
    """The events of decoded() rows, with exactly the columns of EVENT."""
    return events.where("problem is null").select(*_TYPES)


def rejected(events: DataFrame) -> DataFrame:
    """(partition, offset, value, problem) of decoded() rows that are no event."""
    return events.where("problem is not null").select("partition", "offset", "value", "problem")


def read_topic(spark: SparkSession, path: str) -> DataFrame:
    """The decoded stream of a topic kept in a folder (sources.event_log)."""
    return decoded(read_log(spark, path))


def read_kafka(spark: SparkSession, servers: str, topic: str) -> DataFrame:
    """The decoded stream of a Kafka topic of JSON values, from its earliest event on the first run; needs Spark's Kafka package."""
    raw = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic).option("startingOffsets", "earliest").load()
    return decoded(raw.select("partition", "offset", F.col("value").cast("string").alias("value")))


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """A decoded stream of JSON lines in files. Such events have no offsets: they are ordered by a batch only, and replays aren't known."""
    raw = spark.readStream.text(path)
    return decoded(raw.select(F.lit(None).cast("int").alias("partition"), F.lit(None).cast("long").alias("offset"), "value"))
