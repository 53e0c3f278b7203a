"""A topic of events kept in a folder, as a Spark data source: read as a table or as a stream, appended to as a table.

Under the topic's folder each partition has a folder and in it segments, files of one JSON string a line (null for an event without
a value). A segment's name tells its first offset and how many events it holds, so offsets are found by listing. Segments
are written aside, and only the commit of a write moves them into place; they are never changed.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, DataSourceWriter, InputPartition, WriterCommitMessage

FORMAT = "tessera_event_log"
RECORD = "partition int, offset long, value string"


def opened(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path or URI and the path in it."""
    if path.startswith("file:"):
        path = "/" + path.removeprefix("file:").lstrip("/")
    return pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)


@dataclass
class Segment(InputPartition):
    """A file of a partition: its first offset and number of events, and those of them to read."""

    path: str
    partition: int
    base: int
    count: int
    start: int = 0
    end: int = 0


def segments(path: str) -> list[Segment]:
    """All segments of a topic by partition and offset."""
    fs, root = opened(path)
    found = []
    for info in fs.get_file_info(pafs.FileSelector(root, recursive=True, allow_not_found=True)):
        folder, _, name = info.path.rpartition("/")
        if info.is_file and name.endswith(".jsonl") and "/partition=" in folder:
            base, _, count = name.removesuffix(".jsonl").partition("-")
            found.append(Segment(info.path, int(folder.rpartition("=")[2]), int(base), int(count)))
    return sorted(found, key=lambda s: (s.partition, s.base))


def ends(found: list[Segment]) -> dict[str, int]:
    """The offset after the last event of each partition."""
    out: dict[str, int] = {}
    for s in found:
        out[str(s.partition)] = max(out.get(str(s.partition), 0), s.base + s.count)
    return out


def read_segment(path: str, s: Segment) -> Iterator[tuple]:
    fs, _ = opened(path)
    with fs.open_input_stream(s.path) as file:
        left = b""
        at = s.base
        while chunk := file.read(1 << 20):
            *lines, left = (left + chunk).split(b"\n")
            for line in lines:
                if s.start <= at < s.end:
                    yield s.partition, at, json.loads(line)
                at += 1


class TableReader(DataSourceReader):
    def __init__(self, path: str) -> None:
        self.path = path

    def partitions(self) -> list[Segment]:
        return [Segment(s.path, s.partition, s.base, s.count, s.base, s.base + s.count) for s in segments(self.path)] or [Segment("", 0, 0, 0)]

    def read(self, partition: Segment) -> Iterator[tuple]:
        yield from read_segment(self.path, partition) if partition.count else ()


class StreamReader(DataSourceStreamReader):
    """Offsets are the ends of all partitions, so that new partitions may turn up; a task reads what a batch wants of one segment."""

    def __init__(self, path: str) -> None:
        self.path = path

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        return ends(segments(self.path))

    def partitions(self, start: dict, end: dict) -> list[Segment]:
        out = []
        for s in segments(self.path):
            low, high = max(s.base, start.get(str(s.partition), 0)), min(s.base + s.count, end.get(str(s.partition), 0))
            if low < high:
                out.append(Segment(s.path, s.partition, s.base, s.count, low, high))
        return out

    def read(self, partition: Segment) -> Iterator[tuple]:
        yield from read_segment(self.path, partition)


@dataclass
class Written(WriterCommitMessage):
    files: list[tuple[int, str, int]]


class Appender(DataSourceWriter):
    """Tasks write segments aside; the commit gives them their offsets, in the order of tasks, and moves them into place. One writer at a time."""

    def __init__(self, path: str) -> None:
        self.path, self.turn = path, uuid.uuid4().hex

    def write(self, iterator: Iterator) -> Written:
        fs, root = opened(self.path)
        aside = f"{root}/_aside/{self.turn}"
        fs.create_dir(aside, recursive=True)
        open_: dict[int, list] = {}
        for row in iterator:
            if row["partition"] not in open_:
                name = f"{aside}/{row['partition']}-{uuid.uuid4().hex}"
                open_[row["partition"]] = [name, fs.open_output_stream(name), 0]
            held = open_[row["partition"]]
            held[1].write(json.dumps(row["value"]).encode() + b"\n")
            held[2] += 1
        for held in open_.values():
            held[1].close()
        return Written([(p, name, n) for p, (name, _, n) in open_.items()])

    def commit(self, messages: list) -> None:
        fs, root = opened(self.path)
        at = ends(segments(self.path))
        for partition, name, count in (f for m in messages if m for f in m.files):
            base = at.get(str(partition), 0)
            fs.create_dir(f"{root}/partition={partition}", recursive=True)
            fs.move(name, f"{root}/partition={partition}/{base:020d}-{count}.jsonl")
            at[str(partition)] = base + count

    def abort(self, messages: list) -> None:
        """What was written aside is never read."""


class EventLog(DataSource):
    """Option path: the topic's folder, in any file system that pyarrow opens."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return RECORD

    def reader(self, schema) -> DataSourceReader:
        return TableReader(self.options["path"])

    def streamReader(self, schema) -> DataSourceStreamReader:
        return StreamReader(self.options["path"])

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return Appender(self.options["path"])


def append_events(values: DataFrame, path: str, key: Column, *order: Column | str, partitions: int = 8) -> None:
    """Append a table (value string, ...) to a topic: values of one key go to one partition, in the given order."""
    values.sparkSession.dataSource.register(EventLog)
    dealt = values.withColumn("partition", F.pmod(F.xxhash64(key), F.lit(partitions)).cast("int"))
    dealt = dealt.repartition(partitions, "partition").sortWithinPartitions("partition", *order)
    dealt.select("partition", F.lit(None).cast("long").alias("offset"), "value").write.format(FORMAT).mode("append").option("path", path).save()


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """A stream of (partition, offset, value) of a topic, from its first event on."""
    spark.dataSource.register(EventLog)
    return spark.readStream.format(FORMAT).option("path", path).load()


def log_table(spark: SparkSession, path: str) -> DataFrame:
    """All events of a topic as a table."""
    spark.dataSource.register(EventLog)
    return spark.read.format(FORMAT).option("path", path).load()
