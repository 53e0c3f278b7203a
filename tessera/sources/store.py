"""A graph as Parquet tables in versions. A version counts once its mark is there, so readers see all of it or none."""

from __future__ import annotations

import json
import re
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import KEYS, SCHEMAS, Graph, conform, empty_graph


def scratch_dir(spark: SparkSession) -> str:
    """The cluster's shared folder of spark.checkpoint.dir; one of our own only where none is set."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("on a cluster spark.checkpoint.dir must name a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="tessera-"))
        root = spark.sparkContext.getCheckpointDir()
    return root.rstrip("/")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """df written as a table in the shared folder: loops over it neither recompute it nor grow its lineage."""
    path = f"{scratch_dir(df.sparkSession)}/tessera/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows that a join may broadcast; of more it shuffles.
FEW = 1_000_000


def counted(df: DataFrame, name: str, few: int = FEW) -> tuple[DataFrame, int]:
    """df written as a table and its number of rows; up to few of them are broadcast where they are joined, whatever the other side."""
    df = materialize(df, name)
    n = df.count()
    return (F.broadcast(df) if n <= few else df), n


#: Keys, and whole rows, that changes to a graph broadcast: a hash table of either takes under 100 MB, vectors of 2,048 numbers included.
FEW_KEYS, FEW_ROWS = 100_000, 10_000


def few_keys(df: DataFrame, name: str) -> DataFrame:
    """A table of keys, written once and broadcast if they are few."""
    return counted(df, name, FEW_KEYS)[0]


def few_rows(df: DataFrame) -> bool:
    """Whether a written table's rows are few enough to be broadcast as they are."""
    return df.count() <= FEW_ROWS


@contextmanager
def measured_broadcasts(spark: SparkSession):
    """Joins run inside broadcast what was counted, or what a shuffle has measured. Spark else goes by the size of files, where ids in a row and
    repeated texts and vectors take a hundredth of what they take as a hash table. The session's settings come back."""
    by_files, measured = "spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"
    before = {k: spark.conf.get(k, None) for k in (by_files, measured)}
    spark.conf.set(measured, before[measured] or spark.conf.get(by_files))
    spark.conf.set(by_files, "-1")
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


#: Rows of a bucket of a table, up to twice as many.
BUCKET_ROWS = 200_000


def _bucket(table: str, n: int) -> Column:
    """The bucket of a row among n: by the hash of the first column of the table's key."""
    return F.pmod(F.xxhash64(KEYS[table][0]), F.lit(n)).cast("int")


class GraphStore:
    """Versions of a graph under root, which may be in any file system that Spark writes to.

    A table lies in buckets by the hash of its first key; their number follows its rows, so that a bucket stays of one size. Publishing
    compares each bucket's digest with that of the current version and writes the changed ones, to a folder of a name of its own. The
    mark of a version names the folder of every bucket.
    """

    def __init__(self, spark: SparkSession, root: str, bucket_rows: int = BUCKET_ROWS) -> None:
        self.spark, self.root, self.bucket_rows = spark, root.rstrip("/"), bucket_rows

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def _committed(self) -> dict[int, str]:
        fs, p = self._fs(f"{self.root}/versions/*.json")
        found = fs.globStatus(p) or []
        return {int(f.getPath().getName().removesuffix(".json")): f.getPath().toString() for f in found}

    def version(self) -> int:
        """The current version: the highest committed one, 0 before the first."""
        return max(self._committed(), default=0)

    def mark(self, version: int | None = None) -> dict:
        """What a version (the current one) holds: for each table its number of buckets and the folder, digest and rows of each."""
        marks = self._committed()
        if not marks:
            return {}
        return json.loads("".join(r[0] for r in self.spark.read.text(marks[max(marks) if version is None else version]).collect()))

    def load(self, version: int | None = None) -> Graph:
        mark = self.mark(version)
        if not mark:
            return empty_graph(self.spark)
        return Graph(**{t: self._table(mark["tables"][t], s) for t, s in SCHEMAS.items()})

    def _table(self, held: dict, schema: str) -> DataFrame:
        empty = self.spark.createDataFrame([], schema)
        folders = [f"{self.root}/{part['folder']}/bucket={b}" for b, part in held["parts"].items()]
        return self.spark.read.schema(empty.schema).parquet(*folders) if folders else empty

    def outcomes(self, version: int | None = None) -> DataFrame | None:
        """What became of each document that the batch of a version named; None if it says nothing."""
        folder = self.mark(version).get("outcomes")
        return self.spark.read.parquet(f"{self.root}/{folder}") if folder else None

    def _digests(self, df: DataFrame, table: str, n: int) -> dict[str, list]:
        """For each bucket that has rows a digest of them in any order, and their number: one short row a bucket for the driver."""
        rows = df.select(_bucket(table, n).alias("b"), F.xxhash64(*df.columns).alias("h"))
        sums = rows.groupBy("b").agg(F.bit_xor("h").alias("x"), F.sum(F.col("h").bitwiseAND(F.lit(2**31 - 1))).alias("s"), F.count("*").alias("n"))
        return {str(r["b"]): [f"{r['x']}:{r['s']}:{r['n']}", r["n"]] for r in sums.collect()}

    def _written(self, df: DataFrame, name: str, held: dict | None) -> dict:
        n = held["buckets"] if held else 1
        found = self._digests(df, name, n)
        rows = sum(k for _, k in found.values())
        if rows > 2 * self.bucket_rows * n:  # the table has outgrown its buckets: it is dealt anew, which happens each time it doubles
            n, held = 1 << (-(-rows // self.bucket_rows) - 1).bit_length(), None
            found = self._digests(df, name, n)
        old = held["parts"] if held else {}
        parts = {b: old[b] if b in old and old[b]["digest"] == digest else {"digest": digest, "rows": k} for b, (digest, k) in found.items()}
        changed = [b for b, part in parts.items() if "folder" not in part]
        if changed:
            folder = f"{name}/{uuid.uuid4().hex}"
            out = df.withColumn("bucket", _bucket(name, n))
            out = out if len(changed) == len(parts) else out.where(F.col("bucket").isin([int(b) for b in changed]))
            out.repartition(len(changed), "bucket").write.partitionBy("bucket").parquet(f"{self.root}/{folder}")
            for b in changed:
                parts[b]["folder"] = folder
        return {"buckets": n, "parts": parts}

    def publish(self, graph: Graph, base: Graph | None = None, outcomes: DataFrame | None = None, once: bool = False) -> int:
        """Make graph the next version; tables that are still those of base, the graph that load() gave, aren't looked at. once says that a large
        batch changed the others, each of which is derived once, to a table of its own that digests and buckets are then read from. The mark is made
        last and never changed: a writer that fails before it leaves the current version as it was, and of two writers of one version the
        later raises an error and has changed nothing."""
        v, mark = self.version() + 1, self.mark()
        tables = mark.get("tables", {})
        new = {}
        for name, df in graph.tables().items():
            same = base is not None and name in tables and df is base.tables()[name]
            if not same:
                df = conform(df, name)
                df = materialize(df, name) if once else df
            new[name] = tables[name] if same else self._written(df, name, tables.get(name))
        said = {"tables": new}
        if outcomes is not None:
            said["outcomes"] = f"outcomes/{uuid.uuid4().hex}"
            outcomes.write.parquet(f"{self.root}/{said['outcomes']}")
        fs, path = self._fs(f"{self.root}/versions/{v}.json")
        if fs.exists(path):
            raise RuntimeError(f"another writer has made version {v}")
        fs.mkdirs(path.getParent())
        out = fs.create(path, False)
        out.write(bytearray(json.dumps(said).encode()))
        out.close()
        return v

    def vacuum(self, keep: int = 2) -> int:
        """Delete the folders that none of the last versions names, and the marks of the others; how many went. No writer may be at work."""
        marks = self._committed()
        last = sorted(marks)[-keep:]
        named = set()
        for v in last:
            mark = self.mark(v)
            named |= {p["folder"] for t in mark["tables"].values() for p in t["parts"].values()} | {mark.get("outcomes")}
        gone = [m for v, m in marks.items() if v not in last]
        for name in (*SCHEMAS, "outcomes"):
            fs, p = self._fs(f"{self.root}/{name}/*")
            gone += [f.getPath().toString() for f in fs.globStatus(p) or [] if f"{name}/{f.getPath().getName()}" not in named]
        for path in gone:
            fs, p = self._fs(path)
            fs.delete(p, True)
        return len(gone)
