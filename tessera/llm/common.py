"""Shared helpers: tables staged in the cluster's shared folder, size-checked broadcasts, connected components."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A table of at most this many rows of a few numbers each, or array elements, is broadcast: under 100 MB as a hash table, as measured.
BROADCAST_ROWS = 1_000_000


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; one of our own only where the session names none and runs on one machine."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("on a cluster spark.checkpoint.dir must name a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="tessera-")
        spark.conf.set("spark.tessera.staging.dir", root)
        spark.sparkContext.setCheckpointDir(root)
        root = spark.sparkContext.getCheckpointDir()
    return root.rstrip("/")


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write df as a table in the shared folder and read it back: the lineage ends there, and a lost executor costs nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tessera/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_staged(*tables: DataFrame) -> None:
    """Delete staged tables that nothing reads any more."""
    for df in tables:
        spark = df.sparkSession
        for file in df.inputFiles()[:1]:
            path = spark._jvm.org.apache.hadoop.fs.Path(file.rsplit("/", 1)[0])
            if "/tessera/" in file:
                path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def small(df: DataFrame, rows: int, most: int | None = None) -> DataFrame:
    """Broadcast a staged table whose counted rows are few (most, or BROADCAST_ROWS); beyond that Spark joins it by a shuffle."""
    return F.broadcast(df) if rows <= (BROADCAST_ROWS if most is None else most) else df


def cells(df: DataFrame, *arrays: str) -> int:
    """Rows of a staged table and the elements of its arrays: what its size as a broadcast goes by."""
    return df.agg(F.sum(sum((F.coalesce(F.size(c), F.lit(0)) for c in arrays), F.lit(1)))).first()[0] or 0


#: Bytes of an Arrow batch where the session leaves Spark's default (64 MB): rows and what Python makes of them stay small, long texts or not.
BATCH_BYTES = "4m"
_BATCH_KEY, _BATCH_DEFAULT = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b"


def release() -> None:
    """Give back to the machine what was freed: Python workers live on from task to task, beside each other and the JVM."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def map_batches(df: DataFrame, run, schema: str) -> DataFrame:
    """df.mapInArrow(run, schema) over batches of a few MB; a bound that the session sets itself is kept."""
    conf = df.sparkSession.conf
    if conf.get(_BATCH_KEY) == _BATCH_DEFAULT:
        conf.set(_BATCH_KEY, BATCH_BYTES)

    def trimmed(batches):
        for batch in batches:
            yield batch
            release()

    def bounded(batches):
        yield from run(trimmed(batches))
        release()

    return df.mapInArrow(bounded, schema)


def slices(batches, rows: int = 256):
    """Arrow batches in slices of few rows, so that what a task makes of them stays small."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def words_pattern() -> str:
    return r"[^\x20\x09-\x0D]+"


def union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def rank_rows(df: DataFrame, *order: Column, name: str = "rank") -> DataFrame:
    """Rows numbered from 0 by a total order without a single-task window: a range partitioning, staged, then offsets of its partitions."""
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    from pyspark.sql import Window as W

    parts = stage(df.repartitionByRange(n, *order).withColumn("_part", F.spark_partition_id()), "ranked")
    counts = parts.groupBy("_part").agg(F.count("*").alias("_n"))
    offsets = counts.withColumn("_before", F.coalesce(F.sum("_n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("_n")  # a row for each partition
    within = F.row_number().over(W.partitionBy("_part").orderBy(*order))
    return parts.withColumn("_row", within).join(F.broadcast(offsets), "_part").withColumn(name, F.col("_row") + F.col("_before") - 1).drop("_part", "_row", "_before")


#: Rounds of contraction. Those by hash leave about two thirds of the nodes of a path, so 100 are enough for any table.
ROUNDS = 100
#: Edges that a task holds to join them; more are joined in parts.
HELD_EDGES = 500_000


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (least node of a component, other node of it) that join the same nodes as the edges (a, b) do."""
    ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    root = np.arange(len(ids))
    while True:
        x, y = root[x], root[y]
        apart = x != y
        if not apart.any():
            break
        x, y = x[apart], y[apart]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))  # only roots hook, each to a smaller one
        while not np.array_equal(up := root[root], root):
            root = up
    own = np.flatnonzero(root != np.arange(len(ids)))
    return ids[root[own]], ids[own]


def stars(edges: DataFrame) -> DataFrame:
    """Edges (a, b) without nulls and loops, those of each task replaced by stars that join the same nodes: never more than there
    were, and at most one for each node of a task. No shuffle."""

    def run(batches):
        parts, held, kind = [], 0, None
        for batch in batches:
            kind = batch.schema
            batch = batch.drop_null()
            parts.append([c.to_numpy() for c in batch.columns])
            held += batch.num_rows
            if held > HELD_EDGES:
                yield joined(parts, kind)
                parts, held = [], 0
        if held:
            yield joined(parts, kind)

    def joined(parts, kind):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(forest(*(np.concatenate(c) for c in zip(*parts))), kind.types)], ["a", "b"])

    kinds = dict(edges.dtypes)
    return map_batches(edges.select("a", "b"), run, f"a {kinds['a']}, b {kinds['b']}")


def components(edges: DataFrame) -> DataFrame:
    """(node, component_id) of every node in edges (a, b), which are integers: the smallest node that links reach.

    Each task joins its own edges to stars first. Each round a node joins its least neighbour, by id in even rounds (a star ends at
    once) and by a salted hash in odd ones (a long path halves), and the edges are contracted. Minima come from aggregations,
    never from one group's list. Null ends and loops are left out; an empty input gives an empty table. Links that are left
    after ROUNDS rounds raise an error.
    """
    e = stage(stars(edges), "edges")
    labels = None
    for turn in range(ROUNDS):
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        key = (lambda c: F.col(c)) if turn % 2 == 0 else (lambda c, turn=turn: F.xxhash64(F.lit(turn), F.col(c)))
        best = both.groupBy("a").agg(F.min(F.struct(key("b").alias("k"), F.col("b").alias("to"))).alias("m"))
        to = stage(best.select(F.col("a").alias("node"), F.least(F.col("m"), F.struct(key("a").alias("k"), F.col("a").alias("to")))["to"].alias("to")), "hooks")
        if labels is None:
            new = to.select("node", F.col("to").alias("label"))
        else:
            hop = to.select(F.col("node").alias("label"), "to")
            new = labels.join(hop, "label", "left").select("node", F.coalesce("to", "label").alias("label"))
        a, b = to.select(F.col("node").alias("a"), F.col("to").alias("ta")), to.select(F.col("node").alias("b"), F.col("to").alias("tb"))
        new = stage(new, "labels")
        left = stage(e.join(a, "a").join(b, "b").where("ta <> tb").select(F.col("ta").alias("a"), F.col("tb").alias("b")), "left")
        done = left.isEmpty()
        contracted = left if done else stage(stars(left), "edges")
        drop_staged(e, to, *([left] if not done else []), *([labels] if labels is not None else []))
        e, labels = contracted, new
        if done:
            break
    else:
        raise RuntimeError(f"components are not joined after {ROUNDS} rounds")
    roots = labels.groupBy("label").agg(F.min("node").alias("component_id"))
    return labels.join(roots, "label").select("node", "component_id")
