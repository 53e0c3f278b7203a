"""Dense vectors: cosine as an expression, and exact nearest rows by blocks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Rows of a block on either side of a nearest join: what a task holds.
PROBES, BASE = 1024, 8192


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine in double precision; null for vectors of different lengths or without a direction."""
    norm = F.sqrt(dot(a, a) * dot(b, b))
    return F.when((F.size(a) == F.size(b)) & (norm > 0), dot(a, b) / norm)


def to_query(vector: list[float]) -> Column:
    return F.array(*(F.lit(float(x)) for x in vector))


def unit_interval(score: Column) -> Column:
    """Cosine as some vector indexes report it, from 0 to 1."""
    return (1 + score) / 2


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    flat = pa.concat_arrays([c.flatten() for c in column.chunks]).to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def nearest(probes: DataFrame, base: DataFrame, k: int = 1, least: float | None = None) -> DataFrame:
    """(probe, match, score): for each (probe, vector) row the k rows of base (match, vector) of highest cosine, ties to the smaller
    match, none under least. Exact: each block of probes meets each block of base in a task as one matrix product."""
    p = probes.where("probe is not null and vector is not null").withColumn("dim", F.size("vector"))
    b = base.where("match is not null and vector is not null").withColumn("dim", F.size("vector"))
    n_p, n_b = max(1, -(-p.count() // PROBES)), max(1, -(-b.count() // BASE))
    both = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = p.select("probe", "vector", "dim", F.pmod(F.xxhash64("probe"), F.lit(n_p)).alias("i"), both(n_b).alias("j"))
    right = b.select("match", "vector", "dim", F.pmod(F.xxhash64("match"), F.lit(n_b)).alias("j"), both(n_p).alias("i"))
    left, right = left.withColumns({c: F.col(c).cast("long") for c in "ij"}), right.withColumns({c: F.col(c).cast("long") for c in "ij"})
    kinds = {"probe": dict(probes.dtypes)["probe"], "match": dict(base.dtypes)["match"]}

    def best(some: pa.Table, all_: pa.Table) -> pa.Table:
        out: tuple[list, list, list] = ([], [], [])
        if some.num_rows and all_.num_rows:
            all_ = all_.sort_by("match")
            x, y = _matrix(some.column("vector")), _matrix(all_.column("vector"))
            norms = np.sqrt((x * x).sum(1))[:, None] * np.sqrt((y * y).sum(1))[None, :]
            with np.errstate(invalid="ignore", divide="ignore"):
                score = np.where(norms > 0, (x @ y.T) / norms, -np.inf)
            few = np.argsort(-score, axis=1, kind="stable")[:, :k]
            for r, cols in enumerate(few):
                cols = [c for c in cols.tolist() if score[r, c] > -np.inf and (least is None or score[r, c] >= least)]
                out[0].extend([r] * len(cols))
                out[1].extend(cols)
                out[2].extend(score[r, cols].tolist())
        return pa.table({"probe": some.column("probe").take(pa.array(out[0], pa.int64())), "match": all_.column("match").take(pa.array(out[1], pa.int64())), "score": pa.array(out[2], pa.float64())})

    keys = ["i", "j", "dim"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(best, f"probe {kinds['probe']}, match {kinds['match']}, score double")
    order = W.partitionBy("probe").orderBy(F.desc("score"), "match")
    return found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k).drop("place")


#: Rows that are held against others at a time.
STEP = 512


def by_length(column: pa.ChunkedArray | pa.Array) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """For each length of the vectors that are there: their places in the column, and them as rows of a matrix."""
    column = column if isinstance(column, pa.ChunkedArray) else pa.chunked_array([column])
    lengths = pc.fill_null(pc.list_value_length(column), 0).to_numpy()
    at = {int(n): np.flatnonzero(lengths == n) for n in np.unique(lengths) if n}
    return {n: (rows, _matrix(column.take(pa.array(rows)))) for n, rows in at.items()}


def _near(x: np.ndarray, y: np.ndarray, least: float) -> np.ndarray:
    norms = np.sqrt((x * x).sum(1))[:, None] * np.sqrt((y * y).sum(1))[None, :]
    with np.errstate(invalid="ignore", divide="ignore"):
        return (x @ y.T) / norms >= least


def near_to(column: pa.ChunkedArray | pa.Array, known: dict[int, tuple[np.ndarray, np.ndarray]], least: float) -> np.ndarray:
    """Which vectors of a column have a cosine of least or more with one that is known (by_length())."""
    out = np.zeros(len(column), bool)
    for n, (rows, x) in by_length(column).items():
        for i in range(0, len(rows) if n in known else 0, STEP):
            out[rows[i : i + STEP]] = _near(x[i : i + STEP], known[n][1], least).any(1)
    return out


def leading(column: pa.ChunkedArray, least: float) -> np.ndarray:
    """Which vectors of a column, read in order, have a cosine of least or more with no earlier one of these. One that is not there has none."""
    out = np.ones(len(column), bool)
    for rows, x in by_length(column).values():
        lead: list[int] = []
        for i in range(0, len(rows), STEP):
            some = x[i : i + STEP]
            near, covered = _near(some, some, least), _near(some, x[lead], least).any(1)
            for k in range(len(some)):
                if not covered[k]:
                    lead.append(i + k)
                    covered[k + 1 :] |= near[k, k + 1 :]
        out[rows] = np.isin(np.arange(len(rows)), lead)
    return out


def near_pairs(rows: DataFrame, least: float) -> DataFrame:
    """(a, b, score), a < b, of all rows (key, vector) with a cosine of least or more; by blocks, as nearest()."""
    r = rows.where("key is not null and vector is not null").withColumn("dim", F.size("vector"))
    n = max(1, -(-r.count() // PROBES))
    r = r.withColumn("block", F.pmod(F.xxhash64("key"), F.lit(n)).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    dealt = r.select("key", "vector", "dim", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
    kind = dict(rows.dtypes)["key"]

    def pairs(group: pa.Table) -> pa.Table:
        i, j = group.column("i")[0].as_py(), group.column("j")[0].as_py()
        v, block, keys = _matrix(group.column("vector")), group.column("block").to_numpy(), group.column("key")
        left, right = np.flatnonzero(block == i), np.flatnonzero(block == j)
        norm = np.sqrt((v * v).sum(1))
        with np.errstate(invalid="ignore", divide="ignore"):
            score = (v[left] @ v[right].T) / (norm[left, None] * norm[None, right])
        x, y = np.nonzero(score >= least)
        s = score[x, y]
        return pa.table({"a": keys.take(pa.array(left[x])), "b": keys.take(pa.array(right[y])), "score": pa.array(s)})

    found = dealt.groupBy("dim", "i", "j").applyInArrow(pairs, f"a {kind}, b {kind}, score double")
    ordered = found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "score").where("a < b")
    return ordered.groupBy("a", "b").agg(F.max("score").alias("score"))
