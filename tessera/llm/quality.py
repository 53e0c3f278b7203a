"""Quality classifier: random Fourier features of document statistics, ridge by summed normal equations, isotonic calibration."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_batches, slices, small, stage

#: Raw scores are calibrated in this many bins between LOW and HIGH.
BINS, LOW, HIGH = 1000, -0.5, 1.5
# Characters whose shares are statistics of their own.
MARKS = [b"!", b"*#$%&", b"|", b".,;:", b"?", b"@_<>{}[]()/\\=+~^`", b"\n", b"-'\""]
_CLASSES = np.zeros((256, len(MARKS) + 5), np.float64)
for _k, _chars in enumerate(MARKS):
    _CLASSES[list(_chars), _k] = 1
_CLASSES[65:91, -5] = _CLASSES[97:123, -4] = _CLASSES[48:58, -3] = _CLASSES[128:, -2] = 1
_CLASSES[[32, *range(9, 14)], -1] = 1


def statistics(text: str) -> list[float]:
    """Numbers that describe a whole text; all are finite for any text, the empty one too."""
    raw = text.encode("utf-8", "replace")
    share = np.bincount(np.frombuffer(raw, np.uint8), minlength=256) @ _CLASSES / max(1, len(raw))
    words, lines = text.split(), text.split("\n")
    n, letters = max(1, len(words)), max(1e-9, share[-5] + share[-4])
    different = set(words)
    return [
        *share, share[-5] / letters, np.log1p(len(raw)), np.log1p(len(words)), np.log1p(len(lines)), (len(raw) - len(lines)) / n,
        len(different) / n, len(set(lines)) / len(lines), np.log1p(len(raw) / len(lines)), sum(map(len, different)) / max(1, len(different)),
        np.log1p(len(different)),
    ]


N_STATISTICS = len(statistics(""))


@dataclass
class QualityModel:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    seed: int
    gamma: float
    knots: np.ndarray
    levels: np.ndarray

    def features(self, x: np.ndarray) -> np.ndarray:
        """Cosines of random projections; their products approximate a Gaussian kernel of the standardised statistics."""
        rng = np.random.default_rng(self.seed)
        d = len(self.weights) - 1
        w, b = rng.normal(0, np.sqrt(2 * self.gamma), (x.shape[1], d)), rng.uniform(0, 2 * np.pi, d)
        z = np.clip((x - self.mean) / self.scale, -6, 6)
        return np.concatenate([np.sqrt(2 / d) * np.cos(z @ w + b), np.ones((len(x), 1))], 1)

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.features(x) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        """Calibrated, from 0 to 1; a thousandth follows the raw score so that it still orders what calibration levels."""
        raw = self.raw(x)
        level = np.interp(raw, self.knots, self.levels)
        return np.clip(0.999 * level + 0.001 / (1 + np.exp(-np.clip(raw, -20, 20))), 0, 1)


def isotonic(n: np.ndarray, good: np.ndarray) -> np.ndarray:
    """Rising rates closest to good / n, by pooling adjacent violators."""
    blocks: list[list[float]] = []
    for a, b in zip(n, good):
        blocks.append([a, b, 1])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][0] >= blocks[-1][1] * blocks[-2][0]:
            a2, b2, k = blocks.pop()
            blocks[-1] = [blocks[-1][0] + a2, blocks[-1][1] + b2, blocks[-1][2] + k]
    return np.concatenate([np.full(k, b / a) for a, b, k in blocks]) if blocks else np.zeros(0)


def held_out() -> Column:
    """Rows that are never learned from: crc32 of doc_id as text is divisible by 5. A null doc_id is not held out and has no label."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))


def described(labelled: DataFrame) -> DataFrame:
    """(y, x, fold) of rows (y, text, fold)."""

    def run(batches):
        for batch in slices(batches):
            flat = np.array([statistics(t or "") for t in batch.column(1).to_pylist()])
            xs = pa.FixedSizeListArray.from_arrays(pa.array(flat.ravel()), N_STATISTICS).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), xs, batch.column(2)], ["y", "x", "fold"])

    return map_batches(labelled.select(F.col("y").cast("double"), "text", "fold"), run, "y double, x array<double>, fold int")


#: Rows that are learned from fall into this many parts by the remainder that holds rows out; each part is calibrated by the others' fit.
FOLDS = 4


def solved(sums: np.ndarray, ridge: float) -> np.ndarray:
    return np.linalg.solve(sums[:, :-1] + ridge * np.eye(len(sums)), sums[:, -1])


def fit_quality(docs: DataFrame, labels: DataFrame, features: int = 160, ridge: float = 1.0, seed: int = 5) -> QualityModel:
    """Learned from every labelled row that is not held out. Each partition sends its sums of products by fold, Spark adds them by
    cell; FOLDS * features**2 sums and BINS counts reach the driver, whatever the input. Levels are calibrated on raw scores of
    weights that did not see their row. Null labels, or labels of no document, teach nothing; without any label every score is 0.5."""
    y = labels.select("doc_id", F.col("quality").cast("double").alias("y")).where("y is not null and doc_id is not null")
    fold = (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 - 1).cast("int")
    train = docs.select("doc_id", "text").where(~held_out()).join(small(y, y.count()), "doc_id")
    rows = stage(described(train.select("y", "text", fold.alias("fold"))), "statistics")
    means = [F.avg(F.col("x")[k]) for k in range(N_STATISTICS)] + [F.stddev_pop(F.col("x")[k]) for k in range(N_STATISTICS)]
    got = np.array([v or 0.0 for v in rows.agg(*means).first()])
    model = QualityModel(got[:N_STATISTICS], np.maximum(got[N_STATISTICS:], 1e-6), np.zeros(features + 1), seed, 0.5 / N_STATISTICS, np.zeros(1), np.full(1, 0.5))

    def matrices(batches):
        for batch in batches:
            flat = batch.column(1).flatten().to_numpy(zero_copy_only=False)
            yield batch.column(0).to_numpy(zero_copy_only=False), flat.reshape(-1, N_STATISTICS), batch.column(2).to_numpy(zero_copy_only=False)

    def products(batches):
        total = np.zeros((FOLDS, features + 1, features + 2))
        for y, x, part in matrices(batches):
            z = model.features(x)
            z_y = np.concatenate([z, y[:, None]], 1)
            for f in np.unique(part).tolist():
                total[f] += z[part == f].T @ z_y[part == f]
        f, i, j = np.indices(total.shape).reshape(3, -1)
        yield pa.RecordBatch.from_arrays([pa.array(f, pa.int32()), pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(total.ravel())], ["f", "i", "j", "v"])

    sums = np.zeros((FOLDS, features + 1, features + 2))
    for f, i, j, v in map_batches(rows, products, "f int, i int, j int, v double").groupBy("f", "i", "j").agg(F.sum("v")).collect():
        sums[f, i, j] = v
    if not sums[:, -1, -2].sum():
        return model
    model.weights = solved(sums.sum(0), ridge)
    unseen = np.stack([solved(sums.sum(0) - sums[f], ridge) for f in range(FOLDS)])

    def binned(batches):
        for y, x, part in matrices(batches):
            raw = (model.features(x) * unseen[part]).sum(1)
            bins = np.clip(((raw - LOW) / (HIGH - LOW) * BINS).astype(np.int64), 0, BINS - 1)
            yield pa.RecordBatch.from_arrays([pa.array(bins), pa.array(y)], ["bin", "y"])

    counts = sorted(map_batches(rows, binned, "bin long, y double").groupBy("bin").agg(F.count("*"), F.sum("y")).collect())
    at, n, good = (np.array(c, float) for c in zip(*counts))
    model.knots, model.levels = LOW + (at + 0.5) * (HIGH - LOW) / BINS, isotonic(n, good)
    return model


def score_quality(docs: DataFrame, model: QualityModel, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keep and score (0 to 1) of every row's whole text; a null text is scored as an empty one."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    chosen = docs.select(*keep) if "text" in keep else docs.select(*keep, "text")
    at = chosen.columns.index("text")

    def run(batches):
        for batch in slices(batches):
            x = np.array([statistics(t or "") for t in batch.column(at).to_pylist()])
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(len(keep))), pa.array(sent.value.score(x))], [*keep, "score"])

    return map_batches(chosen, run, ", ".join(f"`{c}` {t}" for c, t in chosen.select(*keep).dtypes) + ", score double")


def predicted(threshold: float = 0.3) -> Column:
    return (F.col("score") >= threshold).cast("int")
