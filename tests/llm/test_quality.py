from __future__ import annotations

import zlib

import numpy as np
from hypothesis import given
from hypothesis import strategies as st

from tessera.llm.quality import fit_quality, held_out, isotonic, predicted, score_quality, statistics

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    rows = score_quality(docs, fit_quality(docs, labels)).withColumns({"held": held_out(), "predicted": predicted()}).join(labels, "doc_id").collect()
    assert all(r["held"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and 0 <= r["score"] <= 1 for r in rows)
    held = [r for r in rows if r["held"]]
    good, bad = [r["score"] for r in held if r["quality"]], [r["score"] for r in held if not r["quality"]]
    assert np.mean([[g > b for b in bad] for g in good]) > 0.95
    assert np.mean([r["predicted"] == r["quality"] for r in held]) > 0.9


@given(st.lists(st.tuples(st.integers(1, 9), st.floats(0, 1)), min_size=1, max_size=12))
def test_isotonic_rises_and_keeps_the_mean(pairs):
    n, good = np.array([p[0] for p in pairs], float), np.array([p[0] * p[1] for p in pairs])
    fit = isotonic(n, good)
    assert (np.diff(fit) >= -1e-9).all() and abs((fit * n).sum() - good.sum()) < 1e-6


def test_the_fit_equals_one_over_whole_matrices(spark):
    """Brute force: features of all rows at once, normal equations and levels in NumPy, over one table of a hundred documents or so."""
    docs, labels = spark.read.parquet("/root/testdata/sf0.001/documents.parquet"), spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    model = fit_quality(docs, labels, features=40)
    rows = [r for r in docs.join(labels, "doc_id").collect() if r["quality"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5]
    fold = np.array([zlib.crc32(str(r["doc_id"]).encode()) % 5 - 1 for r in rows])
    x, y = np.array([statistics(r["text"] or "") for r in rows]), np.array([float(r["quality"]) for r in rows])
    assert np.allclose(model.mean, x.mean(0)) and np.allclose(model.scale, np.maximum(x.std(0), 1e-6), atol=1e-7)
    z = np.clip((x - x.mean(0)) / np.maximum(x.std(0), 1e-6), -6, 6)
    rng = np.random.default_rng(5)
    w, b = rng.normal(0, np.sqrt(1 / x.shape[1]), (x.shape[1], 40)), rng.uniform(0, 2 * np.pi, 40)
    phi = np.concatenate([np.sqrt(2 / 40) * np.cos(z @ w + b), np.ones((len(x), 1))], 1)
    ridge = lambda rows: np.linalg.solve(phi[rows].T @ phi[rows] + np.eye(41), phi[rows].T @ y[rows])
    assert np.allclose(model.weights, ridge(np.ones(len(y), bool)), atol=1e-6)
    raw = np.array([phi[k] @ ridge(fold != fold[k]) for k in range(len(y))])
    bins = np.clip(((raw + 0.5) / 2 * 1000).astype(int), 0, 999)
    keys = np.unique(bins)
    # The least squares rising fit by its definition: a level is the greatest of the least means over ranges around its bin.
    n, good = np.array([(bins == k).sum() for k in keys]), np.array([y[bins == k].sum() for k in keys])
    levels = [max(min(good[i : j + 1].sum() / n[i : j + 1].sum() for j in range(k, len(keys))) for i in range(k + 1)) for k in range(len(keys))]
    assert np.allclose(model.knots, -0.5 + (keys + 0.5) / 500) and np.allclose(model.levels, levels)


def test_odd_rows_and_empty_tables(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(1, 0, 0), (4, 1, None), (None, 1, 0), (5, None, 0), (5, 1, 0), (5, 1, 0), (77, 1, 1)], "doc_id long, quality int, toxic int")
    model = fit_quality(odd_docs, labels)
    rows = score_quality(odd_docs, model, ("doc_id", "text")).collect()
    assert len(rows) == odd_docs.count() and all(0 <= r["score"] <= 1 for r in rows)
    assert score_quality(no_docs, model).count() == 0
    assert {r["score"] for r in score_quality(odd_docs, fit_quality(no_docs, labels)).collect()} == {0.5}
