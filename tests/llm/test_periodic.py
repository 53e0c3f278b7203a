from __future__ import annotations

import hashlib
import random
import zlib

import numpy as np

from tessera.llm.periodic import collapse_runs, longest_run, reach, runs_of
from tessera.llm.queries import planted_runs


def brute(w):
    """All runs of a list of words by trying every period everywhere."""
    out = []
    for p in range(1, len(w) // 4 + 1):
        i = 0
        while i + p < len(w):
            s = i
            while i + p < len(w) and w[i] == w[i + p]:
                i += 1
            length = i - s + p
            if i > s and length >= max(6, 4 * p) and not any(w[s : s + length - q] == w[s + q : s + length] for q in range(1, p)):
                out.append((s, length, p))
            i += 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def collapsed(w, runs):
    gone = {i for s, n, p in runs for i in range(s + p, s + n)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


def texts(seed, many):
    r = random.Random(seed)
    for k in range(many):
        n = r.randrange(0, 90)
        if k % 5 == 0:
            w = [r.randrange(r.choice([1, 2, 3, 9])) for _ in range(n)]
        elif k % 5 == 1:
            w = ([r.randrange(3) for _ in range(r.randrange(1, 12))] * 99)[:n]
            for _ in range(r.randrange(3) if n else 0):
                w[r.randrange(n)] = r.randrange(4)
        elif k % 5 == 2:
            w = [int(r.random() < 0.07) for _ in range(n)]
        elif k % 5 == 3:
            w = []
            while len(w) < n:
                w += [r.randrange(3) for _ in range(r.randrange(1, 4))] * r.randrange(1, 9)
        else:
            w = (([0] * r.randrange(1, 14) + [1]) * 20)[:n]  # short runs inside of longer ones
        yield [f"w{x}" for x in w]


def test_runs_equal_those_of_every_period_tried():
    some = list(texts(3, 600))
    for at in range(0, len(some), 4):
        group = some[at : at + 4]
        bounds = np.concatenate([[0], np.cumsum([len(w) for w in group])]).astype(np.int64)
        ids = np.array([int(w[1:]) + 10 * k for k, ws in enumerate(group) for w in ws], np.int64)
        assert [tuple(map(int, r)) for r in runs_of(ids, bounds)] == [(int(bounds[k]) + s, n, p) for k, w in enumerate(group) for s, n, p in brute(w)]


def test_extension_by_chunks():
    ids = np.array([5] * 1000 + [6], np.int64)
    at, p = np.array([0, 990, 999]), np.array([1, 1, 1])
    assert reach(ids, at, p, np.array([1000, 10, 1]), 1).tolist() == [999, 9, 0]
    assert reach(ids, np.array([499]), np.array([2]), np.array([500]), -1).tolist() == [500]


def test_whole_texts(spark):
    some = [" ".join(w) for w in texts(4, 60)] + ["x" * 70000 + " y" * 300, "a\tb\n" * 40, "é b " * 9]
    rows = {r["doc_id"]: r for r in collapse_runs(spark.createDataFrame(list(enumerate(some)), "doc_id long, text string")).collect()}
    for k, text in enumerate(some):
        words = text.split()
        runs = brute(words)
        assert [tuple(r) for r in rows[k]["runs"]] == runs and rows[k]["n_words"] == len(words) and rows[k]["text"] == collapsed(words, runs)


def test_planted_periods(spark):
    some = [(k, " ".join(f"w{i}" for i in range(k % 50 + 1))) for k in range(300)]
    for r in planted_runs(spark.createDataFrame(some, "doc_id long, text string")).collect():
        words, h = dict(some)[r["doc_id"]].split(), zlib.crc32(str(r["doc_id"]).encode())
        if h % 10 == 0:
            n, g = len(words), h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[a + (i - a) % p] if i >= a else w for i, w in enumerate(words)]
        assert r["text"].split() == words


def test_odd_rows(spark, odd_docs, no_docs):
    rows = collapse_runs(planted_runs(odd_docs)).withColumn("best", longest_run("runs")).collect()
    assert len(rows) == odd_docs.count() and all((r["best"] is None) == (not r["runs"]) for r in rows)
    assert {r["text"] for r in rows if not r["n_words"]} == {""}
    assert len({hashlib.sha256(r["text"].encode()).hexdigest() for r in rows if r["doc_id"] == 100}) == 1
    assert collapse_runs(planted_runs(no_docs)).count() == 0
