from __future__ import annotations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.llm import common
from tessera.llm import ngram_join as J
from tessera.llm import shingles as S
from tessera.llm.common import components
from tessera.llm.shingles import shingle_sets


def shingles(text):
    words = [w for w in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").replace("\x0b", " ").replace("\x0c", " ").split(" ")]
    words = [w for part in words for w in part.replace("\t", " ").replace("\n", " ").replace("\r", " ").split(" ") if w]
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} if words else set()


def brute(rows):
    sets = {k: shingles(t) for k, t in rows}
    reach = {k: k for k in sets}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    while True:
        changed = False
        for a, b in links:
            m = min(reach[a], reach[b])
            changed |= reach[a] != m or reach[b] != m
            reach[a] = reach[b] = m
        if not changed:
            return {k: (len(sets[k]), reach[k]) for k in sets}


@pytest.mark.parametrize("block,local,held", [(2, 2, 50), (2048, 64, 1_000_000)])
def test_against_brute_force(spark, prose, monkeypatch, block, local, held):
    monkeypatch.setattr(J, "GROUP_BLOCK", block)
    monkeypatch.setattr(J, "LOCAL", local)
    monkeypatch.setattr(J, "HELD", held)
    words = " ".join(f"w{k}" for k in range(60))
    hot = [(1000 + k, words.replace(f"w{k} ", f"x{k} ").replace(f"w{(7 * k) % 59} ", "") if k % 2 else words.replace(f"w{k} ", "")) for k in range(50)]
    rows = [(k, t) for k, t, _ in prose] + hot + [(2000, "A b C"), (2001, "a B c"), (2002, ""), (2003, None), (2004, "a b c d")]
    docs = spark.createDataFrame([(*r, 1, b"x") for r in rows], "doc_id long, text string, n int, sig binary")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in J.near_duplicates(docs).collect()}
    assert got == brute(rows)


def test_partners_that_compete_in_groups_of_two(spark):
    """b shares more rare shingles with a1, which is not similar, than with a3, which is: no pair may be lost to the other.
    Repeated rows make the text's shingles more frequent than the tail's, so b's prefix starts with its tail."""
    rows = []
    for k in range(40):
        text, tail, other = ([f"{c}{k}x{i}" for i in range(n)] for c, n in (("t", 85), ("e", 19), ("o", 85)))
        a1, a3, b = " ".join(other + tail), " ".join(text), " ".join(text + tail)
        rows += [(10 * k, b), (10 * k + 1, a1), *[(10 * k + 2, a3)] * 3, *[(10 * k + 3, " ".join(other))] * 5]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in J.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute(dict(rows).items())


def test_no_pair_is_verified_twice(spark, prose, monkeypatch):
    """Over all rounds, with pairs that pass the sketches and fail, which stay in different components."""
    seen = []

    def watch(pairs, *rest):
        seen.append([tuple(r) for r in pairs.select("a", "b").collect()])
        return verified(pairs, *rest)

    verified = J.verified
    monkeypatch.setattr(J, "verified", watch)
    monkeypatch.setattr(J, "sketch_distance", lambda s, x, y: np.zeros(len(x), np.int64))
    base = [f"w{k}" for k in range(80)]
    apart = [(1000 + k, " ".join(base[:k] + [f"x{k}"] + base[k + 1 :])) for k in range(5, 80, 5)]  # 66 of 86 shingles in common, all pairs fail
    rows = [(k, t) for k, t, _ in prose] + apart
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in J.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute(rows)
    pairs = [p for part in seen for p in part]
    assert len(seen) == 3 and len(pairs) == len(set(pairs)) > 100


def test_a_frequent_shingle_is_sent_by_few_rows(spark, monkeypatch):
    """What meets by the hash of a shingle that all documents have grows with tasks, not with documents."""
    monkeypatch.setattr(J, "LOCAL", 8)
    prefix = spark.createDataFrame([(k, 40 + k % 3, [7, 1000 + k]) for k in range(900)], "node long, n long, hs array<long>").repartition(3)
    rows = J.exploded(prefix, 80).collect()
    met = [r for r in rows if r["kind"] < J.SETTLED and r["h"] == 7]
    assert len(met) == 6 and len([r for r in rows if r["kind"] == J.ENTRY]) == 900
    assert sorted(r["a"] for r in rows if r["kind"] == J.SETTLED) == list(range(900))
    pairs = [(r["a"], r["b"]) for r in J.chained(prefix, 80).where("h is null").collect()]
    reached = {r["node"]: r["component_id"] for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert reached == dict.fromkeys(range(900), 0)


def test_sketches_never_differ_more_than_sets():
    r = np.random.default_rng(1)
    for n in (1, 5, 60, 300, 2000):
        x = np.unique(r.integers(0, 2**63, n, dtype=np.uint64))
        y = np.unique(np.concatenate([x[: n // 2], r.integers(0, 2**63, n - n // 2 + 3, dtype=np.uint64)]))
        sketches = pa.array([J.odd_sketch(x), J.odd_sketch(y)], pa.binary())
        assert J.sketch_distance(sketches, np.array([0]), np.array([1]))[0] <= len(np.setxor1d(x, y))


def test_similarity_of_sets():
    r = np.random.default_rng(2)
    for _ in range(300):
        x = np.unique(r.integers(0, 40, 25).astype(np.uint64) * np.uint64(2**50))
        y = np.unique(np.concatenate([x, r.integers(0, 40, r.integers(0, 6)).astype(np.uint64) * np.uint64(2**50)]))[: r.integers(1, 30)]
        both, either = len(np.intersect1d(x, y)), len(np.union1d(x, y))
        assert J.is_similar(x, y, 80) == (100 * both >= 80 * either)


def test_shingles_of_short_and_empty_texts():
    got = [len(s) for s in shingle_sets(pa.array(["", None, "a", "a b c d e", "a b c d e f", "a b c d e a b c d e", "  \n"]))]
    assert got == [0, 0, 1, 1, 2, 5, 0]


def test_long_texts_go_in_stretches(monkeypatch):
    texts = [" ".join(f"w{k % 700}" for k in range(4000)), "x" * 30_000 + " a b c d e f", " " * 9000 + "a b c d e f g", "a b c d e f g", None]
    whole = [s.tolist() for s in shingle_sets(pa.array(texts))]
    monkeypatch.setattr(S, "BLOCK", 5000)
    assert [s.tolist() for s in shingle_sets(pa.array(texts))] == whole and whole[2] == whole[3]


def test_components_of_stars_paths_and_loops(spark):
    pairs = [(0, k) for k in range(1, 40)] + [(100 + k, 101 + k) for k in range(50)] + [(300, 300), (None, 1)] + [(401, 400), (400, 402), (402, 401)]
    got = {r["node"]: r["component_id"] for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {k: 0 for k in range(40)} | {k: 100 for k in range(100, 151)} | {k: 400 for k in (400, 401, 402)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_components_of_random_links_over_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(common, "HELD_EDGES", 3)
    r = np.random.default_rng(3)
    pairs = [(int(x), int(y)) for x, y in r.integers(0, 400, (300, 2))] + [(1000 + k, 1001 + k) for k in range(64)]
    least = {k: k for p in pairs for k in p}
    while any(least[x] != least[y] for x, y in pairs):
        for x, y in pairs:
            least[x] = least[y] = min(least[x], least[y])
    linked = {k for x, y in pairs if x != y for k in (x, y)}
    frame = spark.createDataFrame(pairs, "a long, b long").repartition(7)
    got = {r["node"]: r["component_id"] for r in components(frame).collect()}
    assert {k: v for k, v in got.items() if k in linked} == {k: v for k, v in least.items() if k in linked}
    assert set(got) == linked


def test_odd_rows_and_an_empty_table(odd_docs, no_docs):
    rows = J.near_duplicates(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    assert {r["component_id"] for r in rows if r["doc_id"] is None} == {None}
    assert {r["component_id"] for r in rows if r["doc_id"] == 100} == {100}
    assert J.near_duplicates(no_docs.withColumn("x", F.lit(1))).count() == 0
