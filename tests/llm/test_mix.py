from __future__ import annotations

import re
from collections import Counter, defaultdict

import pytest

from tessera.llm import mix
from tessera.llm.mix import mix_sources, plan_mix, repeated


def fill(sizes, weights, most):
    """Water-filling by small steps of the clamp: brute force."""
    clamped = {}
    while True:
        free = {s for s in sizes if s not in clamped}
        left = sum(sizes.values()) - sum(clamped.values())
        total = sum(weights[s] for s in free)
        over = {s: most * sizes[s] for s in free if left * weights[s] / total > most * sizes[s]}
        if not over:
            return clamped | {s: left * weights[s] / total for s in free}
        clamped |= over


def test_targets_and_taken(spark, prose):
    docs = spark.createDataFrame([(k, t * (40 if s == "s0" else 1), s) for k, t, s in prose] + [(900, "a b c", None)], "doc_id long, text string, source string")
    rows = mix_sources(docs).collect()
    sizes, taken, biggest = defaultdict(int), defaultdict(int), defaultdict(int)
    for r in rows:
        n = len(re.findall(r"[^\x20\x09-\x0D]+", r["text"]))
        assert r["size"] == n and 0 <= r["copies"] <= 3
        sizes[r["source"]] += n
        taken[r["source"]] += n * r["copies"]
        biggest[r["source"]] = max(biggest[r["source"]], n)
    order = sorted(s for s in sizes if s is not None) + [None]
    want = fill(dict(sizes), {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}, 3)
    for r in rows:
        assert abs(r["target"] - want[r["source"]]) < 1e-6 * max(1, want[r["source"]]) and r["source_size"] == sizes[r["source"]]
    for s in sizes:
        assert abs(taken[s] - want[s]) <= biggest[s]
    assert sorted(map(str, rows)) == sorted(map(str, mix_sources(docs).collect()))


@pytest.mark.parametrize("block", [7, 65_536])
def test_a_source_of_equal_rows_comes_near_its_target(spark, monkeypatch, block):
    monkeypatch.setattr(mix, "EQUAL_ROWS", block)
    rows = [(1, "a b c d", "en" if k % 3 else None, "s0", k % 2) for k in range(1000)] + [(2 + k, f"w{k} x", "en", "s1", None) for k in range(2500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int")
    got = mix_sources(docs).collect()
    assert Counter((r["doc_id"], r["lang"], r["n_chars"]) for r in got) == Counter((r[0], r[2], r[4]) for r in rows)
    for s, biggest in (("s0", 4), ("s1", 2)):
        own = [r for r in got if r["source"] == s]
        assert abs(sum(r["size"] * r["copies"] for r in own) - own[0]["target"]) <= biggest / 2
    assert sorted(map(str, got)) == sorted(map(str, mix_sources(docs).collect()))


def test_odd_rows_and_an_empty_table(spark, odd_docs, no_docs):
    rows = mix_sources(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    assert {r["size"] for r in rows if not (r["text"] or "").strip()} == {0}
    assert max(c := [r["copies"] for r in rows if r["doc_id"] == 100]) - min(c) <= 1
    assert mix_sources(no_docs).count() == 0 and plan_mix(no_docs).count() == 0
    assert repeated(mix_sources(odd_docs)).count() == sum(r["copies"] for r in rows)
