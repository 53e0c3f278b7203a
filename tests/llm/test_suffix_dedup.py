from __future__ import annotations

import random
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import shingles, suffix_dedup, windows
from tessera.llm.suffix_array import suffix_array


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=60))
def test_suffix_array(s):
    assert suffix_array(np.array(s, dtype=int)) == sorted(range(len(s)), key=lambda i: s[i:])


def removed(texts, n):
    raws = [(t or "").encode() for t in texts]
    seen = Counter(r[i : i + n] for r in raws for i in range(len(r) - n + 1))
    out = []
    for r in raws:
        gone = bytearray(len(r))
        for i in range(len(r) - n + 1):
            if seen[r[i : i + n]] > 1:
                gone[i : i + n] = b"\1" * n
        out.append(bytes(b for b, g in zip(r, gone) if not g))
    return raws, out


@pytest.mark.parametrize("group,length", [(4096, 60), (1, 60), (4096, 400)])
def test_against_brute_force(spark, monkeypatch, group, length):
    monkeypatch.setattr(suffix_dedup, "GROUP", group)
    r = random.Random(5)
    base = "".join(r.choice("abcdé ") for _ in range(1200))
    texts = [None, "", base, base, base[:length], base[: length - 1], "y" * (length + 1), "ab" * length, base[50 : 50 + length] + "|" + base[50 : 50 + length]]
    texts += ["".join(r.choice("xyz") for _ in range(r.randrange(80))) + base[(a := r.randrange(700)) : a + r.randrange(20, 500)] + "q" * r.randrange(9) for _ in range(30)]
    docs = spark.createDataFrame([(k, t, 1) for k, t in enumerate(texts)], "doc_id long, text string, v int")
    raws, want = removed(texts, length)
    for row in suffix_dedup.dedup_substrings(docs, length).collect():
        assert row["n_bytes"] == len(raws[row["doc_id"]])
        assert bytes(row["kept"]) == want[row["doc_id"]]
        assert len(raws[row["doc_id"]]) - sum(s["end"] - s["start"] for s in row["spans"]) == len(row["kept"])


def test_no_task_gets_all_copies_of_a_passage(spark, monkeypatch):
    """What is sorted by key with its bytes has GROUP rows of a key at most, however many documents share a passage."""
    monkeypatch.setattr(suffix_dedup, "GROUP", 8)
    sent, real = [], suffix_dedup.map_batches
    monkeypatch.setattr(suffix_dedup, "map_batches", lambda df, run, schema: (sent.append(df), real(df, run, schema))[1])
    r = random.Random(11)
    passage = "".join(r.choice("abcdé ") for _ in range(500))
    texts = ["".join(r.choice("xyz") for _ in range(90)) + passage[r.randrange(20) :] + "".join(r.choice("uvw") for _ in range(90)) for _ in range(60)]
    rows = suffix_dedup.dedup_substrings(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), 100).collect()
    assert [bytes(x["kept"]) for x in sorted(rows)] == removed(texts, 100)[1]
    for df in sent:
        if "bytes" in df.columns:
            keys = [k for k in ("v", "k1", "k2") if k in df.columns]
            assert all(x["count"] <= 8 for x in df.groupBy(*keys).count().collect())


def test_long_texts_past_the_width_of_positions(monkeypatch):
    """Positions of 12 bits and texts of 9,000 bytes stand for 24 bits and over 16 MiB."""
    monkeypatch.setattr(shingles, "BLOCK", 1000)
    monkeypatch.setattr(windows, "_LOW", np.uint64((1 << 12) - 1))
    monkeypatch.setattr(windows, "RANGE", 1500, raising=False)
    r, n = random.Random(6), 60
    passage = bytes(r.choices(b"abcd", k=400))
    texts = [bytes(r.choices(b"xyz", k=4500)) + passage + bytes(r.choices(b"xyz", k=k)) + passage for k in (3700, 10, 900)] + [passage, b"", b"x" * n]
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    key_of, starts = {}, [Counter() for _ in texts]
    for block in windows.segments(np.frombuffer(b"".join(texts), np.uint8), offsets, n):
        for text, start, end, anchor, key, _ in zip(*(x.tolist() for x in block)):
            assert 0 <= end - start - n <= anchor <= n - windows.GRAM and end <= len(texts[text])
            for at in range(start, end - n + 1):
                starts[text][at] += 1
                assert key_of.setdefault(texts[text][at : at + n], (key, start + anchor - at)) == (key, start + anchor - at)
    assert starts == [Counter(range(len(t) - n + 1)) for t in texts]


def test_odd_rows_and_an_empty_table(spark, odd_docs, no_docs):
    rows = suffix_dedup.dedup_substrings(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    assert [len(r["kept"]) for r in rows if r["doc_id"] == 7] == [0]  # a long run repeats itself
    assert suffix_dedup.dedup_substrings(no_docs).count() == 0
