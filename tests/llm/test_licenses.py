from __future__ import annotations

import re

import pytest

from tessera.llm import licenses as L


@pytest.mark.parametrize(
    "text,rpn",
    [("mit", ["mit"]), ("mit or apache-2.0 and isc", ["mit", "apache-2.0", "isc", "and", "or"]), ("(mit or apache-2.0) and isc", ["mit", "apache-2.0", "or", "isc", "and"]),
     ("gpl-2.0 with cp and mit", ["gpl-2.0", "cp", "with", "mit", "and"]), ("mit and", None), ("(mit", None), ("", None), ("mit apache", ["mit"]), ("or", None)],
)
def test_shunting_yard(text, rpn):
    assert L.parse(text) == rpn


def test_evaluation():
    assert L.evaluate("mit or gpl-3.0") == ({"mit", "gpl"}, 0.95)
    assert L.evaluate("mit and gpl-3.0") == ({"mit", "gpl"}, 0.3)
    assert L.evaluate("gpl-3.0 with x") == ({"gpl"}, 0.5)


def places(text):
    """Base places by brute force over the words."""
    folded = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", folded)
    hits = [(k, label) for p, label in L.BASE.items() for k in range(len(words)) if words[k : k + len(p.split())] == p.split()]
    starts = [k for k, _ in hits]
    return len(words), len(hits), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in hits}))


TEXTS = [None, "", "MIT LICENSE, mit license", "the Apache-License. General public license general public license", "mitlicense", "ünï mit  license é", "mit\x00license", "mit license license mit license",
         "SPDX-License-Identifier: (MIT OR Apache-2.0) AND ISC\nmore"]


def test_against_brute_force(spark):
    docs = spark.createDataFrame([(k, t, "x", 0.1) for k, t in enumerate(TEXTS)], "doc_id long, text string, labels string, score double")
    for r in L.scan_licenses(docs).collect():
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == places(TEXTS[r["doc_id"]])
        assert set(filter(None, r["base_labels"].split(","))) <= set(filter(None, r["labels"].split(","))) and 0 <= r["score"] <= 1
    tagged = [r for r in L.scan_licenses(docs).collect() if r["doc_id"] == 8][0]
    assert tagged["labels"] == "apache,isc,mit" and tagged["n_base"] == 0


def test_odd_rows_and_an_empty_table(odd_docs, no_docs):
    rows = L.scan_licenses(odd_docs).collect()
    assert len(rows) == odd_docs.count() and [r["labels"] for r in rows if r["doc_id"] == 4] == ["mit"]
    assert L.scan_licenses(no_docs).count() == 0
