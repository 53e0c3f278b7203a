from __future__ import annotations

import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, size long, rank int, score double, spans string, node long"
TEXTS = [None, "", " ", "a", "MIT License", "one two three four five six", "é😀 b\n\nc\td", "x" * 5000, ("word%d " * 3000) % tuple(range(3000)), "line\nline\nline"]


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows, and columns whose names operators use inside."""
    rows = [(k, t, "en", f"s{k % 3}", len(t or ""), 1, 2, 0.5, "x", 9) for k, t in enumerate(TEXTS)]
    rows += [(100, "same text here", None, None, None, None, None, None, None, None)] * 3 + [(None, "no id", "en", "s1", 5, 0, 0, 0.0, "", 0), (None, None, None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def prose():
    """Deterministic texts with copies and near copies: (doc_id, text, source)."""
    r = random.Random(7)
    words = ["".join(r.choice("abcdefg") for _ in range(r.randrange(2, 7))) for _ in range(400)]
    out = []
    for k in range(60):
        text = " ".join(r.choice(words) for _ in range(r.randrange(5, 120)))
        out.append(text)
        if k % 4 == 0:
            out.append(text)
        if k % 3 == 0:
            parts = text.split()
            for _ in range(r.randrange(1, 4)):
                parts[r.randrange(len(parts))] = r.choice(words)
            out.append(" ".join(parts))
    return [(k, t, f"s{k % 5}") for k, t in enumerate(out)]
