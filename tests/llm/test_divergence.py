from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from tessera.llm.divergence import audit_sources, shares


def brute(rows, least, top=10):
    """rows: (text, lang, source)."""
    n, docs, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for text, lang, source in rows:
        words = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        n[lang or "", source or ""].update(words)
        docs[lang or ""].update(set(words))
        groups[lang or ""].add(source or "")
    out = set()
    for lang, sources in groups.items():
        kept = [t for t, k in docs[lang].items() if k >= least]
        everywhere = sum((n[lang, s] for s in sources), Counter())

        def share(counts):
            total = sum(counts[t] for t in kept) + 2 * len(kept)
            return {t: 1 + 10**9 * (counts[t] + 2) // total for t in kept}

        q, f = share(everywhere), lambda x, y: (x - y) ** 2 // (x + y)
        p = {s: share(n[lang, s]) for s in sources}
        for s in sources:
            pairs = [(sum(f(p[s][t], p[o][t]) for t in kept), o) for o in sources if o != s]
            terms = [(f(p[s][t], q[t]), t) for t in kept if n[lang, s][t] and p[s][t] > q[t]]
            for part, found, most in (("pair", pairs, None), ("term", terms, top)):
                out |= {(lang, s, part, item, v, k) for k, (v, item) in enumerate(sorted(found, key=lambda x: (-x[0], x[1]))[:most], 1)}
    return out


@pytest.mark.parametrize("terms, sources", [(512, 64), (5, 2)])  # one tile, and many tiles with blocks of sources
def test_equals_brute_force(spark, terms, sources):
    r = random.Random(5)
    words = [f"{r.choice('aébß')}{r.choice('xyzÄ')}{r.choice('kl')}{r.choice('mnop')}" for _ in range(60)]
    rows = [(" ".join(r.choices(words, k=r.randrange(0, 40))) + r.choice(["", " 12 A-B", "\x00Ab"]), r.choice(["en", "de", None, ""]), r.choice(["s1", "s2", "Z", "é", "s3", None])) for _ in range(300)]
    rows += [(None, "xx", "lonely"), ("", "yy", "a"), ("rare word", "yy", "b"), rows[0], rows[0]]
    docs = spark.createDataFrame(rows, "text string, lang string, source string")
    got = [tuple(x) for x in audit_sources(docs, 10, terms=terms, sources=sources).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(rows, 10)


def test_shares_are_exact_for_great_counts():
    r = random.Random(2)
    for _ in range(300):
        total = r.randrange(1, 9 * 10**15)
        count = r.randrange(0, total + 1)
        assert int(shares(np.array([count]), np.array([total]))[0]) == 1 + 10**9 * count // total


def test_odd_rows(spark, odd_docs, no_docs):
    rows = audit_sources(odd_docs, 1).collect()
    assert {tuple(r) for r in rows} == brute([(r["text"], r["lang"], r["source"]) for r in odd_docs.collect()], 1)
    assert audit_sources(no_docs).count() == 0
