from __future__ import annotations

import math
import random
import re
from collections import Counter

from pyspark.sql import functions as F

from tessera.llm.pii import BASE, KINDS, N_VOTES, default_gazetteer, find_pii, looked_up, reliabilities

PLAIN = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
TEXTS = [
    None, "", "a@b.c_d@e.f x@y", "1.2.3.4.5.6.7.8 1.2.3 999.1.1.1 001.2.3.4", "4111 1111 1111 1111 and 4111-1111-1111-1111,41111111111111112", "+1 (555) 555-1234- +12+34567890123 ++1 222 333 444",
    "é" * 5 + "x@y.de..z@q.r.", "user@@a.b@c.d.", "😀 10.0.0.1😀a.b@c-d.ef", "123456789012345678901234567890", "1.2.3.4@5.6 7-8 9-0 1 2 3 4 5 6 7 8 9 0 1 2 3", "a" * 20000 + "@b.cd " + "9" * 20000,
    'token = "abcdef0123456789abcdef0123456789"',
]


def luhn(d):
    return sum(int(c) if k % 2 == 0 else sum(divmod(2 * int(c), 10)) for k, c in enumerate(reversed(d))) % 10 == 0


def spans(text):
    out = []
    for rank, (kind, pattern) in enumerate(PLAIN.items()):
        for m in re.finditer(pattern, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            good = {"email": True, "ip": all(int(p or 256) <= 255 for p in m[0].split(".")) if kind == "ip" else True, "card": 12 <= len(d) <= 19 and luhn(d), "phone": 9 <= len(d) <= 15}[kind]
            if good:
                out.append((m.start(), rank, m.end(), kind))
    return sorted(out)


def test_base_spans_equal_the_plain_patterns(spark):
    docs = spark.createDataFrame([(k, t, "x", 1) for k, t in enumerate(TEXTS)], "doc_id long, text string, spans string, base int")
    for r in find_pii(docs).collect():
        want = spans(TEXTS[r["doc_id"]])
        assert [tuple(s) for s in r["base"]] == want
        assert set(want) <= {tuple(s) for s in r["spans"]}
        assert [r[f"n_{k}"] for k in BASE] == [sum(s[3] == k for s in want) for k in BASE]


def test_secrets_are_added_and_prose_is_left_alone(spark):
    rows = [(k, f'see token = "{k:040x}" here' if k % 2 else f"plain words {k} of text, chapter {k}.") for k in range(1, 60)]
    got = {r["doc_id"]: [s["kind"] for s in r["spans"]] for r in find_pii(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[k] == (["secret"] if k % 2 else []) for k, _ in rows)


def test_reliabilities_follow_agreement():
    post = reliabilities({("email", (1, 1, 1, 1, 1, 1)): 80, ("email", (-1, -1, -1, -1, -1, -1)): 40, ("email", (1, -1, 1, 1, 1, 0)): 10})
    assert post["email", (1, 1, 1, 1, 1, 1)] > 0.9 > 0.1 > post["email", (-1, -1, -1, -1, -1, -1)]


def test_expectation_maximisation_over_single_spans():
    """Brute force: each span by itself, with its own posterior, instead of counted patterns of votes."""
    r = random.Random(3)
    rows = [(r.choice(KINDS[:3]), tuple(r.choice((-1, 0, 1)) for _ in range(N_VOTES))) for _ in range(80)] * 2
    p = [1 / (1 + math.exp(-1.5 * sum(v) - 0.5)) for _, v in rows]
    for _ in range(7):
        share = {k: (sum(q for q, (kind, _) in zip(p, rows) if kind == k) + 1) / (sum(kind == k for kind, _ in rows) + 2) for k in KINDS}
        rate = {}
        for j in range(N_VOTES):
            for vote in (-1, 0, 1):
                yes, no = sum(q for q, (_, v) in zip(p, rows) if v[j] == vote), sum(1 - q for q, (_, v) in zip(p, rows) if v[j] == vote)
                rate[j, vote] = (yes + (2 if vote == 1 else 1)) / (sum(p) + 4), (no + (2 if vote == -1 else 1)) / (len(p) - sum(p) + 4)
        new = []
        for kind, v in rows:
            true, false = share[kind], 1 - share[kind]
            for j, vote in enumerate(v):
                true, false = true * rate[j, vote][0], false * rate[j, vote][1]
            new.append(true / (true + false))
        p = new
    got = reliabilities(Counter(rows), 7)
    assert all(abs(got[row] - q) < 1e-9 for row, q in zip(rows, p))


def test_a_gazetteer_votes_on_known_values(spark):
    rows = [("email", "a@gmail.com", 1), ("email", "a@b.example", -1), ("email", "a@own.zz", 0), ("ip", "10.1.2.3", -1), ("ip", "172.20.1.1", -1), ("ip", "172.40.1.1", 0), ("card", "4242 4242 4242 4242", -1),
            ("card", "5212345678901234", 1), ("phone", "+49 30 1234567", 1), ("secret", "AKIA0123456789ABCD", 1), ("secret", "DeadBeefDeadBeef", -1), ("ssn", "666-12-3456", -1), ("ssn", "123-45-6789", 0)]
    df = spark.createDataFrame(rows, "kind string, found string, want int")
    known = {v: [f"{r['kind']}:{r['entry']}" for r in default_gazetteer(spark).collect() if r["vote"] == v] for v in (1, -1)}
    assert [tuple(r) for r in df.withColumn("got", looked_up(known, F.col("kind"), F.col("found"))).where("got <> want").collect()] == []
    own = spark.createDataFrame([("email", "own.zz", 1), (None, "x", 1), ("email", None, -1)], "kind string, entry string, vote int")
    docs = spark.createDataFrame([(1, "write to a@own.zz")], "doc_id long, text string")
    assert find_pii(docs, gazetteer=own).first()["n_email"] == 1


def test_secrets_in_any_case(spark):
    texts = [f'{name}{sep}"{"9f8e7d6c5b4a3f2e1d0c" if k % 2 else "Q7w8E9r0T1y2U3i4"}"' for k, (name, sep) in enumerate([("API_KEY", "="), ("Token", ": "), ("SECRET", " = "), ("api-key", ":"), ("Password", "=")])]
    filler = [f"plain words {k} of text, see chapter {k}" for k in range(20)]
    rows = find_pii(spark.createDataFrame(list(enumerate(texts + filler)), "doc_id long, text string")).collect()
    assert sorted(r["doc_id"] for r in rows if any(s["kind"] == "secret" for s in r["spans"])) == list(range(len(texts)))


def test_odd_rows_and_an_empty_table(odd_docs, no_docs):
    assert find_pii(odd_docs).count() == odd_docs.count() and find_pii(no_docs).count() == 0
