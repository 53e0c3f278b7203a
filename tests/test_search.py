"""Text search against a plain BM25, bounded answers, hot keys of conflicts and walks, and library functions that no query calls."""

from __future__ import annotations

import json
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_contract import PARAMS, plan

from tessera.functions.models import EMBEDDERS, build, hashing_embedder, prefixed
from tessera.operators import conflicts, rows, search, text_search, traverse, vocabulary
from tessera.operators.vocabulary import SEED_KINDS, seed_kinds
from tessera.plans.contract import canonical_json, model_plans
from tessera.plans.revisions import items, review
from tessera.schema import conform, empty_graph
from tessera.sources.documents import get_document, read_details


def bm25(clauses, query, limit):
    docs = {k: re.findall(r"[^\W_]+", (t or "").lower()) for k, t in clauses}
    docs = {k: ts for k, ts in docs.items() if ts}
    mean, df = sum(map(len, docs.values())) / len(docs), Counter(t for ts in docs.values() for t in set(ts))
    scores = Counter()
    for t in set(re.findall(r"[^\W_]+", query.lower())):
        for k, ts in docs.items():
            if tf := ts.count(t):
                scores[k] += math.log1p((len(docs) - df[t] + 0.5) / (df[t] + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(ts) / mean))
    return sorted(scores.items(), key=lambda x: (-round(x[1], 9), x[0]))[:limit]


def test_text_search_equals_plain_bm25(spark):
    r = random.Random(3)
    words = ["Школа", "зона", "парк", "a1", "дом", "ÜBER", "e"]
    clauses = [(f"c{k}", " ".join(r.choices(words, k=r.randrange(0, 30))) + r.choice(["", "!", " — "])) for k in range(80)] + [("null", None), ("empty", ""), ("marks", "?!")]
    index = text_search.build_index(spark.createDataFrame(clauses, "node_id string, text string"))
    for query in ("школа a1 школа", "über", "nothing here", "", "?"):
        got = [(x["node_id"], round(x["score"], 9)) for x in text_search.search_text(index, query, 10).collect()]
        assert got == [(k, pytest.approx(s, abs=1e-8)) for k, s in bm25(clauses, query, 10)]
    few = spark.createDataFrame([("c1",), ("c2",)], "node_id string")
    assert {x["node_id"] for x in text_search.search_text(index, "школа зона парк дом e", 10, few).collect()} <= {"c1", "c2"}
    none = text_search.build_index(spark.createDataFrame([], "node_id string, text string"))
    assert text_search.search_text(none, "школа").count() == 0


def test_one_search_writes_no_index(spark, monkeypatch):
    """The index of all texts is ten times what one search reads of it: nothing is written for one."""
    r = random.Random(3)
    words = ["Школа", "зона", "парк", "a1", "дом", "ÜBER", "e"]
    clauses = [(f"c{k}", f"n{k % 2}", " ".join(r.choices(words, k=r.randrange(0, 30)))) for k in range(80)] + [("null", "n0", None), ("empty", "n1", ""), ("marks", "n1", "?!")]
    rows = spark.createDataFrame(clauses, "node_id string, name string, text string")
    monkeypatch.setattr(text_search, "materialize", lambda *_: 1 / 0)
    for query in ("школа a1 школа", "über", "nothing here", "", "?"):
        want = bm25([(k, t) for k, _, t in clauses], query, 100)
        for among, names in ((None, ("n0", "n1")), (F.col("name") == "n1", ("n1",))):
            got = [(x["node_id"], round(x["score"], 9)) for x in text_search.search_once(rows, query, 100, among).collect()]
            assert got == [(k, pytest.approx(s, abs=1e-8)) for k, s in want if dict((c, n) for c, n, _ in clauses)[k] in names]
    assert text_search.search_once(rows.limit(0), "школа").count() == 0


@pytest.mark.parametrize(("few", "tasks"), [(1_000_000, 1_000_000), (4, 40), (0, 1)])
def test_searches_within_documents_of_many_rare_terms(spark, few, tasks):
    """Frequencies beyond the most frequent ones come to a document as a table of its own; no posting is shuffled by its term."""
    r = random.Random(6)
    words = ["школа", "зона", "парк", "дом", "e"] + [f"r{k}" for k in range(60)]
    clauses = [(f"c{k:02}", f"d{k % 7}", " ".join(r.choices(words, weights=[20] * 5 + [1] * 60, k=r.randrange(0, 12)))) for k in range(70)] + [("none", None, "школа r1")]
    rows = spark.createDataFrame(clauses, "node_id string, doc_id string, text string")
    asked = [(f"q{k}", f"d{k}", f"зона r{k} r{k + 9} парк unknown") for k in range(7)] + [("q", "d1", "unknown"), ("p", None, "e"), ("o", "other", "e")]
    found = text_search.search_within(rows, spark.createDataFrame(asked, "query_id string, doc_id string, text string"), "doc_id", 3, few, tasks)
    got = {(x["query_id"], x["place"]): (x["node_id"], round(x["score"], 8)) for x in found.collect()}
    own, want = {k: d for k, d, _ in clauses}, {}
    for q, doc, text in asked:
        best = [(k, s) for k, s in bm25([(k, t) for k, _, t in clauses], text, 100) if doc and own[k] == doc][:3]
        want |= {(q, i): (k, pytest.approx(s, abs=1e-7)) for i, (k, s) in enumerate(best, 1)}
    assert got == want


@pytest.mark.parametrize(("first", "most"), [(2048, 16_384), (3, 8)])
def test_leaders_of_vectors_read_in_order(spark, monkeypatch, first, most):
    """Near pairs grow as the square of the labels: none is written, whatever the batches."""
    r = random.Random(2)
    rows = [(f"n{k:02}", (k * 7) % 60, [r.gauss(0, 1) for _ in range(3 if k % 5 else 2)]) for k in range(60)] + [("zero", 3, [0.0] * 3), ("again", 4, [0.0] * 3), ("none", 5, None), ("tie", 9, [1.0, 2.0, 3.0]), ("tia", 9, [1.0, 2.0, 3.1])]
    want = []
    for norm, _, v in sorted(rows, key=lambda x: (x[1], x[0])):
        if not any(u and v and len(u) == len(v) and any(u) and any(v) and np.dot(u, v) / np.sqrt(np.dot(u, u) * np.dot(v, v)) >= 0.8 for _, u in want):
            want.append((norm, v))
    monkeypatch.setattr(vocabulary, "near_pairs", lambda *_: 1 / 0)
    labels = spark.createDataFrame(rows, "norm string, seq int, vector array<double>")
    assert sorted(x["norm"] for x in vocabulary.leading_vectors(labels, 0.8, first, most).collect()) == sorted(k for k, _ in want)
    assert vocabulary.leading_vectors(labels.limit(0), 0.8).count() == 0


def test_limits_and_counted_answers(spark):
    for limit in (0, 501, -1):
        for call in (lambda n: search.fetch_size(n), lambda n: search.respond(spark.range(3), n), lambda n: search.search_vector(empty_graph(spark), [1.0], limit=n)):
            with pytest.raises(ValueError):
                call(limit)
    one = search.respond(spark.range(9).orderBy("id"), 4).collect()[0]
    assert one["count"] == 4 and [i["id"] for i in one["items"]] == [0, 1, 2, 3]
    none = search.respond(spark.range(0), 500).collect()[0]
    assert (none["count"], none["items"]) == (0, [])


def restrictions(spark, values):
    """values: (id, subject, object, operator, number)."""
    r = spark.createDataFrame(values, "id string, subject_normalized string, object_normalized string, value_operator string, value_number double")
    made = {"kind": F.lit("k"), "value_unit": F.lit("m"), "clause_node_id": F.col("id")}
    return empty_graph(spark).with_(restriction=conform(r.withColumns(made), "restriction"))


def plain_conflicts(values):
    def span(op, n):
        return (-math.inf if op in ("<=", "<") else n + 1e-9 * (op == ">"), math.inf if op in (">=", ">") else n - 1e-9 * (op == "<"))

    out = set()
    for i, a in enumerate(values):
        for b in values[:i]:
            (l1, h1), (l2, h2) = span(*a[3:]), span(*b[3:])
            if {a[1], a[2]} & {b[1], b[2]} and (h1 < l2 or h2 < l1):
                out.add((min(a[0], b[0]), max(a[0], b[0])))
    return out


@pytest.mark.parametrize("block", [4096, 8])  # one range, and keys in many ranges and parts
def test_conflicts_of_hot_keys(spark, block):
    r = random.Random(8)
    values = [(f"r{k:03}", r.choice(["hot", "e1", "e2"]), r.choice(["hot", "e3", "e1"]), r.choice([">=", "<=", ">", "<", "="]), float(r.choice([5, 10, r.randrange(100)]))) for k in range(220)]
    g, want = restrictions(spark, values), plain_conflicts(values)
    assert [tuple(x) for x in conflicts.find_conflicts(g, block=block).select("lo", "hi").orderBy("lo", "hi").collect()] == sorted(want)
    some = spark.createDataFrame([("r001",), ("r002",), ("r200",)], "id string")
    mine = {p for p in want if {"r001", "r002", "r200"} & set(p)}
    assert {tuple(x) for x in conflicts.find_conflicts(g, some, block).select("lo", "hi").collect()} == mine
    counts = Counter(x for p in want for x in p)
    assert {x["id"]: x["conflicts"] for x in conflicts.conflict_counts(g, block).collect()} == counts


def test_a_hundred_thousand_bounds_of_one_entity(spark):
    """No pair is made for counts, and one upper bound against all the others stays one part's work."""
    n = 100_000
    r = spark.range(n).select(F.concat(F.lit("r"), "id").alias("id"), F.lit("hot").alias("subject_normalized"), F.lit("hot").alias("object_normalized"), F.when(F.col("id") == 0, "<=").otherwise(">=").alias("value_operator"), F.col("id").cast("double").alias("value_number"))
    g = empty_graph(spark).with_(restriction=conform(r.withColumns({"kind": F.lit("k"), "value_unit": F.lit("m")}), "restriction"))
    got = {x["id"]: x["conflicts"] for x in conflicts.conflict_counts(g).where("id in ('r0', 'r1', 'r99999')").collect()}
    assert got == {"r0": n - 1, "r1": 1, "r99999": 1}
    assert conflicts.find_conflicts(g).count() == n - 1


def test_bounds_without_another_side_are_not_repeated(spark):
    """A key of lower bounds alone has no pair: it is dealt into no parts, which would be as the square of its bounds; one upper bound repeats none."""
    rows = [("lower", k % 97, False) for k in range(900)] + [("both", k % 97, k == 5) for k in range(900)]
    sides = spark.createDataFrame([(f"r{i}", e, "k", "m", float(v), u) for i, (e, v, u) in enumerate(rows)], "id string, entity string, kind string, unit_key string, edge double, upper boolean")
    got = conflicts.ranged(sides, conflicts.KEY, 8).groupBy("entity").agg(F.max("both").alias("both"), F.max("meshes").alias("meshes"), F.max("parts").alias("parts")).collect()
    assert sorted(map(tuple, got)) == [("both", True, 1, 4), ("lower", False, 1, 4)]


@pytest.mark.parametrize("block", [4096, 3])
def test_pairs_of_a_hot_entity(spark, block):
    r = random.Random(4)
    values = [(f"r{k:02}", r.choice(["hot", "hot", "a", "b"]), r.choice(["hot", "c", "a"]), ">=", 1.0) for k in range(40)]
    g = restrictions(spark, values)
    want = sorted((a[0], b[0]) for a in values for b in values if a[0] < b[0] and {a[1], a[2]} & {b[1], b[2]})
    assert sorted(tuple(x) for x in traverse.shares_entity(g, block=block).collect()) == want
    one = spark.createDataFrame([("r05",)], "id string")
    assert sorted(x["neighbor_id"] for x in traverse.shares_entity(g, one, block).collect()) == sorted({y for p in want if "r05" in p for y in p} - {"r05"})


def test_filters_read_labels_as_the_vocabulary_does(spark):
    entity = spark.createDataFrame([("санитарная зона", ["сзз"])], "subject_normalized string, _s_aliases array<string>")
    count = lambda label: rows.matching(entity, rows.Filters(subject=label)).count()
    assert [count(x) for x in (" Санитарная  ЗОНА. ", "СЗЗ", "", "зона", ".")] == [1, 1, 1, 0, 0]


def test_sources_of_documents(spark, tmp_path):
    detail = {"doc_id": "d", "name": "N", "unknown": {"x": 1}, "fragments": [{"id": "b", "order": 2, "text": "two", "tags": ["t"]}, {"id": "a", "order": 1, "references": [{"raw": "see", "resolved": True}]}]}
    (tmp_path / "details.jsonl").write_text(json.dumps(detail) + "\n" + json.dumps({"name": "none", "doc_id": "e"}) + "\n")
    details = read_details(spark, str(tmp_path / "details.jsonl"))
    one = get_document(details, "d").collect()[0]
    assert [f["id"] for f in one["fragments"]] == ["a", "b"] and one["fragments"][0]["references"][0]["resolved"] is True and one["name"] == "N"
    assert get_document(details, "x").count() == 0 and get_document(details, "e").collect()[0]["fragments"] is None


def test_models(spark):
    embed = build(EMBEDDERS, "hashing", dimension=8)
    assert prefixed(embed, "query: ")(["a"]) == embed(["query: a"]) and len(embed(["a"])[0]) == 8
    with pytest.raises(ValueError):
        build(EMBEDDERS, "other")
    kinds = seed_kinds(spark, hashing_embedder()).collect()
    assert [k["name"] for k in kinds] == SEED_KINDS and {k["status"] for k in kinds} == {"approved"} and {len(k["embedding"]) for k in kinds} == {64}


def test_plans_of_a_language_model(spark):
    """What is a plan is kept with source and status set here; prose, broken JSON and plans against the contract give none."""
    good = {k: v for k, v in plan("zonal_ratio").items() if k not in ("source", "planner_status")}
    answers = {"good": f"Here it is: {json.dumps(good)} ok", "prose": "no plan", "broken": "{", "against": json.dumps(good | {"params": {**PARAMS["zonal_ratio"], "threshold": 101}})}

    def model(prompts):
        return [answers[p] for p in prompts]

    asked = spark.createDataFrame([(k, k, f"text {k}") for k in answers], "id string, prompt string, extraction_text string")
    got = {x["restriction_id"]: x["plan_json"] for x in model_plans(asked, model).collect()}
    assert {k for k, v in got.items() if v} == {"good"}
    made = json.loads(got["good"])
    assert made["source"] == {"extraction_text": "text good", "restriction_id": "good"} and made["planner_status"] == "auto"

    def failing(prompts):
        raise RuntimeError("no model")

    assert all(x["plan_json"] is None for x in model_plans(asked, failing).collect())
    raw = spark.createDataFrame([('{"b": 1, "a": [1, {"d": 2, "c": 3}]}',), ("x",), (None,)], "j string")
    assert [x[0] for x in raw.select(canonical_json(F.col("j"))).collect()] == ['{"a":[1,{"c":3,"d":2}],"b":1}', None, None]


def test_reviews_and_their_items(spark):
    plans = conform(spark.createDataFrame([("r", 1, True, "zonal_ratio", '{"a": {"b": [1, 2]}}', "auto")], "restriction_id string, revision int, current boolean, template string, params_json string, planner_status string"), "check_plan")
    known = spark.createDataFrame([("r",)], "id string")
    at = F.lit("2024-05-01 00:00:00").cast("timestamp")
    other = conform(spark.createDataFrame([("presence_within", "{}")], "template string, params_json string"), "check_plan")
    now = review(plans, known, "r", "replace", "ann", at, "better", other)
    assert [(x["revision"], x["current"], x["template"], x["planner_status"], x["author"]) for x in now.orderBy("revision").collect()] == [(1, False, "zonal_ratio", "auto", None), (2, True, "presence_within", "reviewed", "ann")]
    for action, given in (("replace", None), ("approve", other), ("other", None)):
        with pytest.raises(ValueError):
            review(plans, known, "r", action, "ann", at, plan=given)
    one = items(plans).select(F.try_variant_get("params", "$.a.b[1]", "int").alias("nested"), F.to_json("source").alias("source"), "requirements_json").collect()[0]
    assert tuple(one) == (2, "{}", "null")
