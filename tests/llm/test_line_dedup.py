from __future__ import annotations

from tessera.llm.line_dedup import dedup_lines


def test_lines_of_many_sites_stay_once(spark):
    rows = [(k, f"own {k}\n  shared here \nfew" if k < 4 else f"own {k}\nshared here", f"s{k}") for k in range(12)] + [(50, "shared here\nshared here", None)]
    out = {r["doc_id"]: r for r in dedup_lines(spark.createDataFrame(rows, "doc_id long, text string, source string"), 5).collect()}
    assert out[0]["text"].split("\n")[1].strip() == "shared here" and out[0]["n_removed"] == 0
    assert all(out[k]["text"] == (f"own {k}\nfew" if k < 4 else f"own {k}") for k in range(1, 12))
    assert out[50]["text"] == "" and out[50]["n_removed"] == 2 and out[50]["n_lines"] == 2


def test_near_the_threshold_counts_are_exact(spark):
    rows = [(1000 * n + k, f"line of {n} sites", f"s{k}") for n in range(1, 40) for k in range(n)]
    out = dedup_lines(spark.createDataFrame(rows, "doc_id long, text string, source string"), 20).collect()
    assert {r["doc_id"] // 1000 for r in out if r["n_removed"]} == set(range(20, 40))


def test_odd_rows_and_an_empty_table(spark, odd_docs, no_docs):
    rows = dedup_lines(odd_docs, 1).collect()
    assert len(rows) == odd_docs.count()
    assert [r["text"] for r in rows if r["doc_id"] == 9] == ["line"]
    assert [(r["text"], r["n_lines"]) for r in rows if r["doc_id"] == 0] == [(None, 0)]
    assert dedup_lines(no_docs).count() == 0
