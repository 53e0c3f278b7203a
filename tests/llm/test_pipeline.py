from __future__ import annotations

import corpus_pipeline as P

SF = "/root/testdata/sf0.001"


def test_stages_take_effect(spark, tmp_path):
    docs, counts = spark.read.parquet(f"{SF}/documents.parquet"), []
    columns = docs.columns
    for k, (name, step) in enumerate(P.STAGES):
        before = docs
        step(spark, docs, SF).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        counts.append(docs.count())
        if k < len(P.STAGES) - 1:
            assert sorted(docs.columns) == sorted(columns)
        if name in ("quality", "near_copies"):
            assert docs.select(*columns).exceptAll(before.select(*columns)).isEmpty() and counts[-1] < before.count()
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    kept = spark.read.parquet(f"{tmp_path}/quality").join(labels, "doc_id").groupBy("quality").count().collect()
    share = {r["quality"]: r["count"] for r in kept}
    assert share[1] / labels.where("quality = 1").count() > 0.95 and share.get(0, 0) / labels.where("quality = 0").count() < 0.5
    assert "ids" in docs.columns and docs.where("n_ids > 0").count() > 0


def test_near_copies_lose_no_text_of_their_own(spark):
    """Two texts under doc_id 2: the copy goes, the other stays; of repeated rows and of a group of copies one stays."""
    a, b, c = (" ".join(f"{x}{k}" for k in range(40)) for x in "abc")
    rows = [(1, a, "en", "s", 1), (2, a, "en", "s", 1), (2, b, "en", "s", 1), (3, c, "de", "s", 1), (3, c, "en", "t", 1), (4, a + " more", "en", "s", 1), (5, "", "en", "s", 0), (5, "", "en", "s", 0),
            (None, a, "en", "s", 1), (None, a, "en", "s", 1), (6, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = sorted(((r["doc_id"] or 0), r["text"] or "") for r in P.near_copies(spark, docs, SF).collect())
    assert got == sorted([(1, a), (2, b), (3, c), (5, ""), (5, ""), (0, a), (0, a), (6, "")])


def test_an_empty_table_and_nulls(spark, no_docs, odd_docs):
    for rows in (no_docs, odd_docs):
        docs = rows
        for _, step in P.STAGES:
            docs = step(spark, docs, SF)
        n = docs.count()
        assert n == 0 if rows is no_docs else n >= 0
