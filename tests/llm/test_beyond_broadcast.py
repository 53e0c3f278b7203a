"""Every operator gives the same rows when nothing is small enough to broadcast and all joins shuffle."""

from __future__ import annotations

from collections import Counter

import pytest

from tessera.llm import common, line_dedup, mix, suffix_dedup
from tessera.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["op1_mix_sources", "op2_suffix_dedup", "op3_line_dedup", "op9_embedding_dedup", "op10_ngram_join"])
def test_same_rows_by_shuffles(spark, monkeypatch, name):
    want = Counter(map(tuple, QUERIES[name](spark, SF).collect()))
    for module, limit in ((common, "BROADCAST_ROWS"), (mix, "BROADCAST_SOURCES"), (line_dedup, "BROADCAST_DOCS"), (suffix_dedup, "BROADCAST_TEXTS")):
        monkeypatch.setattr(module, limit, 0)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert Counter(map(tuple, QUERIES[name](spark, SF).collect())) == want
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_batches_are_bounded_by_bytes_unless_the_session_says_otherwise(spark):
    import pyarrow as pa

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], ["n"])

    rows = spark.range(6000).selectExpr("id", "repeat('x', 2000) AS text").coalesce(1)
    before = spark.conf.get(common._BATCH_KEY)
    try:
        spark.conf.set(common._BATCH_KEY, common._BATCH_DEFAULT)
        found = [r["n"] for r in common.map_batches(rows, sizes, "n long").collect()]
        assert sum(found) == 6000 and max(found) < 3000
        spark.conf.set(common._BATCH_KEY, "1m")
        assert max(r["n"] for r in common.map_batches(rows, sizes, "n long").collect()) < 700
    finally:
        spark.conf.set(common._BATCH_KEY, before)
