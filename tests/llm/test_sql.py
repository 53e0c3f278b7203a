from __future__ import annotations

import pytest
from oracle import assert_same

from tessera.llm.queries import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_its_sql(spark, name):
    assert assert_same(spark, QUERIES[name], ORACLE_SQL[name], "/root/testdata/sf0.001") > 0


def test_planted_copies_are_linked(spark):
    rows = QUERIES["planted_embedding_dedup"](spark, "/root/testdata/sf0.001").collect()
    assert sum(r["n_links"] for r in rows) > len(rows) and sum(r["kept"] for r in rows) < len(rows) / 2


def test_every_operator_has_one_query():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES if n.startswith("op")) == list(range(1, 14))
