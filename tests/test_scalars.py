from __future__ import annotations

import hashlib
import re

import pytest
from pyspark.sql import functions as F

from tessera.functions import scalars as S


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("text,key", [("  Санитарно-Защитная  ЗОНА. ", "санитарно-защитная зона"), ("ЁЛКА", "елка"), ("«a b»", "a b"), ("", ""), ("—", "")])
def test_normalize(spark, text, key):
    assert one(spark, S.normalize(F.lit(text))) == key


def test_normalize_kind(spark):
    assert one(spark, S.normalize_kind(F.lit("Минимальная ширина"))) == "минимальная_ширина"
    assert one(spark, S.normalize_kind(F.lit("a - b"))) == "a_b"


def test_pending_key(spark):
    assert one(spark, S.pending_key(F.lit("  СП  99 "), F.lit("4.1"))) == "сп 99#4.1"


@pytest.mark.parametrize("raw,number", [("3,5", 3.5), (" 50 ", 50.0), ("x", None), ("", None)])
def test_parse_number(spark, raw, number):
    assert one(spark, S.parse_number(F.lit(raw))) == number


def test_restriction_id_hashes_what_is_said_where(spark):
    value = S.value_text(F.lit(">="), F.lit(50.0), F.lit("м"), F.lit(None).cast("string"))
    got = one(spark, S.restriction_id(F.lit("c"), F.lit("s"), F.lit("o"), F.lit("k"), value))
    assert got == hashlib.sha1("c\x1fs\x1fo\x1fk\x1f>=|50.0|м|None".encode()).hexdigest()
    empty = S.value_text(*(F.lit(None).cast(t) for t in ("string", "double", "string", "string")))
    assert one(spark, empty) == ""


def test_embedding_text_prints_no_zero(spark):
    text = S.embedding_text(F.lit("s"), F.lit("o"), F.lit("k"), F.lit("<="), F.lit(0.0), F.lit("м"), F.lit(None).cast("string"))
    assert one(spark, text) == "s | o | k | <=м"


def test_attribute_lists_are_joined(spark):
    assert one(spark, S.attribute_text(F.array(F.lit(" a "), F.lit(None), F.lit("b")))) == "a, b"


def test_entity_types(spark):
    assert [one(spark, S.entity_type(F.lit(x))) for x in ("Водоохранная зона", "Школа", "Дом")] == ["functional_zone", "service", "physical_object"]


def test_first_json_block(spark):
    assert one(spark, S.first_json(F.lit('so: {"a":\n{"b": 1}} end'))) == '{"a":\n{"b": 1}}'
    assert one(spark, S.first_json(F.lit("none"))) is None


def test_depth_is_clamped():
    assert [S.clamp_depth(d) for d in (-1, 1, 2, 9)] == [1, 1, 2, 3]


def test_normalize_equals_a_local_rule(spark):
    texts = ["Ab  c", "\tЁж.", "(x)-y-", "«Q»", "a—b", "İ", "  z"]
    edge = r"[\s.,;:—–\-()\[\]«»\"']+"

    def rule(t):
        return re.sub(rf"^{edge}|{edge}$", "", re.sub(r"\s+", " ", t.lower().replace("ё", "е")))

    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", S.normalize(F.col("t")).alias("k"))
    assert {r["t"]: r["k"] for r in df.collect()} == {t: rule(t) for t in texts}
