"""Scalar rules of the graph: label keys, ids, values and spans. All are column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Punctuation stripped from a label's ends, and operators that make a value comparable.
EDGE_PUNCTUATION = r".,;:—–\-()\[\]«»\"'"
COMPARABLE = (">=", "<=", ">", "<", "=")
STRICT = 1e-9
UNIT_SEPARATOR = "\x1f"
# Stems in an entity's name that make it a zone or a service.
ZONE_STEMS = ("зон", "территори")
SERVICE_STEMS = ("школ", "детск", "сад", "поликлиник", "больниц", "аптек", "магазин", "спорт")
#: Traversal never goes deeper than this.
MAX_DEPTH = 3
#: Rows that a request may ask for.
MIN_LIMIT, MAX_LIMIT = 1, 500


def normalize(text: Column) -> Column:
    """A label's key: lower case, ё as е, single spaces, no punctuation at its ends. Unicode white space counts."""
    plain = F.regexp_replace(F.regexp_replace(F.lower(text), "ё", "е"), r"(?U)\s+", " ")
    return F.regexp_replace(plain, rf"(?U)^[\s{EDGE_PUNCTUATION}]+|[\s{EDGE_PUNCTUATION}]+$", "")


def normalize_kind(label: Column) -> Column:
    """A kind's code: the key with spaces and hyphens as underscores."""
    return F.regexp_replace(normalize(label), r"(?U)[\s\-]+", "_")


def name_key(text: Column) -> Column:
    """The looser key of a referenced document's name: lower case and single spaces only."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"(?U)\s+", " "))


def pending_key(name: Column, numbering: Column) -> Column:
    return F.concat(name_key(name), F.lit("#"), F.coalesce(numbering, F.lit("None")))


def value_text(operator: Column, number: Column, unit: Column, condition: Column) -> Column:
    """A value as its id sees it: '' without a value, else its four parts, absent ones as None."""
    parts = [F.coalesce(c.cast("string"), F.lit("None")) for c in (operator, number, unit, condition)]
    return F.when(value_is_empty(operator, number, unit, condition), F.lit("")).otherwise(F.concat_ws("|", *parts))


def value_is_empty(operator: Column, number: Column, unit: Column, condition: Column) -> Column:
    return operator.isNull() & number.isNull() & unit.isNull() & condition.isNull()


def restriction_id(clause: Column, subject: Column, obj: Column, kind: Column, value: Column) -> Column:
    """The stable id of a restriction: what it says and where, so writing it twice is writing it once."""
    return F.sha1(F.concat_ws(UNIT_SEPARATOR, clause, subject, obj, kind, value))


def embedding_text(subject: Column, obj: Column, kind: Column, operator: Column, number: Column, unit: Column, condition: Column) -> Column:
    """What a restriction's vector is made of. A zero prints as nothing."""
    amount = F.when(number == 0, F.lit("")).otherwise(F.coalesce(number.cast("string"), F.lit("")))
    value = F.concat(F.coalesce(operator, F.lit("")), amount, F.coalesce(unit, F.lit("")))
    return F.concat_ws(" | ", subject, obj, kind, F.when(~value_is_empty(operator, number, unit, condition), value))


def attribute_text(values: Column) -> Column:
    """An attribute given as a list: its parts trimmed and joined."""
    return F.trim(F.regexp_replace(F.array_join(F.transform(F.filter(values, lambda x: x.isNotNull()), lambda x: F.trim(x)), ", "), r"^[, ]+|[, ]+$", ""))


def parse_number(raw: Column) -> Column:
    """A number with a point or a comma; anything else is null."""
    return F.trim(F.regexp_replace(raw, ",", ".")).try_cast("double")


def absolute(base: Column, offset: Column) -> Column:
    """A span's place in the document; null if either part is."""
    return base + offset


def lower_bound(operator: Column, number: Column) -> Column:
    low = F.when(operator.isin("<=", "<"), F.lit(float("-inf"))).when(operator == ">", number + STRICT)
    return low.otherwise(number)


def upper_bound(operator: Column, number: Column) -> Column:
    high = F.when(operator.isin(">=", ">"), F.lit(float("inf"))).when(operator == "<", number - STRICT)
    return high.otherwise(number)


def comparable(operator: Column, number: Column) -> Column:
    return operator.isin(*COMPARABLE) & number.isNotNull()


def amount_text(operator: Column, number: Column, unit: Column) -> Column:
    return F.concat(operator, number.cast("string"), F.coalesce(unit, F.lit("")))


def checked_limit(limit: int) -> int:
    """A request's limit; one out of bounds is an error, as what is ranked and broadcast grows with it."""
    if not MIN_LIMIT <= limit <= MAX_LIMIT:
        raise ValueError(f"limit {limit} is not between {MIN_LIMIT} and {MAX_LIMIT}")
    return limit


def clamp_depth(depth: int) -> int:
    return max(1, min(depth, MAX_DEPTH))


def has_any(text: Column, stems: tuple[str, ...]) -> Column:
    found = F.lit(False)
    for stem in stems:
        found = found | text.contains(stem)
    return found


def entity_type(name: Column) -> Column:
    folded = F.lower(name)
    return F.when(has_any(folded, ZONE_STEMS), "functional_zone").when(has_any(folded, SERVICE_STEMS), "service").otherwise("physical_object")


def layer(role: str, entity: Column) -> Column:
    kind = entity_type(entity)
    area = F.array(F.lit("Polygon"), F.lit("MultiPolygon"))
    any_shape = F.array(*map(F.lit, ("Point", "MultiPoint", "Polygon", "MultiPolygon")))
    return F.struct(
        F.lit(role).alias("role"), entity.alias("entity"), kind.alias("entity_type"),
        F.when(kind == "functional_zone", area).otherwise(any_shape).alias("geometry_types"), F.lit(True).alias("required"),
    )


def first_json(text: Column) -> Column:
    """The outermost {...} block of a model's answer, null if there is none."""
    block = F.regexp_extract(text, r"(?s)\{.*\}", 0)
    return F.when(block != "", block)
