"""Plans from restrictions by rules: distances in metres and shares in percent; what no rule covers is unsupported."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import has_any, layer

# Units that rules understand, and stems of kinds that are shares.
METRES = ("м", "m", "метр", "метров", "метра")
PERCENT = ("%", "процент", "процентов")
SHARE_STEMS = ("доля", "коэффициент", "плотност")
RATIO_OPERATORS = ("<", "<=", ">", ">=", "==")
MAX_DISTANCE, MAX_ENTITY, MAX_TEXT = 100_000, 200, 8000


def rule() -> Column:
    """The template a restriction calls for by its value; null if none does."""
    unit, operator = F.lower(F.coalesce("value_unit", F.lit(""))), F.col("value_operator")
    metres = F.col("value_number").isNotNull() & unit.isin(*METRES)
    share = F.col("value_number").isNotNull() & F.coalesce("value_unit", F.lit("")).isin(*PERCENT) & has_any(F.lower("kind"), SHARE_STEMS)
    template = F.when(metres & operator.isin(">", ">="), "distance_from_source").when(metres & operator.isin("<", "<="), "presence_within")
    return template.when(share, "zonal_ratio")


def acceptable(template: Column) -> Column:
    """Whether the plan that a rule would make meets the contract; if not the restriction is unsupported."""
    n, named = F.col("value_number"), F.lit(True)
    for c in ("subject", "object"):
        named = named & F.length(c).between(1, MAX_ENTITY)
    texts = F.coalesce(F.length("extraction_text") <= MAX_TEXT, F.lit(True))
    amount = F.when(template == "zonal_ratio", n.between(0, 100) & F.coalesce("value_operator", F.lit("<=")).isin(*RATIO_OPERATORS)).otherwise((n > 0) & (n <= MAX_DISTANCE))
    return F.coalesce(named & texts & amount, F.lit(False))


def plan_columns(restrictions: DataFrame, *also: str) -> DataFrame:
    """(also ..., restriction_id, schema_version, template, template_version, params_json, requirements_json, source_json, planner_status)."""
    rows = restrictions.withColumn("_rule", rule())
    rows = rows.withColumn("template", F.when(acceptable(F.col("_rule")), F.coalesce("_rule", F.lit("unsupported"))).otherwise("unsupported"))
    n = F.col("value_number")
    text = lambda v, name: F.lit(v).alias(name)
    distance = F.struct(
        text("source", "source_layer"), F.array(F.lit("targets")).alias("targets"), text("buffered", "geometry_mode"), n.alias("distance_m"), text("intersects", "predicate"),
        text("matched", "violation_when"), text("both", "result_mode"),
    )
    presence = F.struct(text("objects", "objects_layer"), F.array(F.lit("neighbors")).alias("required_neighbor_layers"), n.alias("distance_m"), F.lit(1).alias("minimum_neighbors"), text("both", "result_mode"))
    ratio = F.struct(
        text("zones", "zones_layer"), F.struct(text("numerator", "layer"), text("area", "measure")).alias("numerator"), F.struct(text("zone_area", "measure")).alias("denominator"),
        F.coalesce("value_operator", F.lit("<=")).alias("operator"), n.alias("threshold"), text("%", "unit"),
    )
    subject, obj = F.col("subject"), F.col("object")

    def needs(*layers: Column) -> Column:
        return F.to_json(F.struct(F.array(*layers).alias("layers"), F.array().cast("array<string>").alias("attributes")))

    made = F.col("template")
    params = F.when(made == "distance_from_source", F.to_json(distance)).when(made == "presence_within", F.to_json(presence)).when(made == "zonal_ratio", F.to_json(ratio)).otherwise("{}")
    required = F.when(made == "distance_from_source", needs(layer("source", subject), layer("targets", obj))).when(made == "presence_within", needs(layer("objects", obj), layer("neighbors", subject)))
    required = required.when(made == "zonal_ratio", needs(layer("zones", obj), layer("numerator", subject))).otherwise("null")
    source = F.to_json(F.struct(F.col("id").alias("restriction_id"), F.col("extraction_text").alias("extraction_text")))
    return rows.select(
        *also, F.col("id").alias("restriction_id"), F.lit("1.0").alias("schema_version"), "template", F.lit(1).alias("template_version"), params.alias("params_json"),
        required.alias("requirements_json"), source.alias("source_json"), F.when(made == "unsupported", "unsupported").otherwise("auto").alias("planner_status"),
    )


def review_status(planner_status: Column) -> Column:
    return F.when(planner_status == "auto", "pending").otherwise("rejected")
