"""Mixing sources to target weights by capped water-filling [DataFrame functions only]."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import rank_rows, small, stage, words_pattern

#: Sources a mix may hold while their table is broadcast; beyond that it is joined by a shuffle.
BROADCAST_SOURCES = 10_000


def text_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(words_pattern())), F.lit(0)).cast("long")


def draw_key(seed: int) -> Column:
    """A seeded draw for each row, alike in every run: the same row always has the same one."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.lit(":"), F.coalesce("text", F.lit(""))))


def water_fill(sources: DataFrame, max_epochs: int) -> DataFrame:
    """Adds target to (size, weight): the total is shared by weight; sources beyond max_epochs times their size are clamped
    there and the excess goes to the others by weight until none is above. Only two sums a round reach the driver."""
    total, weight = sources.agg(F.sum("size"), F.sum("weight")).first()
    share, free = total or 0, weight or 0

    def poured(share: int, free: int) -> Column:
        return (F.lit(share) * F.col("weight")).cast("double") / F.lit(float(max(free, 1)))

    cap = F.col("size") * max_epochs
    while True:
        over = cap.cast("double") < poured(share, free)
        clamped, rest = sources.agg(F.sum(F.when(over, cap)), F.sum(F.when(~over, F.col("weight")))).first()
        now = (total or 0) - (clamped or 0), rest or 0
        if now == (share, free):
            break
        share, free = now
    return sources.withColumn("target", F.when(over, cap.cast("double")).otherwise(poured(share, free)))


def plan_mix(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), max_epochs: int = 3, seed: int = 17) -> DataFrame:
    """A row for each source: source, source_size, target, whole (full repetitions), cut (rows drawn below it get one more), more
    and equal: of so many rows drawn at the cut itself, which are equal in id and text, so many get one more.

    Rows are sized and drawn in one pass over the texts. Sums by source and leading digits of the draw find the digits at
    which a source's fractional share ends; only the rows under those digits are ordered, so no source is gathered anywhere.
    """
    rows = stage(docs.select("source", text_words(F.col("text")).alias("size"), draw_key(seed).alias("draw")), "sized").withColumn("head", F.substring("draw", 1, 3))
    heads = stage(rows.groupBy("source", "head").agg(F.sum("size").alias("size")), "heads")
    totals = heads.groupBy("source").agg(F.sum("size").alias("size"))
    ranked = rank_rows(totals, F.col("source").isNull(), F.col("source"))
    cycle = F.array(*map(F.lit, weights))
    ranked = stage(ranked.select("source", "size", F.element_at(cycle, (F.col("rank") % len(weights) + 1).cast("int")).cast("long").alias("weight")), "sources")
    n = ranked.count()
    targets = water_fill(ranked, max_epochs)
    whole = F.when(F.col("size") > 0, F.floor(F.col("target") / F.col("size"))).otherwise(F.lit(0)).cast("long")
    targets = targets.withColumn("whole", whole).withColumn("goal", F.col("target") - F.col("whole") * F.col("size"))
    targets = stage(targets.withColumnsRenamed({"size": "source_size"}), "targets")

    upto = F.sum("size").over(W.partitionBy("source").orderBy("head"))
    ends = heads.withColumn("upto", upto).join(small(targets.select(F.col("source").alias("s"), "goal"), n, BROADCAST_SOURCES), F.col("source").eqNullSafe(F.col("s")))
    ends = ends.where("upto >= goal").groupBy("source", "goal").agg(F.min(F.struct("head", (F.col("upto") - F.col("size")).alias("before"))).alias("e"))
    ends = stage(ends.select(F.col("source").alias("s"), "goal", F.col("e.head").alias("h"), F.col("e.before").alias("before")), "ends")
    edge = rows.join(small(ends, n, BROADCAST_SOURCES), F.col("source").eqNullSafe(F.col("s")) & (F.col("head") == F.col("h")))
    alike = edge.groupBy("source", "head", "draw", "goal", "before").agg(F.max("size").alias("size"), F.count("*").alias("equal"))
    cum = F.col("before") + F.sum(F.col("size") * F.col("equal")).over(W.partitionBy("source", "head").orderBy("draw"))
    left = F.col("goal") - F.col("cum") + F.col("size") * F.col("equal")
    fit = F.coalesce(F.floor(F.try_divide(left, F.col("size")) + 0.5), F.lit(0))
    more = F.when(F.expr("cum - size / 2 <= goal"), F.col("equal")).otherwise(F.least(fit, F.col("equal") - 1))
    inside = alike.withColumn("cum", cum).withColumn("more", more).where("more > 0")
    inside = inside.groupBy(F.col("source").alias("i")).agg(F.max(F.struct("draw", "more", "equal")).alias("last"))
    cuts = ends.join(inside, F.col("s").eqNullSafe(F.col("i")), "left").select("s", F.coalesce("last.draw", "h").alias("cut"), "last.more", "last.equal")
    out = targets.join(cuts, F.col("source").eqNullSafe(F.col("s")), "left")
    none = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("more", "equal")]
    return stage(out.select("source", "source_size", "target", "whole", F.coalesce("cut", F.lit("")).alias("cut"), *none), "mix")


#: Equal rows that one task numbers.
EQUAL_ROWS = 65_536


def numbered(rows: DataFrame, columns: list[str]) -> DataFrame:
    """rows, equal ones numbered from 1 in all (_place). They are counted, not gathered, and made again in blocks."""
    counts = rows.groupBy(*columns).agg(F.count("*").alias("_n"))
    # Rows of one draw that differ in another column follow each other: few distinct ones, whatever their number.
    before = F.sum("_n").over(W.partitionBy("source", "_draw").orderBy(*columns)) - F.col("_n")
    blocks = counts.withColumn("_before", before).withColumn("_from", F.explode(F.sequence(F.lit(0), F.col("_n") - 1, F.lit(EQUAL_ROWS))))
    blocks = blocks.repartition("_draw", "_before", "_from").withColumn("_k", F.explode(F.sequence(F.lit(1), F.least(F.col("_n") - F.col("_from"), F.lit(EQUAL_ROWS)))))
    return blocks.withColumn("_place", F.col("_before") + F.col("_from") + F.col("_k"))


def mix_sources(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), max_epochs: int = 3, seed: int = 17) -> DataFrame:
    """docs with size, source_size, target and copies (times the mix takes the document, 0 to max_epochs).

    Sources by code point, null last, weigh weights in turn; all targets sum to the words of docs. A null text has size 0,
    a source of size 0 gets target 0. Of rows equal in id and text that a source's target falls among, as many get one more as
    fit, so copies may differ by one among them. Other input columns are not kept but for text, lang and source where present.
    """
    keep = [c for c in ("doc_id", "text", "lang", "source", "n_chars") if c in docs.columns]
    plan = plan_mix(docs, weights, max_epochs, seed)
    parted = not plan.where("more < equal").isEmpty()
    plan = small(plan.withColumnRenamed("source", "_source"), plan.count(), BROADCAST_SOURCES)
    out = docs.select(*keep, text_words(F.col("text")).alias("size"), draw_key(seed).alias("_draw")).join(plan, F.col("source").eqNullSafe(F.col("_source")))
    columns = [*keep, "size", "source_size", "target", "whole", "more", "_draw"]
    among = (F.col("_draw") == F.col("cut")) & (F.col("more") < F.col("equal"))
    copies = (F.col("whole") + (F.col("_draw") <= F.col("cut")).cast("long")).alias("copies")
    wanted = [*keep, "size", "source_size", "target"]
    if not parted:
        return out.select(*wanted, copies)
    split = numbered(out.where(among).select(*columns), columns)
    split = split.select(*wanted, (F.col("whole") + (F.col("_place") <= F.col("more")).cast("long")).alias("copies"))
    return out.where(~among).select(*wanted, copies).unionByName(split)


def repeated(mixed: DataFrame) -> DataFrame:
    """The mix itself: each document as many times as it is taken."""
    return mixed.where("copies > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).drop("_copy")
