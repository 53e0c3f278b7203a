"""Line dedup: lines that many sites carry are boilerplate and stay in one place only [DataFrame functions only]."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cells, small, stage

#: Documents with a line to remove, and such lines, that may be broadcast; beyond that texts and removals meet by a shuffle.
BROADCAST_DOCS = 1_000_000


def site_lines(docs: DataFrame) -> DataFrame:
    """(doc_id, th, pos, h, site) of every line that is not blank; th tells texts under one doc_id apart."""
    lines = docs.select("doc_id", F.xxhash64("text").alias("th"), F.coalesce(F.concat(F.lit("s"), "source"), F.lit("")).alias("site"), F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    return lines.withColumn("line", F.trim("line")).where("line <> ''").select("doc_id", "th", "pos", F.xxhash64("line").alias("h"), "site")


def boilerplate(lines: DataFrame, min_sites: int, lg_k: int) -> DataFrame:
    """Staged (h, first): lines on min_sites sites or more, with their first place.

    A sketch of each line's sites is merged by aggregation. Estimates within three standard errors of min_sites are
    decided by exact distinct counts of those lines alone.
    """
    sketched = lines.groupBy("h").agg(F.count("*").alias("n"), F.hll_sketch_agg("site", F.lit(lg_k)).alias("sites"), F.min(F.struct("doc_id", "th", "pos")).alias("first"))
    likely = sketched.where(F.col("n") >= min_sites).select("h", "first", F.hll_sketch_estimate("sites").alias("estimate"))
    band = 3 * 1.04 / math.sqrt(2**lg_k) * min_sites
    likely = stage(likely.where(F.col("estimate") >= min_sites - band), "lines")
    near = likely.where(F.col("estimate") <= min_sites + band).select("h")
    counted = lines.join(small(near, near.count()), "h").groupBy("h", "site").agg(F.lit(1)).groupBy("h").agg(F.count("*").alias("exact"))
    exact = stage(counted.where(F.col("exact") >= min_sites).select("h"), "exact")
    sure = likely.where(F.col("estimate") > min_sites + band)
    return stage(sure.select("h", "first").unionByName(likely.join(exact, "h").select("h", "first")), "boilerplate")


def dedup_lines(docs: DataFrame, min_sites: int = 10, lg_k: int = 8) -> DataFrame:
    """docs with text cut, n_chars (if present) set anew, n_lines and n_removed.

    Lines are compared without spaces at their ends; a line found on min_sites different sources or more (a null source and an
    empty one are two more) stays at its first place by (doc_id, text hash, position) and goes everywhere else. Blank lines stay.
    A null text stays null with 0 lines, an empty one has one line. Rows alike in doc_id and text are treated alike.
    Only doc_id, text, lang, source and n_chars are kept of other columns.
    """
    keep = [c for c in ("doc_id", "text", "lang", "source", "n_chars") if c in docs.columns]
    docs = docs.select(*keep)
    lines = site_lines(docs)
    common = boilerplate(lines, min_sites, lg_k)
    hits = lines.join(small(common, common.count()), "h").where(~F.struct("doc_id", "th", "pos").eqNullSafe(F.col("first")))
    gone = stage(hits.groupBy(F.col("doc_id").alias("_id"), F.col("th").alias("_th")).agg(F.collect_set("pos").alias("_gone")), "removals")
    joined = docs.join(small(gone, cells(gone, "_gone"), BROADCAST_DOCS), F.col("doc_id").eqNullSafe(F.col("_id")) & (F.xxhash64("text") == F.col("_th")), "left")
    parts = F.split("text", "\n")
    left = F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), F.col("_gone"))
    cut = F.when(F.col("_gone").isNull(), F.col("text")).otherwise(F.array_join(F.transform(left, lambda i: F.get(parts, i)), "\n"))
    n_lines = F.when(F.col("text").isNull(), 0).otherwise(F.size(parts)).cast("long")
    out = joined.select(*(c for c in keep if c not in ("text", "n_chars")), cut.alias("text"), n_lines.alias("n_lines"), F.coalesce(F.size("_gone"), F.lit(0)).cast("long").alias("n_removed"))
    if "n_chars" in keep:
        out = out.withColumn("n_chars", F.length("text").cast("long"))
    return out.select(*keep, "n_lines", "n_removed")
