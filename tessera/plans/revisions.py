"""Plan revisions: appended, never changed; the highest is current."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..schema import conform

PLAN = ["schema_version", "template", "template_version", "params_json", "requirements_json", "source_json", "planner_status"]


def current(plans: DataFrame) -> DataFrame:
    """Plans with the current flag set anew: one for each restriction, its highest revision."""
    last = F.row_number().over(W.partitionBy("restriction_id").orderBy(F.desc("revision"))) == 1
    return plans.withColumn("current", last)


def append(plans: DataFrame, new: DataFrame, restrictions: DataFrame, protect_reviewed: bool = False) -> DataFrame:
    """plans with a revision of each row of new (restriction_id, plan columns, review_status, author, reason, created_at) whose restriction
    exists; with protect_reviewed none for restrictions whose current plan was reviewed. A rejected plan is not protected. Each new
    revision is current, and of the others only the flag of those it follows changes: what plans hold is neither sorted nor grouped. Where
    all three name the restriction's document, plans of many restrictions are meant, which append_by_document() takes."""
    if all("doc_id" in df.columns for df in (plans, new, restrictions)):
        return append_by_document(plans, new, restrictions, protect_reviewed)
    now = plans.groupBy("restriction_id").agg(F.max(F.struct("revision", "planner_status")).alias("m")).select("restriction_id", F.col("m.revision").alias("_rev"), F.col("m.planner_status").alias("_status"))
    rows = new.join(restrictions.select(F.col("id").alias("restriction_id")), "restriction_id", "left_semi").join(now, "restriction_id", "left")
    if protect_reviewed:
        rows = rows.where("_status is null or _status <> 'reviewed'")
    rows = rows.withColumn("revision", F.coalesce("_rev", F.lit(0)) + 1)
    newer = rows.select("restriction_id", F.lit(True).alias("_newer"))
    old = conform(plans, "check_plan").join(newer, "restriction_id", "left")
    old = old.withColumn("current", F.col("current") & F.col("_newer").isNull())
    return conform(old, "check_plan").unionByName(conform(rows.withColumn("current", F.lit(True)), "check_plan"))


def append_by_document(plans: DataFrame, new: DataFrame, restrictions: DataFrame, protect_reviewed: bool = False) -> DataFrame:
    """append() of tables that hold doc_id too, which the result keeps. Plans, new ones and restrictions are each read once and meet in
    windows of a restriction: without a shuffle if they lie by document, and however many appends follow each other."""
    part = lambda df, name: conform(df, "check_plan", "doc_id").withColumn("_part", F.lit(name))
    there = part(restrictions.select(F.col("id").alias("restriction_id"), "doc_id"), "restriction")
    rows = part(plans, "plan").unionByName(part(new, "new")).unionByName(there)
    w = W.partitionBy("doc_id", "restriction_id")
    last = F.max(F.when(F.col("_part") == "plan", F.struct("revision", "planner_status"))).over(w)
    rows = rows.withColumns({"_last": last, "_there": F.max(F.col("_part") == "restriction").over(w), "_asked": F.max(F.col("_part") == "new").over(w)})
    grows = F.col("_there") & F.col("_asked")
    if protect_reviewed:
        grows = grows & F.coalesce(F.col("_last.planner_status") != "reviewed", F.lit(True))
    is_new = F.col("_part") == "new"
    rows = rows.where((F.col("_part") == "plan") | (is_new & grows))
    current = F.when(is_new, True).otherwise(F.col("current") & ~grows)
    revision = F.when(is_new, F.coalesce("_last.revision", F.lit(0)) + 1).otherwise(F.col("revision"))
    return conform(rows.withColumns({"current": current, "revision": revision}), "check_plan", "doc_id")


def history(plans: DataFrame, restriction: str | None = None) -> DataFrame:
    """Revisions, newest first; they outlive their restriction."""
    rows = plans if restriction is None else plans.where(F.col("restriction_id") == restriction)
    return rows.orderBy("restriction_id", F.desc("revision"))


def pending(plans: DataFrame, restrictions: DataFrame, limit: int | None = 100) -> DataFrame:
    """Current plans that wait for review and whose restriction exists, oldest first."""
    rows = plans.where("current and planner_status = 'auto'").join(restrictions.select(F.col("id").alias("restriction_id")), "restriction_id", "left_semi")
    return rows if limit is None else rows.orderBy("created_at", "restriction_id").limit(limit)


def review(plans: DataFrame, restrictions: DataFrame, restriction: str, action: str, author: str, at: Column, reason: str | None = None, plan: DataFrame | None = None) -> DataFrame:
    """plans after a review. approve and replace give a reviewed, approved revision, reject an unsupported, rejected one; plan (one row of
    plan columns) is given exactly for replace."""
    if action not in ("approve", "reject", "replace"):
        raise ValueError(f"unknown action {action!r}")
    if (action == "replace") != (plan is not None):
        raise ValueError("a plan is given exactly for replace")
    base = plan.select(*PLAN) if plan is not None else plans.where((F.col("restriction_id") == restriction) & F.col("current")).select(*PLAN)
    good = action != "reject"
    row = base.withColumns({
        "restriction_id": F.lit(restriction), "planner_status": F.lit("reviewed" if good else "unsupported"), "review_status": F.lit("approved" if good else "rejected"),
        "author": F.lit(author), "reason": F.lit(reason).cast("string"), "created_at": at,
    })
    return append(plans, row, restrictions)


def items(plans: DataFrame) -> DataFrame:
    """Review items: params and source as variants, which keep what is nested ({} where there are none), requirements as text."""
    parsed = lambda c: F.try_parse_json(F.coalesce(c, F.lit("{}"))).alias(c.removesuffix("_json"))
    return plans.select("restriction_id", "revision", "current", "template", "template_version", "planner_status", "review_status", "author", "reason", "created_at", parsed("params_json"), parsed("source_json"), F.coalesce("requirements_json", F.lit("null")).alias("requirements_json"))


