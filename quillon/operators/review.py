"""What a review would post: a plan, nothing is sent."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ACTIONS = ("COMMENT", "APPROVE", "REQUEST_CHANGES")
MOST_COMMENTS, MOST_PATH, MOST_BODY, MOST_NAME, MOST_PULL = 50, 4096, 65_536, 100, 1_000_000
NAME = r"\A[A-Za-z0-9._-]+\z"


def valid(comments: DataFrame) -> DataFrame:
    """The comments with a column ``valid``: bounds of path, line and body."""
    ok = F.length("path").between(1, MOST_PATH) & (F.col("line") > 0) & F.length("body").between(1, MOST_BODY)
    return comments.withColumn("valid", F.coalesce(ok, F.lit(False)))


def checked(comments: DataFrame, call: str) -> DataFrame:
    """(call, comments, valid, rejected): a call is turned down if it has too many comments or one that isn't valid."""
    sums = valid(comments).groupBy(call).agg(F.count("*").alias("comments"), F.count_if("valid").alias("valid"))
    return sums.withColumn("rejected", (F.col("comments") > MOST_COMMENTS) | (F.col("valid") < F.col("comments")))


def planned(comments: DataFrame, summary: str | None = None, action: str | None = None, failed: DataFrame | None = None) -> DataFrame:
    """(ordinal, type, path, line, action, status): inline comments in order, then the summary's review.

    comments: (ordinal, path, line, body); failed: (ordinal) of actions that could not be posted.  Each is posted for itself, so
    one failure leaves the others alone.
    """
    if action is not None and action not in ACTIONS:
        raise ValueError(f"action is one of {', '.join(ACTIONS)}, not {action}")
    spark = comments.sparkSession
    plan = comments.select("ordinal", F.lit("inline_comment").alias("type"), "path", "line", F.lit(None).cast("string").alias("action"))
    if summary:
        last = comments.agg((F.coalesce(F.max("ordinal"), F.lit(0)) + 1).alias("ordinal"))
        plan = plan.unionByName(last.select("ordinal", F.lit("review").alias("type"), F.lit(None).cast("string").alias("path"), F.lit(None).cast("int").alias("line"), F.lit(action or ACTIONS[0]).alias("action")))
    failed = spark.createDataFrame([], "ordinal long") if failed is None else failed
    lost = failed.select(F.col("ordinal").cast("long").alias("ordinal"), F.lit("failed").alias("status")).distinct()
    return plan.withColumn("ordinal", F.col("ordinal").cast("long")).join(lost, "ordinal", "left").withColumn("status", F.coalesce("status", F.lit("posted")))


def totals(plan: DataFrame, pr: str) -> DataFrame:
    failed = F.count_if(F.col("status") == "failed")
    return plan.agg(F.lit(pr).alias("pr"), F.count("*").alias("total_actions"), (F.count("*") - failed).alias("posted"), failed.alias("failed"))
