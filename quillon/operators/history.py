"""Commits, newest first."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.operators.credentials import secrets

DEFAULT_COMMITS, MOST_COMMITS = 100, 5000


def newest(commits: DataFrame, n: int | None = None) -> DataFrame:
    """The n newest commits (100 if None): a bounded top-k, of which each task keeps n."""
    n = DEFAULT_COMMITS if n is None else n
    if not 1 <= n <= MOST_COMMITS:
        raise ValueError(f"the number of commits is 1 to {MOST_COMMITS}, not {n}")
    return commits.orderBy(F.desc("commit_date"), F.desc("commit_hash")).limit(n)


def history_secrets(commits: DataFrame, n: int | None = None) -> DataFrame:
    """Secrets in the added lines of the newest commits; commits: (commit_hash, commit_date, file_path, patch).

    Lines are numbered within the patch.
    """
    few = newest(commits.select("commit_hash", "commit_date").distinct(), n)
    patches = commits.join(few, ["commit_hash", "commit_date"])
    lines = patches.select("commit_hash", "commit_date", "file_path", F.posexplode(F.split("patch", r"\r?\n", -1)).alias("at", "text"))
    added = lines.where(F.col("text").startswith("+") & ~F.col("text").startswith("+++"))
    # The commit rides along as the ordinal, so the detectors stay one plan.
    tagged = added.select(F.struct("commit_hash", "commit_date").alias("ord"), "file_path", (F.col("at") + 1).alias("line"), F.substring("text", 2, 1 << 30).alias("text"))
    found = secrets(tagged)
    return found.select("ord.commit_hash", "ord.commit_date", *(c for c in found.columns if c != "ord"))
