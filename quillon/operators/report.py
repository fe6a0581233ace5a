"""Findings by file, ranked, and their sums."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon.functions.severity import SEVERITIES, counts


def by_file(found: DataFrame, listed: bool = False) -> DataFrame:
    """(file_path, language, first_ord, total_findings, five counts) of files that have a finding; ``listed`` adds them in order."""
    more = [F.array_sort(F.collect_list(F.struct("ord", "line", "rule_id", "severity", "category", "cwe_id", "message", "line_content", "remediation", "confidence", "source", "fingerprint"))).alias("findings")] if listed else []
    return found.groupBy("file_path").agg(F.first("language").alias("language"), F.min("ord").alias("first_ord"), F.count("*").alias("total_findings"), *counts(F.col("severity")), *more)


def _order():
    return F.desc("critical"), F.desc("high"), F.desc("total_findings"), F.asc("first_ord"), F.asc("file_path")


def ordered(files: DataFrame) -> DataFrame:
    """The gravest files first: a distributed sort; ties keep the order in which files were first seen."""
    return files.orderBy(*_order())


def top(files: DataFrame, n: int) -> DataFrame:
    """The n gravest files with their rank; each task keeps n, so nothing more is gathered."""
    few = files.orderBy(*_order()).limit(n)
    return few.withColumn("rank", F.row_number().over(Window.orderBy(*_order())))


def ranked(files: DataFrame) -> DataFrame:
    """All files with their rank.

    Counts repeat much, so ranks come from their distinct triples: a small table is ordered, and within a triple
    files are numbered by first sight.
    """
    triple = ["critical", "high", "total_findings"]
    groups = files.groupBy(*triple).agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy(*(F.desc(c) for c in triple)).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    groups = groups.select(*triple, before.alias("before"))
    within = F.row_number().over(Window.partitionBy(*triple).orderBy("first_ord", "file_path"))
    return files.join(groups, triple).withColumn("rank", F.col("before") + within).drop("before")


def summary(found: DataFrame) -> DataFrame:
    """One row of five counts, zeros if there is no finding."""
    return found.agg(*counts(F.col("severity")))


def rollup(found: DataFrame, key: str) -> DataFrame:
    return found.groupBy(key).agg(F.count("*").alias("total_findings"), F.countDistinct("file_path").alias("files"), *counts(F.col("severity")))


def envelope(found: DataFrame, files: DataFrame) -> DataFrame:
    """One row of a scan's sums; ``files`` are those scanned.  A file is skipped if its text is null.

    Findings count by ``copies``, if they have it.  With a boolean ``known``, those are left out and make ``suppressed_findings``.
    """
    scanned = files.agg(F.count_if(F.col("text").isNotNull()).alias("files_scanned"), F.count_if(F.col("text").isNull()).alias("files_skipped"))
    copies, is_known = F.col("copies") if "copies" in found.columns else F.lit(1).cast("long"), F.col("known") if "known" in found.columns else F.lit(False)
    n = lambda which: F.coalesce(F.sum(F.when(which, copies)), F.lit(0).cast("long"))
    less = [n(is_known).alias("suppressed_findings")] if "known" in found.columns else []
    sums = found.agg(F.countDistinct(F.when(~is_known, F.col("file_path"))).alias("files_with_findings"), n(~is_known).alias("total_findings"), *(n(~is_known & (F.col("severity") == s)).alias(s) for s in SEVERITIES), *less)
    one = F.lit(1).alias("one")
    return scanned.select(one, "*").join(sums.select(one, "*"), "one").drop("one")


def with_cwe(found: DataFrame, cwe: DataFrame) -> DataFrame:
    """Findings with what the knowledge base says of their weakness; unknown ones stay, with nulls."""
    return found.join(cwe.withColumnRenamed("id", "cwe_id"), "cwe_id", "left")


