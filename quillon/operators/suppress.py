"""What keeps findings out of a report."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.functions.severity import at_least, known


@dataclass
class Config:
    """Settings of a scan; the severities are None where nothing is asked for."""

    ignore_paths: list[str] = field(default_factory=list)
    ignore_rules: list[str] = field(default_factory=list)
    minimum_severity: str | None = None
    fail_on_severity: str | None = None
    offline: bool = True

    def __post_init__(self):
        for s in (self.minimum_severity, self.fail_on_severity):
            if s is not None:
                known(s)


def threshold(df: DataFrame, least: str | None) -> DataFrame:
    """Rows at or above a severity; those of unknown severity go."""
    return df if least is None else df.where(at_least(F.col("severity"), least))


def without_paths(df: DataFrame, paths: list[str]) -> DataFrame:
    """Rows outside the given files and directories; works on files before their text is split, too."""
    for p in paths:
        p = p.rstrip("/")
        df = df.where(F.col("file_path").isNull() | ~((F.col("file_path") == p) | F.col("file_path").startswith(p + "/")))
    return df


def without_rules(df: DataFrame, rules: list[str]) -> DataFrame:
    return df.where(~F.col("rule_id").isin(*rules)) if rules else df


def baseline(df: DataFrame, known_ones: DataFrame) -> DataFrame:
    """Rows whose fingerprint isn't in the baseline."""
    return df.join(known_ones.select("fingerprint").distinct(), "fingerprint", "left_anti")


def suppressed(df: DataFrame, known_ones: DataFrame) -> DataFrame:
    """Rows that a baseline takes away."""
    return df.join(known_ones.select("fingerprint").distinct(), "fingerprint", "left_semi")


def marked(df: DataFrame, known_ones: DataFrame) -> DataFrame:
    """All rows, with whether a baseline takes them away in ``known``; rows without a fingerprint are never known."""
    gone = known_ones.select("fingerprint").distinct().withColumn("known", F.lit(True))
    return df.join(gone, "fingerprint", "left").withColumn("known", F.coalesce("known", F.lit(False)))


def deduplicated(df: DataFrame) -> DataFrame:
    """The first row of each fingerprint, by ``ord`` and line: a minimum per key, combined before the shuffle."""
    rest = [c for c in df.columns if c not in ("ord", "line", "fingerprint")]
    first = df.groupBy("fingerprint").agg(F.min(F.struct("ord", "line", *rest)).alias("r"))
    return first.select("fingerprint", "r.*").select(*df.columns)


def failing(df: DataFrame, least: str) -> DataFrame:
    """One row: how many findings are at or above a severity, and whether that fails a build."""
    n = F.count_if(at_least(F.col("severity"), least))
    return df.agg(n.alias("failing"), (n > 0).alias("failed"))


def configured(df: DataFrame, config: Config) -> DataFrame:
    return threshold(without_rules(without_paths(df, config.ignore_paths), config.ignore_rules), config.minimum_severity)
