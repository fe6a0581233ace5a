"""The line scan over a stream: it keeps no state, so the batch plan serves; sums by window need a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.operators.lines import split_lines
from quillon.operators.match import findings


def stream_findings(files: DataFrame, rules=None) -> DataFrame:
    """Findings of a stream of files (ord, file_path, language, text)."""
    return findings(split_lines(files), rules)


def windowed_counts(found: DataFrame, at: str, late: str = "10 minutes", width: str = "5 minutes") -> DataFrame:
    """Findings by severity in windows of the time column ``at``; rows later than ``late`` are dropped."""
    return found.withWatermark(at, late).groupBy(F.window(at, width), "severity").agg(F.count("*").alias("n"))
