"""From texts to numbered lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.functions.text import language


def units(df: DataFrame, path: Column, text: Column, ordinal: Column | None = None) -> DataFrame:
    """(ord, file_path, language, text): what a scan reads, one row a file; ``ord`` orders files."""
    ordinal = F.monotonically_increasing_id() if ordinal is None else ordinal
    return df.select(ordinal.cast("long").alias("ord"), path.alias("file_path"), language(path).alias("language"), text.alias("text"))


def first_files(files: DataFrame, most: int | None) -> DataFrame:
    """At most so many files, in the order of their paths; taken before any text is split."""
    return files if most is None else files.orderBy("file_path", "ord").limit(most)


def split_lines(files: DataFrame) -> DataFrame:
    """(ord, file_path, language, line, text): lines count from 1 and end at LF or CRLF; a null text has none."""
    return files.select("ord", "file_path", "language", F.posexplode(F.split("text", r"\r?\n", -1)).alias("at", "text")).select("ord", "file_path", "language", (F.col("at") + 1).alias("line"), "text")
