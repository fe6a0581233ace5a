"""Severities, from the gravest down."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SEVERITIES = ("critical", "high", "medium", "low", "info")


def known(severity: str) -> str:
    if severity not in SEVERITIES:
        raise ValueError(f"unknown severity {severity!r}; use one of {', '.join(SEVERITIES)}")
    return severity


def rank(severity: Column) -> Column:
    """4 for critical down to 0 for info; null for anything else."""
    out = F.lit(None).cast("int")
    for i, s in enumerate(reversed(SEVERITIES)):
        out = F.when(severity == s, F.lit(i)).otherwise(out)
    return out


def at_least(severity: Column, least: str) -> Column:
    return rank(severity) >= len(SEVERITIES) - 1 - SEVERITIES.index(known(least))


def counts(severity: Column) -> list[Column]:
    """Five counts, zero where there is none."""
    return [F.count_if(severity == s).alias(s) for s in SEVERITIES]
