"""Secrets in lines: extraction, entropy, redaction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.functions.text import entropy, fingerprint, redacted

#: secret type, pattern, group of the value, severity, CWE.
DETECTORS = [
    ("cloud_access_key", r"\bAKIA[0-9A-Z]{16}\b", 0, "critical", "CWE-798"),
    ("assigned_secret", r"""(?i:secret|token|passw(?:or)?d|api_?key)["']?\s*[:=]\s*["']([^"'\s]{8,})["']""", 1, "high", "CWE-798"),
    ("private_key", r"-----BEGIN (?:[A-Z]+ )?PRIVATE KEY-----", 0, "critical", "CWE-321"),
]


def secrets(lines: DataFrame, least_entropy: float = 0.0) -> DataFrame:
    """A row for each value that a detector finds, with its entropy; the value itself is not in the result."""
    out = None
    for kind, pattern, group, severity, cwe in DETECTORS:
        hit = lines.where(F.col("text").rlike(pattern)).select("ord", "file_path", "line", F.explode(F.regexp_extract_all("text", F.lit(pattern), F.lit(group))).alias("value"))
        hit = hit.select("ord", "file_path", "line", F.lit(kind).alias("secret_type"), F.lit(severity).alias("severity"), F.lit(cwe).alias("cwe_id"), F.lit("secret-detector").alias("source"), F.round(entropy(F.col("value")), 6).alias("entropy_score"), redacted(F.col("value")).alias("line_content"), fingerprint(F.lit(kind), F.col("file_path"), F.col("value")).alias("fingerprint"))
        out = hit if out is None else out.unionByName(hit)
    return out.where(F.col("entropy_score") >= least_entropy) if least_entropy > 0 else out
