"""Lines against rules."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.functions.text import fingerprint, trimmed
from quillon.sources.rules import RULES, Rule, checked, rules_frame

FINDING = ("ord", "file_path", "language", "line", "line_content", "rule_id", "severity", "category", "cwe_id", "message", "remediation", "confidence", "source", "fingerprint")
#: Rules of one plan at most; a larger catalog is matched in slices.
SLICE = 400


def condition(rule: Rule, text: Column, low: Column, language: Column) -> Column:
    """Language first, then the anchors, then the pattern."""
    anchored = reduce(lambda a, b: a | b, (F.contains(low, F.lit(a)) for a in rule.anchors))
    hit = anchored & text.rlike(rule.pattern)
    return hit if "*" in rule.languages else language.isin(*rule.languages) & hit


def findings(lines: DataFrame, rules: list[Rule] | None = None) -> DataFrame:
    """One row for each line and rule that matches (at most one each), with the rule's attributes.

    Rules unroll into one expression over the line, so lines are read once and nothing is shuffled; attributes come from the
    small catalog by an equi-join on its row number.
    """
    rules = checked(RULES if rules is None else rules)
    spark = lines.sparkSession
    text, low = F.col("text"), F.col("low")
    out = None
    lines = lines.withColumn("low", F.lower("text"))
    for i in range(0, max(1, len(rules)), SLICE):
        part = rules[i : i + SLICE]
        hits = F.array_compact(F.array(F.lit(None).cast("int"), *(F.when(condition(r, text, low, F.col("language")), F.lit(n)) for n, r in enumerate(part))))
        # An outer explode: from an inner one, or from a filter on the hits, the optimizer makes a filter with all patterns in it, beside the projection.
        hit = lines.select("ord", "file_path", "language", "line", "text", hits.alias("hits")).select("ord", "file_path", "language", "line", "text", F.explode_outer("hits").alias("rule_no"))
        hit = hit.where("rule_no is not null").select("ord", "file_path", "language", "line", trimmed(text).alias("line_content"), "rule_no")
        table = rules_frame(spark, part).drop("languages", "anchors", "pattern", "match_scope")
        found = hit.join(F.broadcast(table), "rule_no").drop("rule_no")
        out = found if out is None else out.unionByName(found)
    return out.select(
        "ord", "file_path", "language", "line", "line_content", "rule_id", "severity", "category", "cwe_id", "message", "remediation",
        F.lit("medium").alias("confidence"), F.lit("compatibility").alias("source"), fingerprint(F.col("rule_id"), F.col("file_path"), F.col("line_content")).alias("fingerprint"),
    )
