"""Comparison of dotted versions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Digits of one part that count; a longer part is no number, and 0.
DIGITS = 38


def parsed(version: Column) -> Column:
    """Numbers without the zeros at their end, and a mark: a leading v and what follows + are dropped, pre-releases sort first."""
    core = F.regexp_replace(F.split(version, r"\+")[0], "^[vV=]", "")
    main = F.split(F.split(core, "-")[0], r"\.")
    numbers = F.transform(main, lambda x: F.coalesce(F.regexp_extract(x, rf"^(\d{{1,{DIGITS}}})(?!\d)", 1).try_cast(f"decimal({DIGITS},0)"), F.lit(0).cast(f"decimal({DIGITS},0)")))
    last = F.array_max(F.transform(numbers, lambda x, i: F.when(x > 0, i + 1).otherwise(0)))
    return F.struct(F.slice(numbers, F.lit(1), last).alias("numbers"), F.when(F.contains(core, F.lit("-")), F.lit(0)).otherwise(F.lit(1)).alias("released"))


def before(a: Column, b: Column) -> Column:
    """Whether version a is older than version b; null if one is null."""
    return F.when(a.isNotNull() & b.isNotNull(), parsed(a) < parsed(b))


def sort_key(version: Column) -> Column:
    """Text that sorts, byte by byte, as versions do: each number after its count of digits, then a mark below any digit; null for null."""
    parts = parsed(version)
    numbers = F.transform(parts["numbers"], lambda x: F.concat(F.lpad(F.length(x.cast("string")).cast("string"), 2, "0"), x.cast("string")))
    return F.when(version.isNotNull(), F.concat(F.array_join(numbers, ""), F.lit("!"), parts["released"].cast("string")))
