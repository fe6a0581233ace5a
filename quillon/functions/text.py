"""Functions of source text and detected values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Languages by the ending of a file's name; only the first three have rules of their own.
LANGUAGES = {
    "js": "javascript", "jsx": "javascript", "mjs": "javascript", "cjs": "javascript", "ts": "typescript", "tsx": "typescript", "mts": "typescript", "cts": "typescript", "py": "python", "pyw": "python",
    "go": "go", "java": "java", "rb": "ruby", "php": "php", "rs": "rust", "cs": "csharp", "c": "c", "h": "c", "cpp": "cpp", "hpp": "cpp", "kt": "kotlin", "swift": "swift", "sh": "shell", "yml": "yaml", "yaml": "yaml", "json": "json", "tf": "terraform",
}


def trimmed(text: Column) -> Column:
    """White space off both ends."""
    return F.regexp_replace(text, r"\A\s+|\s+\z", "")


def language(path: Column) -> Column:
    ending = F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))
    table = F.create_map(*(F.lit(x) for pair in LANGUAGES.items() for x in pair))
    return F.coalesce(F.try_element_at(table, ending), F.lit("unknown"))


def entropy(value: Column) -> Column:
    """Shannon's, in bits a character; 0 for an empty value."""
    chars = F.regexp_extract_all(value, F.lit("(?s)."), F.lit(0))
    n = F.size(chars)
    counts = F.transform(F.array_distinct(chars), lambda c: F.size(F.filter(chars, lambda x: x == c)))
    bits = F.aggregate(counts, F.lit(0.0), lambda acc, k: acc - (k / n) * F.log2(k / n))
    return F.when(n > 0, bits).otherwise(F.lit(0.0))


def redacted(value: Column, shown: int = 4) -> Column:
    """The first characters and the length; the rest is masked."""
    return F.concat(F.substring(value, 1, shown), F.lit("...["), F.length(value).cast("string"), F.lit("]"))


def fingerprint(*parts: Column) -> Column:
    """A stable digest that shows none of its parts."""
    return F.sha2(F.concat_ws("|", *(F.coalesce(p.cast("string"), F.lit("")) for p in parts)), 256)
