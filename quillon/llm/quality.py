"""Quality rules from suffix arrays (operator 8).

For every text a suffix array of its words (Larsson-Sadakane) and their common prefixes (Kasai) give, at each word, the
longest run that starts there and occurs elsewhere in the text: the union of these runs is that of all maximal repeated
substrings.  A text is rejected when they cover more than ``max_covered`` of its words or one is longer than
``max_longest`` words; and, as base rules, when it has fewer than ``min_words`` words or more than ``max_repeat_percent``
of its words lie in windows of ``window`` words that occur twice.

Null and empty texts have no words, all counts 0, and fail the base rules.  Repeated rows are judged alike; other columns
play no part.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm.bytesets import SPACE, owner, per_text, prefix, span_hash, words
from quillon.llm.rows import annotate, fresh, read
from quillon.llm.suffix import common_prefixes, suffix_array

FIELDS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_covered long, longest_repeat long"
_SYMBOL = np.zeros(256, bool)
_SYMBOL[np.frombuffer(b"#*$%&|<>", np.uint8)] = True


def _marked(n: int, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Which of n positions lie in a span."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, start, 1)
    np.add.at(edge, start + length, -1)
    return np.cumsum(edge[:n]) > 0


def measure(off: np.ndarray, data: np.ndarray, window: int = 8, min_repeat: int = 5) -> list[np.ndarray]:
    """The values of FIELDS for a block of texts."""
    n = len(off) - 1
    start, end, doc = words(off, data)
    s = prefix(data)
    h = span_hash(s, start, end)
    first_byte = (data & 0xC0) != 0x80
    chars = np.flatnonzero(first_byte & ~SPACE[data])
    n_chars = per_text(n, owner(off, chars))
    n_symbols = per_text(n, owner(off, np.flatnonzero(_SYMBOL[data])))
    # Lines: between bounds of texts and newlines; only those with a word count.
    stop = np.flatnonzero(data == 10)
    bound = np.unique(np.r_[off, stop + 1])
    a = bound[:-1]
    b = bound[1:] - (data[bound[1:] - 1] == 10) if len(bound) > 1 else a
    has = np.searchsorted(start, b) > np.searchsorted(start, a)
    a, b = a[has], b[has]
    line, of = span_hash(s, a, b), owner(off, a)
    order = np.lexsort((line, of))
    same = (line[order][1:] == line[order][:-1]) & (of[order][1:] == of[order][:-1])
    n_dup = per_text(n, of[order][1:][same])
    # Repeats: at each word the longest prefix shared with a neighbour in the suffix array.
    m = len(h)
    sa, _ = suffix_array(h, doc)
    lcp = common_prefixes(h, doc, sa)
    longest = np.zeros(m, np.int64)
    if m:
        longest[sa] = np.maximum(lcp, np.r_[lcp[1:], 0])
    at = np.flatnonzero(longest >= window)
    n_repeat = per_text(n, doc[_marked(m, at, np.full(len(at), window))])
    at = np.flatnonzero(longest >= min_repeat)
    n_covered = per_text(n, doc[_marked(m, at, longest[at])])
    top = np.zeros(n, np.int64)
    np.maximum.at(top, doc[at], longest[at])
    return [per_text(n, doc), n_chars, n_symbols, n_dup, n_repeat, n_covered, top]


def judge(df: DataFrame, text: str = "text", keep: list[str] | None = None, min_words: int = 20, window: int = 8, max_repeat_percent: int = 30, min_repeat: int = 5, max_covered: float = 0.4, max_longest: int = 100) -> tuple[DataFrame, str]:
    """The columns ``keep`` (all by default) and a struct with FIELDS, covered, base_failed and kept; and the struct's name."""
    keep = df.columns if keep is None else keep
    out = fresh(df, "quality")
    made = annotate(df, text, lambda off, data: measure(off, data, window, min_repeat), FIELDS, keep, out)
    q = F.col(out)
    failed = (q.n_words < min_words) | (100 * q.n_repeat_words > max_repeat_percent * q.n_words)
    covered = F.when(q.n_words > 0, q.n_covered / q.n_words).otherwise(0.0)
    kept = ~failed & (covered <= max_covered) & (q.longest_repeat <= max_longest)
    return made.withColumn(out, q.withField("covered", covered).withField("base_failed", failed).withField("kept", kept)), out


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counts and verdict of every document, as the module says.

    Null and empty texts have no words and fail; a null doc_id stays null; rows with one id and repeated rows are judged each; whole
    texts count, whatever their length; an empty table gives no rows; other columns aren't read.
    """
    made, q = judge(read(spark, sf_dir, "documents", "doc_id", "text"), keep=["doc_id"])
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_covered", "covered", "longest_repeat"]
    return made.select("doc_id", *(F.col(f"{q}.{c}").alias(c) for c in names))


#: Runs of five words or more that occur elsewhere in the text cover the words of five-word windows found twice or more; the longest is
#: the longest run of equal windows at a fixed distance.
OP8_SQL = r"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS MATERIALIZED (SELECT k, len(w) AS n, i, CASE WHEN i + 4 <= len(w) THEN array_to_string(w[i:i + 4], ' ') END AS g5, CASE WHEN i + 7 <= len(w) THEN array_to_string(w[i:i + 7], ' ') END AS g8 FROM (SELECT k, w, unnest(range(1, len(w) + 1)) AS i FROM d)),
m AS (SELECT k, n, i, g5 IS NOT NULL AND count(*) OVER (PARTITION BY k, g5) > 1 AS r5, g8 IS NOT NULL AND count(*) OVER (PARTITION BY k, g8) > 1 AS r8 FROM g),
c AS (SELECT k, i, coalesce(bool_or(r5) OVER (PARTITION BY k ORDER BY i ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), false) AS c5, coalesce(bool_or(r8) OVER (PARTITION BY k ORDER BY i ROWS BETWEEN 7 PRECEDING AND CURRENT ROW), false) AS c8 FROM m),
s AS (SELECT k, count(*) FILTER (c8) AS n_repeat_words, count(*) FILTER (c5) AS n_covered FROM c GROUP BY k),
q AS (SELECT a.k, b.i - a.i AS far, a.i - row_number() OVER (PARTITION BY a.k, b.i - a.i ORDER BY a.i) AS run FROM g a JOIN g b ON a.k = b.k AND a.g5 = b.g5 AND a.i < b.i),
l AS (SELECT k, max(size) + 4 AS longest_repeat FROM (SELECT k, count(*) AS size FROM q GROUP BY k, far, run) GROUP BY k),
y AS (SELECT k, sum(n - 1) AS n_dup_lines FROM (SELECT k, line, count(*) AS n FROM (SELECT k, unnest(string_split(text, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY k, line) GROUP BY k),
x AS (SELECT k, doc_id, len(w)::bigint AS n_words, length(array_to_string(w, ''))::bigint AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::bigint AS n_symbols FROM d),
z AS (SELECT doc_id, n_words, coalesce(word_chars, 0) AS word_chars, n_symbols, coalesce(n_dup_lines, 0)::bigint AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(n_covered, 0) AS n_covered, coalesce(longest_repeat, 0)::bigint AS longest_repeat
  FROM x LEFT JOIN s USING (k) LEFT JOIN y USING (k) LEFT JOIN l USING (k)),
v AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed, CASE WHEN n_words > 0 THEN n_covered / n_words ELSE 0.0::double END AS covered FROM z)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND covered <= 0.4 AND longest_repeat <= 100 AS kept, n_covered, covered, longest_repeat FROM v
"""
