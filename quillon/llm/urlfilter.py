"""URL filters by a trie over reversed host labels and path segments (operator 9).

A rule has a host and a path; it fits its host and all subdomains if the url's path starts with the rule's.  The trie
first descends by host labels from the right, then by path segments from the left; a rule that doesn't end with a
segment (``/en`` also fits ``/english``) sits as a partial entry at the node before.  Each node passed on the way may
hold a verdict, and the one whose rule is longest (host and path together) wins, a block before an allow.

The trie is built once and sent to every task; ``most`` bounds its rules and ``TRIE_BYTES`` what their nodes may take.  A larger
list is cut into tries within these bounds, which are applied one after the other, the longest match being kept.

Null urls, and those without ``://``, have an empty host and path; they and urls without a host are blocked, others
without a rule get ``default``.  A host is what stands between ``://`` and the next ``/``, ``?``, ``#`` or the end, with
a port or user name if there is one, in lower case for A-Z; the path is what follows up to ``?``, ``#`` or the end.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm.rows import bounded, fresh, read

ALLOW, BLOCK = "allow", "block"
RULES = [(ALLOW, "com", "/"), (BLOCK, "example.com", "/en/"), (ALLOW, "www.example.com", "/en/"), (BLOCK, "net", "/es/"), (BLOCK, "net", "/fr/")]
MOST = 1_000_000
#: Bytes of a trie, counted as ``NODE`` for each label, segment and rule at most, and the characters of the rules.
TRIE_BYTES, NODE = 256 << 20, 300


class Trie:
    """Nodes are dicts: host labels, and under the key "" the root of the paths below that host.

    In a path node the key None holds partial entries: (verdict, rule, start of the next segment).
    """

    def __init__(self, rules: list[tuple[str, str, str]]):
        self.root: dict = {}
        for verdict, host, path in rules:
            node = self.root
            for label in reversed(host.split(".")):
                node = node.setdefault(label, {})
            node = node.setdefault("", {})
            *whole, rest = path.split("/")
            for segment in whole:
                node = node.setdefault(segment, {})
            node.setdefault(None, []).append((verdict, host + path, rest))

    def find(self, host: str, path: str) -> tuple[str | None, str | None]:
        """(verdict, rule) of the longest rule that fits."""
        best: tuple[int, bool, str] | None = None
        node = self.root
        segments = path.split("/")
        for label in reversed(host.split(".")):
            node = node.get(label)
            if node is None:
                break
            below = node.get("")
            for segment in segments:
                if below is None:
                    break
                for verdict, rule, rest in below.get(None, ()):
                    if segment.startswith(rest):
                        best = max(best or (-1, False, ""), (len(rule), verdict == BLOCK, rule))
                below = below.get(segment)
        if best is None:
            return None, None
        return (BLOCK if best[1] else ALLOW), best[2]


def host_of(url: Column) -> Column:
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def _finder(spark: SparkSession, trie: Trie):
    shared = spark.sparkContext.broadcast(trie)

    @F.pandas_udf("verdict string, rule string")
    def find(host: pd.Series, path: pd.Series) -> pd.DataFrame:
        t = shared.value
        return pd.DataFrame([t.find(h, p) for h, p in zip(host, path, strict=True)], columns=["verdict", "rule"], dtype=object)

    return find


def _parts(rules: list[tuple[str, str, str]], most: int, most_bytes: int = TRIE_BYTES) -> list[list[tuple[str, str, str]]]:
    """The rules in lists of at most so many rules and bytes, at least one list."""
    parts: list[list[tuple[str, str, str]]] = [[]]
    held = 0
    for rule in rules:
        _, host, path = rule
        size = NODE * (host.count(".") + path.count("/") + 3) + 2 * len(host + path)
        if parts[-1] and (len(parts[-1]) >= most or held + size > most_bytes):
            parts.append([])
            held = 0
        parts[-1].append(rule)
        held += size
    return parts


def judge(df: DataFrame, rules: list[tuple[str, str, str]], url: str = "url", default: str = ALLOW, most: int = MOST) -> DataFrame:
    """df with a struct (host, path, rule, verdict), named ``filtered`` or, if that is taken, with underscores."""
    bounded(df.sparkSession)
    out = fresh(df, "filtered")
    made = df.withColumn(out, F.struct(host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path")))
    match = None
    for part in _parts(rules, most):
        one = _finder(df.sparkSession, Trie(part))(F.col(f"{out}.host"), F.col(f"{out}.path"))
        if match is None:
            match = one
        else:
            # Longest first; on a tie a block, which sorts after an allow.
            match = F.when(F.coalesce(F.length(one.rule), F.lit(-1)) > F.coalesce(F.length(match.rule), F.lit(-1)), one).when((F.length(one.rule) == F.length(match.rule)) & (one.verdict == BLOCK), one).otherwise(match)
    at = fresh(made, "match")
    made = made.withColumn(at, match)
    verdict = F.coalesce(F.col(at).verdict, F.when(F.col(out).host == "", F.lit(BLOCK)).otherwise(F.lit(default)))
    return made.withColumn(out, F.col(out).withField("rule", F.col(at).rule).withField("verdict", verdict)).drop(at)


def op9_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict on the url of every page, as the module says.

    Null and empty urls, and those without a host, are blocked by the method; a null page_id stays null; rows with one id and
    repeated rows are judged each; urls of any length are judged whole; two rules of one length: a block wins; an empty table gives no rows; other
    columns aren't read.
    """
    return judge(read(spark, sf_dir, "pages", "page_id", "url"), RULES).select("page_id", "filtered.*")


_VALUES = ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in RULES)
OP9_SQL = f"""
WITH r(verdict, host, path) AS (VALUES {_VALUES}),
u AS (SELECT page_id, coalesce(url, '') AS url, row_number() OVER () AS k FROM pages),
p AS (SELECT k, page_id, translate(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's') AS path FROM u),
m AS (SELECT p.k, r.verdict, r.host || r.path AS rule FROM p JOIN r ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path)),
b AS (SELECT k, arg_max(struct_pack(verdict := verdict, rule := rule), length(rule) * 2 + (verdict = 'block')::int) AS best FROM m GROUP BY k)
SELECT page_id, host, path, best.rule AS rule, coalesce(best.verdict, CASE WHEN host = '' THEN 'block' ELSE 'allow' END) AS verdict
FROM p LEFT JOIN b USING (k)
"""
