"""Secret scans by linking the parts of credentials (operator 1), in DataFrame operations only.

Strong parts are reported wherever they are: an assignment to a secret's name (``assign``), an access identifier
(``access``) and a long run of hexadecimal digits (``hex``).  Weak parts could be anything: a user or client name
(``user``), a short assigned value (``short``), a long mixed token (``blob``), a host or url (``endpoint``).  They are reported
only when complementary parts co-occur in their scope, ``reach`` characters around them in the same text:

* an identifier (user) beside a secret (assign, hex, short, blob) and a secret (short, blob) beside an identifier (access, user),
* an endpoint beside both.

Weak parts that overlap a strong one are that strong one's.  The interval join keeps, along each text, the furthest end
before and the nearest start after of each role, so no pairs are made and a part is handled in constant time.

Offsets count code points, ends are exclusive.  Null text counts as empty; repeated rows each give a row; a null id stays
null.  Only lengths of parts, not texts, are shuffled.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillon.llm.rows import fresh, read

_TO = r"""["']?\x20*[:=]\x20*["']?"""
#: kind, pattern, group of the value, least length of the value.
PATTERNS = [
    ("assign", r"""(?i:(password|passwd|secret|token|api_?key))""" + _TO + r"""([A-Za-z0-9+/_.=-]+)""", 2, 12),
    ("access", r"AKIA[A-Z0-9]{14,}", 0, 18),
    ("hex", r"[0-9a-f]{16,}", 0, 16),
    ("user", r"(?i:(user_?name|user|login|client_?id|account_?id|key_?id))" + _TO + r"([A-Za-z0-9_.@+-]+)", 2, 3),
    ("short", r"""(?i:(password|passwd|secret|token|api_?key|pwd|pass))""" + _TO + r"""([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("blob", r"[A-Za-z0-9+/]{32,}", 0, 32),
    ("endpoint", r"(?i:(https?|ftp|jdbc|postgres|mysql|mongodb|redis|amqp|host|endpoint|server))(?:://|" + _TO + r")([A-Za-z0-9][A-Za-z0-9.-]*\.[A-Za-z0-9.:/_-]+)", 2, 4),
]
#: What a text in lower case has one of if a kind's pattern matches: a quick test before the regular expression.
ANCHORS = {
    "assign": ("passw", "secret", "token", "apikey", "api_key"), "access": ("akia",), "user": ("user", "login", "clientid", "client_id", "accountid", "account_id", "keyid", "key_id"),
    "short": ("pass", "secret", "token", "apikey", "api_key", "pwd"), "endpoint": ("http", "ftp", "jdbc", "postgres", "mysql", "mongodb", "redis", "amqp", "host", "endpoint", "server"),
}
#: A pattern that a text has a match of if and only if it has one of the kind's; it doesn't try again inside a run.
TESTS = {"blob": "(?<![A-Za-z0-9+/])[A-Za-z0-9+/]{32}"}
BASE = 3
REACH = 200
#: Roles of kinds, by number: identifiers, secrets.
_IDENTIFIERS, _SECRETS = (1, 3), (0, 2, 4, 5)


def _hits(text: Column, low: Column, number: int) -> Column:
    """Each match of a kind, as text; none where its anchors are missing."""
    kind, pattern, _, _ = PATTERNS[number]
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    if kind in TESTS:
        return F.when(text.rlike(TESTS[kind]), hits)
    if kind not in ANCHORS:
        return hits
    assigned = F.contains(text, F.lit("=")) | F.contains(text, F.lit(":")) if kind != "access" else F.lit(True)
    return F.when(assigned & reduce(lambda a, b: a | b, (F.contains(low, F.lit(x)) for x in ANCHORS[kind])), hits)


def _found(text: Column, hits: Column, number: int) -> Column:
    """Each match of a kind, with the length of what lies between it and the match before; lengths in code points.

    No pattern looks beyond its match, so the value is found again in the match alone.
    """
    kind, pattern, group, _ = PATTERNS[number]
    zipped = F.arrays_zip(F.slice(F.split(text, pattern, -1), F.lit(1), F.size(hits)).alias("gap"), hits.alias("hit"))
    value = (lambda x: F.regexp_extract(x, pattern, group)) if group else lambda x: x
    mixed = lambda x: x.rlike("[0-9]") & x.rlike("[A-Z]") & x.rlike("[a-z]") if kind == "blob" else F.lit(True)
    rows = F.transform(zipped, lambda z, i: F.struct(F.lit(number).alias("kind"), i.alias("i"), F.length(z.gap).alias("gap"), F.length(z.hit).alias("hit"), F.when(mixed(z.hit), F.length(value(z.hit))).otherwise(0).alias("value")))
    empty = F.array().cast("array<struct<kind:int,i:int,gap:int,hit:int,value:int>>")
    return F.when(F.size(hits) > 0, rows).otherwise(empty)


def parts(df: DataFrame, row: str, text: str, carried: list[str], reach: int = REACH) -> DataFrame:
    """A line for each reported part (kind, start, end, value) of each text, and one with null kind for each row.

    ``row`` names rows apart; the columns ``carried`` are on the line with null kind only.
    """
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    low = fresh(df, "low")
    df = df.withColumn(low, F.lower(t))
    names = {k: fresh(df, f"hits{k}") for k in range(len(PATTERNS))}
    df = df.select(row, *dict.fromkeys([*carried, text]), *(_hits(t, F.col(low), k).alias(n) for k, n in names.items()))
    own = F.array(F.lit(None).cast("struct<kind:int,i:int,gap:int,hit:int,value:int>"))
    lines = df.select(row, *carried, F.posexplode(F.concat(own, *(_found(t, F.col(n), k) for k, n in names.items()))).alias("nth", "p"))
    lines = lines.select(row, *(F.when(F.col("nth") == 0, F.col(c)).alias(c) for c in carried), "p.*").repartition(row)
    along = Window.partitionBy(row, "kind").orderBy("i")
    end = F.sum(F.col("gap") + F.col("hit")).over(along.rowsBetween(Window.unboundedPreceding, 0))
    least = F.element_at(F.array(*(F.lit(p[3]) for p in PATTERNS)), F.col("kind") + 1)
    lines = lines.withColumn("end", end).withColumn("start", F.col("end") - F.col("hit")).where(F.col("kind").isNull() | (F.col("value") >= least))
    by = Window.partitionBy(row).orderBy(F.col("start").asc_nulls_first(), "kind", "end")
    before, after = by.rowsBetween(Window.unboundedPreceding, -1), by.rowsBetween(1, Window.unboundedFollowing)

    def near(kinds: tuple[int, ...]) -> Column:
        mine = F.col("kind").isin(*kinds)
        last, first = F.max(F.when(mine, F.col("end"))).over(before), F.min(F.when(mine, F.col("start"))).over(after)
        return F.coalesce(last >= F.col("start") - reach, F.lit(False)) | F.coalesce(first <= F.col("end") + reach, F.lit(False))

    strong = F.col("kind") < BASE
    covered = F.coalesce(F.max(F.when(strong, F.col("end"))).over(before) > F.col("start"), F.lit(False)) | F.coalesce(F.min(F.when(strong, F.col("start"))).over(after) < F.col("end"), F.lit(False))
    lines = lines.withColumn("by_id", near(_IDENTIFIERS)).withColumn("by_secret", near(_SECRETS)).withColumn("covered", covered)
    k = F.col("kind")
    linked = F.when(k == 3, F.col("by_secret")).when(k.isin(4, 5), F.col("by_id")).otherwise(F.col("by_id") & F.col("by_secret"))
    return lines.where(k.isNull() | strong | (~F.col("covered") & linked)).select(row, *carried, "kind", "start", "end", "value")


def _listed(spans: Column) -> Column:
    names = F.array(*(F.lit(p[0]) for p in PATTERNS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s.kind + 1), s.start.cast("string"), s.end.cast("string"))), ",")


def scan(df: DataFrame, text: str = "text", keep: list[str] | None = None, reach: int = REACH) -> tuple[DataFrame, str]:
    """The columns ``keep`` (all by default) and an array ``found`` of the reported parts in order (start, kind, end, value)."""
    keep = df.columns if keep is None else keep
    out = fresh(df, "found")
    # Names of our own, so that no column of df can clash.
    held = {c: f"c{i}" for i, c in enumerate(keep)}
    narrow = df.select(F.monotonically_increasing_id().alias("row"), F.col(text).alias("t"), *(F.col(c).alias(h) for c, h in held.items()))
    lines = parts(narrow, "row", "t", list(held.values()), reach)
    own = F.col("kind").isNull()
    made = lines.groupBy("row").agg(*(F.first(F.when(own, F.struct(h)), ignorenulls=True).getField(h).alias(h) for h in held.values()), F.sort_array(F.collect_list(F.when(~own, F.struct("start", "kind", "end", "value")))).alias(out))
    return made.select(*(F.col(h).alias(c) for c, h in held.items()), out), out


def redact(df: DataFrame, text: str = "text", mark: str = "[SECRET]", reach: int = REACH) -> DataFrame:
    """df with the value of every reported part but endpoints replaced by ``mark``; null texts stay null."""
    made, found = scan(df, text, reach=reach)
    spans = F.transform(F.filter(F.col(found), lambda s: s.kind != 6), lambda s: F.struct((s.end - s.value).alias("a"), s.end.alias("b")))
    # Overlapping values have one mark.
    state = F.aggregate(
        F.sort_array(spans),
        F.struct(F.array().cast("array<struct<a:bigint,b:bigint>>").alias("out"), F.lit(0).cast("long").alias("to")),
        lambda acc, s: F.struct(F.when(s.a >= acc.to, F.concat(acc.out, F.array(F.struct(acc.to.alias("a"), s.a.alias("b"))))).otherwise(acc.out).alias("out"), F.greatest(acc.to, s.b).alias("to")),
    )
    t = F.col(text)
    piece = lambda a, b: t.substr((a + 1).cast("int"), (b - a).cast("int"))
    state_at = fresh(made, "state")
    made = made.withColumn(state_at, F.when(F.size(found) > 0, state))
    s = F.col(state_at)
    cut = F.array_join(F.concat(F.transform(s.out, lambda x: piece(x.a, x.b)), F.array(piece(s.to, F.length(t).cast("long")))), mark)
    return made.withColumn(text, F.when(F.size(found) > 0, cut).otherwise(t)).select(*df.columns)


def op1_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The parts of credentials in every document, as the module says.

    Null and empty texts have none; a null doc_id stays null; rows with one id and repeated rows each give a row; whole texts
    are searched, whatever their length; an empty table gives no rows; other columns aren't read.
    """
    made, found = scan(read(spark, sf_dir, "documents", "doc_id", "text"), keep=["doc_id"])
    spans = F.col(found)
    count = lambda k: F.size(F.filter(spans, lambda s: s.kind == k)).cast("long")
    base = F.filter(spans, lambda s: s.kind < BASE)
    return made.select("doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(_listed(base), 256).alias("base_sha256"), _listed(spans).alias("spans"), (F.size(spans) - F.size(base)).cast("long").alias("n_linked"))


def _sql() -> str:
    quote = lambda s: s.replace("'", "''")
    found = " UNION ALL ".join(f"SELECT k, doc_id, {n} AS kind, unnest(list_zip(string_split_regex(t, '{quote(p)}'), regexp_extract_all(t, '{quote(p)}', 0), regexp_extract_all(t, '{quote(p)}', {g}), range(1, 1 + len(string_split_regex(t, '{quote(p)}'))))) AS z FROM d WHERE regexp_matches(t, '{quote(p)}')" for n, (_, p, g, _) in enumerate(PATTERNS))
    least = "[" + ", ".join(str(p[3]) for p in PATTERNS) + "]"
    names = "[" + ", ".join(f"'{p[0]}'" for p in PATTERNS) + "]"

    def near(kinds):
        return f"(coalesce(max(e) FILTER (kind IN {kinds}) OVER before >= s - {REACH}, false) OR coalesce(min(s) FILTER (kind IN {kinds}) OVER after <= e + {REACH}, false))"

    return f"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS t FROM documents),
z AS ({found}),
m AS (SELECT k, kind, sum(length(z[1]) + coalesce(length(z[2]), 0)) OVER (PARTITION BY k, kind ORDER BY z[4]) AS e, length(z[2]) AS hit, z[2] AS h, length(z[3]) AS v FROM z),
p AS (SELECT k, kind, e - hit AS s, e FROM m WHERE hit IS NOT NULL AND v >= ({least})[kind + 1] AND (kind <> 5 OR (regexp_matches(h, '[0-9]') AND regexp_matches(h, '[A-Z]') AND regexp_matches(h, '[a-z]')))),
n AS (SELECT k, kind, s, e, {near(_IDENTIFIERS)} AS by_id, {near(_SECRETS)} AS by_secret,
  coalesce(max(e) FILTER (kind < {BASE}) OVER before > s, false) OR coalesce(min(s) FILTER (kind < {BASE}) OVER after < e, false) AS covered
  FROM p WINDOW before AS (PARTITION BY k ORDER BY s, kind, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), after AS (PARTITION BY k ORDER BY s, kind, e ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)),
r AS (SELECT k, kind, s, ({names})[kind + 1] || ':' || s::bigint || ':' || e::bigint AS x FROM n
  WHERE kind < {BASE} OR (NOT covered AND CASE WHEN kind = 3 THEN by_secret WHEN kind IN (4, 5) THEN by_id ELSE by_id AND by_secret END)),
a AS (SELECT k, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex, count(*) FILTER (kind >= {BASE}) AS n_linked,
  string_agg(x, ',' ORDER BY s, kind) FILTER (kind < {BASE}) AS base, string_agg(x, ',' ORDER BY s, kind) AS spans FROM r GROUP BY k)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_linked, 0) AS n_linked
FROM d LEFT JOIN a USING (k)
"""


OP1_SQL = _sql()
