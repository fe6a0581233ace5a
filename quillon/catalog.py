"""Every query of the engine by name, with SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.functions.severity import SEVERITIES
from quillon.functions.text import entropy, fingerprint, language, redacted, trimmed
from quillon.functions.versions import before
from quillon.operators import deps, report, review, suppress
from quillon.operators.credentials import DETECTORS, secrets
from quillon.operators.history import history_secrets, newest
from quillon.operators.lines import first_files, split_lines, units
from quillon.operators.match import findings
from quillon.sources.corpus import code_lines, code_lines_sql, quoted
from quillon.sources.files import dependencies, settings_of
from quillon.sources.rules import BY_ID, RULES, Rule, rules_frame

Query = Callable[[SparkSession, str], DataFrame]
FLAT = ["ord", "file_path", "language", "line", "line_content", "rule_id", "severity", "category", "cwe_id", "message", "remediation", "confidence", "source", "fingerprint"]


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


# --- SQL of the parts -------------------------------------------------------------------------------------------------


def _condition(rule: Rule) -> str:
    return rule.re2 or f"regexp_matches(t, {quoted(rule.pattern)})"


def _rules_sql(rules: list[Rule]) -> str:
    langs = lambda r: "[" + ", ".join(quoted(x) for x in r.languages) + "]"
    return "rules(rule_id, severity, category, cwe_id, message, remediation, languages, match_scope) AS (VALUES " + ", ".join(f"({quoted(r.rule_id)}, {quoted(r.severity)}, {quoted(r.category)}, {quoted(r.cwe_id)}, {quoted(r.message)}, {quoted(r.remediation)}, {langs(r)}, {quoted(r.match_scope) if r.match_scope else 'NULL::varchar'})" for r in rules) + ")"


_TRIM = r"regexp_replace(regexp_replace(t, '^\s+', ''), '\s+$', '')"


def _findings_sql(rules: list[Rule], lines: str = "code_lines") -> str:
    cases = " ".join(f"WHEN {quoted(r.rule_id)} THEN ({_condition(r)})" for r in rules)
    return f"""{_rules_sql(rules)},
findings AS MATERIALIZED (SELECT ord, file_path, language, line, {_TRIM} AS line_content, r.rule_id, severity, category, cwe_id, message, remediation, 'medium' AS confidence, 'compatibility' AS source,
  sha256(concat_ws('|', r.rule_id, file_path, {_TRIM})) AS fingerprint
  FROM {lines} l JOIN rules r ON (list_contains(r.languages, '*') OR list_contains(r.languages, l.language)) AND CASE r.rule_id {cases} END)"""


_COUNTS = ", ".join(f"count(*) FILTER (severity = '{s}') AS {s}" for s in SEVERITIES)
_ALL = f"WITH {code_lines_sql()}, {_findings_sql(RULES)} "
_FILES = f"files AS (SELECT file_path, any_value(language) AS language, min(ord) AS first_ord, count(*) AS total_findings, {_COUNTS} FROM findings GROUP BY file_path)"
_RANK = "CASE severity WHEN 'critical' THEN 4 WHEN 'high' THEN 3 WHEN 'medium' THEN 2 WHEN 'low' THEN 1 WHEN 'info' THEN 0 END"


# --- Findings ---------------------------------------------------------------------------------------------------------


def _found(spark: SparkSession, sf_dir: str, rules: list[Rule] | None = None) -> DataFrame:
    return findings(code_lines(spark, sf_dir), rules)


def _rule(rule_id: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    return _found(spark, sf_dir, [BY_ID[rule_id]])


def _http_no_tls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """HTTP_NO_TLS over crawled urls: a page is a file, its url the one line."""
    pages = _read(spark, sf_dir, "pages")
    lines = pages.select(F.col("page_id").alias("ord"), F.concat(F.lit("pages/"), F.col("page_id").cast("string")).alias("file_path"), F.lit("unknown").alias("language"), F.lit(1).alias("line"), F.col("url").alias("text"))
    return findings(lines, [BY_ID["HTTP_NO_TLS"]])


_HTTP_SQL = f"WITH urls AS (SELECT page_id AS ord, 'pages/' || page_id AS file_path, 'unknown' AS language, 1 AS line, url AS t FROM pages), {_findings_sql([BY_ID['HTTP_NO_TLS']], 'urls')} SELECT * FROM findings"


def _rules_catalog(spark, sf_dir):
    return rules_frame(spark).select("rule_id", "severity", "category", "cwe_id", "message", "remediation", F.array_join("languages", ",").alias("languages"), "match_scope")


def _scopes(spark, sf_dir):
    """Findings by the scope of their rule, which is carried and has no effect."""
    scope = rules_frame(spark).select("rule_id", F.coalesce("match_scope", F.lit("any")).alias("match_scope"))
    return _found(spark, sf_dir).join(F.broadcast(scope), "rule_id").groupBy("match_scope").agg(F.count("*").alias("n"), F.countDistinct("rule_id").alias("rules"))


def _documents(spark, sf_dir):
    return units(_read(spark, sf_dir, "documents"), F.concat(F.lit("documents/"), F.col("doc_id").cast("string"), F.lit(".txt")), F.col("text"), F.col("doc_id"))


def _line_split(spark, sf_dir):
    return split_lines(_documents(spark, sf_dir)).select("ord", "line", trimmed(F.col("text")).alias("line_content"))


def _languages(spark, sf_dir):
    return code_lines(spark, sf_dir).select("file_path", language(F.col("file_path")).alias("detected")).groupBy("detected").agg(F.count("*").alias("lines"), F.countDistinct("file_path").alias("files"))


def _file_report(spark, sf_dir):
    """As in a client's report: a file's findings in order, here as one text."""
    files = report.by_file(_found(spark, sf_dir), listed=True)
    listed = F.array_join(F.transform("findings", lambda f: F.concat(f.line.cast("string"), F.lit(":"), f.rule_id)), ",")
    return files.select("file_path", "language", "total_findings", *SEVERITIES, listed.alias("listed"))


_DROP_PATHS, _DROP_RULES = ["src/m1", "src/m2/f2.js"], ["HTTP_NO_TLS", "CORS_WILDCARD"]


def _known(found: DataFrame) -> DataFrame:
    return found.where("ord % 3 = 0").select("fingerprint")


def _baseline(spark, sf_dir):
    found = _found(spark, sf_dir)
    return suppress.baseline(found, _known(found)).select(*FLAT)


def _baseline_counts(spark, sf_dir):
    found = _found(spark, sf_dir)
    return suppress.suppressed(found, _known(found)).agg(F.count("*").alias("suppressed_findings"), F.lit(True).alias("applied"))


_CWE = [("CWE-95", "Code injection", "Input runs as code."), ("CWE-22", "Path traversal", "Files outside a root are reached."), ("CWE-79", "Cross-site scripting", "Scripts run in others' pages."), ("CWE-798", "Hard-coded credentials", "Anyone with the source has them.")]


def _cwe(spark, sf_dir):
    table = spark.createDataFrame(_CWE, "id string, name string, impact string")
    return report.with_cwe(_found(spark, sf_dir), table).select("ord", "rule_id", "cwe_id", "name", "impact")


def _envelope(spark, sf_dir):
    """The sums of a scan of which the Go files can't be read, with a baseline and the dependencies' audit."""
    lines = code_lines(spark, sf_dir)
    readable = F.col("language") != "go"
    # A file's lines are numbered, so its first one stands for it: nothing is grouped.
    files = lines.where("line = 1").select("file_path", F.when(readable, F.col("text")).alias("text"))
    everything = findings(lines.where(readable))
    # Findings and dependencies repeat much: both are counted before they meet the baseline, which then is asked once.
    repeated = everything.groupBy("fingerprint", "file_path", "severity").agg(F.count("*").alias("copies"))
    one = report.envelope(suppress.marked(repeated, _known(everything)), files)
    audited = suppress.marked(_counted(spark, sf_dir).select("fingerprint", "copies"), _known_dependencies(spark, sf_dir))
    n = lambda which: F.coalesce(F.sum(F.when(which, F.col("copies"))), F.lit(0).cast("long"))
    lost = audited.agg(n(~F.col("known")).alias("dependency_vulnerabilities"), n(F.col("known")).alias("suppressed_dependencies"))
    one = one.withColumn("one", F.lit(1)).join(lost.withColumn("one", F.lit(1)), "one").drop("one")
    return one.select(*(c for c in one.columns if c != "suppressed_findings"), "suppressed_findings", F.lit("src").alias("directory"), F.lit("compatibility").alias("engine"), F.lit(0).alias("warnings"), F.lit(True).alias("baseline_applied"))


def _max_files(spark, sf_dir):
    return split_lines(first_files(_documents(spark, sf_dir), 25)).select("ord", "file_path", "line", F.length("text").alias("chars"))


def _union(spark, sf_dir):
    """Findings of both detectors, by source and severity."""
    lines = code_lines(spark, sf_dir)
    both = findings(lines).select("source", "severity").unionByName(secrets(lines).select("source", "severity"))
    return both.groupBy("source", "severity").agg(F.count("*").alias("n"))


def _json(spark, sf_dir):
    found = _found(spark, sf_dir, [BY_ID["EVAL_USAGE"]])
    return found.select("ord", F.to_json(F.struct("rule_id", "severity", "line", F.lit(None).cast("string").alias("metadata"))).alias("json"))


# --- Secrets ----------------------------------------------------------------------------------------------------------


def _secret_findings(spark, sf_dir):
    return secrets(split_lines(_documents(spark, sf_dir)))


def _secrets_sql(lines: str) -> str:
    parts = []
    for kind, pattern, group, severity, cwe in DETECTORS:
        parts.append(f"SELECT ord, file_path, line, '{kind}' AS secret_type, '{severity}' AS severity, '{cwe}' AS cwe_id, unnest(regexp_extract_all(t, {quoted(pattern)}, {group})) AS value FROM {lines} WHERE regexp_matches(t, {quoted(pattern)})")
    return " UNION ALL ".join(parts)


_DOC_LINES = "doc_lines AS (SELECT doc_id AS ord, 'documents/' || doc_id || '.txt' AS file_path, unnest(range(1, len(l) + 1))::int AS line, unnest(l) AS t FROM (SELECT doc_id, string_split_regex(text, '\\r?\\n') AS l FROM documents))"
_ENTROPY = "round(coalesce((SELECT -sum(c / length(v.value) * log2(c / length(v.value))) FROM (SELECT count(*)::double AS c FROM (SELECT unnest(string_split(v.value, '')) AS ch) GROUP BY ch)), 0), 6)"
_SECRETS_SQL = f"""WITH {_DOC_LINES}, v AS ({_secrets_sql('doc_lines')})
SELECT ord, file_path, line, secret_type, severity, cwe_id, 'secret-detector' AS source, {_ENTROPY} AS entropy_score, left(value, 4) || '...[' || length(value) || ']' AS line_content, sha256(concat_ws('|', secret_type, file_path, value)) AS fingerprint FROM v"""


def _entropies(spark, sf_dir):
    return _read(spark, sf_dir, "customer").select("c_custkey", F.round(entropy(F.col("c_name")), 6).alias("entropy"), redacted(F.col("c_name")).alias("shown"))


def _history(spark, sf_dir):
    commits = _read(spark, sf_dir, "events").select(F.sha2(F.col("event_id").cast("string"), 256).alias("commit_hash"), F.col("ts").alias("commit_date"), "user_id")
    return newest(commits)


def _history_secrets(spark, sf_dir):
    """Documents as commits: two of three lines are added, the rest is there already."""
    docs = _read(spark, sf_dir, "documents").where("text is not null")
    lines = F.transform(F.split("text", "\n", -1), lambda x, i: F.concat(F.when((i + F.col("doc_id")) % 3 != 0, "+").otherwise(" "), x))
    commits = docs.select(F.sha2(F.col("doc_id").cast("string"), 256).alias("commit_hash"), F.timestamp_seconds(F.lit(1_700_000_000) + F.col("doc_id") % 977).alias("commit_date"), F.concat(F.lit("d"), (F.col("doc_id") % 7).cast("string"), F.lit("/notes.txt")).alias("file_path"), F.array_join(lines, "\n").alias("patch"))
    return history_secrets(commits, 500).select("commit_hash", "commit_date", "file_path", "line", "secret_type", "severity", "cwe_id", "source", "entropy_score", "line_content", "fingerprint")


_HISTORY_SQL = f"""WITH c AS (SELECT doc_id, text, sha256(doc_id::varchar) AS commit_hash, make_timestamp((1700000000 + doc_id % 977) * 1000000) AS commit_date, 'd' || (doc_id % 7) || '/notes.txt' AS file_path FROM documents WHERE text IS NOT NULL),
few AS (SELECT * FROM c ORDER BY commit_date DESC, commit_hash DESC LIMIT 500),
added AS (SELECT commit_hash AS ord, commit_date, file_path, i::int AS line, CASE WHEN ends_with(l[i], chr(13)) AND i < len(l) THEN left(l[i], length(l[i]) - 1) ELSE l[i] END AS t FROM (SELECT *, string_split(text, chr(10)) AS l FROM few), LATERAL (SELECT unnest(range(1, len(l) + 1)) AS i) WHERE (i - 1 + doc_id) % 3 <> 0 AND NOT starts_with(l[i], '++')),
v AS ({_secrets_sql('added')})
SELECT v.ord AS commit_hash, d.commit_date, v.file_path, line, secret_type, severity, cwe_id, 'secret-detector' AS source, {_ENTROPY} AS entropy_score, left(value, 4) || '...[' || length(value) || ']' AS line_content, sha256(concat_ws('|', secret_type, v.file_path, value)) AS fingerprint FROM v JOIN few d ON v.ord = d.commit_hash"""


# --- Dependencies -----------------------------------------------------------------------------------------------------


def _dependencies(spark, sf_dir):
    part = _read(spark, sf_dir, "part")
    k = F.col("p_partkey")
    version = F.concat_ws(".", (k % 5).cast("string"), (k % 13).cast("string"), (k % 7).cast("string"))
    deps_ = part.select(F.concat(F.lit("Lib-"), (k % 50).cast("string")).alias("package"), F.when(k % 2 == 0, "npm").otherwise("PyPI").alias("ecosystem"), version.alias("version"), F.concat(F.lit("/app"), (k % 9).cast("string")).alias("path"))
    s = F.col("s_suppkey")
    severity = F.element_at(F.array(*(F.lit(x) for x in SEVERITIES)), (s % 4 + 1).cast("int"))
    adv = _read(spark, sf_dir, "supplier").select(
        F.concat(F.lit("lib-"), (s % 60).cast("string")).alias("package"), F.when(s % 3 == 0, "npm").otherwise("pypi").alias("ecosystem"), F.concat(F.lit("ADV-"), s.cast("string")).alias("advisory_id"), severity.alias("severity"), F.col("s_name").alias("title"), F.concat(F.lit("https://advisories.example/"), s.cast("string")).alias("url"),
        F.when(s % 10 != 0, F.concat_ws(".", (s % 4).cast("string"), (s % 11).cast("string"))).alias("fixed_version"), F.when(s % 7 == 0, F.lit("0.5")).alias("introduced_version"),
    )
    used = _read(spark, sf_dir, "nation").select(F.concat(F.lit("lib-"), F.col("n_nationkey").cast("string")).alias("package"))
    return deps_, adv, used


def _audit(spark, sf_dir, least=None):
    return suppress.threshold(deps.audit(*_dependencies(spark, sf_dir)), least)


def _counted(spark, sf_dir):
    return deps.counted(*_dependencies(spark, sf_dir))


def _tally(spark, sf_dir, least):
    deps_, adv, _ = _dependencies(spark, sf_dir)
    return suppress.threshold(deps.tally(deps_, adv), least)


def _known_dependencies(spark, sf_dir):
    return _counted(spark, sf_dir).where(F.endswith("advisory_id", F.lit("3"))).select("fingerprint")


def _deps_envelope(spark, sf_dir):
    found = _tally(spark, sf_dir, "high")
    n = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return found.agg(n("copies").alias("total_vulnerabilities"), F.lit(True).alias("offline"), *(n(F.when(F.col("severity") == s, F.col("copies"))).alias(s) for s in SEVERITIES))


_V = lambda v: f"[coalesce(try_cast(string_split({v}, '.')[i] AS int), 0) FOR i IN range(1, 7)]"
_DEPS = f"""d AS (SELECT lower('Lib-' || (p_partkey % 50)) AS package, CASE WHEN p_partkey % 2 = 0 THEN 'npm' ELSE 'pypi' END AS ecosystem, (p_partkey % 5) || '.' || (p_partkey % 13) || '.' || (p_partkey % 7) AS installed_version, '/app' || (p_partkey % 9) AS path FROM part),
a AS (SELECT 'lib-' || (s_suppkey % 60) AS package, CASE WHEN s_suppkey % 3 = 0 THEN 'npm' ELSE 'pypi' END AS ecosystem, 'ADV-' || s_suppkey AS advisory_id, ['critical', 'high', 'medium', 'low', 'info'][s_suppkey % 4 + 1] AS severity, s_name AS title, 'https://advisories.example/' || s_suppkey AS url,
  CASE WHEN s_suppkey % 10 <> 0 THEN (s_suppkey % 4) || '.' || (s_suppkey % 11) END AS patched_version, CASE WHEN s_suppkey % 7 = 0 THEN '0.5' END AS introduced FROM supplier),
v AS (SELECT d.package, d.ecosystem, installed_version, path, advisory_id, severity, title, url, patched_version, CASE WHEN d.package IN (SELECT 'lib-' || n_nationkey FROM nation) THEN 'reachable' ELSE 'unreachable' END AS reachability,
  sha256(concat_ws('|', d.ecosystem, d.package, advisory_id, installed_version, path)) AS fingerprint
  FROM d JOIN a ON d.package = a.package AND d.ecosystem = a.ecosystem AND (patched_version IS NULL OR {_V('installed_version')} < {_V('patched_version')}) AND NOT (introduced IS NOT NULL AND {_V('installed_version')} < {_V("coalesce(introduced, '')")}))"""


def _versions(spark, sf_dir):
    """Versions with and without a leading v, zeros at the end, build and pre-release marks, and dates as long as a number gets."""
    k = F.col("p_partkey")
    text = lambda c: c.cast("string")
    a = F.concat(F.when(k % 3 == 0, "v").otherwise(""), text(k % 4), F.lit("."), text(k % 12), F.when(k % 4 == 0, ".0").otherwise(""), F.when(k % 5 == 0, F.concat(F.lit("."), text(F.lit(20240101120000) + k % 7))).otherwise(""), F.when(k % 7 == 0, "-rc1").otherwise(""), F.when(k % 11 == 0, "+build7").otherwise(""))
    b = F.when(k % 50 != 0, F.concat(text(k % 3), F.lit("."), text(k % 11), F.when(k % 5 == 0, F.concat(F.lit(".0" + ".0" * 7), F.lit("."), text(F.lit(20240101120003)))).otherwise(""), F.when(k % 13 == 0, "-beta").otherwise("")))
    return _read(spark, sf_dir, "part").select("p_partkey", a.alias("a"), b.alias("b"), before(a, b).alias("older"))


_PARTS = lambda v: f"list_transform(range(1, 13), lambda i: coalesce(try_cast(string_split(string_split(string_split(ltrim({v}, 'v'), '+')[1], '-')[1], '.')[i] AS hugeint), 0))"
_VERSIONS_SQL = f"""WITH x AS (SELECT p_partkey, p_partkey AS k FROM part),
y AS (SELECT p_partkey, (CASE WHEN k % 3 = 0 THEN 'v' ELSE '' END) || (k % 4) || '.' || (k % 12) || (CASE WHEN k % 4 = 0 THEN '.0' ELSE '' END) || (CASE WHEN k % 5 = 0 THEN '.' || (20240101120000 + k % 7) ELSE '' END) || (CASE WHEN k % 7 = 0 THEN '-rc1' ELSE '' END) || (CASE WHEN k % 11 = 0 THEN '+build7' ELSE '' END) AS a,
  CASE WHEN k % 50 <> 0 THEN (k % 3) || '.' || (k % 11) || (CASE WHEN k % 5 = 0 THEN '.0.0.0.0.0.0.0.0.20240101120003' ELSE '' END) || (CASE WHEN k % 13 = 0 THEN '-beta' ELSE '' END) END AS b FROM x),
z AS (SELECT *, {_PARTS('a')} AS p, {_PARTS('b')} AS q, contains(a, '-')::int AS pa, contains(b, '-')::int AS pb FROM y)
SELECT p_partkey, a, b, CASE WHEN b IS NOT NULL THEN p < q OR (p = q AND pa > pb) END AS older FROM z"""


def _manifest_files(spark, sf_dir):
    """A manifest for each part, of nine kinds in turn, which names two packages."""
    k = F.col("p_partkey")
    n, v = F.concat(F.lit("lib-"), (k % 50).cast("string")), F.concat((k % 5).cast("string"), F.lit("."), (k % 13).cast("string"))
    parts = _read(spark, sf_dir, "part").select("p_partkey", n.alias("n"), v.alias("v"))
    text, name = F.lit(None).cast("string"), F.lit(None).cast("string")
    for i, (kind, form) in enumerate(_MANIFESTS):
        mine = F.col("p_partkey") % len(_MANIFESTS) == i
        name, text = F.when(mine, kind).otherwise(name), F.when(mine, F.format_string(form, "n", "v", "n", "v")).otherwise(text)
    return parts.select(F.concat(F.lit("app"), F.col("p_partkey").cast("string"), F.lit("/"), name).alias("file_path"), text.alias("text"))


#: Names and contents, each with places for a package, its version, and both of another one.
_MANIFESTS = [
    ("package.json", '{"dependencies": {"%s": "^%s"}, "devDependencies": {"%s-dev": "~%s"}, "name": "x"}'), ("package-lock.json", '{"packages": {"": {"version": "0"}, "node_modules/%s": {"version": "%s"}, "node_modules/a/node_modules/%s-dev": {"version": "%s"}}}'),
    ("requirements.txt", "# needed\n%s==%s\n%s-dev>=%s ; python_version\nunpinned\n"), ("poetry.lock", '[[package]]\nname = "%s"\nversion = "%s"\n\n[[package]]\nname = "%s-dev"\nversion = "%s"\n'), ("Cargo.lock", 'version = 3\n\n[[package]]\nname = "%s"\nversion = "%s"\n\n[[package]]\nname = "%s-dev"\nversion = "%s"\n'),
    ("go.mod", "module m\n\nrequire (\n\tx.org/%s v%s\n\tx.org/%s-dev v%s\n)\n"), ("Gemfile.lock", "GEM\n  specs:\n    %s (%s)\n      sub (>= 1)\n    %s-dev (%s)\n"), ("composer.lock", '{"packages": [{"name": "%s", "version": "%s"}, {"name": "%s-dev", "version": "%s"}]}'),
    ("pom.xml", "<project><dependency><groupId>g</groupId><artifactId>%s</artifactId><version>%s</version></dependency>\n<dependency><groupId>g</groupId><artifactId>%s-dev</artifactId><version>%s</version></dependency></project>"),
]
_KINDS = "['npm', 'npm', 'PyPI', 'PyPI', 'crates.io', 'Go', 'RubyGems', 'Packagist', 'Maven']"
_MANIFEST_SQL = f"""SELECT (CASE p_partkey % 9 WHEN 5 THEN 'x.org/' WHEN 8 THEN 'g:' ELSE '' END) || 'lib-' || (p_partkey % 50) || s AS package, ({_KINDS})[p_partkey % 9 + 1] AS ecosystem, (CASE p_partkey % 9 WHEN 5 THEN 'v' ELSE '' END) || (p_partkey % 5) || '.' || (p_partkey % 13) AS version,
  'app' || p_partkey || '/' || ({[name for name, _ in _MANIFESTS]})[p_partkey % 9 + 1] AS path FROM part, (VALUES (''), ('-dev')) AS x(s)"""


def _settings(spark, sf_dir):
    """A settings file for each supplier: all keys, some, none, or no JSON."""
    k = F.col("s_suppkey")
    n = k.cast("string")
    text = F.when(k % 5 == 0, F.format_string('{"ignorePaths": ["src/%s", "b"], "ignoreRules": ["R%s"], "minimumSeverity": "high", "failOnSeverity": "critical", "offline": false}', n, n)).when(k % 5 == 1, F.format_string('{"ignorePaths": ["x/%s"], "other": 1}', n)).when(k % 5 == 2, F.lit('{"minimumSeverity": null, "offline": null}')).when(k % 5 == 3, F.lit("{}")).otherwise(F.lit("not json"))
    made = settings_of(_read(spark, sf_dir, "supplier").select(F.concat(F.lit("p"), n, F.lit("/.quillon.json")).alias("file_path"), text.alias("text")))
    return made.withColumns({c: F.array_join(c, ",") for c in ("ignore_paths", "ignore_rules")})


_SETTINGS_SQL = """SELECT 'p' || s_suppkey || '/.quillon.json' AS file_path, CASE s_suppkey % 5 WHEN 0 THEN 'src/' || s_suppkey || ',b' WHEN 1 THEN 'x/' || s_suppkey ELSE '' END AS ignore_paths, CASE WHEN s_suppkey % 5 = 0 THEN 'R' || s_suppkey ELSE '' END AS ignore_rules,
  CASE WHEN s_suppkey % 5 = 0 THEN 'high' END AS minimum_severity, CASE WHEN s_suppkey % 5 = 0 THEN 'critical' END AS fail_on_severity, s_suppkey % 5 <> 0 AS offline FROM supplier"""


def _manifests(spark, sf_dir):
    return dependencies(_manifest_files(spark, sf_dir))


# --- Reviews and arguments --------------------------------------------------------------------------------------------


def _comments(spark, sf_dir):
    found = report.by_file(_found(spark, sf_dir)).where("critical > 0")
    few = report.top(found, review.MOST_COMMENTS)
    return few.select(F.col("rank").cast("long").alias("ordinal"), F.col("file_path").alias("path"), F.col("rank").alias("line"), F.lit("See the findings.").alias("body"))


def _plan(spark, sf_dir):
    comments = _comments(spark, sf_dir)
    return review.planned(comments, "A summary.", None, comments.where("ordinal % 5 = 0").select("ordinal"))


_PLAN = f"""{_FILES}, c AS (SELECT row_number() OVER (ORDER BY critical DESC, high DESC, total_findings DESC, first_ord, file_path) AS n, file_path FROM files WHERE critical > 0 QUALIFY n <= 50),
plan AS (SELECT n AS ordinal, 'inline_comment' AS type, file_path AS path, n::int AS line, NULL::varchar AS action, CASE WHEN n % 5 = 0 THEN 'failed' ELSE 'posted' END AS status FROM c
  UNION ALL SELECT coalesce(max(n), 0) + 1, 'review', NULL, NULL, 'COMMENT', 'posted' FROM c)"""


def _comment_cap(spark, sf_dir):
    """Each user's events as the comments of two calls: how many are valid, and whether the call is turned down."""
    e = _read(spark, sf_dir, "events")
    call = F.col("user_id") * 2 + (F.col("event_id") % 4 == 0).cast("int")
    comments = e.select(call.alias("call"), F.when(F.col("event_id") % 211 != 0, F.col("event_type")).alias("path"), (F.col("event_id") % 197).cast("int").alias("line"), F.coalesce(F.nullif("props", F.lit("")), F.lit("-")).alias("body"))
    return review.checked(comments, "call")


def _names(spark, sf_dir):
    name = F.col("c_name")
    shown = F.when(F.col("c_custkey") % 3 == 0, F.concat(name, F.lit("/x"))).when(F.col("c_custkey") % 3 == 1, F.regexp_replace(name, "#", ".")).otherwise(F.lit(""))
    ok = shown.rlike(review.NAME) & F.length(shown).between(1, review.MOST_NAME)
    return _read(spark, sf_dir, "customer").select("c_custkey", shown.alias("name"), ok.alias("valid"))


def _bounds(spark, sf_dir):
    o = _read(spark, sf_dir, "orders")
    n = F.col("o_orderkey") - 3
    action = F.element_at(F.array(*(F.lit(a) for a in (*review.ACTIONS, "MERGE"))), (F.col("o_orderkey") % 4 + 1).cast("int"))
    return o.select("o_orderkey", n.between(1, review.MOST_PULL).alias("pull_ok"), n.between(1, 5000).alias("commits_ok"), n.between(1, 200000).alias("files_ok"), action.isin(*review.ACTIONS).alias("action_ok"), F.length("o_orderpriority").between(1, review.MOST_BODY).alias("body_ok"))


def _defaults(spark, sf_dir):
    """An argument under its older name, and defaults of what is unset."""
    c = _read(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    newer, older = F.when(k % 3 == 0, F.lit("")).when(k % 3 == 1, F.concat(F.lit("new"), k.cast("string"))), F.when(k % 2 == 0, F.concat(F.lit("old"), k.cast("string")))
    return c.select("c_custkey", F.coalesce(F.nullif(newer, F.lit("")), F.nullif(older, F.lit(""))).alias("path"), F.coalesce(F.when(k % 4 == 0, k), F.lit(100)).alias("max_commits"), F.coalesce(F.when(k % 5 == 0, F.lit("APPROVE")), F.lit("COMMENT")).alias("action"))


_QUERIES: dict[str, tuple[Query, str | None]] = {
    "rule_http_no_tls": (_http_no_tls, _HTTP_SQL),
    **{f"rule_{r.rule_id.lower()}" if r.rule_id != "HTTP_NO_TLS" else "rule_http_no_tls_code": (partial(_rule, r.rule_id), f"WITH {code_lines_sql()}, {_findings_sql([r])} SELECT * FROM findings") for r in RULES},
    "rules_catalog": (_rules_catalog, f"WITH {_rules_sql(RULES)} SELECT rule_id, severity, category, cwe_id, message, remediation, array_to_string(languages, ',') AS languages, match_scope FROM rules"),
    "match_scope": (_scopes, f"{_ALL} SELECT coalesce(match_scope, 'any') AS match_scope, count(*) AS n, count(DISTINCT rule_id) AS rules FROM findings JOIN (SELECT rule_id, match_scope FROM rules) USING (rule_id) GROUP BY 1"),
    "findings_all": (_found, f"{_ALL} SELECT * FROM findings"),
    "line_split": (_line_split, f"WITH {_DOC_LINES} SELECT ord, line, {_TRIM} AS line_content FROM doc_lines"),
    "language_detection": (_languages, f"WITH {code_lines_sql()} SELECT language AS detected, count(*) AS lines, count(DISTINCT file_path) AS files FROM code_lines GROUP BY language"),
    "findings_by_file": (lambda s, d: report.by_file(_found(s, d)), f"{_ALL}, {_FILES} SELECT * FROM files"),
    "file_report": (_file_report, f"{_ALL} SELECT file_path, any_value(language) AS language, count(*) AS total_findings, {_COUNTS}, string_agg(line || ':' || rule_id, ',' ORDER BY ord, line, rule_id) AS listed FROM findings GROUP BY file_path"),
    "file_ranking": (lambda s, d: report.ranked(report.by_file(_found(s, d))), f"{_ALL}, {_FILES} SELECT *, row_number() OVER (ORDER BY critical DESC, high DESC, total_findings DESC, first_ord, file_path) AS rank FROM files"),
    "top_files": (lambda s, d: report.top(report.by_file(_found(s, d)), 20), f"{_ALL}, {_FILES} SELECT *, row_number() OVER (ORDER BY critical DESC, high DESC, total_findings DESC, first_ord, file_path)::int AS rank FROM files QUALIFY rank <= 20"),
    "severity_summary": (lambda s, d: report.summary(_found(s, d)), f"{_ALL} SELECT {_COUNTS} FROM findings"),
    "category_rollup": (lambda s, d: report.rollup(_found(s, d), "category"), f"{_ALL} SELECT category, count(*) AS total_findings, count(DISTINCT file_path) AS files, {_COUNTS} FROM findings GROUP BY category"),
    "cwe_rollup": (lambda s, d: report.rollup(_found(s, d), "cwe_id"), f"{_ALL} SELECT cwe_id, count(*) AS total_findings, count(DISTINCT file_path) AS files, {_COUNTS} FROM findings GROUP BY cwe_id"),
    "scan_envelope": (_envelope, f"{_ALL}, {_DEPS}, k AS (SELECT DISTINCT fingerprint FROM findings WHERE ord % 3 = 0 AND language <> 'go'), e AS (SELECT * FROM findings WHERE language <> 'go'), f AS (SELECT * FROM e ANTI JOIN k ON e.fingerprint = k.fingerprint), w AS (SELECT fingerprint FROM v WHERE advisory_id LIKE '%3')"
        f" SELECT (SELECT count(DISTINCT file_path) FROM code_lines WHERE language <> 'go') AS files_scanned, (SELECT count(DISTINCT file_path) FROM code_lines WHERE language = 'go') AS files_skipped, count(DISTINCT file_path) AS files_with_findings, count(*) AS total_findings, {_COUNTS},"
        f" (SELECT count(*) FROM v ANTI JOIN w ON v.fingerprint = w.fingerprint) AS dependency_vulnerabilities, (SELECT count(*) FROM v SEMI JOIN w ON v.fingerprint = w.fingerprint) AS suppressed_dependencies, (SELECT count(*) FROM e SEMI JOIN k ON e.fingerprint = k.fingerprint) AS suppressed_findings,"
        f" 'src' AS directory, 'compatibility' AS engine, 0 AS warnings, true AS baseline_applied FROM f"),
    "max_files": (_max_files, f"WITH {_DOC_LINES} SELECT ord, file_path, line, length(t)::int AS chars FROM doc_lines WHERE file_path IN (SELECT DISTINCT 'documents/' || doc_id || '.txt' AS p FROM documents ORDER BY p LIMIT 25)"),
    "threshold": (lambda s, d: suppress.threshold(_found(s, d), "high"), f"{_ALL} SELECT * FROM findings WHERE {_RANK} >= 3"),
    "fail_gate": (lambda s, d: suppress.failing(_found(s, d), "critical"), f"{_ALL} SELECT count(*) FILTER ({_RANK} >= 4) AS failing, count(*) FILTER ({_RANK} >= 4) > 0 AS failed FROM findings"),
    "ignore_paths": (lambda s, d: suppress.without_paths(_found(s, d), _DROP_PATHS), f"{_ALL} SELECT * FROM findings WHERE NOT (file_path = 'src/m1' OR starts_with(file_path, 'src/m1/') OR file_path = 'src/m2/f2.js' OR starts_with(file_path, 'src/m2/f2.js/'))"),
    "ignore_rules": (lambda s, d: suppress.without_rules(_found(s, d), _DROP_RULES), f"{_ALL} SELECT * FROM findings WHERE rule_id NOT IN ('HTTP_NO_TLS', 'CORS_WILDCARD')"),
    "configured": (lambda s, d: suppress.configured(_found(s, d), suppress.Config(["src/m3"], ["EVAL_USAGE"], "medium")), f"{_ALL} SELECT * FROM findings WHERE NOT starts_with(file_path, 'src/m3/') AND rule_id <> 'EVAL_USAGE' AND {_RANK} >= 2"),
    "baseline": (_baseline, f"{_ALL} SELECT f.* FROM findings f ANTI JOIN (SELECT DISTINCT fingerprint FROM findings WHERE ord % 3 = 0) k ON f.fingerprint = k.fingerprint"),
    "baseline_counts": (_baseline_counts, f"{_ALL} SELECT count(*) AS suppressed_findings, true AS applied FROM findings f SEMI JOIN (SELECT DISTINCT fingerprint FROM findings WHERE ord % 3 = 0) k ON f.fingerprint = k.fingerprint"),
    "dedup_fingerprint": (lambda s, d: suppress.deduplicated(_found(s, d)), f"{_ALL} SELECT * FROM findings QUALIFY row_number() OVER (PARTITION BY fingerprint ORDER BY ord, line) = 1"),
    "cwe_knowledge": (_cwe, f"{_ALL} SELECT ord, rule_id, f.cwe_id, name, impact FROM findings f LEFT JOIN (VALUES {', '.join(f'({quoted(a)}, {quoted(b)}, {quoted(c)})' for a, b, c in _CWE)}) AS k(cwe_id, name, impact) ON f.cwe_id = k.cwe_id"),
    "detectors_union": (_union, f"{_ALL}, v AS ({_secrets_sql('code_lines')}) SELECT source, severity, count(*) AS n FROM (SELECT source, severity FROM findings UNION ALL SELECT 'secret-detector', severity FROM v) GROUP BY ALL"),
    "json_findings": (_json, f"WITH {code_lines_sql()}, {_findings_sql([BY_ID['EVAL_USAGE']])} SELECT ord, '{{\"rule_id\":\"' || rule_id || '\",\"severity\":\"' || severity || '\",\"line\":' || line || '}}' AS json FROM findings"),
    "secret_findings": (_secret_findings, _SECRETS_SQL),
    "value_entropy": (_entropies, f"WITH v AS (SELECT c_custkey, c_name AS value FROM customer) SELECT c_custkey, {_ENTROPY} AS entropy, left(value, 4) || '...[' || length(value) || ']' AS shown FROM v"),
    "fingerprints": (lambda s, d: _read(s, d, "nation").select("n_nationkey", fingerprint(F.col("n_nationkey"), F.col("n_name"), F.lit(None)).alias("fingerprint")), "SELECT n_nationkey, sha256(n_nationkey || '|' || n_name || '|') AS fingerprint FROM nation"),
    "history_newest": (_history, "SELECT sha256(event_id::varchar) AS commit_hash, ts AS commit_date, user_id FROM events ORDER BY ts DESC, commit_hash DESC LIMIT 100"),
    "history_secrets": (_history_secrets, _HISTORY_SQL),
    "settings": (_settings, _SETTINGS_SQL),
    "manifest_dependencies": (_manifests, _MANIFEST_SQL),
    "deps_audit": (_audit, f"WITH {_DEPS} SELECT * FROM v"),
    "deps_threshold": (partial(_audit, least="high"), f"WITH {_DEPS} SELECT * FROM v WHERE {_RANK} >= 3"),
    "deps_histogram": (lambda s, d: deps.histogram(_tally(s, d, "medium")), f"WITH {_DEPS} SELECT s.severity, count(v.severity) AS n FROM (VALUES ('critical'), ('high'), ('medium'), ('low'), ('info')) AS s(severity) LEFT JOIN v ON v.severity = s.severity AND {_RANK.replace('severity', 'v.severity', 1)} >= 2 GROUP BY s.severity"),
    "deps_envelope": (_deps_envelope, f"WITH {_DEPS} SELECT count(*) AS total_vulnerabilities, true AS offline, {_COUNTS} FROM v WHERE {_RANK} >= 3"),
    "version_order": (_versions, _VERSIONS_SQL),
    "review_plan": (_plan, f"{_ALL}, {_PLAN} SELECT * FROM plan"),
    "review_totals": (lambda s, d: review.totals(_plan(s, d), "owner/repo#7"), f"{_ALL}, {_PLAN} SELECT 'owner/repo#7' AS pr, count(*) AS total_actions, count(*) FILTER (status = 'posted') AS posted, count(*) FILTER (status = 'failed') AS failed FROM plan"),
    "comment_cap": (_comment_cap, "SELECT call, count(*) AS comments, count(*) FILTER (ok) AS valid, count(*) > 50 OR count(*) FILTER (NOT ok) > 0 AS rejected FROM (SELECT user_id * 2 + (event_id % 4 = 0)::int AS call, event_id % 211 <> 0 AND length(event_type) BETWEEN 1 AND 4096 AND event_id % 197 > 0 AND length(coalesce(nullif(props, ''), '-')) BETWEEN 1 AND 65536 AS ok FROM events) GROUP BY call"),
    "review_names": (_names, r"SELECT c_custkey, name, regexp_full_match(name, '[A-Za-z0-9._-]+') AND length(name) BETWEEN 1 AND 100 AS valid FROM (SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN c_name || '/x' WHEN 1 THEN replace(c_name, '#', '.') ELSE '' END AS name FROM customer)"),
    "argument_bounds": (_bounds, "SELECT o_orderkey, o_orderkey - 3 BETWEEN 1 AND 1000000 AS pull_ok, o_orderkey - 3 BETWEEN 1 AND 5000 AS commits_ok, o_orderkey - 3 BETWEEN 1 AND 200000 AS files_ok, o_orderkey % 4 < 3 AS action_ok, length(o_orderpriority) BETWEEN 1 AND 65536 AS body_ok FROM orders"),
    "argument_defaults": (_defaults, "SELECT c_custkey, coalesce(CASE WHEN c_custkey % 3 = 1 THEN 'new' || c_custkey END, CASE WHEN c_custkey % 2 = 0 THEN 'old' || c_custkey END) AS path, CASE WHEN c_custkey % 4 = 0 THEN c_custkey ELSE 100 END AS max_commits, CASE WHEN c_custkey % 5 = 0 THEN 'APPROVE' ELSE 'COMMENT' END AS action FROM customer"),
}


def queries() -> dict[str, Query]:
    return {k: q for k, (q, _) in _QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: sql for k, (_, sql) in _QUERIES.items() if sql}
