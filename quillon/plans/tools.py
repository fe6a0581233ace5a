"""The tools that a client calls: arguments are checked, a plan is built, and a response comes back.

A response is {"content": [{"type": "text", "text": ...}]}, with "isError" if something could not be looked at; finding nothing is no
error.  Results that go into a response are bounded by arguments, and a response says if there is more; sums cover all.
"""

from __future__ import annotations

import json
import logging
import os
import time
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.functions.severity import SEVERITIES
from quillon.operators import deps, report, review, suppress
from quillon.operators.credentials import secrets
from quillon.operators.history import DEFAULT_COMMITS, MOST_COMMITS, history_secrets
from quillon.operators.lines import first_files, split_lines
from quillon.operators.match import findings
from quillon.sources import files as source

log = logging.getLogger("quillon.tools")
MOST_PATH, MOST_FILES = 4096, 200_000
ADVISORY = "package string, ecosystem string, advisory_id string, severity string, title string, url string, fixed_version string, introduced_version string"


class BadArgument(ValueError):
    """An argument out of its bounds; shown with a hint, if there is one."""

    def __init__(self, message: str, hint: str | None = None):
        super().__init__(message)
        self.hint = hint


class BadPath(BadArgument):
    """A path that isn't what it should be; its message is shown as it is."""


def json_response(value: Any) -> dict:
    """Indented JSON; keys without a value are left out."""

    def dropped(x):
        if isinstance(x, dict):
            return {k: dropped(v) for k, v in x.items() if v is not None}
        return [dropped(v) for v in x] if isinstance(x, list) else x

    return text_response(json.dumps(dropped(value), indent=2, default=str, ensure_ascii=False))


def text_response(text: str) -> dict:
    return {"content": [{"type": "text", "text": text}]}


def error_response(message: str, hint: str | None = None) -> dict:
    return json_response({"error": message, "hint": hint or None}) | {"isError": True}


def run_tool(name: str, body: Callable[[], dict]) -> dict:
    """What body returns, or an error response; only path errors go without the tool's name.  How long it took is logged for debugging."""
    began = time.perf_counter()
    try:
        return body()
    except BadPath as e:
        return error_response(str(e), e.hint)
    except BadArgument as e:
        return error_response(f"{name}: {e}", e.hint)
    except Exception as e:
        return error_response(f"{name}: {e}")
    finally:
        log.debug("%s took %d ms", name, 1000 * (time.perf_counter() - began))


def whole(value: int | None, low: int, high: int, label: str) -> int | None:
    if value is not None and (isinstance(value, bool) or not isinstance(value, int) or not low <= value <= high):
        raise BadArgument(f"{label} must be a whole number from {low} to {high}")
    return value


def path(value: str, kind: str, label: str) -> str:
    """An existing file or directory ("any": either), as an absolute path."""
    if not isinstance(value, str) or not 1 <= len(value) <= MOST_PATH:
        raise BadPath(f"{label} must have 1 to {MOST_PATH} characters")
    fits = {"file": os.path.isfile, "directory": os.path.isdir, "any": os.path.exists}[kind]
    if not fits(value):
        raise BadPath(f"{label} is no {kind if kind != 'any' else 'file or directory'}: {value}")
    return os.path.abspath(value)


def scan(files: DataFrame, config: suppress.Config | None = None, most: int | None = None, known: DataFrame | None = None, rules=None) -> DataFrame:
    """Findings of files (ord, file_path, language, text) from rules and secret detectors, after settings and baseline."""
    config = config or suppress.Config()
    lines = split_lines(suppress.without_paths(first_files(files, most), config.ignore_paths))
    found = findings(lines, rules)
    kept = secrets(lines).withColumns({"rule_id": F.upper("secret_type"), "category": F.lit("secrets"), "message": F.lit("A value that looks like a credential."), "remediation": F.lit("Revoke it and keep its successor out of the source."), "confidence": F.lit("medium")}).drop("secret_type", "entropy_score")
    found = found.unionByName(kept, allowMissingColumns=True)
    found = suppress.threshold(suppress.without_rules(found, config.ignore_rules), config.minimum_severity)
    return found if known is None else suppress.baseline(found, known)


#: Keys of a finding in a response and where each comes from; without a column, from its file.
_FOUND = ("ruleId", "rule_id"), ("severity", "severity"), ("category", "category"), ("cweId", "cwe_id"), ("message", "message"), ("filePath", None), ("line", "line"), ("lineContent", "line_content"), ("remediation", "remediation"), ("confidence", "confidence"), ("source", "source"), ("fingerprint", "fingerprint")


def scan_directory(spark: SparkSession, dir_path: str, max_files: int | None = None, known: DataFrame | None = None, most_files: int = MOST_FILES, advisories: DataFrame | None = None, imports: DataFrame | None = None) -> dict:
    """The report of a directory.  With ``advisories`` (a local table) the manifests in it are audited, too.

    Files are matched once; sums, the list and the baseline's counters come from the findings, which are kept until the response is
    there.  All files with findings are listed, up to ``most_files``; a warning tells if there are more.
    """

    def body():
        whole(max_files, 1, MOST_FILES, "max_files")
        root = path(dir_path, "directory", "dir_path")
        config = source.settings(root)
        files = suppress.without_paths(source.directory(spark, root), config.ignore_paths)
        chosen = first_files(files, max_files)
        everything = scan(files, config, max_files).persist()
        try:
            found = everything if known is None else suppress.baseline(everything, known)
            sums = report.envelope(found, chosen).first().asDict()
            listed = report.ordered(report.by_file(found, listed=True)).limit(most_files)
            rows = [
                {"filePath": r["file_path"], "language": r["language"], "totalFindings": r["total_findings"], "findings": [{k: f[c] if c else r["file_path"] for k, c in _FOUND} for f in r["findings"]], "summary": {s: r[s] for s in SEVERITIES}}
                for r in listed.toLocalIterator()
            ]
            gone = 0 if known is None else suppress.suppressed(everything, known).count()
        finally:
            everything.unpersist()
        vulnerable, lost = [], 0
        if advisories is not None:
            audited = suppress.threshold(deps.audit(source.dependencies(chosen), advisories, imports), config.minimum_severity)
            left = audited if known is None else suppress.baseline(audited, known)
            vulnerable = [r.asDict() for r in left.orderBy("path", "package", "advisory_id", "installed_version").toLocalIterator()]
            lost = 0 if known is None else suppress.suppressed(audited, known).count()
        less = None if known is None else {"applied": True, "suppressedFindings": gone, "suppressedDependencies": lost}
        more = sums["files_with_findings"] - len(rows)
        return json_response(
            {
                "directory": root, "filesScanned": sums["files_scanned"], "filesSkipped": sums["files_skipped"], "filesWithFindings": sums["files_with_findings"], "totalFindings": sums["total_findings"],
                "summary": {s: sums[s] for s in SEVERITIES}, "dependencyVulnerabilities": vulnerable, "files": rows, "engine": {"engine": "patterns", "available": True, "used": "compatibility"}, "coverage": {"scanned": sums["files_scanned"], "skipped": sums["files_skipped"]},
                "warnings": [f"{more} more files have findings; raise most_files to list them."] if more else [], "baseline": less,
            }
        )

    return run_tool("scan_directory", body)


def check_dependencies(spark: SparkSession, advisories: DataFrame, manifest_path: str | None = None, package_json_path: str | None = None, imports: DataFrame | None = None) -> dict:
    """package_json_path is an older name of manifest_path, which wins.  ``advisories`` is a local table: nothing is fetched."""

    def body():
        asked = manifest_path or package_json_path
        if not asked:
            raise BadPath("manifest_path is required.", "Give the absolute path of a manifest or lockfile.")
        at = path(asked, "file", "manifest_path")
        config = source.settings(at)
        found = suppress.threshold(deps.audit(source.manifest(spark, at), advisories, imports), config.minimum_severity)
        rows = [r.asDict() for r in found.orderBy("package", "advisory_id", "installed_version").collect()]
        return json_response({"ecosystem": source.ecosystem(at), "scannedManifest": at, "offline": True, "totalVulnerabilities": len(rows), "vulnerabilities": rows, "summary": {r["severity"]: r["n"] for r in deps.histogram(found).collect()}, "warnings": []})

    return run_tool("check_dependencies", body)


def scan_git_history(spark: SparkSession, export_path: str, max_commits: int | None = None) -> dict:
    """Secrets in an export of commits (JSON lines), newest first; values are masked."""

    def body():
        whole(max_commits, 1, MOST_COMMITS, "max_commits")
        at = path(export_path, "any", "export_path")
        found = history_secrets(source.commits(spark, at), DEFAULT_COMMITS if max_commits is None else max_commits)
        rows = [r.asDict() for r in found.orderBy(F.desc("commit_date"), "commit_hash", "file_path", "line").collect()]
        return json_response({"totalFindings": len(rows), "findings": rows})

    return run_tool("scan_git_history", body)


def post_security_review(spark: SparkSession, owner: str, repo: str, pull_number: int, comments: list[dict] | None = None, summary: str | None = None, action: str | None = None) -> dict:
    """The plan of a review: what would be posted, in order."""
    import re

    def body():
        for label, name in (("owner", owner), ("repo", repo)):
            if not isinstance(name, str) or not 1 <= len(name) <= review.MOST_NAME or not re.fullmatch(r"[A-Za-z0-9._-]+", name):
                raise BadArgument(f"{label} has 1 to {review.MOST_NAME} letters, digits, dots, underscores or hyphens")
        whole(pull_number, 1, review.MOST_PULL, "pull_number")
        if comments and len(comments) > review.MOST_COMMENTS:
            raise BadArgument(f"at most {review.MOST_COMMENTS} comments a call")
        if summary is not None and not 1 <= len(summary) <= review.MOST_BODY:
            raise BadArgument(f"summary has 1 to {review.MOST_BODY} characters")
        if action is not None and action not in review.ACTIONS:
            raise BadArgument(f"action is one of {', '.join(review.ACTIONS)}")
        pr = f"{owner}/{repo}#{pull_number}"
        if not comments and not summary:
            return json_response({"pr": pr, "totalActions": 0, "results": [], "note": "Nothing to post: give comments, a summary, or both."})
        table = spark.createDataFrame([(i + 1, c.get("path"), c.get("line"), c.get("body")) for i, c in enumerate(comments or [])], "ordinal long, path string, line int, body string")
        if review.valid(table).where("not valid").count():
            raise BadArgument("a comment needs a path, a line above 0 and a body within their bounds")
        plan = review.planned(table, summary, action)
        sums = review.totals(plan, pr).first()
        rows = [{k: r[k] for k in ("type", "path", "line", "action", "status")} for r in plan.orderBy("ordinal").collect()]
        return json_response({"pr": pr, "totalActions": sums["total_actions"], "posted": sums["posted"], "failed": sums["failed"], "results": rows})

    return run_tool("post_security_review", body)
