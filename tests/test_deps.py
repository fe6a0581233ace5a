from collections import Counter
from functools import cmp_to_key

import pytest
from pyspark.sql import functions as F

from quillon import catalog
from quillon.functions.severity import SEVERITIES
from quillon.functions.versions import before, sort_key
from quillon.operators import deps, report, suppress
from tests.conftest import SF

VERSIONS = ["0", "v1", "1.0", "1.0.0", "1.9", "1.10", "1.10-rc1", "1.10+b", "2..1", "10", "9" * 38, "1" * 39, "1.x", "", "-", "1.0.0.0.1"]
DEPENDENCY = "package string, ecosystem string, version string, path string"
ADVISORY = "package string, ecosystem string, advisory_id string, severity string, title string, url string, fixed_version string, introduced_version string"


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.fixture
def tables(spark):
    """More copies than one row stands for, nulls, equal advisories, packages that only case tells apart, and unknown severities."""
    d = [("Lib", "npm", v, p) for v in (*VERSIONS, None) for p in ("/a", None)] + [("lib", "NPM", "1.0", "/hot")] * 150 + [("other", "npm", "1.0", "/a"), (None, "npm", "1", "/a")]
    a = [("lib", "npm", f"A{i}", [*SEVERITIES, "odd", None][i % 7], "t", "u", fixed, since) for i, (fixed, since) in enumerate([(f, s) for f in ("1.10", "2", None, "1.0") for s in (None, "0.5", "1.0", "1.10-rc1")])]
    return spark.createDataFrame(d, DEPENDENCY), spark.createDataFrame(a + a[:2] + [(None, "npm", "A", "low", "t", "u", None, None)], ADVISORY)


def by_pairs(d, a):
    """The audit of each pair, with versions parsed for each."""
    x, y = d.select(F.lower("package").alias("package"), F.lower("ecosystem").alias("ecosystem"), "version", "path"), a.select(F.lower("package").alias("p"), F.lower("ecosystem").alias("e"), "advisory_id", "severity", "fixed_version", "introduced_version")
    both = x.join(y, (F.col("package") == F.col("p")) & (F.col("ecosystem") == F.col("e")))
    old = F.coalesce(before(F.col("version"), F.col("fixed_version")), F.col("version").isNotNull()) & ~F.coalesce(before(F.col("version"), F.col("introduced_version")), F.lit(False))
    return Counter(tuple(r) for r in both.where(old).select("package", "ecosystem", "version", "path", "advisory_id", "severity", "fixed_version").collect())


def test_keys_sort_as_versions(spark):
    pairs = spark.createDataFrame([(x, y) for x in VERSIONS for y in VERSIONS], "x string, y string")
    x, y = F.col("x"), F.col("y")
    wrong = pairs.where((before(x, y) != (sort_key(x) < sort_key(y))) | ((~before(x, y) & ~before(y, x)) != (sort_key(x) == sort_key(y))))
    assert wrong.collect() == []
    assert spark.range(1).select(sort_key(F.lit(None).cast("string"))).first()[0] is None


@pytest.mark.parametrize("most", [deps.BROADCAST_ROWS, 0])
def test_audit_gives_each_copy(tables, monkeypatch, most):
    monkeypatch.setattr(deps, "BROADCAST_ROWS", most)
    found = deps.audit(*tables).select("package", "ecosystem", "installed_version", "path", "advisory_id", "severity", "patched_version").collect()
    assert Counter(map(tuple, found)) == by_pairs(*tables)
    assert max(by_pairs(*tables).values()) == 300


def test_audit_parses_no_version_for_a_pair(spark):
    """Versions are parsed before the join: for each pair, the time is that of regular expressions."""
    join = [x for x in plan(catalog.queries()["deps_audit"](spark, SF)).splitlines() if "Join Inner" in x]
    assert join and not any("regexp" in x or "split" in x for x in join)
    assert any("installed_key" in x for x in join)


def test_marked_and_counted_as_before(tables, spark):
    """One pass over counted rows gives what the baseline keeps and takes away of all rows; rows without a fingerprint stay."""
    d, a = tables
    known = deps.counted(d, a).where("advisory_id like '%3'").select("fingerprint").unionByName(spark.createDataFrame([(None,), ("x",)], "fingerprint string"))
    every, lone = deps.audit(d, a), spark.createDataFrame([(None, 5)], "fingerprint string, copies long")
    sums = suppress.marked(deps.counted(d, a).select("fingerprint", "copies").unionByName(lone), known).groupBy("known").agg(F.sum("copies"))
    assert dict(map(tuple, sums.collect())) == {False: suppress.baseline(every, known).count() + 5, True: suppress.suppressed(every, known).count()}


def test_envelope_counts_copies(spark):
    files = spark.createDataFrame([("a", "x"), ("b", None), ("c", "y")], "file_path string, text string")
    found = spark.createDataFrame([("a", "high", 3, False), ("a", "odd", 2, False), ("c", None, 7, True), ("b", "low", 0, True)], "file_path string, severity string, copies long, known boolean")
    want = {"files_scanned": 2, "files_skipped": 1, "files_with_findings": 1, "total_findings": 5, "critical": 0, "high": 3, "medium": 0, "low": 0, "info": 0}
    assert report.envelope(found, files).first().asDict() == want | {"suppressed_findings": 7}
    assert report.envelope(found.where("not known").drop("copies", "known"), files).first().asDict() == want | {"total_findings": 2, "high": 1}
    assert report.envelope(found.where("false"), files).first().asDict() == want | {"files_with_findings": 0, "total_findings": 0, "high": 0, "suppressed_findings": 0}


def test_scan_envelope_matches_and_audits_twice(spark):
    """Once for the sums and once for the baseline; before, four times each."""
    text = plan(catalog.queries()["scan_envelope"](spark, SF))
    assert text.count("explode(hits") == 2
    assert sum("Join Inner" in x and "_key#" in x for x in text.splitlines()) == 2


def test_tally_counts_the_rows_of_the_audit(tables, spark):
    want = Counter(r["severity"] for r in deps.audit(*tables).select("severity").collect())
    assert dict(map(tuple, deps.tally(*tables).collect())) == want
    assert {None, "odd"} < set(want)
    assert deps.tally(tables[0], tables[1].where("false")).count() == 0


def test_deps_envelope_makes_no_row_for_a_sum(spark):
    text = plan(catalog.queries()["deps_envelope"](spark, SF))
    assert "advisories" in text and "explode" not in text and "sha2" not in text
    assert sum("Join Inner" in x and "_key#" in x for x in text.splitlines()) == 1


def test_histogram_counts_by_copies(tables, spark):
    """Of a tally and of the audit's rows alike, with severities that are none."""
    want = sorted(map(tuple, deps.histogram(deps.audit(*tables)).collect()), key=repr)
    assert sorted(map(tuple, deps.histogram(deps.tally(*tables)).collect()), key=repr) == want
    assert sorted(map(tuple, deps.histogram(deps.counted(*tables)).collect()), key=repr) == want
    assert {s for s, _ in want} == {*SEVERITIES, "odd", None}
    assert {n for _, n in deps.histogram(deps.tally(tables[0], tables[1].where("false"))).collect()} == {0}


def test_threshold_is_met_before_the_join(spark):
    """Advisories below the severity meet no dependency, and versions are parsed before, too."""
    lines = plan(catalog.queries()["deps_threshold"](spark, SF)).splitlines()
    at = next(i for i, x in enumerate(lines) if "Join Inner" in x)
    assert "installed_key" in lines[at] and "regexp" not in lines[at]
    low = [i for i, x in enumerate(lines) if "Filter" in x and "= high" in x]
    assert low and min(low) > at
