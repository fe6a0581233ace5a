"""Dependencies against advisories."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.functions.severity import SEVERITIES
from quillon.functions.text import fingerprint
from quillon.functions.versions import sort_key

#: Advisories that a broadcast may hold; more are joined by a shuffle, each package in so many parts.
BROADCAST_ROWS, PARTS = 200_000, 16
#: Copies of a dependency that one row stands for at most, so that those of one go to many tasks.
COPIES = 64


def _dependencies(dependencies: DataFrame, *more: str) -> DataFrame:
    """Distinct dependencies with the number of their copies, and a key of the version."""
    columns = [F.lower("package").alias("package"), F.lower("ecosystem").alias("ecosystem"), F.col("version").alias("installed_version"), *more]
    d = dependencies.select(*columns)
    return d.groupBy(*d.columns).agg(F.count("*").alias("copies")).withColumn("installed_key", sort_key(F.col("installed_version")))


def _advisories(advisories: DataFrame) -> DataFrame:
    a = advisories.select(F.lower("package").alias("package"), F.lower("ecosystem").alias("ecosystem"), "advisory_id", "severity", "title", "url", F.col("fixed_version").alias("patched_version"), "introduced_version")
    return a.withColumns({"patched_key": sort_key(F.col("patched_version")), "introduced_key": sort_key(F.col("introduced_version"))}).drop("introduced_version")


def _hits(d: DataFrame, a: DataFrame) -> DataFrame:
    """Each dependency with each advisory that it is old enough for.

    Few rows make very many here, and packages differ much, so dependencies are spread by all of their columns and into a fixed
    number of tasks: by their size, or by package, they would be few tasks or uneven ones.
    """
    spark = d.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    on = ["package", "ecosystem"]
    if a.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        pairs = d.repartition(tasks, *d.columns).join(F.broadcast(a), on)
    else:
        part = F.pmod(F.xxhash64(*d.columns), F.lit(PARTS)).cast("int")
        d, a = d.withColumn("part", part), a.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
        on = [*on, "part"]
        pairs = d.repartition(tasks, *on).join(a.repartition(tasks, *on), on).drop("part")
    older = F.coalesce(F.col("installed_key") < F.col("patched_key"), F.col("installed_key").isNotNull())
    return pairs.where(older & ~F.coalesce(F.col("installed_key") < F.col("introduced_key"), F.lit(False))).drop("installed_key", "patched_key", "introduced_key")


def _audited(d: DataFrame, advisories: DataFrame, imports: DataFrame | None) -> DataFrame:
    if imports is None:
        d = d.withColumn("reachability", F.lit("unknown"))
    else:
        used = imports.select(F.lower("package").alias("package")).distinct().withColumn("used", F.lit(True))
        d = d.join(used, "package", "left").withColumn("reachability", F.when(F.col("used"), "reachable").otherwise("unreachable")).drop("used")
    hit = _hits(d, _advisories(advisories))
    return hit.select(
        "package", "ecosystem", "installed_version", "path", "advisory_id", "severity", "title", "url", "patched_version", "reachability",
        fingerprint(F.col("ecosystem"), F.col("package"), F.col("advisory_id"), F.col("installed_version"), F.col("path")).alias("fingerprint"), "copies",
    )


def counted(dependencies: DataFrame, advisories: DataFrame, imports: DataFrame | None = None) -> DataFrame:
    """As ``audit``, but with one row for all copies of a dependency, and their number in ``copies``."""
    return _audited(_dependencies(dependencies, "path"), advisories, imports)


def audit(dependencies: DataFrame, advisories: DataFrame, imports: DataFrame | None = None) -> DataFrame:
    """A row for each dependency and advisory of its package that it is old enough for.

    dependencies: (package, ecosystem, version, path); advisories: (package, ecosystem, advisory_id, severity, title, url,
    fixed_version, introduced_version); imports: (package) that the code uses, for reachability.
    An advisory without a fixed version holds for all later versions; names are compared in lower case.
    Equal dependencies are looked up and fingerprinted once, and repeated at the end.
    """
    d = _dependencies(dependencies, "path")
    d = d.withColumn("nth", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1, F.lit(COPIES).cast("long"))))
    d = d.withColumn("copies", F.least(F.lit(COPIES), F.col("copies") - F.col("nth")).cast("int"))
    hit = _audited(d, advisories, imports)
    return hit.withColumn("copies", F.explode(F.array_repeat(F.lit(0), F.col("copies")))).drop("copies")


def tally(dependencies: DataFrame, advisories: DataFrame) -> DataFrame:
    """(severity, copies): how many rows ``audit`` has of each severity, from distinct versions alone; no row is made for a sum."""
    bounds = ["package", "ecosystem", "patched_key", "introduced_key", "severity"]
    a = _advisories(advisories).groupBy(*bounds).agg(F.count("*").alias("advisories"))
    return _hits(_dependencies(dependencies), a).groupBy("severity").agg(F.sum(F.col("copies") * F.col("advisories")).alias("copies"))


def histogram(vulnerabilities: DataFrame) -> DataFrame:
    """(severity, n): the five severities, zero where there is none, and any other that occurs; rows count by ``copies``, if they have it."""
    five = vulnerabilities.sparkSession.createDataFrame([(s,) for s in SEVERITIES], "severity string")
    n = vulnerabilities.groupBy("severity").agg((F.sum("copies") if "copies" in vulnerabilities.columns else F.count("*")).alias("n"))
    return five.join(n, "severity", "full_outer").select("severity", F.coalesce("n", F.lit(0)).alias("n"))
