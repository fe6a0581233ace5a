"""Files, manifests, commits and settings."""

from __future__ import annotations

import json
import os
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.operators.suppress import Config

#: What one value of a table can hold; larger files are skipped: their text is null.
MOST_BYTES = (1 << 31) - (1 << 20)


def directory(spark: SparkSession, root: str, most_bytes: int = MOST_BYTES) -> DataFrame:
    """(ord, file_path, language, text) of all files below a directory, paths relative to it."""
    from quillon.operators.lines import units

    base = Path(root).resolve().as_posix()
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(base)
    path = F.regexp_replace("path", r"^file:/*", "/")
    rel = F.substring(path, len(base) + 2, 1 << 20)
    # The length decides before contents are read.
    text = F.col("content").cast("string")
    fits = raw.where(F.col("length") <= most_bytes).select(rel.alias("rel"), F.when(F.is_valid_utf8(text), text).alias("text"))
    wide = raw.where(F.col("length") > most_bytes).select(rel.alias("rel"), F.lit(None).cast("string").alias("text"))
    return units(fits.unionByName(wide), F.col("rel"), F.col("text"), F.xxhash64("rel"))


def settings(path: str, name: str = ".quillon.json") -> Config:
    """The settings file beside or above a path; the default settings if there is none."""
    at = Path(path).resolve()
    for folder in [at, *at.parents] if at.is_dir() else list(at.parents):
        if (f := folder / name).is_file():
            raw = json.loads(f.read_text())
            return Config(raw.get("ignorePaths") or [], raw.get("ignoreRules") or [], raw.get("minimumSeverity"), raw.get("failOnSeverity"), raw.get("offline", True))
    return Config()


_SETTINGS = "struct<ignorePaths:array<string>,ignoreRules:array<string>,minimumSeverity:string,failOnSeverity:string,offline:boolean>"


def settings_of(files: DataFrame) -> DataFrame:
    """(file_path, ignore_paths, ignore_rules, minimum_severity, fail_on_severity, offline) of settings files (file_path, text).

    What is unset, and all of a text that is no JSON object, has the default.
    """
    s = F.from_json("text", _SETTINGS)
    none = F.array().cast("array<string>")
    return files.withColumn("s", s).select(
        "file_path", F.coalesce("s.ignorePaths", none).alias("ignore_paths"), F.coalesce("s.ignoreRules", none).alias("ignore_rules"),
        F.col("s.minimumSeverity").alias("minimum_severity"), F.col("s.failOnSeverity").alias("fail_on_severity"), F.coalesce("s.offline", F.lit(True)).alias("offline"),
    )


_ECOSYSTEMS = {"package.json": "npm", "package-lock.json": "npm", "requirements.txt": "PyPI", "poetry.lock": "PyPI", "go.mod": "Go", "Cargo.lock": "crates.io", "pom.xml": "Maven", "Gemfile.lock": "RubyGems", "composer.lock": "Packagist"}


def ecosystem(path: str) -> str:
    name = os.path.basename(path)
    if name in _ECOSYSTEMS:
        return _ECOSYSTEMS[name]
    if name.endswith(".txt"):
        return "PyPI"
    raise ValueError(f"{name} is no manifest that is known: {', '.join(_ECOSYSTEMS)}")


_MAPS = ("dependencies", "devDependencies", "optionalDependencies", "peerDependencies")
_MAP = T.MapType(T.StringType(), T.StringType())
_LOCKED = T.MapType(T.StringType(), T.StructType([T.StructField("version", T.StringType())]))
_LISTED = T.ArrayType(T.StructType([T.StructField("name", T.StringType()), T.StructField("version", T.StringType())]))
_PAIRS = "array<struct<package:string,version:string>>"
_LINE = {
    "go.mod": r"(?m)^\s*(?:require\s+)?([a-z0-9.-]+\.[a-z]+/\S+)\s+(v\S+)", "Gemfile.lock": r"(?m)^    ([A-Za-z0-9._-]+) \(([^)]+)\)",
    "": r"(?m)^[ \t]*([A-Za-z0-9][A-Za-z0-9._-]*)(?:\[[^\]]*\])?[ \t]*[=~>]=[ \t]*([0-9][^\s;,#]*)",
}


def _pairs(name: str, text: Column) -> Column:
    """The (package, version) pairs that a manifest of that name has."""
    pair = lambda package, version: F.struct(package.alias("package"), version.alias("version"))
    if name == "package.json":
        parsed = F.from_json(text, T.StructType([T.StructField(k, _MAP) for k in _MAPS]))
        return F.concat(*(F.transform(F.map_entries(F.coalesce(parsed[k], F.create_map().cast(_MAP))), lambda e: pair(e.key, e.value)) for k in _MAPS))
    if name == "package-lock.json":
        parsed = F.from_json(text, T.StructType([T.StructField("packages", _LOCKED), T.StructField("dependencies", _LOCKED)]))
        return F.transform(F.map_entries(F.coalesce(parsed.packages, parsed.dependencies)), lambda e: pair(F.regexp_replace(e.key, "^.*node_modules/", ""), e.value.version))
    if name == "composer.lock":
        parsed = F.from_json(text, T.StructType([T.StructField("packages", _LISTED)]))
        return F.transform(parsed.packages, lambda e: pair(e["name"], e["version"]))
    if name == "pom.xml":
        found = F.regexp_extract_all(text, F.lit(r"(?s)<dependency>.*?</dependency>"), F.lit(0))
        get = lambda x, tag: F.regexp_extract(x, rf"<{tag}>\s*([^<]+?)\s*</{tag}>", 1)
        return F.transform(found, lambda x: pair(F.concat_ws(":", get(x, "groupId"), get(x, "artifactId")), get(x, "version")))
    pattern = r'(?s)\[\[package\]\]\s*name = "([^"]+)"\s*version = "([^"]+)"' if name in ("poetry.lock", "Cargo.lock") else _LINE.get(name, _LINE[""])
    both = F.arrays_zip(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)).alias("package"), F.regexp_extract_all(text, F.lit(pattern), F.lit(2)).alias("version"))
    return both.cast(_PAIRS)


def dependencies(files: DataFrame) -> DataFrame:
    """(package, ecosystem, version, path) that manifests and lockfiles among files (file_path, text) name; ranges count as their least version.

    All files are read in one pass; those of other names, and null texts, give nothing.
    """
    name = F.element_at(F.split("file_path", "/"), -1)
    kind, pairs = F.lit(None).cast("string"), F.lit(None).cast(_PAIRS)
    for known in [*_ECOSYSTEMS, ""]:
        mine = F.endswith(name, F.lit(".txt")) & ~name.isin(*_ECOSYSTEMS) if not known else name == known
        kind, pairs = F.when(mine, _ECOSYSTEMS.get(known, "PyPI")).otherwise(kind), F.when(mine, _pairs(known, F.col("text"))).otherwise(pairs)
    rows = files.where(name.isin(*_ECOSYSTEMS) | F.endswith(name, F.lit(".txt"))).select(kind.alias("ecosystem"), F.col("file_path").alias("path"), F.explode_outer(pairs).alias("e"))
    return rows.where("e.package <> ''").select("e.package", "ecosystem", F.regexp_replace("e.version", r"^[\^~>=<\s]+", "").alias("version"), "path").distinct()


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """(package, ecosystem, version, path) that one manifest or lockfile names."""
    ecosystem(path)
    return dependencies(spark.read.text(path, wholetext=True).select(F.lit(path).alias("file_path"), F.col("value").alias("text")))


def commits(spark: SparkSession, folder: str) -> DataFrame:
    """(commit_hash, commit_date, file_path, patch) from an export of commits as JSON lines."""
    raw = spark.read.schema("commit_hash string, commit_date string, file_path string, patch string").json(folder)
    return raw.withColumn("commit_date", F.to_timestamp("commit_date"))
