"""From raw documents to packed training sequences: five stages over the whole table.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last keep the columns of ``documents``, and
each is written as Parquet and read again as the next one's input.  Null texts count as empty, and so don't pass the
quality rules; repeated rows are near duplicates of each other, so one stays.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm.decontaminate import contained
from quillon.llm.neardup import BROADCAST_ROWS, near_duplicates
from quillon.llm.packing import pack, public
from quillon.llm.quality import judge
from quillon.llm.rows import cut, folder, fresh, remove
from quillon.llm.secrets import redact


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep (operator 8)."""
    made, q = judge(docs)
    return made.where(F.col(f"{q}.kept")).select(*docs.columns)


def near_duplicate_removal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates (operator 4): that with the least id.

    Of rows with the same id and text one stays.  Texts move only if more rows go than a broadcast may hold, or rows repeat.
    """
    twin, drop = fresh(docs, "twin"), fresh(docs, "gone")
    found = cut(near_duplicates(docs).select("id", "twin", (F.col("id").eqNullSafe(F.col("node")) & F.coalesce(F.col("class_id") == F.col("node"), F.lit(True))).alias("stays")))
    gone = found.where("not stays").select("id", F.col("twin").alias(twin), F.lit(True).alias(drop)).distinct()
    few = found.where("not stays").count() <= BROADCAST_ROWS
    marked = docs.withColumn(twin, F.unhex(F.md5(F.coalesce(F.col("text").cast("string"), F.lit("")))))
    same = (marked[twin] == gone[twin]) & marked["doc_id"].eqNullSafe(gone["id"])
    kept = marked.join(F.broadcast(gone) if few else gone, same, "left_anti")
    if not found.where("stays").groupBy("id", "twin").count().where("count > 1").isEmpty():
        kept = kept.dropDuplicates([twin])
    return kept.select(*docs.columns)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item (operator 6).

    Equal texts contain the same, so what goes is named by the text's hash; texts move only if more go than a broadcast may hold.
    """
    twin = fresh(docs, "twin")
    marked = docs.withColumn(twin, F.unhex(F.md5(F.coalesce(F.col("text").cast("string"), F.lit("")))))
    found = contained(marked, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), doc=twin)
    gone = cut(found.select(F.col("doc").alias(twin)).distinct())
    return marked.join(F.broadcast(gone) if gone.count() <= BROADCAST_ROWS else gone, twin, "left_anti").select(*docs.columns)


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with the values of secrets masked (operator 1)."""
    return redact(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of at most 1024 tokens (operator 7)."""
    return pack(docs, *public()).withColumnRenamed("doc", "doc_id")


STAGES = [
    ("quality rules", quality_rules),
    ("MinHash near-dedup", near_duplicate_removal),
    ("benchmark decontamination", benchmark_decontamination),
    ("secret scans", secret_scans),
    ("packing", packing),
]

#: SQL can express neither the suffix arrays nor the tokens; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; the others are written below the shared checkpoint folder, each removed when the next is there, the last at the driver's end."""
    at = folder(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for i, (_, stage) in enumerate(STAGES):
        made = stage(spark, docs, sf_dir)
        if i == len(STAGES) - 1:
            return made
        made.write.parquet(path := f"{at}/{i}")
        docs = spark.read.parquet(path)
        if before:
            remove(spark.sparkContext, before)
        before = path
    return docs

