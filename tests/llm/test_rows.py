import time

from quillon.llm.rows import cut


def _files(sc):
    blocks = sc._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {blocks.apply(i).getName() for i in range(blocks.size()) if blocks.apply(i).getName().startswith("shuffle")}


def test_a_cut_table_leaves_no_shuffle_files(spark):
    before, setting = _files(spark.sparkContext), spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled")
    made = cut(spark.range(100_000).selectExpr("id % 1000 as k").groupBy("k").count())
    for _ in range(100):  # removal is asked for and done soon after
        if left := _files(spark.sparkContext) - before:
            time.sleep(0.1)
    assert not left and made.count() == 1000
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == setting
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_a_cut_table_can_be_used_again_and_again(spark):
    made = cut(spark.range(1000).selectExpr("id % 10 as k").groupBy("k").count())
    both = cut(made.join(made.withColumnRenamed("count", "n"), "k"))
    assert both.count() == 10 and made.join(both, "k").count() == 10
