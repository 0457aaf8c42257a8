"""Stored tables leave no shuffle files behind."""

import time

from pyspark.sql import functions as F

from panelwright.plans import derived as D
from panelwright.session import cut_lineage


def _shuffle_files(spark):
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {name for name in (files.apply(i).getName() for i in range(files.size())) if name.startswith("shuffle_")}


def _left(spark, before):
    """Files that stay; they are deleted beside the next query."""
    until = time.time() + 10
    while (left := _shuffle_files(spark) - before) and time.time() < until:
        time.sleep(0.2)
    return left


def test_shuffles_go_with_the_write(spark):
    spark.range(1).count()
    before, conf = _shuffle_files(spark), "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    asked = spark.conf.get(conf, None)
    df = spark.range(5000).groupBy((F.col("id") % 700).alias("k")).agg(F.count("*").alias("n"))
    other = df.filter("n > 7").agg(F.sum("n").alias("s"))
    stored = cut_lineage(df)
    assert not _left(spark, before) and spark.conf.get(conf, None) == asked
    assert stored.count() == 700 and other.first().s == 800  # the table itself can be asked again
    assert df.count() == 700


def test_stored_cells_give_the_same_panel(spark, sf_dir):
    rows = lambda df: sorted(map(str, df.collect()))
    plain, stored = (D.part_panel(spark, sf_dir, D.SNAPSHOTS, stored=x) for x in (False, True))
    assert plain.schema == stored.schema and rows(plain) == rows(stored)
    assert "l_shipdate" not in stored._jdf.queryExecution().executedPlan().toString()
