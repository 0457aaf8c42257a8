"""Connected components of a table of links, by alternating star contractions."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwright.llm.frames import cut_lineage, discard


def components(links: DataFrame) -> DataFrame:
    """``node`` and ``root``, the smallest node of its component, for every node that is no root.

    ``links`` holds pairs of long ids ``a`` and ``b``. Large and small stars alternate until
    every node hangs below its root; minima are pre-aggregated, and joins on hot nodes are
    plain joins that adaptive execution can split. Every round starts from a written table.
    """
    edges = cut_lineage(links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    before, old = None, None
    while True:
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = state
        if old is not None:
            discard(old)
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(
            F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*")
        edges, old = cut_lineage(small.filter("u <> v").distinct()), edges
