"""Connected components of a table of links."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwright.session import cut_lineage, discard


def components(links: DataFrame) -> DataFrame:
    """``node`` and ``root``, the smallest node of its component, for every node that is no root.

    ``links`` holds pairs ``a`` and ``b`` of one ordered type; pairs of a node with itself or
    with a null say nothing. Stars are contracted: all larger neighbours of a node are hung below its least neighbour, then
    all smaller ones, until nothing changes, which takes logarithmically many rounds. Least
    neighbours are pre-aggregated, so a hub is one row of each task; joins on a hub
    can be split by adaptive execution. Every round starts from a written table.
    """
    edges = cut_lineage(links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    known = None
    while True:
        # The sum of hashes changes with the set of edges; it is exact in a decimal.
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == known:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        known = state
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        hung = cut_lineage(both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        least = hung.groupBy("u").agg(F.min("v").alias("m"))
        pairs = hung.join(least, "u").select(F.inline(F.array(
            F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u"), F.col("m").alias("v")))))
        old, edges = edges, cut_lineage(pairs.filter("u <> v").distinct())
        discard(old, hung)
