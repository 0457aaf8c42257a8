"""Queries on tables that change: digests by key range, upserts of touched ranges, features on a stream."""

import uuid

from pyspark.sql import functions as F

from panelwright.operators import digests as G
from panelwright.operators import panel as P
from panelwright.plans import derived as D
from panelwright.registry import query
from panelwright.registry.monthly import KEYS, _features_sql, _round
from panelwright.session import checkpoint_dir
from panelwright.sources import ranges
from panelwright.streaming import velocities

_COLUMNS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"]


def _folder(spark, name):
    return f"{checkpoint_dir(spark)}/incremental/{name}-{uuid.uuid4().hex}"


def _orders(spark, sf_dir):
    return D.table(spark, sf_dir, "orders").select(*_COLUMNS)


def _changes(orders):
    """The next snapshot's new and changed rows, and the keys it lost."""
    k = F.col("o_orderkey")
    changed = orders.filter(k % 501 == 0).withColumn("o_orderstatus", F.lit("X"))
    added = orders.filter(k % 601 == 0).withColumn("o_orderkey", -k - 1)
    return changed.unionByName(added), orders.filter((k % 701 == 0) & (k % 501 != 0))


def _next(orders):
    fresh, gone = _changes(orders)
    changed = F.col("o_orderkey") % 501 == 0
    lost = F.col("o_orderkey") % 701 == 0
    return orders.filter(~changed & ~lost).unionByName(fresh)


_NEXT = """a AS (SELECT o_orderkey, o_custkey, o_orderstatus, o_orderpriority FROM orders),
b AS (SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 501 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus, o_orderpriority
  FROM a WHERE o_orderkey % 501 = 0 OR o_orderkey % 701 <> 0
  UNION ALL SELECT -o_orderkey - 1, o_custkey, o_orderstatus, o_orderpriority FROM a WHERE o_orderkey % 601 = 0),
d AS (SELECT coalesce(a.o_orderkey, b.o_orderkey) AS o_orderkey, CASE WHEN a.o_orderkey IS NULL THEN 'added'
  WHEN b.o_orderkey IS NULL THEN 'removed' ELSE 'changed' END AS change FROM a FULL JOIN b ON a.o_orderkey = b.o_orderkey
  WHERE a.o_orderkey IS NULL OR b.o_orderkey IS NULL OR a.o_orderstatus <> b.o_orderstatus)"""


def _node(column):
    return f"substr(md5(CAST({column} AS VARCHAR)), 1, 3)"


def _stored(spark, df, keys):
    """Digests written once, as a snapshot keeps them beside its rows."""
    path = _folder(spark, "digests")
    G.range_digests(df, keys).write.parquet(path)
    return spark.read.parquet(path)


@query("SELECT count(*) AS row_count, CAST(sum(CAST('0x' || substr(md5(concat_ws('|', CAST(o_orderkey AS VARCHAR), CAST(o_custkey AS VARCHAR), "
       f"o_orderstatus, o_orderpriority)), 1, 13) AS BIGINT)) AS VARCHAR) AS content_hash FROM (WITH {_NEXT} SELECT * FROM b)")
def stored_fingerprint(spark, sf_dir):
    """IO9: the fingerprint of a changed table from its stored digests and those of the changed rows alone."""
    orders = _orders(spark, sf_dir)
    fresh, gone = _changes(orders)
    k = F.col("o_orderkey")
    removed = gone.unionByName(orders.filter(k % 501 == 0))
    of = lambda df: G.range_digests(df, ["o_orderkey"])
    return G.fingerprint_of(G.after_change(_stored(spark, orders, ["o_orderkey"]), of(removed), of(fresh)))


@query(f"""WITH {_NEXT}, n AS (SELECT DISTINCT {_node("o_orderkey")} AS node FROM d),
o AS (SELECT {_node("o_orderkey")} AS node, count(*) AS old_rows FROM a GROUP BY 1), w AS (SELECT {_node("o_orderkey")} AS node, count(*) AS new_rows FROM b GROUP BY 1)
SELECT n.node, coalesce(old_rows, 0) AS old_rows, coalesce(new_rows, 0) AS new_rows FROM n LEFT JOIN o USING (node) LEFT JOIN w USING (node)""")
def changed_ranges(spark, sf_dir):
    """IO8, IO9: key ranges in which two snapshots differ, from stored digests."""
    orders = _orders(spark, sf_dir)
    return G.changed_ranges(_stored(spark, orders, ["o_orderkey"]), _stored(spark, _next(orders), ["o_orderkey"]))


@query(f"WITH {_NEXT} SELECT o_orderkey, change FROM d")
def changed_keys(spark, sf_dir):
    """IO8, IO9: keys added, removed or changed, reading rows of differing ranges only."""
    orders, keys = _orders(spark, sf_dir), ["o_orderkey"]
    after = _next(orders)
    differing = G.changed_ranges(_stored(spark, orders, keys), _stored(spark, after, keys))
    return G.changed_keys(orders, after, keys, differing)


@query(f"""WITH {_NEXT}, u AS (SELECT * FROM b WHERE o_orderkey < 0 OR o_orderkey % 501 = 0)
SELECT * FROM a WHERE o_orderkey NOT IN (SELECT o_orderkey FROM u) UNION ALL SELECT * FROM u""")
def range_upsert(spark, sf_dir):
    """IO7: rows updated and inserted in a stored table; only ranges they touch are written anew."""
    orders = _orders(spark, sf_dir)
    fresh, _ = _changes(orders)
    path = _folder(spark, "table")
    ranges.create(orders, path, ["o_orderkey"])
    ranges.upsert(fresh.filter("o_orderkey < 0"), path)
    ranges.upsert(fresh.filter("o_orderkey >= 0"), path)
    return ranges.read(spark, path)


@query("""WITH a AS (SELECT o_orderkey, substr(md5(CAST(o_orderkey AS VARCHAR)), 1, 2) AS node FROM orders)
SELECT count(DISTINCT node) AS ranges, count(DISTINCT node) FILTER (o_orderkey % 2501 = 0) AS rewritten FROM a""")
def rewritten_ranges(spark, sf_dir):
    """IO7: ranges of a stored table, and how many of them an upsert of few rows wrote anew."""
    orders, path = _orders(spark, sf_dir), _folder(spark, "table")
    ranges.create(orders, path, ["o_orderkey"])
    before = ranges.manifest(spark, path).select("node", F.col("folder").alias("_old"))
    ranges.upsert(orders.filter(F.col("o_orderkey") % 2501 == 0).withColumn("o_orderstatus", F.lit("X")), path)
    both = ranges.manifest(spark, path).join(before, "node")
    return both.agg(F.count("*").alias("ranges"), F.count_if(F.col("folder") != F.col("_old")).alias("rewritten"))


@query(_features_sql(True))
def streamed_features(spark, sf_dir):
    """Features of the panel arriving in parts, each read by a stream that restarts from its checkpoint."""
    rows, path = D.monthly_panel(spark, sf_dir), _folder(spark, "stream")
    month = F.col("reporting_period")
    # The last part lies far ahead, so that the watermark passes every month of the panel.
    end = rows.limit(1).withColumn("reporting_period", F.lit("2200-01"))
    for part in (rows.filter(month < "1995-01"), rows.filter(month >= "1995-01"), end):
        part.write.mode("append").parquet(f"{path}/in")
        source = spark.readStream.schema(rows.schema).parquet(f"{path}/in")
        velocities.append_features(source, f"{path}/out", f"{path}/checkpoint")
    found = spark.read.parquet(f"{path}/out").filter(month < "2200-01")
    return _round(found.select(*KEYS, *P.FEATURES), P.FEATURES[:-1])
