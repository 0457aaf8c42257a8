"""Mergeable digests of a table by key range.

A range holds the keys whose md5 begins with the same hex digits, so ranges are even whatever
the keys are. A range's digest is its row count and the sum of its rows' hash parts. Sums add
up: digests of fewer digits, of parts of a table, and after a change follow from stored ones
without reading the table again, and two snapshots differ only in ranges whose digests do.

At most ``16 ** digits`` rows make up the digests of a table, however large it is. A null key is
a key like others; an empty table has no digests and the fingerprint of no rows.
"""

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwright.operators.snapshots import row_part, row_text

DIGITS = 3
_WIDE = "decimal(38,0)"


def range_of(keys, digits=DIGITS):
    """Column: the key range of a row."""
    return F.substring(F.md5(row_text(keys)), 1, digits)


def _summed(df: DataFrame, node) -> DataFrame:
    return df.groupBy(node.alias("node")).agg(F.sum("row_count").alias("row_count"), F.sum("content").cast(_WIDE).alias("content"))


def range_digests(df: DataFrame, keys, columns=None, digits=DIGITS) -> DataFrame:
    """(node, row_count, content) of every key range that has rows; ``columns`` must include ``keys``."""
    columns = list(columns or df.columns)
    if not set(keys) <= set(columns):
        raise ValueError("a digest without the key columns misses values that change places")
    return df.groupBy(range_of(keys, digits).alias("node")).agg(
        F.count("*").alias("row_count"), F.sum(row_part(columns)).cast(_WIDE).alias("content"))


def coarser(digests: DataFrame, digits: int) -> DataFrame:
    """The same digests for wider ranges; none of the digits gives the whole table's."""
    return _summed(digests, F.substring("node", 1, digits))


def merged(*digests: DataFrame) -> DataFrame:
    """Digests of several tables, or parts of one, put together."""
    return _summed(reduce(DataFrame.unionByName, digests), F.col("node"))


def after_change(digests: DataFrame, removed: DataFrame, added: DataFrame) -> DataFrame:
    """Digests of a table once the rows of ``removed`` left and those of ``added`` came, from their digests."""
    gone = removed.select("node", (-F.col("row_count")).alias("row_count"), (-F.col("content")).cast(_WIDE).alias("content"))
    return merged(digests, gone, added).filter("row_count <> 0 OR content <> 0")


def fingerprint_of(digests: DataFrame) -> DataFrame:
    """(row_count, content_hash) of the whole table, as ``fingerprint`` gives them."""
    return digests.agg(F.coalesce(F.sum("row_count"), F.lit(0)).alias("row_count"),
                       F.coalesce(F.sum("content"), F.lit(0)).cast(_WIDE).cast("string").alias("content_hash"))


def _differs(a, b):
    return ~(F.col(f"{a}_rows").eqNullSafe(F.col(f"{b}_rows")) & F.col(f"{a}_content").eqNullSafe(F.col(f"{b}_content")))


def _side(digests: DataFrame, name, by) -> DataFrame:
    return digests.select(*by, F.col("row_count").alias(f"{name}_rows"), F.col("content").alias(f"{name}_content"))


def changed_ranges(old: DataFrame, new: DataFrame) -> DataFrame:
    """(node, old_rows, new_rows) of the ranges in which two snapshots differ, from digests of equal digits."""
    both = _side(old, "old", ["node"]).join(_side(new, "new", ["node"]), "node", "full")
    return both.filter(_differs("old", "new")).select("node", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("old_rows", "new_rows")])


def changed_keys(old: DataFrame, new: DataFrame, keys, ranges: DataFrame, digits=DIGITS, columns=None) -> DataFrame:
    """``keys`` and ``change`` (added, removed, changed) of keys whose rows differ; only rows in ``ranges`` are compared.

    A key may have several rows; it is changed if their number or content is.
    """
    keys, columns = list(keys), list(columns or old.columns)
    wanted = ranges.select(F.col("node").alias("_node"))

    def per_key(df, name, to):
        inside = df.withColumn("_node", range_of(keys, digits)).join(wanted, "_node", "left_semi")
        found = inside.groupBy(*keys).agg(F.count("*").alias("row_count"), F.sum(row_part(columns)).cast(_WIDE).alias("content"))
        return _side(found, name, [F.col(k).alias(f"{to}{n}") for n, k in enumerate(keys)])

    same = reduce(lambda a, b: a & b, [F.col(f"_a{n}").eqNullSafe(F.col(f"_b{n}")) for n in range(len(keys))])
    both = per_key(old, "old", "_a").join(per_key(new, "new", "_b"), same, "full").filter(_differs("old", "new"))
    kind = F.when(F.col("old_rows").isNull(), "added").when(F.col("new_rows").isNull(), "removed").otherwise("changed")
    return both.select(*[F.coalesce(f"_a{n}", f"_b{n}").alias(k) for n, k in enumerate(keys)], kind.alias("change"))
