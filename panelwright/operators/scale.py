"""Order-dependent building blocks that never put a whole table in one task.

Ranks, quantiles, prefix sums and exact hash splits all need a global order. Here the
order is cut into value ranges: a bucket is a function of the value alone, so equal
values stay together, the assignment survives the loss of an executor, and per-bucket
totals (at most ``BUCKETS`` rows per group) carry the offsets between buckets. Rows are
first reduced to distinct values with counts, so a value that a third of all rows share
is one row by the time anything is sorted.
"""

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

COARSE = 32
FINE = 32
BUCKETS = COARSE * FINE


def beside(df: DataFrame, *singles: DataFrame) -> DataFrame:
    """Attach the columns of one-row tables as scalar subqueries (computed once, no join)."""
    for i, single in enumerate(singles):
        row = single.select(F.struct("*")).scalar()
        df = df.select("*", row.alias(f"_row{i}")).select(
            *df.columns, *[F.col(f"_row{i}")[c].alias(c) for c in single.columns])
    return df


def _bounds(flat: DataFrame, by, value: str, sums) -> DataFrame:
    """Per group: approximate quantile cut points as COARSE lists of FINE values, and totals.

    The sketch only balances the buckets; results do not depend on its accuracy. Totals
    come from the same aggregate, so the distinct values are shuffled once for all uses.
    """
    probs = F.expr("array(" + ", ".join(f"{i / BUCKETS}D" for i in range(1, BUCKETS)) + ")")
    cuts = flat.groupBy(*by).agg(
        F.percentile_approx(value, probs, BUCKETS * 10).alias("_cuts"),
        *[F.sum(k).alias(f"{k}_total") for k in sums])
    return cuts.withColumn("_cuts", F.transform(
        F.sequence(F.lit(1), F.lit(COARSE)), lambda i: F.slice("_cuts", (i - 1) * FINE + 1, FINE)))


def _bucket(value: Column, cuts: Column) -> Column:
    """Number of cut points below ``value``, found in COARSE + FINE comparisons."""
    below = lambda cut: cut < value
    coarse = F.size(F.filter(cuts, lambda fine: below(fine[0])))
    block = F.get(cuts, coarse - 1)
    return F.when(coarse > 0, (coarse - 1) * FINE + F.size(F.filter(block, below))).otherwise(0)


def prefix_sums(df: DataFrame, value: str, sums: dict, by=(), descending=False) -> DataFrame:
    """Distinct values with exclusive prefix sums in value order.

    ``sums`` maps an output name to an aggregate column; each name comes back as the
    total at that value, as ``<name>_before`` over all values that sort before it and as
    ``<name>_total`` over the group. ``n`` counts rows. One row per (``by``, distinct value).
    """
    by = list(by)
    sums = {"n": F.count("*"), **sums}
    flat = df.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(*[c.alias(k) for k, c in sums.items()])
    bounds = _bounds(flat, by, value, sums)
    cut = flat.join(bounds, by) if by else beside(flat, bounds)
    # Every use of the bounds needs every total, so all of them share one aggregate and
    # one shuffle of the distinct values.
    known = reduce(lambda a, b: a & b, [F.col(f"{k}_total").isNotNull() for k in sums])
    bucketed = cut.withColumn("_b", F.when(known, _bucket(F.col(value), F.col("_cuts")))).drop("_cuts")
    totals = bucketed.groupBy(*by, "_b").agg(*[F.sum(k).alias(f"_t_{k}") for k in sums])
    earlier = (
        Window.partitionBy(*(by or [F.lit(0)])).orderBy(F.col("_b") * (-1 if descending else 1))
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    carry = totals.select(
        *by, "_b", *[F.coalesce(F.sum(f"_t_{k}").over(earlier), F.lit(0)).alias(f"_c_{k}") for k in sums])
    order = F.col(value).desc() if descending else F.col(value).asc()
    within = Window.partitionBy(*by, "_b").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    # At most BUCKETS rows per group carry the offsets back.
    joined = bucketed.join(carry, [*by, "_b"])
    return joined.select(
        *by, value, *sums, *[f"{k}_total" for k in sums],
        *[(F.coalesce(F.sum(k).over(within), F.lit(0)) + F.col(f"_c_{k}")).alias(f"{k}_before") for k in sums],
    )


def exact_quantiles(df: DataFrame, value: str, probs, by=()) -> DataFrame:
    """Linear-interpolated quantiles: one row per group with ``q`` (array in ``probs`` order).

    A quantile lies between two ranks; each rank falls into the run of one distinct value.
    """
    by = list(by)
    ranked = prefix_sums(df, value, {}, by)
    first, last = F.col("n_before"), F.col("n_before") + F.col("n") - 1
    spots = F.array(*[
        F.struct(F.lit(i).alias("i"), ((F.col("n_total") - 1) * F.lit(float(p))).alias("pos"))
        for i, p in enumerate(probs)])
    inside = lambda rank: (rank >= first) & (rank <= last)
    low, high = (lambda w: F.floor(w["pos"])), (lambda w: F.ceil(w["pos"]))
    hits = ranked.select(*by, F.col(value).alias("_v"), first.alias("_lo"), last.alias("_hi"), F.explode(
        F.filter(spots, lambda w: inside(low(w)) | inside(high(w)))).alias("w"))
    within = lambda rank: (rank >= F.col("_lo")) & (rank <= F.col("_hi"))
    w = F.col("w")
    parts = hits.groupBy(*by, F.col("w.i").alias("i")).agg(
        F.max(F.when(within(low(w)), F.col("_v"))).alias("low"),
        F.max(F.when(within(high(w)), F.col("_v"))).alias("high"),
        F.max(w["pos"] - low(w)).alias("frac"),
    )
    point = F.col("low") + (F.col("high") - F.col("low")) * F.col("frac")
    return parts.groupBy(*by).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("i", point.alias("x")))), lambda s: s["x"]).alias("q"))


def competition_rank(df: DataFrame, value: str, out: str, by=(), descending=True) -> DataFrame:
    """Standard competition rank (ties share the smallest rank), joined back by value.

    The rank table has one row per distinct value; Spark broadcasts it when its measured
    size allows and otherwise splits a hot value's rows with the adaptive skew join.
    """
    by = list(by)
    ranks = prefix_sums(df, value, {}, by, descending).select(
        *by, value, (F.col("n_before") + 1).alias(out))
    return df.join(ranks, [*by, value], "left").select(*df.columns, out)


# --- exact splits in hash order -------------------------------------------------------

#: Rows that share a hash prefix, about; the prefix gets longer as the table grows.
PREFIX_ROWS = 1 << 20


def _prefix(df: DataFrame, hashed: str) -> Column:
    """The leading hash digits that cut ``df`` into parts of about ``PREFIX_ROWS`` rows."""
    digits = df.agg(F.greatest(F.lit(1), F.ceil(F.log(16.0, F.count("*") / F.lit(PREFIX_ROWS))).cast("int"))).scalar()
    return F.substr(F.col(hashed), F.lit(1), digits)


def hash_key(key, seed) -> Column:
    """Uniform text key that any engine can reproduce: md5 of ``key|seed``."""
    return F.md5(F.concat_ws("|", F.col(key).cast("string"), F.lit(str(seed))))


def hash_cuts(df: DataFrame, stratum: str, sizes: DataFrame, hashed="_h") -> DataFrame:
    """The hash value at given ranks within each stratum.

    ``sizes`` holds (stratum, ``cut``, ``rank``), a few rows per stratum. Counts by hash
    prefix locate the one prefix holding each rank; only rows with that prefix are sorted. Output: one row per stratum with ``cuts``, a map from cut to hash; a rank
    of 0 has no entry.
    """
    prefix = _prefix(df, hashed)
    counts = df.groupBy(F.col(stratum), prefix.alias("_p")).agg(F.count("*").alias("_c"))
    run = Window.partitionBy(stratum).orderBy("_p").rowsBetween(Window.unboundedPreceding, 0)
    located = counts.withColumn("_upto", F.sum("_c").over(run))
    target = (
        located.join(sizes, stratum)
        .filter((F.col("rank") > F.col("_upto") - F.col("_c")) & (F.col("rank") <= F.col("_upto")))
        .select(stratum, "_p", "cut", (F.col("rank") - F.col("_upto") + F.col("_c")).alias("_local"))
    )
    near = df.select(F.col(stratum), prefix.alias("_p"), F.col(hashed)).join(
        target.select(stratum, "_p").distinct(), [stratum, "_p"], "left_semi")
    local = near.withColumn("_rn", F.row_number().over(Window.partitionBy(stratum, "_p").orderBy(hashed)))
    found = local.join(target, [stratum, "_p"]).filter(F.col("_rn") == F.col("_local"))
    return found.groupBy(stratum).agg(
        F.map_from_entries(F.collect_list(F.struct("cut", hashed))).alias("cuts"))


def hash_order(df: DataFrame, stratum: str, hashed="_h", out="_rn") -> DataFrame:
    """Exact 1-based position of every row in hash order within its stratum."""
    prefix = _prefix(df, hashed)
    cut = df.withColumn("_p", prefix)
    counts = cut.groupBy(stratum, "_p").agg(F.count("*").alias("_c"))
    earlier = Window.partitionBy(stratum).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    carry = counts.select(stratum, "_p", F.coalesce(F.sum("_c").over(earlier), F.lit(0)).alias("_o"))
    local = F.row_number().over(Window.partitionBy(stratum, "_p").orderBy(hashed))
    return cut.join(carry, [stratum, "_p"]).withColumn(out, local + F.col("_o")).drop("_p", "_o")
