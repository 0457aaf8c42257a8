"""Temporal splits with embargo, rolling folds, and exact stratified hold-outs.

A temporal split is a range test on the period, decided from the list of distinct
periods (months, checked by their layout; the only thing collected). Rows never move.
"""

from math import floor

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelwright.errors import LeakageError, SplitError
from panelwright.functions.periods import PERIOD_PATTERN, month_distance
from panelwright.operators.scale import beside, hash_cuts, hash_key, hash_order


def _period_column(df: DataFrame, time: str):
    if time not in df.columns:
        raise SplitError(f"time column '{time}' not found")
    if isinstance(df.schema[time].dataType, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return F.date_format(time, "yyyy-MM")
    return F.trim(F.col(time).cast("string"))


def distinct_periods(df: DataFrame, time="reporting_period") -> list:
    """Sorted distinct periods; raises on an empty panel or a NULL period."""
    month = F.col("p").rlike(PERIOD_PATTERN)
    # Months of four-digit years bound the list, whatever the table holds.
    found = df.select(_period_column(df, time).alias("p")).distinct().agg(
        F.count("*").alias("n"), F.count_if(F.col("p").isNull()).alias("nulls"), F.min(F.when(~month, F.col("p"))).alias("other"),
        F.sort_array(F.collect_list(F.when(month, F.col("p")))).alias("periods")).first()
    if not found.n:
        raise SplitError("input is empty")
    if found.nulls:
        raise SplitError(f"time column '{time}' contains nulls")
    if found.other is not None:
        raise SplitError(f"'{time}' holds '{found.other}', which is no month")
    return found.periods


def _check_embargo(embargo):
    if embargo < 0:
        raise SplitError(f"embargo must not be negative, got {embargo}")


def cutoff_roles(periods, train_end, test_start=None, val_end=None, embargo=0) -> dict:
    """Role of every period under explicit cutoffs, with the embargo in observed periods."""
    _check_embargo(embargo)
    train = [p for p in periods if p <= train_end]
    if not train:
        raise SplitError(f"no periods up to train_end '{train_end}'")
    roles = dict.fromkeys(train, "train")
    boundary = train[-1]
    if val_end is not None:
        if val_end <= train_end:
            raise SplitError(f"val_end '{val_end}' must be after train_end '{train_end}'")
        later = [p for p in periods if p > boundary]
        # The gap before validation is skipped when too few periods remain.
        held = later[:embargo] if len(later) > embargo else []
        val = [p for p in later if p <= val_end and p not in held]
        if not val:
            raise SplitError(f"no periods for validation up to '{val_end}'")
        roles.update(dict.fromkeys(held, "val_embargo"))
        roles.update(dict.fromkeys(val, "val"))
        boundary = val[-1]
    rest = [p for p in periods if p > boundary]
    if test_start is not None:
        if test_start <= boundary:
            raise SplitError(f"test_start '{test_start}' must be after '{boundary}'")
        start = test_start
    elif len(rest) <= embargo:
        raise SplitError(f"{len(rest)} periods after '{boundary}' cannot hold embargo {embargo} and a test set")
    else:
        start = rest[embargo]
    test = [p for p in rest if p >= start]
    if not test:
        raise SplitError(f"no periods from test_start '{start}'")
    roles.update(dict.fromkeys([p for p in rest if p < start], "purged"))
    roles.update(dict.fromkeys(test, "test"))
    return roles


def ratio_cutoffs(periods, train_ratio=0.7, val_ratio=0.0, test_ratio=None, embargo=0):
    """``(train_end, val_end)`` from shares of the distinct periods."""
    _check_embargo(embargo)
    if not 0.0 < train_ratio < 1.0:
        raise SplitError(f"train_ratio must be inside (0, 1), got {train_ratio}")
    if not 0.0 <= val_ratio < 1.0:
        raise SplitError(f"val_ratio must be inside [0, 1), got {val_ratio}")
    test_ratio = 1.0 - train_ratio - val_ratio if test_ratio is None else test_ratio
    if test_ratio <= 0.0 or train_ratio + val_ratio + test_ratio > 1.0001:
        raise SplitError("ratios must leave a test share and not exceed 1")
    n = len(periods)
    if n < 2:
        raise SplitError(f"at least 2 distinct periods are needed, got {n}")
    n_train = max(1, floor(n * train_ratio))
    n_val = max(1, floor(n * val_ratio)) if val_ratio > 0.0 else 0
    if n_train + n_val + embargo >= n:
        raise SplitError(f"train {n_train} + val {n_val} + embargo {embargo} leave no test period of {n}")
    return periods[n_train - 1], periods[n_train + n_val - 1] if n_val else None


def _ranges(roles: dict) -> list:
    """Consecutive periods of one role as ``(role, first, last)``."""
    out = []
    for p in sorted(roles):
        if out and out[-1][0] == roles[p]:
            out[-1][2] = p
        else:
            out.append([roles[p], p, p])
    return out


def label_periods(df, time, roles, out="split"):
    p = _period_column(df, time)
    label = F.lit(None).cast("string")
    for role, first, last in _ranges(roles):
        label = F.when(p.between(first, last), F.lit(role)).otherwise(label)
    return df.withColumn(out, label)


def split_by_cutoffs(df, train_end, test_start=None, val_end=None, embargo=0,
                     time="reporting_period", entity="project_code", verify=True) -> DataFrame:
    """All rows plus ``split``: train, val, test, purged or val_embargo."""
    roles = cutoff_roles(distinct_periods(df, time), train_end, test_start, val_end, embargo)
    out = label_periods(df, time, roles)
    if verify:
        require_split(out, time, entity, embargo)
    return out


def split_by_ratio(df, train_ratio=0.7, val_ratio=0.0, test_ratio=None, embargo=0,
                   time="reporting_period", entity="project_code", verify=True) -> DataFrame:
    periods = distinct_periods(df, time)
    train_end, val_end = ratio_cutoffs(periods, train_ratio, val_ratio, test_ratio, embargo)
    out = label_periods(df, time, cutoff_roles(periods, train_end, None, val_end, embargo))
    if verify:
        require_split(out, time, entity, embargo)
    return out


def fold_roles(periods, n_splits=3, min_train=2, test_periods=1, embargo=0, expanding=True) -> list:
    """One role map per forward-chaining fold."""
    if n_splits < 1 or min_train < 1 or test_periods < 1:
        raise SplitError("n_splits, min_train and test_periods must be at least 1")
    _check_embargo(embargo)
    spare = len(periods) - (min_train + embargo + test_periods)
    if spare < 0:
        raise SplitError(f"{len(periods)} periods cannot hold one fold")
    if n_splits > 1 and spare < n_splits - 1:
        raise SplitError(f"at most {spare + 1} folds fit, {n_splits} asked")
    folds = []
    for k in range(n_splits):
        cut = min_train + k
        start = cut + embargo
        folds.append({
            **dict.fromkeys(periods[0 if expanding else k:cut], "train"),
            **dict.fromkeys(periods[cut:start], "purged"),
            **dict.fromkeys(periods[start:start + test_periods], "test"),
        })
    return folds


def rolling_folds(df, n_splits=3, min_train=2, test_periods=1, embargo=0, expanding=True,
                  time="reporting_period") -> DataFrame:
    """Rows of every fold in one table with ``fold`` (from 1) and ``split``."""
    folds = fold_roles(distinct_periods(df, time), n_splits, min_train, test_periods, embargo, expanding)
    p = _period_column(df, time)
    uses = []
    for k, roles in enumerate(folds, 1):
        for role, first, last in _ranges(roles):
            use = F.struct(F.lit(k).alias("fold"), F.lit(role).alias("split"))
            uses.append(F.when(p.between(first, last), use))
    listed = F.filter(F.array(*uses), lambda u: u.isNotNull())
    return df.select("*", F.inline(listed))


def verify_split(df, time="reporting_period", entity="project_code", embargo=0, split="split") -> DataFrame:
    """Violations per rule of a labelled table: emptiness, order, embargo, entity order."""
    p = _period_column(df, time)
    low = lambda role: F.min(F.when(F.col(split) == role, F.col("_p")))
    high = lambda role: F.max(F.when(F.col(split) == role, F.col("_p")))
    marks = [low("train").alias("train_min"), high("train").alias("train_max"),
             low("val").alias("val_min"), high("val").alias("val_max"), low("test").alias("test_min")]
    labelled = df.select(_entity_or_null(df, entity).alias("_e"), F.col(split), p.alias("_p"))
    per_entity = labelled.groupBy("_e").agg(*marks)
    c = F.col
    bad = lambda a, b: c(a) >= c(b)
    known = c("_e").isNotNull()
    whole = per_entity.agg(
        F.max("train_max").alias("train_max"), F.min("val_min").alias("val_min"),
        F.max("val_max").alias("val_max"), F.min("test_min").alias("test_min"),
        F.count_if(known & bad("train_max", "test_min")).alias("entity_test"),
        F.count_if(known & bad("train_max", "val_min")).alias("entity_val"),
        F.count_if(known & c("train_max").isNotNull() & c("test_min").isNotNull()).alias("repeated"),
    )
    distance = month_distance("train_max", F.coalesce("val_min", "test_min"))
    yes = lambda cond: F.coalesce(cond, F.lit(False)).cast("long")
    rules = [
        ("empty_train", yes(c("train_max").isNull())),
        ("empty_test", yes(c("test_min").isNull())),
        ("train_before_test", yes(bad("train_max", "test_min"))),
        ("train_before_val", yes(bad("train_max", "val_min"))),
        ("val_before_test", yes(bad("val_max", "test_min"))),
        ("embargo", yes((distance > 0) & (distance <= embargo)) if embargo > 0 else F.lit(0).cast("long")),
        ("entity_train_before_test", c("entity_test")),
        ("entity_train_before_val", c("entity_val")),
    ]
    return whole.select("repeated", F.inline(F.array(*[
        F.struct(F.lit(n).alias("rule"), v.alias("violations")) for n, v in rules]))).select(
        "rule", "violations", F.col("repeated").alias("repeated_entities"))


def _entity_or_null(df, entity):
    return F.col(entity).cast("string") if entity and entity in df.columns else F.lit(None).cast("string")


def require_split(df, time="reporting_period", entity="project_code", embargo=0):
    """Raise on any violation; the result is one aggregate of eight rows."""
    broken = [r for r in verify_split(df, time, entity, embargo).collect() if r.violations]
    if any(r.rule.startswith("empty") for r in broken):
        raise SplitError(", ".join(r.rule for r in broken))
    if broken:
        raise LeakageError(", ".join(f"{r.rule}: {r.violations}" for r in broken))


def split_summary(df, time="reporting_period", split="split") -> DataFrame:
    """Rows, periods and period range of each split; the period set is bounded by months."""
    p = _period_column(df, time)
    return df.groupBy(split).agg(
        F.count("*").alias("row_count"), F.sort_array(F.collect_set(p)).alias("periods"),
        F.min(p).alias("min_period"), F.max(p).alias("max_period"))


# --- stratified hold-outs -------------------------------------------------------------


def _allocate(counts: DataFrame, rows: str, share: float, out: str) -> DataFrame:
    """Split ``ceil(share * total)`` over the strata by largest remainder.

    One row per class goes in, so the unpartitioned window is over a handful of rows.
    """
    everything = Window.partitionBy(F.lit(0))
    exact = F.col("_want") * F.col(rows) / F.col("_all")
    ranked = everything.orderBy((F.col("_exact") - F.floor("_exact")).desc(), F.col("_s"))
    return (
        counts.withColumn("_all", F.sum(rows).over(everything))
        .withColumn("_want", F.ceil(F.round(F.col("_all") * share, 9)))
        .withColumn("_exact", F.round(exact, 9))
        .withColumn("_left", F.col("_want") - F.sum(F.floor("_exact")).over(everything))
        .withColumn(out, F.floor("_exact") + (F.row_number().over(ranked) <= F.col("_left")).cast("long"))
        .drop("_all", "_want", "_exact", "_left")
    )


def stratified_partition(df, y: str, key: str, seed=42, test=0.20, calibration=0.25,
                         eligible=None, out="partition") -> DataFrame:
    """MODELFIT / CALIBRATION_HOLDOUT / TEST_HOLDOUT / NOT_ELIGIBLE with exact class counts.

    Rows are taken in the order of ``md5(key|seed)`` within each class; the hold-out is
    the first share, calibration the next. Rows meet only the cut hashes of their class
    (two values), so labelling needs no order of the rows themselves.
    """
    usable = F.col(y).isNotNull() if eligible is None else F.coalesce(eligible, F.lit(False)) & F.col(y).isNotNull()
    hashed = df.withColumns({"_s": F.when(usable, F.col(y)), "_h": hash_key(key, seed)})
    pool = hashed.filter(F.col("_s").isNotNull())
    counts = pool.groupBy("_s").agg(F.count("*").alias("rows"))
    sized = _allocate(counts, "rows", test, "n_test").withColumn("rest", F.col("rows") - F.col("n_test"))
    sized = _allocate(sized, "rest", calibration, "n_cal")
    sizes = sized.select("_s", F.inline(F.array(
        F.struct(F.lit("test").alias("cut"), F.col("n_test").alias("rank")),
        F.struct(F.lit("cal").alias("cut"), (F.col("n_test") + F.col("n_cal")).alias("rank")))))
    cuts = hash_cuts(pool.select("_s", "_h"), "_s", sizes)
    label = (
        F.when(F.col("_s").isNull(), "NOT_ELIGIBLE")
        .when(F.col("_h") <= F.col("cuts")["test"], "TEST_HOLDOUT")
        .when(F.col("_h") <= F.col("cuts")["cal"], "CALIBRATION_HOLDOUT")
        .otherwise("MODELFIT")
    )
    # One row per class becomes one map, so no row is shuffled on its class.
    table = cuts.agg(F.map_from_entries(F.collect_list(F.struct("_s", "cuts"))).alias("_table"))
    return beside(hashed, table).withColumn("cuts", F.col("_table")[F.col("_s")]).withColumn(out, label).select(*df.columns, out)


def stratified_kfold(df, y: str, key: str, k=5, seed=42, out="fold") -> DataFrame:
    """Fold 0..k-1 dealt round-robin in hash order within each class."""
    hashed = df.withColumn("_h", hash_key(key, seed))
    return hash_order(hashed, y).withColumn(out, ((F.col("_rn") - 1) % k).cast("int")).select(*df.columns, out)


def eligible_rows(df, flag_column: str) -> DataFrame:
    return df.filter(F.col(flag_column) == 1)


def sensitivity_flag(df, progress="feat_physical_progress_pct", limit=99.0, out="is_near_complete") -> DataFrame:
    """Mark rows at or beyond ``limit`` progress; no row is dropped."""
    return df.withColumn(out, F.coalesce(F.col(progress) >= limit, F.lit(False)).cast("int"))
