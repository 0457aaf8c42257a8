"""Harmonise differing snapshot layouts into one 30-column table of text."""

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelwright.functions.periods import is_bad_month, strict_month
from panelwright.functions.text import blank_to_null, record_hash

# Canonical columns in table order.
CANONICAL_COLUMNS = [
    "canonical_observation_key", "source_snapshot", "snapshot_date", "source_table",
    "source_project_id", "project_name", "agency", "state",
    "approval_date_raw", "approval_date", "start_date_raw", "start_date",
    "original_completion_date_raw", "original_completion_date",
    "revised_completion_date_raw", "revised_completion_date",
    "anticipated_completion_date_raw", "anticipated_completion_date",
    "original_cost_crore", "revised_cost_crore", "anticipated_cost_crore",
    "cumulative_expenditure_crore", "physical_progress_pct",
    "source_page", "source_row", "source_file", "source_record_hash",
    "sector", "legacy_ocms_code", "pmgid",
]
DATE_FIELDS = ["approval_date", "start_date", "original_completion_date", "revised_completion_date",
               "anticipated_completion_date"]
# Canonical name to source name where they differ.
RENAMED = {"source_project_id": "project_id", "source_row": "sl_no"}


@dataclass(frozen=True)
class SnapshotSpec:
    """One source layout: its labels and the canonical fields it does not publish."""

    snapshot: str
    snapshot_date: str
    table: str
    source_file: str
    absent: tuple = field(default=())


def observation_key(snapshot, table, project_id) -> Column:
    return F.concat_ws(":", snapshot, table, project_id)


def to_canonical(df: DataFrame, spec: SnapshotSpec, bad_months="raise") -> DataFrame:
    """Project a source table onto the canonical columns.

    Absent fields are NULL, raw and normalised months stand side by side, and a month in
    no known layout raises (or is NULL with ``bad_months="null"``, see
    :func:`rejected_months`).
    """
    source = lambda c: F.col(RENAMED.get(c, c)).cast("string")
    published = lambda c: c not in spec.absent and RENAMED.get(c, c) in df.columns
    null = F.lit(None).cast("string")

    def month(c):
        value = strict_month(source(c))
        if bad_months == "raise":
            report = F.concat(F.lit(f"{c}: not a month: "), source(c))
            value = F.when(is_bad_month(source(c)), F.raise_error(report).cast("string")).otherwise(value)
        return value

    fixed = {
        "canonical_observation_key": observation_key(
            F.lit(spec.snapshot), F.lit(spec.table), F.trim(source("source_project_id"))),
        "source_snapshot": F.lit(spec.snapshot),
        "snapshot_date": F.lit(spec.snapshot_date),
        "source_table": F.lit(spec.table),
        "source_file": F.lit(spec.source_file),
        "source_record_hash": record_hash(df.columns),
    }
    out = []
    for c in CANONICAL_COLUMNS:
        base = c.removesuffix("_raw")
        if c in fixed:
            value = fixed[c]
        elif not published(base):
            value = null
        elif base in DATE_FIELDS:
            value = blank_to_null(source(base)) if c.endswith("_raw") else month(base)
        else:
            value = blank_to_null(source(c))
        out.append(value.alias(c))
    return df.select(*out)


def rejected_months(df: DataFrame, columns) -> DataFrame:
    """(column, value, rows) of month text in no known layout."""
    cells = F.array(*[
        F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("value")) for c in columns])
    return (df.select(F.inline(cells)).filter(is_bad_month("value"))
            .groupBy("column_name", "value").agg(F.count("*").alias("row_count")))


def union_snapshots(*snapshots: DataFrame) -> DataFrame:
    """Bag union by column name; absent columns become NULL."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), snapshots)


def in_source_order(df: DataFrame) -> DataFrame:
    """Snapshot, table, numeric source row; a range-partitioned sort."""
    return df.orderBy("source_snapshot", "source_table", F.col("source_row").try_cast("int"))


def duplicate_keys(df: DataFrame, keys) -> DataFrame:
    """Key values that occur more than once."""
    return df.groupBy(*keys).agg(F.count("*").alias("row_count")).filter(F.col("row_count") > 1)


def common_keys(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Distinct keys present on both sides."""
    return a.select(key).filter(F.col(key).isNotNull()).intersect(b.select(key))


def missing_serials(df: DataFrame, serial: str, expected) -> DataFrame:
    """Serials of 1..expected that were not seen; ``expected=None`` uses the largest seen."""
    seen = df.select(F.col(serial).cast("long").alias("serial")).distinct()
    if expected is None:
        expected = df.agg(F.max(F.col(serial).cast("long"))).first()[0] or 0
    every = df.sparkSession.range(1, expected + 1).withColumnRenamed("id", "serial")
    return every.join(seen, "serial", "left_anti")


def trajectory_labels(df: DataFrame, key: str, first: str, second: str, extra: str) -> DataFrame:
    """Keys in both snapshots, labelled by membership of an extra, earlier one."""
    held = df.groupBy(key).agg(F.collect_set("source_snapshot").alias("_s"))
    both = F.array_contains("_s", first) & F.array_contains("_s", second)
    label = F.when(F.array_contains("_s", extra), "3_SNAPSHOT").otherwise("2_SNAPSHOT_JULY")
    return held.filter(both).select(key, label.alias("trajectory_type"))
