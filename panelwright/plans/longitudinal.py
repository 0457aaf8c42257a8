"""Monthly panel to checked, annotated and split training tables."""

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwright.operators import panel as P
from panelwright.operators import quality as V
from panelwright.operators import split as K
from panelwright.sources.sinks import save_artifacts


@dataclass
class Longitudinal:
    """Lazy result tables of the job and the facts recorded on the way."""

    annotated: DataFrame
    model_a: DataFrame
    model_b: DataFrame
    targets: DataFrame
    issues: DataFrame
    metadata: dict = field(default_factory=dict)

    def save(self, path) -> dict:
        """Write the annotated table once; the other tables are columns of what was written."""
        paths = save_artifacts({"annotated": self.annotated}, self.metadata, path)
        stored = self.annotated.sparkSession.read.parquet(paths["annotated"])
        rest = {"model_a": self.model_a, "model_b": self.model_b, "targets": self.targets}
        return paths | save_artifacts({name: stored.select(*df.columns) for name, df in rest.items()}, self.metadata, path)


def build(df: DataFrame, horizons=(1, 3, 6, 12), cost_threshold=0.05, schedule_threshold=0.0,
          train_end=None, test_start=None, val_end=None, train_ratio=0.7, val_ratio=0.0,
          test_ratio=None, embargo=0, split=True, strict=True) -> Longitudinal:
    """Validate, add features and targets over one shuffle, audit names, label the split.

    Actions: the issue table (a few rows), the period list, the split check. Everything
    else stays lazy until it is written.
    """
    horizons = P.check_horizons(horizons, cost_threshold, schedule_threshold)
    df = V.normalize_headers(df)
    issues = V.validate_panel(df, allow_snapshot_only=True)
    found = issues.collect()  # at most one row per rule and column
    hard = [r for r in found if r.severity == "HARD_FAIL"]
    if strict and hard:
        V.require_clean(issues)
    cols = P.require_panel(df) if hard else P.detect_columns(df.columns)
    annotated = P.annotate(df, horizons, cost_threshold, schedule_threshold, cols)
    targets = [c for c in P.target_columns(horizons) if c in annotated.columns]
    features = annotated.drop(*targets)
    a, b = P.model_a(features, cols), P.model_b(features, cols)
    for table in (a, b):
        V.audit_separation(table, targets)
    metadata = {
        "horizons": horizons, "cost_overrun_threshold": cost_threshold,
        "schedule_deterioration_threshold": schedule_threshold,
        "validation_status": "FAIL" if hard else "PASS", "validation_hard_fails": len(hard),
        "validation_warnings": len(found) - len(hard), "leakage_audit_status": "PASS",
        "model_a_feature_count": len(a.columns), "model_b_feature_count": len(b.columns),
        "target_column_count": len(targets), "temporal_split_status": "ENABLED" if split else "DISABLED",
    }
    if split:
        periods = K.distinct_periods(df, cols.period)
        if train_end is None:
            train_end, val_end = K.ratio_cutoffs(periods, train_ratio, val_ratio, test_ratio, embargo)
        roles = K.cutoff_roles(periods, train_end, test_start, val_end, embargo)
        annotated = K.label_periods(annotated, cols.period, roles)
        # The check needs the labels and the keys only, not the features.
        K.require_split(K.label_periods(df.select(cols.entity, cols.period), cols.period, roles),
                        cols.period, cols.entity, embargo)
        metadata["reporting_periods"] = periods
        metadata["split_periods"] = {r: [p for p in periods if roles.get(p) == r] for r in set(roles.values())}
    return Longitudinal(annotated, a, b, annotated.select(*targets), issues, metadata)


def summary(result: Longitudinal, entity="project_code", time="reporting_period") -> DataFrame:
    """One row of totals of the finished table."""
    return result.annotated.agg(
        F.count("*").alias("final_rows"), F.count_distinct(entity).alias("unique_projects"),
        F.count_distinct(time).alias("periods"))
