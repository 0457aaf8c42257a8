"""Features and targets on the literal panels."""

import math

import pytest
from pyspark.sql import functions as F

from panelwright.errors import LeakageError, PanelError
from panelwright.operators import panel as P
from panelwright.operators import quality as V

FEATURE_SCHEMA = ("project_code string, reporting_period string, sector string, line_ministry string, start_date string, "
                  "original_cost_cr double, revised_cost_cr double, original_end_date string, revised_end_date string, "
                  "expenditure_cr double, physical_progress_pct double")
TARGET_SCHEMA = ("project_code string, reporting_period string, original_cost_cr double, revised_cost_cr double, "
                 "original_end_date string, revised_end_date string, physical_progress_pct double")


@pytest.fixture(scope="module")
def features(spark):
    one = lambda p, rev, end, spend, prog: ("PROJ_1", p, "R", "M", "2024-01-01", 100.0, rev, "2025-12-31", end, spend, prog)
    two = lambda p, rev, end, spend, prog: ("PROJ_2", p, "R", "M", "2023-01-01", 200.0, rev, "2026-06-30", end, spend, prog)
    rows = [one("2025-01", 100.0, "2025-12-31", 20.0, 25.0), one("2025-02", 110.0, "2026-03-31", 30.0, 35.0),
            one("2025-03", 110.0, "2026-03-31", 45.0, 45.0), two("2025-01", 200.0, "2026-06-30", 50.0, 20.0),
            two("2025-03", 220.0, "2026-09-30", 70.0, 30.0)]
    return spark.createDataFrame(rows, FEATURE_SCHEMA)


@pytest.fixture(scope="module")
def target_panel(spark):
    rows = []
    for i in range(13):
        p = f"{2025 + i // 12}-{i % 12 + 1:02d}"
        rows.append(("PROJ_A", p, 100.0, 110.0 if i >= 3 else 100.0, "2026-06-30",
                     "2026-08-30" if i >= 6 else "2026-06-30", 70.0 if i >= 6 else 50.0))
    b = lambda p, rev, end, prog: ("PROJ_B", p, 200.0, rev, "2025-03-31", end, prog)
    rows += [b("2025-01", 200.0, "2025-03-31", 80.0), b("2025-02", 200.0, "2025-03-31", 85.0),
             b("2025-04", 250.0, "2025-06-30", 90.0)]
    rows.append(("PROJ_C", "2025-06", 50.0, 50.0, "2027-12-31", "2027-12-31", 15.0))
    return spark.createDataFrame(rows, TARGET_SCHEMA)


def _row(df, entity, period):
    return df.filter((F.col("project_code") == entity) & (F.col("reporting_period") == period)).first()


def test_feature_values(features):
    out = P.panel_features(features).cache()
    assert out.count() == 5
    r = _row(out, "PROJ_1", "2025-01")
    assert (r.cost_growth_ratio, r.expenditure_to_original_cost, r.expenditure_to_revised_cost) == (1.0, 0.2, 0.2)
    assert r.schedule_slippage_days == 0 and r.expenditure_progress_gap == -5.0 and r.is_first_observation == 1
    assert r.recent_cost_change is None and r.recent_schedule_change is None
    r = _row(out, "PROJ_1", "2025-02")
    assert math.isclose(r.cost_growth_ratio, 1.1) and math.isclose(r.expenditure_to_revised_cost, 30 / 110)
    assert r.schedule_slippage_days == 90
    assert (r.recent_cost_change, r.recent_expenditure_change, r.recent_progress_change, r.recent_schedule_change) == (10, 10, 10, 90)
    r = _row(out, "PROJ_1", "2025-03")
    assert (r.recent_cost_change, r.recent_expenditure_change, r.recent_progress_change, r.recent_schedule_change) == (0, 15, 10, 0)
    r = _row(out, "PROJ_2", "2025-03")
    assert r.is_first_observation == 1 and r.recent_expenditure_change is None


def test_stored_zero_before_is_a_change(spark):
    rows = [("A", "2025-01", "R", "M", None, 100.0, 0.0, "2025-12-31", None, 1.0, 1.0),
            ("A", "2025-02", "R", "M", None, 100.0, None, "2025-12-31", None, 1.0, 1.0)]
    out = P.panel_features(spark.createDataFrame(rows, FEATURE_SCHEMA))
    assert _row(out, "A", "2025-02").recent_cost_change == 100.0
    assert _row(out, "A", "2025-01").cost_growth_ratio == 1.0


def test_nan_is_missing(spark):
    rows = [("A", "2025-01", "R", "M", None, float("nan"), float("nan"), None, None, 1.0, float("nan"))]
    r = P.panel_features(spark.createDataFrame(rows, FEATURE_SCHEMA)).first()
    assert r.cost_growth_ratio is None and r.expenditure_to_revised_cost is None and r.expenditure_progress_gap is None


def test_negative_day_difference_floors(spark):
    rows = [("A", "2025-01", "R", "M", "2025-02-02", 100.0, None, "2025-12-31", None, 1.0, 1.0)]
    assert P.panel_features(spark.createDataFrame(rows, FEATURE_SCHEMA)).first().project_age_days == -2.0


def test_panel_guards(spark, features):
    with pytest.raises(PanelError, match="duplicate"):
        P.panel_features(features.unionByName(features.limit(1)))
    with pytest.raises(PanelError, match="unparseable"):
        P.panel_features(features.withColumn("reporting_period", F.lit("soon")))
    with pytest.raises(PanelError, match="not found"):
        P.panel_features(features.drop("project_code"))
    with pytest.raises(PanelError, match="empty"):
        P.panel_features(features.limit(0))


def test_targets(target_panel):
    out = P.build_targets(target_panel).cache()
    r = _row(out, "PROJ_A", "2025-01")
    assert r.target_cost_escalation_3m_cr == 10.0 and math.isclose(r.target_cost_escalation_pct_3m, 0.1)
    assert r.target_cost_overrun_3m_binary == 1 and r.target_schedule_slippage_6m_days == 61
    assert r.target_schedule_deterioration_6m_binary == 1 and r.target_horizon_miss_3m_binary is None
    r = _row(out, "PROJ_A", "2025-04")
    assert r.target_cost_escalation_3m_cr == 0.0 and r.target_cost_overrun_3m_binary == 0
    r = _row(out, "PROJ_B", "2025-01")
    assert (r.is_observable_1m, r.is_observable_3m, r.is_observable_6m, r.is_observable_12m) == (1, 1, 0, 0)
    assert r.target_horizon_miss_3m_binary == 1
    assert _row(out, "PROJ_B", "2025-02").is_observable_1m == 0
    r = _row(out, "PROJ_C", "2025-06")
    assert r.is_observable_1m == 0 and r.target_cost_escalation_12m_cr is None


def test_schedule_threshold(target_panel):
    out = P.build_targets(target_panel, (6,), schedule_threshold=90.0)
    assert _row(out, "PROJ_A", "2025-01").target_schedule_deterioration_6m_binary == 0


def test_unrevised_fallback(spark):
    rows = [("A", "2025-01", 500.0, None, "2025-06-30", None, 10.0), ("A", "2025-02", 500.0, 550.0, "2025-06-30", "2025-09-28", 10.0)]
    r = _row(P.build_targets(spark.createDataFrame(rows, TARGET_SCHEMA), (1,)), "A", "2025-01")
    assert (r.target_cost_escalation_1m_cr, r.target_schedule_slippage_1m_days) == (50.0, 90.0)
    assert math.isclose(r.target_cost_escalation_pct_1m, 0.1)
    assert (r.target_cost_overrun_1m_binary, r.target_schedule_deterioration_1m_binary) == (1, 1)


@pytest.mark.parametrize("bad", [(0,), (-1,), ("3",), (1.5,)])
def test_horizon_guard(bad):
    with pytest.raises(PanelError):
        P.check_horizons(bad)
    assert P.check_horizons((3, 1, 3)) == [1, 3]
    with pytest.raises(PanelError):
        P.check_horizons((1,), cost_threshold=-0.1)


def test_column_detection():
    cols = P.detect_columns(["canonical_project_key", "snapshot_date", "original_cost", "rev_doc"], progress="pp")
    assert (cols.entity, cols.period, cols.original_cost, cols.revised_end, cols.progress) == (
        "canonical_project_key", "snapshot_date", "original_cost", "rev_doc", "pp")


def test_model_sets(features):
    a, b = P.model_a(features), P.model_b(features)
    assert len(a.columns) == 8 and set(a.columns) <= set(b.columns) and len(b.columns) == 20
    assert V.audit_separation(b) == 20
    with pytest.raises(LeakageError):
        V.audit_separation(b.withColumn("future_slip", F.lit(1)))


def test_one_shuffle_for_features_and_targets(features):
    plan = P.annotate(features)._jdf.queryExecution().executedPlan().toString()
    assert plan.split("Initial Plan")[0].count("Exchange hashpartitioning") == 1


@pytest.mark.parametrize("partitions", [1, 4, 17])
def test_partition_count_does_not_matter(spark, features, partitions):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        got = sorted(map(str, P.annotate(features.repartition(partitions)).collect()))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert got == sorted(map(str, P.annotate(features).collect()))
