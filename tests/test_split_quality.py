"""Temporal splits, hold-outs and the panel contract."""

import pytest
from pyspark.sql import functions as F

from panelwright.errors import ContractError, LeakageError, SplitError
from panelwright.operators import quality as V
from panelwright.operators import split as K
from panelwright.plans import longitudinal


@pytest.fixture(scope="module")
def panel(spark):
    rows = [(f"2025-{m:02d}", f"P{p}", 10.0 * m, 5.0 * m) for m in range(1, 7) for p in (101, 102, 103)]
    return spark.createDataFrame(rows, "reporting_period string, project_code string, expenditure_cr double, physical_progress_pct double")


def _counts(df, *by):
    return {tuple(r[c] for c in by): r["count"] for r in df.groupBy(*by).count().collect()}


def test_cutoffs(panel):
    assert _counts(K.split_by_cutoffs(panel, "2025-03"), "split") == {("train",): 9, ("test",): 9}
    out = K.split_by_cutoffs(panel, "2025-02", test_start="2025-05", val_end="2025-04")
    assert _counts(out, "split") == {("train",): 6, ("val",): 6, ("test",): 6}
    out = K.split_by_cutoffs(panel, "2025-02", embargo=2)
    assert _counts(out, "split") == {("train",): 6, ("purged",): 6, ("test",): 6}


def test_validation_embargo_is_skipped_when_short():
    roles = K.cutoff_roles(["2025-01", "2025-02", "2025-03"], "2025-01", test_start="2025-03", val_end="2025-02", embargo=2)
    assert roles["2025-02"] == "val"


def test_ratio(panel):
    out = K.split_by_ratio(panel, 0.5, embargo=1)
    assert _counts(out, "split") == {("train",): 9, ("purged",): 3, ("test",): 6}


def test_rolling(panel):
    out = K.rolling_folds(panel, 3, 2, 1, 1)
    tests = {r.fold: r.p for r in out.filter("split = 'test'").groupBy("fold").agg(F.max("reporting_period").alias("p")).collect()}
    assert tests == {1: "2025-04", 2: "2025-05", 3: "2025-06"}
    with pytest.raises(SplitError):
        K.rolling_folds(panel, 6, 2, 1, 1)


def test_split_errors(panel):
    with pytest.raises(SplitError):
        K.split_by_cutoffs(panel, "2025-05", val_end="2025-04")
    with pytest.raises(SplitError):
        K.split_by_cutoffs(panel, "2025-05", embargo=3)
    with pytest.raises(SplitError):
        K.split_by_cutoffs(panel.drop("reporting_period"), "2025-05")
    with pytest.raises(SplitError):
        K.split_by_cutoffs(panel, "2024-01")
    with pytest.raises(SplitError):
        K.split_by_ratio(panel, 1.5)
    leaky = panel.withColumn("split", F.when(F.col("project_code") == "P101", "test").otherwise("train"))
    with pytest.raises(LeakageError):
        K.require_split(leaky)


def test_partition_shuffles_no_row_on_its_class(spark):
    df = spark.range(1000).select(F.col("id"), (F.col("id") % 3 == 0).cast("int").alias("y"), F.lit("x").alias("wide"))
    plan = K.stratified_partition(df, "y", "id")._jdf.queryExecution().optimizedPlan().toString()
    main = plan.split("scalar-subquery")[0]
    assert "Join" not in main and "wide" in main


def test_partition_sizes_match_the_stratified_rule(spark):
    df = spark.range(437).withColumn("y", (F.col("id") < 132).cast("int"))
    got = _counts(K.stratified_partition(df, "y", "id"), "partition", "y")
    # ceil(.2 * 437) = 88 rows in proportion 132 : 305, then ceil(.25 * 349) = 88.
    assert got[("TEST_HOLDOUT", 1)] + got[("TEST_HOLDOUT", 0)] == 88
    assert got[("CALIBRATION_HOLDOUT", 1)] + got[("CALIBRATION_HOLDOUT", 0)] == 88
    assert (got[("TEST_HOLDOUT", 1)], got[("TEST_HOLDOUT", 0)]) == (27, 61)
    again = K.stratified_partition(df.repartition(13), "y", "id")
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, K.stratified_partition(df, "y", "id").collect()))


def test_kfold_is_balanced(spark):
    df = spark.range(103).withColumn("y", (F.col("id") % 3 == 0).cast("int"))
    got = _counts(K.stratified_kfold(df, "y", "id", 5), "fold", "y")
    for y in (0, 1):
        sizes = [got[(f, y)] for f in range(5)]
        assert max(sizes) - min(sizes) <= 1


# --- contract ----------------------------------------------------------------------------

SCHEMA = ("reporting_period string, project_code string, project_name string, sector string, line_ministry string, "
          "original_cost_cr double, revised_cost_cr double, expenditure_cr double, physical_progress_pct double, "
          "start_date string, original_end_date string, revised_end_date string")


@pytest.fixture(scope="module")
def good(spark):
    rows = [(f"2026-{m:02d}", p, f"Project {p}", "Rail", "Ministry", 100.0, 110.0 if m > 5 else 100.0, 10.0 * m, 5.0 * m,
             "2024-01-01", "2027-01-01", "2027-06-01" if p == "P101" else "2027-01-01")
            for m in (5, 6, 7) for p in ("P101", "P102")]
    return spark.createDataFrame(rows, SCHEMA)


def _rules(df, **kw):
    return {r.rule_id for r in V.validate_panel(df, **kw).collect()}


def test_clean_panel_passes(good):
    assert _rules(good) == set()
    assert V.status(V.validate_panel(good)).first().status == "PASS"


MUTATIONS = {
    "DC-IDENTITY-03": lambda d: d.unionByName(d.limit(1)),
    "DC-IDENTITY-01": lambda d: d.withColumn("project_code", F.when(F.col("project_code") != "P101", F.col("project_code"))),
    "DC-TIME-01": lambda d: d.withColumn("reporting_period", F.regexp_replace("reporting_period", "2026-05", "05/2026")),
    "DC-NUM-02": lambda d: d.withColumn("expenditure_cr", F.lit(-1.0)),
    "DC-NUM-04": lambda d: d.withColumn("physical_progress_pct", F.lit(101.0)),
    "DC-DERIVED-01": lambda d: d.withColumn("recent_cost_change", F.lit(1.0)),
    "DC-TARGET-01": lambda d: d.withColumn("target", (F.col("revised_end_date") > F.col("original_end_date")).cast("int")),
    "DC-TARGET-02": lambda d: d.withColumn("target", (F.col("revised_cost_cr") > F.col("original_cost_cr")).cast("int")),
    "DC-SCHEMA-01": lambda d: d.drop("sector"),
    "DC-TIME-03": lambda d: d.withColumn("start_date", F.lit("soon")),
    "DC-NUM-WARN-01": lambda d: d.withColumn("revised_cost_cr", F.lit(50.0)),
}


@pytest.mark.parametrize("rule", MUTATIONS)
def test_each_rule_fires(good, rule):
    assert rule in _rules(MUTATIONS[rule](good))


def test_velocity_over_a_gap(good):
    gap = good.filter("reporting_period <> '2026-06'").withColumn(
        "recent_cost_change", F.when(F.col("reporting_period") == "2026-07", 1.0))
    assert "DC-DERIVED-01" in _rules(gap)
    ok = good.withColumn("recent_cost_change", F.when(F.col("reporting_period") != "2026-05", 1.0))
    assert _rules(ok) == set()


def test_leakage_rules(good):
    assert "LR-01-04" in _rules(good, cutoff="2026-06")
    assert {"LR-05", "LR-06", "LR-ENTITY"} <= _rules(
        good.withColumns({"future_slip": F.lit(1), "final_cost": F.lit(1)}), feature_matrix=True)


def test_snapshot_only(good):
    one = good.filter("reporting_period = '2026-05'")
    assert V.status(V.validate_panel(one)).first().status == "SNAPSHOT_ONLY"
    assert _rules(one, allow_snapshot_only=True) == set()
    assert V.status(V.validate_panel(good.drop("reporting_period"))).first().status == "SNAPSHOT_ONLY"


def test_headers(good):
    messy = good.withColumnRenamed("sector", " Sector Name ").withColumnRenamed("expenditure_cr", "Expenditure\n(in Cr.)")
    assert {"sector", "expenditure_cr"} <= set(V.normalize_headers(messy).columns)


def test_longitudinal_job(good, tmp_path, spark):
    done = longitudinal.build(good, (1,), train_ratio=0.5)
    assert done.metadata["validation_status"] == "PASS" and done.metadata["model_b_feature_count"] == 20
    assert _counts(done.annotated, "split") == {("train",): 2, ("test",): 4}
    paths = done.save(str(tmp_path / "out"))
    assert spark.read.parquet(paths["annotated"]).count() == 6
    with pytest.raises(ContractError):
        longitudinal.build(MUTATIONS["DC-NUM-02"](good), (1,))
