"""Queries on the monthly panel."""

from pyspark.sql import functions as F

from panelwright.operators import panel as P
from panelwright.operators import quality as V
from panelwright.plans import derived as D
from panelwright.plans import longitudinal
from panelwright.registry import query
from panelwright.registry.sql import FEATURES, panel, rounded, targets

KEYS = ["project_code", "reporting_period"]
HORIZONS = (1, 3, 6, 12)


def _round(df, columns, digits=6):
    return df.withColumns({c: F.round(c, digits) for c in columns})


def _features(spark, sf_dir, dense):
    df = P.panel_features(D.monthly_panel(spark, sf_dir, dense), guard=False)
    return _round(df.select(*KEYS, *P.FEATURES), P.FEATURES[:-1])


def _features_sql(dense):
    return (f"WITH {panel(dense)}, {FEATURES} SELECT project_code, reporting_period, "
            f"{rounded(P.FEATURES[:-1])}, is_first_observation FROM features")


@query(_features_sql(True))
def panel_features(spark, sf_dir):
    """L0-L13 and J10 on the dense panel."""
    return _features(spark, sf_dir, True)


@query(_features_sql(False))
def panel_features_with_gaps(spark, sf_dir):
    """L9-L13 where most months have no predecessor."""
    return _features(spark, sf_dir, False)


_TARGETS = P.target_columns(HORIZONS)
_DOUBLES = [c for c in _TARGETS if c.endswith("_cr") or "_pct_" in c or c.endswith("_days")]


def _targets_sql(dense):
    cols = ", ".join(f"round({c}, 6) AS {c}" if c in _DOUBLES else c for c in _TARGETS)
    typed = FEATURES[: FEATURES.index(",\nfeatured AS")]
    return f"WITH {panel(dense)}, {typed}, {targets(HORIZONS)} SELECT project_code, reporting_period, {cols} FROM targets"


@query(_targets_sql(True))
def panel_targets(spark, sf_dir):
    """G1-G7 and J11 for four horizons on the dense panel."""
    df = P.build_targets(D.monthly_panel(spark, sf_dir), HORIZONS, guard=False)
    return _round(df.select(*KEYS, *_TARGETS), _DOUBLES)


@query(_targets_sql(False))
def panel_targets_with_gaps(spark, sf_dir):
    """Unobserved horizons stay NULL."""
    df = P.build_targets(D.monthly_panel(spark, sf_dir, dense=False), HORIZONS, guard=False)
    return _round(df.select(*KEYS, *_TARGETS), _DOUBLES)


_AUDIT = " UNION ALL ".join(
    f"SELECT {h} AS horizon, count(*) AS total_rows, count(*) FILTER (is_observable_{h}m = 1) AS observable, "
    f"count(*) FILTER (target_cost_overrun_{h}m_binary = 1) AS cost_overrun, "
    f"count(*) FILTER (target_schedule_deterioration_{h}m_binary = 1) AS schedule_deterioration, "
    f"count(*) FILTER (target_horizon_miss_{h}m_binary = 1) AS horizon_miss FROM targets" for h in HORIZONS)


@query(f"WITH {panel()}, {FEATURES[: FEATURES.index(',' + chr(10) + 'featured AS')]}, {targets(HORIZONS)} {_AUDIT}")
def horizon_audit(spark, sf_dir):
    """Observable rows and positives per horizon."""
    return P.horizon_audit(P.build_targets(D.monthly_panel(spark, sf_dir), HORIZONS, guard=False), HORIZONS)


@query(_targets_sql(True).replace("SELECT project_code, reporting_period, round", "SELECT round"))
def target_matrix(spark, sf_dir):
    """The target columns alone."""
    df = P.build_targets(D.monthly_panel(spark, sf_dir), HORIZONS, guard=False)
    return _round(P.target_matrix(df, HORIZONS), _DOUBLES)


_A = ["original_cost_cr", "revised_cost_cr", "expenditure_cr", "expenditure_to_original_cost", "physical_progress_pct"]


@query(f"WITH {panel()}, {FEATURES} SELECT sector, line_ministry, original_end_date, {rounded(_A)} FROM features")
def model_a_features(spark, sf_dir):
    """The basic feature set."""
    df = P.panel_features(D.monthly_panel(spark, sf_dir), guard=False)
    return _round(P.model_a(df), _A)


_B = _A + [c for c in P.FEATURES[:-1] if c not in _A]


@query(f"WITH {panel()}, {FEATURES} SELECT sector, line_ministry, original_end_date, {rounded(_B)}, "
       "is_first_observation FROM features")
def model_b_features(spark, sf_dir):
    """The enhanced feature set."""
    df = P.panel_features(D.monthly_panel(spark, sf_dir), guard=False)
    return _round(P.model_b(df), _B)


@query(f"WITH {panel(False)} SELECT t.project_code, t.reporting_period, t.expenditure_cr, "
       "p.expenditure_cr AS prev_expenditure_cr, p.physical_progress_pct AS prev_physical_progress_pct "
       "FROM panel t LEFT JOIN panel p ON p.project_code = t.project_code AND p.idx = t.idx - 1")
def previous_month_row(spark, sf_dir):
    """The row at exactly t-1."""
    df = P.previous_month_row(D.monthly_panel(spark, sf_dir, False), ["expenditure_cr", "physical_progress_pct"])
    return df.select(*KEYS, "expenditure_cr", "prev_expenditure_cr", "prev_physical_progress_pct")


@query(f"WITH {panel(False)} SELECT project_code, reporting_period, round((expenditure_cr - lag(expenditure_cr) OVER w) "
       "/ (idx - lag(idx) OVER w), 6) AS spend_per_month FROM panel WINDOW w AS (PARTITION BY project_code ORDER BY idx)")
def observed_rate(spark, sf_dir):
    """Change per elapsed month since the previous observed row."""
    df = P.observed_rate(D.monthly_panel(spark, sf_dir, False), "expenditure_cr", "spend_per_month")
    return _round(df.select(*KEYS, "spend_per_month"), ["spend_per_month"])


@query(f"WITH {panel()} SELECT project_code, reporting_period, "
       "CAST(coalesce(expenditure_cr > greatest(revised_cost_cr, original_cost_cr), FALSE) AS INTEGER) AS is_over_budget, "
       "CAST(revised_end_date IS NOT NULL AS INTEGER) AS has_revised_doc FROM panel")
def soft_flags(spark, sf_dir):
    """Budget breach and missing revised date."""
    return V.soft_flags(D.monthly_panel(spark, sf_dir)).select(*KEYS, "is_over_budget", "has_revised_doc")


@query(f"WITH {panel()} SELECT t.project_code, t.reporting_period, "
       "CAST(t.expenditure_cr - p.expenditure_cr < -1.0 AS INTEGER) AS is_spend_drop, "
       "CAST(t.physical_progress_pct - p.physical_progress_pct < 0 AS INTEGER) AS is_progress_reversal "
       "FROM panel t LEFT JOIN panel p ON p.project_code = t.project_code AND p.idx = t.idx - 1")
def monotonicity_flags(spark, sf_dir):
    """Spend drops and progress reversals against the previous month."""
    return V.monotonicity_flags(D.monthly_panel(spark, sf_dir)).select(*KEYS, "is_spend_drop", "is_progress_reversal")


# --- the data contract on a panel with planted defects ------------------------------------

_BROKEN_SQL = panel(False) + """,
doubled AS (SELECT panel.*, unnest(CASE WHEN id % 101 = 0 THEN [1, 2] ELSE [1] END) AS copy FROM panel),
broken AS (
  SELECT CASE WHEN id % 307 = 0 THEN NULL ELSE project_code END AS project_code,
         CASE WHEN id % 211 = 0 THEN '1998/' || substr(reporting_period, 6) ELSE reporting_period END AS reporting_period,
         'Part ' || id AS project_name, 'S' || id % 5 AS sector, 'M' || id % 3 AS line_ministry,
         CASE WHEN id % 53 = 0 THEN 0.0 ELSE original_cost_cr END AS original_cost_cr, revised_cost_cr,
         CASE WHEN id % 71 = 0 THEN -1.0 ELSE expenditure_cr END AS expenditure_cr,
         CASE WHEN id % 59 = 0 THEN 120.0 ELSE physical_progress_pct END AS physical_progress_pct,
         CASE WHEN id % 67 = 0 THEN 'soon' ELSE start_date END AS start_date, original_end_date, revised_end_date,
         CASE WHEN id % 5 = 0 THEN 1.5::DOUBLE END AS recent_cost_change,
         CASE WHEN original_cost_cr IS NOT NULL AND revised_cost_cr IS NOT NULL
              THEN CAST(revised_cost_cr > CASE WHEN id % 53 = 0 THEN 0.0 ELSE original_cost_cr END AS INTEGER) END AS future_cost_escalation
  FROM doubled)"""


def broken_panel(spark, sf_dir):
    """The sparse panel with one kind of defect per residue of the part number."""
    df = D.monthly_panel(spark, sf_dir, False)
    c, i = F.col, F.substring("project_code", 2, 20).cast("long")
    df = df.withColumn("id", i).withColumn("copy", F.explode(
        F.when(c("id") % 101 == 0, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))))
    every = lambda n: c("id") % n == 0
    cost = F.when(every(53), 0.0).otherwise(c("original_cost_cr"))
    return df.select(
        F.when(~every(307), c("project_code")).alias("project_code"),
        F.when(every(211), F.concat(F.lit("1998/"), F.substring("reporting_period", 6, 2)))
        .otherwise(c("reporting_period")).alias("reporting_period"),
        F.concat(F.lit("Part "), c("id")).alias("project_name"), F.concat(F.lit("S"), c("id") % 5).alias("sector"),
        F.concat(F.lit("M"), c("id") % 3).alias("line_ministry"), cost.alias("original_cost_cr"), "revised_cost_cr",
        F.when(every(71), -1.0).otherwise(c("expenditure_cr")).alias("expenditure_cr"),
        F.when(every(59), 120.0).otherwise(c("physical_progress_pct")).alias("physical_progress_pct"),
        F.when(every(67), "soon").otherwise(c("start_date")).alias("start_date"),
        "original_end_date", "revised_end_date", F.when(every(5), 1.5).alias("recent_cost_change"),
        (c("revised_cost_cr") > cost).cast("int").alias("future_cost_escalation"))


_VALID = r"regexp_full_match(reporting_period, '\d{4}-(0[1-9]|1[0-2])')"
_CELLS = f""",
per_cell AS (SELECT project_code, reporting_period, count(*) AS n, count(recent_cost_change) AS v,
    CASE WHEN project_code IS NOT NULL AND {_VALID}
         THEN CAST(substr(reporting_period, 1, 4) AS INTEGER) * 12 + CAST(substr(reporting_period, 6, 2) AS INTEGER) - 1 END AS i
  FROM broken GROUP BY 1, 2),
steps AS (SELECT *, i - lag(i) OVER (PARTITION BY project_code, i IS NULL ORDER BY i) AS d FROM per_cell),
per_entity AS (SELECT project_code, count(reporting_period) AS periods, count(*) FILTER (d = 1) AS pairs,
    count(*) FILTER (d > 1) AS gaps, sum(n - 1) AS extras, sum(CASE WHEN d = 1 THEN 0 ELSE v END) AS bad_v FROM steps GROUP BY 1)"""

_ISSUES = f"""WITH {_BROKEN_SQL}{_CELLS}, found AS (
  SELECT 'HARD_FAIL' AS severity, 'DC-IDENTITY-01' AS rule_id, count(*) FILTER (project_code IS NULL) AS issue_count FROM broken
  UNION ALL SELECT 'HARD_FAIL', 'DC-IDENTITY-03', sum(extras) FROM per_entity
  UNION ALL SELECT 'HARD_FAIL', 'DC-TIME-01', count(DISTINCT reporting_period) FROM broken WHERE NOT {_VALID}
  UNION ALL SELECT 'HARD_FAIL', 'DC-TIME-03', count(*) FILTER (start_date = 'soon') FROM broken
  UNION ALL SELECT 'HARD_FAIL', 'DC-NUM-01', count(*) FILTER (original_cost_cr <= 0) FROM broken
  UNION ALL SELECT 'HARD_FAIL', 'DC-NUM-02', count(*) FILTER (expenditure_cr < 0) FROM broken
  UNION ALL SELECT 'WARNING', 'DC-NUM-WARN-01', count(*) FILTER (revised_cost_cr > 0 AND revised_cost_cr < original_cost_cr) FROM broken
  UNION ALL SELECT 'HARD_FAIL', 'DC-NUM-04', count(*) FILTER (physical_progress_pct < 0 OR physical_progress_pct > 100) FROM broken
  UNION ALL SELECT 'HARD_FAIL', 'LR-01-04', count(*) FILTER (reporting_period > '2000-06') FROM broken
  UNION ALL SELECT 'HARD_FAIL', 'DC-TARGET-02', count(future_cost_escalation) FROM broken
  UNION ALL SELECT 'HARD_FAIL', 'DC-DERIVED-01', sum(bad_v) FROM per_entity
  UNION ALL SELECT 'HARD_FAIL', 'LR-05', 1
  UNION ALL SELECT 'WARNING', 'LR-ENTITY', 1)"""


def _broken_issues(spark, sf_dir):
    return V.validate_panel(broken_panel(spark, sf_dir), cutoff="2000-06", feature_matrix=True)


@query(_ISSUES + " SELECT severity, rule_id, CAST(issue_count AS BIGINT) AS issue_count FROM found WHERE issue_count > 0")
def panel_issues(spark, sf_dir):
    """The fused contract check."""
    return _broken_issues(spark, sf_dir).select("severity", "rule_id", F.col("count").alias("issue_count"))


@query(_ISSUES + " SELECT 'FAIL' AS status, count(*) FILTER (severity = 'HARD_FAIL') AS hard_fails, "
       "count(*) FILTER (severity = 'WARNING') AS warnings FROM found WHERE issue_count > 0")
def panel_status(spark, sf_dir):
    """Overall status from the issue table."""
    return V.status(_broken_issues(spark, sf_dir))


@query(f"""WITH {_BROKEN_SQL}{_CELLS}
SELECT count(*) AS total_projects, count(*) FILTER (periods = 1) AS single_period_projects,
  count(*) FILTER (periods > 1) AS multi_period_projects, max(periods) AS max_periods_observed,
  min(periods) AS min_periods_observed, CAST(sum(pairs) AS BIGINT) AS consecutive_pairs_count,
  CAST(sum(gaps) AS BIGINT) AS projects_with_gaps,
  (SELECT CAST(sum(extras) AS BIGINT) FROM per_entity) AS duplicate_rows,
  (SELECT CAST(sum(bad_v) AS BIGINT) FROM per_entity) AS broken_recent_cost_change
FROM per_entity WHERE project_code IS NOT NULL""")
def panel_density(spark, sf_dir):
    """Density, gaps and velocity continuity."""
    return V.panel_density(broken_panel(spark, sf_dir))


@query(f"WITH {panel()} SELECT reporting_period, count(*) AS row_count FROM panel GROUP BY 1")
def rows_per_period(spark, sf_dir):
    """V3: rows per observed period."""
    return V.rows_per_period(D.monthly_panel(spark, sf_dir))


_NULLABLE = ["project_code", "reporting_period", "revised_cost_cr", "physical_progress_pct", "start_date",
             "revised_end_date", "recent_cost_change"]


@query(f"WITH {_BROKEN_SQL} " + " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, count(*) FILTER ({c} IS NULL) AS nulls FROM broken" for c in _NULLABLE))
def null_counts(spark, sf_dir):
    """V1: nulls per column."""
    return V.null_counts(broken_panel(spark, sf_dir).select(*_NULLABLE))


@query(f"WITH {_BROKEN_SQL} SELECT count(*) FILTER (length(project_name) NOT BETWEEN 3 AND 255) AS bad_name_length, "
       "count(*) FILTER (try_cast(start_date AS DATE) > last_day(try_cast(reporting_period || '-01' AS DATE))) AS start_after_period, "
       "count(*) FILTER (try_cast(original_end_date AS DATE) < try_cast(start_date AS DATE)) AS end_before_start FROM broken "
       )
def contract_counts(spark, sf_dir):
    """Name length and date order."""
    return V.contract_counts(broken_panel(spark, sf_dir))


_W1 = ["cost_growth_ratio", "expenditure_progress_gap", "recent_cost_change", "target_cost_escalation_3m_cr"]


@query(f"WITH {panel()}, {FEATURES}, {targets((1, 3))}, ranked AS (SELECT *, dense_rank() OVER (ORDER BY reporting_period) AS r, "
       "(SELECT count(DISTINCT reporting_period) FROM panel) AS n FROM features JOIN targets USING (project_code, reporting_period)) "
       "SELECT project_code, reporting_period, " + rounded(_W1) + ", target_horizon_miss_3m_binary, is_first_observation, "
       "CASE WHEN r <= floor(n * 0.6) THEN 'train' WHEN r <= floor(n * 0.6) + 3 THEN 'val_embargo' "
       "WHEN r <= floor(n * 0.6) + floor(n * 0.2) THEN 'val' "
       "WHEN r <= floor(n * 0.6) + floor(n * 0.2) + 3 THEN 'purged' ELSE 'test' END AS split FROM ranked")
def longitudinal_job(spark, sf_dir):
    """Validate, features, targets, audits, split."""
    done = longitudinal.build(D.monthly_panel(spark, sf_dir), (1, 3), train_ratio=0.6, val_ratio=0.2, embargo=3)
    out = done.annotated.select(*KEYS, *_W1, "target_horizon_miss_3m_binary", "is_first_observation", "split")
    return _round(out, _W1)
