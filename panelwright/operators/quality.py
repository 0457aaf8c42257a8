"""Data-contract checks of a monthly panel, fused into two aggregates.

All row checks are counted in one pass; everything that needs (entity, period) groups
shares a second pass, reduced with map-side combine. Both results are single rows.
"""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelwright.errors import ContractError, LeakageError
from panelwright.functions.numeric import number
from panelwright.functions.periods import PERIOD_PATTERN, period_index, spelled_date
from panelwright.operators.scale import beside

# Columns of the panel contract.
REQUIRED = ["reporting_period", "project_code", "project_name", "sector", "line_ministry",
            "original_cost_cr", "original_end_date", "expenditure_cr"]
VELOCITIES = ["recent_cost_change", "recent_expenditure_change", "recent_progress_change",
              "recent_schedule_change"]
DATES = ["start_date", "original_end_date", "revised_end_date"]
# Names that must never reach a feature matrix.
POST_OUTCOME = ["actual_completion_date", "commissioning_date", "actual_doc", "final_cost", "final_cost_overrun"]
TARGET_NAMES = ["target", "label", "future_slip", "future_slip_days", "future_schedule_deterioration",
                "future_cost_escalation", "future_cost_overrun"]
GENERIC_TARGETS = ["target", "label", "y", "future_cost_change"]
# Header spellings accepted for contract columns.
HEADER_ALIASES = {
    "sr._no.": "sr_no", "sector_name": "sector",
    "original_cost": "original_cost_cr", "original_cost_(in_cr.)": "original_cost_cr",
    "revised_cost": "revised_cost_cr", "revised_cost_(in_cr.)": "revised_cost_cr",
    "expenditure": "expenditure_cr", "expenditure_(in_cr.)": "expenditure_cr",
    "cumulative_expenditure": "expenditure_cr", "original_doc": "original_end_date",
    "revised_date": "revised_end_date", "revised_doc": "revised_end_date",
    "physical_progress": "physical_progress_pct",
}
ISSUE_SCHEMA = "gate string, severity string, rule_id string, count long, message string"
SNAPSHOT_RULES = ["DC-TIME-02", "DC-DENSITY-01", "DC-SCHEMA-00"]


def normalize_headers(df: DataFrame) -> DataFrame:
    """Trim, lower-case and underscore the headers, then apply free aliases."""
    names = [c.strip().lower().replace("\n", " ").replace(" ", "_") for c in df.columns]
    taken = set(names)
    final = [HEADER_ALIASES[n] if n in HEADER_ALIASES and HEADER_ALIASES[n] not in taken else n for n in names]
    return df.toDF(*final)


def leaking_names(columns, targets=()) -> list:
    """(rule, column) for every column that may not be a feature."""
    found = []
    for c in columns:
        name = c.lower().strip()
        if name.startswith(("target_", "future_")) or name.endswith("_target") or name in GENERIC_TARGETS:
            found.append(("LR-05", c))
        if name in POST_OUTCOME:
            found.append(("LR-06", c))
        if c in targets:
            found.append(("LR-05", c))
    return found


def audit_separation(df: DataFrame, targets=()) -> int:
    """Raise :class:`LeakageError` if a feature table holds targets; else its width."""
    found = leaking_names(df.columns, targets)
    if found:
        raise LeakageError("; ".join(f"{rule}: {c}" for rule, c in found))
    return len(df.columns)


# Predictors that are never allowed.
PROHIBITED_PREDICTORS = [
    "future_total_cost_escalation_2026", "cost_overrun_5pct_2026", "future_schedule_slippage_months_2026",
    "time_overrun_3m_2026", "revised_cost_cr_2026", "revised_date_of_commissioning_2026", "future_cost", "future_completion",
    "future_expenditure", "future_progress", "sector", "feat_sector", "cat_sector",
    "revised_cost_cr_2025", "delay_months_2025",
]


def audit_predictors(columns, prohibited=tuple(PROHIBITED_PREDICTORS), patterns=("2026", "future", "sector")):
    """Raise if a predictor is listed or contains a forbidden pattern."""
    bad = [c for c in columns if c in prohibited or any(p in c.lower() for p in patterns)]
    if bad:
        raise LeakageError(f"prohibited predictors: {bad}")
    return list(columns)


def _is_target(c) -> bool:
    name = c.lower().strip()
    return (name in ("target", "label", "future_slip", "future_cost_escalation")
            or name.startswith("future_") or name.endswith("_target"))


def _row_checks(df: DataFrame, cutoff):
    """name -> (gate, severity, rule, count column, message) for the row-level pass."""
    c, have = F.col, set(df.columns)
    checks = []

    def add(gate, severity, rule, condition, message):
        checks.append((gate, severity, rule, F.count_if(condition), message))

    num = {n: number(n) for n in ("original_cost_cr", "revised_cost_cr", "expenditure_cr",
                                  "physical_progress_pct") if n in have}
    if "project_code" in have:
        add("identity", "HARD_FAIL", "DC-IDENTITY-01", c("project_code").isNull(), "rows without project_code")
    if "reporting_period" in have:
        add("identity", "HARD_FAIL", "DC-IDENTITY-02", c("reporting_period").isNull(),
            "rows without reporting_period")
    for d in DATES:
        if d in have:
            text = c(d).cast("string")
            add("temporal", "HARD_FAIL", "DC-TIME-03", text.isNotNull() & spelled_date(F.trim(text)).isNull(),
                f"unparseable dates in {d}")
    if "original_cost_cr" in num:
        add("numeric", "HARD_FAIL", "DC-NUM-01", num["original_cost_cr"] <= 0, "original cost not above 0")
    if "expenditure_cr" in num:
        add("numeric", "HARD_FAIL", "DC-NUM-02", num["expenditure_cr"] < 0, "negative expenditure")
    if "original_cost_cr" in num and "revised_cost_cr" in num:
        rev = num["revised_cost_cr"]
        add("numeric", "HARD_FAIL", "DC-NUM-03", rev < 0, "negative revised cost")
        add("numeric", "WARNING", "DC-NUM-WARN-01", (rev > 0) & (rev < num["original_cost_cr"]),
            "revised cost below original cost")
    if "physical_progress_pct" in num:
        prog = num["physical_progress_pct"]
        add("numeric", "HARD_FAIL", "DC-NUM-04", (prog < 0) | (prog > 100), "progress outside 0 to 100")
    if cutoff and "reporting_period" in have:
        add("leakage", "HARD_FAIL", "LR-01-04", c("reporting_period") > cutoff, f"periods after cutoff {cutoff}")
    for t in [x for x in df.columns if _is_target(x)]:
        target = number(t)
        for rule, rev, orig, read, what in (
            ("DC-TARGET-01", "revised_end_date", "original_end_date",
             lambda x: spelled_date(F.trim(c(x).cast("string"))), "current delay"),
            ("DC-TARGET-02", "revised_cost_cr", "original_cost_cr", number, "current overrun"),
        ):
            if rev in have and orig in have:
                now = (read(rev) > read(orig)).cast("int")
                known = target.isNotNull() & now.isNotNull()
                same = F.when((F.count_if(known) > 0) & (F.count_if(known & (target != now)) == 0),
                              F.count_if(known)).otherwise(0)
                checks.append(("target", "HARD_FAIL", rule, same, f"{t} equals {what} on all comparable rows"))
    return checks


def panel_density(df: DataFrame, entity="project_code", time="reporting_period") -> DataFrame:
    """One row: entities, single/multi-period, period range, consecutive pairs, gaps, extras.

    Cells are distinct (entity, period); a window group is bounded by the months there are.
    """
    velocity = [v for v in VELOCITIES if v in df.columns]
    cells = df.groupBy(entity, time).agg(
        F.count("*").alias("n"), *[F.count(v).alias(v) for v in velocity])
    valid = F.col(time).rlike(PERIOD_PATTERN) & F.col(entity).isNotNull()
    cells = cells.withColumn("_i", F.when(valid, period_index(time)))
    # Unreadable periods get no predecessor; salting them by value keeps their groups apart.
    w = Window.partitionBy(entity, F.when(F.col("_i").isNull(), F.col(time))).orderBy("_i")
    steps = cells.withColumn("_d", F.when(F.col("_i").isNotNull(), F.col("_i") - F.lag("_i").over(w)))
    apart = ~F.coalesce(F.col("_d") == 1, F.lit(False))
    per_entity = steps.groupBy(entity).agg(
        F.count(time).alias("periods"),
        F.count_if(F.col("_d") == 1).alias("pairs"),
        F.count_if(F.col("_d") > 1).alias("gaps"),
        F.sum(F.col("n") - 1).alias("extras"),
        *[F.sum(F.when(apart, F.col(v)).otherwise(0)).alias(v) for v in velocity],
    )
    real = F.col(entity).isNotNull()
    return per_entity.agg(
        F.count_if(real).alias("total_projects"),
        F.count_if(real & (F.col("periods") == 1)).alias("single_period_projects"),
        F.count_if(real & (F.col("periods") > 1)).alias("multi_period_projects"),
        F.coalesce(F.max(F.when(real, F.col("periods"))), F.lit(0)).alias("max_periods_observed"),
        F.coalesce(F.min(F.when(real, F.col("periods"))), F.lit(0)).alias("min_periods_observed"),
        F.coalesce(F.sum(F.when(real, F.col("pairs"))), F.lit(0)).alias("consecutive_pairs_count"),
        F.coalesce(F.sum(F.when(real, F.col("gaps"))), F.lit(0)).alias("projects_with_gaps"),
        F.coalesce(F.sum("extras"), F.lit(0)).alias("duplicate_rows"),
        *[F.coalesce(F.sum(v), F.lit(0)).alias(f"broken_{v}") for v in velocity],
    )


def rows_per_period(df: DataFrame, time="reporting_period") -> DataFrame:
    return df.filter(F.col(time).isNotNull()).groupBy(time).agg(F.count("*").alias("row_count"))


def _period_checks(df, allow_snapshot_only, time="reporting_period"):
    """Distinct-period checks from a table of at most one row per distinct period."""
    periods = rows_per_period(df, time).agg(
        F.count("*").alias("periods"), F.count_if(~F.col(time).rlike(PERIOD_PATTERN)).alias("invalid"))
    rows = [("temporal", "HARD_FAIL", "DC-TIME-01", F.col("invalid"), "distinct periods not YYYY-MM")]
    if not allow_snapshot_only:
        rows.append(("temporal", "HARD_FAIL", "DC-TIME-02", (F.col("periods") <= 1).cast("long"),
                     "at most one reporting period: snapshot only"))
    return periods, rows


def _issues(one_row: DataFrame, checks) -> DataFrame:
    return one_row.select(F.inline(F.array(*[
        F.struct(F.lit(g).alias("gate"), F.lit(s).alias("severity"), F.lit(r).alias("rule_id"),
                 n.cast("long").alias("count"), F.lit(m).alias("message"))
        for g, s, r, n, m in checks]))).filter(F.col("count") > 0)


def _schema_checks(df, feature_matrix):
    """Issues known from the header alone."""
    rows = []
    missing = sorted(c for c in REQUIRED if c not in df.columns)
    if missing:
        rows.append(("schema", "HARD_FAIL", "DC-SCHEMA-01", len(missing), f"missing columns: {missing}"))
    if feature_matrix:
        name = lambda c: c.lower().strip()
        late = sorted(c for c in df.columns if name(c) in POST_OUTCOME)
        targets = sorted(
            c for c in df.columns if c not in late
            and (name(c) in TARGET_NAMES or name(c).startswith("future_") or name(c).endswith("_target")))
        if targets:
            rows.append(("leakage", "HARD_FAIL", "LR-05", len(targets), f"target columns: {targets}"))
        if late:
            rows.append(("leakage", "HARD_FAIL", "LR-06", len(late), f"post-outcome columns: {late}"))
        if "project_code" in df.columns:
            rows.append(("leakage", "WARNING", "LR-ENTITY", 1, "project_code must not be a feature"))
    return rows


def validate_panel(df: DataFrame, cutoff=None, feature_matrix=False, allow_snapshot_only=False) -> DataFrame:
    """Issue table (gate, severity, rule_id, count, message) of a panel; empty when clean."""
    df = normalize_headers(df)
    known = _schema_checks(df, feature_matrix)
    if "reporting_period" not in df.columns:
        if "project_code" in df.columns and "original_cost_cr" in df.columns:
            known.append(("schema", "HARD_FAIL", "DC-SCHEMA-00", 1, "no reporting_period: snapshot only"))
            return df.sparkSession.createDataFrame(known, ISSUE_SCHEMA)
    checks = _row_checks(df, cutoff)
    one = df.agg(F.count("*").alias("_rows"), *[n.alias(f"_c{i}") for i, (_, _, _, n, _) in enumerate(checks)])
    checks = [(g, s, r, F.col(f"_c{i}"), m) for i, (g, s, r, _, m) in enumerate(checks)]
    if "reporting_period" in df.columns:
        periods, more = _period_checks(df, allow_snapshot_only)
        one, checks = beside(one, periods), checks + more
        if "project_code" in df.columns:
            density = panel_density(df)
            one = beside(one, density)
            checks.append(("identity", "HARD_FAIL", "DC-IDENTITY-03", F.col("duplicate_rows"),
                           "duplicate (project_code, reporting_period) rows"))
            if not allow_snapshot_only:
                checks.append(("density", "HARD_FAIL", "DC-DENSITY-01",
                               (F.col("multi_period_projects") == 0).cast("long"), "no multi-period projects"))
            checks += [("derived", "HARD_FAIL", "DC-DERIVED-01", F.col(f"broken_{v}"),
                        f"{v} set without the previous calendar month")
                       for v in VELOCITIES if v in df.columns]
    found = _issues(one, checks)
    if known:
        found = found.unionByName(df.sparkSession.createDataFrame(known, ISSUE_SCHEMA))
    return found


def status(issues: DataFrame) -> DataFrame:
    """One row: PASS, FAIL or SNAPSHOT_ONLY, with hard-fail and warning counts."""
    hard = F.count_if(F.col("severity") == "HARD_FAIL")
    snapshot = F.count_if(F.col("rule_id").isin(SNAPSHOT_RULES))
    return issues.agg(
        F.when(snapshot > 0, "SNAPSHOT_ONLY").when(hard > 0, "FAIL").otherwise("PASS").alias("status"),
        hard.alias("hard_fails"), F.count_if(F.col("severity") == "WARNING").alias("warnings"))


def null_counts(df: DataFrame) -> DataFrame:
    """(column, nulls) for every column, from one pass."""
    return df.agg(F.array(*[
        F.struct(F.lit(c).alias("column_name"), F.count_if(F.col(c).isNull()).alias("nulls"))
        for c in df.columns]).alias("a")).select(F.inline("a"))


def soft_flags(df: DataFrame) -> DataFrame:
    """Audit flags that reject nothing: budget breach and missing revised date."""
    top = F.greatest(number("revised_cost_cr"), number("original_cost_cr"))
    return df.withColumns({
        "is_over_budget": F.coalesce(number("expenditure_cr") > top, F.lit(False)).cast("int"),
        "has_revised_doc": F.col("revised_end_date").isNotNull().cast("int"),
    })


def monotonicity_flags(df: DataFrame, spend_drop=1.0) -> DataFrame:
    """Flags against the previous calendar month: spend drop and progress reversal."""
    from panelwright.operators.panel import previous_month_row

    both = previous_month_row(df, ["expenditure_cr", "physical_progress_pct"])
    spend = number("expenditure_cr") - number("prev_expenditure_cr")
    progress = number("physical_progress_pct") - number("prev_physical_progress_pct")
    return both.withColumns({
        "is_spend_drop": (spend < -spend_drop).cast("int"),
        "is_progress_reversal": (progress < 0).cast("int"),
    })


def contract_counts(df: DataFrame) -> DataFrame:
    """Counts of rows breaking the column contract: name length, date order."""
    start, end = (spelled_date(F.trim(F.col(c).cast("string"))) for c in ("start_date", "original_end_date"))
    last = F.last_day(F.concat("reporting_period", F.lit("-01")).try_cast("date"))
    return df.agg(
        F.count_if(~F.length("project_name").between(3, 255)).alias("bad_name_length"),
        F.count_if(start > last).alias("start_after_period"),
        F.count_if(end < start).alias("end_before_start"))


def require_clean(issues: DataFrame):
    """Raise :class:`ContractError` on hard failures; at most one row per rule is read."""
    hard = issues.filter(F.col("severity") == "HARD_FAIL").collect()
    if hard:
        raise ContractError("; ".join(f"[{r.rule_id}] {r['count']} {r.message}" for r in hard))
