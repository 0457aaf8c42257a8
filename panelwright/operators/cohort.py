"""Fixed pair cohort: features at a cutoff month, outcomes twelve months later."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwright.functions.numeric import flag, gap_to_progress, log_cost, number, ratio
from panelwright.functions.periods import month_index, year_month

# Predictors in list order (the order breaks ties in explanations).
NUMERIC_FEATURES = [
    "feat_log_original_cost", "feat_original_cost_crore", "feat_cumulative_expenditure_crore",
    "feat_expenditure_to_original_cost_ratio", "feat_physical_progress_pct",
    "feat_physical_vs_financial_divergence", "feat_project_age_months", "feat_is_missing_approval_date",
    "feat_remaining_original_duration_months", "feat_is_past_original_completion",
]
CATEGORICAL_FEATURES = ["feat_state", "feat_agency"]
SPEC_VERSION = "MODULE_2C_V1"


def pair_cohort(panel: DataFrame, t0: str, t1: str, earlier: str | None = None,
                key="canonical_project_key") -> DataFrame:
    """Entities observed at both months, with the outcome columns of ``t1`` and the
    trajectory label. Both scans are filtered (and pruned when the panel is partitioned
    by ``source_snapshot``) before the join on the entity key."""
    at = lambda s: panel.filter((F.col("source_snapshot") == s) & F.col(key).isNotNull())
    later = at(t1).select(
        key, F.col("revised_cost_crore").alias("_rev_cost"), F.col("revised_completion_date").alias("_rev_end"))
    both = at(t0).join(later, key)
    if earlier is None:
        return both.withColumn("trajectory_type", F.lit("2_SNAPSHOT_JULY"))
    seen = at(earlier).select(key).distinct().withColumn("_seen", F.lit(True))
    label = F.when(F.col("_seen"), "3_SNAPSHOT").otherwise("2_SNAPSHOT_JULY")
    return both.join(seen, key, "left").withColumn("trajectory_type", label).drop("_seen")


def pair_features(cohort: DataFrame, t0: str, cutoff_date: str, outcome_suffix: str, generated_at: str,
                  spec_version=SPEC_VERSION, key="canonical_project_key") -> DataFrame:
    """The 26-column cohort table: keys, features at t0, targets, eligibility, provenance."""
    year, month = (int(x) for x in t0.split("-"))
    now = year * 12 + month - 1
    c = F.col
    df = cohort.withColumns({
        "_cost": number("original_cost_crore"), "_spend": number("cumulative_expenditure_crore"),
        "_prog": number("physical_progress_pct"), "_rev": number("_rev_cost"),
        "_appr": month_index(year_month("approval_date")),
        "_end": month_index(year_month("original_completion_date")),
        "_late": month_index(year_month("_rev_end")),
    }).withColumn("_share", ratio("_spend", "_cost"))
    escalation = F.when((c("_cost") > 0) & c("_rev").isNotNull(), (c("_rev") - c("_cost")) / c("_cost"))
    slip = (c("_late") - c("_end")).cast("double")
    remaining = (c("_end") - now).cast("double")
    named = lambda col, default: F.coalesce(F.trim(col), F.lit(default))
    s = outcome_suffix
    return df.select(
        key, "source_project_id", "project_name",
        F.lit(t0).alias("snapshot_date"), F.lit(cutoff_date).alias("prediction_cutoff_date"),
        log_cost("_cost").alias("feat_log_original_cost"),
        c("_cost").alias("feat_original_cost_crore"),
        c("_spend").alias("feat_cumulative_expenditure_crore"),
        c("_share").alias("feat_expenditure_to_original_cost_ratio"),
        c("_prog").alias("feat_physical_progress_pct"),
        gap_to_progress("_share", "_prog").alias("feat_physical_vs_financial_divergence"),
        (F.lit(now) - c("_appr")).cast("double").alias("feat_project_age_months"),
        c("_appr").isNull().cast("int").alias("feat_is_missing_approval_date"),
        remaining.alias("feat_remaining_original_duration_months"),
        flag(remaining < 0).alias("feat_is_past_original_completion"),
        named("state", "MISSING").alias("feat_state"), named("agency", "UNKNOWN").alias("feat_agency"),
        escalation.alias(f"future_total_cost_escalation_{s}"),
        flag(escalation > 0.05).alias(f"cost_overrun_5pct_{s}"),
        slip.alias(f"future_schedule_slippage_months_{s}"),
        flag(slip >= 3.0).alias(f"time_overrun_3m_{s}"),
        escalation.isNotNull().cast("int").alias("is_eligible_cost_target"),
        slip.isNotNull().cast("int").alias("is_eligible_schedule_target"),
        "trajectory_type",
        F.lit(spec_version).alias("spec_version"), F.lit(generated_at).alias("generated_at"),
    )


def planned_duration(df: DataFrame, out="feat_original_planned_duration_months") -> DataFrame:
    """Months from approval to original completion; NULL if either is missing."""
    span = month_index(year_month("original_completion_date")) - month_index(year_month("approval_date"))
    return df.withColumn(out, span.cast("double"))


def target_accounting(df: DataFrame, flags, by=None) -> DataFrame:
    """(task, total, eligible, missing, positive, negative, event_rate), optionally per group."""
    by = [by] if by else []
    tall = df.select(*by, F.inline(F.array(*[
        F.struct(F.lit(task).alias("task"), F.col(column).alias("y")) for task, column in flags.items()])))
    return tall.groupBy(*by, "task").agg(
        F.count("*").alias("total"), F.count("y").alias("eligible"),
        F.count_if(F.col("y").isNull()).alias("missing"),
        F.count_if(F.col("y") == 1).alias("positive"), F.count_if(F.col("y") == 0).alias("negative"),
    ).withColumn("event_rate", F.coalesce(F.try_divide(F.col("positive") * 100.0, F.col("eligible")), F.lit(0.0)))
