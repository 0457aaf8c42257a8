"""Deterministic routing from scores, features and top drivers to monitoring actions."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Output text.
GOVERNANCE_NOTE = ("Monitoring recommendation derived from historical statistical associations in source reports; "
                   "not an autonomous administrative decision or causal estimate.")
# Tier to priority.
PRIORITIES = {"Tier 1": "PRIORITY_1", "Tier 2": "PRIORITY_2", "Tier 3": "PRIORITY_3", "Tier 4": "PRIORITY_4"}
OUTPUT = ["cost_risk_probability", "schedule_risk_probability", "attention_score", "risk_coverage",
          "portfolio_rank", "intervention_priority", "primary_action", "secondary_action", "risk_focus",
          "priority_reason", "evidence_feature", "evidence_value", "evidence_direction",
          "data_quality_flag", "governance_note"]


def join_evidence(scores: DataFrame, features: DataFrame, explanations: DataFrame,
                  key="canonical_project_key") -> DataFrame:
    """Scores with routing features and both top drivers; schedule evidence only at FULL coverage.

    Every side is keyed by project, so the four tables meet on one partitioning.
    """
    f = features.select(
        key, F.col("feat_is_past_original_completion").alias("past_due"),
        F.col("feat_physical_vs_financial_divergence").alias("divergence"),
        F.col("feat_expenditure_to_original_cost_ratio").alias("spend_ratio"),
        F.col("feat_is_missing_approval_date").alias("no_approval"))

    def evidence(task, mark):
        top = F.struct(F.col("top_1_feature").alias("feature"), F.col("top_1_feature_value").alias("value"),
                       F.col("top_1_direction").alias("direction"))
        return explanations.filter(F.col("task") == task).select(key, top.alias(mark))

    joined = (scores.join(f, key, "left").join(evidence("cost_overrun", "cost_top"), key, "left")
              .join(evidence("schedule_slippage", "schedule_top"), key, "left"))

    def default(mark, feature, value, usable):
        stub = F.struct(F.lit(feature).alias("feature"), value.cast("string").alias("value"),
                        F.lit("NEUTRAL").alias("direction"))
        return F.when(usable & F.col(mark).isNotNull(), F.col(mark)).otherwise(stub)

    full = F.col("risk_coverage") == "FULL"
    return joined.withColumns({
        "cost_top": default("cost_top", "feat_expenditure_to_original_cost_ratio", F.col("spend_ratio"), F.lit(True)),
        "schedule_top": default("schedule_top", "feat_is_past_original_completion", F.col("past_due"), full),
    })


def data_quality_flag():
    partial, missing = F.col("risk_coverage") == "PARTIAL", F.col("no_approval") == 1
    return (
        F.when(partial & missing, "SCHEDULE_OUTCOME_UNOBSERVED_AND_MISSING_APPROVAL_DATE")
        .when(partial, "SCHEDULE_OUTCOME_UNOBSERVED")
        .when(missing, "MISSING_APPROVAL_DATE").otherwise("COMPLETE_BASELINE_DATA"))


def routing(cutoff_label="the cutoff"):
    """The decision table, first match wins, as one struct column; its texts and codes are fixed values."""
    full = F.col("risk_coverage") == "FULL"
    partial = F.col("risk_coverage") == "PARTIAL"
    pc, ps = F.col("cost_risk_probability"), F.col("schedule_risk_probability")
    gap, spread = F.col("divergence"), F.abs("divergence")
    past = F.col("past_due") == 1
    cost, schedule = F.col("cost_top"), F.col("schedule_top")
    given = lambda f, v, d: F.struct(F.lit(f).alias("feature"), v.alias("value"), d.alias("direction"))

    def route(focus, primary, secondary, reason, evidence):
        text = lambda x: F.lit(x) if isinstance(x, str) else x
        return F.struct(
            F.lit(focus).alias("risk_focus"), text(primary).alias("primary_action"),
            text(secondary).alias("secondary_action"), text(reason).alias("priority_reason"),
            evidence["feature"].alias("evidence_feature"), evidence["value"].alias("evidence_value"),
            evidence["direction"].alias("evidence_direction"))

    up = F.lit("ELEVATES_RISK")
    overdue = given("feat_is_past_original_completion", F.lit("1"), up)
    driver = F.replace(F.replace(cost["feature"], F.lit("feat_"), F.lit("")), F.lit("_"), F.lit(" "))
    signed = F.format_string("%+.1f", gap)
    return (
        F.when(full & (pc >= 0.50) & (ps >= 0.75), route(
            "JOINT_COST_SCHEDULE", "JOINT_COST_SCHEDULE_REVIEW",
            F.when(past, "COMPLETION_STATUS_REVIEW").when(spread >= 20.0, "EXPENDITURE_PROGRESS_REVIEW")
            .otherwise("PROGRESS_VERIFICATION"),
            "Both evaluated cost and schedule risk are elevated; "
            "coordinated cost and schedule review is recommended.", cost))
        .when(pc >= 0.50, route(
            "COST_RISK", "COST_REVIEW",
            F.when((spread >= 20.0) | (F.col("spend_ratio") >= 1.0), "EXPENDITURE_PROGRESS_REVIEW")
            .when(partial, "DATA_QUALITY_REVIEW").otherwise("PROGRESS_VERIFICATION"),
            F.when(partial, F.lit("Elevated cost risk is supported by budget expenditure signals; "
                                  "schedule outcome is unobserved, cost review is recommended."))
            .otherwise(F.concat(F.lit("Elevated cost risk is supported by "), driver,
                                F.lit("; cost review is recommended."))), cost))
        .when(full & (ps >= 0.75) & past, route(
            "SCHEDULE_RISK", "COMPLETION_STATUS_REVIEW", "SCHEDULE_REVIEW",
            "Elevated schedule risk is supported by a past-original-completion signal; "
            "completion status review is recommended.", overdue))
        .when(full & (ps >= 0.75), route(
            "SCHEDULE_RISK", "SCHEDULE_REVIEW", "PROGRESS_VERIFICATION",
            "Elevated schedule risk is supported by remaining duration and agency timeline patterns; "
            "schedule review is recommended.", schedule))
        .when(partial, route(
            "UNOBSERVED_SCHEDULE", "DATA_QUALITY_REVIEW", "PROGRESS_VERIFICATION",
            "Schedule outcome is unobserved in the available PIT cohort; "
            "prioritisation is based on cost risk only.",
            given("schedule_outcome", F.lit("UNOBSERVED"), F.lit("NEUTRAL"))))
        .when(spread >= 25.0, route(
            "PROGRESS_FINANCIAL_DIVERGENCE", "EXPENDITURE_PROGRESS_REVIEW", "PROGRESS_VERIFICATION",
            F.concat(F.lit("Physical-financial divergence of "), signed,
                     F.lit("% points indicates expenditure pace mismatch; expenditure progress review is recommended.")),
            given("feat_physical_vs_financial_divergence", signed,
                  F.when(gap > 0, up).otherwise("ATTENUATES_RISK"))))
        .when(past, route(
            "COMPLETION_STATUS", "COMPLETION_STATUS_REVIEW", "PROGRESS_VERIFICATION",
            f"Project had passed original completion date as of {cutoff_label} cutoff; "
            "completion status verification is recommended.", overdue))
        .otherwise(route(
            "BASELINE_MONITORING", "PROGRESS_VERIFICATION", "DATA_QUALITY_REVIEW",
            "Evaluated risk probabilities remain within baseline parameters; "
            "standard periodic progress verification is recommended.", cost))
    )


def priority():
    tier = F.col("attention_tier")
    out = F.lit(None).cast("string")
    for name, value in PRIORITIES.items():
        out = F.when(tier == name, F.lit(value)).otherwise(out)
    return out


def route_interventions(scores, features, explanations, key="canonical_project_key",
                        cutoff_label="the cutoff", governance_note=GOVERNANCE_NOTE) -> DataFrame:
    """The 16-column intervention table."""
    routed = join_evidence(scores, features, explanations, key).withColumns({
        "data_quality_flag": data_quality_flag(),
        "intervention_priority": priority(),
        "governance_note": F.lit(governance_note),
        "_route": routing(cutoff_label),
    })
    return routed.select("*", "_route.*").select(key, *OUTPUT)


def in_priority_order(df: DataFrame, key="canonical_project_key") -> DataFrame:
    return df.orderBy("portfolio_rank", key)


def distributions(df: DataFrame, columns=("primary_action", "risk_focus", "data_quality_flag")) -> DataFrame:
    """(dimension, value, projects, share) of several columns in one pass."""
    tall = df.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("dimension"), F.col(c).alias("value")) for c in columns])))
    total = df.agg(F.count("*").alias("n")).scalar()
    return tall.groupBy("dimension", "value").agg(F.count("*").alias("projects")).withColumn(
        "share", F.col("projects") * 100.0 / total)


# Wording that must not appear in advice.
FORBIDDEN_WORDS = [
    "caused the delay", "caused cost overrun", "this project will fail", "agency is responsible",
    "state is responsible", "penalty", "penalties", "sanction", "sanctions", "terminate", "termination",
    "fault", "culpability",
]


def forbidden_language(df: DataFrame, columns=("priority_reason", "governance_note"),
                       words=FORBIDDEN_WORDS) -> DataFrame:
    """(column, word, rows) for every forbidden word, zero counts included, in one pass."""
    counts = [
        F.struct(F.lit(c).alias("column_name"), F.lit(w).alias("word"),
                 F.count_if(F.contains(F.lower(F.col(c)), F.lit(w))).alias("row_count"))
        for c in columns for w in words]
    return df.agg(F.array(*counts).alias("a")).select(F.inline("a"))
