"""Read queries over the published portfolio tables. Parameters are bound as literals."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwright.functions.text import contains_any, relabel

KEY = "canonical_project_key"
SORTABLE = ["portfolio_rank", "attention_score", "cost_risk_probability", "project_name"]
# Stored label to served label.
DIRECTION_LABELS = {"ELEVATES_RISK": "INCREASES_RISK", "ATTENUATES_RISK": "DECREASES_RISK"}
VARIANT_LABELS = {"Raw / Uncalibrated": "raw_uncalibrated"}
SUMMARY = [KEY, "source_project_id", "project_name", "state", "agency", "attention_score", "attention_tier",
           "portfolio_rank", "risk_coverage", "cost_risk_probability", "schedule_risk_probability",
           "compound_exposure", "intervention_priority", "primary_action"]
SEARCHED = ["project_name", KEY, "agency"]


def summaries(scores: DataFrame, interventions: DataFrame) -> DataFrame:
    """One row per project with its score and intervention badge."""
    badge = interventions.select(KEY, "intervention_priority", "primary_action")
    return scores.join(badge, KEY, "left").select(*SUMMARY)


def filtered(df: DataFrame, state=None, agency=None, tier=None, coverage=None, search=None,
             searched=SEARCHED) -> DataFrame:
    """Optional equality filters and free-text search, all pushed to the scan."""
    for column, value in (("state", state), ("agency", agency), ("attention_tier", tier),
                          ("risk_coverage", coverage)):
        if value is not None:
            df = df.filter(F.col(column) == F.lit(value))
    return df if search is None else df.filter(contains_any(searched, search))


def catalogue(df: DataFrame, sort_by="portfolio_rank", order="asc", page=1, page_size=20, after=None,
              **filters) -> DataFrame:
    """One page with ``total_records`` and ``total_pages`` on each row.

    ``after=(value, key)`` of the last row seen replaces the offset for deep pages: the
    next page is then a filter and a top-k, at any depth.
    """
    if sort_by not in SORTABLE or order not in ("asc", "desc"):
        raise ValueError(f"cannot sort by {sort_by} {order}")
    if page < 1 or not 1 <= page_size <= 100:
        raise ValueError("page starts at 1, page_size is 1 to 100")
    rows = filtered(df, **filters)
    total = rows.agg(F.count("*")).scalar()
    c = F.col(sort_by)
    ordered = [c.asc() if order == "asc" else c.desc(), F.col(KEY).asc()]
    if after is not None:
        value, key = after
        beyond = c > F.lit(value) if order == "asc" else c < F.lit(value)
        window = rows.filter(beyond | ((c == F.lit(value)) & (F.col(KEY) > F.lit(key)))).orderBy(*ordered)
    else:
        window = rows.orderBy(*ordered).offset((page - 1) * page_size)
    pages = F.greatest(F.ceil(total / page_size), F.lit(1))
    return window.limit(page_size).withColumns({"total_records": total, "total_pages": pages})


def leaderboard(df: DataFrame, limit=50, offset=0, **filters) -> DataFrame:
    """Rank ascending, then key, with ``total_records``."""
    filters.setdefault("searched", [*SEARCHED, "state"])
    rows = filtered(df, **filters)
    total = rows.agg(F.count("*")).scalar()
    return rows.orderBy("portfolio_rank", KEY).offset(offset).limit(limit).withColumn("total_records", total)


def resorted(df: DataFrame, by="rank", direction="asc") -> DataFrame:
    """Order by rank, attention, cost or schedule; a missing schedule counts as -1."""
    column = {"rank": "portfolio_rank", "attention": "attention_score", "cost": "cost_risk_probability",
              "schedule": "schedule_risk_probability"}[by]
    c = F.col(column)
    return df.orderBy(c.asc_nulls_first() if direction == "asc" else c.desc_nulls_last(), KEY)


def search(df: DataFrame, query, **filters) -> DataFrame:
    return filtered(df, search=query, **filters)


def _one(df, key):
    return df.filter(F.col(KEY) == F.lit(key))


def _models():
    variant = lambda c: relabel(c, VARIANT_LABELS).alias(c)
    return F.struct(F.col("cost_model_name").alias("cost_model"), variant("cost_probability_variant"),
                    F.col("schedule_model_name").alias("schedule_model"),
                    variant("schedule_probability_variant")).alias("models")


RISK = ["attention_score", "portfolio_rank", "attention_tier", "risk_coverage", "cost_risk_probability",
        "schedule_risk_probability", "compound_exposure", "is_eligible_cost_target",
        "is_eligible_schedule_target"]
ACTIONS = ["intervention_priority", "primary_action", "secondary_action", "risk_focus", "priority_reason",
           "evidence_feature", "evidence_value", "evidence_direction", "data_quality_flag", "governance_note"]


def profile(scores, features, interventions, key) -> DataFrame:
    """Nested project, risk and intervention of one key; empty when the key is unknown."""
    served = lambda c: (relabel(c, DIRECTION_LABELS) if c == "evidence_direction" else F.col(c)).alias(c)
    named = {"original_cost_crore": "feat_original_cost_crore",
             "cumulative_expenditure_crore": "feat_cumulative_expenditure_crore",
             "physical_progress_pct": "feat_physical_progress_pct",
             "divergence": "feat_physical_vs_financial_divergence",
             "project_age_months": "feat_project_age_months",
             "remaining_duration_months": "feat_remaining_original_duration_months"}
    s = _one(scores, key)
    f = _one(features, key).select(KEY, *[F.col(v).alias(k) for k, v in named.items()])
    i = _one(interventions, key).select(KEY, F.struct(*[served(c) for c in ACTIONS]).alias("intervention"))
    identity = [KEY, "source_project_id", "project_name", "state", "agency"]
    return s.join(f, KEY).join(i, KEY, "left").select(
        F.struct(*identity, *named, "snapshot_date").alias("project"),
        F.struct(*RISK, _models(), "scoring_method_version").alias("risk"),
        "intervention")


def risk(scores, key) -> DataFrame:
    return _one(scores, key).select(
        KEY, *RISK, _models(), "scoring_method_version", "snapshot_date", "prediction_cutoff_date")


def drivers(explanations, key=None, k=3) -> DataFrame:
    """Per key the ordered drivers of both tasks; an ineligible task has an empty list."""
    rows = explanations if key is None else _one(explanations, key)
    slots = F.array(*[
        F.struct(F.lit(i).alias("rank"), F.col(f"top_{i}_feature").alias("feature"),
                 F.col(f"top_{i}_feature_value").alias("feature_value"), F.col(f"top_{i}_impact").alias("impact"),
                 relabel(f"top_{i}_direction", DIRECTION_LABELS).alias("direction"),
                 F.col(f"top_{i}_source_fact").alias("source_fact")) for i in range(1, k + 1)])
    listed = F.when(F.col("is_eligible_task_target") == 1,
                    F.filter(slots, lambda d: d["feature"].isNotNull())).otherwise(F.filter(slots, lambda d: F.lit(False)))
    task = F.struct("task", F.col("is_eligible_task_target").alias("is_eligible"),
                    "predicted_risk_probability", listed.alias("top_drivers"))
    of = lambda name: F.max(F.when(F.col("task") == name, task))
    return rows.groupBy(KEY).agg(
        of("cost_overrun").alias("cost_drivers"), of("schedule_slippage").alias("schedule_drivers"),
        F.max("explanation_method").alias("explanation_method"),
        F.max("explanation_disclaimer").alias("disclaimer"))


def intervention(interventions, key) -> DataFrame:
    served = lambda c: (relabel(c, DIRECTION_LABELS) if c == "evidence_direction" else F.col(c)).alias(c)
    return _one(interventions, key).select(KEY, *[served(c) for c in ACTIONS])


DIMENSIONS = {"risk_coverage": "coverage_breakdown", "attention_tier": "tier_distribution",
              "intervention_priority": "intervention_priority_distribution",
              "primary_action": "action_distribution", "risk_focus": "risk_focus_distribution"}


def distribution_table(scores, interventions) -> DataFrame:
    """(dimension, value, projects) over five dimensions, from one aggregate."""
    extra = interventions.select(KEY, "intervention_priority", "primary_action", "risk_focus")
    both = scores.select(KEY, "risk_coverage", "attention_tier").join(extra, KEY, "left")
    tall = both.select(F.inline(F.array(*[
        F.struct(F.lit(name).alias("dimension"), F.col(c).alias("value")) for c, name in DIMENSIONS.items()])))
    return tall.filter(F.col("value").isNotNull()).groupBy("dimension", "value").agg(F.count("*").alias("projects"))


def portfolio_summary(scores, interventions) -> DataFrame:
    """One row: total and five distributions as maps (closed vocabularies)."""
    table = distribution_table(scores, interventions)
    # Every project has a coverage label, so that dimension adds up to the total.
    mapped = lambda name: F.map_from_entries(F.filter(F.sort_array(F.collect_list(
        F.when(F.col("dimension") == name, F.struct("value", "projects")))), lambda x: x.isNotNull()))
    total = F.coalesce(F.sum(F.when(F.col("dimension") == "coverage_breakdown", F.col("projects"))), F.lit(0))
    return table.agg(total.alias("total_projects"), *[mapped(n).alias(n) for n in DIMENSIONS.values()])
