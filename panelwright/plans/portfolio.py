"""Cohort to scores, explanations, interventions and the published tables."""

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwright.operators import explain as X
from panelwright.operators import interventions as N
from panelwright.operators import learn as M
from panelwright.operators import scoring as S
from panelwright.operators import split as K
from panelwright.operators.cohort import CATEGORICAL_FEATURES, NUMERIC_FEATURES
from panelwright.operators.quality import audit_predictors
from panelwright.session import cut_lineage, discard

KEY = "canonical_project_key"
COST, SCHEDULE = "cost_overrun", "schedule_slippage"


@dataclass
class Portfolio:
    features: DataFrame
    scores: DataFrame
    explanations: DataFrame
    interventions: DataFrame

    def tables(self) -> dict:
        """Parent first, as :func:`panelwright.sources.sinks.seed_tables` loads them."""
        names = [KEY, "source_project_id", "project_name", "state", "agency", "snapshot_date"]
        return {"projects": self.scores.select(*names), "risk_scores": self.scores,
                "explanations": self.explanations, "interventions": self.interventions}


def from_scorers(cohort: DataFrame, cost_scorer, schedule_scorer, eligible="is_eligible_schedule_target",
                 cutoff_label="the cutoff", source_label="source", materialize=True, deltas_digits=None, made_by=None) -> Portfolio:
    """Score, explain and route with any two scorers (``DataFrame -> DataFrame + probability``).

    The scored table is used by every later stage, so it is written once to the shared
    checkpoint folder.
    """
    audit_predictors([*NUMERIC_FEATURES, *CATEGORICAL_FEATURES])
    has_schedule = F.col(eligible) == 1
    cost = cost_scorer(cohort).withColumnRenamed("probability", "cost_risk_probability")
    both = schedule_scorer(cost).withColumn(
        "schedule_risk_probability", F.when(has_schedule, F.col("probability"))).drop("probability")
    lead = both.withColumns({"state": F.col("feat_state"), "agency": F.col("feat_agency")})
    if materialize:
        lead = cut_lineage(lead)
    scores = S.score_portfolio(lead, made_by=made_by)
    if materialize:
        scores = cut_lineage(scores)
        discard(lead)
    reference = X.reference_profile(cohort)

    def deltas(rows, scorer):
        out = X.perturb(rows, reference, scorer, KEY)
        return out if deltas_digits is None else out.withColumn("delta", F.round("delta", deltas_digits))

    per_task = {COST: deltas(cohort, cost_scorer), SCHEDULE: deltas(cohort.filter(has_schedule), schedule_scorer)}
    explanations = X.explanation_table(scores, per_task, KEY, 3, cutoff_label, source_label)
    if materialize:
        explanations = cut_lineage(explanations)
    interventions = N.route_interventions(scores, cohort, explanations, KEY, cutoff_label)
    return Portfolio(cohort, scores, explanations, interventions)


def train(cohort: DataFrame, cost_target, schedule_target, eligible="is_eligible_schedule_target", seed=42,
          trees=300, depth=30):
    """Two forests fitted on their MODELFIT rows, and the partition labels."""
    split = K.stratified_partition(cohort, cost_target, KEY, seed, out="cost_partition")
    split = K.stratified_partition(split, schedule_target, KEY, seed, eligible=F.col(eligible) == 1,
                                   out="schedule_partition")
    split = cut_lineage(split)

    def fit(part, y):
        rows = M.in_fit_order(split.filter(F.col(part) == "MODELFIT"), KEY)
        return M.fit_forest(rows, y, trees=trees, depth=depth, seed=seed)

    return (fit("cost_partition", cost_target), fit("schedule_partition", schedule_target),
            split.select(KEY, "cost_partition", "schedule_partition"))


def attach_partitions(scores: DataFrame, partitions: DataFrame) -> DataFrame:
    """Sidecar join that keeps the presentation order."""
    return S.in_rank_order(scores.join(partitions, KEY, "left"))


def build(cohort: DataFrame, cost_target, schedule_target, seed=42, trees=300, depth=30, **labels) -> Portfolio:
    """The whole chain with trained forests; each model is fitted once and reused."""
    cost, schedule, _ = train(cohort, cost_target, schedule_target, seed=seed, trees=trees, depth=depth)
    name = S.forest_name(trees, seed)
    return from_scorers(cohort, cost.score, schedule.score, made_by=S.provenance(name, name), **labels)
