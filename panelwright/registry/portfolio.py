"""Queries on scores, explanations, interventions and the serving tables."""

from pyspark.sql import functions as F

from panelwright.operators import explain as X
from panelwright.operators import interventions as N
from panelwright.operators import scoring as S
from panelwright.operators import serving as Q
from panelwright.operators.scale import beside, exact_quantiles
from panelwright.operators.search import RAREST, build_index
from panelwright.plans import derived as D
from panelwright.plans import portfolio as W
from panelwright.operators.cohort import CATEGORICAL_FEATURES, NUMERIC_FEATURES
from panelwright.registry import query
from panelwright.registry.sql import COHORT, PORTFOLIO, SCORED
from panelwright.session import cut_lineage

KEY = "canonical_project_key"
SCORES = ["cost_risk_probability", "schedule_risk_probability", "risk_coverage", "attention_score",
          "compound_exposure", "attention_tier", "portfolio_rank"]

_MADE_BY = S.provenance("hash of length", "hash of id")


def _scores(spark, sf_dir):
    return S.score_portfolio(D.portfolio(spark, sf_dir), made_by=_MADE_BY)


@query(f"WITH {PORTFOLIO}, {SCORED} SELECT {KEY}, {', '.join(SCORES)}, "
       + ", ".join(f"'{v}' AS {k}" for k, v in _MADE_BY.items()) + " FROM scores")
def score_portfolio(spark, sf_dir):
    """Coverage, attention, exposure, tier, rank, provenance."""
    return S.in_rank_order(_scores(spark, sf_dir)).select(KEY, *SCORES, *_MADE_BY)


@query(f"WITH {PORTFOLIO} SELECT lang, round(quantile_cont(cost_risk_probability, 0.5), 9) AS q50, "
       "round(quantile_cont(cost_risk_probability, 0.75), 9) AS q75, round(quantile_cont(cost_risk_probability, 0.9), 9) AS q90 "
       "FROM portfolio GROUP BY lang")
def exact_quantile_table(spark, sf_dir):
    """Exact interpolated quantiles per group."""
    q = exact_quantiles(D.portfolio(spark, sf_dir), "cost_risk_probability", S.TIER_PROBS, by=["lang"])
    return q.select("lang", *[F.round(F.col("q")[i], 9).alias(n) for i, n in enumerate(("q50", "q75", "q90"))])


_METRICS = ["cost_risk_probability", "schedule_risk_probability", "attention_score", "compound_exposure"]
_DECILES = ", ".join(f"round(quantile_cont({{m}}, {i / 10}), 6) AS q{i}0" for i in range(1, 10))


@query(f"WITH {PORTFOLIO}, {SCORED} " + " UNION ALL ".join(
    f"SELECT '{m}' AS metric, count({m}) AS n, min({m}) AS min, {_DECILES.format(m=m)}, max({m}) AS max, "
    f"round(avg({m}), 6) AS mean, round(stddev_samp({m}), 6) AS std FROM scores" for m in _METRICS))
def score_distribution(spark, sf_dir):
    """Extremes, deciles, mean and deviation."""
    table = S.distribution(_scores(spark, sf_dir), _METRICS)
    return table.withColumns({c: F.round(c, 6) for c in [f"q{i}0" for i in range(1, 10)] + ["mean", "std"]})


@query(f"WITH {PORTFOLIO}, {SCORED} SELECT coalesce(attention_tier, 'TOTAL') AS attention_tier, "
       "count(*) FILTER (risk_coverage = 'FULL') AS full_coverage, count(*) FILTER (risk_coverage = 'PARTIAL') AS partial_coverage, "
       "count(*) AS total FROM scores GROUP BY ROLLUP (attention_tier)")
def tier_by_coverage(spark, sf_dir):
    """Cross-tab with totals."""
    return S.tier_by_coverage(_scores(spark, sf_dir))


@query(f"WITH {PORTFOLIO}, t AS (SELECT unnest([0.5, 0.75, 0.9]) AS threshold) SELECT CAST(threshold AS DOUBLE) AS threshold, "
       "count(*) FILTER (cost_risk_probability >= threshold AND schedule_risk_probability >= threshold) AS projects FROM portfolio, t GROUP BY 1")
def co_elevation(spark, sf_dir):
    """Rows with both probabilities elevated."""
    return S.co_elevation(D.portfolio(spark, sf_dir))


@query(f"WITH {PORTFOLIO}, {SCORED} SELECT {KEY}, compound_exposure FROM scores WHERE compound_exposure IS NOT NULL "
       f"ORDER BY compound_exposure DESC, {KEY} LIMIT 10")
def top_exposure(spark, sf_dir):
    """Top-k by compound exposure."""
    return S.top_exposure(S.combine(D.portfolio(spark, sf_dir))).select(KEY, "compound_exposure")


def _wrong_scores(spark, sf_dir):
    """A score table with planted errors, for the audit."""
    i = F.substring(KEY, 5, 20).cast("long")
    return _scores(spark, sf_dir).withColumns({
        "attention_score": F.when(i % 41 == 0, F.col("attention_score") / 2).otherwise(F.col("attention_score")),
        "compound_exposure": F.when(i % 37 != 0, F.col("compound_exposure")),
        "portfolio_rank": F.when(i % 43 == 0, F.col("portfolio_rank") + 1).otherwise(F.col("portfolio_rank"))})


@query(f"""WITH {PORTFOLIO}, {SCORED}, wrong AS (SELECT {KEY}, cost_risk_probability, schedule_risk_probability, risk_coverage,
  CASE WHEN i % 41 = 0 THEN attention_score / 2 ELSE attention_score END AS attention_score,
  CASE WHEN i % 37 <> 0 THEN compound_exposure END AS compound_exposure,
  CASE WHEN i % 43 = 0 THEN portfolio_rank + 1 ELSE portfolio_rank END AS portfolio_rank
  FROM (SELECT *, CAST(substr({KEY}, 5) AS BIGINT) AS i FROM scores)),
again AS (SELECT *, rank() OVER (ORDER BY attention_score DESC) AS r FROM wrong)
SELECT 'attention_formula' AS "check", count(*) FILTER (attention_score <> greatest(cost_risk_probability, schedule_risk_probability)) AS violations FROM wrong
UNION ALL SELECT 'compound_formula', count(*) FILTER (compound_exposure <> least(cost_risk_probability, schedule_risk_probability)) FROM wrong
UNION ALL SELECT 'partial_pattern', count(*) FILTER ((risk_coverage = 'PARTIAL') <> (schedule_risk_probability IS NULL AND compound_exposure IS NULL)) FROM wrong
UNION ALL SELECT 'probability_range', 0
UNION ALL SELECT 'tie_consistency', count(*) FILTER (a <> b) FROM (SELECT min(portfolio_rank) AS a, max(portfolio_rank) AS b FROM wrong GROUP BY attention_score)
UNION ALL SELECT 'rank_order', count(*) FILTER (r <> portfolio_rank) FROM again""")
def audit_scores(spark, sf_dir):
    """Violations in a score table."""
    return S.audit_scores(_wrong_scores(spark, sf_dir))


# --- explanations and interventions with closed-form scorers ----------------------------------


def _score_sql(task, swap=None) -> str:
    """Probability of a closed-form scorer as SQL, features taken from ``swap(name)``."""
    swap = swap or (lambda c: c)
    bias, weights, (column, level, bonus) = D._WEIGHTS[task]
    z = f"CAST({bias} AS DOUBLE)" + "".join(
        f" + coalesce(CAST({swap(c)} AS DOUBLE), 0.0) * CAST({w} AS DOUBLE)" for c, w in weights.items())
    z += f" + CASE WHEN {swap(column)} = '{level}' THEN CAST({bonus} AS DOUBLE) ELSE 0.0 END"
    return f"round(1.0 / (1.0 + exp(-({z}))), 6)"


FEATURES = [*NUMERIC_FEATURES, *CATEGORICAL_FEATURES]
_REFERENCE = "reference AS (SELECT " + ", ".join(
    [f"median({c}) AS {c}" for c in NUMERIC_FEATURES]
    + [f"(SELECT {c} FROM cohort GROUP BY {c} ORDER BY count(*) DESC, {c} LIMIT 1) AS {c}" for c in CATEGORICAL_FEATURES]
) + " FROM cohort)"


@query(f"WITH {COHORT}, {_REFERENCE} SELECT " + ", ".join(f"round({c}, 6) AS {c}" for c in NUMERIC_FEATURES)
       + ", feat_state, feat_agency FROM reference")
def reference_profile(spark, sf_dir):
    """Medians and modes of the whole cohort."""
    return X.reference_profile(D.cohort(spark, sf_dir)).withColumns({c: F.round(c, 6) for c in NUMERIC_FEATURES})


def _deltas_sql(task, name, where="TRUE"):
    """CTE ``name``: (key, ord, feature, base, delta) of one task."""
    parts = []
    for i, f in enumerate(FEATURES):
        swap = lambda c, f=f: f"r.{c}" if c == f else f"c.{c}"
        parts.append(f"SELECT c.{KEY}, {i} AS ord, '{f}' AS feature, {_score_sql(task, lambda c: 'c.' + c)} AS base, "
                     f"round({_score_sql(task, lambda c: 'c.' + c)} - {_score_sql(task, swap)}, 6) AS delta "
                     f"FROM cohort c, reference r WHERE {where}")
    return f"{name} AS ({' UNION ALL '.join(parts)})"


@query(f"WITH {COHORT}, {_REFERENCE}, {_deltas_sql('cost', 'deltas')} SELECT {KEY}, ord, feature, round(base, 6) AS base, delta FROM deltas")
def marginal_perturbation(spark, sf_dir):
    """One feature at a time set to its reference."""
    rows = D.cohort(spark, sf_dir)
    out = X.perturb(rows, X.reference_profile(rows), D.closed_form("cost"), KEY)
    return out.select(KEY, "ord", "feature", F.round("base", 6).alias("base"), F.round("delta", 6).alias("delta"))


_TOP = f"""risk AS (
  SELECT *, {_score_sql('cost')} AS cost_risk_probability,
         CASE WHEN is_eligible_schedule_target = 1 THEN {_score_sql('schedule')} END AS schedule_risk_probability FROM cohort),
portfolio AS (SELECT * FROM risk), {SCORED}, {_REFERENCE}, {_deltas_sql('cost', 'dc')},
{_deltas_sql('schedule', 'ds', 'c.is_eligible_schedule_target = 1')},
ranked AS (SELECT *, row_number() OVER (PARTITION BY task, {KEY} ORDER BY abs(delta) DESC, ord) AS rn FROM (
  SELECT 'cost_overrun' AS task, * FROM dc UNION ALL SELECT 'schedule_slippage', * FROM ds)),
tops AS (SELECT task, {KEY}, any_value(base) AS base, {', '.join(
    f"max(feature) FILTER (rn = {i}) AS f{i}, max(delta) FILTER (rn = {i}) AS d{i}" for i in (1, 2, 3))}
  FROM ranked WHERE rn <= 3 GROUP BY 1, 2),
tasks AS (SELECT unnest(['cost_overrun', 'schedule_slippage']) AS task),
explained AS (SELECT s.*, tasks.task, base, f1, f2, f3, d1, d2, d3
  FROM scores s CROSS JOIN tasks LEFT JOIN tops ON tops.{KEY} = s.{KEY} AND tops.task = tasks.task)"""


def _dir(d):
    return f"CASE WHEN {d} > 1e-4 THEN 'ELEVATES_RISK' WHEN {d} < -1e-4 THEN 'ATTENUATES_RISK' WHEN {d} IS NOT NULL THEN 'NEUTRAL' END"


@query(f"WITH {COHORT}, {_TOP} SELECT {KEY}, task, CAST(base IS NOT NULL AS INTEGER) AS is_eligible_task_target, "
       "base AS predicted_risk_probability, attention_score, attention_tier, portfolio_rank, risk_coverage, "
       + ", ".join(f"f{i} AS top_{i}_feature, d{i} AS top_{i}_impact, {_dir(f'd{i}')} AS top_{i}_direction" for i in (1, 2, 3))
       + " FROM explained")
def explanation_table(spark, sf_dir):
    """Top three drivers per project and task."""
    table = X.in_task_order(D.risk_portfolio(spark, sf_dir).explanations)
    drivers = [f"top_{i}_{c}" for i in (1, 2, 3) for c in ("feature", "impact", "direction")]
    return table.select(KEY, "task", "is_eligible_task_target", "predicted_risk_probability", "attention_score",
                        "attention_tier", "portfolio_rank", "risk_coverage", *drivers)


@query(f"WITH {COHORT}, {_TOP} SELECT {KEY}, task, i AS rank, CASE i WHEN 1 THEN f1 WHEN 2 THEN f2 ELSE f3 END AS feature, "
       "CASE i WHEN 1 THEN d1 WHEN 2 THEN d2 ELSE d3 END AS impact FROM explained, (SELECT unnest([1, 2, 3]) AS i) WHERE f1 IS NOT NULL")
def tall_drivers(spark, sf_dir):
    """Wide drivers back to one row per rank."""
    return X.tall_drivers(D.risk_portfolio(spark, sf_dir).explanations, KEY).select(KEY, "task", "rank", "feature", "impact")


@query(f"WITH {COHORT} SELECT count(*) * 2 AS rows_checked, 0 AS mismatches FROM cohort")
def probability_mismatches(spark, sf_dir):
    """Explained probabilities equal the stored scores."""
    done = D.risk_portfolio(spark, sf_dir)
    return X.probability_mismatches(done.explanations, done.scores)


_PC, _PS = "cost_risk_probability", "schedule_risk_probability"
_ROUTES = f"""{_TOP},
evidence AS (SELECT s.*, feat_is_past_original_completion AS past, feat_physical_vs_financial_divergence AS div,
    feat_expenditure_to_original_cost_ratio AS ratio, feat_is_missing_approval_date AS noappr,
    c.f1 AS cf, c.d1 AS cd, t.f1 AS sf, t.d1 AS sd
  FROM scores s LEFT JOIN tops c ON c.{KEY} = s.{KEY} AND c.task = 'cost_overrun'
       LEFT JOIN tops t ON t.{KEY} = s.{KEY} AND t.task = 'schedule_slippage'),
cases AS (SELECT *, CASE
    WHEN risk_coverage = 'FULL' AND {_PC} >= 0.5 AND {_PS} >= 0.75 THEN 1 WHEN {_PC} >= 0.5 THEN 2
    WHEN risk_coverage = 'FULL' AND {_PS} >= 0.75 AND past = 1 THEN 3 WHEN risk_coverage = 'FULL' AND {_PS} >= 0.75 THEN 4
    WHEN risk_coverage = 'PARTIAL' THEN 5 WHEN abs(div) >= 25 THEN 6 WHEN past = 1 THEN 7 ELSE 8 END AS rule FROM evidence),
routed AS (SELECT {KEY}, {_PC}, {_PS}, attention_score, risk_coverage, portfolio_rank,
    'PRIORITY_' || right(attention_tier, 1) AS intervention_priority, attention_tier,
    CASE rule WHEN 1 THEN 'JOINT_COST_SCHEDULE_REVIEW' WHEN 2 THEN 'COST_REVIEW' WHEN 3 THEN 'COMPLETION_STATUS_REVIEW'
      WHEN 4 THEN 'SCHEDULE_REVIEW' WHEN 5 THEN 'DATA_QUALITY_REVIEW' WHEN 6 THEN 'EXPENDITURE_PROGRESS_REVIEW'
      WHEN 7 THEN 'COMPLETION_STATUS_REVIEW' ELSE 'PROGRESS_VERIFICATION' END AS primary_action,
    CASE rule WHEN 1 THEN CASE WHEN past = 1 THEN 'COMPLETION_STATUS_REVIEW' WHEN abs(div) >= 20 THEN 'EXPENDITURE_PROGRESS_REVIEW' ELSE 'PROGRESS_VERIFICATION' END
      WHEN 2 THEN CASE WHEN abs(div) >= 20 OR ratio >= 1 THEN 'EXPENDITURE_PROGRESS_REVIEW' WHEN risk_coverage = 'PARTIAL' THEN 'DATA_QUALITY_REVIEW' ELSE 'PROGRESS_VERIFICATION' END
      WHEN 3 THEN 'SCHEDULE_REVIEW' WHEN 8 THEN 'DATA_QUALITY_REVIEW' ELSE 'PROGRESS_VERIFICATION' END AS secondary_action,
    CASE rule WHEN 1 THEN 'JOINT_COST_SCHEDULE' WHEN 2 THEN 'COST_RISK' WHEN 3 THEN 'SCHEDULE_RISK' WHEN 4 THEN 'SCHEDULE_RISK'
      WHEN 5 THEN 'UNOBSERVED_SCHEDULE' WHEN 6 THEN 'PROGRESS_FINANCIAL_DIVERGENCE' WHEN 7 THEN 'COMPLETION_STATUS' ELSE 'BASELINE_MONITORING' END AS risk_focus,
    CASE rule WHEN 1 THEN 'Both evaluated cost and schedule risk are elevated; coordinated cost and schedule review is recommended.'
      WHEN 2 THEN CASE WHEN risk_coverage = 'PARTIAL' THEN 'Elevated cost risk is supported by budget expenditure signals; schedule outcome is unobserved, cost review is recommended.'
        ELSE 'Elevated cost risk is supported by ' || replace(replace(cf, 'feat_', ''), '_', ' ') || '; cost review is recommended.' END
      WHEN 3 THEN 'Elevated schedule risk is supported by a past-original-completion signal; completion status review is recommended.'
      WHEN 4 THEN 'Elevated schedule risk is supported by remaining duration and agency timeline patterns; schedule review is recommended.'
      WHEN 5 THEN 'Schedule outcome is unobserved in the available PIT cohort; prioritisation is based on cost risk only.'
      WHEN 6 THEN 'Physical-financial divergence of ' || printf('%+.1f', div) || '% points indicates expenditure pace mismatch; expenditure progress review is recommended.'
      WHEN 7 THEN 'Project had passed original completion date as of July 2025 cutoff; completion status verification is recommended.'
      ELSE 'Evaluated risk probabilities remain within baseline parameters; standard periodic progress verification is recommended.' END AS priority_reason,
    CASE rule WHEN 3 THEN 'feat_is_past_original_completion' WHEN 4 THEN sf WHEN 5 THEN 'schedule_outcome'
      WHEN 6 THEN 'feat_physical_vs_financial_divergence' WHEN 7 THEN 'feat_is_past_original_completion' ELSE cf END AS evidence_feature,
    CASE rule WHEN 3 THEN 'ELEVATES_RISK' WHEN 4 THEN {_dir('sd')} WHEN 5 THEN 'NEUTRAL'
      WHEN 6 THEN CASE WHEN div > 0 THEN 'ELEVATES_RISK' ELSE 'ATTENUATES_RISK' END WHEN 7 THEN 'ELEVATES_RISK' ELSE {_dir('cd')} END AS evidence_direction,
    CASE WHEN risk_coverage = 'PARTIAL' AND noappr = 1 THEN 'SCHEDULE_OUTCOME_UNOBSERVED_AND_MISSING_APPROVAL_DATE'
      WHEN risk_coverage = 'PARTIAL' THEN 'SCHEDULE_OUTCOME_UNOBSERVED' WHEN noappr = 1 THEN 'MISSING_APPROVAL_DATE'
      ELSE 'COMPLETE_BASELINE_DATA' END AS data_quality_flag
  FROM cases)"""
_ROUTED = [KEY, _PC, _PS, "attention_score", "risk_coverage", "portfolio_rank", "intervention_priority",
           "primary_action", "secondary_action", "risk_focus", "priority_reason", "evidence_feature",
           "evidence_direction", "data_quality_flag"]


@query(f"WITH {COHORT}, {_ROUTES} SELECT {', '.join(_ROUTED)} FROM routed")
def route_interventions(spark, sf_dir):
    """Score, explain and route the cohort."""
    return N.in_priority_order(D.risk_portfolio(spark, sf_dir).interventions).select(*_ROUTED)


@query(f"WITH {COHORT}, {_ROUTES} " + " UNION ALL ".join(
    f"SELECT '{c}' AS dimension, {c} AS value, count(*) AS projects, round(count(*) * 100.0 / (SELECT count(*) FROM routed), 6) AS share FROM routed GROUP BY {c}"
    for c in ("primary_action", "risk_focus", "data_quality_flag")))
def intervention_distributions(spark, sf_dir):
    """Actions, focus and quality flags with shares."""
    return N.distributions(D.risk_portfolio(spark, sf_dir).interventions).withColumn("share", F.round("share", 6))


@query("WITH words(word) AS (VALUES " + ", ".join(f"('{w}')" for w in N.FORBIDDEN_WORDS) + f"), {COHORT}, {_ROUTES} "
       "SELECT 'priority_reason' AS column_name, word, count(*) FILTER (contains(lower(priority_reason), word)) AS row_count FROM routed, words GROUP BY word "
       f"UNION ALL SELECT 'governance_note', word, count(*) FILTER (contains(lower('{N.GOVERNANCE_NOTE}'), word)) FROM routed, words GROUP BY word")
def forbidden_language(spark, sf_dir):
    """Forbidden wording in the advice."""
    return N.forbidden_language(D.risk_portfolio(spark, sf_dir).interventions)


# --- serving ------------------------------------------------------------------------------------


def _served(spark, sf_dir):
    done = D.risk_portfolio(spark, sf_dir)
    return Q.summaries(done.scores, done.interventions)


_SUMMARY = f"""{_ROUTES}, summaries AS (SELECT s.{KEY}, source_project_id, project_name, feat_state AS state, feat_agency AS agency,
  s.attention_score, s.attention_tier, s.portfolio_rank, s.risk_coverage, s.{_PC}, s.{_PS}, compound_exposure,
  intervention_priority, primary_action FROM scores s JOIN routed r ON r.{KEY} = s.{KEY})"""


@query(f"WITH {COHORT}, {_SUMMARY}, f AS (SELECT * FROM summaries WHERE state = 'en' AND risk_coverage = 'FULL') "
       f"SELECT f.*, (SELECT count(*) FROM f) AS total_records, (SELECT CAST(ceil(count(*) / 20) AS BIGINT) FROM f) AS total_pages FROM f "
       f"ORDER BY {_PC} DESC, {KEY} LIMIT 20 OFFSET 20")
def catalogue_page(spark, sf_dir):
    """Q1: filter, sort, page, totals."""
    return Q.catalogue(_served(spark, sf_dir), "cost_risk_probability", "desc", page=2, state="en", coverage="FULL")


@query(f"WITH {COHORT}, {_SUMMARY}, f AS (SELECT * FROM summaries WHERE attention_tier = 'Tier 2') "
       f"SELECT f.*, (SELECT count(*) FROM f) AS total_records FROM f ORDER BY portfolio_rank, {KEY} LIMIT 50 OFFSET 10")
def leaderboard_page(spark, sf_dir):
    """Q2: rank order with limit and offset."""
    return Q.leaderboard(_served(spark, sf_dir), 50, 10, tier="Tier 2")


@query(f"WITH {COHORT}, {_ROUTES} SELECT s.{KEY}, project_name, feat_physical_progress_pct AS physical_progress_pct, "
       "feat_project_age_months AS project_age_months, s.attention_tier, s.portfolio_rank, 'raw_uncalibrated' AS variant, "
       "primary_action, risk_focus, replace(replace(evidence_direction, 'ELEVATES', 'INCREASES'), 'ATTENUATES', 'DECREASES') AS evidence_direction "
       f"FROM scores s JOIN routed r ON r.{KEY} = s.{KEY} WHERE s.{KEY} = 'DOC-77'")
def project_profile(spark, sf_dir):
    """Nested profile of one project, flattened for comparison."""
    done = D.risk_portfolio(spark, sf_dir)
    scores = done.scores
    p = Q.profile(scores, done.features, done.interventions, "DOC-77")
    return p.select(f"project.{KEY}", "project.project_name", "project.physical_progress_pct",
                    "project.project_age_months", "risk.attention_tier", "risk.portfolio_rank",
                    F.col("risk.models.cost_probability_variant").alias("variant"), "intervention.primary_action",
                    "intervention.risk_focus", "intervention.evidence_direction")


@query(f"WITH {COHORT}, {_ROUTES} SELECT {KEY}, attention_score, portfolio_rank, attention_tier, risk_coverage, {_PC}, {_PS}, "
       f"compound_exposure, is_eligible_cost_target, is_eligible_schedule_target FROM scores WHERE {KEY} = 'DOC-78'")
def project_risk(spark, sf_dir):
    """Q4: risk projection of one project."""
    return Q.risk(D.risk_portfolio(spark, sf_dir).scores, "DOC-78").select(KEY, *Q.RISK)


@query(f"WITH {COHORT}, {_TOP} SELECT {KEY}, max(CASE WHEN task = 'cost_overrun' THEN f1 END) AS first_cost_driver, "
       "max(CASE WHEN task = 'cost_overrun' THEN 3 END) AS cost_drivers, max(CASE WHEN task = 'schedule_slippage' THEN "
       "CASE WHEN f1 IS NULL THEN 0 ELSE 3 END END) AS schedule_drivers, max(CASE WHEN task = 'schedule_slippage' THEN d2 END) AS second_impact "
       f"FROM explained GROUP BY {KEY}")
def project_drivers(spark, sf_dir):
    """Q5: ordered driver lists of every project; empty when ineligible."""
    d = Q.drivers(D.risk_portfolio(spark, sf_dir).explanations)
    top = lambda task: F.col(f"{task}_drivers.top_drivers")
    return d.select(KEY, top("cost")[0]["feature"].alias("first_cost_driver"), F.size(top("cost")).alias("cost_drivers"),
                    F.size(top("schedule")).alias("schedule_drivers"), F.get(top("schedule"), F.lit(1))["impact"].alias("second_impact"))


@query(f"WITH {COHORT}, {_ROUTES} SELECT {KEY}, intervention_priority, primary_action, secondary_action, risk_focus, "
       f"priority_reason, data_quality_flag FROM routed WHERE {KEY} = 'DOC-79'")
def project_intervention(spark, sf_dir):
    """Q6: intervention projection of one project."""
    row = Q.intervention(D.risk_portfolio(spark, sf_dir).interventions, "DOC-79")
    return row.select(KEY, "intervention_priority", "primary_action", "secondary_action", "risk_focus",
                      "priority_reason", "data_quality_flag")


@query(f"WITH {COHORT}, {_ROUTES} " + " UNION ALL ".join(
    f"SELECT '{name}' AS dimension, {c} AS value, count(*) AS projects FROM routed GROUP BY {c}"
    for c, name in Q.DIMENSIONS.items()))
def portfolio_summary(spark, sf_dir):
    """Q7: five distributions from one aggregate, the maps of the summary unfolded."""
    done = D.risk_portfolio(spark, sf_dir)
    row = Q.portfolio_summary(done.scores, done.interventions)
    parts = [row.select(F.lit(n).alias("dimension"), F.explode(n).alias("value", "projects"))
             for n in Q.DIMENSIONS.values()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query(f"WITH {COHORT}, {_SUMMARY} SELECT * FROM summaries WHERE risk_coverage = 'FULL' AND "
       f"(contains(lower(project_name), '7 fr') OR contains(lower({KEY}), '7 fr') OR contains(lower(agency), '7 fr'))")
def search_projects(spark, sf_dir):
    """Free text combined with filters."""
    return Q.search(_served(spark, sf_dir), "7 FR", coverage="FULL")


@query(f"WITH {COHORT}, {_SUMMARY} SELECT * FROM summaries WHERE contains(lower(project_name), '7 fr') OR contains(lower({KEY}), '7 fr') OR contains(lower(agency), '7 fr')")
def indexed_search(spark, sf_dir):
    """The same search over the served table by the gram index."""
    served = cut_lineage(_served(spark, sf_dir))
    return build_index(served, KEY, Q.SEARCHED).search(served, KEY, "7 FR")


_GRAMS = "SELECT DISTINCT doc_id, unnest([substr(lower(text), i, 3) FOR i IN range(1, length(text) + 1)]) AS gram FROM documents"


@query(f"""WITH asked AS (SELECT unnest(['Qu', 'tion de la', 'zzzz']) AS query),
grams AS ({_GRAMS}),
counts AS (SELECT gram, count(*) AS n FROM grams GROUP BY gram),
own AS (SELECT DISTINCT query, unnest([substr(lower(query), i, 3) FOR i IN range(1, length(query) - 1)]) AS gram FROM asked),
known AS (SELECT query, gram, n, count(n) OVER (PARTITION BY query) = count(*) OVER (PARTITION BY query) AS whole FROM own LEFT JOIN counts USING (gram)),
wanted AS (SELECT query, gram, n, least(count(*) OVER (PARTITION BY query), {RAREST}) AS size FROM known WHERE whole QUALIFY row_number() OVER (PARTITION BY query ORDER BY n, gram) <= {RAREST}),
near AS (SELECT query, doc_id FROM wanted JOIN grams USING (gram) GROUP BY query, doc_id HAVING count(*) = any_value(size)
  UNION ALL SELECT DISTINCT query, doc_id FROM asked JOIN grams ON length(query) < 3 AND starts_with(gram, lower(query)))
SELECT query, (SELECT CAST(sum(n) AS BIGINT) FROM counts) AS postings, coalesce((SELECT CAST(sum(n) AS BIGINT) FROM wanted w WHERE w.query = asked.query), 0) AS read,
  (SELECT count(*) FROM near WHERE near.query = asked.query) AS candidates,
  (SELECT count(*) FROM documents WHERE contains(lower(text), lower(asked.query))) AS matches FROM asked""")
def search_effort(spark, sf_dir):
    """Rows of the gram index that searches over whole texts read, what they compare and find."""
    docs = D.table(spark, sf_dir, "documents").select("doc_id", "text")
    index, out = build_index(docs, "doc_id", ["text"]), None
    for text in ("Qu", "tion de la", "zzzz"):
        found = index.search(docs, "doc_id", text).agg(F.count("*").alias("matches"))
        one = beside(index.effort(text), found).withColumn("query", F.lit(text))
        out = one if out is None else out.unionByName(one)
    return out


@query(f"WITH {COHORT}, {_SUMMARY} SELECT {KEY}, {_PS}, row_number() OVER (ORDER BY coalesce({_PS}, -1) DESC, {KEY}) AS position "
       "FROM summaries QUALIFY position <= 25")
def resorted_page(spark, sf_dir):
    """Q9: first page by schedule risk, missing values last."""
    top = Q.resorted(_served(spark, sf_dir), "schedule", "desc").limit(25)
    # Positions of one page of 25 rows.
    from pyspark.sql import Window
    w = Window.partitionBy(F.lit(0)).orderBy(F.coalesce(F.col(_PS), F.lit(-1.0)).desc(), KEY)
    return top.select(KEY, _PS).withColumn("position", F.row_number().over(w).cast("long"))


@query(f"WITH {COHORT}, {_SUMMARY}, t AS (SELECT * FROM summaries WHERE (portfolio_rank, {KEY}) > (100, 'DOC-5')) "
       f"SELECT {KEY}, portfolio_rank, (SELECT count(*) FROM summaries) AS total_records FROM t ORDER BY portfolio_rank, {KEY} LIMIT 20")
def catalogue_keyset_page(spark, sf_dir):
    """Q1 beyond a key: a deep page without an offset."""
    page = Q.catalogue(_served(spark, sf_dir), after=(100, "DOC-5"))
    return page.select(KEY, "portfolio_rank", "total_records")
