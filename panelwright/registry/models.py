"""Queries on preprocessing and fitted models; forests have no SQL counterpart."""

from pyspark.sql import functions as F

from panelwright.operators import learn as M
from panelwright.operators import split as K
from panelwright.plans import derived as D
from panelwright.plans import portfolio as W
from panelwright.registry import query
from panelwright.registry.evaluation import RATE_COLS, RATES, counts, curves
from panelwright.registry.newton_sql import COEFFICIENTS, LOGISTIC, isotonic, newton
from panelwright.registry.sql import COHORT, PREDICTIONS
from panelwright.session import cut_lineage

KEY = "canonical_project_key"
_SETS = f"""WITH {COHORT}, numbered AS (SELECT *, CAST(source_project_id AS BIGINT) AS n,
    CASE WHEN CAST(source_project_id AS BIGINT) % 9 <> 0 THEN feat_agency END AS agency FROM cohort),
train AS (SELECT * FROM numbered WHERE n % 5 <> 0)"""


def _sets(spark, sf_dir):
    """(train, all): every fifth row is kept out of the fit; some agencies are missing."""
    n = F.col("source_project_id").cast("long")
    df = D.cohort(spark, sf_dir).withColumn("agency", F.when(n % 9 != 0, F.col("feat_agency")))
    return df.filter(n % 5 != 0), df


@query(_SETS + f" SELECT {KEY}, coalesce(feat_project_age_months, (SELECT median(feat_project_age_months) FROM train)) AS age FROM numbered")
def median_impute(spark, sf_dir):
    """M1: exact train median."""
    return M.median_impute(*_sets(spark, sf_dir), ["feat_project_age_months"]).select(
        KEY, F.col("feat_project_age_months").alias("age"))


@query(_SETS + f" SELECT {KEY}, coalesce(agency, (SELECT agency FROM train WHERE agency IS NOT NULL GROUP BY agency "
       "ORDER BY count(*) DESC, agency LIMIT 1)) AS agency FROM numbered")
def mode_impute(spark, sf_dir):
    """M2: most frequent train value, smallest on ties."""
    return M.mode_impute(*_sets(spark, sf_dir), ["agency"]).select(KEY, "agency")


@query(_SETS + f" SELECT {KEY}, CAST(feat_state = 'en' AS INTEGER) AS feat_state_en, CAST(feat_state = 'fr' AS INTEGER) AS feat_state_fr FROM numbered")
def one_hot(spark, sf_dir):
    """M3: one column per level, unknown levels all zeros."""
    return M.one_hot_levels(_sets(spark, sf_dir)[1], "feat_state", ["en", "fr"]).select(KEY, "feat_state_en", "feat_state_fr")


@query(_SETS + ", known AS (SELECT agency FROM train WHERE agency <> 'src3'), shares AS (SELECT agency, "
       "count(*) / (SELECT count(*) FROM known) AS s FROM known GROUP BY 1) "
       f"SELECT {KEY}, round(coalesce(s, 0), 6) AS agency_share FROM numbered LEFT JOIN shares USING (agency)")
def frequency_encode(spark, sf_dir):
    """M4: train share of each level; a level unseen in the fit gets 0."""
    train, df = _sets(spark, sf_dir)
    out = M.frequency_encode(train.filter(F.col("agency") != "src3"), df, "agency", "agency_share")
    return out.select(KEY, F.round("agency_share", 6).alias("agency_share"))


@query(_SETS + ", best AS (SELECT agency FROM train WHERE agency IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, agency LIMIT 3) "
       f"SELECT {KEY}, CASE WHEN agency IN (SELECT agency FROM best) THEN agency ELSE 'OTHER' END AS level FROM numbered")
def top_levels(spark, sf_dir):
    """The most frequent train levels, the rest as OTHER."""
    return M.top_levels(*_sets(spark, sf_dir), "agency", 3, "level").select(KEY, "level")


_SCALED = ["feat_log_original_cost", "feat_physical_progress_pct"]


@query(_SETS + ", s AS (SELECT " + ", ".join(f"avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}" for c in _SCALED)
       + f" FROM train) SELECT {KEY}, " + ", ".join(f"round(({c} - m_{c}) / s_{c}, 6) AS {c}_scaled" for c in _SCALED) + " FROM numbered, s")
def standard_scaling(spark, sf_dir):
    """Train mean and deviation."""
    out = M.standardize(*_sets(spark, sf_dir), _SCALED)
    return out.select(KEY, *[F.round(f"{c}_scaled", 6).alias(f"{c}_scaled") for c in _SCALED])


# --- fitted models -----------------------------------------------------------------------------


#: Task, its target, and the rows that take part.
TASKS = {"cost": ("cost_overrun", "true"), "schedule": ("time_overrun", "is_eligible_schedule_target = 1")}


def _per_task(spark, sf_dir, table):
    """``table(rows)`` of both tasks on their own partitions, with the task's name."""
    cohort, out = D.cohort(spark, sf_dir), None
    for task, (target, eligible) in TASKS.items():
        rows = cohort.filter(eligible).withColumn("y", F.col(target))
        one = table(cut_lineage(K.stratified_partition(rows, "y", KEY))).withColumn("task", F.lit(task))
        out = one if out is None else out.unionByName(one)
    return out


def _part(df, name):
    return df.filter(F.col("partition") == name)


@query(f"WITH RECURSIVE {LOGISTIC} SELECT {KEY}, partition, CAST(y AS INTEGER) AS y, round(p, 6) AS p, task FROM scored")
def logistic_scores(spark, sf_dir):
    """M6: logistic probabilities of every row, both tasks."""
    return _per_task(spark, sf_dir, lambda df: M.fit_logistic(_part(df, "MODELFIT"), "y").score(df, "p").select(
        KEY, "partition", F.col("y").cast("int").alias("y"), F.round("p", 6).alias("p")))


# Fits keep totals: with a free intercept a logistic fit's probabilities sum to its events, and
# pooling adjacent violators keeps the weighted mean.
_TOTALS = f"""WITH {COHORT}, rows_ AS (
  SELECT 'cost' AS task, cost_overrun AS y FROM cohort
  UNION ALL SELECT 'schedule', time_overrun FROM cohort WHERE is_eligible_schedule_target = 1)
SELECT task, model, count(*) AS row_count, CAST(sum(y) AS DOUBLE) AS events
FROM rows_ CROSS JOIN (VALUES ('logistic'), ('sigmoid'), ('isotonic')) m(model) GROUP BY ALL"""


@query(_TOTALS)
def fitted_totals(spark, sf_dir):
    """Expected events of logistic, sigmoid and isotonic fits on their own rows."""
    out = None
    for task, (target, eligible) in TASKS.items():
        rows = D.cohort(spark, sf_dir).filter(eligible).withColumn("y", F.col(target))
        scored = cut_lineage(M.fit_logistic(rows, "y").score(rows, "logistic").select("y", "logistic"))
        wide = M.fit_platt(scored, "y", "logistic").apply(scored, "logistic", "sigmoid")
        wide = M.fit_isotonic(scored, "y", "logistic").apply(wide, "logistic", "isotonic")
        tall = wide.select(F.inline(F.array(*[
            F.struct(F.lit(m).alias("model"), F.col(m).alias("p")) for m in ("logistic", "sigmoid", "isotonic")])))
        one = tall.groupBy("model").agg(F.count("*").alias("row_count"), F.round(F.sum("p"), 1).alias("events")).withColumn("task", F.lit(task))
        out = one if out is None else out.unionByName(one)
    return out


@query(f"WITH {COHORT} SELECT {KEY}, TRUE AS has_cost, is_eligible_schedule_target = 1 AS has_schedule, TRUE AS in_range FROM cohort")
def forest_score_coverage(spark, sf_dir):
    """M7, M8: which rows get which forest probability, all within 0 and 1."""
    c, s = F.col("cost_risk_probability"), F.col("schedule_risk_probability")
    return forest_scores(spark, sf_dir).select(KEY, c.isNotNull().alias("has_cost"), s.isNotNull().alias("has_schedule"), (
        c.between(0, 1) & F.coalesce(s, F.lit(0)).between(0, 1)).alias("in_range"))


@query()
def forest_scores(spark, sf_dir):
    """M7, M8: 300-tree forests for both tasks, schedule only where eligible."""
    cohort = D.cohort(spark, sf_dir)
    cost, schedule, parts = W.train(cohort, "cost_overrun", "time_overrun")
    scored = M.score_tasks(cohort, cost, schedule)
    return W.attach_partitions(_as_scores(scored), parts).select(
        KEY, "cost_risk_probability", "schedule_risk_probability", "cost_partition", "schedule_partition")


def _as_scores(df):
    return df.withColumn("attention_score", F.greatest("cost_risk_probability", "schedule_risk_probability"))


@query()
def feature_set_experiment(spark, sf_dir):
    """Basic and enhanced predictors on one split, with deltas, both tasks."""
    return _per_task(spark, sf_dir, lambda df: M.feature_set_deltas(M.compare_feature_sets(df, "y")))


@query(f"WITH RECURSIVE {COEFFICIENTS} SELECT c.task, c.feature, kind, round(coefficient, 6) AS coefficient, "
       "CASE WHEN t <= 5 THEN 'top' WHEN b <= 5 THEN 'bottom' END AS side FROM coefs c LEFT JOIN ranked r ON r.task = c.task AND r.feature = c.feature")
def logistic_coefficients(spark, sf_dir):
    """Coefficients by name, extreme levels marked, both tasks."""
    def table(df):
        coefs = M.coefficients(M.fit_logistic(_part(df, "MODELFIT"), "y"), spark)
        return coefs.join(M.extreme_levels(coefs).select("feature", "side").distinct(), "feature", "left").withColumn(
            "coefficient", F.round("coefficient", 6))

    return _per_task(spark, sf_dir, table)


@query()
def forest_importances(spark, sf_dir):
    """Raw top importances with their share, and parent sums, both tasks."""
    def table(df):
        own = M.importances(M.fit_forest(M.in_fit_order(_part(df, "MODELFIT"), KEY), "y"), spark)
        top = M.cumulative_importance(own).join(
            M.parent_importance(own).withColumnRenamed("importance", "parent_importance"), "parent")
        return top.select("feature", "parent", "importance", "cumulative_share", "parent_importance")

    return _per_task(spark, sf_dir, table)


_CLIPPED = "greatest(1e-6, least(1 - 1e-6, p))"
_LOGIT = f"[1.0, ln({_CLIPPED} / (1 - {_CLIPPED}))]"


@query(f"WITH {PREDICTIONS}, odd AS (SELECT * FROM predictions WHERE CAST(substr(canonical_project_key, 5) AS BIGINT) % 2 = 1), "
       + isotonic("odd", "predictions", "calibrated") + f" SELECT {KEY}, task, round(iso, 6) AS calibrated FROM calibrated WHERE p IS NOT NULL")
def isotonic_calibration(spark, sf_dir):
    """Isotonic map fitted on every other row, applied to all, with linear parts between its blocks."""
    rows, out = D.predictions(spark, sf_dir).filter(F.col("p").isNotNull()), None
    for task in ("cost_overrun", "schedule_slippage"):
        own = rows.filter(F.col("task") == task)
        fitted = M.fit_isotonic(own.filter(F.substring(KEY, 5, 99).cast("long") % 2 == 1), "y", "p")
        one = fitted.apply(own, "p", "iso").select(KEY, "task", F.round("iso", 6).alias("calibrated"))
        out = one if out is None else out.unionByName(one)
    return out


_COMPARED = f"""WITH RECURSIVE {LOGISTIC},
held AS (SELECT task, p, CAST(y AS DOUBLE) AS y FROM scored WHERE partition = 'CALIBRATION_HOLDOUT'),
tested AS (SELECT task, p, y FROM scored WHERE partition = 'TEST_HOLDOUT'),
platt_design AS (SELECT task, {_LOGIT} AS x, y FROM held),
{newton('platt_design', 2, [0, 1e-6], 'platt')},
{isotonic('held', 'tested', 'bent')},
predictions AS (SELECT task, 'raw' AS variant, y, p FROM tested
  UNION ALL SELECT t.task, 'sigmoid', y, 1 / (1 + exp(-list_dot_product(w, {_LOGIT}))) FROM tested t JOIN platt ON platt.task = t.task
  UNION ALL SELECT task, 'isotonic', y, iso FROM bent),
slope_design AS (SELECT task || '/' || variant AS task, {_LOGIT} AS x, CAST(y AS DOUBLE) AS y FROM predictions),
{newton('slope_design', 2, [0, 1e-6], 'slopes')},
{counts(True, by='task, variant')}, {curves(by='task, variant')}
SELECT task, variant, n, tp, fp, tn, fn, {RATE_COLS}, round(roc_auc, 6) AS roc_auc, round(pr_auc, 6) AS pr_auc,
  round(w[1], 4) AS intercept_alpha, round(w[2], 4) AS slope_beta
FROM full_rates JOIN curves USING (task, variant) JOIN slopes ON slopes.task = full_rates.task || '/' || full_rates.variant"""


@query(_COMPARED)
def calibrated_logistic(spark, sf_dir):
    """Raw, sigmoid and isotonic probabilities of the logistic model on the same test rows, both tasks."""
    def table(df):
        scored = cut_lineage(M.fit_logistic(_part(df, "MODELFIT"), "y").score(df, "p"))
        done = M.compare_calibrators(_part(scored, "CALIBRATION_HOLDOUT"), _part(scored, "TEST_HOLDOUT"), "y", "p")
        return done.select("variant", "n", "tp", "fp", "tn", "fn", *[F.round(c, 6).alias(c) for c in [*RATES, "brier", "log_loss", "roc_auc", "pr_auc"]],
                           F.round("intercept_alpha", 4).alias("intercept_alpha"), F.round("slope_beta", 4).alias("slope_beta"))

    return _per_task(spark, sf_dir, table)


@query()
def calibrated_comparison(spark, sf_dir):
    """Raw, sigmoid and isotonic probabilities of both models and tasks compared."""
    def table(df):
        out, fit = None, M.in_fit_order(_part(df, "MODELFIT"), KEY)
        for name, model in (("logistic", M.fit_logistic(fit, "y")), ("forest", M.fit_forest(fit, "y"))):
            scored = cut_lineage(model.score(df, "p"))
            one = M.compare_calibrators(_part(scored, "CALIBRATION_HOLDOUT"), _part(scored, "TEST_HOLDOUT"), "y", "p")
            one = one.withColumn("model", F.lit(name))
            out = one if out is None else out.unionByName(one)
        return out

    return _per_task(spark, sf_dir, table)


@query(f"WITH RECURSIVE {PREDICTIONS}, design AS (SELECT task, {_LOGIT} AS x, CAST(y AS DOUBLE) AS y FROM predictions WHERE p IS NOT NULL AND y IS NOT NULL), "
       + newton("design", 2, [0, 1e-6]) + " SELECT task, round(w[1], 6) AS intercept_alpha, round(w[2], 6) AS slope_beta FROM fit")
def calibration_slopes(spark, sf_dir):
    """Calibration intercept and slope of the given probabilities."""
    rows = D.predictions(spark, sf_dir)
    out = [(task, *M.calibration_slope(rows.filter(F.col("task") == task), "y", "p").values())
           for task in ("cost_overrun", "schedule_slippage")]
    return spark.createDataFrame([(t, round(a, 6), round(b, 6)) for t, a, b in out], "task string, intercept_alpha double, slope_beta double")


@query()
def forest_portfolio(spark, sf_dir):
    """W3 with trained forests: score, explain, route."""
    done = W.build(D.cohort(spark, sf_dir), "cost_overrun", "time_overrun")
    return done.interventions
