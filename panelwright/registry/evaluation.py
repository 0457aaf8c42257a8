"""Queries on model metrics."""

from pyspark.sql import functions as F

from panelwright.operators import metrics as E
from panelwright.plans import derived as D
from panelwright.registry import query
from panelwright.registry.sql import PREDICTIONS

RATES = ["accuracy", "precision", "recall", "specificity", "f1", "balanced_accuracy"]


def _round(df, columns, digits=6):
    return df.withColumns({c: F.round(c, digits) for c in columns})


def counts(inclusive, by="task, lang"):
    op = ">=" if inclusive else ">"
    return f"""counts AS (SELECT {by}, count(*) AS n,
  count(*) FILTER (y = 1 AND p {op} 0.5) AS tp, count(*) FILTER (y = 0 AND p {op} 0.5) AS fp,
  count(*) FILTER (y = 0 AND NOT p {op} 0.5) AS tn, count(*) FILTER (y = 1 AND NOT p {op} 0.5) AS fn,
  avg((p - y) * (p - y)) AS brier,
  avg(-(y * ln(greatest(1e-6, least(1 - 1e-6, p))) + (1 - y) * ln(1 - greatest(1e-6, least(1 - 1e-6, p))))) AS log_loss
  FROM predictions GROUP BY {by}),
rates AS (SELECT *, coalesce((tp + tn) / nullif(n, 0), 0) AS accuracy, coalesce(tp / nullif(tp + fp, 0), 0) AS precision,
  coalesce(tp / nullif(tp + fn, 0), 0) AS recall, coalesce(tn / nullif(tn + fp, 0), 0) AS specificity FROM counts),
full_rates AS (SELECT *, coalesce(2 * precision * recall / nullif(precision + recall, 0), 0) AS f1,
  (recall + specificity) / 2 AS balanced_accuracy FROM rates)"""


def curves(by="task, lang"):
    g = by
    return f"""flat AS (SELECT {g}, p, count(*) FILTER (y = 1) AS pos, count(*) FILTER (y = 0) AS neg FROM predictions GROUP BY {g}, p),
run AS (SELECT *, sum(pos) OVER w AS cp, sum(neg) OVER w AS cn FROM flat
  WINDOW w AS (PARTITION BY {g} ORDER BY p DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
curves AS (SELECT {g}, sum(neg * (cp - pos / 2)) / nullif(CAST(sum(pos) AS DOUBLE) * sum(neg), 0) AS roc_auc,
  sum(pos * cp / (cp + cn)) / nullif(sum(pos), 0) AS pr_auc FROM run GROUP BY {g})"""


RATE_COLS = ", ".join(f"round({c}, 6) AS {c}" for c in [*RATES, "brier", "log_loss"])


def _confusion(spark, sf_dir, inclusive):
    df = E.with_rates(E.confusion(D.predictions(spark, sf_dir), by=["task", "lang"], inclusive=inclusive))
    return _round(df, [*RATES, "brier", "log_loss"])


@query(f"WITH {PREDICTIONS}, {counts(True)} SELECT task, lang, n, tp, fp, tn, fn, {RATE_COLS} FROM full_rates")
def threshold_metrics(spark, sf_dir):
    """E1-E5 with p >= 0.5 counted as positive."""
    return _confusion(spark, sf_dir, True)


@query(f"WITH {PREDICTIONS}, {counts(False)} SELECT task, lang, n, tp, fp, tn, fn, {RATE_COLS} FROM full_rates")
def argmax_metrics(spark, sf_dir):
    """E1-E5 with p = 0.5 counted as negative."""
    return _confusion(spark, sf_dir, False)


@query(f"WITH {PREDICTIONS}, {curves()} SELECT task, lang, round(roc_auc, 6) AS roc_auc, round(pr_auc, 6) AS pr_auc FROM curves")
def discrimination(spark, sf_dir):
    """ROC-AUC and average precision per task and language."""
    return _round(E.discrimination(D.predictions(spark, sf_dir), by=["task", "lang"]), ["roc_auc", "pr_auc"])


@query(f"""WITH {PREDICTIONS} SELECT task, CAST(greatest(ceil(p * 5) - 1, 0) AS INTEGER) AS bin, count(*) AS n,
  round(avg(p), 6) AS mean_probability, round(avg(y), 6) AS observed_rate FROM predictions GROUP BY 1, 2""")
def calibration_curve(spark, sf_dir):
    """Five uniform bins."""
    return _round(E.calibration_curve(D.predictions(spark, sf_dir), by=["task"]), ["mean_probability", "observed_rate"])


@query(f"WITH {PREDICTIONS} SELECT task, CAST(least(floor(p * 10), 9) AS INTEGER) AS bin, count(*) AS n FROM predictions GROUP BY 1, 2")
def probability_histogram(spark, sf_dir):
    """Ten bins."""
    return E.histogram(D.predictions(spark, sf_dir), by=["task"])


_LANG_PAIR = ", ".join(
    f"round(max({m}) FILTER (lang = 'en') - max({m}) FILTER (lang = 'fr'), 6) AS delta_{m}" for m in E.METRIC_NAMES)


@query(f"WITH {PREDICTIONS}, {counts(True)}, {curves()} SELECT task, {_LANG_PAIR} FROM full_rates JOIN curves USING (task, lang) GROUP BY task")
def metric_deltas(spark, sf_dir):
    """One variant less another, here two languages."""
    table = E.metrics(D.predictions(spark, sf_dir), by=["task", "lang"])
    return _round(E.metric_deltas(table, "lang", "en", "fr", ["task"]), [f"delta_{m}" for m in E.METRIC_NAMES])


_HURDLES = ", ".join(f"('{t}', '{m}', '{op}', {x})" for t, m, op, x in E.HURDLES)
_VALUE = "CASE metric " + " ".join(f"WHEN '{m}' THEN {m}" for m in sorted({h[1] for h in E.HURDLES})) + " END"


@query(f"""WITH {PREDICTIONS}, {counts(True, 'task')}, {curves('task')},
h(task, metric, rule, floor_) AS (VALUES {_HURDLES})
SELECT task, metric, rule, CAST(floor_ AS DOUBLE) AS floor, round({_VALUE}, 6) AS value,
  CASE WHEN rule = '>' THEN {_VALUE} > floor_ ELSE {_VALUE} >= floor_ END AS passes
FROM h JOIN full_rates USING (task) JOIN curves USING (task)""")
def hurdle_check(spark, sf_dir):
    """Metric floors per task."""
    return _round(E.hurdle_check(E.metrics(D.predictions(spark, sf_dir), by=["task"])), ["value"])


@query(f"""WITH {PREDICTIONS}, c AS (SELECT task, lang, count(*) FILTER (y = 1) AS positives, count(*) FILTER (y = 0) AS negatives
  FROM predictions GROUP BY 1, 2)
SELECT *, positives + negatives AS n, round(positives / (positives + negatives), 6) AS positive_rate,
  round(greatest(positives, negatives) / nullif(least(positives, negatives), 0), 6) AS imbalance_ratio FROM c""")
def class_balance(spark, sf_dir):
    """Class counts, base rate, imbalance."""
    return _round(E.class_balance(D.predictions(spark, sf_dir), by=["task", "lang"]), ["positive_rate", "imbalance_ratio"])


@query(f"""WITH {PREDICTIONS}, c AS (SELECT task, count(*) FILTER (y = 1) AS positives, count(*) FILTER (y = 0) AS negatives
  FROM predictions GROUP BY 1)
SELECT task, CAST(positives > negatives AS INTEGER) AS prediction,
  round(greatest(positives, negatives) / (positives + negatives), 6) AS accuracy, 0.5 AS balanced_accuracy,
  round(least(positives, negatives) / (positives + negatives), 6) AS brier,
  0.5 AS roc_auc, round(positives / (positives + negatives), 6) AS pr_auc FROM c""")
def majority_baseline(spark, sf_dir):
    """M5: the constant majority predictor."""
    table = E.majority_baseline(D.predictions(spark, sf_dir), by=["task"])
    cols = ["accuracy", "balanced_accuracy", "brier", "roc_auc", "pr_auc"]
    return _round(table.select("task", "prediction", *cols), cols)
