"""Binary classifier metrics, one row per group, all exact and distributed."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwright.functions.numeric import clip
from panelwright.operators.scale import beside, prefix_sums


def _ratio(num, den):
    return F.coalesce(F.try_divide(num, den), F.lit(0.0))


def confusion(df: DataFrame, y="y", p="p", by=(), tau=0.5, inclusive=True) -> DataFrame:
    """Counts at a threshold; ``inclusive=False`` is the argmax rule, where p = tau is class 0."""
    called = F.col(p) >= tau if inclusive else F.col(p) > tau
    pos = F.col(y) == 1
    return df.groupBy(*by).agg(
        F.count("*").alias("n"),
        F.count_if(pos & called).alias("tp"), F.count_if(~pos & called).alias("fp"),
        F.count_if(~pos & ~called).alias("tn"), F.count_if(pos & ~called).alias("fn"),
        F.avg(F.pow(F.col(p) - F.col(y), 2)).alias("brier"),
        F.avg(_log_loss_term(y, p)).alias("log_loss"),
    )


def _log_loss_term(y, p, eps=1e-6):
    q = clip(p, eps, 1.0 - eps)
    return -(F.col(y) * F.log(q) + (1 - F.col(y)) * F.log(1 - q))


def with_rates(counts: DataFrame) -> DataFrame:
    """Rates of a table holding tp, fp, tn, fn and n; 0/0 counts as 0."""
    tp, fp, tn, fn, n = (F.col(c) for c in ("tp", "fp", "tn", "fn", "n"))
    return counts.withColumns({
        "accuracy": _ratio(tp + tn, n),
        "precision": _ratio(tp, tp + fp),
        "recall": _ratio(tp, tp + fn),
        "specificity": _ratio(tn, tn + fp),
    }).withColumns({
        "f1": _ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")),
        "balanced_accuracy": (F.col("recall") + F.col("specificity")) * 0.5,
    })


def discrimination(df: DataFrame, y="y", p="p", by=()) -> DataFrame:
    """ROC-AUC (ties count half) and average precision (step-wise, ties grouped).

    Scores are collapsed to distinct values with class counts first; prefix sums over
    value ranges replace the global sort.
    """
    by = list(by)
    flat = prefix_sums(df, p, {"pos": F.count_if(F.col(y) == 1)}, by, descending=True)
    neg = F.col("n") - F.col("pos")
    seen, pos_seen = F.col("n_before") + F.col("n"), F.col("pos_before") + F.col("pos")
    sums = flat.groupBy(*by).agg(
        F.max("pos_total").alias("_p"), F.max(F.col("n_total") - F.col("pos_total")).alias("_n"),
        F.sum(neg * (F.col("pos_before") + F.col("pos") / 2)).alias("_area"),
        F.sum(F.col("pos") * pos_seen / seen).alias("_ap"))
    return sums.select(
        *by, F.try_divide(F.col("_area"), F.col("_p").cast("double") * F.col("_n")).alias("roc_auc"),
        F.try_divide(F.col("_ap"), F.col("_p")).alias("pr_auc"))


def metrics(df: DataFrame, y="y", p="p", by=(), tau=0.5, inclusive=True) -> DataFrame:
    """Every metric for every group in one table."""
    by = list(by)
    counts = with_rates(confusion(df, y, p, by, tau, inclusive))
    curves = discrimination(df, y, p, by)
    if by:
        return counts.join(curves, by, "left")
    return beside(counts, curves)


def calibration_curve(df: DataFrame, y="y", p="p", by=(), bins=5) -> DataFrame:
    """Mean probability and observed rate per uniform bin, right edges included."""
    b = F.greatest(F.ceil(F.col(p) * bins) - 1, F.lit(0)).cast("int")
    return df.groupBy(*by, b.alias("bin")).agg(
        F.count("*").alias("n"), F.avg(p).alias("mean_probability"), F.avg(y).alias("observed_rate"))


def histogram(df: DataFrame, p="p", by=(), bins=10) -> DataFrame:
    """Rows per uniform bin, left edges included, the last bin closed."""
    b = F.least(F.floor(F.col(p) * bins), F.lit(bins - 1)).cast("int")
    return df.groupBy(*by, b.alias("bin")).agg(F.count("*").alias("n"))


METRIC_NAMES = ["accuracy", "precision", "recall", "f1", "balanced_accuracy", "roc_auc", "pr_auc", "brier"]


def metric_deltas(table: DataFrame, variant: str, model, baseline, by=(), names=METRIC_NAMES) -> DataFrame:
    """``model`` less ``baseline`` for each metric of a table with one row per variant."""
    of = lambda v, m: F.max(F.when(F.col(variant) == v, F.col(m)))
    return table.groupBy(*by).agg(*[(of(model, m) - of(baseline, m)).alias(f"delta_{m}") for m in names])


# Floors a model has to clear, per task.
HURDLES = [
    ("cost_overrun", "roc_auc", ">=", 0.65), ("cost_overrun", "pr_auc", ">", 0.40),
    ("cost_overrun", "balanced_accuracy", ">", 0.60), ("cost_overrun", "recall", ">", 0.40),
    ("schedule_slippage", "balanced_accuracy", ">", 0.60), ("schedule_slippage", "pr_auc", ">", 0.88),
    ("schedule_slippage", "specificity", ">", 0.30), ("schedule_slippage", "tn", ">=", 15.0),
]


def hurdle_check(table: DataFrame, task="task", hurdles=HURDLES) -> DataFrame:
    """One row per (task, metric) floor with the value reached and whether it passes."""
    rows = F.array(*[
        F.struct(F.lit(t).alias("_t"), F.lit(m).alias("metric"), F.lit(op).alias("rule"),
                 F.lit(float(x)).alias("floor"), F.col(m).cast("double").alias("value"))
        for t, m, op, x in hurdles])
    tall = table.select(task, F.inline(rows)).filter(F.col(task) == F.col("_t")).drop("_t")
    ok = F.when(F.col("rule") == ">", F.col("value") > F.col("floor")).otherwise(F.col("value") >= F.col("floor"))
    return tall.withColumn("passes", ok)


def class_balance(df: DataFrame, y="y", by=()) -> DataFrame:
    """Class counts, base rate and majority-to-minority ratio."""
    pos, neg = F.count_if(F.col(y) == 1), F.count_if(F.col(y) == 0)
    return df.groupBy(*by).agg(pos.alias("positives"), neg.alias("negatives")).withColumns({
        "n": F.col("positives") + F.col("negatives"),
        "positive_rate": F.try_divide(F.col("positives"), F.col("positives") + F.col("negatives")),
        "imbalance_ratio": F.try_divide(F.greatest("positives", "negatives"), F.least("positives", "negatives")),
    })


def majority_baseline(df: DataFrame, y="y", by=()) -> DataFrame:
    """The constant majority predictor measured on its own data (ties predict 0)."""
    balance = class_balance(df, y, by)
    one = F.col("positives") > F.col("negatives")
    zero = F.lit(0).cast("long")
    counts = balance.withColumns({
        "prediction": one.cast("int"),
        "tp": F.when(one, F.col("positives")).otherwise(zero),
        "fp": F.when(one, F.col("negatives")).otherwise(zero),
        "tn": F.when(one, zero).otherwise(F.col("negatives")),
        "fn": F.when(one, zero).otherwise(F.col("positives")),
    })
    return with_rates(counts).withColumns({
        "roc_auc": F.lit(0.5),
        "pr_auc": F.col("positive_rate"),
        "brier": F.try_divide(F.col("fp") + F.col("fn"), F.col("n")),
    })
