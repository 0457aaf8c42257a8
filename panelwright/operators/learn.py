"""Preprocessing, models and calibration; parameters are fitted on train rows only.

What a fit brings to the driver is the model itself: a few constants, one weight or
importance per feature, one label list per categorical column.
"""

import math
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelwright.errors import ContractError
from panelwright.functions.numeric import clip, logit
from panelwright.operators.cohort import CATEGORICAL_FEATURES, NUMERIC_FEATURES
from panelwright.operators.explain import reference_profile
from panelwright.operators.forests import BINS, Forest, grow
from panelwright.operators.metrics import metric_deltas, metrics
from panelwright.operators.isotonic import isotonic_blocks, knots
from panelwright.operators.newton import MOST_FEATURES, newton_logistic
from panelwright.operators.scale import beside
from panelwright.operators.trees import bin_cuts
from panelwright.session import cut_lineage, discard

# The basic five-column predictor set of the feature-set experiment.
BASIC_NUMERIC = ["feat_original_cost_crore", "feat_cumulative_expenditure_crore", "feat_physical_progress_pct"]


def impute(df: DataFrame, profile: DataFrame) -> DataFrame:
    """Fill the columns of a one-row profile (medians, modes) where they are NULL."""
    names = profile.columns
    filled = beside(df, profile.select(*[F.col(c).alias(f"_fill_{c}") for c in names]))
    return filled.withColumns({c: F.coalesce(F.col(c), F.col(f"_fill_{c}")) for c in names}).drop(
        *[f"_fill_{c}" for c in names])


def median_impute(train: DataFrame, df: DataFrame, columns) -> DataFrame:
    return impute(df, reference_profile(train, columns, []).select(*columns))


def mode_impute(train: DataFrame, df: DataFrame, columns) -> DataFrame:
    return impute(df, reference_profile(train, [], columns).select(*columns))


def frequency_encode(train: DataFrame, df: DataFrame, column: str, out: str) -> DataFrame:
    """Share of each level among the non-null train rows; unseen levels get 0."""
    seen = train.filter(F.col(column).isNotNull())
    total = seen.agg(F.count("*")).scalar()
    shares = seen.groupBy(column).agg(F.count("*").alias("_n")).select(
        column, (F.col("_n") / total).alias(out))
    return df.join(shares, column, "left").select(
        *df.columns, F.coalesce(F.col(out), F.lit(0.0)).alias(out))


def top_levels(train: DataFrame, df: DataFrame, column: str, k: int, out: str, other="OTHER") -> DataFrame:
    """Keep the ``k`` most frequent train levels (name breaks ties), the rest become OTHER."""
    best = (train.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("_n"))
            .orderBy(F.col("_n").desc(), F.col(column)).limit(k)
            .agg(F.collect_list(column).alias("_l")))
    return df.withColumn("_l", best.scalar()).withColumn(
        out, F.when(F.array_contains("_l", F.col(column)), F.col(column)).otherwise(F.lit(other))).drop("_l")


def one_hot_levels(df: DataFrame, column: str, levels) -> DataFrame:
    """0/1 column per level; an unknown level is all zeros."""
    return df.withColumns({
        f"{column}_{v}": F.coalesce(F.col(column) == v, F.lit(False)).cast("int") for v in levels})


def standardize(train: DataFrame, df: DataFrame, columns) -> DataFrame:
    """Subtract the train mean and divide by the train deviation (population); 0 spread keeps 1."""
    stats = train.agg(*[s for c in columns for s in (
        F.avg(c).alias(f"_m_{c}"), F.stddev_pop(c).alias(f"_s_{c}"))])
    scale = lambda c: F.when(F.col(f"_s_{c}") > 0, F.col(f"_s_{c}")).otherwise(F.lit(1.0))
    return beside(df, stats).select(
        *df.columns, *[((F.col(c) - F.col(f"_m_{c}")) / scale(c)).alias(f"{c}_scaled") for c in columns])


@dataclass
class FittedModel:
    """A fitted classifier with its imputation profile and feature names."""

    pipeline: PipelineModel
    profile: dict
    numeric: list
    categorical: list
    names: list = field(default_factory=list)

    def score(self, df: DataFrame, out="probability") -> DataFrame:
        """Add the probability of class 1."""
        filled = df.select("*", *[
            F.coalesce(F.col(c).cast("double" if c in self.numeric else "string"), F.lit(v)).alias(f"_x_{c}")
            for c, v in self.profile.items()])
        scored = self.pipeline.transform(filled)
        return scored.select(*df.columns, vector_to_array("probability")[1].alias(out))

    @property
    def classifier(self):
        return self.pipeline.stages[-1]

    @property
    def intercept(self) -> float:
        return float(self.classifier.intercept)

    @property
    def weights(self) -> list:
        return [float(w) for w in self.classifier.coefficients]


@dataclass
class LogisticModel:
    """Weights by feature name, an intercept and the imputation profile; a score is one column expression."""

    intercept: float
    names: list
    weights: list
    profile: dict
    numeric: list
    levels: dict

    def score(self, df: DataFrame, out="probability") -> DataFrame:
        """Add the probability of class 1; a level unseen in the fit adds nothing."""
        of = dict(zip(self.names, self.weights))
        z = F.lit(self.intercept)
        for c in self.numeric:
            z = z + F.lit(of[c]) * F.coalesce(F.col(c).cast("double"), F.lit(float(self.profile[c])))
        for c, known in self.levels.items():
            if known:
                table = F.create_map(*[F.lit(v) for level in known for v in (level, of[f"{c}={level}"])])
                z = z + F.coalesce(F.try_element_at(table, F.coalesce(F.col(c).cast("string"), F.lit(self.profile[c]))), F.lit(0.0))
        return df.select("*", (F.lit(1.0) / (F.lit(1.0) + F.exp(-z))).alias(out))


def _profile(train: DataFrame, numeric, categorical) -> dict:
    row = reference_profile(train, numeric, categorical).first()
    return {c: (0.0 if c in numeric else "MISSING") if row[c] is None else row[c] for c in [*numeric, *categorical]}


def _fit(train: DataFrame, y: str, classifier, numeric, categorical) -> FittedModel:
    profile = _profile(train, numeric, categorical)
    filled = train.select(F.col(y).cast("double").alias("_label"), *[
        F.coalesce(F.col(c).cast("double" if c in numeric else "string"), F.lit(v)).alias(f"_x_{c}")
        for c, v in profile.items()])
    # The indexer gives unseen levels one extra index, the last; the encoder drops the last
    # slot, so an unseen level encodes as all zeros.
    stages = []
    if categorical:
        stages += [
            StringIndexer(inputCols=[f"_x_{c}" for c in categorical], outputCols=[f"_i_{c}" for c in categorical],
                          handleInvalid="keep", stringOrderType="alphabetAsc"),
            OneHotEncoder(inputCols=[f"_i_{c}" for c in categorical], outputCols=[f"_v_{c}" for c in categorical],
                          handleInvalid="error", dropLast=True)]
    stages.append(VectorAssembler(
        inputCols=[f"_x_{c}" for c in numeric] + [f"_v_{c}" for c in categorical], outputCol="_features"))
    pipeline = Pipeline(stages=[*stages, classifier]).fit(filled)
    labels = pipeline.stages[0].labelsArray if categorical else []
    names = list(numeric) + [f"{c}={level}" for c, known in zip(categorical, labels) for level in known]
    return FittedModel(pipeline, profile, list(numeric), list(categorical), names)


def _rows_to_fit(train: DataFrame) -> int:
    n = train.count()
    if not n:
        raise ContractError("no rows to fit a model on")
    return n


def fit_logistic(train: DataFrame, y: str, numeric=NUMERIC_FEATURES, categorical=CATEGORICAL_FEATURES,
                 c=1.0, steps=25):
    """L2 logistic regression on unscaled features with inverse strength ``c``; the intercept is free.

    Newton steps, see :mod:`panelwright.operators.newton`. With more levels than its sums
    take, :func:`fit_wide_logistic` fits the same loss by gradients.
    """
    _rows_to_fit(train)
    profile = _profile(train, numeric, categorical)
    levels, free = {}, MOST_FEATURES - 1 - len(numeric)
    for name in categorical:
        own = train.select(F.coalesce(F.col(name).cast("string"), F.lit(profile[name])).alias("v")).distinct().limit(free + 1).collect()
        levels[name] = sorted(r["v"] for r in own)
        free -= len(own)
        if free < 0:
            return fit_wide_logistic(train, y, numeric, categorical, c)
    names = [*numeric, *[f"{name}={level}" for name, known in levels.items() for level in known]]
    filled = lambda name: F.coalesce(F.col(name).cast("double" if name in numeric else "string"), F.lit(profile[name]))
    x = F.array(F.lit(1.0), *[filled(name) for name in numeric],
                *[(filled(name) == level).cast("double") for name, known in levels.items() for level in known])
    rows = cut_lineage(train.filter(F.col(y).isNotNull()).select(x.alias("x"), F.col(y).cast("double").alias("y"), F.lit(1.0).alias("w")))
    weights = newton_logistic(rows, [0.0] + [1.0 / c] * len(names), steps)
    discard(rows)
    return LogisticModel(float(weights[0]), names, [float(w) for w in weights[1:]], profile, list(numeric), levels)


def fit_wide_logistic(train: DataFrame, y: str, numeric=NUMERIC_FEATURES, categorical=CATEGORICAL_FEATURES,
                      c=1.0, max_iter=2000) -> FittedModel:
    """The loss of :func:`fit_logistic` on sparse vectors, for any number of levels."""
    n = _rows_to_fit(train)
    lr = LogisticRegression(featuresCol="_features", labelCol="_label", regParam=1.0 / (c * n),
                            elasticNetParam=0.0, standardization=False, maxIter=max_iter)
    return _fit(train, y, lr, numeric, categorical)


@dataclass
class ForestModel:
    """A forest with the imputation profile, cut points and levels that turn a row into bin numbers."""

    forest: Forest
    profile: dict
    cuts: dict
    levels: dict

    @property
    def names(self) -> list:
        return [*self.cuts, *[f"{c}={level}" for c, known in self.levels.items() for level in known]]

    def score(self, df: DataFrame, out="probability") -> DataFrame:
        """Add the probability of class 1; a level unseen in the fit is none of the known ones."""
        coded = df.withColumn("_codes", _codes(self.profile, self.cuts, self.levels, packed=True))
        scores = self.forest.score(coded.select(F.col("_codes").alias("codes")).distinct())
        # One row per distinct row of bins: it grows with the rows, so it is not broadcast.
        found = scores.select(F.col("codes").alias("_codes"), F.col("p").alias("_p")).hint("merge")
        return coded.join(found, "_codes").select(*df.columns, F.col("_p").alias(out))

    def importances(self) -> list:
        return self.forest.importances()


def _codes(profile, cuts, levels, packed=False):
    """Array (``packed``: one binary value) of a row's bin numbers: cut points below a value, then 1 for its level and 0 for the others.

    Bins are looked up in whole Arrow columns. As an expression, with a comparison for every cut, they took
    longer to compile and to evaluate than the trees took to score them.
    """
    filled = lambda c, kind: F.coalesce(F.col(c).cast(kind), F.lit(profile[c]).cast(kind))
    edges = [np.array(own, float) for own in cuts.values()]
    known = list(levels.values())
    width = len(edges) + sum(map(len, known))

    @F.arrow_udf("binary" if packed else "array<tinyint>")
    def bins(*columns):
        rows = len(columns[0])
        out = np.zeros((rows, width), np.int8)
        for at, (column, own) in enumerate(zip(columns, edges)):
            out[:, at] = np.searchsorted(own, column.to_numpy(zero_copy_only=False))
        at = len(edges)
        for column, own in zip(columns[at:], known):
            place = pc.index_in(column, pa.array(own, pa.string())).fill_null(-1).to_numpy(zero_copy_only=False)
            hit = np.flatnonzero(place >= 0)
            out[hit, at + place[hit]] = 1
            at += len(own)
        ends = pa.array(np.arange(rows + 1, dtype=np.int32) * width, pa.int32())
        if packed:
            return pa.Array.from_buffers(pa.binary(), rows, [None, ends.buffers()[1], pa.py_buffer(out)])
        return pa.ListArray.from_arrays(ends, pa.array(out.ravel()))

    # Marked so that a filter on the join key does not evaluate it once more.
    return bins.asNondeterministic()(*[filled(c, "double") for c in cuts], *[filled(c, "string") for c in levels])


def fit_forest(train: DataFrame, y: str, numeric=NUMERIC_FEATURES, categorical=CATEGORICAL_FEATURES,
               trees=300, depth=30, seed=42) -> ForestModel:
    """Random forest with sqrt features and bootstrap, see :mod:`panelwright.operators.forests`.

    Rows are drawn by their place in ``train``, see :func:`in_fit_order`.
    """
    _rows_to_fit(train)
    numeric, profile = list(numeric), _profile(train, numeric, categorical)
    filled = cut_lineage(train.filter(F.col(y).isNotNull()).select(F.monotonically_increasing_id().alias("row"), F.col(y).cast("bigint").alias("y"), *[
        F.coalesce(F.col(c).cast("double" if c in numeric else "string"), F.lit(v).cast("double" if c in numeric else "string")).alias(c) for c, v in profile.items()]))
    _rows_to_fit(filled)
    cuts = bin_cuts(filled, numeric, BINS)
    levels = {c: sorted(r[c] for r in filled.select(c).distinct().collect()) for c in categorical}
    names = [*numeric, *[v for known in levels.values() for v in known]]
    coded = cut_lineage(filled.select("row", "y", _codes(profile, cuts, levels).alias("codes")))
    pieces, base = grow(coded, len(names), trees, depth, math.ceil(math.sqrt(len(names))), seed)
    discard(filled, coded)
    return ForestModel(Forest(pieces, trees, len(names), base), profile, cuts, levels)


def in_fit_order(train: DataFrame, key: str, partitions=None) -> DataFrame:
    """Fixed partitions and row order, so that seeded sampling repeats after a lost executor."""
    n = partitions or int(train.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return train.repartition(n, key).sortWithinPartitions(key)


def score_tasks(df: DataFrame, cost: ForestModel, schedule: ForestModel,
                eligible="is_eligible_schedule_target") -> DataFrame:
    """Both probabilities; the schedule probability is NULL for ineligible rows."""
    both = schedule.score(cost.score(df, "cost_risk_probability"), "_ps")
    return both.withColumn("schedule_risk_probability", F.when(F.col(eligible) == 1, F.col("_ps"))).drop("_ps")


def coefficients(model: LogisticModel | FittedModel, spark) -> DataFrame:
    """(feature, kind, coefficient) with the intercept as a row."""
    rows = [("(intercept)", "intercept", model.intercept)]
    rows += [(n, "categorical" if "=" in n else "numeric", w) for n, w in zip(model.names, model.weights)]
    return spark.createDataFrame(rows, "feature string, kind string, coefficient double")


def extreme_levels(coefs: DataFrame, k=5) -> DataFrame:
    """The ``k`` largest and ``k`` smallest categorical coefficients."""
    cat = coefs.filter(F.col("kind") == "categorical")
    side = lambda order, mark: cat.orderBy(order, "feature").limit(k).withColumn("side", F.lit(mark))
    return side(F.col("coefficient").desc(), "top").unionByName(side(F.col("coefficient").asc(), "bottom"))


def importances(model: ForestModel, spark) -> DataFrame:
    """(feature, parent, importance) of a forest."""
    rows = [(n, n.split("=", 1)[0], float(v)) for n, v in zip(model.names, model.importances())]
    return spark.createDataFrame(rows, "feature string, parent string, importance double")


def cumulative_importance(table: DataFrame, k=15) -> DataFrame:
    """Top ``k`` raw features with the running share of the total."""
    top = table.orderBy(F.col("importance").desc(), "feature").limit(k)
    total = table.agg(F.sum("importance")).scalar()
    # The window runs over k rows.
    w = Window.partitionBy(F.lit(0)).orderBy(F.col("importance").desc(), "feature")
    return top.withColumn("cumulative_share", F.sum("importance").over(
        w.rowsBetween(Window.unboundedPreceding, 0)) / total)


def parent_importance(table: DataFrame) -> DataFrame:
    """Importance summed back to the feature each slot came from."""
    return table.groupBy("parent").agg(F.sum("importance").alias("importance"))


# --- calibration ----------------------------------------------------------------------


@dataclass
class Platt:
    """``logit(P) = alpha + beta * logit(p)``."""

    alpha: float
    beta: float

    def apply(self, df: DataFrame, p: str, out: str) -> DataFrame:
        z = F.lit(self.alpha) + F.lit(self.beta) * logit(p)
        return df.withColumn(out, F.lit(1.0) / (F.lit(1.0) + F.exp(-z)))


def _weighted(df, y, p):
    """Distinct probabilities with class counts: all a calibrator needs to see."""
    return df.filter(F.col(p).isNotNull() & F.col(y).isNotNull()).groupBy(
        F.col(p).alias("p"), F.col(y).cast("double").alias("label")).agg(F.count("*").cast("double").alias("w"))


def fit_platt(df: DataFrame, y: str, p: str, c=1e6) -> Platt:
    rows = _weighted(df, y, p)
    _rows_to_fit(df.filter(F.col(p).isNotNull() & F.col(y).isNotNull()))
    stored = cut_lineage(rows.select(F.array(F.lit(1.0), logit("p")).alias("x"), F.col("label").alias("y"), "w"))
    alpha, beta = newton_logistic(stored, [0.0, 1.0 / c])
    discard(stored)
    return Platt(float(alpha), float(beta))


@dataclass
class Isotonic:
    """Monotone map, linear between the blocks' ends and constant beyond them, clipped to [0, 1]."""

    xs: np.ndarray
    ys: np.ndarray

    def apply(self, df: DataFrame, p: str, out: str) -> DataFrame:
        xs, ys = self.xs, np.clip(self.ys, 0.0, 1.0)

        @F.pandas_udf("double")
        def mapped(values: pd.Series) -> pd.Series:
            return pd.Series(np.interp(values, xs, ys)).where(values.notna().to_numpy())

        return df.withColumn(out, mapped(F.col(p).cast("double")))


def fit_isotonic(df: DataFrame, y: str, p: str) -> Isotonic:
    _rows_to_fit(df.filter(F.col(p).isNotNull() & F.col(y).isNotNull()))
    points = _weighted(df, y, p).groupBy("p").agg(F.sum(F.col("label") * F.col("w")).alias("s"), F.sum("w").alias("w"))
    return Isotonic(*knots(isotonic_blocks(points)))


def calibration_slope(df: DataFrame, y: str, p: str) -> dict:
    """Diagnostic intercept and slope of the outcome on logit(p)."""
    m = fit_platt(df, y, p)
    return {"intercept_alpha": m.alpha, "slope_beta": m.beta}


def compare_calibrators(calibration: DataFrame, test: DataFrame, y: str, p: str) -> DataFrame:
    """Metrics, calibration intercept and slope of raw, sigmoid and isotonic probabilities on the same test rows."""
    platt, iso = fit_platt(calibration, y, p), fit_isotonic(calibration, y, p)
    wide = iso.apply(platt.apply(test, p, "_sigmoid"), p, "_isotonic")
    tall = wide.select(F.col(y).alias("y"), F.inline(F.array(*[
        F.struct(F.lit(v).alias("variant"), F.col(c).alias("p"))
        for v, c in (("raw", p), ("sigmoid", "_sigmoid"), ("isotonic", "_isotonic"))])))
    slopes = [(v, *calibration_slope(wide.withColumn("_v", clip(c, 1e-6, 1 - 1e-6)), y, "_v").values())
              for v, c in (("raw", p), ("sigmoid", "_sigmoid"), ("isotonic", "_isotonic"))]
    lines = test.sparkSession.createDataFrame(slopes, "variant string, intercept_alpha double, slope_beta double")
    return metrics(tall, "y", "p", ["variant"]).join(lines, "variant")


def compare_feature_sets(df: DataFrame, y: str, partition="partition", sets=None, c=1.0) -> DataFrame:
    """Logistic models on two predictor sets and one split, with test metrics per set."""
    sets = sets or {"basic": (BASIC_NUMERIC, CATEGORICAL_FEATURES),
                    "enhanced": (NUMERIC_FEATURES, CATEGORICAL_FEATURES)}
    train = df.filter(F.col(partition) != "TEST_HOLDOUT")
    test = df.filter(F.col(partition) == "TEST_HOLDOUT")
    parts = None
    for name, (numeric, categorical) in sets.items():
        scored = fit_logistic(train, y, numeric, categorical, c).score(test, "p").select(
            F.lit(name).alias("feature_set"), F.col(y).alias("y"), "p")
        parts = scored if parts is None else parts.unionByName(scored)
    return metrics(parts, "y", "p", ["feature_set"], inclusive=False)


def feature_set_deltas(table: DataFrame) -> DataFrame:
    return metric_deltas(table, "feature_set", "enhanced", "basic")
