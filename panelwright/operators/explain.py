"""Local explanations: replace one feature by its reference value, score again, compare.

One wide row becomes one row per (feature), scored in a single transform; the reference
profile is a row of constants. Nothing is paired with anything else.
"""

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwright.functions.text import source_fact
from panelwright.operators.cohort import CATEGORICAL_FEATURES, NUMERIC_FEATURES
from panelwright.operators.scale import beside, exact_quantiles

# Output texts.
METHOD = "Local Marginal Reference Perturbation"
DISCLAIMER = "Statistical association in evaluated data; not a causal driver."
UNOBSERVED_FACT = ("Schedule outcome unobserved / unrevised in source reports; "
                   "schedule monitoring inactive.")


def reference_profile(df: DataFrame, numeric=NUMERIC_FEATURES, categorical=CATEGORICAL_FEATURES) -> DataFrame:
    """One row: exact median of each numeric feature, most frequent value of each categorical
    (smallest on ties), over the whole cohort."""
    tall = lambda columns, dtype: df.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("feature"), F.col(c).cast(dtype).alias("value")) for c in columns])))
    parts = []
    if numeric:
        medians = exact_quantiles(tall(numeric, "double"), "value", [0.5], by=["feature"])
        parts.append(medians.select("feature", F.col("q")[0].alias("median"), F.lit(None).cast("string").alias("mode")))
    if categorical:
        counts = tall(categorical, "string").filter(F.col("value").isNotNull()).groupBy("feature", "value").agg(
            F.count("*").alias("n"))
        parts.append(counts.groupBy("feature").agg(
            F.lit(None).cast("double").alias("median"), F.min(F.struct(-F.col("n"), "value"))["value"].alias("mode")))
    both = reduce(DataFrame.unionByName, parts)
    pick = lambda c, field: F.max(F.when(F.col("feature") == c, F.col(field))).alias(c)
    return both.agg(*[pick(c, "median") for c in numeric], *[pick(c, "mode") for c in categorical])


def perturb(df: DataFrame, reference: DataFrame, scorer, key, numeric=NUMERIC_FEATURES,
            categorical=CATEGORICAL_FEATURES, probability="probability") -> DataFrame:
    """(key, ord, feature, value, base, delta) for every row and feature.

    ``scorer`` adds ``probability`` to a table holding the feature columns. A ``NULL``
    feature marks the unchanged row, so base and variants are scored together.
    """
    features = [*numeric, *categorical]
    renamed = reference.select(*[F.col(c).alias(f"_ref_{c}") for c in features])
    slots = F.array(F.struct(F.lit(-1).alias("ord"), F.lit(None).cast("string").alias("feature")), *[
        F.struct(F.lit(i).alias("ord"), F.lit(c).alias("feature")) for i, c in enumerate(features)])
    text = F.create_map(*[x for c in features for x in (F.lit(c), F.col(c).cast("string"))])
    wide = beside(df.select(key, *features), renamed).select("*", text.alias("_text")).select("*", F.inline(slots))
    swap = lambda c: F.when(F.col("feature") == c, F.col(f"_ref_{c}")).otherwise(F.col(c))
    # Scorers may shuffle rows: a row carries the text of its own feature, not of all.
    tried = wide.withColumn("value", F.col("_text")[F.col("feature")]).withColumns({c: swap(c) for c in features}).drop("_text", *[f"_ref_{c}" for c in features])
    scored = scorer(tried).select(key, "ord", "feature", "value", probability)
    # 13 rows per key come back together; the list is bounded by the features.
    grouped = scored.groupBy(key).agg(
        F.max(F.when(F.col("ord") < 0, F.col(probability))).alias("base"),
        F.filter(F.collect_list(F.struct("ord", "feature", "value", F.col(probability).alias("p"))),
                 lambda s: s["ord"] >= 0).alias("_all"))
    return grouped.select(key, "base", F.inline("_all")).select(
        key, "ord", "feature", "value", "base", (F.col("base") - F.col("p")).alias("delta"))


def direction(delta, width=1e-4):
    delta = F.col(delta) if isinstance(delta, str) else delta
    return F.when(delta > width, "ELEVATES_RISK").when(delta < -width, "ATTENUATES_RISK").otherwise("NEUTRAL")


def top_drivers(deltas: DataFrame, key, k=3, by=(), cutoff_label="the cutoff", source_label="source") -> DataFrame:
    """The ``k`` largest absolute deltas per key as an ordered array; ties keep list order."""
    fact = source_fact("feature", "value", cutoff_label, source_label)
    entry = F.struct((-F.abs("delta")).alias("weight"), "ord", "feature", "value", "delta",
                     direction("delta").alias("direction"), fact.alias("fact"))
    return deltas.groupBy(key, *by, "base").agg(
        F.slice(F.sort_array(F.collect_list(entry)), 1, k).alias("drivers"))


def wide_drivers(df: DataFrame, k=3) -> DataFrame:
    """Ordered driver array to top_1_* .. top_k_* columns, values as text."""
    out = {}
    for i in range(k):
        d = F.get("drivers", F.lit(i))
        out |= {f"top_{i + 1}_feature": d["feature"], f"top_{i + 1}_feature_value": d["value"],
                f"top_{i + 1}_impact": d["delta"], f"top_{i + 1}_direction": d["direction"],
                f"top_{i + 1}_source_fact": d["fact"]}
    return df.withColumns(out).drop("drivers")


def tall_drivers(wide: DataFrame, key, k=3) -> DataFrame:
    """top_1_* .. top_k_* columns back to one row per (key, task, rank)."""
    rows = [F.struct(F.lit(i).alias("rank"), *[
        F.col(f"top_{i}_{c}").alias(n) for c, n in (
            ("feature", "feature"), ("feature_value", "feature_value"), ("impact", "impact"),
            ("direction", "direction"), ("source_fact", "source_fact"))]) for i in range(1, k + 1)]
    return wide.select(key, "task", F.inline(F.array(*rows))).filter(F.col("feature").isNotNull())


def explanation_table(scores: DataFrame, per_task: dict, key="canonical_project_key", k=3,
                      cutoff_label="the cutoff", source_label="source") -> DataFrame:
    """29 columns: one row per (project, task); ineligible rows keep a placeholder.

    ``per_task`` maps a task to its :func:`perturb` output; only the schedule task may
    lack projects.
    """
    lead = [key, "source_project_id", "project_name", "state", "agency"]
    tail = ["attention_score", "attention_tier", "portfolio_rank", "risk_coverage"]
    parts = None
    for task, deltas in per_task.items():
        top = top_drivers(deltas, key, k, (), cutoff_label, source_label)
        joined = scores.select(*lead, *tail).join(top, key, "left")
        seen = F.col("base").isNotNull()
        wide = wide_drivers(joined, k).withColumn(
            "top_1_source_fact", F.when(seen, F.col("top_1_source_fact")).otherwise(F.lit(UNOBSERVED_FACT)))
        drivers = [c for c in wide.columns if c.startswith("top_")]
        part = wide.select(
            *lead, F.lit(task).alias("task"), seen.cast("int").alias("is_eligible_task_target"),
            F.col("base").alias("predicted_risk_probability"), *tail, *drivers,
            F.lit(METHOD).alias("explanation_method"), F.lit(DISCLAIMER).alias("explanation_disclaimer"))
        parts = part if parts is None else parts.unionByName(part)
    return parts


def in_task_order(df: DataFrame, key="canonical_project_key") -> DataFrame:
    return df.orderBy("task", "portfolio_rank", key)


def probability_mismatches(explanations: DataFrame, scores: DataFrame, tolerance=1e-6,
                           key="canonical_project_key") -> DataFrame:
    """One row: explained probabilities that differ from the stored scores."""
    stored = scores.select(key, "cost_risk_probability", "schedule_risk_probability")
    both = explanations.select(key, "task", "predicted_risk_probability").join(stored, key)
    want = F.when(F.col("task") == "cost_overrun", F.col("cost_risk_probability")).otherwise(
        F.col("schedule_risk_probability"))
    got = F.col("predicted_risk_probability")
    off = F.abs(got - want) > tolerance
    return both.agg(F.count("*").alias("rows_checked"),
                    F.count_if(off | (got.isNull() != want.isNull())).alias("mismatches"))
