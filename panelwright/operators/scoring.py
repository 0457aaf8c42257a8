"""Portfolio scores: coverage, attention, exposure, tiers, rank and their reports."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwright.operators.scale import beside, competition_rank, exact_quantiles

TIER_PROBS = (0.50, 0.75, 0.90)



def provenance(cost_model: str, schedule_model: str, variant="Raw / Uncalibrated", version="1.0.0") -> dict:
    """Columns written beside every score; the model names are those of the models used."""
    return {"cost_model_name": cost_model, "schedule_model_name": schedule_model, "cost_probability_variant": variant,
            "schedule_probability_variant": variant, "scoring_method_version": version}


def forest_name(trees: int, seed: int) -> str:
    return f"RandomForestClassifier(n_estimators={trees}, random_state={seed})"


def combine(df: DataFrame, pc="cost_risk_probability", ps="schedule_risk_probability") -> DataFrame:
    """Coverage, attention score and compound exposure from the two probabilities."""
    cost, schedule = F.col(pc), F.col(ps)
    return df.withColumns({
        "risk_coverage": F.when(schedule.isNull(), "PARTIAL").otherwise("FULL"),
        "attention_score": F.greatest(cost, schedule),
        "compound_exposure": F.when(schedule.isNotNull(), F.least(cost, schedule)),
    })


def add_tiers(df: DataFrame, score="attention_score", out="attention_tier") -> DataFrame:
    """Tier from the exact portfolio quantiles .50/.75/.90, lower bounds inclusive."""
    cuts = exact_quantiles(df, score, TIER_PROBS).withColumnRenamed("q", "_q")
    s, q = F.col(score), F.col("_q")
    tier = (F.when(s >= q[2], "Tier 1").when(s >= q[1], "Tier 2").when(s >= q[0], "Tier 3").otherwise("Tier 4"))
    return beside(df, cuts).withColumn(out, tier).drop("_q")


def score_portfolio(df: DataFrame, pc="cost_risk_probability", ps="schedule_risk_probability",
                    made_by=None) -> DataFrame:
    """All score columns of a portfolio with the two probabilities attached.

    ``made_by`` is the provenance of the probabilities; without it the names are unknown.
    """
    scored = competition_rank(add_tiers(combine(df, pc, ps)), "attention_score", "portfolio_rank")
    return scored.withColumns({k: F.lit(v) for k, v in (made_by or provenance("unknown", "unknown")).items()})


def in_rank_order(df: DataFrame, key="canonical_project_key") -> DataFrame:
    """Presentation order: score descending, then key."""
    return df.orderBy(F.col("attention_score").desc(), F.col(key))


def distribution(df: DataFrame, columns) -> DataFrame:
    """Minimum, deciles, maximum, mean and sample deviation of each column."""
    tall = df.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in columns])))
    probs = [i / 10 for i in range(1, 10)]
    deciles = exact_quantiles(tall, "value", probs, by=["metric"])
    moments = tall.groupBy("metric").agg(
        F.count("value").alias("n"), F.min("value").alias("min"), F.max("value").alias("max"),
        F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"))
    return moments.join(deciles, "metric", "left").select(
        "metric", "n", "min", *[F.col("q")[i - 1].alias(f"q{i}0") for i in range(1, 10)], "max", "mean", "std")


def tier_by_coverage(df: DataFrame) -> DataFrame:
    """Cross-tab of tier and coverage with a total row."""
    table = (
        df.rollup("attention_tier")
        .agg(F.count_if(F.col("risk_coverage") == "FULL").alias("full_coverage"),
             F.count_if(F.col("risk_coverage") == "PARTIAL").alias("partial_coverage"),
             F.count("*").alias("total"))
    )
    return table.withColumn("attention_tier", F.coalesce("attention_tier", F.lit("TOTAL")))


def co_elevation(df: DataFrame, thresholds=TIER_PROBS, pc="cost_risk_probability",
                 ps="schedule_risk_probability") -> DataFrame:
    """Rows with both probabilities at or above each threshold, from one aggregate."""
    counts = [
        F.struct(F.lit(float(t)).alias("threshold"),
                 F.count_if((F.col(pc) >= t) & (F.col(ps) >= t)).alias("projects"))
        for t in thresholds]
    return df.agg(F.array(*counts).alias("a")).select(F.inline("a"))


def top_exposure(df: DataFrame, k=10, key="canonical_project_key") -> DataFrame:
    """The ``k`` largest compound exposures; a top-k heap per task, no full sort."""
    return (df.filter(F.col("compound_exposure").isNotNull())
            .orderBy(F.col("compound_exposure").desc(), F.col(key)).limit(k))


def audit_scores(df: DataFrame, pc="cost_risk_probability", ps="schedule_risk_probability",
                 key="canonical_project_key") -> DataFrame:
    """Rule violations in a score table: formulas, coverage pattern, ties, rank order."""
    cost, schedule, score = F.col(pc), F.col(ps), F.col("attention_score")
    partial = F.col("risk_coverage") == "PARTIAL"
    outside = lambda c: (F.col(c) < 0) | (F.col(c) > 1)
    ties = df.groupBy("attention_score").agg(
        F.min("portfolio_rank").alias("lo"), F.max("portfolio_rank").alias("hi"), F.count("*").alias("n"))
    formulas = {
        "attention_formula": score != F.greatest(cost, schedule),
        "compound_formula": F.col("compound_exposure") != F.least(cost, schedule),
        "partial_pattern": partial != (schedule.isNull() & F.col("compound_exposure").isNull()),
        "probability_range": outside(pc) | outside(ps),
    }
    rows = df.agg(*[F.count_if(c).alias(k) for k, c in formulas.items()])
    recount = competition_rank(df.select("attention_score", key, "portfolio_rank"), "attention_score", "_r")
    ranks = recount.agg(F.count_if(F.col("_r") != F.col("portfolio_rank")).alias("rank_order"))
    tied = ties.agg(F.count_if(F.col("lo") != F.col("hi")).alias("tie_consistency"))
    one = beside(rows, tied, ranks)
    names = [*formulas, "tie_consistency", "rank_order"]
    return one.select(F.inline(F.array(*[
        F.struct(F.lit(n).alias("check"), F.col(n).alias("violations")) for n in names])))
