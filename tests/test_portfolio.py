"""Metrics, scores, explanations, interventions, serving and models."""

import pytest
from pyspark.sql import functions as F

from panelwright.operators import explain as X
from panelwright.operators import learn as M
from panelwright.operators import metrics as E
from panelwright.operators import scoring as S
from panelwright.operators import serving as Q
from panelwright.plans import derived as D
from panelwright.sources import sinks

KEY = "canonical_project_key"


@pytest.fixture(scope="module")
def done(spark, sf_dir):
    return D.risk_portfolio(spark, sf_dir)


def test_metrics_by_hand(spark):
    df = spark.createDataFrame([(1, 0.9), (0, 0.9), (1, 0.5), (0, 0.2), (0, 0.1)], "y int, p double")
    r = E.metrics(df).first()
    assert (r.tp, r.fp, r.tn, r.fn) == (2, 1, 2, 0)
    assert abs(r.roc_auc - (0.5 + 1 + 1 + 0 + 1 + 1) / 6) < 1e-12
    assert abs(r.pr_auc - (1 / 2 * 1 / 2 + 1 / 2 * 2 / 3)) < 1e-12
    assert E.confusion(df, inclusive=False).first().fn == 1
    bins = {x.bin: x.n for x in E.calibration_curve(df).collect()}
    assert bins == {0: 2, 2: 1, 4: 2}
    assert {x.bin for x in E.histogram(spark.createDataFrame([(1.0,), (0.0,)], "p double")).collect()} == {0, 9}


def test_one_class_gives_no_auc(spark):
    r = E.metrics(spark.createDataFrame([(1, 0.9), (1, 0.2)], "y int, p double")).first()
    assert r.roc_auc is None and r.precision == 1.0 and r.specificity == 0.0


def test_scores(spark):
    rows = [("a", 0.9, 0.5), ("b", 0.9, None), ("c", 0.1, 0.2), ("d", 0.1, None)]
    df = spark.createDataFrame(rows, f"{KEY} string, cost_risk_probability double, schedule_risk_probability double")
    out = {r[KEY]: r for r in S.score_portfolio(df).collect()}
    assert out["a"].compound_exposure == 0.5 and out["b"].compound_exposure is None
    assert out["b"].risk_coverage == "PARTIAL" and out["b"].attention_score == 0.9
    assert [out[k].portfolio_rank for k in "abcd"] == [1, 1, 3, 4]
    assert out["a"].attention_tier == "Tier 1" and out["d"].attention_tier == "Tier 4"
    checks = {r.check: r.violations for r in S.audit_scores(S.score_portfolio(df)).collect()}
    assert set(checks.values()) == {0}


def test_explanations(done):
    t = done.explanations
    assert len(t.columns) == 29
    assert t.count() == 2 * done.scores.count() and t.select(KEY, "task").distinct().count() == t.count()
    assert t.filter("is_eligible_task_target = 0 and top_1_feature is not null").count() == 0
    assert t.filter("abs(top_1_impact) < abs(top_2_impact)").count() == 0
    assert X.probability_mismatches(t, done.scores).first().mismatches == 0


def test_interventions(done):
    assert len(done.interventions.columns) == 16
    assert done.interventions.filter("primary_action is null or priority_reason is null or evidence_feature is null").count() == 0


def test_serving(done, spark, tmp_path):
    df = Q.summaries(done.scores, done.interventions)
    first = Q.catalogue(df, page=1, page_size=30).collect()
    second = Q.catalogue(df, page=2, page_size=30).collect()
    last = first[-1]
    keyset = Q.catalogue(df, page_size=30, after=(last.portfolio_rank, last[KEY])).collect()
    assert [r[KEY] for r in second] == [r[KEY] for r in keyset]
    assert first[0].total_records == df.count()
    assert Q.profile(done.scores, done.features, done.interventions, "nope").count() == 0
    r = Q.portfolio_summary(done.scores, done.interventions).first()
    assert r.total_projects == df.count() == sum(r.tier_distribution.values())
    d = Q.drivers(done.explanations).filter("schedule_drivers.is_eligible = 0").first()
    assert d.schedule_drivers.top_drivers == []
    with pytest.raises(ValueError):
        Q.catalogue(df, sort_by="1; drop")
    sinks.seed_tables(done.tables(), str(tmp_path), "v1")
    assert sinks.open_tables(spark, str(tmp_path), ["interventions"])["interventions"].count() == df.count()


def test_models(spark, sf_dir):
    df = D.cohort(spark, sf_dir).withColumn("y", F.col("cost_overrun")).cache()
    model = M.fit_logistic(df, "y")
    scored = model.score(df, "p").cache()
    assert scored.filter("p is null or p < 0 or p > 1").count() == 0
    # At the optimum of the mean loss plus |w|^2 / (2 C n), the intercept gradient vanishes.
    assert abs(scored.agg(F.avg(F.col("p") - F.col("y"))).first()[0]) < 1e-3
    unseen = df.limit(3).withColumn("feat_agency", F.lit("never seen"))
    assert model.score(unseen, "p").filter("p is null").count() == 0
    assert M.coefficients(model, spark).count() == len(model.names) + 1 == len(model.weights) + 1
    platt, iso = M.fit_platt(scored, "y", "p"), M.fit_isotonic(scored, "y", "p")
    both = iso.apply(platt.apply(scored, "p", "s"), "p", "i").select("p", "s", "i").orderBy("p").collect()
    assert all(a.i <= b.i + 1e-12 for a, b in zip(both, both[1:]))
    assert all((a.s <= b.s + 1e-12) == (platt.beta >= 0) or a.p == b.p for a, b in zip(both, both[1:]))


def test_forest_repeats(spark, sf_dir):
    df = D.cohort(spark, sf_dir).withColumn("y", F.col("cost_overrun"))
    fit = lambda d: M.fit_forest(M.in_fit_order(d, KEY, 4), "y", trees=5, depth=4)
    a, b = (fit(d).score(df, "p").select(KEY, "p") for d in (df, df.repartition(7)))
    assert a.exceptAll(b).count() == 0
    table = M.importances(fit(df), spark)
    assert abs(M.parent_importance(table).agg(F.sum("importance")).first()[0] - 1) < 1e-9
    assert M.cumulative_importance(table).agg(F.max("cumulative_share")).first()[0] <= 1 + 1e-9
