"""Fits by distributed sums and pooled ranges against plain versions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelwright.errors import ContractError
from panelwright.operators import learn as M
from panelwright.operators.isotonic import _pool, isotonic_blocks, knots
from panelwright.operators.newton import MOST_FEATURES, newton_logistic


def plain_pool(points):
    stack = []
    for p, s, w in sorted(points):
        lo = hi = p
        while stack and stack[-1][2] / stack[-1][3] >= s / w:
            b = stack.pop()
            lo, s, w = b[0], s + b[2], w + b[3]
        stack.append((lo, hi, s, w))
    return stack


@pytest.mark.parametrize("shape", ["noise", "rising", "falling", "one"])
def test_pooled_ranges_equal_one_pass(spark, shape):
    rng = np.random.default_rng(3)
    n = 1 if shape == "one" else 400
    p, w = rng.permutation(n) / n, rng.integers(1, 5, n).astype(float)
    s = {"noise": rng.integers(0, 2, n) * w, "rising": w * p ** 2, "falling": w * (1 - p), "one": w}[shape]
    points = spark.createDataFrame([(float(a), float(b), float(c)) for a, b, c in zip(p, s, w)], "p double, s double, w double")
    expected = plain_pool(zip(p.tolist(), s.tolist(), w.tolist()))
    found = sorted(tuple(r) for r in isotonic_blocks(points).collect())
    assert [x[:2] for x in found] == [x[:2] for x in expected] and np.allclose([x[2:] for x in found], [x[2:] for x in expected])
    # Many ranges first, then one, whatever the cuts.
    for ranges in (2, 7, 31):
        blocks = points.select(F.col("p").alias("lo"), F.col("p").alias("hi"), "s", "w")
        again = sorted(tuple(r) for r in _pool(_pool(blocks, ranges), 1).collect())
        assert [x[:2] for x in again] == [x[:2] for x in expected]
    xs, ys = knots(isotonic_blocks(points))
    assert (np.diff(ys) >= 0).all() and (np.diff(xs) >= 0).all()


def test_isotonic_map_has_linear_parts_and_keeps_nulls(spark):
    df = spark.createDataFrame([(0.2, 0), (0.2, 1), (0.4, 0), (0.8, 1), (None, 1), (0.9, None)], "p double, y int")
    fitted = M.fit_isotonic(df, "y", "p")
    asked = spark.createDataFrame([(0.0,), (0.3,), (0.6,), (1.0,), (None,)], "p double")
    got = [r.i for r in fitted.apply(asked, "p", "i").collect()]
    assert got[-1] is None and np.allclose(got[:-1], [1 / 3, 1 / 3, 2 / 3, 1.0])
    with pytest.raises(ContractError):
        M.fit_isotonic(df.filter("p > 2"), "y", "p")


def test_newton_reaches_a_zero_gradient_on_uneven_features(spark):
    rng = np.random.default_rng(5)
    x = np.column_stack([np.ones(300), rng.normal(0, 1e4, 300), rng.normal(0, 1e-3, 300), np.zeros(300)])
    y = (x[:, 1] / 1e4 + rng.normal(0, 1, 300) > 0.3).astype(float)
    w = rng.integers(1, 4, 300).astype(float)
    rows = spark.createDataFrame([(a.tolist(), float(b), float(c)) for a, b, c in zip(x, y, w)], "x array<double>, y double, w double").repartition(5)
    for ridge in ([0, 1, 1, 1], [0, 0, 0, 0]):
        found = newton_logistic(rows, ridge)
        p = 1 / (1 + np.exp(-x @ found))
        gradient = x.T @ (w * (y - p)) - np.array(ridge) * found
        assert np.abs(gradient / np.maximum(1, np.abs(x).max(axis=0))).max() < 1e-7 and found[3] == 0
    with pytest.raises(ContractError):
        newton_logistic(rows, [1.0] * (MOST_FEATURES + 1))


def test_separable_rows_unseen_values_and_many_levels(spark, monkeypatch):
    df = spark.createDataFrame([(float(i), f"level {i % 10}", int(i > 25)) for i in range(50)], "v double, c string, y int")
    narrow = M.fit_logistic(df, "y", ["v"], [])
    top = narrow.score(df, "p").agg(F.min(F.when(F.col("y") == 1, F.col("p"))).alias("a"), F.max(F.when(F.col("y") == 0, F.col("p"))).alias("b")).first()
    assert top.a > 0.5 > top.b
    few = M.fit_logistic(df, "y", [], ["c"])
    null = df.limit(2).withColumn("c", F.lit(None).cast("string"))
    assert few.score(null, "p").filter("p is null").count() == 0 and len(few.names) == 10
    monkeypatch.setattr(M, "MOST_FEATURES", 9)
    wide = M.fit_logistic(df, "y", [], ["c"])
    assert isinstance(wide, M.FittedModel) and wide.names == few.names
    assert np.allclose(wide.weights, few.weights, atol=1e-3) and abs(wide.intercept - few.intercept) < 1e-3
