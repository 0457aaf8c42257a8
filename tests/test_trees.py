"""Trees grown from sums of bins against a plain recursive version."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from panelwright.errors import ContractError
from panelwright.operators import trees as G

SCHEMA = "k int, a double, b double, c string, y int"


def rows_of(seed, n=160):
    rng = random.Random(seed)
    rows = []
    for k in range(n):
        a, b, c = rng.choice([None, rng.randint(0, 9) / 2, 3.0]), rng.random(), rng.choice(["x", "y", "z", None])
        rows.append((k, a, b, c, None if k % 31 == 0 else int((a or 0) + (c == "y") * 3 + b > 3.5)))
    return rows


def plain(rows, forest, depth):
    """{node: (feature, code, n, pos) or (n, pos)} by trying every split of every node."""
    codes = {}
    for k, a, b, c, y in rows:
        own = [-1 if v is None else sum(v > x for x in forest.cuts[f]) for f, v in (("a", a), ("b", b))]
        codes[k] = [*own, forest.levels["c"].index(c) + 1 if c in forest.levels["c"] else 0]
    out = {}

    def imp(some):
        pos = sum(r[4] for r in some)
        return pos * (len(some) - pos) / len(some)

    def go(node, some, left):
        best = None
        if left:
            for place, name in enumerate(["a", "b", "c"]):
                for code in sorted({codes[r[0]][place] for r in some}):
                    if place == 2 and code == 0:
                        continue
                    holds = [r for r in some if (codes[r[0]][place] <= code if place < 2 else codes[r[0]][place] == code)]
                    rest = [r for r in some if r not in holds]
                    if holds and rest:
                        gain = imp(some) - imp(holds) - imp(rest)
                        if gain > 1e-9 and (best is None or gain > best[0] + 1e-12):
                            best = gain, name, code, holds, rest
        n, pos = len(some), sum(r[4] for r in some)
        if best is None:
            out[node] = n, pos
            return
        out[node] = best[1], best[2], n, pos
        go(2 * node, best[3], left - 1)
        go(2 * node + 1, best[4], left - 1)

    go(1, [r for r in rows if r[4] is not None], depth)
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_one_tree_equals_the_recursive_one(spark, seed):
    rows = rows_of(seed)
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    forest = G.grow(df, "y", "k", ["a", "b"], ["c"], depth=3)
    expected = plain(rows, forest, 3)
    got = {r.node: (r.feature, r.code, r.n, r.pos) for r in forest.splits.collect()} | {r.node: (r.n, r.pos) for r in forest.leaves.collect()}
    assert got == expected
    scores = {r.k: r.p for r in forest.score(df, "k", "p").collect()}
    assert len(scores) == len(rows) and all(0 <= p <= 1 for p in scores.values())
    assert abs(forest.importances().agg(F.sum("importance")).first()[0] - 1) < 1e-12


def test_cuts_split_rows_evenly_and_levels_are_bounded(spark, monkeypatch):
    df = spark.range(1000).select((F.col("id") % 250).cast("double").alias("v"), F.lit(5.0).alias("same"), F.lit(None).cast("double").alias("none"),
                                  F.col("id").cast("string").alias("s"), F.lit(1).alias("y"), "id")
    cuts = G.bin_cuts(df, ["v", "same", "none"])
    assert len(cuts["v"]) == G.BINS and cuts["same"] == [5.0] and cuts["none"] == []
    monkeypatch.setattr(G, "MOST_LEVELS", 5)
    with pytest.raises(ContractError):
        G.grow(df, "y", "id", ["v"], ["s"])
    with pytest.raises(ContractError):
        G.grow(df, "y", "id", ["v"], depth=99)
    pure = G.grow(df, "y", "id", ["v", "none"], depth=2)
    assert pure.splits.count() == 0 and pure.leaves.count() == 1
    assert pure.score(df, "id", "p").filter("p <> 1").count() == 0 and pure.importances().filter("importance <> 0").count() == 0


def test_draws_repeat_and_follow_the_poisson_distribution(spark):
    drawn = spark.range(20_000).select(G.bootstrap_count("id", F.lit(1), 42).alias("w"))
    counts = Counter(r.w for r in drawn.collect())
    assert abs(counts[0] / 20_000 - 0.368) < 0.015 and abs(counts[1] / 20_000 - 0.368) < 0.015 and max(counts) <= 7
    df = spark.createDataFrame(rows_of(3), SCHEMA)
    one, two = (G.grow(d, "y", "k", ["a", "b"], ["c"], trees=3, depth=2, per_split=2, bootstrap=True) for d in (df, df.repartition(7)))
    assert one.splits.exceptAll(two.splits).count() == 0 and one.leaves.exceptAll(two.leaves).count() == 0
    assert {r.tree for r in one.leaves.collect()} == {1, 2, 3}
