"""Forests of deep trees: large nodes by aggregates, smaller ones by groups."""

import numpy as np
from pyspark.sql import functions as F

from panelwright.operators import forests as R
from panelwright.operators import learn as M


def _rows(spark, n=600):
    rng = np.random.default_rng(1)
    a, b, c = rng.random(n), rng.integers(0, 9, n), rng.integers(0, 3, n)
    y = ((a > 0.5) ^ (b > 4)) | (c == 2)
    rows = [(i, float(x), None if i % 50 == 0 else float(z), None if i % 40 == 0 else f"L{v}", None if i % 90 == 0 else int(t))
            for i, (x, z, v, t) in enumerate(zip(a, b, c, y))]
    return spark.createDataFrame(rows, "k long, a double, b double, c string, y int")


def _fit(df, trees=12, depth=30):
    return M.fit_forest(M.in_fit_order(df, "k", 3), "y", ["a", "b"], ["c"], trees, depth)


def test_subtree_tells_all_rows_apart():
    rng = np.random.default_rng(2)
    codes = np.array([[i, j, 0] for i in range(20) for j in range(5)])
    y = (codes[:, 0] % 2).astype(float)
    nodes, gains = R._grown(codes, y, np.ones(100), 0, 30, 3, rng)
    found = R._leaf_shares(codes, [(1, 1, False, *R._packed(*nodes))], 1, 0)
    assert (found == y * R._ONE).all() and gains[2] == 0 and gains.sum() > 0
    stump, _ = R._grown(codes, y, np.ones(100), 29, 30, 3, rng)
    assert len(stump[0]) == 3


def test_deep_forest_fits_scores_and_repeats(spark):
    df = _rows(spark)
    model = _fit(df)
    got = {r.k: r.p for r in model.score(df, "p").collect()}
    assert len(got) == 600 and all(0 <= p <= 1 for p in got.values())
    known = df.filter("y is not null").collect()
    assert np.mean([(got[r.k] >= 0.5) == r.y for r in known]) > 0.9
    assert got == {r.k: r.p for r in _fit(df.repartition(5)).score(df.repartition(2), "p").collect()}
    values = model.importances()
    assert abs(sum(values) - 1) < 1e-9 and len(values) == len(model.names) == 5
    odd = df.limit(4).withColumn("c", F.lit("never seen")).unionByName(df.limit(4))
    assert model.score(odd, "p").filter("p is not null").count() == 8
    assert model.score(df.limit(0), "p").count() == 0


def test_large_nodes_are_split_before_groups(spark, monkeypatch):
    df = _rows(spark)
    whole = _fit(df)
    assert whole.forest.pieces.filter("top").count() == 0
    monkeypatch.setattr(R, "NODE_ROWS", 120)
    monkeypatch.setattr(R, "PIECE_BYTES", 4000)
    parts = _fit(df)
    pieces = parts.forest.pieces
    assert pieces.filter("top").count() >= 12 and pieces.select("tree", "node").distinct().count() == pieces.count()
    scored = parts.score(df, "p").filter("y is not null")
    assert scored.count() == 593 and scored.agg(F.avg(((F.col("p") >= 0.5).cast("int") == F.col("y")).cast("int"))).first()[0] > 0.9
    values = parts.importances()
    assert abs(sum(values) - 1) < 1e-9 and min(values) >= 0


def test_tiny_tables(spark):
    one = spark.createDataFrame([(1, 1.0, 2.0, "x", 1)], "k long, a double, b double, c string, y int")
    assert _fit(one, 7).score(one, "p").first().p == 1.0


def test_bins_are_looked_up_in_columns(spark):
    nan = float("nan")
    values = [None, -1.0, 0.0, 0.5, 1.0, 2.5, nan]
    df = spark.createDataFrame([(i, v, c) for i, (v, c) in enumerate(zip(values, ["x", "y", None, "z", "never", "x", ""]))], "i long, a double, c string")
    cuts, levels = {"a": [0.0, 1.0, 2.5], "b": []}, {"c": ["x", "y", "z"]}
    codes = M._codes({"a": 0.75, "b": 0.0, "c": "y"}, cuts, levels)
    got = [r.codes for r in df.withColumn("b", F.lit(None).cast("double")).select("i", codes.alias("codes")).orderBy("i").collect()]
    below = [1, 0, 0, 1, 1, 2, 3]
    named = [[1, 0, 0], [0, 1, 0], [0, 1, 0], [0, 0, 1], [0, 0, 0], [1, 0, 0], [0, 0, 0]]
    assert got == [[a, 0, *n] for a, n in zip(below, named)]
    plan = df.withColumn("b", F.lit(0.0)).select(codes.alias("codes"))._jdf.queryExecution().optimizedPlan().toString()
    assert " > 2.5" not in plan


def test_leaves_of_many_rows_agree_with_a_plain_walk():
    rng = np.random.default_rng(4)
    codes = rng.integers(0, 33, (500, 4))
    y = ((codes[:, 0] + codes[:, 1]) % 3 == 0).astype(float)
    (feature, code, child, share), _ = R._grown(codes, y, np.ones(500), 0, 30, 2, rng)
    asked = rng.integers(0, 33, (300, 4))

    def plain(row):
        at = 0
        while feature[at] >= 0:
            at = child[at] + (row[feature[at]] > code[at])
        return at

    got = R._leaves(asked.astype(np.int8).ravel(), np.arange(300) * 4, *(np.asarray(x, k) for x, k in ((feature, "<i2"), (code, "<i2"), (child, "<i4"))))
    assert got.tolist() == [plain(r) for r in asked]


def _pieces(model):
    return sorted((r.tree, r.node, r.top, *[x.tolist() for x in R._unpacked(r.nodes)], r.gains) for r in model.forest.pieces.collect())


def test_tables_taken_whole_and_dealt_row_by_row_give_the_same_trees(spark, monkeypatch):
    df = _rows(spark)
    for rows in (100_000, 120):  # with and without large nodes
        monkeypatch.setattr(R, "NODE_ROWS", rows)
        monkeypatch.setattr(R, "TASK_ROWS", 1 << 22)
        whole = _pieces(_fit(df))
        monkeypatch.setattr(R, "TASK_ROWS", 1)
        assert whole == _pieces(_fit(df)) and len(whole) >= 12


def test_growing_a_whole_table_moves_no_row_for_a_tree(spark):
    coded = spark.range(500).select(F.col("id").alias("row"), (F.col("id") % 2).alias("y"), F.array((F.col("id") % 30).cast("tinyint"), F.lit(1).cast("tinyint")).alias("codes"))
    grown = R._whole_trees(coded, 2, 40, 30, 2, 42)
    assert "explode(sequence(1, 40" not in grown._jdf.queryExecution().optimizedPlan().toString()
    assert grown.select("tree").distinct().count() == 40


def test_pieces_take_a_few_bytes_a_node():
    rng = np.random.default_rng(5)
    codes = rng.integers(0, 33, (4000, 6))
    nodes, _ = R._grown(codes, rng.integers(0, 2, 4000).astype(float), np.ones(4000), 0, 30, 3, rng)
    (data,) = R._packed(*nodes)
    feature, code, child, share = R._unpacked(data)
    split = nodes[0] >= 0
    assert (feature == nodes[0]).all() and (code[split] == nodes[1][split]).all() and (child == nodes[2]).all()
    assert (share[~split] == np.rint(nodes[3][~split] * R._ONE)).all() and len(data) < 3 * len(split)


def test_perturbed_rows_carry_one_text(spark):
    from panelwright.operators import explain as X

    df = spark.createDataFrame([("k", 1.0, "x"), ("l", None, "y")], "key string, a double, c string")
    seen = []

    def scorer(rows):
        seen.extend(rows.columns)
        return rows.withColumn("probability", F.coalesce("a", F.lit(0.5)))

    got = X.perturb(df, spark.createDataFrame([(3.0, "x")], "a double, c string"), scorer, "key", ["a"], ["c"])
    assert {(r.key, r.feature, r.value, r.base, r.delta) for r in got.collect()} == {
        ("k", "a", "1.0", 1.0, -2.0), ("k", "c", "x", 1.0, 0.0), ("l", "a", None, 0.5, -2.5), ("l", "c", "y", 0.5, 0.0)}
    assert "value" in seen and not any(c.startswith("_text") for c in seen)
