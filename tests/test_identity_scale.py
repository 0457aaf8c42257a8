"""Identity, global order blocks and their plans."""

import random

import pytest
from pyspark.sql import functions as F

from panelwright.operators import identity as J
from panelwright.operators import scale as Z
from panelwright.operators.links import components

OBS = ("canonical_observation_key string, source_snapshot string, source_table string, source_project_id string, source_row string, "
       "project_name string, state string, agency string, approval_date string, original_cost_crore string")


def _obs(spark, snapshot, rows):
    return spark.createDataFrame([(f"{snapshot}:{i}", snapshot, "T", i, str(n), name, state, agency, appr, cost)
                                  for n, (i, name, state, agency, appr, cost) in enumerate(rows)], OBS)


def _random_rows(rng, n, mark):
    words = [f"w{i}" for i in range(30)]
    rows = []
    for i in range(n):
        title = " ".join(rng.sample(words, rng.choice([2, 7, 8, 9]))) if rng.random() < 0.5 else "hot title of copies alpha"
        rows.append((f"{mark}{i}", title, rng.choice(["Goa", "Bihar", ""]), rng.choice(["NHAI", "PWD (pw)"]),
                     rng.choice(["", "2020-01", "2020-02"]), rng.choice(["100.0", "100.04", "100.05", "100.06", "250"])))
    return rows


def _brute(a, b, tol, sim):
    stop = set(J_STOP)
    tok = lambda s: {w for w in s.lower().split() if w not in stop}
    out = {}
    for (i, t, s, g, d, c) in a:
        found = []
        for (i2, t2, s2, g2, d2, c2) in b:
            if abs(float(c) - float(c2)) > tol or (s and s2 and s != s2) or (g != g2) or (d and d2 and d != d2):
                continue
            x, y = tok(t), tok(t2)
            if x and y and len(x & y) / len(x | y) >= sim:
                found.append(i2)
        if found:
            out[i] = (len(found), found[0] if len(found) == 1 else None)
    return out


from panelwright.functions.text import TITLE_STOPWORDS as J_STOP  # noqa: E402


@pytest.mark.parametrize("seed", [1, 2])
def test_similarity_join_equals_brute_force(spark, seed):
    rng = random.Random(seed)
    a, b = _random_rows(rng, 60, "a"), _random_rows(rng, 60, "b")
    # Near copies: one word more, so that the similarity is close to the limit.
    b += [(f"n{i}", r[1] + " extra", *r[2:]) for i, r in enumerate(a[:30])]
    for tol, sim in ((0.05, 0.85), (50.0, 0.8)):
        got = J.strong_candidates(_obs(spark, "A", a), _obs(spark, "B", b), tol, sim).collect()
        assert {r.a_id: (r.candidates, r.b_id) for r in got} == _brute(a, b, tol, sim)


def test_no_cross_product_in_the_similarity_join(spark):
    rng = random.Random(3)
    df = J.strong_candidates(_obs(spark, "A", _random_rows(rng, 20, "a")), _obs(spark, "B", _random_rows(rng, 20, "b")))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_cascade(spark):
    name = "Kadapa airport terminal building block seven"
    old = [("O1", name, "Goa", "AAI", "", "10.00"), ("O2", "other thing entirely", "Goa", "AAI", "", "99")]
    early = [("5", name, "Goa", "AAI", "", "10.01"), ("6", "bridge north", "Goa", "X", "", "5"), ("7", "only early", "Goa", "X", "", "6")]
    late = [("5", name, "Goa", "AAI", "", "77"), ("6", "bridge north", "Bihar", "X", "", "5"), ("8", name, "Goa", "AAI", "", "10.00")]
    obs = _obs(spark, "2025-06", old).unionByName(_obs(spark, "2025-07", early)).unionByName(_obs(spark, "2026-07", late))
    m = {r.canonical_observation_key: r for r in J.resolve(obs, ("2025-06", "2025-07", "2026-07")).collect()}
    assert m["2025-07:5"].match_confidence == "EXACT_ID" and m["2025-07:5"].canonical_project_key == "PROJ-LINKED-5"
    # The older row follows its link to the latest snapshot.
    assert m["2025-06:O1"].canonical_project_key == "PROJ-LINKED-8" and m["2026-07:8"].match_confidence == "STRONG_MATCH"
    assert m["2025-07:6"].canonical_project_key == "PROJ-REVIEW-2025-07-6" and "State conflict" in m["2025-07:6"].match_evidence
    assert m["2025-07:7"].canonical_project_key == "PROJ-UNMATCHED-2025-07-7" and len(m) == 8
    checks = {r.check: r.violations for r in J.audit_identity(obs, J.resolve(obs, ("2025-06", "2025-07", "2026-07"))).collect()}
    assert set(checks.values()) == {0} and len(checks) == 4
    # O1 is 2025-07:5 and 2026-07:8, and 2025-07:5 is 2026-07:5: one chain, two entities.
    found = J.match_snapshots(obs, ("2025-06", "2025-07", "2026-07"))
    identity = J.assign_entities(obs, found.exact, found.strong_early, found.strong_late, ("2025-06", "2025-07", "2026-07"))
    checks = {r.check: r.violations for r in J.audit_identity(obs, identity, found.accepted_links()).collect()}
    assert checks.pop("broken_transitivity") == 1 and set(checks.values()) == {0}
    one = identity.withColumn("canonical_project_key", F.lit("P"))
    assert J.transitivity_conflicts(one, found.accepted_links()).count() == 0


def test_components_of_chains_hubs_and_nothing(spark):
    rng = random.Random(4)
    pairs = [(f"c{i:04d}", f"c{i + 1:04d}") for i in range(200)] + [("hub", f"x{i:04d}") for i in range(500)]
    pairs += [("self", "self"), (None, "self"), ("hub", "x0001")] + [(f"r{rng.randrange(90):02d}", f"r{rng.randrange(90):02d}") for _ in range(60)]
    rng.shuffle(pairs)
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in pairs:
        if a and b and a != b:
            low, high = sorted((find(a), find(b)))
            root[high] = low
    frame = spark.createDataFrame(pairs, "a string, b string")
    got = {r.node: r.root for r in components(frame).collect()}
    assert got == {x: find(x) for x in root if find(x) != x} and got["x0499"] == "hub" and got["c0200"] == "c0000"
    assert components(frame.limit(0)).count() == 0


def test_title_join_moves_rows_linear_in_words(spark):
    """Rows before the join hold one token each; a title of four times the words has about four times the rows."""
    sizes = {}
    for words in (50, 200):
        titles = spark.range(20).select(
            F.col("id").cast("string").alias("title"), F.lit(True).alias("in_a"), F.lit(True).alias("in_b"),
            F.transform(F.sequence(F.lit(1), F.lit(words)), lambda i: F.concat(F.lit("w"), (i + F.col("id")).cast("string"))).alias("tokens"))
        rows = J._prefixes(titles, 0.85)
        assert not any(t.startswith("array") for _, t in rows.dtypes)
        sizes[words] = rows.count()
    assert sizes[200] <= 4.5 * sizes[50]


def test_token_counts_bound_what_titles_hold(spark):
    rows = [(["a", "b"],), (["a"],), ([],), (None,), (["a", "c", "b"],)]
    df = spark.createDataFrame(rows, "tokens array<string>").repartition(3)
    counts = J.token_counts(df.select(F.transform("tokens", lambda t: F.xxhash64(t)).alias("h")))
    slot = {t: J._slots(spark.range(1).select(F.xxhash64(F.lit(t))).first()[0]) for t in "abc"}
    assert counts.sum() == 6 and [int(counts[slot[t]]) for t in "abc"] == [3, 2, 1]


def test_long_titles_that_share_few_tokens_are_not_compared(spark, monkeypatch):
    """Long titles with some rare tokens in common need too many more; only near copies are compared word by word."""
    common = [f"c{i}" for i in range(1200)]
    title = lambda i: " ".join(common[:800 + i] + [f"x{i % 5}"] + [f"own{i}q{j}" for j in range(300)])
    make = lambda mark, odd: _obs(spark, mark, [(f"{mark}{i}", title(i) + odd, "Goa", "NHAI", "", "100.0") for i in range(30)])
    seen = []
    monkeypatch.setattr(J, "jaccard", lambda a, b, real=J.jaccard: seen.append(1) or real(a, b))
    rows, others = (J.cut_lineage(J._signed(df, False, "original_cost_crore")) for df in (make("A", ""), make("B", " extra")))
    found = J.similar_titles(rows, others)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert found.count() == 30 and found.filter("similarity >= 1").count() == 0 and seen
    # The tokens of a title are never moved one by one, and never collected into lists again.
    assert "collect_list" not in plan and plan.count("explode") == 0


def test_each_pair_is_compared_once_and_equals_brute_force(spark):
    rng = random.Random(3)
    kinds = [[f"k{g}w{i}" for i in range(rng.randrange(6, 60))] for g in range(12)]

    def near(words):
        kept = [w for w in words if rng.random() > 0.06]
        return kept + [f"new{rng.randrange(40)}" for _ in range(rng.randrange(3))] or ["none"]

    make = lambda mark: [(f"{mark}{i}", near(kinds[i % 12])) for i in range(90)]
    left, right = make("A"), make("B")
    frames = [J._signed(_obs(spark, m, [(k, " ".join(w), "Goa", "NHAI", "", "100.0") for k, w in rows]), False, "original_cost_crore") for m, rows in (("A", left), ("B", right))]
    found = J.similar_titles(*[J.cut_lineage(f) for f in frames])
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("array_intersect(") == 1
    keyed = [f.select("id", "title").collect() for f in frames]
    titles = [{r.id: bytes(r.title) for r in rows} for rows in keyed]
    got = {(bytes(r.a_title), bytes(r.b_title)): r.similarity for r in found.collect()}
    share = lambda x, y: len(x & y) / len(x | y)
    want = {(titles[0][a], titles[1][b]): s for a, x in left for b, y in right if (s := share(set(x), set(y))) >= 0.85}
    assert got == want and len(want) > 50


def _values(spark, n=4000, partitions=5):
    return spark.range(n).select(
        F.when(F.col("id") % 3 == 0, 0.5).otherwise(F.pmod(F.xxhash64("id"), F.lit(997)) / 997).alias("v"),
        (F.col("id") % 2).alias("g")).repartition(partitions)


def test_quantiles_equal_exact_percentile(spark):
    df = _values(spark)
    probs = [0.0, 0.1, 0.5, 0.75, 0.9, 1.0]
    want = {r.g: r.q for r in df.groupBy("g").agg(F.percentile("v", F.array(*map(F.lit, probs))).alias("q")).collect()}
    got = {r.g: r.q for r in Z.exact_quantiles(df, "v", probs, ["g"]).collect()}
    assert all(abs(a - b) < 1e-12 for g in want for a, b in zip(want[g], got[g]))
    small = spark.createDataFrame([(1.0,), (2.0,), (4.0,), (10.0,)], "v double")
    assert abs(Z.exact_quantiles(small, "v", [0.9]).first().q[0] - 8.2) < 1e-12


@pytest.mark.parametrize("partitions", [1, 9])
def test_rank_equals_window_rank(spark, partitions):
    from pyspark.sql import Window
    df = _values(spark, partitions=partitions).withColumn("id", F.monotonically_increasing_id())
    want = df.withColumn("w", F.rank().over(Window.partitionBy(F.lit(1)).orderBy(F.col("v").desc())))
    both = Z.competition_rank(df, "v", "r").join(want.select("v", "w").distinct(), "v")
    assert both.filter("r <> w").count() == 0 and both.count() == 4000


def test_rank_has_no_global_sort_of_rows(spark):
    plan = Z.competition_rank(_values(spark), "v", "r")._jdf.queryExecution().executedPlan().toString()
    assert "rank(" not in plan and "Window [row_number" not in plan


def test_hash_order_is_a_permutation(spark):
    df = spark.range(500).select("id", F.lit("s").alias("s"), Z.hash_key("id", 1).alias("_h"))
    rows = Z.hash_order(df, "s").orderBy("_h").collect()
    assert [r._rn for r in rows] == list(range(1, 501))


def _observations(spark, n, cost, title, side):
    i = F.col("id")
    return spark.range(n).select(
        F.concat(F.lit(side), i).alias("source_project_id"), F.concat(F.lit(side), i).alias("canonical_observation_key"),
        i.cast("string").alias("source_row"), F.lit("Goa").alias("state"), F.lit("PWD").alias("agency"), F.lit("").alias("approval_date"),
        cost(i).cast("string").alias("original_cost_crore"), F.lit(title).alias("project_name"))


def test_one_title_in_all_rows_is_linear(spark):
    a = _observations(spark, 100_000, lambda i: i + 1, "big dam on river", "a")
    b = _observations(spark, 100_000, lambda i: i + 1, "big dam on river", "b")
    found = J.strong_candidates(a, b, tol=1.5)
    assert found.filter("candidates <> if(a_row in (0, 99999), 2, 3)").count() == 0 and found.count() == 100_000
    similar = J.review_candidates(a, b, tol=0.25).filter("trigger = 'SIMILAR_TITLE_OTHER_COST'")
    c, n = F.substring("a_key", 2, 9).cast("long") + 1, 100_000
    inside = F.least(F.floor(c * 11 / 10), F.lit(n)) - F.ceil(c * 9 / 10) + 1
    assert similar.filter(F.abs(F.col("partners") - (n - inside)) > 1).count() == 0 and similar.count() == n


def test_counts_within_equal_brute_force(spark):
    rng = random.Random(9)
    costs = lambda n: [rng.choice([0.0, 8.2, 8.25, 10.05, 10.1]) if rng.random() < 0.5 else round(rng.uniform(0, 20), 2) for _ in range(n)]
    left, right = costs(80), costs(90)
    make = lambda side, values: spark.createDataFrame(
        [(f"{side}{i}", f"{side}{i}", str(i), "Goa", "PWD", "", str(c), "canal of the north") for i, c in enumerate(values)],
        "source_project_id string, canonical_observation_key string, source_row string, state string, agency string, "
        "approval_date string, original_cost_crore string, project_name string")
    a, b = make("a", left), make("b", right)
    got = {r.a_key: (r.candidates, r.b_key) for r in J.strong_candidates(a, b, tol=0.05).collect()}
    expected = {}
    for i, x in enumerate(left):
        near = [j for j, y in enumerate(right) if abs(x - y) <= 0.05]
        if near:
            expected[f"a{i}"] = (len(near), f"b{near[0]}" if len(near) == 1 else None)
    assert got == expected
    got = {r.a_key: r.partners for r in J.review_candidates(a, b).filter("trigger = 'SIMILAR_TITLE_OTHER_COST'").collect()}
    assert got == {f"a{i}": n for i, x in enumerate(left) if (n := sum(abs(x - y) > 0.1 * x for y in right))}
    none = a.withColumn("original_cost_crore", F.when(F.col("source_row").cast("int") >= 10, F.col("original_cost_crore")))
    assert J.without_cost(none).first().without_cost == 10
