"""Digests by key range, upserts of touched ranges, and features on a stream."""

import pytest
from pyspark.sql import functions as F

from panelwright.errors import ContractError
from panelwright.operators import digests as G
from panelwright.operators import panel as P
from panelwright.operators.snapshots import fingerprint
from panelwright.sources import ranges
from panelwright.streaming import velocities as S


def _table(spark, n=300):
    return spark.range(n).select(F.col("id").alias("k"), (F.col("id") % 7).alias("v"), F.when(F.col("id") % 3 > 0, F.lit("t")).alias("t"))


def test_digests_roll_up_to_the_fingerprint(spark):
    df = _table(spark).unionByName(spark.sql("SELECT CAST(NULL AS BIGINT) AS k, 1L AS v, 'x' AS t"))
    own = G.range_digests(df, ["k"])
    assert G.fingerprint_of(own).first() == fingerprint(df).first()
    assert G.coarser(own, 1).count() <= 16
    assert G.coarser(own, 0).first().row_count == 301
    halves = [G.range_digests(df.filter(c), ["k"]) for c in ("k % 2 = 0", "k % 2 = 1 OR k IS NULL")]
    assert G.changed_ranges(G.merged(*halves), own).isEmpty()
    assert G.fingerprint_of(G.range_digests(df.limit(0), ["k"])).first() == fingerprint(df.limit(0)).first()
    with pytest.raises(ValueError):
        G.range_digests(df, ["k"], ["v"])


def test_digests_after_a_change_and_changed_keys(spark):
    old = _table(spark)
    removed, added = old.filter("k IN (5, 9)"), spark.sql("SELECT 5L AS k, 99L AS v, 't' AS t UNION ALL SELECT 1000L, 1L, NULL UNION ALL SELECT 1000L, 1L, NULL")
    new = old.filter("k NOT IN (5, 9)").unionByName(added)
    of = lambda df: G.range_digests(df, ["k"])
    assert G.changed_ranges(G.after_change(of(old), of(removed), of(added)), of(new)).isEmpty()
    differing = G.changed_ranges(of(old), of(new))
    assert 1 <= differing.count() <= 3
    found = {(r.k, r.change) for r in G.changed_keys(old, new, ["k"], differing).collect()}
    assert found == {(5, "changed"), (9, "removed"), (1000, "added")}
    # A repeated row counts: one of two equal rows that goes is a change.
    twice = old.unionByName(old.filter("k = 4"))
    differing = G.changed_ranges(of(old), of(twice))
    assert [(r.k, r.change) for r in G.changed_keys(old, twice, ["k"], differing).collect()] == [(4, "changed")]


def test_values_that_swap_keys_are_seen(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string")
    new = spark.createDataFrame([(1, "b"), (2, "a")], "k long, v string")
    of = lambda df: G.range_digests(df, ["k"])
    assert {r.node for r in G.changed_ranges(of(old), of(new)).collect()} == {r.node for r in of(old).collect()}


def test_upsert_keeps_untouched_files(spark, tmp_path):
    path = str(tmp_path / "t")
    ranges.create(_table(spark), path, ["k"], digits=1, files=2)
    first = {r.node: r.folder for r in ranges.manifest(spark, path).collect()}
    updates = spark.createDataFrame([(3, 100, "new"), (5000, 1, None)], "k long, v long, t string").withColumn("extra", F.lit(1))
    earlier = ranges.read(spark, path)
    touched = ranges.upsert(updates, path, keep_filled=["t"])
    second = {r.node: r.folder for r in ranges.manifest(spark, path).collect()}
    assert len(touched) == 2 and all(first[n] == f for n, f in second.items() if n not in touched)
    assert all(first.get(n) != second[n] for n in touched)
    rows = {r.k: (r.v, r.t) for r in ranges.read(spark, path).collect()}
    assert len(rows) == 301 and rows[3] == (100, "new") and rows[5000] == (1, None) and rows[4] == (4, "t")
    # Digests in the manifest stand for the table; readers of the version before still see it.
    assert G.fingerprint_of(ranges.manifest(spark, path)).first() == fingerprint(ranges.read(spark, path)).first()
    assert earlier.count() == 300 and earlier.filter("k = 3").first().v == 3
    ranges.upsert(spark.createDataFrame([(4, 0, "other")], "k long, v long, t string"), path, keep_filled=["t"])
    assert tuple(ranges.read(spark, path).filter("k = 4").first()) == (4, 0, "t")


def test_upsert_of_nothing_and_bad_keys(spark, tmp_path):
    path = str(tmp_path / "t")
    ranges.create(_table(spark).limit(0), path, ["k"], digits=1)
    assert ranges.read(spark, path).count() == 0 and ranges.read(spark, path).columns == ["k", "v", "t"]
    assert ranges.upsert(_table(spark).limit(0), path) == []
    assert ranges.upsert(_table(spark, 2), path) != [] and ranges.read(spark, path).count() == 2
    for bad in (_table(spark, 1).unionByName(_table(spark, 1)), _table(spark, 1).withColumn("k", F.lit(None).cast("long"))):
        with pytest.raises(ContractError):
            ranges.upsert(bad, path)
    assert ranges.read(spark, path).count() == 2


_PANEL = "project_code string, reporting_period string, original_cost_cr double, expenditure_cr double"


def _features(rows):
    return {(r.project_code, r.reporting_period): (r.recent_expenditure_change, r.is_first_observation, r.expenditure_to_original_cost) for r in rows}


def _arrive(spark, path, parts):
    for part in parts:
        spark.createDataFrame(part, _PANEL).coalesce(1).write.mode("append").parquet(f"{path}/in")
        source = spark.readStream.schema(_PANEL).parquet(f"{path}/in")
        S.append_features(source, f"{path}/out", f"{path}/checkpoint")
    return spark.read.parquet(f"{path}/out")


_END = [("end", "2100-01", 1.0, 1.0)]


def test_stream_equals_batch_after_restarts(spark, tmp_path):
    rows = [(f"p{p}", f"{2020 + m // 12}-{m % 12 + 1:02d}", 100.0 + p, float(m * p)) for p in range(6) for m in range(14) if (p * m) % 5 != 3]
    parts = [[r for r in rows if r[1] < "2020-07"], [r for r in rows if r[1] >= "2020-07"], _END]
    found = _arrive(spark, tmp_path, parts).filter("project_code <> 'end'").collect()
    assert len(found) == len(rows)
    assert _features(found) == _features(P.panel_features(spark.createDataFrame(rows, _PANEL)).collect())


def test_stream_late_out_of_order_and_repeated_months(spark, tmp_path):
    parts = [
        [("a", "2020-02", 10.0, 5.0), ("b", "2020-02", 10.0, 1.0)],
        [("a", "2020-01", 10.0, 2.0), ("a", "2020-02", 10.0, 99.0)],            # out of order in time; repeated
        [("c", "2020-06", 10.0, 1.0), (None, "2020-06", 1.0, 1.0), ("d", "soon", 1.0, 1.0)],
        [("b", "2020-01", 10.0, 7.0), ("b", "2020-06", 10.0, 7.0)],             # the first is too late
        _END]
    found = _features(_arrive(spark, tmp_path, parts).filter("project_code <> 'end'").collect())
    assert found == {
        ("a", "2020-01"): (None, 1, 0.2), ("a", "2020-02"): (3.0, 0, 0.5), ("b", "2020-02"): (None, 1, 0.1),
        ("c", "2020-06"): (None, 1, 0.1), ("b", "2020-06"): (None, 1, 0.7)}
    bad = S.unreadable_rows(spark.createDataFrame(parts[2], _PANEL)).collect()
    assert {(r.project_code, r.reporting_period) for r in bad} == {(None, "2020-06"), ("d", "soon")}
