"""The gram index against a scan of all texts."""

import random

from panelwright.functions.text import contains_any
from panelwright.operators import search as S


def test_index_finds_what_a_scan_finds(spark):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice(["a", "b", "É", "ß", " ", "😀", "x"]) for _ in range(rng.randint(0, 9)))
    rows = [(i, word() + word(), rng.choice([None, word()])) for i in range(120)] + [(None, "abc", None), (500, None, None), (501, "", ""), (502, "ab" * 20_000, "a")]
    df = spark.createDataFrame(rows, "k int, s string, t string").repartition(3)
    index = S.build_index(df, "k", ["s", "t"])
    assert index.postings.groupBy("gram", "key").count().filter("count > 1").count() == 0
    keyed = df.filter("k IS NOT NULL")
    for query in ("a", "ab", "aba", "É", "éß", " x ", "😀😀", "abababab", "no such", ""):
        expected = sorted(r.k for r in keyed.filter(contains_any(["s", "t"], query)).select("k").collect())
        assert sorted(r.k for r in index.search(keyed, "k", query).select("k").collect()) == expected, query
    effort = index.effort("abababab").first()
    assert 0 < effort.read < effort.postings and effort.candidates >= 1


def test_grams_of_short_and_null_texts(spark):
    got = spark.createDataFrame([("Ab",), ("",), (None,), ("aaaa",)], "s string").select(S.grams("s").alias("g")).collect()
    assert [sorted(r.g) for r in got] == [["ab", "b"], [], [], ["a", "aa", "aaa"]]


def test_stored_grams_are_those_of_the_column_and_sort_as_texts(spark):
    texts = ["Straße ÉÀ 😀x\x00y", "", None, "a", "İstanbul ab\U0010ffff", "aaaa"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(0, "Straße"), (None, "zzz")], "k int, s string")
    index = S.build_index(df, "k", ["s"])
    want = {(S.gram_code(g), r.k) for r in df.filter("k IS NOT NULL").select("k", S.grams("s").alias("g")).collect() for g in r.g}
    got = [(r.gram, r.key) for r in index.postings.collect()]
    assert set(got) == want and len(got) == len(want) and {r.gram: r.n for r in index.counts.collect()} == {c: sum(x == c for x, _ in want) for c, _ in want}
    known = ["a", "a\x00", "ab", "abc", "aé", "b", "é", "😀", "\U0010ffff\U0010ffff\U0010ffff"]
    assert sorted(known, key=S.gram_code) == sorted(known) and 0 < S.gram_code(known[-1]) < 1 << 63


def test_postings_of_single_keys_are_not_moved_and_stored_in_order(spark, monkeypatch):
    df = spark.createDataFrame([(i, f"some text {i}") for i in range(200)] + [(None, "x"), (200, None)], "k int, s string").coalesce(1)
    stored = []
    monkeypatch.setattr(S, "cut_lineage", lambda d, keep=S.cut_lineage: stored.append(d) or keep(d))
    index = S.build_index(df, "k", ["s"])
    plan = stored[1]._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning" not in plan and "zip_with" not in plan
    grams = [r.gram for r in index.postings.collect()]
    assert grams == sorted(grams) and len(grams) == sum(len(set(f"some text {i}"[j:j + 3] for j in range(len(f"some text {i}")))) for i in range(200))
