"""Fitted operators: held-out accuracy, stated rules, edge cases and repeatability."""

import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from panelwright.llm import decontaminate, jaccard, language, linear, lm, pii, quality, toxicity, urls

ODD = [None, "", " \t\n", "one", "123 456 !!", "é" * 5000, "x y " * 20000, "x y " * 20000]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, None, None, None, "other", "other") for i, t in enumerate(ODD)] + [(7, ODD[7], "en", "s", 1, "other", "other")]
    return spark.createDataFrame(
        rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, score string, predicted string")


@pytest.fixture(scope="module")
def tables(spark, sf_dir):
    larger = sf_dir.replace("sf0.001", "sf0.01")
    return {t: spark.read.parquet(f"{larger}/{t}.parquet") for t in ("documents", "labels", "pages")}


def crc(i):
    return zlib.crc32(str(i).encode())


# --- linear models ----------------------------------------------------------------------

def test_logistic_fit_satisfies_its_first_order_conditions():
    rng = np.random.default_rng(0)
    columns = rng.integers(0, 20, (300, 4))
    y = (columns[:, 0] < 8).astype(float)
    x = linear.Sparse(columns.ravel(), np.arange(0, 1201, 4), 20)
    w, _, b = linear.fit_logistic(x, y, l2=1e-2, steps=3000)
    r = (linear.sigmoid(x.times(w) + b) - y) / len(y)
    assert abs(r.sum()) < 1e-4 and abs(x.transposed(r) + 1e-2 * w).max() < 1e-4
    sparse, _, _ = linear.fit_logistic(x, y, l2=0, l1=2e-2, steps=2000)
    assert 0 < np.count_nonzero(sparse) < 20


# --- quality ------------------------------------------------------------------------------

def test_quality_on_held_out_labels_and_odd_rows(tables, odd):
    got = {r["doc_id"]: r for r in quality.quality_digest(tables["documents"], tables["labels"]).collect()}
    assert all(r["held_out"] == (crc(i) % 5 == 0) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for i, r in got.items())
    truth = [(r["quality"], got[r["doc_id"]]) for r in tables["labels"].collect() if crc(r["doc_id"]) % 5 == 0]
    assert np.mean([r["predicted"] == y for y, r in truth]) > 0.9
    rows = quality.score(odd, quality.train(tables["documents"], tables["labels"])).collect()
    assert len(rows) == len(ODD) + 1 and rows[0]["score"] == rows[1]["score"] and all(0 <= r["score"] <= 1 for r in rows)
    none = quality.score(odd, quality.train(tables["documents"], tables["labels"].limit(0))).collect()
    assert {r["score"] for r in none} == {0.5}
    assert quality.score(odd.limit(0), quality.RuleModel([], [], 0.0)).count() == 0


def test_compiled_rules_equal_the_rules(tables):
    frame = quality.with_statistics(tables["documents"])
    rows = frame.collect()
    x = np.array([r[1:] for r in rows], float)
    rng = np.random.default_rng(1)
    y = (x[:, 3] + 0.02 * rng.normal(size=len(x)) > np.median(x[:, 3])).astype(float)
    model = quality.fit_rules(x, y)
    expected = model.intercept + sum((w * quality.holds(r, x) for r, w in zip(model.rules, model.weights)), np.zeros(len(x)))
    got = {r["doc_id"]: r["s"] for r in frame.select("doc_id", model.column().alias("s")).collect()}
    assert model.rules and np.allclose([got[r["doc_id"]] for r in rows], 1 / (1 + np.exp(-expected)))


# --- language -------------------------------------------------------------------------------

def test_forward_backward_equals_enumeration():
    rng = np.random.default_rng(0)
    scores, transition = rng.normal(size=(7, 3)), rng.normal(size=(3, 3))
    first = np.array([0, 5, 5, 7])
    got = language.marginals(scores, first, transition)
    for a, b in ((0, 5), (5, 7)):
        weight, total = np.zeros((b - a, 3)), 0.0
        for path in np.ndindex(*[3] * (b - a)):
            # every start label is entered from each label alike
            p = np.exp(sum(scores[a + i, t] for i, t in enumerate(path)) + sum(transition[s, t] for s, t in zip(path, path[1:])))
            p *= np.exp(transition[:, path[0]]).sum()
            total += p
            for i, t in enumerate(path):
                weight[i, t] += p
        assert np.allclose(got[a:b], weight / total)
    long = rng.normal(size=(500, 3))
    whole = language.marginals(long, np.array([0, 500]), transition)
    size, language.BLOCK = language.BLOCK, 500
    assert np.allclose(whole, language.marginals(long, np.array([0, 500]), transition))
    language.BLOCK = size


def test_language_on_held_out_documents_and_code_switching(tables, odd):
    docs = tables["documents"]
    got = language.language_digest(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert all(r["held_out"] == (crc(r["doc_id"]) % 3 == 1) and 0 <= r["score"] <= 1 for r in got)
    assert np.mean([r["lang_pred"] == r["lang"] for r in got if r["held_out"]]) > 0.95
    sample = docs.filter(~language.held_out()).select("text", "lang").collect()
    model = language.fit_model([r["text"] for r in sample], [r["lang"] for r in sample])
    parts = {lang: next(r["text"][:300] for r in sample if r["lang"] == lang and len(r["text"]) > 400) for lang in ("de", "en")}
    data, offsets = language.tb.raw(pa.array([parts["de"] + " " + parts["en"]]))
    starts, _, _, p = model.word_marginals(language.tb.LOWER[data], offsets)
    labels = np.array(model.labels)[p.argmax(axis=1)]
    middle = np.searchsorted(starts, len(parts["de"].encode()))
    assert np.mean(labels[:middle] == "de") > 0.8 and np.mean(labels[middle:] == "en") > 0.8
    rows = {r["doc_id"]: r for r in language.identify(odd, model).collect()}
    assert [rows[i]["lang_pred"] for i in (0, 1, 2, 4)] == ["und"] * 4 and rows[0]["score"] == 0 and rows[3]["lang_pred"] != "und"
    empty = language.identify(odd, language.fit_model([], []))
    assert {r["lang_pred"] for r in empty.collect()} == {"und"}
    assert language.identify(odd.limit(0), model).count() == 0


# --- language model ---------------------------------------------------------------------------

def test_lm_probabilities_sum_to_one_and_training_helps(tables, odd):
    docs = tables["documents"]
    network = lm.train(docs)
    tokens, first = np.array([3, 800, 5, 1000, 7]), np.array([0, 3, 5])
    for place in (0, 2, 4):
        total = 0.0
        for other in range(lm.VOCABULARY):
            own = tokens.copy()
            own[place] = other
            total += np.exp(network.log_probabilities(own, first, np.array([place]))[0])
        assert abs(total - 1) < 1e-3
    before = lm.Network(network.frequent, network.numbers)
    mean = lambda n: lm.score(docs, n).agg(F.sum("log_probability") / F.sum("n_words")).first()[0]
    assert mean(network) > mean(before) + 0.3
    words = lm.word_counts(docs).agg(F.sum("n")).first()[0]
    assert words == lm.score(docs, before).agg(F.sum("n_words")).first()[0]
    rows = {r["doc_id"]: r for r in lm.score(odd, network).collect()}
    assert rows[0]["n_words"] == 0 and rows[0]["log_probability"] == 0 and rows[0]["mean_log_probability"] is None
    assert rows[6]["n_words"] == 40_000 and np.isfinite(rows[6]["log_probability"])
    assert lm.score(odd.limit(0), lm.train(odd.limit(0))).count() == 0


def test_lm_trains_on_every_word(spark, tables):
    short = spark.createDataFrame([(0, "one"), (1, "two words"), (2, None), (3, "a b c d e f g h i j k")], "doc_id int, text string")
    for docs in (short, tables["documents"].limit(200)):
        assert lm.train(docs).seen == lm.word_counts(docs).agg(F.sum("n")).first()[0]
    first = np.array([0, 1, 3, 3, 14])
    parts = [lm.targets(first, number, 3) for number in range(3)]
    assert sorted(np.concatenate(parts)) == list(range(14)) and {0, 1, 3} <= set(parts[0])


def test_lm_scores_each_word_of_a_class(spark, monkeypatch):
    monkeypatch.setattr(lm, "FREQUENT", 4)
    texts = ["the of and to " * 50 + "common-ending " * 40 + "rarending bending bending xyz"] * 2
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    counts = {}
    for word in (w for t in texts for w in t.replace("-", " ").split()):
        counts[word] = counts.get(word, 0) + 1
    column = pa.array(list(counts))
    (_, _, data, offsets), = lm.tb.each_slice(column)
    words, endings, _ = lm.word_hashes(data, offsets)
    for most in (0, 1, lm.KEPT):                # all counts joined, some, none
        known, numbers = lm.vocabulary(docs, most)
        network = lm.Network(known, numbers)
        tokens = network.tokens(words, endings)
        totals = {}
        for t, n in zip(tokens, counts.values()):
            totals[t] = totals.get(t, 0) + n
        bare = lm.Network(lm.Vocabulary(known.own), numbers, network.weights)
        probes = spark.createDataFrame(
            [(i, w) for i, w in enumerate(counts)] + [(90, "unknownending"), (91, None), (91, None), (92, "bending xyz bending")], "doc_id int, text string")
        score = lambda x: {r["doc_id"]: r["log_probability"] for r in lm.score(probes, x).collect()}
        full, plain = score(network), score(bare)
        place = {w: i for i, w in enumerate(counts)}
        share = {w: np.log(n / (totals[t] + 1)) if t >= 4 else 0.0 for (w, n), t in zip(counts.items(), tokens)}
        for w, i in place.items():
            assert abs(full[i] - plain[i] - share[w]) < 1e-6
        assert full[place["bending"]] > full[place["rarending"]] and full[91] == 0
        assert abs(full[92] - plain[92] - 2 * share["bending"] - share["xyz"]) < 1e-6
        assert abs(full[90] - plain[90] + np.log(totals[tokens[place["bending"]]] + 1)) < 1e-6
        assert lm.score(probes, network).count() == len(counts) + 4


# --- urls ---------------------------------------------------------------------------------------

def test_url_parts_rules_and_model(spark, tables):
    rows = [(1, None), (2, ""), (3, "HTTP://WWW.Example.COM/en/x?y#z"), (4, "http://example.com/en/"), (5, "x://com"), (6, "x://net/es/"),
            (7, "http://a.net/fr/é?q"), (8, "http://net:80/es/1"), (9, "a\nb://h.com/q\nr#f"), (10, "http://a.example.com/de/"),
            (11, "https://casino-win.example.org/en/3"), (11, "https://casino-win.example.org/en/3"), (12, "http://therat.example.org/en/4")]
    frame = spark.createDataFrame(rows, "page_id int, url string").withColumn("verdict", F.lit("clash")).withColumn("host", F.lit("clash"))
    got = {r["page_id"]: tuple(r)[1:5] for r in urls.judge(frame).collect()}
    assert got[1] == got[2] == ("", "", None, "allow")
    assert got[3] == ("www.example.com", "/en/x", "www.example.com/en/", "allow") and got[4][2:] == ("example.com/en/", "block")
    assert got[5][:3] == ("com", "", None) and got[6][2:] == ("net/es/", "block") and got[7][:3] == ("a.net", "/fr/é", "net/fr/")
    assert got[8][:3] == ("net:80", "/es/1", None) and got[9][:3] == ("h.com", "/q\nr", "com/") and got[10][2:] == ("com/", "allow")
    assert got[11][2:] == (None, "block") and got[12][2:] == (None, "allow")
    assert urls.judge(frame).count() == len(rows) and urls.judge(frame.limit(0)).count() == 0
    judged = urls.judge(tables["pages"])
    assert judged.filter("verdict not in ('allow', 'block')").count() == 0


def test_pii_finds_disguised_addresses_without_digits(spark, tables):
    hidden = ["anna.maria(at)example.org", "anna.maria[at]example.org", "anna.maria at example dot org"]
    texts = [f"please write to {h} about the matter" for h in hidden] + ["we look at the sky and then at the sea"]
    model = pii.fit_model(tables["documents"])
    rows = {r["doc_id"]: r for r in pii.find_spans(
        spark.createDataFrame([*enumerate(texts), (9, None)], "doc_id int, text string"), model).collect()}
    for i, h in enumerate(hidden):
        assert [(s["kind"], texts[i][s["start"]:s["end"]]) for s in rows[i]["spans"]] == [("email", h)] and not rows[i]["base"]
    assert rows[3]["spans"] == rows[9]["spans"] == []
    for text in ("x anna@example.org y", ):
        assert sum(bool(truth) for _, _, truth in pii.examples([text])) == 4


# --- toxicity -------------------------------------------------------------------------------------

def test_toxicity_finds_labelled_documents_and_single_words(tables, odd):
    chain = toxicity.train(tables["documents"], tables["labels"])
    scored = toxicity.score(tables["documents"], chain).join(tables["labels"], "doc_id").collect()
    assert np.mean([r["is_toxic"] == (r["toxic"] == 1) for r in scored]) > 0.95
    lone = chain.predict(pa.array(["the and of idiot it", "the and of the it"]))
    assert lone[0, -1] > 0.5 > lone[1, -1] and lone[0, 0] > lone[1, 0]
    rows = toxicity.score(odd, chain).collect()
    assert len(rows) == len(ODD) + 1 and not any(r["is_toxic"] for r in rows)
    none = toxicity.train(tables["documents"], tables["labels"].limit(0))
    assert not any(r["is_toxic"] for r in toxicity.score(odd, none).collect())
    assert toxicity.score(odd.limit(0), chain).count() == 0


# --- pipeline ---------------------------------------------------------------------------------------

def test_stages_take_effect_and_keep_the_columns(spark, sf_dir, odd):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    spoken = corpus_pipeline.identify_language(spark, docs.unionByName(odd.select(*docs.columns)), sf_dir)
    assert spoken.columns == docs.columns
    left = {r["doc_id"] for r in docs.join(spoken, "doc_id", "left_anti").collect()}
    assert not left or all(not any(c.isalpha() for c in r["text"] or "") for r in docs.filter(F.col("doc_id").isin(list(left))).collect())
    distinct = corpus_pipeline.drop_near_duplicates(spark, docs, sf_dir)
    groups = jaccard.jaccard_groups(docs)
    assert distinct.columns == docs.columns
    assert {r["doc_id"] for r in distinct.collect()} == {r["component_id"] for r in groups.collect()}
    clean = corpus_pipeline.drop_contaminated(spark, docs, sf_dir)
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    hit = {r["doc_id"] for r in decontaminate.contamination(docs, items).filter(decontaminate.is_contaminated()).collect()}
    assert hit and {r["doc_id"] for r in docs.collect()} - hit == {r["doc_id"] for r in clean.collect()} and clean.columns == docs.columns
    masked = corpus_pipeline.mask_personal_data(spark, docs, sf_dir)
    assert masked.count() == docs.count() and masked.columns == docs.columns
    assert not any(pii.base_spans(r["text"]) for r in masked.collect())
    assert masked.filter("n_chars <> length(text)").count() == 0


def test_language_stage_keeps_mixed_documents(spark, tables, sf_dir):
    docs = tables["documents"]
    parts = [docs.filter((F.col("lang") == lang) & (F.length("text") > 400)).orderBy("doc_id").first()["text"][:300] for lang in ("de", "en", "es", "fr")]
    mixed = spark.createDataFrame([(-1, " ".join(parts), None, "s", 1203), (-2, "123 !!", None, "s", 6)], docs.schema)
    both = docs.unionByName(mixed)
    found = language.identify(mixed, language.train(both), keep=("doc_id",)).filter("doc_id = -1").first()
    assert found["lang_pred"] != language.UNKNOWN and found["score"] < 0.4
    kept = corpus_pipeline.identify_language(spark, both, sf_dir).filter("doc_id < 0").collect()
    assert [r["doc_id"] for r in kept] == [-1]


def test_near_duplicate_stage_tells_rows_by_id_and_text(spark, sf_dir):
    words = "one two three four five six seven eight nine ten eleven twelve"
    texts = [(4, words), (2, words + " "), (2, "another text of the very same id here"), (2, "another text of the very same id here"), (None, words),
             (None, "only rows without an id hold this text"), (None, "only rows without an id hold this text"), (7, ""), (7, ""), (None, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in texts], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    got = sorted(((r["doc_id"], r["text"]) for r in corpus_pipeline.drop_near_duplicates(spark, docs, sf_dir).collect()), key=str)
    expected = [(2, words + " "), texts[2], texts[5], (7, ""), (7, ""), (None, None)]
    assert got == sorted(expected, key=str)


def test_pipeline_runs_and_equals_its_stages(spark, sf_dir):
    got = corpus_pipeline.run(spark, sf_dir)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf_dir)
    ids = {r["doc_id"] for r in docs.select("doc_id").collect()}
    assert {r["doc_id"] for r in got.select("doc_id").distinct().collect()} == ids
    totals = got.groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("m"))
    assert totals.filter("n <> m").count() == 0 and corpus_pipeline.ORACLE_SQL is None
    empty = spark.createDataFrame([], docs.schema)
    for _, stage in corpus_pipeline.STAGES:
        empty = stage(spark, empty, sf_dir)
    assert empty.count() == 0
