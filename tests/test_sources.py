"""Parsing of cells, lines and words, readers, writers and the stream form."""

import pytest
from pyspark.sql import functions as F

from panelwright.errors import ContractError
from panelwright.functions import periods as P
from panelwright.functions import text as X
from panelwright.operators import harmonize as H
from panelwright.operators import quality as V
from panelwright.operators import snapshots as S
from panelwright.sources import cells as C
from panelwright.sources import lines as L
from panelwright.sources import readers as R
from panelwright.sources import sinks
from panelwright.sources import words as W
from panelwright.streaming import rows as ST


def _cells(spark, *rows):
    return C.identify_rows(spark.createDataFrame(rows, ST.CELL_SCHEMA), 1775)


STANDARD = ["525", "Rehab of road km 0 to 25 of PB73/2023-24/NR (PWD) (705375) (-) (-)", "Punjab", "03/2024\n(10/2024)",
            "04/2026\n(-)", "172.93\n(172.93)", "25.10", "15"]


def test_row_with_date_like_name(spark):
    r = C.parse_rows(_cells(spark, (80, 5, STANDARD)), "2026-07").first()
    assert (r.sl_no, r.project_id, r.state, r.agency) == (525, "705375", "Punjab", "PWD")
    assert r.project_name == "Rehab of road km 0 to 25 of PB73/2023-24/NR"
    assert (r.approval_date, r.start_date, r.original_completion_date, r.revised_completion_date) == (
        "03/2024", "10/2024", "04/2026", "")
    assert (r.original_cost_crore, r.revised_cost_crore, r.cumulative_expenditure_crore, r.physical_progress_pct) == (
        "172.93", "172.93", "25.10", "15")
    assert r.reject_reason is None


def test_missing_approval_does_not_shift(spark):
    row = ["557", "Construction of 4 lane bridge across river Zuari (NHAI) (706865) (-) (-)", "Goa", "NA\n(01/2022)",
           "03/2031\n(-)", "2,534.50\n(2,534.50)", "1850.00", "75"]
    r = C.parse_rows(_cells(spark, (82, 15, row)), "2026-07").first()
    assert (r.approval_date, r.start_date, r.original_completion_date, r.original_cost_crore) == (
        "", "01/2022", "03/2031", "2534.50")


def test_bad_shapes_are_rejected(spark):
    rows = C.parse_rows(_cells(spark, (1, 1, STANDARD + ["x"]), (1, 2, STANDARD[:2] + [""] + STANDARD[3:]),
                               (1, 3, STANDARD[:2] + ["12"] + STANDARD[3:]), (1, 4, ["total", "x"]), (1, 5, ["9999", "(12345)"])), "s")
    assert sorted(r.reject_reason for r in rows.collect()) == [
        "expected 8 cells, found 9", "state is a number", "state is empty"]


@pytest.mark.parametrize("text,top,inner", [
    ("03/2023\n(01/2024)", "03/2023", "01/2024"), ("03/2027\n(-)", "03/2027", ""), ("NA\n(01/2022)", "", "01/2022"),
    ("-\n(-)", "", "")])
def test_pairs(spark, text, top, inner):
    r = spark.range(1).select(X.pair(F.lit(text)).alias("p")).first().p
    assert (r.top, r.inner) == (top, inner)


@pytest.mark.parametrize("raw,strict,period", [
    ("2025-07-31", "2025-07", "2025-07"), ("7/2025", "2025-07", "2025-07"), ("07-2025", "2025-07", "2025-07"),
    ("Jun-2023", "2023-06", "2023-06"), ("NA", None, None), ("(-)", None, None), ("13/2025", None, None),
    ("31/07/2025", None, "2025-07"), ("July 2025", None, "2025-07")])
def test_months(spark, raw, strict, period):
    r = spark.range(1).select(P.strict_month(F.lit(raw)).alias("s"), P.period(F.lit(raw)).alias("p")).first()
    assert (r.s, r.p) == (strict, period)


def test_month_helpers(spark):
    r = spark.range(1).select(P.add_months(F.lit("2025-10"), 3).alias("a"), P.add_months(F.lit("2025-12"), 1).alias("b"),
                              P.previous_month(F.lit("2025-01")).alias("c"),
                              P.month_distance(F.lit("x"), F.lit("2025-01")).alias("d")).first()
    assert tuple(r) == ("2026-01", "2026-01", "2024-12", 0)


def test_titles_beyond_ascii(spark):
    df = spark.createDataFrame([("Ｆｏｏ Café-Line (N°4)",)], "t string")
    got = set(df.select(X.title_tokens("t").alias("k")).first().k)
    assert "foo" in got and "line" not in got and any(w.startswith("cafe") for w in got)


def _greedy(pages):
    """Plain restatement of the rule for the check below."""
    want, out = 1, []
    for page, lines in pages:
        for i, line in enumerate(lines):
            if line == str(want) and any("(12345)" in x for x in lines[i:i + 25]):
                out.append((page, i, want))
                want += 1
    return out


def test_segments_follow_the_greedy_rule(spark):
    import random
    rng = random.Random(7)
    pages = [(p, [rng.choice(["1", "2", "3", "4", "5", "6", "7", "x", "(12345)", "08"]) for _ in range(60)]) for p in range(1, 6)]
    rows = [("d", p, i, l) for p, lines in pages for i, l in enumerate(lines)]
    df = spark.createDataFrame(rows, "document string, page int, line_no int, line string")
    got = sorted((r.page, r.line_no, r.serial) for r in L.accepted_serials(df).collect())
    assert got == sorted(_greedy(pages)) and len(got) >= 7


def test_serials_of_a_document_in_many_blocks(spark):
    """A hot document of 150 pages, breaks at random places, beside short ones; blocks of one to four pages."""
    import random
    rng, documents = random.Random(11), {}
    for name, n in (("hot", 150), ("a", 1), ("b", 7), ("c", 13), ("none", 3)):
        want, pages = 1, []
        for p in range(n):
            lines = []
            for _ in range(rng.randint(0, 9)):
                more = rng.choice([[str(want)], [str(want), "x"], [str(rng.randint(1, want + 3))], ["(12345)"], ["7", str(want + 1)]])
                for line in more:
                    want += line == str(want) and rng.random() < 0.99
                lines += more
            pages.append((p * (3 if name == "c" else 1) - (4 if name == "b" else 0), lines + ["(12345)"] * (name != "none")))
        documents[name] = pages
    rows = [(d, p, i, l) for d, pages in documents.items() for p, lines in pages for i, l in enumerate(lines)]
    df = spark.createDataFrame(rows, "document string, page int, line_no int, line string")
    expected = sorted((d, *x) for d, pages in documents.items() for x in _greedy(pages))
    assert sum(x[0] == "hot" for x in expected) > 20
    for block_pages in (1, 4, 64):
        got = sorted((r.document, r.page, r.line_no, r.serial) for r in L.accepted_serials(df, block_pages).collect())
        assert got == expected
    assert L.accepted_serials(df.limit(0)).count() == 0


def test_block_maps_compose_like_their_lines(spark):
    from panelwright.sources import serials
    import random
    rng = random.Random(3)
    lines = [rng.randint(1, 9) for _ in range(60)]
    found = spark.createDataFrame([("d", i // 30, i, i, v) for i, v in enumerate(lines)], "document string, _block long, page int, line_no int, serial long")
    leads = {(r._block, r.serial): r.next for r in serials.block_maps(found).collect()}
    whole = serials.block_maps(found.withColumn("_block", F.lit(0).cast("long"))).collect()
    maps = serials.block_maps(found).selectExpr("document", "2L AS _blocks", "_block AS _node", "serial", "next")
    composed = {r.serial: r.next for r in serials._composed(maps).collect()}
    for e in range(1, 12):
        want = e
        for v in lines:
            want += v == want
        middle = leads.get((0, e), e)
        assert leads.get((1, middle), middle) == want == composed.get(e, e)
    assert composed == {r.serial: r.next for r in whole}


def test_segmentation_orders_no_document_in_one_task(spark):
    df = spark.createDataFrame([("d", 1, 1, "1"), ("d", 90, 1, "(12345)")], "document string, page int, line_no int, line string")
    plan = L.segment_records(df)._jdf.queryExecution().executedPlan().toString()
    windows = [line for line in plan.splitlines() if "Window " in line]
    assert windows and all("page#" in line.split("],")[-2] + line.split("],")[-1] for line in windows)


def test_line_records(spark):
    lines = ["Heading", "1", "Road", "part", "(AG)", "(12345)", "Goa", "01/2020", "02/2024", "(-)", "10.0", "(12.0)", "3", "40",
             "2", "Dam", "XY", "(12346)", "Bihar", "03/2024", "-", "5", "(6)", "7", "8", "Total (2)", "9"]
    df = spark.createDataFrame([("d", 1, i, l) for i, l in enumerate(lines)], "document string, page int, line_no int, line string")
    a, b = L.assemble_records(L.segment_records(df), "2025-07").orderBy("sl_no").collect()
    assert (a.project_name, a.agency, a.state, a.approval_date, a.revised_completion_date, a.revised_cost_crore) == (
        "Road part", "AG", "Goa", "01/2020", "(-)", "12.0")
    assert (b.project_name, b.agency, b.approval_date, b.original_completion_date, b.physical_progress_pct) == (
        "Dam", "XY", "", "03/2024", "8")


def test_legacy_block(spark):
    r = spark.range(1).select(L.legacy_block(F.array(*map(F.lit, [
        "Pipeline 12345678KM", "phase two", "( GAIL )", "(N04000073)"]))).alias("b")).first().b
    assert tuple(r) == ("Pipeline 12345678KM phase two", "GAIL", "N04000073")


def test_words_to_rows(spark):
    ws = [(130, 150, "1"), (20, 151, "Goa"), (160, 150, "Big"), (180, 152, "dam"), (160, 160, "(NHPC)"), (160, 170, "(220100265)"),
          (130, 200, "2"), (160, 200, "Small"), (160, 210, "(AB)"), (160, 220, "(220100266)"), (160, 260, "Total"), (200, 261, "x")]
    df = spark.createDataFrame([("d", 1, i, float(x), float(y), t) for i, (x, y, t) in enumerate(ws)],
                               "document string, page int, word_no int, x double, y double, text string")
    a, b = W.parse_words(df, "2025-06").orderBy("sl_no").collect()
    assert (a.project_name, a.agency, a.project_id, a.state) == ("Big dam", "NHPC", "220100265", "Goa")
    assert (b.project_name, b.agency, b.project_id, b.state) == ("Small", "AB", "220100266", "Goa")


def test_readers(spark, tmp_path):
    plain, titled = tmp_path / "a.csv", tmp_path / "b.csv"
    plain.write_text('id,name\n1,"x, y"\nNA,\n')
    titled.write_text('Projects Details\nas of May\nid,name\n1,"x, y"\n2,NA\n')
    assert [tuple(r) for r in R.read_panel(spark, str(plain), ["id", "name"]).collect()] == [("1", "x, y"), (None, None)]
    assert sorted(map(str, R.read_titled_csv(spark, str(titled)).collect())) == sorted(
        ["Row(id='1', name='x, y')", "Row(id='2', name=None)"])
    assert R.read_titled_csv(spark, str(plain)).count() == 2


def test_titled_csv_drops_lines_by_position_and_fails_on_ragged_rows(spark, tmp_path):
    folder = tmp_path / "many"
    folder.mkdir()
    (folder / "a.csv").write_text('Projects Details\nas of May\nid,name\nid,name\n1,"x, y"\n')
    (folder / "b.csv").write_text('Projects Details\nas of June\nid,name\nas of May,z\n')
    rows = sorted(tuple(r) for r in R.read_titled_csv(spark, str(folder)).collect())
    assert rows == [("1", "x, y"), ("as of May", "z"), ("id", "name")]
    for ragged in ("4,5,6", "3"):
        bad = tmp_path / f"{len(ragged)}.csv"
        bad.write_text(f"Projects Details\nas of May\nid,name\n1,2\n{ragged}\n")
        with pytest.raises(Exception, match="(?i)malformed"):
            R.read_titled_csv(spark, str(bad)).collect()


def test_missing_fields_lists_every_serial(spark):
    df = spark.createDataFrame([(str(i), "" if i % 2 else "x", None) for i in range(100)], "sl_no string, state string, agency string")
    rows = S.missing_fields(df, ["state", "agency"]).collect()
    assert sorted(r.serial for r in rows if r.field == "state") == list(range(1, 100, 2))
    assert len(rows) == 150 and {(r.field, r.missing) for r in rows} == {("state", 50), ("agency", 100)}


def test_nan_rule(spark):
    df = spark.createDataFrame([(float("nan"), "nan"), (1.0, "a")], "x double, s string")
    assert R.tokens_to_null(df).filter("x is null and s is null").count() == 1


def test_promotion_gate(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    clean = spark.createDataFrame([], V.ISSUE_SCHEMA)
    assert sinks.promote(df, clean, str(tmp_path / "t")).count() == 2
    dirty = spark.createDataFrame([("g", "HARD_FAIL", "R", 1, "m")], V.ISSUE_SCHEMA)
    with pytest.raises(ContractError):
        sinks.promote(df, dirty, str(tmp_path / "u"))
    assert not (tmp_path / "u").exists()
    # A later version may be made from the published one; a failed one changes nothing.
    current = spark.read.parquet(sinks.published(spark, str(tmp_path / "t")))
    sinks.promote(current.filter("k = 1"), clean, str(tmp_path / "t"))
    with pytest.raises(ContractError):
        sinks.promote(df, dirty, str(tmp_path / "t"))
    assert spark.read.parquet(sinks.published(spark, str(tmp_path / "t"))).count() == 1
    with pytest.raises(ContractError):
        sinks.published(spark, str(tmp_path / "u"))


def test_seeding_publishes_only_whole_versions(spark, tmp_path):
    key = "canonical_project_key"
    parent = spark.createDataFrame([("a", 1), ("b", 2)], f"{key} string, n int")
    child = spark.createDataFrame([("a", 1.0)], f"{key} string, x double")
    for _ in range(2):
        sinks.seed_tables({"projects": parent, "risk": child}, str(tmp_path), "v1")
    assert sinks.open_tables(spark, str(tmp_path), ["risk"])["risk"].count() == 1
    with pytest.raises(ContractError):
        sinks.seed_tables({"projects": parent, "risk": child.withColumn(key, F.lit("z"))}, str(tmp_path), "v2")
    assert sinks.open_tables(spark, str(tmp_path), ["projects"])["projects"].count() == 2


def test_fingerprint_ignores_order(spark):
    df = spark.range(100).withColumn("s", F.lit("x"))
    assert S.same_content(df, df.repartition(7)).first().same
    assert not S.same_content(df, df.filter("id <> 5")).first().same


def test_canonical_hash_and_bad_month(spark):
    import hashlib, json
    row = {"project_id": "N1", "project_name": 'A "b"', "agency": "", "state": "Goa", "approval_date": "1/2020", "sl_no": "1"}
    df = spark.createDataFrame([tuple(row.values())], ", ".join(f"{k} string" for k in row))
    spec = H.SnapshotSpec("2025-06", "2025-06-30", "T", "f")
    r = H.to_canonical(df, spec).first()
    assert r.source_record_hash == hashlib.sha256(json.dumps(row, sort_keys=True, ensure_ascii=False).encode()).hexdigest()
    assert (r.approval_date, r.approval_date_raw, r.agency, r.sector) == ("2020-01", "1/2020", None, None)
    assert r.canonical_observation_key == "2025-06:T:N1" and len(r) == 30
    with pytest.raises(Exception, match="not a month"):
        H.to_canonical(df.withColumn("approval_date", F.lit("soon")), spec).collect()
    assert H.rejected_months(df.withColumn("approval_date", F.lit("soon")), ["approval_date"]).first().value == "soon"


def test_stream_of_cells(spark, tmp_path):
    src = str(tmp_path / "in")
    spark.createDataFrame([(80, 5, STANDARD)], ST.CELL_SCHEMA).write.parquet(src)
    parsed = ST.parsed_stream(ST.read_cells(spark, src), "2026-07", 1775)
    canon = ST.canonical_stream(parsed, H.SnapshotSpec("2026-07", "2026-07-31", "T", "f"))
    q = (canon.writeStream.format("memory").queryName("canon").option("checkpointLocation", str(tmp_path / "cp"))
         .trigger(availableNow=True).start())
    q.awaitTermination(120)
    assert spark.table("canon").first().source_project_id == "705375"
