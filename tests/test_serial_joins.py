"""Tables of serials look small in files; their joins stay off the driver."""

from panelwright.sources import lines as L


def _plan(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def test_serial_joins_are_never_broadcast(spark):
    page = [(d, p, i, text) for d in range(3) for p in (1, 70, 140) for i, text in enumerate([str(1 + p // 70), "name", "(1234)", "01/2020"])]
    df = spark.createDataFrame(page, "document long, page long, line_no long, line string")
    assert "BroadcastHashJoin" not in _plan(L.accepted_serials(df))
    segments = L.segment_records(df)
    assert "BroadcastHashJoin" not in _plan(segments)
    assert segments.select("document", "page", "serial").distinct().count() == 9


def test_headings_are_never_broadcast(spark):
    df = spark.createDataFrame([("d", 1, 1, "a"), ("d", 2, 1, None)], "document string, page int, row int, heading string")
    filled = L.fill_down(df, ["heading"])
    assert "BroadcastHashJoin" not in _plan(filled) and {r.heading for r in filled.collect()} == {"a"}
