"""Queries that parse extracted cells, lines and words written from the order table."""

from pyspark.sql import functions as F

from panelwright.functions import text as X
from panelwright.plans import derived as D
from panelwright.registry import query
from panelwright.sources import cells as C
from panelwright.sources import lines as L
from panelwright.sources import words as W

_T = F.lit


def _str(c):
    return c.cast("string")


def _orders(spark, sf_dir):
    k = F.col("o_orderkey")
    return D.table(spark, sf_dir, "orders").select(
        k.alias("k"), "o_orderpriority", F.date_format("o_orderdate", "MM/yyyy").alias("my"),
        F.lpad(_str(k % 1000), 3, "0").alias("n3"))


_ORDERS = """o AS (SELECT o_orderkey AS k, o_orderpriority, strftime(o_orderdate, '%m/%Y') AS my,
  lpad(CAST(o_orderkey % 1000 AS VARCHAR), 3, '0') AS n3 FROM orders)"""


def report_cells(spark, sf_dir):
    """Eight report cells per order; some rows lack a code, a state or the right shape."""
    k = F.col("k")
    code = F.when(k % 13 == 0, _T("")).otherwise(F.concat(_T(" ("), _str(k + 100000), _T(") (L"), _str(k), _T(") (-)")))
    agency = F.when(k % 11 == 0, _T("")).otherwise(F.concat(_T(" (AG"), _str(k % 7), _T(")")))
    name = F.concat(_T("Works \n on  PB"), _str(k % 90), _T("/2023-24"), agency, code)
    state = F.when(k % 17 == 0, "").when(k % 19 == 0, "12").otherwise(F.col("o_orderpriority"))
    start = F.concat(F.when(k % 5 == 0, "NA").otherwise(F.col("my")), _T("\n("), F.col("my"), _T(")"))
    cost = F.concat(_T("1,"), F.col("n3"), _T(".50\n("), F.when(k % 3 == 0, "-").otherwise(
        F.concat(_T("2,"), F.col("n3"), _T(".00"))), _T(")"))
    row = [_str(k % 2000 + 1), name, state, start, F.concat(F.col("my"), _T("\n(-)")), cost,
           F.when(k % 7 == 0, "-").otherwise(F.concat(F.col("n3"), _T(".10"))), _str(k % 101)]
    whole = F.array(*row)
    return _orders(spark, sf_dir).select(
        (k % 97 + 1).cast("int").alias("source_page"), k.cast("int").alias("row_index"),
        F.when(k % 23 == 0, F.concat(whole, F.array(_T("extra")))).otherwise(whole).alias("cells"))


@query(f"""WITH {_ORDERS} SELECT CAST(k % 97 + 1 AS INTEGER) AS source_page, CAST(k % 2000 + 1 AS INTEGER) AS sl_no,
  CAST(k + 100000 AS VARCHAR) AS project_id, 'Works on PB' || k % 90 || '/2023-24' AS project_name,
  CASE WHEN k % 11 = 0 THEN '' ELSE 'AG' || k % 7 END AS agency, 'L' || k AS legacy_ocms_code, '-' AS pmgid,
  CASE WHEN k % 17 = 0 THEN '' WHEN k % 19 = 0 THEN '12' ELSE o_orderpriority END AS state,
  CASE WHEN k % 5 = 0 THEN '' ELSE my END AS approval_date, my AS start_date, my AS original_completion_date, '' AS revised_completion_date,
  '1' || n3 || '.50' AS original_cost_crore, CASE WHEN k % 3 = 0 THEN '' ELSE '2' || n3 || '.00' END AS revised_cost_crore,
  CASE WHEN k % 7 = 0 THEN '' ELSE n3 || '.10' END AS cumulative_expenditure_crore, CAST(k % 101 AS VARCHAR) AS physical_progress_pct,
  CASE WHEN k % 23 = 0 THEN 'expected 8 cells, found 9' WHEN k % 17 = 0 THEN 'state is empty' WHEN k % 19 = 0 THEN 'state is a number' END AS reject_reason
FROM o WHERE k % 13 <> 0 AND k % 2000 + 1 <= 1500""")
def parsed_cells(spark, sf_dir):
    """Serial, code, name, agency, ids, pairs, shape check."""
    rows = C.parse_rows(C.identify_rows(report_cells(spark, sf_dir), 1500), "2026-07")
    return rows.drop("snapshot_date")


@query(f"""WITH {_ORDERS} SELECT k, my AS original, CASE WHEN k % 3 = 0 THEN '' ELSE 'Jan-2024' END AS revised,
  CASE WHEN k % 4 = 0 THEN my ELSE '' END AS anticipated, '1' || n3 || '.5' AS cost_original, '2' || n3 AS cost_revised FROM o""")
def parsed_triples(spark, sf_dir):
    """``original (revised) {anticipated}`` for dates and costs."""
    k = F.col("k")
    dates = F.concat(F.col("my"), _T(" ("), F.when(k % 3 == 0, "N.A.").otherwise("Jan-2024"), _T(") {"),
                     F.when(k % 4 == 0, F.col("my")).otherwise("N.A."), _T("}"))
    costs = F.concat(_T("1,"), F.col("n3"), _T(".5 (2,"), F.col("n3"), _T(") {N.A.}"))
    df = _orders(spark, sf_dir).select("k", X.triple(dates).alias("d"), X.triple(costs, numeric=True).alias("c"))
    return df.select("k", "d.*", F.col("c.original").alias("cost_original"), F.col("c.revised").alias("cost_revised"))


def report_lines(spark, sf_dir):
    """Forty records per document, ten per page, as ordered page lines with trailers."""
    k = F.col("k")
    t = _T
    record = [_str(k % 40 + 1), F.concat(t("Road part "), _str(k)), t("5000"), F.concat(t("(AG"), _str(k % 7), t(")")),
              F.concat(t("("), _str(k + 100000), t(")")), F.col("o_orderpriority")]
    dates = F.when(k % 9 == 0, F.array(F.col("my"), t("(-)"))).otherwise(F.array(F.col("my"), F.col("my"), t("-")))
    money = [F.concat(F.col("n3"), t(".50")), F.concat(t("("), F.col("n3"), t(".75)")), F.concat(F.col("n3"), t(".10")), F.concat(_str(k % 101), t(".5"))]
    tail = F.when(k % 10 == 9, F.array(t("Total (all)"), t("9"), t("junk"))).otherwise(F.array().cast("array<string>"))
    lines = F.concat(F.array(*record), dates, F.array(*money), tail)
    return _orders(spark, sf_dir).select(
        F.floor(k / 40).alias("document"), (F.floor(k % 40 / 10) + 1).alias("page"), k,
        F.posexplode(lines).alias("_i", "line")).select(
        "document", "page", ((F.col("k") % 10) * 100 + F.col("_i")).alias("line_no"), "line")


@query(f"""WITH {_ORDERS} SELECT k // 40 AS document, k % 40 // 10 + 1 AS source_page, k % 40 + 1 AS sl_no, CAST(k + 100000 AS VARCHAR) AS project_id,
  'Road part ' || k || ' 5000' AS project_name, 'AG' || k % 7 AS agency, o_orderpriority AS state,
  CASE WHEN k % 9 = 0 THEN '' ELSE my END AS approval_date, my AS original_completion_date, CASE WHEN k % 9 = 0 THEN '(-)' ELSE '-' END AS revised_completion_date,
  n3 || '.50' AS original_cost_crore, n3 || '.75' AS revised_cost_crore, n3 || '.10' AS cumulative_expenditure_crore,
  k % 101 || '.5' AS physical_progress_pct, CAST(NULL AS VARCHAR) AS reject_reason FROM o""")
def parsed_lines(spark, sf_dir):
    """Records from page lines, two or three dates."""
    return L.assemble_records(L.segment_records(report_lines(spark, sf_dir)), "2025-07").drop("snapshot_date")


@query("""WITH e AS (SELECT event_id, event_id // 1000 AS document, event_id // 50 % 20 AS page, event_id % 50 AS row_no,
    CASE WHEN event_id % 37 = 0 THEN event_type END AS heading FROM events)
SELECT event_id, last_value(heading IGNORE NULLS) OVER (PARTITION BY document ORDER BY page, row_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS heading FROM e""")
def heading_fill_down(spark, sf_dir):
    """A heading holds until replaced, across pages."""
    i = F.col("event_id")
    df = D.table(spark, sf_dir, "events").select(
        i, F.floor(i / 1000).alias("document"), (F.floor(i / 50) % 20).alias("page"), (i % 50).alias("row"),
        F.when(i % 37 == 0, F.col("event_type")).alias("heading"))
    return L.fill_down(df, ["heading"]).select("event_id", "heading")


@query("""WITH p AS (SELECT page_id // 10 AS document, page_id % 10 + 1 AS page,
    CASE WHEN page_id // 10 % 3 = 0 AND page_id % 10 IN (2, 4) THEN 2 WHEN page_id // 10 % 3 = 1 AND page_id % 10 IN (3, 6) THEN 1 ELSE 0 END AS mark,
    page_id % 10 = 7 AS lists FROM pages),
g AS (SELECT document, min(page) FILTER (mark = 2) AS t0, max(page) FILTER (mark = 2) AS t1, max(page) FILTER (lists) AS l1,
  min(page) FILTER (mark = 1) AS f0, max(page) FILTER (mark = 1) AS f1, max(page) AS n FROM p GROUP BY 1)
SELECT document, coalesce(t0, f0, 30) AS start_page, CASE WHEN t0 IS NOT NULL THEN greatest(t1, CASE WHEN l1 > t0 THEN l1 END) ELSE coalesce(f1, n) END AS end_page FROM g""")
def project_table_region(spark, sf_dir):
    """First and last page of the project table per document."""
    i = F.col("page_id")
    doc, slot = F.floor(i / 10) % 3, i % 10
    mark = (F.when((doc == 0) & slot.isin(2, 4), "All Ongoing Projects")
            .when((doc == 1) & slot.isin(3, 6), "Table 4").otherwise(""))
    text = F.concat(F.regexp_replace("html", r"(?i)table [46]", "table"), _T("\n"), mark, F.when(slot == 7, _T("\n 1 \n")).otherwise(""))
    pages = D.table(spark, sf_dir, "pages").select(F.floor(i / 10).alias("document"), (slot + 1).alias("page"), text.alias("text"))
    return L.locate_region(pages)


def report_words(spark, sf_dir):
    """Ten rows per page as positioned words, headings on some rows, a total after the last."""
    k, t = F.col("k"), _T
    row = k % 10
    y = (t(150) + row * 60).cast("double")
    word = lambda x, dy, text, when=None: F.when(
        t(True) if when is None else when,
        F.struct(t(float(x)).alias("x"), (y + dy).alias("y"), text.alias("text")))
    words = F.array(
        word(130, 0, _str(k % 40 + 1)),
        word(15, 1, F.concat(t("State"), _str(F.floor(k / 20) % 9)), k % 20 == 0),
        word(80, 1, t("TELECOMMUNI"), k % 10 == 0), word(80, 2, F.concat(t("SECTOR"), _str(k % 4)), k % 10 == 5),
        word(160, 0, t("Alpha")), word(200, 1, F.concat(t("road"), _str(k))),
        word(160, 10, F.concat(t("(AG"), _str(k % 7), t(")"))),
        word(160, 20, F.concat(t("(N"), F.lpad(_str(k), 8, "0"), t(")"))),
        word(300, 0, F.col("my")), word(340, 0, F.col("my")), word(340, 10, t("(Jan-2024)")), word(340, 20, t("{N.A.}")),
        word(425, 0, F.concat(t("1,"), F.col("n3"), t(".5"))), word(425, 10, t("(N.A.)")), word(425, 20, t("{7.25}")),
        word(500, 0, F.concat(F.col("n3"), t(".10"))), word(560, 0, _str(k % 101)),
        word(160, 40, t("Total"), row == 9), word(200, 41, t("junk"), row == 9))
    rows = _orders(spark, sf_dir).select(
        F.floor(k / 40).alias("document"), (F.floor(k % 40 / 10) + 1).alias("page"), k,
        F.posexplode(words).alias("_i", "w")).filter(F.col("w").isNotNull())
    return rows.select("document", "page", (F.col("k") % 10 * 100 + F.col("_i")).alias("word_no"), "w.*")


@query(f"""WITH {_ORDERS}, h AS (SELECT *, CASE WHEN k % 20 = 0 THEN 'State' || k // 20 % 9 END AS st,
    CASE WHEN k % 10 = 0 THEN 'TELECOMMUNICATIONS' WHEN k % 10 = 5 THEN 'SECTOR' || k % 4 END AS se FROM o)
SELECT k // 40 AS document, k % 40 // 10 + 1 AS source_page, k % 40 + 1 AS sl_no, 'N' || lpad(CAST(k AS VARCHAR), 8, '0') AS project_id,
  'Alpha road' || k AS project_name, 'AG' || k % 7 AS agency,
  last_value(st IGNORE NULLS) OVER w AS state, last_value(se IGNORE NULLS) OVER w AS sector, my AS approval_date,
  my AS original_completion_date, 'Jan-2024' AS revised_completion_date, '' AS anticipated_completion_date,
  '1' || n3 || '.5' AS original_cost_crore, '' AS revised_cost_crore, '7.25' AS anticipated_cost_crore,
  n3 || '.10' AS cumulative_expenditure_crore, CAST(k % 101 AS VARCHAR) AS physical_progress_pct
FROM h WINDOW w AS (PARTITION BY k // 40 ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""")
def parsed_words(spark, sf_dir):
    """Rows from positioned words, headings filled down, last code wins."""
    return W.parse_words(report_words(spark, sf_dir), "2025-06").drop("snapshot_date")


@query(f"""WITH {_ORDERS} SELECT k // 40 AS document, k % 40 // 10 + 1 AS page, k % 10 AS row_no, 'Alpha road' || k AS first_line, 3 AS line_count FROM o""")
def grouped_lines(spark, sf_dir):
    """Words of a block grouped to lines by their vertical distance."""
    block = report_words(spark, sf_dir).filter(F.col("x").between(155, 294) & ~F.col("text").isin("Total", "junk"))
    rows = block.withColumn("row_no", F.floor(F.col("word_no") / 100))
    lines = W.group_lines(rows, ["document", "page", "row_no"])
    return lines.groupBy("document", "page", "row_no").agg(
        F.min_by("line", "line_no").alias("first_line"), F.count("*").alias("line_count"))
