"""Queries that check snapshot tables, and table writers' building blocks."""

import uuid

from pyspark.sql import functions as F

from panelwright.functions.numeric import number
from panelwright.operators import snapshots as V
from panelwright.operators.quality import ISSUE_SCHEMA
from panelwright.plans import derived as D
from panelwright.registry import query
from panelwright.registry.sql import CANONICAL, RAW
from panelwright.session import checkpoint_dir
from panelwright.sources import sinks

# The three raw layouts under their shared columns, with planted gaps and clashes.
_ALL = ["source_page", "sl_no", "project_id", "project_name", "agency", "state", "approval_date",
        "original_completion_date", "revised_completion_date", "original_cost_crore", "revised_cost_crore",
        "cumulative_expenditure_crore", "physical_progress_pct"]
_DIRTY_SQL = RAW + f""",
dirty AS (SELECT source_page, CASE WHEN CAST(sl_no AS BIGINT) % 90 = 0 THEN '7' ELSE sl_no END AS sl_no,
    CASE WHEN CAST(sl_no AS BIGINT) % 31 = 0 THEN sl_no ELSE project_id END AS project_id, project_name,
    CASE WHEN CAST(sl_no AS BIGINT) % 37 = 0 THEN '' ELSE agency END AS agency,
    CASE WHEN CAST(sl_no AS BIGINT) % 41 = 0 THEN '12' WHEN CAST(sl_no AS BIGINT) % 43 = 0 THEN '' WHEN CAST(sl_no AS BIGINT) % 47 = 0 THEN 'Multi-States (A, B)' ELSE state END AS state,
    CASE WHEN CAST(sl_no AS BIGINT) % 29 = 0 THEN '' ELSE approval_date END AS approval_date, original_completion_date, revised_completion_date,
    original_cost_crore, revised_cost_crore, cumulative_expenditure_crore, physical_progress_pct FROM raw_late)"""


def dirty(spark, sf_dir):
    """The latest raw snapshot with one kind of defect per residue of the serial."""
    df = D.raw_snapshots(spark, sf_dir)[2][0].select(*_ALL)
    s = F.col("sl_no").cast("long")
    every = lambda n: s % n == 0
    return df.select(
        "source_page", F.when(every(90), "7").otherwise(F.col("sl_no")).alias("sl_no"),
        F.when(every(31), F.col("sl_no")).otherwise(F.col("project_id")).alias("project_id"), "project_name",
        F.when(every(37), "").otherwise(F.col("agency")).alias("agency"),
        F.when(every(41), "12").when(every(43), "").when(every(47), "Multi-States (A, B)").otherwise(F.col("state")).alias("state"),
        F.when(every(29), "").otherwise(F.col("approval_date")).alias("approval_date"), *_ALL[7:])


@query(f"""WITH {_DIRTY_SQL}, s AS (SELECT CAST(sl_no AS BIGINT) AS s, count(*) AS n FROM dirty GROUP BY 1)
SELECT CAST(sum(n) AS BIGINT) AS row_count, count(*) AS distinct_serials, min(s) AS min_serial, max(s) AS max_serial,
  count(*) FILTER (n > 1) AS duplicate_serials, max(s) - count(*) FILTER (s >= 1) AS missing_serials FROM s""")
def serial_continuity(spark, sf_dir):
    """Serials seen, repeated and missing."""
    return V.serial_continuity(dirty(spark, sf_dir))


@query(f"""WITH {_DIRTY_SQL}, p AS (SELECT project_id, count(*) AS n FROM dirty GROUP BY 1)
SELECT (SELECT count(*) FROM p WHERE n > 1) AS duplicate_ids, count(*) FILTER (project_id = sl_no) AS id_equals_serial,
  count(*) FILTER (NOT regexp_full_match(project_id, '[0-9]+')) AS non_numeric_ids FROM dirty""")
def id_checks(spark, sf_dir):
    """Repeated ids, ids equal to serials, ids that are no number."""
    return V.id_checks(dirty(spark, sf_dir))


@query(f"""WITH {_DIRTY_SQL}, tall AS (SELECT CAST(sl_no AS BIGINT) AS s, unnest(['state', 'agency', 'approval_date']) AS field,
  unnest([state, agency, approval_date]) AS v FROM dirty)
SELECT field, s AS serial, count(*) OVER (PARTITION BY field) AS missing FROM tall WHERE v = ''""")
def missing_fields(spark, sf_dir):
    """Every serial with a blank field, and the blank counts."""
    return V.missing_fields(dirty(spark, sf_dir), ["state", "agency", "approval_date"])


_N = "CAST(nullif({}, '') AS DOUBLE)"
_O, _R, _S = (_N.format(c) for c in ("original_cost_crore", "revised_cost_crore", "cumulative_expenditure_crore"))


@query(f"WITH {RAW} " + " UNION ALL ".join(
    f"SELECT '{k}' AS \"check\", count(*) FILTER ({c}) AS violations FROM raw_late" for k, c in {
        "revised_below_original": f"{_R} < {_O}", "revised_above_original": f"{_R} > {_O}",
        "revised_equals_original": f"{_R} = {_O}", "spend_above_revised": f"{_S} > {_R}",
        "spend_above_original": f"{_S} > {_O}"}.items()))
def cross_field_anomalies(spark, sf_dir):
    """Cost and spend anomalies."""
    return V.cross_field_anomalies(D.raw_snapshots(spark, sf_dir)[2][0])


_TALLY = ("SELECT '{c}' AS column_name, count(*) FILTER ({c} = '' OR regexp_full_match({c}, '[0-9]{{2}}/[0-9]{{4}}')) AS valid, "
          "count(*) FILTER ({c} IN ('(-)', '-')) AS dash, count(*) FILTER ({c} = '') AS blank, "
          "count(*) FILTER (NOT ({c} = '' OR regexp_full_match({c}, '[0-9]{{2}}/[0-9]{{4}}')) AND {c} NOT IN ('(-)', '-')) AS malformed FROM dirty")
_DATES = ["approval_date", "original_completion_date", "revised_completion_date"]


@query(f"WITH {_DIRTY_SQL} " + " UNION ALL ".join(_TALLY.format(c=c) for c in _DATES))
def date_tallies(spark, sf_dir):
    """Valid, dash, blank and malformed dates."""
    return V.date_tallies(dirty(spark, sf_dir), _DATES)


@query(f"""WITH {_DIRTY_SQL} SELECT 'source_page_outside' AS "check", count(*) FILTER (CAST(source_page AS INTEGER) NOT BETWEEN 2 AND 30) AS violations FROM dirty
UNION ALL SELECT 'physical_progress_pct_outside', count(*) FILTER (CAST(nullif(physical_progress_pct, '') AS DOUBLE) NOT BETWEEN 5 AND 60) FROM dirty
UNION ALL SELECT 'state_numeric', count(*) FILTER (regexp_full_match(state, '[0-9]+')) FROM dirty""")
def range_checks(spark, sf_dir):
    """Page bounds and numeric-looking categories."""
    return V.range_checks(dirty(spark, sf_dir), {"source_page": (2, 30), "physical_progress_pct": (5, 60)}, ["state"])


_M = "CAST(nullif({}, '') AS DECIMAL(18,2))"
_MO, _MR, _ME = (_M.format(c) for c in ("original_cost_crore", "revised_cost_crore", "cumulative_expenditure_crore"))
_OFFICIAL = {"original_cost": "1000000.00", "revised_or_original_cost": "1200000.00", "expenditure": "500000.00"}


@query(f"WITH {RAW}, t AS (" + " UNION ALL ".join(
    f"SELECT '{k}' AS measure, sum({e}) AS actual, CAST({_OFFICIAL[k]} AS DECIMAL(18,2)) AS official FROM raw_late" for k, e in {
        "original_cost": _MO, "revised_or_original_cost": f"coalesce({_MR}, {_MO})", "expenditure": _ME}.items())
    + ") SELECT measure, CAST(actual AS VARCHAR) AS actual, CAST(official AS VARCHAR) AS official, "
      "CAST(actual - official AS VARCHAR) AS difference, abs(actual - official) <= 0.01 AS matches FROM t")
def totals_reconciliation(spark, sf_dir):
    """Exact decimal totals against official ones."""
    out = V.totals_reconciliation(D.raw_snapshots(spark, sf_dir)[2][0], _OFFICIAL)
    return out.withColumns({c: F.col(c).cast("string") for c in ("actual", "official", "difference")})


_EXPECTED = {"rows": 600, "blank_revised": 100, "progress_missing": 40}


@query(f"WITH {RAW}, t AS (SELECT count(*) AS a, count(*) FILTER (revised_cost_crore = '') AS b, "
       "count(*) FILTER (physical_progress_pct = '') AS c FROM raw_late) " + " UNION ALL ".join(
           f"SELECT '{k}' AS measure, {c} AS actual, {_EXPECTED[k]} AS expected, {c} = {_EXPECTED[k]} AS matches FROM t"
           for k, c in zip(_EXPECTED, "abc")))
def count_expectations(spark, sf_dir):
    """Exact counts against expectations."""
    blank = lambda c: F.count_if(F.col(c) == "")
    measures = {"rows": F.count("*"), "blank_revised": blank("revised_cost_crore"),
                "progress_missing": blank("physical_progress_pct")}
    return V.expectations(D.raw_snapshots(spark, sf_dir)[2][0], measures, _EXPECTED)


_VOCAB = {"lang": ["en", "fr"], "source": [f"src{i}" for i in range(5)]}


@query(" UNION ALL ".join(
    f"SELECT '{c}' AS column_name, {c} AS value, count(*) AS row_count FROM documents WHERE {c} NOT IN ({', '.join(repr(x) for x in v)}) GROUP BY {c}"
    for c, v in _VOCAB.items()))
def vocabulary_violations(spark, sf_dir):
    """Values outside closed vocabularies."""
    return V.vocabulary_violations(D.table(spark, sf_dir, "documents"), _VOCAB)


@query("SELECT count(*) FILTER (l.doc_id IS NULL) AS only_left, count(*) FILTER (d.doc_id IS NULL) AS only_right, "
       "count(*) FILTER (l.doc_id IS NOT NULL AND d.doc_id IS NOT NULL) AS both FROM documents d FULL JOIN labels l USING (doc_id)")
def key_alignment(spark, sf_dir):
    """Keys of two tables against each other."""
    return V.key_alignment(D.table(spark, sf_dir, "documents"), D.table(spark, sf_dir, "labels"), "doc_id")


@query(f"""WITH {RAW}, both_ AS (SELECT e.project_id, e.state AS es, l.state AS ls, e.agency AS ea, l.agency AS la
  FROM raw_early e LEFT JOIN raw_late l ON l.project_id = e.project_id)
SELECT project_id, 'state' AS column_name, es AS expected, ls AS actual FROM both_ WHERE es IS DISTINCT FROM ls
UNION ALL SELECT project_id, 'agency', ea, la FROM both_ WHERE ea IS DISTINCT FROM la""")
def spot_checks(spark, sf_dir):
    """Expected cells (the earlier snapshot) against actual ones."""
    raws = D.raw_snapshots(spark, sf_dir)
    return V.spot_checks(raws[2][0], raws[1][0].select("project_id", "state", "agency"), "project_id", ["state", "agency"])


_FIRST = "SELECT '{k}' AS category, CAST(sl_no AS BIGINT) AS serial, project_id, project_name FROM raw_late WHERE {c} ORDER BY CAST(sl_no AS BIGINT) LIMIT 1"


@query(f"WITH {RAW} " + " UNION ALL ".join("(" + _FIRST.format(k=k, c=c) + ")" for k, c in {
    "normal": "TRUE", "unrevised_completion": "revised_completion_date IN ('(-)', '-')",
    "revised_cost_differs": f"{_R} <> {_O}", "multi_state": "contains(state, 'Multi-States')",
    "blank_approval": "approval_date = ''", "blank_state": "state = ''"}.items())
    + " UNION ALL (SELECT 'longest_name', CAST(sl_no AS BIGINT), project_id, project_name FROM raw_late "
      "ORDER BY length(project_name) DESC, CAST(sl_no AS BIGINT) LIMIT 1)")
def representatives(spark, sf_dir):
    """One sample row per audit category."""
    return V.representatives(D.raw_snapshots(spark, sf_dir)[2][0])


_UNAVAILABLE = {"1998-06": ["start_date_raw"], "1998-07": ["start_date_raw", "sector"], "1999-07": ["sector"]}


def _class_sql(c):
    absent = [s for s, cols in _UNAVAILABLE.items() if c in cols]
    test = f"source_snapshot IN ({', '.join(repr(s) for s in absent)})" if absent else "FALSE"
    return (f"SELECT source_snapshot AS source, '{c}' AS column_name, CASE WHEN {test} THEN 'UNAVAILABLE' "
            f"WHEN {c} IN ('(-)', '-') THEN 'UNREVISED' WHEN {c} IS NULL OR upper({c}) IN ('', 'NA', 'N.A.') THEN 'GENUINELY_MISSING' "
            f"ELSE 'PRESENT' END AS missing_class, count(*) AS row_count FROM canonical GROUP BY ALL")


_CLASSED = ["start_date_raw", "sector", "revised_completion_date_raw", "approval_date_raw", "state"]


@query(f"WITH {CANONICAL} " + " UNION ALL ".join(_class_sql(c) for c in _CLASSED))
def missing_class(spark, sf_dir):
    """Why a value is missing."""
    return V.missing_class(D.canonical(spark, sf_dir), _CLASSED, _UNAVAILABLE)


@query(f"""WITH {CANONICAL} SELECT 'key_missing' AS "check", 0 AS violations UNION ALL SELECT 'provenance_incomplete', 0
UNION ALL SELECT 'snapshot_date_unknown', count(*) FILTER (snapshot_date NOT IN ('1998-06-30', '1998-07-31')) FROM canonical
UNION ALL SELECT 'month_layout', 0
UNION ALL SELECT 'zero_filled_cost', count(*) FILTER (CAST(original_cost_crore AS DOUBLE) = 0 OR CAST(anticipated_cost_crore AS DOUBLE) = 0) FROM canonical
UNION ALL SELECT 'duplicate_keys', 0""")
def canonical_gates(spark, sf_dir):
    """Gates of the canonical table."""
    return V.canonical_gates(D.canonical(spark, sf_dir), ["1998-06-30", "1998-07-31"])


# --- writers' building blocks ---------------------------------------------------------------------


@query("SELECT count(*) AS row_count, CAST(sum(CAST('0x' || substr(md5(concat_ws('|', CAST(l_orderkey AS VARCHAR), "
       "CAST(l_partkey AS VARCHAR), CAST(l_suppkey AS VARCHAR), CAST(l_linenumber AS VARCHAR), CAST(l_quantity AS VARCHAR), "
       "CAST(l_extendedprice AS VARCHAR), CAST(l_discount AS VARCHAR), CAST(l_tax AS VARCHAR), l_returnflag, l_linestatus, "
       "CAST(l_shipdate AS VARCHAR))), 1, 13) AS BIGINT)) AS VARCHAR) AS content_hash FROM lineitem")
def table_fingerprint(spark, sf_dir):
    """IO9: order-insensitive count and content hash of all columns."""
    return V.fingerprint(D.table(spark, sf_dir, "lineitem"))


def _manifest(spark, sf_dir):
    """One entry per order month and priority, some with a filled address."""
    o = D.table(spark, sf_dir, "orders").select(
        F.date_format("o_orderdate", "yyyy-MM").alias("reporting_period"), F.col("o_orderpriority").alias("source_type"))
    counted = o.groupBy("reporting_period", "source_type").agg(F.count("*").alias("n"))
    return counted.select("reporting_period", "source_type",
                          F.when(F.col("n") % 3 == 0, F.concat(F.lit("u"), F.col("n"))).otherwise("").alias("source_url"),
                          F.lit("NEW").alias("download_status"), F.col("n").cast("string").alias("notes"))


_MANIFEST = """m AS (SELECT strftime(o_orderdate, '%Y-%m') AS reporting_period, o_orderpriority AS source_type, count(*) AS n
  FROM orders GROUP BY 1, 2),
stored AS (SELECT reporting_period, source_type, CASE WHEN n % 3 = 0 THEN 'u' || n ELSE '' END AS source_url, 'NEW' AS download_status,
  CAST(n AS VARCHAR) AS notes FROM m WHERE reporting_period < '1998-01'),
fresh AS (SELECT reporting_period, source_type, 'w' AS source_url, 'ACQUIRED' AS download_status FROM m WHERE reporting_period >= '1997-06')"""


@query(f"""WITH {_MANIFEST}
SELECT coalesce(s.reporting_period, f.reporting_period) AS reporting_period, coalesce(s.source_type, f.source_type) AS source_type,
  CASE WHEN f.source_type IS NULL THEN s.source_url ELSE coalesce(nullif(s.source_url, ''), f.source_url) END AS source_url,
  coalesce(f.download_status, s.download_status) AS download_status, s.notes
FROM stored s FULL JOIN fresh f ON s.reporting_period = f.reporting_period AND s.source_type = f.source_type""")
def manifest_upsert(spark, sf_dir):
    """IO7: update else insert, a filled address stays."""
    m = _manifest(spark, sf_dir)
    fresh = m.filter(F.col("reporting_period") >= "1997-06").select(
        "reporting_period", "source_type", F.lit("w").alias("source_url"), F.lit("ACQUIRED").alias("download_status"))
    return sinks.upsert(m.filter(F.col("reporting_period") < "1998-01"), fresh, ["reporting_period", "source_type"])


@query(f"""WITH {_MANIFEST} SELECT * FROM stored WHERE reporting_period < '1997-06'
UNION ALL SELECT reporting_period, source_type, source_url, download_status, 'x' FROM fresh""")
def manifest_replace(spark, sf_dir):
    """IO7: whole rows replaced."""
    m = _manifest(spark, sf_dir)
    fresh = m.filter(F.col("reporting_period") >= "1997-06").select(
        "reporting_period", "source_type", F.lit("w").alias("source_url"), F.lit("ACQUIRED").alias("download_status"),
        F.lit("x").alias("notes"))
    return sinks.replace_rows(m.filter(F.col("reporting_period") < "1998-01"), fresh, ["reporting_period", "source_type"])


# --- publishing -------------------------------------------------------------------------------------


def _shelf(spark):
    return f"{checkpoint_dir(spark)}/published/{uuid.uuid4().hex}"


@query(f"""WITH {_MANIFEST} SELECT reporting_period, source_type, CASE WHEN n % 3 = 0 THEN 'u' || n ELSE '' END AS source_url,
  'NEW' AS download_status, CAST(n AS VARCHAR) AS notes FROM m""")
def promoted_table(spark, sf_dir):
    """IO8: a table written, verified, published twice (once from itself) and read back."""
    path, clean = _shelf(spark), spark.createDataFrame([], ISSUE_SCHEMA)
    first = sinks.promote(_manifest(spark, sf_dir), clean, path)
    sinks.promote(first, clean, path)
    return spark.read.parquet(sinks.published(spark, path))


@query("SELECT CAST(o_custkey AS VARCHAR) AS canonical_project_key, count(*) AS orders, c_name AS project_name "
       "FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL")
def seeded_tables(spark, sf_dir):
    """IO6: parent and child loaded as one version and read back."""
    key = lambda c: F.col(c).cast("string").alias("canonical_project_key")
    orders = D.table(spark, sf_dir, "orders").groupBy(key("o_custkey")).agg(F.count("*").alias("orders"))
    projects = D.table(spark, sf_dir, "customer").select(key("c_custkey"), F.col("c_name").alias("project_name"))
    path = _shelf(spark)
    sinks.seed_tables({"projects": projects, "orders": orders}, path, "v1")
    stored = sinks.open_tables(spark, path, ["projects", "orders"])
    return stored["orders"].join(stored["projects"], "canonical_project_key")
