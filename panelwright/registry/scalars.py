"""Queries on column functions."""

from pyspark.sql import functions as F

from panelwright.functions import numeric as U
from panelwright.functions import periods as P
from panelwright.functions import text as X
from panelwright.plans import derived as D
from panelwright.registry import query
from panelwright.registry.sql import agency_ok, state_ok, tokens

_MONTHS = """forms AS (SELECT o_orderkey, o_orderdate, CASE o_orderkey % 7 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d')
    WHEN 1 THEN strftime(o_orderdate, '%Y-%m') WHEN 2 THEN month(o_orderdate) || '/' || year(o_orderdate)
    WHEN 3 THEN strftime(o_orderdate, '%m-%Y') WHEN 4 THEN strftime(o_orderdate, '%b-%Y') WHEN 5 THEN '(-)'
    ELSE 'week ' || day(o_orderdate) END AS raw FROM orders)"""


def month_forms(spark, sf_dir):
    """Order dates written in seven ways, two of them unreadable."""
    c, d = F.col("o_orderkey") % 7, F.col("o_orderdate")
    fmt = lambda f: F.date_format(d, f)
    raw = (F.when(c == 0, fmt("yyyy-MM-dd")).when(c == 1, fmt("yyyy-MM")).when(c == 2, fmt("M/yyyy"))
           .when(c == 3, fmt("MM-yyyy")).when(c == 4, fmt("MMM-yyyy")).when(c == 5, "(-)")
           .otherwise(F.concat(F.lit("week "), F.dayofmonth(d).cast("string"))))
    return D.table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate", raw.alias("raw"))


@query(f"WITH {_MONTHS} SELECT o_orderkey, CASE WHEN o_orderkey % 7 < 5 THEN strftime(o_orderdate, '%Y-%m') END AS strict, "
       "o_orderkey % 7 = 6 AS bad, CASE WHEN o_orderkey % 7 < 5 THEN strftime(o_orderdate, '%Y-%m') END AS period, "
       "CASE WHEN o_orderkey % 7 IN (1, 2, 3) THEN year(o_orderdate) * 12 + month(o_orderdate) - 1 END AS ym_index FROM forms")
def month_text(spark, sf_dir):
    """Strict and lenient months in many spellings."""
    return month_forms(spark, sf_dir).select(
        "o_orderkey", P.strict_month("raw").alias("strict"), F.coalesce(P.is_bad_month("raw"), F.lit(False)).alias("bad"),
        P.period("raw").alias("period"), P.month_index(P.year_month("raw")).cast("long").alias("ym_index"))


@query("""SELECT o_orderkey, strftime(o_orderdate + to_months(CAST(o_orderkey % 30 AS INTEGER)), '%Y-%m') AS later,
  strftime(date_trunc('month', o_orderdate) - INTERVAL 1 MONTH, '%Y-%m') AS previous,
  strftime(last_day(o_orderdate), '%Y-%m-%d') AS period_end,
  date_diff('month', date_trunc('month', o_orderdate), DATE '1999-03-01') AS distance,
  CASE WHEN o_orderkey % 3 = 0 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN o_orderkey % 3 = 1 THEN strftime(o_orderdate, '%Y-%m-01') END AS parsed,
  o_orderkey % 2 = 0 AS slashed FROM orders""")
def month_arithmetic(spark, sf_dir):
    """Month arithmetic, month ends, lenient dates, layout test."""
    k, d = F.col("o_orderkey"), F.col("o_orderdate")
    p = F.date_format(d, "yyyy-MM")
    raw = F.when(k % 3 == 0, F.date_format(d, "yyyy-MM-dd")).when(k % 3 == 1, F.date_format(d, "MM/yyyy")).otherwise("n.a.")
    layout = F.when(k % 2 == 0, F.date_format(d, "MM/yyyy")).otherwise(F.date_format(d, "yyyy/MM"))
    return D.table(spark, sf_dir, "orders").select(
        "o_orderkey", P.add_months(p, (k % 30).cast("int")).alias("later"), P.previous_month(p).alias("previous"),
        P.period_end(p).cast("string").alias("period_end"),
        P.month_distance(p, F.lit("1999-03")).cast("long").alias("distance"),
        P.parse_date(raw).cast("string").alias("parsed"), P.is_month_slash_year(layout).alias("slashed"))


@query(f"""WITH t AS (SELECT doc_id, text, {tokens('text')} AS toks FROM documents)
SELECT a.doc_id, len(a.toks) AS token_count, CASE WHEN NOT regexp_matches(a.text, '[^\\x00-\\x7F]') THEN array_to_string(list_sort(a.toks), ' ') END AS words,
  round(CASE WHEN len(a.toks) > 0 AND len(b.toks) > 0 THEN len(list_intersect(a.toks, b.toks)) /
    (len(a.toks) + len(b.toks) - len(list_intersect(a.toks, b.toks))) ELSE 0 END, 6) AS similarity
FROM t a JOIN t b ON b.doc_id = a.doc_id + 1""")
def token_similarity(spark, sf_dir):
    """Token sets of whole texts and their Jaccard with the next document."""
    t = D.table(spark, sf_dir, "documents").select("doc_id", "text", X.title_tokens("text").alias("toks"))
    nxt = t.select((F.col("doc_id") - 1).alias("doc_id"), F.col("toks").alias("other"))
    ascii_only = ~F.col("text").rlike(r"[^\x00-\x7F]")
    return t.join(nxt, "doc_id").select(
        "doc_id", F.size("toks").cast("long").alias("token_count"),
        F.when(ascii_only, F.array_join(F.sort_array("toks"), " ")).alias("words"),
        F.round(X.jaccard("toks", "other"), 6).alias("similarity"))


_PLACES = """places AS (SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN 'Multi-States, ' || o_orderpriority WHEN 1 THEN '' WHEN 2 THEN 'Pan India' ELSE o_orderpriority END AS s1,
    CASE o_orderkey % 3 WHEN 0 THEN 'States: ' || o_orderpriority WHEN 1 THEN '4-NOT SPECIFIED' ELSE 'Pan India' END AS s2,
    CASE o_orderkey % 4 WHEN 0 THEN 'National Board [NB' || o_orderstatus || ']' WHEN 1 THEN '' ELSE 'Agency ' || o_orderstatus || ' (AX)' END AS a1,
    CASE o_orderkey % 3 WHEN 0 THEN 'Board of NB' || o_orderstatus WHEN 1 THEN 'agency p (ax)' ELSE 'Other [Q]' END AS a2 FROM orders)"""


@query(f"WITH {_PLACES} SELECT o_orderkey, {state_ok('s1', 's2')} AS states_fit, {agency_ok('a1', 'a2')} AS agencies_fit FROM places")
def compatibility(spark, sf_dir):
    """State and agency compatibility."""
    k, pr, st = F.col("o_orderkey"), F.col("o_orderpriority"), F.col("o_orderstatus")
    t = F.lit
    s1 = F.when(k % 5 == 0, F.concat(t("Multi-States, "), pr)).when(k % 5 == 1, "").when(k % 5 == 2, "Pan India").otherwise(pr)
    s2 = F.when(k % 3 == 0, F.concat(t("States: "), pr)).when(k % 3 == 1, "4-NOT SPECIFIED").otherwise("Pan India")
    a1 = F.when(k % 4 == 0, F.concat(t("National Board [NB"), st, t("]"))).when(k % 4 == 1, "").otherwise(
        F.concat(t("Agency "), st, t(" (AX)")))
    a2 = F.when(k % 3 == 0, F.concat(t("Board of NB"), st)).when(k % 3 == 1, "agency p (ax)").otherwise("Other [Q]")
    return D.table(spark, sf_dir, "orders").select(
        "o_orderkey", X.states_compatible(s1, s2).alias("states_fit"), X.agencies_compatible(a1, a2).alias("agencies_fit"))


@query("""SELECT l_orderkey, l_linenumber, round(ln(1 + l_extendedprice), 6) AS log_price,
  round(CASE WHEN l_discount > 0 THEN l_extendedprice / l_discount END, 6) AS per_discount,
  round(l_discount * 100.0::DOUBLE - l_quantity, 6) AS gap,
  round(ln(greatest(1e-6, least(1 - 1e-6, l_quantity / 50)) / (1 - greatest(1e-6, least(1 - 1e-6, l_quantity / 50)))), 6) AS logit FROM lineitem""")
def numeric_features(spark, sf_dir):
    """Log, guarded ratio, points gap, clipped logit."""
    return D.table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", F.round(U.log_cost("l_extendedprice"), 6).alias("log_price"),
        F.round(U.ratio("l_extendedprice", "l_discount"), 6).alias("per_discount"),
        F.round(U.gap_to_progress("l_discount", "l_quantity"), 6).alias("gap"),
        F.round(U.logit(F.col("l_quantity") / 50), 6).alias("logit"))


@query("""WITH f AS (SELECT doc_id, CAST((n_chars % 1000) AS DOUBLE) / 7 AS x, doc_id % 6 AS k FROM documents)
SELECT doc_id, CASE k WHEN 0 THEN printf('Financial expenditure ratio diverges from physical progress by %+.1f%% points.', x - 50)
  WHEN 1 THEN printf('Project age was %.0f months since approval as of July 2025.', x)
  WHEN 2 THEN printf('Original sanctioned project cost was ₹%.2f crore.', x)
  WHEN 3 THEN 'feat_project_age_months value is unobserved or missing in PIT record.'
  WHEN 4 THEN printf('Cumulative expenditure reached %.1f%% of original sanctioned budget.', x * 100)
  ELSE 'Original completion date had passed as of July 2025 cutoff.' END AS fact FROM f""")
def source_facts(spark, sf_dir):
    """Feature values in words."""
    x, k = (F.col("n_chars") % 1000) / F.lit(7.0), F.col("doc_id") % 6
    names = ["feat_physical_vs_financial_divergence", "feat_project_age_months", "feat_original_cost_crore",
             "feat_project_age_months", "feat_expenditure_to_original_cost_ratio", "feat_is_past_original_completion"]
    name = F.array(*[F.lit(n) for n in names])[k.cast("int")]
    value = F.when(k == 0, x - 50).when(k == 3, F.lit(None)).when(k == 5, F.lit(1.0)).otherwise(x).cast("string")
    df = D.table(spark, sf_dir, "documents").select("doc_id", name.alias("feature"), value.alias("value"))
    return df.select("doc_id", X.source_fact("feature", "value", "July 2025").alias("fact"))


@query("SELECT doc_id FROM documents WHERE contains(lower(text), 'tion') OR contains(lower(source), 'tion') OR contains(lower(lang), 'tion')")
def substring_search(spark, sf_dir):
    """Case-insensitive search over several columns, whole texts."""
    return D.table(spark, sf_dir, "documents").filter(X.contains_any(["text", "source", "lang"], "TION")).select("doc_id")


@query("SELECT o_orderpriority, CASE o_orderpriority WHEN '1-URGENT' THEN 'urgent' WHEN '5-LOW' THEN 'low' ELSE o_orderpriority END AS served, "
       "CASE WHEN starts_with(o_orderpriority, '4-NOT') THEN 'UNSPECIFIED' ELSE o_orderpriority END AS expanded, count(*) AS n FROM orders GROUP BY ALL")
def relabelled(spark, sf_dir):
    """Relabelling and expansion of truncated values."""
    df = D.table(spark, sf_dir, "orders").withColumns({
        "served": X.relabel("o_orderpriority", {"1-URGENT": "urgent", "5-LOW": "low"}),
        "expanded": X.expand_truncated("o_orderpriority", {"4-NOT": "UNSPECIFIED"})})
    return df.groupBy("o_orderpriority", "served", "expanded").agg(F.count("*").alias("n"))
