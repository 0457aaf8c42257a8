"""Common table expressions shared by the comparison SQL."""


def panel(dense=True) -> str:
    """CTE list ending in ``panel``."""
    prefix, key = ("S", "l_suppkey") if dense else ("P", "l_partkey")
    places = """,
places AS (SELECT s_suppkey AS id, s_name AS agency, n_name AS state, r_name AS sector
  FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""
    extra = """, state, agency, sector, 'Ministry of ' || sector AS line_ministry, 'Works of ' || agency AS project_name
  FROM bare LEFT JOIN places USING (id)"""
    return f"""cells AS (
  SELECT '{prefix}' || {key} AS project_code, {key} AS id,
         CAST(year(l_shipdate) * 12 + month(l_shipdate) - 1 AS BIGINT) AS idx,
         sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS price,
         sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS ret
  FROM lineitem GROUP BY 1, 2, 3),
running AS (
  SELECT project_code, id, idx, sum(price) OVER w AS spend, CAST(sum(ret) OVER w AS BIGINT) AS cum_ret,
         count(*) OVER w AS k, sum(price) OVER (PARTITION BY project_code) AS total,
         min(idx) OVER (PARTITION BY project_code) AS first_idx
  FROM cells
  WINDOW w AS (PARTITION BY project_code ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
priced AS (
  SELECT *, CAST(round(CAST(total AS DECIMAL(18,2)) * CAST(0.8 AS DECIMAL(2,1)), 2) AS DECIMAL(18,2)) AS orig,
         make_date(first_idx // 12, first_idx % 12 + 1, 1) AS first_day
  FROM running),
dated AS (SELECT *, CAST(first_day + to_months(CAST(24 + id % 36 AS INTEGER)) AS DATE) AS end_day FROM priced),
bare AS (
  SELECT project_code, printf('%04d-%02d', idx // 12, idx % 12 + 1) AS reporting_period, id, idx,
         CAST(orig AS DOUBLE) AS original_cost_cr,
         CASE WHEN cum_ret % 7 = 0 THEN NULL WHEN cum_ret % 7 = 1 THEN 0.0
              ELSE CAST(round(CAST(orig * CAST(1000 + cum_ret AS DECIMAL(9,0)) AS DECIMAL(38,2)) * CAST(0.001 AS DECIMAL(4,3)), 2) AS DOUBLE)
         END AS revised_cost_cr,
         CAST(spend AS DOUBLE) AS expenditure_cr,
         CASE WHEN (id + idx) % 17 <> 0 THEN least(100.0::DOUBLE, round(100.0::DOUBLE * k / 60, 2)) END AS physical_progress_pct,
         CASE WHEN id % 11 <> 0 THEN strftime(first_day, '%Y-%m-%d') END AS start_date,
         strftime(end_day, '%Y-%m-%d') AS original_end_date,
         CASE WHEN cum_ret % 5 <> 0 THEN strftime(end_day + CAST(cum_ret AS INTEGER), '%Y-%m-%d') END AS revised_end_date
  FROM dated){places if dense else ''},
panel AS (SELECT project_code, reporting_period, idx, {'bare.id' if dense else 'id'} AS id, original_cost_cr, revised_cost_cr,
         expenditure_cr, physical_progress_pct, start_date, original_end_date, revised_end_date
         {extra if dense else ' FROM bare'})"""


# Typed panel with previous-month columns and the thirteen features.
FEATURES = """typed AS (
  SELECT *, CASE WHEN revised_cost_cr > 0 THEN revised_cost_cr ELSE original_cost_cr END AS eff_cost,
         CAST(coalesce(revised_end_date, original_end_date) AS DATE) AS eff_end,
         CAST(original_end_date AS DATE) AS o_end, CAST(start_date AS DATE) AS s_day,
         last_day(CAST(reporting_period || '-01' AS DATE)) AS p_end
  FROM panel),
featured AS (
  SELECT t.*,
    CASE WHEN t.original_cost_cr > 0 THEN greatest(t.eff_cost, t.original_cost_cr) / t.original_cost_cr END AS cost_growth_ratio,
    CASE WHEN t.original_cost_cr > 0 THEN t.expenditure_cr / t.original_cost_cr END AS expenditure_to_original_cost,
    CASE WHEN greatest(t.eff_cost, t.original_cost_cr) > 0 THEN t.expenditure_cr / greatest(t.eff_cost, t.original_cost_cr) END AS expenditure_to_revised_cost,
    CAST(CASE WHEN t.o_end IS NOT NULL THEN greatest(0, date_diff('day', t.o_end, t.eff_end)) END AS DOUBLE) AS schedule_slippage_days,
    CAST(date_diff('day', t.s_day, t.p_end) AS DOUBLE) AS project_age_days,
    date_diff('day', t.s_day, t.p_end) / CAST(CASE WHEN t.s_day IS NOT NULL THEN greatest(1, date_diff('day', t.s_day, t.o_end)) END AS DOUBLE) AS elapsed_duration_ratio,
    t.eff_cost - coalesce(p.revised_cost_cr, p.original_cost_cr) AS recent_cost_change,
    t.expenditure_cr - p.expenditure_cr AS recent_expenditure_change,
    t.physical_progress_pct - p.physical_progress_pct AS recent_progress_change,
    CAST(date_diff('day', p.eff_end, t.eff_end) AS DOUBLE) AS recent_schedule_change,
    CASE WHEN p.project_code IS NULL THEN 1 ELSE 0 END AS is_first_observation
  FROM typed t LEFT JOIN typed p ON p.project_code = t.project_code AND p.idx = t.idx - 1),
features AS (
  SELECT *, CASE WHEN elapsed_duration_ratio IS NOT NULL
                 THEN greatest(0.0::DOUBLE, least(100.0::DOUBLE, elapsed_duration_ratio * 100.0::DOUBLE)) END - physical_progress_pct AS progress_gap,
         expenditure_to_revised_cost * 100.0::DOUBLE - physical_progress_pct AS expenditure_progress_gap
  FROM featured)"""


def targets(horizons) -> str:
    """CTE ``targets`` over ``typed`` for the given horizons."""
    joins, cols = [], []
    for h in horizons:
        f = f"f{h}"
        joins.append(f"LEFT JOIN typed {f} ON {f}.project_code = t.project_code AND {f}.idx = t.idx + {h}")
        then = (f"(CASE WHEN {f}.revised_cost_cr > 0 THEN {f}.revised_cost_cr WHEN {f}.original_cost_cr > 0 "
                f"THEN {f}.original_cost_cr ELSE t.original_cost_cr END)")
        cost = f"(CASE WHEN {f}.project_code IS NOT NULL AND t.original_cost_cr > 0 THEN greatest(0.0::DOUBLE, {then} - greatest(t.eff_cost, t.original_cost_cr)) END)"
        slip = f"(CASE WHEN {f}.project_code IS NOT NULL THEN CAST(greatest(0, date_diff('day', t.eff_end, {f}.eff_end)) AS DOUBLE) END)"
        due = f"last_day(CAST(t.reporting_period || '-01' AS DATE) + INTERVAL {h} MONTH)"
        cols.append(f"""
    {cost} AS target_cost_escalation_{h}m_cr, {cost} / t.original_cost_cr AS target_cost_escalation_pct_{h}m,
    CAST({cost} / t.original_cost_cr > 0.05 AS INTEGER) AS target_cost_overrun_{h}m_binary,
    {slip} AS target_schedule_slippage_{h}m_days,
    CAST({slip} > 0 AS INTEGER) AS target_schedule_deterioration_{h}m_binary,
    CASE WHEN {f}.project_code IS NOT NULL AND t.eff_end <= {due} THEN CAST({f}.physical_progress_pct < 100 AS INTEGER) END AS target_horizon_miss_{h}m_binary,
    CAST({cost} IS NOT NULL AS INTEGER) AS is_observable_cost_{h}m,
    CAST({slip} IS NOT NULL AS INTEGER) AS is_observable_schedule_{h}m,
    CAST({cost} IS NOT NULL AND {slip} IS NOT NULL AS INTEGER) AS is_observable_{h}m""")
    return f"targets AS (SELECT t.project_code, t.reporting_period,{','.join(cols)}\n  FROM typed t {' '.join(joins)})"


def rounded(columns, digits=6, prefix="") -> str:
    return ", ".join(f"round({prefix}{c}, {digits}) AS {c}" for c in columns)


PORTFOLIO = """portfolio AS (
  SELECT 'DOC-' || d.doc_id AS canonical_project_key, d.lang, d.source, l.quality, l.toxic,
         CAST((d.n_chars * 7919) % 1001 AS DOUBLE) / 1000 AS cost_risk_probability,
         CASE WHEN l.toxic IS NOT NULL THEN CAST((d.doc_id * 104729 + 37) % 1001 AS DOUBLE) / 1000 END AS schedule_risk_probability
  FROM documents d LEFT JOIN labels l USING (doc_id))"""

PREDICTIONS = PORTFOLIO + """,
predictions AS (
  SELECT canonical_project_key, lang, 'cost_overrun' AS task, quality AS y, cost_risk_probability AS p
  FROM portfolio WHERE toxic IS NOT NULL
  UNION ALL
  SELECT canonical_project_key, lang, 'schedule_slippage', toxic, schedule_risk_probability
  FROM portfolio WHERE toxic IS NOT NULL)"""

SCORED = """combined AS (
  SELECT *, CASE WHEN schedule_risk_probability IS NULL THEN 'PARTIAL' ELSE 'FULL' END AS risk_coverage,
         greatest(cost_risk_probability, schedule_risk_probability) AS attention_score,
         CASE WHEN schedule_risk_probability IS NOT NULL THEN least(cost_risk_probability, schedule_risk_probability) END AS compound_exposure
  FROM portfolio),
cuts AS (SELECT quantile_cont(attention_score, 0.5) AS q50, quantile_cont(attention_score, 0.75) AS q75,
                quantile_cont(attention_score, 0.9) AS q90 FROM combined),
scores AS (
  SELECT combined.*,
         CASE WHEN attention_score >= q90 THEN 'Tier 1' WHEN attention_score >= q75 THEN 'Tier 2'
              WHEN attention_score >= q50 THEN 'Tier 3' ELSE 'Tier 4' END AS attention_tier,
         rank() OVER (ORDER BY attention_score DESC) AS portfolio_rank
  FROM combined, cuts)"""

COHORT = """cohort AS (
  SELECT *, cost_share * 100.0::DOUBLE - feat_physical_progress_pct AS feat_physical_vs_financial_divergence,
         cost_share AS feat_expenditure_to_original_cost_ratio
  FROM (
    SELECT 'DOC-' || doc_id AS canonical_project_key, CAST(doc_id AS VARCHAR) AS source_project_id,
           'Work ' || doc_id || ' ' || lang AS project_name, lang AS feat_state, source AS feat_agency,
           ln(1 + CAST(n_chars AS DOUBLE) / 100) AS feat_log_original_cost,
           CAST(n_chars AS DOUBLE) / 100 AS feat_original_cost_crore,
           CAST(n_chars * (doc_id % 13) AS DOUBLE) / 1000 AS feat_cumulative_expenditure_crore,
           CASE WHEN n_chars > 0 THEN (CAST(n_chars * (doc_id % 13) AS DOUBLE) / 1000) / (CAST(n_chars AS DOUBLE) / 100) END AS cost_share,
           CAST((doc_id * 37) % 101 AS DOUBLE) AS feat_physical_progress_pct,
           CASE WHEN doc_id % 11 <> 0 THEN CAST(doc_id % 120 AS DOUBLE) END AS feat_project_age_months,
           CAST(doc_id % 11 = 0 AS INTEGER) AS feat_is_missing_approval_date,
           CAST(doc_id % 61 - 30 AS DOUBLE) AS feat_remaining_original_duration_months,
           CAST(doc_id % 61 - 30 < 0 AS INTEGER) AS feat_is_past_original_completion,
           CAST(n_chars + (doc_id % 97) * 40 > 3000 AS INTEGER) AS cost_overrun, toxic AS time_overrun,
           1 AS is_eligible_cost_target, CAST(toxic IS NOT NULL AS INTEGER) AS is_eligible_schedule_target
    FROM documents LEFT JOIN labels USING (doc_id)))"""


def _money(c):
    return f"coalesce(CAST(CAST({c} AS DECIMAL(18,2)) AS VARCHAR), '')"


def _month_text(c, blank):
    return f"coalesce(substr({c}, 6, 2) || '/' || substr({c}, 1, 4), '{blank}')"


def raw(month, layout) -> str:
    """SELECT of one raw snapshot over ``part_panel``."""
    old, late = layout == "old", layout == "late"
    number = "CASE WHEN id % 3 = 0 THEN id ELSE id % 40 END"
    name = f"p_name || ' ' || p_type || ' package ' || {number}"
    agency = "p_brand || ' (' || upper(p_type) || ')'"
    state = "'North ' || p_type"
    code = "'N' || lpad(CAST(id AS VARCHAR), 8, '0')"
    if late:
        name = f"CASE WHEN id % 13 = 0 THEN 'Rehabilitation contract' ELSE {name} END"
        agency = f"CASE WHEN id % 19 = 0 THEN 'Other Board' WHEN id % 7 = 0 THEN 'Works Board (' || upper(p_type) || ')' ELSE {agency} END"
        state = f"CASE WHEN id % 17 = 0 THEN 'South' WHEN id % 23 = 0 THEN '' ELSE {state} END"
    revised = _month_text("revised_end_date", "(-)")
    if old:
        revised = "coalesce(strftime(CAST(revised_end_date AS DATE), '%b-%Y'), '(-)')"
    approval = _month_text("start_date", "N.A." if old else "NA")
    cols = {
        "snapshot_date": f"'{month}'", "source_page": "CAST(id // 50 + 1 AS VARCHAR)", "sl_no": "CAST(id + 1 AS VARCHAR)",
        "project_id": code if old else "CAST(id AS VARCHAR)", "project_name": name, "agency": agency, "state": state,
        "approval_date": approval, "original_completion_date": _month_text("original_end_date", ""),
        "revised_completion_date": revised, "original_cost_crore": _money("original_cost_cr"),
        "revised_cost_crore": _money("revised_cost_cr"), "cumulative_expenditure_crore": _money("expenditure_cr"),
        "physical_progress_pct": _money("physical_progress_pct")}
    if old:
        cols |= {"sector": "'Sector ' || id % 6", "anticipated_completion_date": _month_text("original_end_date", ""),
                 "anticipated_cost_crore": _money("original_cost_cr")}
    if late:
        cols |= {"start_date": approval, "pmgid": "''",
                 "legacy_ocms_code": f"CASE WHEN id % 29 = 0 THEN {code} ELSE '(-)' END"}
    return "SELECT " + ", ".join(f"{v} AS {k}" for k, v in cols.items()) + f" FROM part_panel WHERE reporting_period = '{month}'"


def _strict(c):
    return (f"CASE WHEN regexp_full_match({c}, '[0-9]{{2}}/[0-9]{{4}}') THEN substr({c}, 4, 4) || '-' || substr({c}, 1, 2) "
            f"WHEN regexp_full_match({c}, '[A-Za-z]{{3}}-[0-9]{{4}}') THEN strftime(strptime({c}, '%b-%Y'), '%Y-%m') END")


def _hash(cols):
    parts = " || ', ' || ".join(f"'\"{c}\": ' || to_json(coalesce({c}, ''))" for c in sorted(cols))
    return "sha256('{' || " + parts + " || '}')"


RAW_COLUMNS = ["snapshot_date", "source_page", "sl_no", "project_id", "project_name", "agency", "state", "approval_date",
               "original_completion_date", "revised_completion_date", "original_cost_crore", "revised_cost_crore",
               "cumulative_expenditure_crore", "physical_progress_pct"]
_EXTRA = {"old": ["sector", "anticipated_completion_date", "anticipated_cost_crore"], "early": [],
          "late": ["start_date", "pmgid", "legacy_ocms_code"]}


def canonical_select(layout, month, day, table, file) -> str:
    have = set(RAW_COLUMNS + _EXTRA[layout])
    text = lambda c: f"nullif({c}, '')" if c in have else "CAST(NULL AS VARCHAR)"
    raw_date = lambda c: text(c)
    norm = lambda c: _strict(c) if c in have else "CAST(NULL AS VARCHAR)"
    cols = {
        "canonical_observation_key": f"'{month}:{table}:' || project_id", "source_snapshot": f"'{month}'",
        "snapshot_date": f"'{day}'", "source_table": f"'{table}'", "source_project_id": "project_id",
        "project_name": text("project_name"), "agency": text("agency"), "state": text("state")}
    for c in ("approval_date", "start_date", "original_completion_date", "revised_completion_date", "anticipated_completion_date"):
        cols[c + "_raw"], cols[c] = raw_date(c), norm(c)
    for c in ("original_cost_crore", "revised_cost_crore", "anticipated_cost_crore", "cumulative_expenditure_crore",
              "physical_progress_pct", "source_page"):
        cols[c] = text(c)
    cols |= {"source_row": "sl_no", "source_file": f"'{file}'", "source_record_hash": _hash(have),
             "sector": text("sector"), "legacy_ocms_code": text("legacy_ocms_code"), "pmgid": text("pmgid")}
    return "SELECT " + ", ".join(f"{v} AS {k}" for k, v in cols.items()) + f" FROM raw_{layout}"


RAW = panel(False) + f""",
part_panel AS (SELECT panel.*, p_name, p_brand, p_type FROM panel JOIN part ON p_partkey = id),
raw_old AS ({raw('1998-06', 'old')}),
raw_early AS ({raw('1998-07', 'early')}),
raw_late AS ({raw('1999-07', 'late')})"""

CANONICAL = RAW + f""",
canonical AS ({canonical_select('old', '1998-06', '1998-06-30', 'Table A', 'report_a')}
  UNION ALL {canonical_select('early', '1998-07', '1998-07-31', 'Table B', 'report_b')}
  UNION ALL {canonical_select('late', '1999-07', '1999-07-31', 'Table C', 'report_c')})"""

_STOP = ", ".join(f"'{w}'" for w in [
    "project", "line", "railway", "new", "doubling", "construction", "works", "of", "and", "to", "in", "at", "for",
    "with", "from", "the", "under", "via", "an", "on", "by"])


def tokens(c) -> str:
    return (f"list_filter(list_distinct(regexp_split_to_array(regexp_replace(lower(coalesce({c}, '')), "
            f"'[()\\[\\]{{}},;:.\\-_/]', ' ', 'g'), '\\s+')), lambda w: w <> '' AND w NOT IN ({_STOP}))")


def state_ok(a, b) -> str:
    fill = "['multi', 'states', 'state', 'pan', 'india', 'and']"
    words = lambda s: f"list_filter(regexp_extract_all(lower({s}), '[a-z]+'), lambda w: NOT list_contains({fill}, w))"
    return (f"({a} = '' OR {b} = '' OR contains(lower({a}), lower({b})) OR contains(lower({b}), lower({a})) "
            f"OR list_has_any({words(a)}, {words(b)}))")


def agency_ok(a, b) -> str:
    found = " || ".join(f"regexp_extract_all(lower({x}), '{p}', 1)" for p in (r"\[(.*?)\]", r"\((.*?)\)") for x in (a, b))
    return (f"({a} = '' OR {b} = '' OR contains(lower({a}), lower({b})) OR contains(lower({b}), lower({a})) "
            f"OR len(list_filter({found}, lambda x: length(trim(x)) >= 2 AND contains(lower({a}), trim(x)) AND contains(lower({b}), trim(x)))) > 0)")


# Observations with tokens, per snapshot.
MATCHED = CANONICAL + f""",
obs AS (SELECT canonical_observation_key AS key, source_snapshot AS snap, source_project_id AS id,
    coalesce(state, '') AS state, coalesce(agency, '') AS agency, CAST(original_cost_crore AS DOUBLE) AS cost,
    coalesce(approval_date, '') AS approval, CAST(source_row AS INTEGER) AS row_no, {tokens('project_name')} AS toks FROM canonical),
ids AS (SELECT a.id, a.key AS a_key, b.key AS b_key, a.state AS a_state, b.state AS b_state, a.agency AS a_agency, b.agency AS b_agency,
    len(list_intersect(a.toks, b.toks)) AS shared, {state_ok('a.state', 'b.state')} AS sok, {agency_ok('a.agency', 'b.agency')} AS aok,
    len(a.toks) + len(b.toks) AS both_len
  FROM obs a JOIN obs b ON a.id = b.id AND a.snap = '1998-07' AND b.snap = '1999-07'),
exact AS (SELECT *, shared / (both_len - shared) AS sim, sok AND aok AND shared > 0 AS accepted,
    concat_ws('; ', CASE WHEN NOT sok THEN 'State conflict (''' || a_state || ''' vs ''' || b_state || ''')' END,
      CASE WHEN NOT aok THEN 'Agency divergence (''' || a_agency || ''' vs ''' || b_agency || ''')' END,
      CASE WHEN shared = 0 THEN 'Zero shared distinctive title tokens' END) AS reason FROM ids),
cand AS (SELECT a.key AS a_key, a.row_no, b.key AS b_key, b.id AS b_id, b.snap AS b_snap, a.state, a.agency, a.approval,
    abs(a.cost - b.cost) AS cost_diff,
    len(list_intersect(a.toks, b.toks)) / (len(a.toks) + len(b.toks) - len(list_intersect(a.toks, b.toks))) AS sim
  FROM obs a JOIN obs b ON a.snap = '1998-06' AND b.snap <> '1998-06' AND abs(a.cost - b.cost) <= 0.05
   AND {state_ok('a.state', 'b.state')} AND {agency_ok('a.agency', 'b.agency')}
   AND (a.approval = '' OR b.approval = '' OR a.approval = b.approval)
   AND len(list_intersect(a.toks, b.toks)) >= 0.85 * (len(a.toks) + len(b.toks) - len(list_intersect(a.toks, b.toks)))),
strong AS (SELECT * FROM cand QUALIFY count(*) OVER (PARTITION BY a_key, b_snap) = 1)"""

IDENTITY = MATCHED + """,
links AS (
  SELECT a_key AS k, 'PROJ-LINKED-' || id AS e, 'EXACT_ID' AS c, 'ACCEPTED' AS s, 1 AS r, 0 AS t FROM exact WHERE accepted
  UNION ALL SELECT b_key, 'PROJ-LINKED-' || id, 'EXACT_ID', 'ACCEPTED', 1, 0 FROM exact WHERE accepted
  UNION ALL SELECT a_key, 'PROJ-LINKED-' || b_id, 'STRONG_MATCH', 'ACCEPTED', CASE WHEN b_snap = '1999-07' THEN 1 ELSE 2 END, 0 FROM strong
  UNION ALL SELECT b_key, 'PROJ-LINKED-' || b_id, 'STRONG_MATCH', 'ACCEPTED', 2, row_no FROM strong
  UNION ALL SELECT a_key, 'PROJ-REVIEW-1998-07-' || id, 'REVIEW_REQUIRED', 'PENDING_DOMAIN_REVIEW', 3, 0 FROM exact WHERE NOT accepted
  UNION ALL SELECT b_key, 'PROJ-REVIEW-1999-07-' || id, 'REVIEW_REQUIRED', 'PENDING_DOMAIN_REVIEW', 3, 0 FROM exact WHERE NOT accepted),
best AS (SELECT * FROM links QUALIFY row_number() OVER (PARTITION BY k ORDER BY r, t) = 1),
identity AS (SELECT o.key AS canonical_observation_key, coalesce(e, 'PROJ-UNMATCHED-' || o.snap || '-' || o.id) AS canonical_project_key,
    o.snap AS source_snapshot, o.id AS source_project_id, coalesce(c, 'UNMATCHED') AS match_confidence,
    coalesce(s, 'NOT_APPLICABLE') AS review_status FROM obs o LEFT JOIN best ON k = o.key)"""

PAIRS = IDENTITY + """,
project_panel AS (SELECT i.canonical_project_key, c.* FROM canonical c JOIN identity i USING (canonical_observation_key)),
pair AS (SELECT a.*, b.revised_cost_crore AS later_cost, b.revised_completion_date AS later_end,
    CASE WHEN a.canonical_project_key IN (SELECT canonical_project_key FROM project_panel WHERE source_snapshot = '1998-06')
         THEN '3_SNAPSHOT' ELSE '2_SNAPSHOT_JULY' END AS trajectory_type
  FROM project_panel a JOIN project_panel b ON a.canonical_project_key = b.canonical_project_key
   AND a.source_snapshot = '1998-07' AND b.source_snapshot = '1999-07'),
typed_pair AS (SELECT *, CAST(original_cost_crore AS DOUBLE) AS cost, CAST(cumulative_expenditure_crore AS DOUBLE) AS spend,
    CAST(physical_progress_pct AS DOUBLE) AS prog, CAST(later_cost AS DOUBLE) AS rev,
    CAST(substr(approval_date, 1, 4) AS INTEGER) * 12 + CAST(substr(approval_date, 6, 2) AS INTEGER) - 1 AS appr,
    CAST(substr(original_completion_date, 1, 4) AS INTEGER) * 12 + CAST(substr(original_completion_date, 6, 2) AS INTEGER) - 1 AS fin,
    CAST(substr(later_end, 1, 4) AS INTEGER) * 12 + CAST(substr(later_end, 6, 2) AS INTEGER) - 1 AS late FROM pair),
pair_features AS (SELECT canonical_project_key, source_project_id, trajectory_type, ln(1 + cost) AS feat_log_original_cost,
    cost AS feat_original_cost_crore, spend AS feat_cumulative_expenditure_crore,
    CASE WHEN cost > 0 THEN spend / cost END AS feat_expenditure_to_original_cost_ratio, prog AS feat_physical_progress_pct,
    CASE WHEN cost > 0 THEN spend / cost END * 100.0::DOUBLE - prog AS feat_physical_vs_financial_divergence,
    CAST(1998 * 12 + 6 - appr AS DOUBLE) AS feat_project_age_months, CAST(appr IS NULL AS INTEGER) AS feat_is_missing_approval_date,
    CAST(fin - (1998 * 12 + 6) AS DOUBLE) AS feat_remaining_original_duration_months,
    CAST(fin - (1998 * 12 + 6) < 0 AS INTEGER) AS feat_is_past_original_completion,
    coalesce(state, 'MISSING') AS feat_state, coalesce(agency, 'UNKNOWN') AS feat_agency,
    CASE WHEN cost > 0 AND rev IS NOT NULL THEN (rev - cost) / cost END AS future_total_cost_escalation_1999,
    CAST(CASE WHEN cost > 0 AND rev IS NOT NULL THEN (rev - cost) / cost END > 0.05 AS INTEGER) AS cost_overrun_5pct_1999,
    CAST(late - fin AS DOUBLE) AS future_schedule_slippage_months_1999, CAST(late - fin >= 3 AS INTEGER) AS time_overrun_3m_1999,
    CAST(cost > 0 AND rev IS NOT NULL AS INTEGER) AS is_eligible_cost_target,
    CAST(late IS NOT NULL AND fin IS NOT NULL AS INTEGER) AS is_eligible_schedule_target FROM typed_pair)"""
