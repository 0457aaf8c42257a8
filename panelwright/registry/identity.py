"""Queries on harmonised snapshots, identity and the pair cohort."""

from pyspark.sql import functions as F

from panelwright.operators import cohort as P
from panelwright.operators import harmonize as H
from panelwright.operators import identity as J
from panelwright.operators import snapshots as V
from panelwright.plans import derived as D
from panelwright.plans import snapshots as W
from panelwright.registry import query
from panelwright.registry.sql import CANONICAL, IDENTITY, MATCHED, PAIRS, RAW, agency_ok, state_ok, tokens
from panelwright.session import cut_lineage

OLD, EARLY, LATE = D.SNAPSHOTS


def _stored(spark, sf_dir):
    """The canonical table, written once for the many steps that read it."""
    return cut_lineage(D.canonical(spark, sf_dir))


def _at(df, snapshot):
    return df.filter(F.col("source_snapshot") == snapshot)


@query(f"WITH {CANONICAL} SELECT {', '.join(H.CANONICAL_COLUMNS)} FROM canonical")
def canonical_snapshots(spark, sf_dir):
    """Three layouts in one 30-column schema, with the row hash."""
    return H.in_source_order(D.canonical(spark, sf_dir))


@query(f"WITH {CANONICAL} SELECT source_row, source_project_id, count(*) AS row_count FROM canonical GROUP BY 1, 2 HAVING count(*) > 1")
def duplicate_keys(spark, sf_dir):
    """H5: key values that occur more than once."""
    return H.duplicate_keys(D.canonical(spark, sf_dir), ["source_row", "source_project_id"])


@query(f"WITH {CANONICAL} SELECT source_project_id FROM canonical WHERE source_snapshot = '{EARLY}' "
       f"INTERSECT SELECT source_project_id FROM canonical WHERE source_snapshot = '{LATE}'")
def common_keys(spark, sf_dir):
    """H6: ids present in both later snapshots."""
    df = D.canonical(spark, sf_dir)
    return H.common_keys(_at(df, EARLY), _at(df, LATE), "source_project_id")


@query(f"WITH {RAW}, top AS (SELECT max(CAST(sl_no AS BIGINT)) AS m FROM raw_early) SELECT serial FROM "
       "(SELECT unnest(range(1, m + 1)) AS serial FROM top) WHERE serial NOT IN (SELECT CAST(sl_no AS BIGINT) FROM raw_early)")
def missing_serials(spark, sf_dir):
    """H7: expected serials minus seen ones."""
    return H.missing_serials(D.raw_snapshots(spark, sf_dir)[1][0], "sl_no", None)


@query(f"WITH {IDENTITY}, s AS (SELECT canonical_project_key, list(DISTINCT source_snapshot) AS l FROM identity GROUP BY 1) "
       f"SELECT canonical_project_key, CASE WHEN list_contains(l, '{OLD}') THEN '3_SNAPSHOT' ELSE '2_SNAPSHOT_JULY' END AS trajectory_type "
       f"FROM s WHERE list_contains(l, '{EARLY}') AND list_contains(l, '{LATE}')")
def trajectory_labels(spark, sf_dir):
    """H8: membership label of the cohort keys."""
    return H.trajectory_labels(_identity(spark, sf_dir), "canonical_project_key", EARLY, LATE, OLD)


@query(f"WITH {MATCHED} SELECT id, a_key, b_key, round(sim, 6) AS similarity, shared, accepted, reason FROM exact")
def match_exact(spark, sf_dir):
    """Id pairs with corroboration and reasons."""
    df = _stored(spark, sf_dir)
    out = J.match_exact(_at(df, EARLY), _at(df, LATE))
    return out.select("id", "a_key", "b_key", F.round("similarity", 6).alias("similarity"),
                      F.col("shared").cast("long").alias("shared"), "accepted", "reason")


@query(f"WITH {MATCHED} SELECT a_key, b_key, b_id, round(sim, 6) AS similarity, round(cost_diff, 6) AS cost_diff FROM strong WHERE b_snap = '{EARLY}'")
def match_strong(spark, sf_dir):
    """Similarity matches with a unique candidate."""
    df = _stored(spark, sf_dir)
    out = J.match_strong(_at(df, OLD), _at(df, EARLY))
    return out.select("a_key", "b_key", "b_id", F.round("similarity", 6).alias("similarity"),
                      F.round("cost_diff", 6).alias("cost_diff"))


# Titles of documents: all their words.
_TITLES = f"""words AS (SELECT doc_id, lang, source, n_chars, list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '') AS w FROM documents),
titled AS (SELECT doc_id, lang AS state, source AS agency, CAST(n_chars AS DOUBLE) AS cost,
    {tokens("array_to_string(w, ' ')")} AS toks FROM words),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, a.cost AS ac, b.cost AS bc, len(list_intersect(a.toks, b.toks)) AS x,
    len(a.toks) + len(b.toks) AS both_len, {state_ok('a.state', 'b.state')} AND {agency_ok('a.agency', 'b.agency')} AS fits
  FROM titled a JOIN titled b ON a.doc_id % 2 = 0 AND b.doc_id % 2 = 1 AND len(a.toks) > 0 AND len(b.toks) > 0)"""


def title_observations(spark, sf_dir):
    """Documents as observations: title, language as state, source as agency, length as cost."""
    words = F.filter(F.split("text", r"\s+"), lambda w: w != "")
    return D.table(spark, sf_dir, "documents").select(
        F.col("doc_id").cast("string").alias("source_project_id"), F.col("doc_id").cast("string").alias("canonical_observation_key"),
        F.col("doc_id").cast("string").alias("source_row"), F.col("lang").alias("state"), F.col("source").alias("agency"),
        F.col("n_chars").cast("string").alias("original_cost_crore"), F.lit("").alias("approval_date"),
        F.array_join(F.array_distinct(words), " ").alias("project_name"), F.col("doc_id").alias("_id"))


def _halves(spark, sf_dir):
    docs = title_observations(spark, sf_dir)
    return docs.filter(F.col("_id") % 2 == 0), docs.filter(F.col("_id") % 2 == 1)


@query(f"WITH {_TITLES} SELECT CAST(a AS VARCHAR) AS a_key, count(*) AS candidates, "
       "CASE WHEN count(*) = 1 THEN CAST(max(b) AS VARCHAR) END AS b_key, "
       "CASE WHEN count(*) = 1 THEN round(max(x / (both_len - x)), 6) END AS similarity "
       "FROM pairs WHERE fits AND abs(ac - bc) <= 50 AND x >= 0.85 * (both_len - x) GROUP BY a")
def title_candidates(spark, sf_dir):
    """J3, J4 on free text: candidates within the band, unique ones resolved."""
    out = J.strong_candidates(*_halves(spark, sf_dir), tol=50.0)
    return out.select("a_key", "candidates", "b_key", F.round("similarity", 6).alias("similarity"))


@query(f"""WITH {_TITLES},
strong AS (SELECT a, b FROM pairs WHERE fits AND abs(ac - bc) <= 50 AND x >= 0.85 * (both_len - x) QUALIFY count(*) OVER (PARTITION BY a) = 1)
SELECT 'SIMILAR_TITLE_OTHER_COST' AS trigger, CAST(a AS VARCHAR) AS a_key, count(*) AS partners FROM pairs
  WHERE x >= 0.85 * (both_len - x) AND abs(ac - bc) > 0.1 * ac GROUP BY a
UNION ALL SELECT 'MANY_TO_ONE', CAST(a AS VARCHAR), n FROM (SELECT a, count(*) OVER (PARTITION BY b) AS n FROM strong) WHERE n > 1""")
def review_candidates(spark, sf_dir):
    """Rows that need a human, counted per trigger."""
    return J.review_candidates(*_halves(spark, sf_dir), tol=50.0)


@query(f"""WITH {MATCHED},
moved AS (SELECT cost, state, CASE WHEN row_no % 3 = 0 THEN '1990-01' ELSE approval END AS approval FROM obs WHERE snap = '{LATE}')
SELECT a.key AS a_key, count(*) AS partners FROM obs a JOIN moved b ON a.snap = '{EARLY}' AND a.cost = b.cost
  AND a.state = b.state AND a.approval <> '' AND b.approval <> '' AND a.approval <> b.approval GROUP BY 1""")
def approval_conflicts(spark, sf_dir):
    """Same cost and state, other approval month."""
    df = _stored(spark, sf_dir)
    other = F.when(F.col("source_row").cast("int") % 3 == 0, "1990-01").otherwise(F.col("approval_date"))
    found = J.review_candidates(_at(df, EARLY), _at(df, LATE).withColumn("approval_date", other))
    return found.filter(F.col("trigger") == "SAME_COST_STATE_OTHER_APPROVAL").select("a_key", "partners")


def _identity(spark, sf_dir):
    return J.resolve(_stored(spark, sf_dir), D.SNAPSHOTS)


@query(f"WITH {IDENTITY} SELECT * FROM identity")
def identity_map(spark, sf_dir):
    """Entity key, confidence and review status of every observation."""
    return _identity(spark, sf_dir).select("canonical_observation_key", "canonical_project_key", "source_snapshot",
                                           "source_project_id", "match_confidence", "review_status")


@query(f"WITH {CANONICAL} SELECT o.canonical_observation_key AS a_key, n.canonical_observation_key AS b_key, n.source_project_id AS b_id "
       f"FROM canonical o JOIN canonical n ON n.legacy_ocms_code = o.source_project_id AND o.source_snapshot = '{OLD}' "
       f"AND n.source_snapshot = '{LATE}' AND n.legacy_ocms_code <> '(-)'")
def match_bridge(spark, sf_dir):
    """Links through a published predecessor id."""
    df = D.canonical(spark, sf_dir)
    return J.match_bridge(_at(df, OLD), _at(df, LATE)).select("a_key", "b_key", "b_id")


@query(f"WITH {IDENTITY} SELECT i.canonical_project_key, i.match_confidence, c.canonical_observation_key, c.project_name, c.state, "
       "c.original_cost_crore FROM canonical c JOIN identity i USING (canonical_observation_key)")
def project_panel(spark, sf_dir):
    """Observations with their identity."""
    df = _stored(spark, sf_dir)
    panel = J.build_panel(df, J.resolve(df, D.SNAPSHOTS))
    return panel.select("canonical_project_key", "match_confidence", "canonical_observation_key", "project_name",
                        "state", "original_cost_crore")


@query(f"WITH {IDENTITY} SELECT match_confidence, count(*) AS observations FROM identity GROUP BY 1")
def tier_counts(spark, sf_dir):
    """Observations per confidence tier."""
    return J.tier_counts(_identity(spark, sf_dir))


@query(f"WITH {IDENTITY}, s AS (SELECT canonical_project_key, array_to_string(list_sort(list(DISTINCT source_snapshot)), ' + ') AS trajectory "
       "FROM identity GROUP BY 1) SELECT trajectory, count(*) AS projects FROM s GROUP BY 1")
def trajectory_distribution(spark, sf_dir):
    """Entities per set of snapshots."""
    return J.trajectory_distribution(_identity(spark, sf_dir))


_TRANSITIVE = f"""WITH RECURSIVE {IDENTITY},
said AS (SELECT a_key AS a, b_key AS b FROM exact WHERE accepted UNION SELECT a_key, b_key FROM strong),
edges AS (SELECT a, b FROM said UNION SELECT b, a FROM said UNION SELECT a, a FROM said UNION SELECT b, b FROM said),
reach AS (SELECT a, b FROM edges UNION SELECT r.a, e.b FROM reach r JOIN edges e ON r.b = e.a),
sets AS (SELECT a AS node, min(b) AS root FROM reach GROUP BY a),
conflicts AS (SELECT root, count(*) AS observations, count(DISTINCT canonical_project_key) AS entities
  FROM sets JOIN identity ON canonical_observation_key = node GROUP BY root HAVING count(DISTINCT canonical_project_key) > 1)"""


@query(_TRANSITIVE + " SELECT 'lost_observations' AS \"check\", 0 AS violations UNION ALL SELECT 'repeated_observations', 0 "
       "UNION ALL SELECT 'split_observations', 0 UNION ALL SELECT 'entity_twice_in_snapshot', "
       "(SELECT count(*) FROM (SELECT 1 FROM identity GROUP BY canonical_project_key, source_snapshot HAVING count(*) > 1)) "
       "UNION ALL SELECT 'broken_transitivity', (SELECT count(*) FROM conflicts)")
def audit_identity(spark, sf_dir):
    """Loss, repeats, doubled entities and linked observations that are not one entity."""
    df = _stored(spark, sf_dir)
    found = J.match_snapshots(df, D.SNAPSHOTS)
    identity = cut_lineage(J.assign_entities(df, found.exact, found.strong_early, found.strong_late, D.SNAPSHOTS))
    return J.audit_identity(df, identity, found.accepted_links())


@query(_TRANSITIVE + " SELECT root, observations, entities FROM conflicts")
def transitivity_conflicts(spark, sf_dir):
    """Sets of observations that accepted links join but the identity map splits."""
    df = _stored(spark, sf_dir)
    found = J.match_snapshots(df, D.SNAPSHOTS)
    identity = J.assign_entities(df, found.exact, found.strong_early, found.strong_late, D.SNAPSHOTS)
    return J.transitivity_conflicts(identity, found.accepted_links())


_PAIR_DOUBLES = [*P.NUMERIC_FEATURES[:7], "feat_remaining_original_duration_months", "future_total_cost_escalation_1999",
                 "future_schedule_slippage_months_1999"]
_PAIR_OTHER = ["canonical_project_key", "source_project_id", "trajectory_type", "feat_is_missing_approval_date",
               "feat_is_past_original_completion", "feat_state", "feat_agency", "cost_overrun_5pct_1999",
               "time_overrun_3m_1999", "is_eligible_cost_target", "is_eligible_schedule_target"]


def _cohort(spark, sf_dir):
    return W.build(D.raw_snapshots(spark, sf_dir), D.SNAPSHOTS, "1998-07-31", "1999", "2026-09-05T08:00:00Z").cohort


@query(f"WITH {PAIRS} SELECT {', '.join(_PAIR_OTHER)}, {', '.join(f'round({c}, 6) AS {c}' for c in _PAIR_DOUBLES)} FROM pair_features")
def pair_cohort(spark, sf_dir):
    """The whole snapshot chain to the 26-column cohort."""
    df = _cohort(spark, sf_dir)
    return df.select(*_PAIR_OTHER, *[F.round(c, 6).alias(c) for c in _PAIR_DOUBLES])


@query(f"WITH {PAIRS}, tall AS (SELECT trajectory_type, 'cost' AS task, cost_overrun_5pct_1999 AS y FROM pair_features "
       "UNION ALL SELECT trajectory_type, 'schedule', time_overrun_3m_1999 FROM pair_features) SELECT trajectory_type, task, count(*) AS total, "
       "count(y) AS eligible, count(*) FILTER (y IS NULL) AS missing, count(*) FILTER (y = 1) AS positive, count(*) FILTER (y = 0) AS negative, "
       "round(coalesce(count(*) FILTER (y = 1) * 100.0 / nullif(count(y), 0), 0), 6) AS event_rate FROM tall GROUP BY 1, 2")
def target_accounting(spark, sf_dir):
    """Eligibility and event rates by trajectory."""
    flags = {"cost": "cost_overrun_5pct_1999", "schedule": "time_overrun_3m_1999"}
    return P.target_accounting(_cohort(spark, sf_dir), flags, "trajectory_type").withColumn("event_rate", F.round("event_rate", 6))


@query(f"WITH {CANONICAL}, m AS (SELECT canonical_observation_key, original_completion_date AS e, approval_date AS a FROM canonical) "
       "SELECT canonical_observation_key, CAST((CAST(substr(e, 1, 4) AS INTEGER) - CAST(substr(a, 1, 4) AS INTEGER)) * 12 "
       "+ CAST(substr(e, 6, 2) AS INTEGER) - CAST(substr(a, 6, 2) AS INTEGER) AS DOUBLE) AS feat_original_planned_duration_months FROM m")
def planned_duration(spark, sf_dir):
    """Months from approval to completion."""
    return P.planned_duration(D.canonical(spark, sf_dir)).select(
        "canonical_observation_key", "feat_original_planned_duration_months")


@query(f"WITH {CANONICAL} SELECT source_project_id, canonical_observation_key FROM canonical WHERE source_snapshot = '{LATE}' "
       f"AND source_project_id NOT IN (SELECT source_project_id FROM canonical WHERE source_snapshot = '{EARLY}')")
def orphans(spark, sf_dir):
    """Child rows without a parent."""
    df = D.canonical(spark, sf_dir)
    return V.orphans(_at(df, LATE), _at(df, EARLY), "source_project_id").select("source_project_id", "canonical_observation_key")
