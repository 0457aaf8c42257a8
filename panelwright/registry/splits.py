"""Queries on temporal splits and stratified hold-outs."""

from pyspark.sql import functions as F

from panelwright.operators import split as K
from panelwright.plans import derived as D
from panelwright.registry import query
from panelwright.registry.sql import COHORT, panel

_NUMBERED = f"""WITH {panel()}, ranked AS (
  SELECT project_code, reporting_period, dense_rank() OVER (ORDER BY reporting_period) AS r,
         (SELECT count(DISTINCT reporting_period) FROM panel) AS n FROM panel)"""


def _periods(spark, sf_dir):
    return D.monthly_panel(spark, sf_dir).select("project_code", "reporting_period")


@query(_NUMBERED + """,
marks AS (SELECT max(r) FILTER (reporting_period <= '1998-06') AS a, max(r) FILTER (reporting_period <= '1999-12') AS b FROM ranked)
SELECT project_code, reporting_period, CASE WHEN r <= a THEN 'train' WHEN r <= a + 2 THEN 'val_embargo'
  WHEN r <= b THEN 'val' WHEN r <= b + 2 THEN 'purged' ELSE 'test' END AS split FROM ranked, marks""")
def split_by_cutoffs(spark, sf_dir):
    """K1: cutoffs, validation slice and embargo."""
    return K.split_by_cutoffs(_periods(spark, sf_dir), "1998-06", val_end="1999-12", embargo=2)


@query(f"WITH {panel()} SELECT project_code, reporting_period, CASE WHEN reporting_period <= '1998-06' THEN 'train' "
       "WHEN reporting_period < '1998-10' THEN 'purged' ELSE 'test' END AS split FROM panel")
def split_with_test_start(spark, sf_dir):
    """K1 with an explicit test start."""
    return K.split_by_cutoffs(_periods(spark, sf_dir), "1998-06", test_start="1998-10")


@query(_NUMBERED + """ SELECT project_code, reporting_period, CASE WHEN r <= floor(n * 0.7) THEN 'train'
  WHEN r <= floor(n * 0.7) + 6 THEN 'purged' ELSE 'test' END AS split FROM ranked""")
def split_by_ratio(spark, sf_dir):
    """K2: shares of the distinct periods."""
    return K.split_by_ratio(_periods(spark, sf_dir), 0.7, embargo=6)


def _folds_sql(expanding):
    low = "" if expanding else "AND r > f - 1 "
    return _NUMBERED + f""", folds AS (SELECT unnest([1, 2, 3, 4]) AS f)
SELECT f AS fold, split, reporting_period, count(*) AS row_count FROM (
  SELECT f, reporting_period, CASE WHEN r <= 59 + f {low}THEN 'train' WHEN r > 59 + f AND r <= 62 + f THEN 'purged'
    WHEN r > 62 + f AND r <= 65 + f THEN 'test' END AS split FROM ranked, folds)
WHERE split IS NOT NULL GROUP BY 1, 2, 3"""


def _folds(spark, sf_dir, expanding):
    df = K.rolling_folds(_periods(spark, sf_dir), 4, 60, 3, 3, expanding)
    return df.groupBy("fold", "split", "reporting_period").agg(F.count("*").alias("row_count"))


@query(_folds_sql(True))
def rolling_folds(spark, sf_dir):
    """K3: expanding folds."""
    return _folds(spark, sf_dir, True)


@query(_folds_sql(False))
def sliding_folds(spark, sf_dir):
    """K3: sliding folds."""
    return _folds(spark, sf_dir, False)


_LABELLED = f"""WITH {panel()}, labelled AS (SELECT project_code, reporting_period,
  CASE WHEN id % 10 = 0 AND reporting_period < '1999-06' THEN 'test' WHEN reporting_period <= '1998-12' THEN 'train'
       WHEN reporting_period <= '1999-12' THEN 'val' ELSE 'test' END AS split FROM panel)"""


def leaky_split(spark, sf_dir):
    """A split with planted leakage: early rows of every tenth entity are in the test set."""
    p = F.col("reporting_period")
    early = (F.substring("project_code", 2, 20).cast("long") % 10 == 0) & (p < "1999-06")
    return _periods(spark, sf_dir).withColumn("split", F.when(early, "test").when(p <= "1998-12", "train").when(
        p <= "1999-12", "val").otherwise("test"))


@query(_LABELLED + """, e AS (
  SELECT project_code, max(reporting_period) FILTER (split = 'train') AS tm, min(reporting_period) FILTER (split = 'val') AS vm,
         max(reporting_period) FILTER (split = 'val') AS vx, min(reporting_period) FILTER (split = 'test') AS sm
  FROM labelled GROUP BY 1),
g AS (SELECT max(tm) AS tm, min(vm) AS vm, max(vx) AS vx, min(sm) AS sm, count(*) FILTER (tm >= sm) AS et,
  count(*) FILTER (tm >= vm) AS ev, count(*) FILTER (tm IS NOT NULL AND sm IS NOT NULL) AS rep FROM e),
m AS (SELECT *, (CAST(substr(vm, 1, 4) AS INTEGER) - CAST(substr(tm, 1, 4) AS INTEGER)) * 12
  + CAST(substr(vm, 6, 2) AS INTEGER) - CAST(substr(tm, 6, 2) AS INTEGER) AS dist FROM g)
SELECT rule, CAST(v AS BIGINT) AS violations, rep AS repeated_entities FROM (
  SELECT rep, unnest(['empty_train', 'empty_test', 'train_before_test', 'train_before_val', 'val_before_test', 'embargo',
                      'entity_train_before_test', 'entity_train_before_val']) AS rule,
         unnest([0, 0, CAST(tm >= sm AS INTEGER), CAST(tm >= vm AS INTEGER), CAST(vx >= sm AS INTEGER),
                 CAST(dist > 0 AND dist <= 3 AS INTEGER), et, ev]) AS v FROM m)""")
def verify_split(spark, sf_dir):
    """Every split rule from one grouped aggregate."""
    return K.verify_split(leaky_split(spark, sf_dir), embargo=3)


@query(_LABELLED + """ SELECT split, count(*) AS row_count, count(DISTINCT reporting_period) AS period_count,
  min(reporting_period) AS min_period, max(reporting_period) AS max_period FROM labelled GROUP BY 1""")
def split_summary(spark, sf_dir):
    """K5: rows and periods per split."""
    return K.split_summary(leaky_split(spark, sf_dir)).withColumn("period_count", F.size("periods").cast("long")).drop("periods")


_HASHED = """pool AS (
  SELECT doc_id, quality AS s, md5(CAST(doc_id AS VARCHAR) || '|42') AS h FROM documents LEFT JOIN labels USING (doc_id)),
ranked AS (SELECT doc_id, s, row_number() OVER (PARTITION BY s ORDER BY h) AS rn, count(*) OVER (PARTITION BY s) AS c
  FROM pool WHERE s IS NOT NULL)"""


@query(f"""WITH {_HASHED},
strata AS (SELECT s, any_value(c) AS c FROM ranked GROUP BY 1),
want AS (SELECT *, ceil(0.2 * sum(c) OVER ()) AS w, ceil(0.2 * sum(c) OVER ()) * c / sum(c) OVER () AS x FROM strata),
test AS (SELECT s, c, floor(x) + CAST(row_number() OVER (ORDER BY x - floor(x) DESC, s) <= w - sum(floor(x)) OVER () AS INTEGER) AS nt FROM want),
left_ AS (SELECT *, c - nt AS rest FROM test),
want2 AS (SELECT *, ceil(0.25 * sum(rest) OVER ()) AS w, ceil(0.25 * sum(rest) OVER ()) * rest / sum(rest) OVER () AS x FROM left_),
cal AS (SELECT *, floor(x) + CAST(row_number() OVER (ORDER BY x - floor(x) DESC, s) <= w - sum(floor(x)) OVER () AS INTEGER) AS nc FROM want2)
SELECT p.doc_id, CASE WHEN r.rn IS NULL THEN 'NOT_ELIGIBLE' WHEN r.rn <= nt THEN 'TEST_HOLDOUT'
  WHEN r.rn <= nt + nc THEN 'CALIBRATION_HOLDOUT' ELSE 'MODELFIT' END AS partition
FROM pool p LEFT JOIN ranked r USING (doc_id) LEFT JOIN cal ON cal.s = r.s""")
def stratified_partition(spark, sf_dir):
    """K6: stratified hold-outs with exact class counts."""
    df = D.labelled(spark, sf_dir).select("doc_id", "quality")
    return K.stratified_partition(df, "quality", "doc_id").select("doc_id", "partition")


@query(f"WITH {_HASHED} SELECT doc_id, CAST((rn - 1) % 5 AS INTEGER) AS fold FROM ranked")
def stratified_kfold(spark, sf_dir):
    """K7: folds dealt round-robin within each class."""
    df = D.labelled(spark, sf_dir).select("doc_id", "quality").filter(F.col("quality").isNotNull())
    return K.stratified_kfold(df, "quality", "doc_id").select("doc_id", "fold")


@query(f"WITH {COHORT} SELECT canonical_project_key, time_overrun FROM cohort WHERE is_eligible_schedule_target = 1")
def eligible_rows(spark, sf_dir):
    """K8: the supervised subset."""
    return K.eligible_rows(D.cohort(spark, sf_dir), "is_eligible_schedule_target").select(
        "canonical_project_key", "time_overrun")


@query(f"WITH {COHORT} SELECT canonical_project_key, CAST(feat_physical_progress_pct >= 99 AS INTEGER) AS is_near_complete FROM cohort")
def sensitivity_flag(spark, sf_dir):
    """K9: near-complete rows marked, none dropped."""
    return K.sensitivity_flag(D.cohort(spark, sf_dir)).select("canonical_project_key", "is_near_complete")
