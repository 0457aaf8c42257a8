"""Queries that write files in the shared folder and read them back, and outcomes of guards as rows."""

import uuid

import pyarrow as pa
from pyspark.sql import functions as F

from panelwright.errors import PanelError
from panelwright.operators import panel as P
from panelwright.operators import quality as V
from panelwright.plans import derived as D
from panelwright.registry import query
from panelwright.registry.sql import panel
from panelwright.session import checkpoint_dir
from panelwright.sources import readers, sinks


def _folder(spark, name):
    return f"{checkpoint_dir(spark)}/files/{name}-{uuid.uuid4().hex}"


_HEAD = ["Projects Details,,,", "as reported,,,", "Project Code,Original Cost,Cumulative Expenditure,State"]


@query("SELECT 'O' || o_orderkey AS project_code, CAST(o_orderkey % 1000 AS DOUBLE) AS original_cost_cr, CASE WHEN o_orderkey % 5 <> 0 THEN CAST(o_custkey % 100 AS DOUBLE) END AS expenditure_cr, "
       "CASE WHEN o_orderkey % 7 = 0 THEN NULL WHEN o_orderkey % 7 = 1 THEN 'Goa, \"north\"' ELSE o_orderpriority END AS state FROM orders")
def titled_csv(spark, sf_dir):
    """IO1-IO3: rows of CSV files that carry a title above the header, with headers brought to their names."""
    k = F.col("o_orderkey")
    state = F.when(k % 7 == 0, "N/A").when(k % 7 == 1, 'Goa, "north"').otherwise(F.col("o_orderpriority"))
    row = F.struct(F.concat(F.lit("O"), k), (k % 1000).cast("string"), F.when(k % 5 == 0, " ").otherwise((F.col("o_custkey") % 100).cast("string")), state)

    def titled(batches):
        yield pa.RecordBatch.from_arrays([pa.array(_HEAD)], names=["value"])
        yield from batches

    path = _folder(spark, "titled")
    D.table(spark, sf_dir, "orders").select(F.to_csv(row, {"escape": '"', "quote": '"'}).alias("value")).repartition(3).mapInArrow(titled, "value string").write.text(path)
    df = V.normalize_headers(readers.read_titled_csv(spark, path))
    return df.select("project_code", F.col("original_cost_cr").cast("double"), F.col("expenditure_cr").cast("double"), "state")


@query("SELECT split, count(*) AS row_count, sum(doc_id) AS ids, 'panel' AS source FROM (SELECT doc_id, CASE WHEN doc_id % 10 < 7 THEN 'TRAIN' ELSE 'TEST' END AS split FROM documents) GROUP BY split")
def saved_artifacts(spark, sf_dir):
    """IO5: tables and metadata written as artifacts, partitioned by split, and read back."""
    docs = D.table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("doc_id") % 10 < 7, "TRAIN").otherwise("TEST").alias("split"))
    paths = sinks.save_artifacts({"rows": docs}, {"source": "panel"}, _folder(spark, "artifacts"))
    source = spark.read.text(paths["metadata"]).select(F.get_json_object("value", "$.source").alias("source")).scalar()
    return spark.read.parquet(paths["rows"]).groupBy("split").agg(F.count("*").alias("row_count"), F.sum("doc_id").alias("ids")).withColumn("source", source)


_ROLES = {"entity": "project_code", "period": "reporting_period", "original_cost": "original_cost_cr", "revised_cost": "revised_cost_cr",
          "expenditure": "expenditure_cr"}


@query(f"WITH {panel(True)} " + " UNION ALL ".join(f"SELECT '{r}' AS role, '{c}' AS name, count({c}) AS filled FROM panel" for r, c in _ROLES.items()))
def column_roles(spark, sf_dir):
    """IO4: which column plays a role, and how many of its values are filled."""
    df = D.monthly_panel(spark, sf_dir)
    found = P.detect_columns(df.columns)
    return df.agg(*[F.count(getattr(found, r)).alias(r) for r in _ROLES]).select(F.inline(F.array(*[
        F.struct(F.lit(r).alias("role"), F.lit(getattr(found, r)).alias("name"), F.col(r).alias("filled")) for r in _ROLES])))


_LEAKS = {"future_cost": "LR-05", "late_target": "LR-05", "target_cost_escalation_1m_cr": "LR-05"}


@query("WITH n AS (SELECT count(*) AS n FROM documents) " + " UNION ALL ".join(f"SELECT '{rule}' AS rule, '{c}' AS name, n AS filled FROM n" for c, rule in _LEAKS.items()))
def leaking_columns(spark, sf_dir):
    """Columns of a feature table that hold the future, with how many rows they would leak."""
    df = D.cohort(spark, sf_dir).select("feat_log_original_cost", "feat_state", *[F.lit(1).alias(c) for c in _LEAKS])
    found = V.leaking_names(df.columns)
    return df.agg(*[F.count(c).alias(c) for _, c in found]).select(F.inline(F.array(*[
        F.struct(F.lit(rule).alias("rule"), F.lit(c).alias("name"), F.col(c).alias("filled")) for rule, c in found])))


def _outcome(work) -> str:
    try:
        work()
    except (PanelError, V.LeakageError) as error:
        return type(error).__name__
    return "passed"


@query(f"WITH {panel(True)}, n AS (SELECT count(*) AS rows FROM panel) SELECT c AS \"check\", outcome, rows FROM n, (VALUES ('whole panel', 'passed'), "
       "('repeated rows', 'PanelError'), ('unreadable period', 'PanelError'), ('no entity', 'PanelError'), ('no rows', 'PanelError'), "
       "('horizon of no months', 'PanelError'), ('predictor of the future', 'LeakageError')) v(c, outcome)")
def guard_outcomes(spark, sf_dir):
    """What the guards say to the panel, to broken copies of it and to bad parameters."""
    df = D.monthly_panel(spark, sf_dir)
    cases = {
        "whole panel": lambda: P.panel_features(df), "repeated rows": lambda: P.panel_features(df.unionByName(df)),
        "unreadable period": lambda: P.panel_features(df.withColumn("reporting_period", F.lit("soon"))), "no entity": lambda: P.panel_features(df.drop("project_code")),
        "no rows": lambda: P.panel_features(df.limit(0)), "horizon of no months": lambda: P.build_targets(df, (0,)),
        "predictor of the future": lambda: V.audit_predictors([*df.columns, "revised_cost_cr_2026"])}
    rows = spark.createDataFrame([(name, _outcome(work)) for name, work in cases.items()], "check string, outcome string")
    return rows.withColumn("rows", df.agg(F.count("*")).scalar())
