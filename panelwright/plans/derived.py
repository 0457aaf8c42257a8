"""Inputs for the registered queries, derived by Spark from the star-schema tables.

The monthly panel aggregates ``lineitem`` by (entity, month) with map-side combine
before any window, so an entity that owns a third of all lines reaches its window
as one row per month.
"""

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelwright.functions.periods import period_from_index
from panelwright.operators.harmonize import SnapshotSpec, to_canonical, union_snapshots
from panelwright.session import cut_lineage, discard


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _running(cells: DataFrame) -> DataFrame:
    """Every cell with the running sums up to its month and its project's total and first month."""
    whole = Window.partitionBy("project_code")
    so_far = whole.orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)
    return cells.select(
        "project_code", "id", "idx",
        F.sum("price").over(so_far).alias("spend"),
        F.sum("ret").over(so_far).alias("cum_ret"),
        F.count("*").over(so_far).alias("k"),
        F.sum("price").over(whole).alias("total"),
        F.min("idx").over(whole).alias("first_idx"),
    )


def _running_at(cells: DataFrame, months) -> DataFrame:
    """The rows of :func:`_running` at a few months: one sum per project and month, no order; no month sorts first."""
    idx = F.col("idx")

    def at(month):
        m = int(month[:4]) * 12 + int(month[5:]) - 1
        upto = idx.isNull() | (idx <= m)
        return (F.lit(m).alias("idx"), F.sum(F.when(upto, F.col("price"))).alias("spend"), F.sum(F.when(upto, F.col("ret"))).alias("cum_ret"),
                F.count_if(upto).alias("k"), F.coalesce(F.bool_or(idx == m), F.lit(False)).alias("seen"))

    # Cells are dealt by project as they are; sums for every month would be many times as wide.
    per = cells.repartition("id").groupBy("id").agg(
        F.sum("price").alias("total"), F.min("idx").alias("first_idx"), F.array(*[F.struct(*at(m)) for m in months]).alias("_at"))
    return per.select("id", "total", "first_idx", F.inline("_at")).filter("seen").drop("seen")


def monthly_panel(spark, sf_dir, dense=True, months=None, stored=False) -> DataFrame:
    """Panel of suppliers (dense) or parts (sparse) by ship month; with ``months``, only their rows.

    With ``stored`` the cells and sums of ``months`` are written as they are found, so only one of their two shuffles is on disk at a time.
    """
    prefix, key = ("S", "l_suppkey") if dense else ("P", "l_partkey")
    day = F.col("l_shipdate")
    lines = table(spark, sf_dir, "lineitem").select(
        F.col(key).alias("id"),
        (F.year(day) * 12 + F.month(day) - 1).alias("idx"),
        F.col("l_extendedprice").cast("decimal(18,2)").alias("price"),
        (F.col("l_returnflag") == "R").cast("int").alias("ret"),
    )
    code = F.concat(F.lit(prefix), F.col("id").cast("string")).alias("project_code")
    if months is None:
        cells = lines.groupBy(code, "id", "idx").agg(F.sum("price").alias("price"), F.sum("ret").alias("ret"))
        running = _running(cells)
    else:  # numbers are moved, not codes
        cells = lines.groupBy("id", "idx").agg(F.sum("price").alias("price"), F.sum("ret").alias("ret"))
        if stored:
            cells = cut_lineage(cells)
            running = cut_lineage(_running_at(cells, months))
            discard(cells)
        else:
            running = _running_at(cells, months)
        running = running.select(code, "*")
    c = F.col
    original = F.round(c("total").cast("decimal(18,2)") * F.lit("0.8").cast("decimal(2,1)"), 2)
    priced = running.withColumn("orig", original.cast("decimal(18,2)"))
    revised = F.round(
        (c("orig") * (1000 + c("cum_ret")).cast("decimal(9,0)")) * F.lit("0.001").cast("decimal(4,3)"), 2)
    first_day = F.concat(period_from_index("first_idx"), F.lit("-01")).cast("date")
    end_day = F.add_months(first_day, (24 + c("id") % 36).cast("int"))
    panel = priced.select(
        "project_code",
        period_from_index("idx").alias("reporting_period"),
        c("id"),
        c("orig").cast("double").alias("original_cost_cr"),
        F.when(c("cum_ret") % 7 == 0, F.lit(None).cast("double"))
        .when(c("cum_ret") % 7 == 1, F.lit(0.0))
        .otherwise(revised.cast("double")).alias("revised_cost_cr"),
        c("spend").cast("double").alias("expenditure_cr"),
        F.when((c("id") + c("idx")) % 17 != 0,
               F.least(F.lit(100.0), F.round(F.lit(100.0) * c("k") / 60, 2))).alias("physical_progress_pct"),
        F.when(c("id") % 11 != 0, F.date_format(first_day, "yyyy-MM-dd")).alias("start_date"),
        F.date_format(end_day, "yyyy-MM-dd").alias("original_end_date"),
        F.when(c("cum_ret") % 5 != 0,
               F.date_format(F.date_add(end_day, c("cum_ret").cast("int")), "yyyy-MM-dd")).alias("revised_end_date"),
    )
    if not dense:
        return panel.drop("id")
    # Joined on the panel's own partitioning key, so only the supplier side can move; the
    # optimizer broadcasts it only when it is under spark.sql.autoBroadcastJoinThreshold.
    places = (
        table(spark, sf_dir, "supplier")
        .join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
        .join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
        .select(F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("project_code"),
                F.col("s_name").alias("agency"),
                F.col("n_name").alias("state"), F.col("r_name").alias("sector"))
    )
    named = panel.join(places, "project_code", "left")
    return named.select(
        *[c for c in panel.columns if c != "id"], "state", "agency", "sector",
        F.concat(F.lit("Ministry of "), F.col("sector")).alias("line_ministry"),
        F.concat(F.lit("Works of "), F.col("agency")).alias("project_name"),
    )


def part_panel(spark, sf_dir, months=None, stored=False) -> DataFrame:
    """The sparse panel with its part attributes, the source of the raw snapshots."""
    part = table(spark, sf_dir, "part").select(
        F.concat(F.lit("P"), F.col("p_partkey").cast("string")).alias("project_code"),
        F.col("p_partkey").alias("id"), "p_name", "p_brand", "p_type")
    return monthly_panel(spark, sf_dir, dense=False, months=months, stored=stored).join(part, "project_code")


def raw_snapshot(rows: DataFrame, month: str, layout: str) -> DataFrame:
    """One month of :func:`part_panel` as report text in the old, early or late layout."""
    c, old, late = F.col, layout == "old", layout == "late"
    text = F.lit
    money = lambda x: F.coalesce(c(x).cast("decimal(18,2)").cast("string"), text(""))
    month_text = lambda x, blank: F.coalesce(F.concat(F.substring(x, 6, 2), text("/"), F.substring(x, 1, 4)), text(blank))
    number = F.when(c("id") % 3 == 0, c("id")).otherwise(c("id") % 40).cast("string")
    name = F.concat(c("p_name"), text(" "), c("p_type"), text(" package "), number)
    agency = F.concat(c("p_brand"), text(" ("), F.upper("p_type"), text(")"))
    state = F.concat(text("North "), c("p_type"))
    code = F.concat(text("N"), F.lpad(c("id").cast("string"), 8, "0"))
    if late:
        name = F.when(c("id") % 13 == 0, text("Rehabilitation contract")).otherwise(name)
        agency = (F.when(c("id") % 19 == 0, text("Other Board"))
                  .when(c("id") % 7 == 0, F.concat(text("Works Board ("), F.upper("p_type"), text(")")))
                  .otherwise(agency))
        state = F.when(c("id") % 17 == 0, text("South")).when(c("id") % 23 == 0, text("")).otherwise(state)
    revised = month_text("revised_end_date", "(-)")
    if old:
        revised = F.coalesce(F.date_format(c("revised_end_date").cast("date"), "MMM-yyyy"), text("(-)"))
    approval = month_text("start_date", "N.A." if old else "NA")
    out = {
        "snapshot_date": text(month), "source_page": F.floor(c("id") / 50 + 1).cast("string"),
        "sl_no": (c("id") + 1).cast("string"), "project_id": code if old else c("id").cast("string"),
        "project_name": name, "agency": agency, "state": state, "approval_date": approval,
        "original_completion_date": month_text("original_end_date", ""), "revised_completion_date": revised,
        "original_cost_crore": money("original_cost_cr"), "revised_cost_crore": money("revised_cost_cr"),
        "cumulative_expenditure_crore": money("expenditure_cr"), "physical_progress_pct": money("physical_progress_pct"),
    }
    if old:
        out |= {"sector": F.concat(text("Sector "), (c("id") % 6).cast("string")),
                "anticipated_completion_date": month_text("original_end_date", ""),
                "anticipated_cost_crore": money("original_cost_cr")}
    if late:
        out |= {"start_date": approval, "pmgid": text(""),
                "legacy_ocms_code": F.when(c("id") % 29 == 0, code).otherwise(text("(-)"))}
    return rows.filter(c("reporting_period") == month).select(*[v.alias(k) for k, v in out.items()])


SNAPSHOTS = ("1998-06", "1998-07", "1999-07")
SPECS = (
    SnapshotSpec("1998-06", "1998-06-30", "Table A", "report_a", ("start_date", "legacy_ocms_code", "pmgid")),
    SnapshotSpec("1998-07", "1998-07-31", "Table B", "report_b",
                 ("start_date", "anticipated_completion_date", "anticipated_cost_crore", "sector",
                  "legacy_ocms_code", "pmgid")),
    SnapshotSpec("1999-07", "1999-07-31", "Table C", "report_c",
                 ("anticipated_completion_date", "anticipated_cost_crore", "sector")),
)


def raw_snapshots(spark, sf_dir) -> list:
    """(table, spec) of the three snapshots; their panel rows are summed once and stored."""
    rows = cut_lineage(part_panel(spark, sf_dir, SNAPSHOTS, stored=True))
    return [(raw_snapshot(rows, m, lay), spec)
            for m, lay, spec in zip(SNAPSHOTS, ("old", "early", "late"), SPECS)]


def canonical(spark, sf_dir) -> DataFrame:
    return union_snapshots(*[to_canonical(df, spec) for df, spec in raw_snapshots(spark, sf_dir)])


def labelled(spark, sf_dir) -> DataFrame:
    """Documents with their labels, NULL where unlabelled."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars")
    return docs.join(table(spark, sf_dir, "labels"), "doc_id", "left")


def cohort(spark, sf_dir) -> DataFrame:
    """Documents as a pair cohort: twelve features, two targets, eligibility."""
    c = F.col
    d = c("doc_id")
    cost = c("n_chars") / F.lit(100.0)
    spend = (c("n_chars") * (d % 13)) / F.lit(1000.0)
    base = labelled(spark, sf_dir).withColumns({"_cost": cost, "_spend": spend})
    base = base.withColumns({
        "_share": F.when(c("_cost") > 0, c("_spend") / c("_cost")), "_prog": ((d * 37) % 101).cast("double"),
        "_left": (d % 61 - 30).cast("double")})
    return base.select(
        F.concat(F.lit("DOC-"), d.cast("string")).alias("canonical_project_key"),
        d.cast("string").alias("source_project_id"),
        F.concat(F.lit("Work "), d.cast("string"), F.lit(" "), c("lang")).alias("project_name"),
        F.lit("2025-07").alias("snapshot_date"), F.lit("2025-07-31").alias("prediction_cutoff_date"),
        F.log1p("_cost").alias("feat_log_original_cost"), c("_cost").alias("feat_original_cost_crore"),
        c("_spend").alias("feat_cumulative_expenditure_crore"),
        c("_share").alias("feat_expenditure_to_original_cost_ratio"),
        c("_prog").alias("feat_physical_progress_pct"),
        (c("_share") * 100.0 - c("_prog")).alias("feat_physical_vs_financial_divergence"),
        F.when(d % 11 != 0, (d % 120).cast("double")).alias("feat_project_age_months"),
        (d % 11 == 0).cast("int").alias("feat_is_missing_approval_date"),
        c("_left").alias("feat_remaining_original_duration_months"),
        (c("_left") < 0).cast("int").alias("feat_is_past_original_completion"),
        c("lang").alias("feat_state"), c("source").alias("feat_agency"),
        (c("n_chars") + (d % 97) * 40 > 3000).cast("int").alias("cost_overrun"),
        c("toxic").alias("time_overrun"), F.lit(1).alias("is_eligible_cost_target"),
        c("toxic").isNotNull().cast("int").alias("is_eligible_schedule_target"))


def portfolio(spark, sf_dir) -> DataFrame:
    """Documents with two given probabilities on a grid of 1001 values, so ranks tie."""
    d = F.col("doc_id")
    ps = ((d * 104729 + 37) % 1001) / F.lit(1000.0)
    return labelled(spark, sf_dir).select(
        F.concat(F.lit("DOC-"), d.cast("string")).alias("canonical_project_key"),
        "lang", "source", "quality", "toxic",
        (((F.col("n_chars") * 7919) % 1001) / F.lit(1000.0)).alias("cost_risk_probability"),
        F.when(F.col("toxic").isNotNull(), ps).alias("schedule_risk_probability"))


def predictions(spark, sf_dir) -> DataFrame:
    """(task, lang, y, p): both probabilities against both labels, labelled rows only."""
    rows = portfolio(spark, sf_dir).filter(F.col("toxic").isNotNull())
    return rows.select("canonical_project_key", "lang", F.inline(F.array(
        F.struct(F.lit("cost_overrun").alias("task"), F.col("quality").alias("y"),
                 F.col("cost_risk_probability").alias("p")),
        F.struct(F.lit("schedule_slippage").alias("task"), F.col("toxic").alias("y"),
                 F.col("schedule_risk_probability").alias("p")))))


# Closed-form scorers, so that explanations have an exact expected result.
_WEIGHTS = {
    "cost": (-1.9, {"feat_log_original_cost": 0.3, "feat_physical_vs_financial_divergence": 0.015,
                    "feat_remaining_original_duration_months": -0.004, "feat_is_missing_approval_date": 0.3,
                    "feat_physical_progress_pct": 0.002}, ("feat_state", "en", 0.2)),
    "schedule": (0.4, {"feat_expenditure_to_original_cost_ratio": 0.5, "feat_project_age_months": 0.004,
                       "feat_is_past_original_completion": 1.1, "feat_remaining_original_duration_months": -0.02,
                       "feat_original_cost_crore": 0.001}, ("feat_agency", "src1", -0.3)),
}


def closed_form(task):
    """Logistic scorer with fixed weights; a missing feature counts as 0."""
    bias, weights, (column, level, bonus) = _WEIGHTS[task]

    def score(df: DataFrame) -> DataFrame:
        z = F.lit(bias)
        for name, w in weights.items():
            z = z + F.coalesce(F.col(name).cast("double"), F.lit(0.0)) * F.lit(w)
        z = z + F.when(F.col(column) == level, F.lit(bonus)).otherwise(F.lit(0.0))
        return df.withColumn("probability", F.round(F.lit(1.0) / (F.lit(1.0) + F.exp(-z)), 6))

    return score


def risk_portfolio(spark, sf_dir):
    """The scored, explained and routed cohort with closed-form scorers."""
    from panelwright.operators.scoring import provenance
    from panelwright.plans.portfolio import from_scorers

    return from_scorers(cohort(spark, sf_dir), closed_form("cost"), closed_form("schedule"),
                        cutoff_label="July 2025", deltas_digits=6, made_by=provenance("closed form: cost", "closed form: schedule"))
