"""Monthly panel: point-in-time features and forward-horizon targets.

Every look-back and look-ahead is a range frame over the month index within one
entity, so features and all horizons share a single shuffle and sort. An entity
holds at most one row per calendar month (checked by :func:`require_panel`), which
bounds every window group by the number of months, however many rows there are.
"""

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelwright.errors import PanelError
from panelwright.functions import periods as P
from panelwright.functions.numeric import clip, flag, number, ratio

# Column names accepted for each role, first present wins.
CANDIDATES = {
    "entity": ["project_code", "canonical_project_key", "project_id", "source_project_id", "id"],
    "period": ["reporting_period", "snapshot_date", "prediction_cutoff_date", "period", "date"],
    "sector": ["sector", "sector_name", "feat_sector"],
    "ministry": ["line_ministry", "ministry", "feat_line_ministry"],
    "state": ["state", "feat_state", "location"],
    "agency": ["agency", "feat_agency", "executing_agency"],
    "start_date": ["start_date", "approval_date", "date_of_approval", "commencement_date"],
    "original_cost": ["original_cost_cr", "original_cost", "feat_original_cost_crore", "cost_original", "orig_cost"],
    "revised_cost": ["revised_cost_cr", "revised_cost", "revised_cost_crore", "cost_revised", "rev_cost"],
    "original_end": ["original_end_date", "original_completion_date", "original_doc", "doc_original", "orig_doc"],
    "revised_end": ["revised_end_date", "revised_completion_date", "revised_doc", "doc_revised", "rev_doc"],
    "expenditure": ["expenditure_cr", "expenditure", "feat_cumulative_expenditure_crore",
                    "cumulative_expenditure", "expenditure_crore"],
    "progress": ["physical_progress_pct", "physical_progress", "feat_physical_progress_pct", "progress_pct"],
}

FEATURES = [
    "cost_growth_ratio", "expenditure_to_original_cost", "expenditure_to_revised_cost",
    "schedule_slippage_days", "project_age_days", "elapsed_duration_ratio", "progress_gap",
    "expenditure_progress_gap", "recent_cost_change", "recent_expenditure_change",
    "recent_progress_change", "recent_schedule_change", "is_first_observation",
]


@dataclass(frozen=True)
class PanelColumns:
    """Names of the panel columns by role."""

    entity: str
    period: str
    sector: str
    ministry: str
    state: str
    agency: str
    start_date: str
    original_cost: str
    revised_cost: str
    original_end: str
    revised_end: str
    expenditure: str
    progress: str


def detect_columns(columns, **overrides) -> PanelColumns:
    """Resolve each role to an explicit override, a known name, or the default name."""
    present = set(columns)
    names = {
        role: next((c for c in known if c in present), known[0]) for role, known in CANDIDATES.items()
    }
    return replace(PanelColumns(**names), **{k: v for k, v in overrides.items() if v})


_TYPED = ["_period", "_idx", "_first", "_orig", "_rev", "_exp", "_prog", "_start", "_orig_end", "_rev_end"]


def _typed(df: DataFrame, cols: PanelColumns) -> DataFrame:
    """Add parsed helper columns; a role without a column reads as NULL."""
    types = {f.name: f.dataType for f in df.schema.fields}
    num = lambda c: number(c) if c in types else F.lit(None).cast("double")
    day = lambda c: P.parse_date(c, types[c]) if c in types else F.lit(None).cast("date")
    return (
        df.withColumn("_period", P.period(cols.period, types[cols.period]))
        .withColumns({
            "_idx": P.period_index("_period"),
            "_first": F.concat(F.col("_period"), F.lit("-01")).try_cast("date"),
            "_orig": num(cols.original_cost),
            "_rev": num(cols.revised_cost),
            "_exp": num(cols.expenditure),
            "_prog": num(cols.progress),
            "_start": day(cols.start_date),
            "_orig_end": day(cols.original_end),
            "_rev_end": day(cols.revised_end),
        })
    )


def _months_away(entity: str, months: int, columns) -> Column:
    """Struct of the row exactly ``months`` away in the same entity, or NULL."""
    frame = Window.partitionBy(entity).orderBy("_idx").rangeBetween(months, months)
    return F.max(F.struct(*columns)).over(frame)


def require_panel(df: DataFrame, cols: PanelColumns | None = None) -> PanelColumns:
    """Raise :class:`PanelError` on a missing key column, a bad period, a duplicate key
    or an empty panel. One aggregation with map-side combine; no rows reach the driver."""
    cols = cols or detect_columns(df.columns)
    for name in (cols.entity, cols.period):
        if name not in df.columns:
            raise PanelError(f"column '{name}' not found")
    dtype = df.schema[cols.period].dataType
    keys = df.select(F.col(cols.entity).alias("e"), P.period(cols.period, dtype).alias("p"))
    rows, bad, extra = (
        keys.groupBy("e", "p").agg(F.count("*").alias("n"))
        .agg(F.sum("n"), F.sum(F.when(F.col("p").isNull(), F.col("n")).otherwise(0)), F.sum(F.col("n") - 1))
        .first()
    )
    if not rows:
        raise PanelError("panel is empty")
    if bad:
        raise PanelError(f"{bad} unparseable reporting periods in '{cols.period}'")
    if extra:
        raise PanelError(f"{extra} duplicate ({cols.entity}, {cols.period}) rows")
    return cols


def _positive_or(value, fallback) -> Column:
    return F.when(value > 0, value).otherwise(fallback)


_PREVIOUS = ["_rev", "_orig", "_exp", "_prog", "_rev_end", "_orig_end"]


def _add_features(df: DataFrame, cols: PanelColumns, previous: Column | None = None) -> DataFrame:
    """``previous``: struct of the month before, where a window cannot find it (streams)."""
    c = F.col
    orig, rev, exp, prog = c("_orig"), c("_rev"), c("_exp"), c("_prog")
    days = lambda end, start: F.datediff(end, start).cast("double")
    eff_cost, eff_end = c("_eff_cost"), c("_eff_end")
    df = df.withColumns({
        "_prev": _months_away(cols.entity, -1, _PREVIOUS) if previous is None else previous,
        "_eff_cost": _positive_or(rev, orig),
        "_eff_end": F.coalesce("_rev_end", "_orig_end"),
        "_age": days(F.last_day("_first"), c("_start")),
    })
    budget = F.when(orig.isNotNull(), F.greatest(eff_cost, orig))
    df = df.withColumns({
        "cost_growth_ratio": F.when(orig > 0, F.greatest(eff_cost, orig) / orig),
        "expenditure_to_original_cost": ratio(exp, orig),
        "expenditure_to_revised_cost": ratio(exp, budget),
        "schedule_slippage_days": F.when(
            c("_orig_end").isNotNull(), F.greatest(F.lit(0.0), days(eff_end, c("_orig_end")))),
        "project_age_days": c("_age"),
        "elapsed_duration_ratio": F.when(
            c("_orig_end").isNotNull(),
            c("_age") / F.greatest(F.lit(1.0), days(c("_orig_end"), c("_start")))),
    })
    prev = c("_prev")
    # The earlier month falls back only when its revised cost is missing, not when it is 0.
    df = df.withColumns({
        "progress_gap": clip(c("elapsed_duration_ratio") * 100.0, 0.0, 100.0) - prog,
        "expenditure_progress_gap": c("expenditure_to_revised_cost") * 100.0 - prog,
        "recent_cost_change": eff_cost - F.coalesce(prev["_rev"], prev["_orig"]),
        "recent_expenditure_change": exp - prev["_exp"],
        "recent_progress_change": prog - prev["_prog"],
        "recent_schedule_change": days(eff_end, F.coalesce(prev["_rev_end"], prev["_orig_end"])),
        "is_first_observation": prev.isNull().cast("int"),
    })
    return df.drop("_prev", "_eff_cost", "_eff_end", "_age")


def check_horizons(horizons, cost_threshold=0.05, schedule_threshold=0.0) -> list:
    """Sorted distinct horizons; raises on anything but positive whole months."""
    for h in horizons:
        if not isinstance(h, int) or isinstance(h, bool) or h <= 0:
            raise PanelError(f"horizons must be positive whole months, got {h!r}")
    if cost_threshold < 0 or schedule_threshold < 0:
        raise PanelError("thresholds must not be negative")
    return sorted(set(horizons))


def target_columns(horizons) -> list:
    """The nine target columns of each horizon, in table order."""
    return [
        name.format(h=h)
        for h in horizons
        for name in (
            "target_cost_escalation_{h}m_cr", "target_cost_escalation_pct_{h}m",
            "target_cost_overrun_{h}m_binary", "target_schedule_slippage_{h}m_days",
            "target_schedule_deterioration_{h}m_binary", "target_horizon_miss_{h}m_binary",
            "is_observable_cost_{h}m", "is_observable_schedule_{h}m", "is_observable_{h}m",
        )
    ]


def _add_targets(df, cols, horizons, cost_threshold, schedule_threshold) -> DataFrame:
    c = F.col
    orig = c("_orig")
    ahead = ["_orig", "_rev", "_orig_end", "_rev_end", "_prog"]
    df = df.withColumns({f"_f{h}": _months_away(cols.entity, h, ahead) for h in horizons})
    base_cost = F.greatest(_positive_or(c("_rev"), orig), orig)
    end_now = F.coalesce("_rev_end", "_orig_end")
    out = {}
    for h in horizons:
        f = c(f"_f{h}")
        cost_then = _positive_or(f["_rev"], _positive_or(f["_orig"], orig))
        cost_known = f.isNotNull() & (orig > 0) & cost_then.isNotNull()
        escalation = F.when(cost_known, F.greatest(F.lit(0.0), cost_then - base_cost))
        end_then = F.coalesce(f["_rev_end"], f["_orig_end"], c("_orig_end"))
        end_known = f.isNotNull() & end_now.isNotNull() & end_then.isNotNull()
        slip = F.when(end_known, F.greatest(F.lit(0.0), F.datediff(end_then, end_now).cast("double")))
        due = f.isNotNull() & (end_now <= F.last_day(F.add_months("_first", h)))
        seen = lambda condition: F.coalesce(condition, F.lit(False)).cast("int")
        values = [
            escalation, escalation / orig, flag(escalation / orig > cost_threshold),
            slip, flag(slip > schedule_threshold), F.when(due, flag(f["_prog"] < 100.0)),
            seen(cost_known), seen(end_known), seen(cost_known & end_known),
        ]
        out.update(zip(target_columns([h]), values))
    return df.withColumns(out).drop(*[f"_f{h}" for h in horizons])


def panel_features(df: DataFrame, cols: PanelColumns | None = None, guard=True) -> DataFrame:
    """The same rows with the 13 point-in-time columns. ``guard`` runs :func:`require_panel`."""
    cols = require_panel(df, cols) if guard else cols or detect_columns(df.columns)
    return _add_features(_typed(df, cols), cols).drop(*_TYPED)


def build_targets(df, horizons=(1, 3, 6, 12), cost_threshold=0.05, schedule_threshold=0.0,
                  cols: PanelColumns | None = None, guard=True) -> DataFrame:
    """The same rows with nine target columns per horizon; an unseen future stays NULL."""
    horizons = check_horizons(horizons, cost_threshold, schedule_threshold)
    cols = require_panel(df, cols) if guard else cols or detect_columns(df.columns)
    typed = _typed(df, cols)
    return _add_targets(typed, cols, horizons, cost_threshold, schedule_threshold).drop(*_TYPED)


def annotate(df, horizons=(1, 3, 6, 12), cost_threshold=0.05, schedule_threshold=0.0,
             cols: PanelColumns | None = None) -> DataFrame:
    """Features and targets in one pass over one shuffle, for panels already checked."""
    horizons = check_horizons(horizons, cost_threshold, schedule_threshold)
    cols = cols or detect_columns(df.columns)
    typed = _add_features(_typed(df, cols), cols)
    return _add_targets(typed, cols, horizons, cost_threshold, schedule_threshold).drop(*_TYPED)


def baseline_columns(columns, cols: PanelColumns) -> list:
    """The eight columns of the basic feature set that exist."""
    wanted = [cols.sector, cols.ministry, cols.original_cost, cols.original_end, cols.revised_cost,
              cols.expenditure, "expenditure_to_original_cost", cols.progress]
    return [c for c in wanted if c in columns]


def model_a(df: DataFrame, cols: PanelColumns | None = None) -> DataFrame:
    cols = cols or detect_columns(df.columns)
    if "expenditure_to_original_cost" not in df.columns:
        df = panel_features(df, cols)
    return df.select(*baseline_columns(df.columns, cols))


def model_b(df: DataFrame, cols: PanelColumns | None = None) -> DataFrame:
    """The basic set plus the derived features it does not already hold."""
    cols = cols or detect_columns(df.columns)
    if "cost_growth_ratio" not in df.columns:
        df = panel_features(df, cols)
    basic = baseline_columns(df.columns, cols)
    return df.select(*basic, *[c for c in FEATURES if c in df.columns and c not in basic])


def previous_month_row(df: DataFrame, columns, cols: PanelColumns | None = None) -> DataFrame:
    """Attach the listed columns of the row at exactly t-1 as ``prev_*``."""
    cols = cols or detect_columns(df.columns)
    typed = df.withColumn("_idx", P.period_index(P.period(cols.period, df.schema[cols.period].dataType)))
    joined = typed.withColumn("_prev", _months_away(cols.entity, -1, columns))
    return joined.withColumns({f"prev_{c}": F.col("_prev")[c] for c in columns}).drop("_prev", "_idx")


def observed_rate(df: DataFrame, value: str, out: str, cols: PanelColumns | None = None) -> DataFrame:
    """Change of ``value`` per month since the previous observed row, whatever the gap."""
    cols = cols or detect_columns(df.columns)
    typed = df.withColumn("_idx", P.period_index(P.period(cols.period, df.schema[cols.period].dataType)))
    w = Window.partitionBy(cols.entity).orderBy("_idx")
    return typed.withColumn(
        out, (number(value) - F.lag(number(value)).over(w)) / (F.col("_idx") - F.lag("_idx").over(w))
    ).drop("_idx")


def target_matrix(df: DataFrame, horizons=(1, 3, 6, 12)) -> DataFrame:
    return df.select(*[c for c in target_columns(horizons) if c in df.columns])


def horizon_audit(df: DataFrame, horizons=(1, 3, 6, 12)) -> DataFrame:
    """Observable rows and positives per horizon, from one aggregate."""
    counts = []
    for h in sorted(set(horizons)):
        one = lambda c: F.count_if(F.col(c) == 1)
        counts.append(F.struct(
            F.lit(h).alias("horizon"),
            F.count("*").alias("total_rows"),
            one(f"is_observable_{h}m").alias("observable"),
            one(f"target_cost_overrun_{h}m_binary").alias("cost_overrun"),
            one(f"target_schedule_deterioration_{h}m_binary").alias("schedule_deterioration"),
            one(f"target_horizon_miss_{h}m_binary").alias("horizon_miss"),
        ))
    return df.agg(F.array(*counts).alias("a")).select(F.inline("a"))
