"""Checks of one snapshot table: serials, ids, gaps, totals, vocabularies, expectations.

Counts that look at single rows are written as aggregates so that several checks of the
same table can share one pass; see :func:`one_pass`.
"""

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwright.functions.numeric import number
from panelwright.functions.periods import is_month_slash_year
from panelwright.operators.scale import beside

# Fields a snapshot row must not miss.
CRITICAL_FIELDS = ["project_id", "project_name", "state", "original_cost_crore", "revised_cost_crore",
                   "cumulative_expenditure_crore", "physical_progress_pct"]
DASHES = ["(-)", "-"]
NA_TOKENS = ["NA", "N.A.", "-", "(-)"]


def _blank(c):
    return F.col(c).isNull() | (F.trim(F.col(c).cast("string")) == "")


def one_pass(df: DataFrame, checks: dict, name="check", value="violations") -> DataFrame:
    """(check, violations) for named conditions, from a single aggregate."""
    return df.agg(F.array(*[
        F.struct(F.lit(k).alias(name), F.count_if(c).alias(value)) for k, c in checks.items()
    ]).alias("a")).select(F.inline("a"))


def serial_continuity(df: DataFrame, serial="sl_no", expected=None) -> DataFrame:
    """One row: rows, distinct, min, max, repeated serials and serials missing of 1..expected."""
    s = F.col(serial).cast("long")
    per = df.select(s.alias("s")).groupBy("s").agg(F.count("*").alias("n"))
    top = F.lit(expected).cast("long") if expected is not None else F.max("s")
    seen = F.count_if(F.col("s").between(1, expected)) if expected is not None else F.count_if(F.col("s") >= 1)
    return per.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("row_count"), F.count("s").alias("distinct_serials"),
        F.min("s").alias("min_serial"), F.max("s").alias("max_serial"),
        F.count_if(F.col("s").isNotNull() & (F.col("n") > 1)).alias("duplicate_serials"),
        (F.coalesce(top, F.lit(0)) - seen).alias("missing_serials"))


def id_checks(df: DataFrame, project_id="project_id", serial="sl_no") -> DataFrame:
    """One row: repeated ids, ids equal to their serial, ids that are no number."""
    pid = F.trim(F.col(project_id).cast("string"))
    per = df.groupBy(pid.alias("p")).agg(
        F.count("*").alias("n"),
        F.count_if(pid == F.col(serial).cast("string")).alias("same"),
        F.count_if(~pid.rlike(r"^[0-9]+$")).alias("text"))
    return per.agg(
        F.count_if(F.col("p").isNotNull() & (F.col("n") > 1)).alias("duplicate_ids"),
        F.coalesce(F.sum("same"), F.lit(0)).alias("id_equals_serial"),
        F.coalesce(F.sum("text"), F.lit(0)).alias("non_numeric_ids"))


def missing_fields(df: DataFrame, fields=CRITICAL_FIELDS, serial="sl_no") -> DataFrame:
    """(field, serial, missing): every serial with a blank field, beside the field's blank count."""
    tall = df.select(F.col(serial).cast("long").alias("serial"), F.explode(F.filter(
        F.array(*[F.when(_blank(f), F.lit(f)) for f in fields]), lambda x: x.isNotNull())).alias("field"))
    counts = df.agg(F.map_from_arrays(
        F.array(*[F.lit(f) for f in fields]), F.array(*[F.count_if(_blank(f)) for f in fields])).alias("_counts"))
    return beside(tall, counts).select("field", "serial", F.col("_counts")[F.col("field")].alias("missing"))


def cross_field_anomalies(df: DataFrame) -> DataFrame:
    orig, rev, spend = (number(c) for c in (
        "original_cost_crore", "revised_cost_crore", "cumulative_expenditure_crore"))
    return one_pass(df, {
        "revised_below_original": rev < orig, "revised_above_original": rev > orig,
        "revised_equals_original": rev == orig, "spend_above_revised": spend > rev,
        "spend_above_original": spend > orig})


def date_tallies(df: DataFrame, columns) -> DataFrame:
    """(column, valid, dash, blank, malformed); blank also counts as valid layout."""
    rows = []
    for c in columns:
        s = F.trim(F.coalesce(F.col(c), F.lit("")))
        ok, dash = is_month_slash_year(s), s.isin(DASHES)
        rows.append(F.struct(
            F.lit(c).alias("column_name"), F.count_if(ok).alias("valid"), F.count_if(dash).alias("dash"),
            F.count_if(s == "").alias("blank"), F.count_if(~ok & ~dash).alias("malformed")))
    return df.agg(F.array(*rows).alias("a")).select(F.inline("a"))


def range_checks(df: DataFrame, ranges, text_columns) -> DataFrame:
    """Values outside [low, high], and category values that look like numbers."""
    checks = {f"{c}_outside": ~number(c).between(low, high) for c, (low, high) in ranges.items()}
    checks.update({f"{c}_numeric": F.trim(F.col(c)).rlike(r"^[0-9]+$") for c in text_columns})
    return one_pass(df, checks)


def totals_reconciliation(df: DataFrame, official: dict, tolerance=0.01) -> DataFrame:
    """Exact decimal totals against official ones: (measure, actual, official, difference, matches)."""
    money = lambda c: F.col(c).try_cast("decimal(18,2)")
    sums = {
        "original_cost": F.sum(money("original_cost_crore")),
        "revised_or_original_cost": F.sum(F.coalesce(money("revised_cost_crore"), money("original_cost_crore"))),
        "expenditure": F.sum(money("cumulative_expenditure_crore")),
        "anticipated_cost": F.sum(money("anticipated_cost_crore")) if "anticipated_cost_crore" in df.columns else None,
    }
    wide = "decimal(38,2)"
    rows = [
        F.struct(F.lit(k).alias("measure"), F.coalesce(v, F.lit(0)).cast(wide).alias("actual"),
                 F.lit(str(official[k])).cast(wide).alias("official"))
        for k, v in sums.items() if k in official and v is not None]
    out = df.agg(F.array(*rows).alias("a")).select(F.inline("a"))
    gap = F.col("actual") - F.col("official")
    return out.withColumn("difference", gap).withColumn("matches", F.abs(gap) <= F.lit(str(tolerance)).cast(wide))


def expectations(df: DataFrame, measures: dict, expected: dict) -> DataFrame:
    """Named aggregates against exact expected counts."""
    return df.agg(F.array(*[
        F.struct(F.lit(k).alias("measure"), m.cast("long").alias("actual"),
                 F.lit(expected[k]).cast("long").alias("expected"))
        for k, m in measures.items()]).alias("a")).select(F.inline("a")).withColumn(
        "matches", F.col("actual") == F.col("expected"))


def vocabulary_violations(df: DataFrame, vocabularies: dict) -> DataFrame:
    """(column, value, rows) of values outside each closed vocabulary."""
    tall = df.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("column_name"), F.col(c).alias("value"),
                 (~F.col(c).isin(list(v))).alias("bad")) for c, v in vocabularies.items()])))
    return tall.filter("bad").groupBy("column_name", "value").agg(F.count("*").alias("row_count"))


def key_alignment(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """One row: keys only in ``a``, only in ``b``, in both."""
    ka, kb = (d.select(key).distinct() for d in (a, b))
    sides = ka.withColumn("_a", F.lit(1)).join(kb.withColumn("_b", F.lit(1)), key, "full")
    return sides.agg(
        F.count_if(F.col("_b").isNull()).alias("only_left"), F.count_if(F.col("_a").isNull()).alias("only_right"),
        F.count_if(F.col("_a").isNotNull() & F.col("_b").isNotNull()).alias("both"))


def orphans(child: DataFrame, parent: DataFrame, key: str) -> DataFrame:
    """Child rows whose key has no parent."""
    return child.join(parent.select(key), key, "left_anti")


def spot_checks(df: DataFrame, expected: DataFrame, key: str, columns) -> DataFrame:
    """(key, column, expected, actual) of expected cells that differ or are missing."""
    actual = df.select(key, *[F.col(c).cast("string").alias(f"_{c}") for c in columns])
    both = expected.select(key, *[F.col(c).cast("string") for c in columns]).join(actual, key, "left")
    cells = both.select(key, F.inline(F.array(*[
        F.struct(F.lit(c).alias("column_name"), F.col(c).alias("expected"), F.col(f"_{c}").alias("actual"))
        for c in columns])))
    return cells.filter(~F.col("expected").eqNullSafe(F.col("actual")))


def representatives(df: DataFrame, serial="sl_no") -> DataFrame:
    """One sample row per audit category, the first in serial order (longest name by length)."""
    s = F.col(serial).cast("long")
    row = F.struct(s.alias("serial"), "project_id", "project_name")
    first = lambda cond: F.min_by(row, F.when(cond, s))
    cost = number("revised_cost_crore") != number("original_cost_crore")
    picks = {
        "normal": first(s.isNotNull()),
        "unrevised_completion": first(F.trim("revised_completion_date").isin(DASHES)),
        "revised_cost_differs": first(cost),
        "multi_state": first(F.contains("state", F.lit("Multi-States"))),
        "longest_name": F.max_by(row, F.struct(F.length("project_name"), -s)),
        "blank_approval": first(_blank("approval_date")),
        "blank_state": first(_blank("state")),
    }
    return df.agg(F.array(*[
        F.struct(F.lit(k).alias("category"), v.alias("r")) for k, v in picks.items()]).alias("a")).select(
        F.inline("a")).filter(F.col("r.serial").isNotNull()).select("category", "r.*")


def missing_class(df: DataFrame, columns, unavailable: dict, source="source_snapshot") -> DataFrame:
    """Per cell why a value is missing: (source, column, class, rows).

    UNAVAILABLE when the source does not publish the column, UNREVISED for a dash,
    GENUINELY_MISSING for a blank or NA token, PRESENT otherwise.
    """
    def classify(c):
        absent = [s for s, cols in unavailable.items() if c in cols]
        text = F.trim(F.col(c))
        return (
            F.when(F.col(source).isin(absent) if absent else F.lit(False), "UNAVAILABLE")
            .when(text.isin(DASHES), "UNREVISED")
            .when(_blank(c) | F.upper(text).isin(NA_TOKENS), "GENUINELY_MISSING").otherwise("PRESENT"))

    tall = df.select(F.col(source).alias("source"), F.inline(F.array(*[
        F.struct(F.lit(c).alias("column_name"), classify(c).alias("missing_class")) for c in columns])))
    return tall.groupBy("source", "column_name", "missing_class").agg(F.count("*").alias("row_count"))


def canonical_gates(df: DataFrame, snapshot_dates) -> DataFrame:
    """(check, violations) of a canonical table: key, provenance, dates, zero-filled blanks."""
    provenance = ["source_page", "source_row", "source_file", "source_record_hash"]
    missing = reduce(lambda a, b: a | b, [_blank(c) for c in provenance])
    zero = lambda c: number(c) == 0
    rows = one_pass(df, {
        "key_missing": _blank("canonical_observation_key"),
        "provenance_incomplete": missing,
        "snapshot_date_unknown": ~F.coalesce(F.col("snapshot_date").isin(list(snapshot_dates)), F.lit(False)),
        "month_layout": ~(F.col("approval_date").rlike(r"^\d{4}-\d{2}$")),
        "zero_filled_cost": zero("original_cost_crore") | zero("anticipated_cost_crore"),
    })
    extra = df.groupBy("canonical_observation_key").agg(F.count("*").alias("n")).agg(
        F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("violations"))
    return rows.unionByName(extra.select(F.lit("duplicate_keys").alias("check"), "violations"))


def row_text(columns):
    """The named cells of a row as one text, a missing one as a tilde."""
    return F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("~")) for c in columns])


def row_part(columns):
    """What a row adds to the content hash: 13 hex digits of md5 as a number."""
    return F.conv(F.substring(F.md5(row_text(columns)), 1, 13), 16, 10).cast("decimal(20,0)")


def fingerprint(df: DataFrame, columns=None) -> DataFrame:
    """Order-insensitive (row_count, hash): the sum of 13 hex digits of md5 over the rows."""
    return df.agg(F.count("*").alias("row_count"),
                  F.coalesce(F.sum(row_part(columns or df.columns)), F.lit(0)).cast("decimal(38,0)").cast("string").alias("content_hash"))


def same_content(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: whether two tables hold the same rows, by count and fingerprint."""
    left = fingerprint(a).select(F.struct("*").alias("l"))
    right = fingerprint(b, a.columns).select(F.struct("*").alias("r"))
    return beside(left, right).select((F.col("l") == F.col("r")).alias("same"))
