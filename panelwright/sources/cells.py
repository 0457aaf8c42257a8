"""Extracted table cells to typed report rows: column expressions only, one pass, no shuffle."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelwright.functions.text import clean, number_token, pair

CELL_COUNT = 8


def serial_of(cells, expected) -> Column:
    """First of the first two cells holding 1-4 digits within 1..expected."""
    looks = lambda c: c.rlike(r"^\d{1,4}$")
    numbers = F.transform(F.filter(F.slice(cells, 1, 2), looks), lambda c: c.cast("int"))
    return F.get(F.filter(numbers, lambda n: n.between(1, expected)), F.lit(0))


def project_code(text) -> Column:
    """First parenthesised 5-8 digit code, else ''."""
    return F.regexp_extract(text, r"\((\d{5,8})\)", 1)


def identify_rows(df: DataFrame, expected) -> DataFrame:
    """Project rows of a table stream: those with a serial and a code."""
    # A one-row generator keeps the optimizer from repeating the cleaning in the filter and
    # in every column that uses the cells.
    once = lambda rows, **cols: rows.select(
        *[c for c in rows.columns if c not in cols],
        F.inline(F.array(F.struct(*[v.alias(k) for k, v in cols.items()]))))
    tidy = once(df, cells=F.transform("cells", clean))
    joined = F.array_join(F.filter("cells", lambda c: c != ""), " ")
    read = once(tidy, cells=F.col("cells"), sl_no=serial_of("cells", expected), project_code=project_code(joined))
    return read.filter(F.col("sl_no").isNotNull() & (F.col("project_code") != ""))


def split_block(block, code, serial) -> Column:
    """Name, trailing bracketed agency, and the first two bracketed ids after the code."""
    marker = F.concat(F.lit("("), code, F.lit(")"))
    at = F.position(marker, block)
    before = F.trim(F.when(at > 0, F.substring(block, F.lit(1), at - 1)).otherwise(block))
    after = F.when(at > 0, F.substring(block, at + F.length(marker), F.length(block))).otherwise(F.lit(""))
    number = serial.cast("string")
    before = F.trim(F.when(F.startswith(before, number), F.substring(before, F.length(number) + 1, F.length(before)))
                    .otherwise(before))
    agency_at = r"\(([^()]*)\)\s*$"
    ids = F.regexp_extract_all(after, F.lit(r"\(([^()]*)\)"))
    return F.struct(
        F.trim(F.regexp_replace(before, agency_at, "")).alias("project_name"),
        F.trim(F.regexp_extract(before, agency_at, 1)).alias("agency"),
        F.coalesce(F.trim(F.get(ids, F.lit(0))), F.lit("")).alias("legacy_ocms_code"),
        F.coalesce(F.trim(F.get(ids, F.lit(1))), F.lit("")).alias("pmgid"))


def reject_reason(state) -> Column:
    """Why a row does not have the standard shape, else NULL."""
    return (F.when(F.size("cells") != CELL_COUNT, F.format_string("expected %d cells, found %d", F.lit(CELL_COUNT), F.size("cells")))
            .when(state == "", "state is empty").when(state.rlike(r"^\d+$"), "state is a number"))


def parse_rows(df: DataFrame, snapshot: str, strict=False) -> DataFrame:
    """The 17 report columns plus ``reject_reason``; ``strict`` raises on a rejected row."""
    cell = lambda i: F.coalesce(F.get("cells", F.lit(i)), F.lit(""))
    state = cell(2)  # the cells were cleaned when the rows were identified
    rows = df.withColumns({
        "_block": split_block(cell(1), F.col("project_code"), F.col("sl_no")),
        "_start": pair(cell(3)), "_end": pair(cell(4)), "_cost": pair(cell(5), numeric=True),
        "reject_reason": reject_reason(state),
    })
    if strict:
        rows = rows.withColumn("reject_reason", F.when(
            F.col("reject_reason").isNotNull(), F.raise_error(F.col("reject_reason")).cast("string")))
    return rows.select(
        F.lit(snapshot).alias("snapshot_date"), "source_page", "sl_no",
        F.col("project_code").alias("project_id"), "_block.project_name", "_block.agency",
        "_block.legacy_ocms_code", "_block.pmgid", state.alias("state"),
        F.col("_start.top").alias("approval_date"), F.col("_start.inner").alias("start_date"),
        F.col("_end.top").alias("original_completion_date"), F.col("_end.inner").alias("revised_completion_date"),
        F.col("_cost.top").alias("original_cost_crore"), F.col("_cost.inner").alias("revised_cost_crore"),
        number_token(cell(6)).alias("cumulative_expenditure_crore"),
        number_token(cell(7)).alias("physical_progress_pct"), "reject_reason")
