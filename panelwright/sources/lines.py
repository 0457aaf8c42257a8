"""Page lines to records. Order is always a column: (document, page, line_no).

Windows run within one page of one document. Only one row per page is ordered across a whole
document (headings); serial numbers are followed through blocks of pages.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelwright.functions.text import clean
from panelwright.sources.serials import BLOCK_PAGES, take_serials

CODE = r"\(\d{4,}\)"
LOOKAHEAD = 24
# Words of a unit, not of a project code.
UNIT_WORDS = ["km", "pkg", "phase", "mva", "mw"]
_CODE_SHAPE = r"\(?\s*([A-Z0-9]{8,10})\s*\)?"


def _is_trailer(line) -> Column:
    line = F.col(line)
    return (line.startswith("Total (") | line.startswith("Total(") | line.startswith("Page ")
            | line.contains("Project Assessment"))


def _tidy(lines: DataFrame) -> DataFrame:
    return lines.withColumn("line", F.trim("line")).filter(F.col("line") != "")


def accepted_serials(lines: DataFrame, block_pages=BLOCK_PAGES) -> DataFrame:
    """(document, page, line_no, serial) of the lines that start record 1, 2, 3, ...

    A numeric line qualifies when a code follows within 25 lines of its page. Qualified
    lines are taken greedily in document order, see :mod:`panelwright.sources.serials`.
    """
    page = Window.partitionBy("document", "page").orderBy("line_no")
    ahead = F.max(F.col("line").rlike(CODE)).over(page.rowsBetween(0, LOOKAHEAD))
    found = lines.withColumn("_coded", ahead).filter(F.col("_coded") & F.col("line").rlike(r"^[1-9]\d{0,17}$"))
    return take_serials(found.select("document", "page", "line_no", F.col("line").cast("long").alias("serial")), block_pages)


def segment_records(lines: DataFrame) -> DataFrame:
    """Lines with the ``serial`` of the record they belong to; the rest are dropped.

    A record ends at the next start, the end of its page, or, for the last record of a
    page, the first trailer line.
    """
    tidy = _tidy(lines)
    starts = accepted_serials(tidy).withColumnRenamed("serial", "_start")
    page = Window.partitionBy("document", "page").orderBy("line_no")
    so_far = page.rowsBetween(Window.unboundedPreceding, 0)
    # Starts grow with the lines; they are never broadcast, however small their files are.
    marked = tidy.join(starts.hint("merge"), ["document", "page", "line_no"], "left").withColumns({
        "serial": F.last("_start", ignorenulls=True).over(so_far),
        "_last": F.max("_start").over(Window.partitionBy("document", "page")),
    }).filter(F.col("serial").isNotNull())
    within = Window.partitionBy("document", "page", "serial").orderBy("line_no").rowsBetween(
        Window.unboundedPreceding, 0)
    closed = F.max(_is_trailer("line")).over(within) & (F.col("serial") == F.col("_last"))
    return marked.withColumn("_closed", closed).filter(~F.col("_closed")).drop("_closed", "_last", "_start")


def assemble_records(segments: DataFrame, snapshot: str) -> DataFrame:
    """One row of 14 report columns per record plus ``reject_reason``.

    The lines of a record (at most a page) are put in order and read by the position of
    the code, the dates and the numbers.
    """
    rec = segments.groupBy("document", "page", "serial").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda s: s["line"]).alias("bl"))
    is_date = lambda l: l.rlike(r"^\d{2}/\d{4}$") | l.isin("(-)", "-")
    rec = rec.withColumn("at", F.array_position(F.transform("bl", lambda l: l.rlike(rf"^{CODE}$")), F.lit(True)).cast("int"))
    rec = rec.withColumn("rem", F.when(F.col("at") > 0, F.slice("bl", F.col("at") + 1, F.size("bl"))))
    rec = rec.withColumn("dates", F.filter(
        F.transform("rem", lambda l, i: F.when(is_date(l), i)), lambda i: i.isNotNull()))
    n = F.size("dates")
    last = F.element_at("dates", -1)
    rec = rec.withColumn("after", F.when(n > 0, F.slice("rem", last + 2, F.size("rem"))))
    raw = F.get("bl", F.col("at") - 2)
    bracketed = raw.startswith("(") & raw.endswith(")")
    agency = clean(F.when(bracketed, F.substring(raw, F.lit(2), F.length(raw) - 2)).otherwise(raw))
    words = lambda a, start, length: clean(F.array_join(F.slice(a, start, F.greatest(length, F.lit(0))), " "))
    nth = lambda k: F.get("rem", F.get("dates", F.lit(k)))
    three = n >= 3
    num = lambda k: F.get("after", F.lit(k))
    reason = (
        F.when(F.col("at") == 0, "no project code").when(n == 0, "no dates").when(n == 1, "one date only")
        .when(F.size("after") < 4, "incomplete numbers"))
    return rec.select(
        "document", F.lit(snapshot).alias("snapshot_date"), F.col("page").alias("source_page"),
        F.col("serial").alias("sl_no"),
        F.regexp_extract(F.get("bl", F.col("at") - 1), r"\((\d{4,})\)", 1).alias("project_id"),
        words("bl", F.lit(2), F.col("at") - 3).alias("project_name"), agency.alias("agency"),
        words("rem", F.lit(1), F.get("dates", F.lit(0))).alias("state"),
        F.when(three, nth(0)).otherwise(F.lit("")).alias("approval_date"),
        F.when(three, nth(1)).otherwise(nth(0)).alias("original_completion_date"),
        F.when(three, nth(2)).otherwise(nth(1)).alias("revised_completion_date"),
        num(0).alias("original_cost_crore"),
        F.trim(F.regexp_replace(num(1), r"[()]", "")).alias("revised_cost_crore"),
        num(2).alias("cumulative_expenditure_crore"), num(3).alias("physical_progress_pct"),
        reason.alias("reject_reason"))


def fill_down(df: DataFrame, columns, document="document", page="page", order="row") -> DataFrame:
    """A heading applies until replaced, across pages of the same document.

    Rows are ordered within their page; a page passes on its last heading, so only one
    row per page is ordered across the document.
    """
    within = Window.partitionBy(document, page).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    ends = df.groupBy(document, page).agg(*[
        F.max_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(f"_end_{c}") for c in columns])
    before = Window.partitionBy(document).orderBy(page).rowsBetween(Window.unboundedPreceding, -1)
    carry = ends.select(document, page, *[
        F.last(f"_end_{c}", ignorenulls=True).over(before).alias(f"_carry_{c}") for c in columns])
    return df.join(carry.hint("merge"), [document, page]).withColumns({
        c: F.coalesce(F.last(c, ignorenulls=True).over(within), F.col(f"_carry_{c}")) for c in columns
    }).drop(*[f"_carry_{c}" for c in columns])


def legacy_block(lines) -> Column:
    """``struct<project_name, agency, project_id>`` of the lines of one project block.

    The last line with an 8-10 character code that has a digit and no unit word gives the
    id, the line above it the agency, everything above that the name.
    """
    lines = F.col(lines) if isinstance(lines, str) else lines
    lines = F.filter(F.transform(lines, lambda l: F.trim(l)), lambda l: l != "")
    codes = F.transform(lines, lambda l: F.regexp_extract(l, _CODE_SHAPE, 1))
    unit = lambda c: F.lower(c).rlike("|".join(UNIT_WORDS))
    good = F.transform(codes, lambda c, i: F.when(c.rlike("[0-9]") & ~unit(c), i))
    at = F.array_max(good)
    above = F.get(lines, at - 1)
    paren = F.regexp_extract(above, r"\(\s*([^)]+)\s*\)", 1)
    plain = F.regexp_extract(above, r"\(?\s*([A-Za-z0-9\s&/.\-_]{2,30})\s*\)?", 1)
    has = at > 0
    agency = F.when(has & (paren != ""), F.trim(paren)).when(has & plain.rlike("[A-Za-z]"), F.trim(plain))
    stop = F.when(at.isNull(), F.size(lines)).when(agency.isNotNull(), at - 1).otherwise(at)
    return F.struct(
        F.trim(F.array_join(F.slice(lines, F.lit(1), stop), " ")).alias("project_name"),
        F.coalesce(agency, F.lit("")).alias("agency"),
        F.coalesce(F.get(codes, at), F.lit("")).alias("project_id"))


def locate_region(pages: DataFrame, heading="all ongoing projects", fallbacks=("table 4", "table 6"),
                  default_start=30) -> DataFrame:
    """(document, start_page, end_page) of the project table, from one aggregate.

    Pages with the heading span the region; later pages that start a list extend it.
    Without the heading the fallback headings are used, then a default start.
    """
    text = F.lower("text")
    titled = text.contains(heading)
    other = F.lit(False)
    for f in fallbacks:
        other = other | text.contains(f)
    lists = F.col("text").rlike(r"(?m)^\s*1\s*$")
    p = F.col("page")
    marks = pages.groupBy("document").agg(
        F.min(F.when(titled, p)).alias("t0"), F.max(F.when(titled, p)).alias("t1"),
        F.max(F.when(lists, p)).alias("l1"),
        F.min(F.when(other, p)).alias("f0"), F.max(F.when(other, p)).alias("f1"), F.max(p).alias("pages"))
    extended = F.greatest("t1", F.when(F.col("l1") > F.col("t0"), F.col("l1")))
    return marks.select(
        "document", F.coalesce("t0", "f0", F.lit(default_start)).alias("start_page"),
        F.when(F.col("t0").isNotNull(), extended).otherwise(F.coalesce("f1", "pages")).alias("end_page"))
