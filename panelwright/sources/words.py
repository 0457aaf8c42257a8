"""Positioned words to table rows; every window is within one page."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelwright.functions.text import expand_truncated, number_token, triple
from panelwright.sources.lines import fill_down, legacy_block

PAGE = ["document", "page"]
# Column bands as left edge (inclusive) and right edge (exclusive).
BANDS = {"state": (10, 75), "sector": (75, 130), "project": (155, 295), "approval": (295, 335),
         "dates": (335, 420), "costs": (420, 490), "expenditure": (490, 555), "progress": (555, 600)}
SERIAL_BAND = (125, 158)
TABLE_TOP, TABLE_BOTTOM = 130, 768
SLACK = 3
# Sector names cut off by their column.
TRUNCATED_SECTORS = {"TELECOMMUNI": "TELECOMMUNICATIONS"}


def group_lines(words: DataFrame, group, gap=SLACK) -> DataFrame:
    """(group, line_no, line): a word starts a new line when its y jumps by more than ``gap``."""
    order = Window.partitionBy(*group).orderBy("y", "x", "word_no")
    jump = F.coalesce(F.abs(F.col("y") - F.lag("y").over(order)) > gap, F.lit(True)).cast("int")
    numbered = words.withColumn("_jump", jump).withColumn(
        "line_no", F.sum("_jump").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    text = F.array_sort(F.collect_list(F.struct("y", "x", "word_no", "text")))
    return numbered.groupBy(*group, "line_no").agg(
        F.array_join(F.transform(text, lambda w: w["text"]), " ").alias("line"))


def assign_rows(words: DataFrame) -> DataFrame:
    """Words of the table with ``serial`` (row) and ``band`` (column).

    A row reaches from its serial word (less a slack) to the next one; the last row of a
    page stops at a total line. Words outside every row are dropped.
    """
    table = words.filter(F.col("y").between(TABLE_TOP, TABLE_BOTTOM))
    is_serial = F.col("x").between(*SERIAL_BAND) & F.col("text").rlike(r"^[0-9]+$")
    total = F.min_by("y", F.when(F.lower("text") == "total", F.col("word_no"))) - SLACK
    totals = table.groupBy(*PAGE).agg(total.alias("_total"))
    marks = table.filter(is_serial).select(
        *PAGE, "word_no", F.lit(None).cast("double").alias("x"), (F.col("y") - SLACK).alias("y"),
        F.lit(None).cast("string").alias("text"), F.col("text").cast("long").alias("_serial"))
    stream = table.withColumn("_serial", F.lit(None).cast("long")).select(
        *PAGE, "word_no", F.col("x").cast("double"), F.col("y").cast("double"), "text", "_serial").unionByName(marks)
    w = Window.partitionBy(*PAGE).orderBy("y", F.col("_serial").isNull(), "word_no").rowsBetween(
        Window.unboundedPreceding, 0)
    rows = stream.withColumns({
        "serial": F.last("_serial", ignorenulls=True).over(w),
        "_top": F.last(F.when(F.col("_serial").isNotNull(), F.col("y")), ignorenulls=True).over(w),
        "_last": F.max(F.when(F.col("_serial").isNotNull(), F.col("y"))).over(Window.partitionBy(*PAGE)),
    }).filter(F.col("text").isNotNull() & F.col("serial").isNotNull())
    beyond = (F.col("_top") == F.col("_last")) & (F.col("y") >= F.coalesce("_total", F.lit(float(TABLE_BOTTOM))))
    band = F.lit(None).cast("string")
    for name, (left, right) in BANDS.items():
        band = F.when((F.col("x") >= left) & (F.col("x") < right), F.lit(name)).otherwise(band)
    return rows.join(totals, PAGE).filter(~beyond).withColumn("band", band).drop("_total", "_top", "_last", "_serial")


def words_to_cells(words: DataFrame) -> DataFrame:
    """One row per (document, page, serial): the words of each band in reading order."""
    rows = assign_rows(words).filter(F.col("band").isNotNull())
    entry = F.struct("y", "x", "word_no", "text")
    joined = lambda name: F.array_join(F.transform(F.array_sort(F.collect_list(
        F.when(F.col("band") == name, entry))), lambda w: w["text"]), " ")
    return rows.groupBy(*PAGE, "serial").agg(*[joined(b).alias(b) for b in BANDS])


def block_lines(block, gap=SLACK) -> Column:
    """Lines of one block given as an ordered array of ``struct<y, ..., text>``."""
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit(None).cast("string").alias("line"),
                     F.lit(None).cast("double").alias("y"))

    def step(acc, w):
        same = F.abs(w["y"] - acc["y"]) <= gap
        return F.when(same, F.struct(acc["done"].alias("done"), F.concat_ws(" ", acc["line"], w["text"]).alias("line"),
                                     w["y"].alias("y"))).otherwise(
            F.struct(F.array_compact(F.array_append(acc["done"], acc["line"])).alias("done"),
                     w["text"].alias("line"), w["y"].alias("y")))

    return F.aggregate(block, start, step, lambda acc: F.array_compact(F.array_append(acc["done"], acc["line"])))


def parse_words(words: DataFrame, snapshot: str) -> DataFrame:
    """The 17 report columns of a positioned-word table; one shuffle by page."""
    rows = assign_rows(words).filter(F.col("band").isNotNull())
    entry = F.struct("y", "x", "word_no", "text")
    of_band = lambda name: F.array_sort(F.collect_list(F.when(F.col("band") == name, entry)))
    cells = rows.groupBy(*PAGE, "serial").agg(*[of_band(b).alias(b) for b in BANDS])
    cells = cells.withColumn("_lines", block_lines(F.col("project"))).withColumns({
        b: F.array_join(F.transform(b, lambda w: w["text"]), " ") for b in BANDS})
    heading = lambda c: F.when(F.length(F.trim(c)) > 2, F.trim(c))
    both = cells.withColumns({
        "state": heading("state"),
        "sector": expand_truncated(heading("sector"), TRUNCATED_SECTORS),
        "_block": legacy_block("_lines"),
        "_dates": triple("dates"), "_costs": triple("costs", numeric=True),
    })
    filled = fill_down(both, ["state", "sector"], order="serial")
    return filled.select(
        "document", F.lit(snapshot).alias("snapshot_date"), F.col("page").alias("source_page"),
        F.col("serial").alias("sl_no"), "_block.project_id", "_block.project_name", "_block.agency",
        "state", "sector", F.trim("approval").alias("approval_date"),
        F.col("_dates.original").alias("original_completion_date"),
        F.col("_dates.revised").alias("revised_completion_date"),
        F.col("_dates.anticipated").alias("anticipated_completion_date"),
        F.col("_costs.original").alias("original_cost_crore"), F.col("_costs.revised").alias("revised_cost_crore"),
        F.col("_costs.anticipated").alias("anticipated_cost_crore"),
        number_token("expenditure").alias("cumulative_expenditure_crore"),
        number_token("progress").alias("physical_progress_pct"))
