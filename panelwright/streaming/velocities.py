"""Point-in-time features on a stream of panel rows.

A row's changes need the same entity's month before. The stream is joined with itself, one month
on, as a left outer join under a watermark on the month. A row leaves as soon as both months
are known, in whatever order they came; once the watermark has passed its month, it leaves as a
first observation. State holds the months that the watermark has not passed, per entity and month.

Late rows: a month below the watermark gets no row. A month that only just fell below it still
counts as the month before of a row that waits for it. Repeated months of an entity: the first to
arrive counts; of several with different values in one batch, any one does. Rows without an
entity or a readable month have no place in time; :func:`unreadable_rows` returns them.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwright.operators import panel as P

#: How far the newest month may be ahead of one that still arrives.
LATENESS = "62 days"


def _placed(rows, cols):
    return F.col(cols.entity).isNotNull() & F.col("_period").isNotNull()


def unreadable_rows(rows: DataFrame, cols: P.PanelColumns | None = None) -> DataFrame:
    """Rows that :func:`feature_stream` cannot place."""
    cols = cols or P.detect_columns(rows.columns)
    return P._typed(rows, cols).filter(~_placed(rows, cols)).select(*rows.columns)


def feature_stream(rows: DataFrame, cols: P.PanelColumns | None = None, lateness=LATENESS) -> DataFrame:
    """The rows with the columns of ``panel_features``, for append mode."""
    cols = cols or P.detect_columns(rows.columns)
    typed = P._typed(rows, cols).filter(_placed(rows, cols))
    now = (typed.withColumn("_at", F.col("_first").cast("timestamp"))
           .withWatermark("_at", lateness).dropDuplicates([cols.entity, "_at"]))
    before = (typed.select(F.col(cols.entity).alias("_of"), F.add_months("_first", 1).cast("timestamp").alias("_due"),
                           F.struct(*P._PREVIOUS).alias("_before"))
              .withWatermark("_due", lateness).dropDuplicates(["_of", "_due"]))
    joined = now.join(before, (F.col(cols.entity) == F.col("_of")) & (F.col("_at") == F.col("_due")), "left")
    return P._add_features(joined, cols, F.col("_before")).select(*rows.columns, *P.FEATURES)


def append_features(rows: DataFrame, path, checkpoint, lateness=LATENESS):
    """Add the features of all rows that have arrived since the last call with this checkpoint to a Parquet table."""
    feature_stream(rows, lateness=lateness).writeStream.format("parquet").option(
        "checkpointLocation", str(checkpoint)).trigger(availableNow=True).start(str(path)).awaitTermination()
