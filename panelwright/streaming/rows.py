"""Row-local operators on a stream: no state, so they apply to arriving rows unchanged."""

from pyspark.sql import DataFrame, SparkSession

from panelwright.operators.harmonize import SnapshotSpec, to_canonical
from panelwright.sources.cells import identify_rows, parse_rows

CELL_SCHEMA = "source_page int, row_index int, cells array<string>"


def read_cells(spark: SparkSession, path) -> DataFrame:
    """Stream of extracted table rows as they land in a folder."""
    return spark.readStream.schema(CELL_SCHEMA).parquet(path)


def parsed_stream(cells: DataFrame, snapshot: str, expected: int) -> DataFrame:
    """Report rows of a cell stream; rejected rows carry their reason."""
    return parse_rows(identify_rows(cells, expected), snapshot)


def canonical_stream(rows: DataFrame, spec: SnapshotSpec) -> DataFrame:
    """Canonical rows of a report-row stream; unreadable months become NULL."""
    return to_canonical(rows, spec, bad_months="null")
