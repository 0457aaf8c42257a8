"""Text table scans: every column is a string, blanks and NA tokens are NULL."""

import csv

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Tokens a table reader treats as missing.
NA_TOKENS = ["", "NA", "N/A", "n/a", "nan", "NaN", "NULL", "null", "None", "<NA>", "#N/A"]


def all_strings(columns) -> T.StructType:
    return T.StructType([T.StructField(c, T.StringType()) for c in columns])


def tokens_to_null(df: DataFrame, tokens=NA_TOKENS) -> DataFrame:
    """The one missing-value rule, applied at the scan; NaN in float columns included."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.StringType):
            c = F.when(~F.trim(c).isin(tokens), c)
        elif isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = F.when(~F.isnan(c), c)
        out.append(c.alias(f.name))
    return df.select(*out)


def read_panel(spark: SparkSession, path, columns=None) -> DataFrame:
    """CSV with a header, read as strings under an explicit schema when ``columns`` is given."""
    reader = spark.read.option("header", True).option("mode", "FAILFAST").option("escape", '"')
    if columns is not None:
        reader = reader.schema(all_strings(columns)).option("enforceSchema", False)
    return tokens_to_null(reader.csv(path))


def read_titled_csv(spark: SparkSession, path, title="Projects Details") -> DataFrame:
    """CSV whose files may carry a two-line title above the header (one record per line).

    The first three lines of each file go by their position; any later line is data, also
    one that repeats the header. A row that is wider or narrower than the header fails.
    """
    head = [r.value for r in spark.read.text(path).head(3)]
    if len(head) < 3 or title not in head[0]:
        return read_panel(spark, path)
    names = next(csv.reader([head[2]]))
    # Ids rise within a task in line order, so a file's first block tells its first lines.
    lines = spark.read.text(path).select(
        "value", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_line"))
    first = lines.filter("_block = 0").groupBy("_file").agg(F.min("_line").alias("_first"))
    body = lines.join(first, "_file").filter("(_block > 0 or _line >= _first + 3) and trim(value) <> ''")
    parsed = body.select(F.from_csv("value", ", ".join(f"`c{i}` string" for i in range(len(names))), {"mode": "FAILFAST", "escape": '"'}).alias("r"))
    return tokens_to_null(parsed.select("r.*").toDF(*names))
