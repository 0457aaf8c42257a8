"""A keyed table stored by key range, so that an upsert rewrites only the ranges it touches.

Each range (see :mod:`panelwright.operators.digests`) lives in a folder of its own. A manifest
lists range, folder and digest; a numbered pointer names the manifest that counts. An upsert
reads the ranges of its keys, writes them to new folders, compares them with their source, and
then publishes a manifest that keeps the other ranges' folders as they are. A failure before
that leaves the published table as it was, and readers keep the files they began with.

Only lists of ranges reach the driver, at most ``16 ** digits`` of them. One writer at a time.
Keys are unique and not null; updates that break this are refused. Superseded folders stay.
"""

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from panelwright.errors import ContractError
from panelwright.operators import digests
from panelwright.sources import sinks

MANIFEST = "node string, folder string, row_count bigint, content decimal(38,0)"
_SETTINGS = "keys array<string>, digits int, files int, columns string"


def _settings(spark, path):
    return spark.read.schema(_SETTINGS).json(f"{path}/_settings").first()


def _require_keys(df, keys):
    bad = df.groupBy(*keys).agg(F.count("*").alias("_n")).filter(" OR ".join(["_n > 1", *[f"`{k}` IS NULL" for k in keys]]))
    if not bad.isEmpty():
        raise ContractError(f"the key {', '.join(keys)} is null or repeated")


def _store(df: DataFrame, path, settings) -> DataFrame:
    """Write rows by range to a new folder; the manifest rows of what is stored there."""
    spark, keys, base = df.sparkSession, list(settings.keys), f"data-{uuid.uuid4().hex}"
    part = F.pmod(F.xxhash64(*keys), F.lit(settings.files))
    placed = df.withColumn("_node", digests.range_of(keys, settings.digits))
    placed.repartition("_node", part).write.partitionBy("_node").parquet(f"{path}/{base}")
    schema = StructType.fromJson(df.schema.jsonValue()).add("_node", "string")
    stored = spark.read.schema(schema).parquet(f"{path}/{base}")
    written = digests.range_digests(stored, keys, df.columns, settings.digits)
    if not digests.changed_ranges(digests.range_digests(df, keys, df.columns, settings.digits), written).isEmpty():
        raise ContractError(f"written ranges differ from their source: {path}/{base}")
    return written.select("node", F.concat(F.lit(f"{base}/_node="), "node").alias("folder"), "row_count", "content")


def _publish(manifest: DataFrame, path):
    folder = f"manifest-{uuid.uuid4().hex}"
    manifest.coalesce(1).write.parquet(f"{path}/{folder}")
    sinks._publish(manifest.sparkSession, path, folder)


def create(df: DataFrame, path, keys, digits=2, files=1):
    """Store a table whose ``keys`` tell its rows apart; each range is written by ``files`` tasks."""
    _require_keys(df, keys)
    spark = df.sparkSession
    row = [(list(keys), digits, files, df.schema.json())]
    spark.createDataFrame(row, _SETTINGS).coalesce(1).write.mode("overwrite").json(f"{path}/_settings")
    _publish(_store(df, path, _settings(spark, path)), path)


def manifest(spark: SparkSession, path) -> DataFrame:
    """(node, folder, row_count, content) of the published ranges; digests of the whole table."""
    return spark.read.schema(MANIFEST).parquet(sinks.published(spark, path))


def _rows(spark, path, settings, ranges: DataFrame) -> DataFrame:
    schema = StructType.fromJson(json.loads(settings.columns))
    folders = [f"{path}/{r.folder}" for r in ranges.select("folder").collect()]
    return spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)


def read(spark: SparkSession, path) -> DataFrame:
    """The published rows."""
    return _rows(spark, path, _settings(spark, path), manifest(spark, path))


def upsert(updates: DataFrame, path, keep_filled=()) -> list:
    """Update rows of the same key, insert the others, in the ranges that ``updates`` touches; returns these.

    The rules for columns are those of :func:`panelwright.sources.sinks.upsert`.
    """
    spark = updates.sparkSession
    settings = _settings(spark, path)
    keys = list(settings.keys)
    _require_keys(updates, keys)
    touched = sorted(r[0] for r in updates.select(digests.range_of(keys, settings.digits)).distinct().collect())
    if touched:
        listed, hit = manifest(spark, path), F.col("node").isin(touched)
        stored = _rows(spark, path, settings, listed.filter(hit))
        changed = _store(sinks.upsert(stored, updates, keys, keep_filled), path, settings)
        _publish(listed.filter(~hit).unionByName(changed), path)
    return touched
