"""Writers: idempotent, verified before publishing, and free of driver data."""

import json
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwright.errors import ContractError
from panelwright.operators.quality import require_clean
from panelwright.operators.snapshots import fingerprint, orphans, same_content


def write(df: DataFrame, path, partition_by=()):
    df.write.mode("overwrite").partitionBy(*partition_by).parquet(path)


def save_artifacts(tables: dict, metadata: dict, path) -> dict:
    """Write named tables and one metadata row; a table with ``split`` is partitioned by it."""
    spark = next(iter(tables.values())).sparkSession
    paths = {}
    for name, df in tables.items():
        paths[name] = f"{path}/{name}"
        write(df, paths[name], ["split"] if "split" in df.columns else [])
    paths["metadata"] = f"{path}/metadata"
    line = json.dumps(metadata, sort_keys=True, default=str)
    spark.createDataFrame([(line,)], "value string").coalesce(1).write.mode("overwrite").text(paths["metadata"])
    return paths


def upsert(df: DataFrame, updates: DataFrame, keys, keep_filled=("source_url",)) -> DataFrame:
    """Update matching rows, insert the rest.

    Columns of ``updates`` replace the stored ones, except that a filled ``keep_filled``
    column stays. Keys are unique on the update side, so no row multiplies.
    """
    new = [c for c in updates.columns if c not in keys]
    incoming = updates.select(*keys, F.lit(True).alias("_hit"), *[F.col(c).alias(f"_new_{c}") for c in new])
    both = df.join(incoming, list(keys), "full")
    out = []
    for c in df.columns:
        if c in new:
            stored = F.col(c)
            fresh = F.col(f"_new_{c}")
            if c in keep_filled:
                fresh = F.coalesce(F.nullif(stored, F.lit("")), fresh)
            out.append(F.when(F.col("_hit"), fresh).otherwise(stored).alias(c))
        else:
            out.append(F.col(c))
    return both.select(*out)


def replace_rows(df: DataFrame, updates: DataFrame, keys) -> DataFrame:
    """Upsert that replaces whole rows."""
    return df.join(updates.select(*keys), list(keys), "left_anti").unionByName(updates)


def _publish(spark, path, folder):
    """Add a pointer to ``folder``; the newest pointer counts, so readers always find one."""
    newest = _pointers(spark, path)
    number = newest[0].number + 1 if newest else 1
    spark.createDataFrame([(number, folder)], _POINTER).coalesce(1).write.mode("append").json(f"{path}/_published")


_POINTER = "number bigint, folder string"


def _pointers(spark, path) -> list:
    """The newest pointer, or nothing if none was published yet."""
    place = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_published")
    if not place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place):
        return []
    return spark.read.schema(_POINTER).json(f"{path}/_published").orderBy(F.desc("number"), F.desc("folder")).limit(1).collect()


def published(spark, path) -> str:
    """Folder of the published version."""
    newest = _pointers(spark, path)
    if not newest:
        raise ContractError(f"nothing is published below {path}")
    return f"{path}/{newest[0].folder}"


def promote(df: DataFrame, issues: DataFrame, path, version="v", partition_by=()) -> DataFrame:
    """Publish a table only if its issue table has no hard failure; returns what was written.

    The table goes to a new folder, is compared with its source there, and only then does
    the pointer move: a failure leaves the published version as it was, and the table may
    be read from that version. :func:`published` gives readers the folder.
    """
    require_clean(issues)
    folder = f"{version}-{uuid.uuid4().hex}"
    write(df, f"{path}/{folder}", partition_by)
    written = df.sparkSession.read.parquet(f"{path}/{folder}").select(*df.columns)
    if not same_content(df, written).first().same:
        raise ContractError(f"written table differs from its source: {path}/{folder}")
    _publish(df.sparkSession, path, folder)
    return written


def seed_tables(tables: dict, path, version: str, key="canonical_project_key", parent=None) -> str:
    """Load related tables parent first into a new folder of ``version`` and move the pointer.

    ``tables`` is ordered, the first one is the parent unless named. Every child key must
    exist in the parent and every written table must match its source, else nothing is
    published; loading the same version again gives the same result.
    """
    names = list(tables)
    parent = parent or names[0]
    spark = tables[parent].sparkSession
    folder = f"{version}-{uuid.uuid4().hex}"
    base = f"{path}/{folder}"
    for name in [parent, *[n for n in names if n != parent]]:
        write(tables[name], f"{base}/{name}")
    written = {n: spark.read.parquet(f"{base}/{n}") for n in names}
    for name in names:
        if name != parent and not orphans(written[name], written[parent], key).isEmpty():
            raise ContractError(f"{name} holds keys without a row in {parent}")
        if fingerprint(written[name], tables[name].columns).first() != fingerprint(tables[name]).first():
            raise ContractError(f"{name} differs from its source")
    _publish(spark, path, folder)
    return base


def open_tables(spark, path, names) -> dict:
    """The tables of the published version."""
    base = published(spark, path)
    return {n: spark.read.parquet(f"{base}/{n}") for n in names}
