"""Small pieces shared by the operators of this subpackage."""

import contextlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwright.session import cut_lineage, discard


#: Rows handled and returned at a time.
ROWS = 2000
#: Spark's setting for the rows of an Arrow batch that a task hands to its Python worker.
BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def limit_batches(spark, rows=ROWS) -> str:
    """From now on tasks hand at most ``rows`` rows at a time to Python; returns the setting before.

    A task holds a batch twice outside the heap (columns and the bytes to send, either doubled as it
    grows), so 10,000 texts, Spark's default, cost some 100 MB of an executor. A smaller limit is kept.
    """
    before = spark.conf.get(BATCH_ROWS)
    spark.conf.set(BATCH_ROWS, str(min(int(before), rows) if int(before) > 0 else rows))
    return before


@contextlib.contextmanager
def small_batches(spark, rows=ROWS):
    """:func:`limit_batches` for the jobs that run inside; lazy results keep nothing of it."""
    before = limit_batches(spark, rows)
    try:
        yield
    finally:
        spark.conf.set(BATCH_ROWS, before)


def remainder(key, modulus):
    """crc32 of the key's decimal text modulo ``modulus``; a null key counts as the empty text."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % modulus


def per_row(docs: DataFrame, function, schema: str, text="text", keep=("doc_id",)) -> DataFrame:
    """``keep`` columns beside what ``function`` makes of the Arrow text column, batch by batch.

    ``function`` returns one list of arrays, in the order of ``schema``. Columns that are
    not named are not read, so their names cannot clash with the new ones.
    """
    keep = list(keep)
    at = keep.index(text) if text in keep else len(keep)
    chosen = docs.select(*keep) if text in keep else docs.select(*keep, F.col(text).alias("_text"))
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in chosen.schema[:len(keep)])

    def run(batches):
        for batch in (whole.slice(low, ROWS) for whole in batches for low in range(0, max(1, whole.num_rows), ROWS)):
            made = function(batch.column(at))
            yield pa.RecordBatch.from_arrays(
                [batch.column(i) for i in range(len(keep))] + [pa.array(x) if not isinstance(x, pa.Array) else x for x in made],
                names=keep + names)

    names = [part.strip().split(" ", 1)[0] for part in _fields(schema)]
    return chosen.mapInArrow(run, f"{kept}, {schema}" if kept else schema)


def _fields(schema):
    depth, part, parts = 0, "", []
    for c in schema:
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            parts.append(part)
            part = ""
        else:
            part += c
    return [*parts, part]


def labelled_sample(rows: DataFrame, key: str, bound: int) -> DataFrame:
    """At most about ``bound`` rows, the smallest by a hash of ``key``, the same in every run.

    Only hashes are sorted, as a top-k; the rows are then read by the hash limit.
    """
    order = F.xxhash64(F.col(key))
    last = rows.select(order.alias("h")).orderBy("h").limit(bound).agg(F.max("h")).first()[0]
    return rows.filter(order <= F.lit(last)) if last is not None else rows.limit(0)


__all__ = ["cut_lineage", "discard", "labelled_sample", "limit_batches", "per_row", "remainder", "small_batches"]
