"""Substring search by an index of three-character grams.

A text holds a query only if it holds all the query's grams, so the keys that the rarest grams have in common
are the only rows to read and compare. Postings are stored where their texts are read, in long runs in order of gram:
a search reads the stretches of its grams, and a gram that most texts hold is spread over all files. Every position
starts a gram, shorter ones at the end of a text, so queries of one or two characters
find the grams that begin with them. A stored gram is one long number, its characters' code
points one after the other, so grams sort as their texts do and a beginning is a range.
"""

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from panelwright.functions.text import contains_any
from panelwright.session import cut_lineage

SIZE = 3
#: Grams of a query whose postings are intersected.
RAREST = 4


def grams(text) -> Column:
    """The distinct grams of a lower-cased text; a null has none."""
    text = F.col(text) if isinstance(text, str) else text
    letters = F.split(F.lower(F.coalesce(text, F.lit(""))), "")
    # The lambdas see single letters only; an array named inside them would be split anew for each.
    joined = lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))
    pairs = F.zip_with(letters, F.slice(letters, 2, F.size(letters)), joined)
    return F.array_distinct(F.filter(F.zip_with(pairs, F.slice(letters, 3, F.size(letters)), joined), lambda g: g != ""))


#: Bits of a code point in a gram's number; a place without a character is 0, so a code point counts from 1.
_BITS = 21
#: Rows of texts handled at a time, postings in one sorted run, and postings in one Arrow batch.
_ROWS, _RUN, _BATCH = 500, 1_000_000, 100_000


def gram_code(gram: str) -> int:
    """The number of a gram of up to three characters."""
    return sum((ord(c) + 1) << _BITS * (SIZE - 1 - i) for i, c in enumerate(gram))


def gram_codes(text: bytes) -> np.ndarray:
    """The numbers of all grams of a text in UTF-8, one per position."""
    points = np.frombuffer(text.decode("utf-8", "replace").encode("utf-32-le", "replace"), "<u4").astype(np.int64) + 1
    points = np.concatenate([points, np.zeros(SIZE - 1, np.int64)])
    n = len(points) - SIZE + 1
    return sum(points[i:i + n] << _BITS * (SIZE - 1 - i) for i in range(SIZE))


def _postings(batches):
    """(gram, key), in runs ordered by gram, of batches whose first column is the key and whose others are lower-cased texts.

    A row's grams come once.
    """
    keys, rows, found, base, held = [], [], [], 0, 0

    def run():
        codes = np.concatenate(found)
        order = np.argsort(codes, kind="stable")
        whole, codes, at = pa.concat_arrays(keys), codes[order], np.concatenate(rows)[order]
        for low in range(0, len(codes), _BATCH):
            yield pa.RecordBatch.from_arrays([pa.array(codes[low:low + _BATCH]), whole.take(pa.array(at[low:low + _BATCH]))], names=["gram", "key"])

    for batch in (whole.slice(at, _ROWS) for whole in batches for at in range(0, whole.num_rows, _ROWS)):
        keys.append(batch.column(0))
        for row, texts in enumerate(zip(*(c.to_pylist() for c in batch.columns[1:]))):
            found.append(np.unique(np.concatenate([gram_codes(t or b"") for t in texts])))
            rows.append(np.full(len(found[-1]), base + row))
            held += len(found[-1])
        base += batch.num_rows
        if held > _RUN:
            yield from run()
            keys, rows, found, base, held = [], [], [], 0, 0
    if held:
        yield from run()


@dataclass
class GramIndex:
    """Postings (gram, key) in sorted runs, and how many keys each gram has; grams as numbers, see :func:`gram_code`."""

    postings: DataFrame
    counts: DataFrame
    columns: list

    def chosen(self, query: str) -> dict | None:
        """The query's rarest grams with their counts; nothing if some gram is unknown."""
        spark = self.counts.sparkSession
        own = spark.range(1).select(F.filter(grams(F.lit(query)), lambda g: F.length(g) == SIZE).alias("g")).first()["g"]
        own = [gram_code(g) for g in own]
        known = {r["gram"]: r["n"] for r in self.counts.filter(F.col("gram").isin(own)).collect()}
        return dict(sorted(known.items(), key=lambda x: (x[1], x[0]))[:RAREST]) if len(known) == len(own) else None

    def candidates(self, query: str) -> DataFrame:
        """Keys of all texts that may hold ``query``; a query is not empty."""
        spark = self.postings.sparkSession
        plain = spark.range(1).select(F.lower(F.lit(query)).alias("q")).first()["q"]
        if len(plain) < SIZE:
            low, width = gram_code(plain), 1 << _BITS * (SIZE - len(plain))
            return self.postings.filter(F.col("gram").between(low, low + width - 1)).select("key").distinct()
        wanted = self.chosen(query)
        if wanted is None:
            return self.postings.filter(F.lit(False)).select("key")
        found = self.postings.filter(F.col("gram").isin(list(wanted)))
        return found.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") == len(wanted)).select("key")

    def search(self, df: DataFrame, key: str, query: str) -> DataFrame:
        """The rows of ``df`` that hold ``query`` in one of the indexed columns, whatever its case."""
        if not query:
            return df.filter(contains_any(self.columns, query))
        near = df.join(self.candidates(query).withColumnRenamed("key", "_key"), F.col(key) == F.col("_key"), "left_semi")
        return near.filter(contains_any(self.columns, query))

    def effort(self, query: str) -> DataFrame:
        """(postings, read, candidates): what a search has, reads and leaves to compare, in rows."""
        wanted = self.chosen(query) or {}
        return self.candidates(query).agg(F.count("*").alias("candidates")).select(
            F.lit(self.counts.agg(F.sum("n")).first()[0] or 0).cast("bigint").alias("postings"),
            F.lit(sum(wanted.values())).cast("bigint").alias("read"), "candidates")


def build_index(df: DataFrame, key: str, columns) -> GramIndex:
    """An index of ``columns``, stored in the shared folder. A null key is not indexed."""
    lowered = [F.lower(F.col(c).cast("string")).cast("binary").alias(f"text{i}") for i, c in enumerate(columns)]
    texts = df.filter(F.col(key).isNotNull()).select(F.col(key).alias("key"), *lowered)
    kinds = StructType([StructField("gram", LongType()), texts.schema["key"]])
    # A row has each gram once, so only the grams of keys with several rows can come again.
    repeated = cut_lineage(texts.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1").select("key"))
    once = texts.join(repeated, "key", "left_anti").mapInArrow(_postings, kinds)
    more = texts.join(repeated, "key", "left_semi").mapInArrow(_postings, kinds).distinct().sortWithinPartitions("gram", "key")
    postings = cut_lineage(once.unionByName(more))
    counts = cut_lineage(postings.groupBy("gram").agg(F.count("*").alias("n")).orderBy("gram"))
    return GramIndex(postings, counts, list(columns))
