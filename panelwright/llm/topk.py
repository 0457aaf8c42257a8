"""Exact top-k inner products by an impact-ordered, score-at-a-time index.

Vectors become integers. Each task indexes its vectors block by block: per dimension,
posting segments of the rows that share one quantised value. For a query, a segment's
impact is its value times the query's component, less the smallest such product of its
dimension, so impacts are not negative. Segments are processed by descending impact. Every
vector has one posting per dimension, so after any segment an unfinished vector can gain at
most its open dimensions times the next impact. Work stops only when this bound leaves few
vectors that could be among the best; those are scored exactly.

Queries go to the tasks in blocks of about ``QUERY_BLOCK``; every task returns its own best
``k`` of each query, which are merged by one shuffle on the query.

Edge cases: vectors that are null, empty, or hold a null or non-finite component take no
part; only vectors as long as the query are its candidates; a query finds all of them if
there are fewer than ``k``; ties go to the smaller id; rows with the query's own id are
left out; an empty table has no rows. Scores are exact while they stay below 2**53.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

K = 20
EVERY = 20
QUERY_BLOCK = 8192
INDEX_BLOCK = 8192
#: Shares of a block's postings after which the bound is tested.
_TESTS = (0.7, 0.9, 1.0)
#: Added to every impact, so that one sum also counts the dimensions seen.
_COUNT = float(1 << 36)


def quantised(ids, column):
    """``(ids, integer matrix)`` per vector length, of the vectors that take part."""
    lists = column.cast(pa.list_(pa.float64()))
    offsets, flat = np.asarray(lists.offsets), lists.values
    good = np.asarray(flat.is_valid()) if flat.null_count else np.ones(len(flat), bool)
    values = np.floor(64 * np.asarray(flat.fill_null(0.0) if flat.null_count else flat))
    good &= np.isfinite(values)
    length = np.diff(offsets)
    bad = np.concatenate([[0], np.cumsum(~good)])
    usable = np.asarray(lists.is_valid()) & (length > 0) & (bad[offsets[1:]] == bad[offsets[:-1]]) & np.asarray(ids.is_valid())
    keys = np.asarray(ids.fill_null(0))
    for n in np.unique(length[usable]):
        rows = np.flatnonzero(usable & (length == n))
        yield keys[rows], values[offsets[rows][:, None] + np.arange(n)]


class ImpactIndex:
    """Posting segments of one block of integer vectors."""

    def __init__(self, ids, x):
        by = np.argsort(ids, kind="stable")
        self.ids, self.x = ids[by], x[by]
        n, dims = self.x.shape
        order = np.argsort(self.x, axis=0, kind="stable")
        value = np.take_along_axis(self.x, order, axis=0).T.ravel()
        self.postings = order.T.ravel().astype(np.int32)
        head = np.ones(n * dims, bool)
        head[1:] = value[1:] != value[:-1]
        head[::n] = True
        self.start = np.flatnonzero(head)
        self.size = np.diff(np.append(self.start, n * dims))
        self.dim, self.value = self.start // n, value[self.start]
        self.first = np.searchsorted(self.dim, np.arange(dims))

    def best(self, q, k, known, own):
        """Ids and scores of vectors that can be among the ``k`` best, at least ``known``."""
        n, dims = self.x.shape
        product = q[self.dim] * self.value
        least = np.minimum.reduceat(product, self.first)
        impact = product - least[self.dim]
        base = least.sum()
        order = np.argsort(-impact, kind="stable")
        reach = np.cumsum(self.size[order])
        both, done = np.zeros(n), 0
        small = least.shape[0] < 1 << 16 and impact.sum() < _COUNT
        total, seen = np.zeros(n), np.zeros(n)
        member = np.arange(n)
        for share in _TESTS:
            upto = int(np.searchsorted(reach, share * n * dims)) + 1
            part = order[done:upto]
            size = self.size[part]
            begin = np.cumsum(size) - size
            at = self.postings[np.arange(size.sum()) + np.repeat(self.start[part] - begin, size)]
            if small:
                both += np.bincount(at, np.repeat(impact[part] + _COUNT, size), n)
                seen, total = np.divmod(both, _COUNT)
            else:
                total, seen = total + np.bincount(at, np.repeat(impact[part], size), n), seen + np.bincount(at, minlength=n)
            done = min(upto, len(order))
            rest = impact[order[done]] if done < len(order) else 0.0
            floor = known
            if n > k:                                  # one more than k, as the query's own row may be here
                floor = max(floor, np.partition(total, n - k - 1)[n - k - 1] + base)
            member = np.flatnonzero(total + (dims - seen) * rest + base >= floor)
            if len(member) <= 8 * k:
                break
        member = member[self.ids[member] != own]
        return self.ids[member], self.x[member] @ q


def _merge(best, i, ids, scores, k):
    if i in best:
        ids, scores = np.concatenate([best[i][0], ids]), np.concatenate([best[i][1], scores])
    by = np.lexsort((ids, -scores))[:k]
    best[i] = ids[by], scores[by]


def top_k(vectors: DataFrame, queries: DataFrame, k=K, key="vec_id", vector="embedding",
          query_block=QUERY_BLOCK, index_block=INDEX_BLOCK) -> DataFrame:
    """``query_id``, ``rank``, ``vec_id`` and ``score`` of every query's ``k`` best vectors.

    Equal rows of ``queries`` ask once; rows of one id with different vectors ask on their own. Every row of
    ``vectors`` with another id is a candidate, repeated ones as well.
    """
    spark = vectors.sparkSession
    asked = queries.select(F.col(key).cast("bigint").alias("id"), F.col(vector).cast("array<double>").alias("v")).filter("id is not null and v is not null").distinct()
    stored = vectors.select(F.col(key).cast("bigint").alias("id"), F.col(vector).cast("array<double>").alias("v"))
    blocks = -(-asked.count() // query_block)
    found = None
    for b in range(blocks):
        rows = asked.filter(F.pmod(F.xxhash64("id"), F.lit(blocks)) == b).toArrow() if blocks > 1 else asked.toArrow()
        ids, lists = rows["id"].combine_chunks(), rows["v"].combine_chunks()
        shared = spark.sparkContext.broadcast(list(quantised(ids, lists)))

        def run(batches, shared=shared):
            best: dict = {}
            for batch in batches:
                for at in range(0, batch.num_rows, index_block):
                    part = batch.slice(at, index_block)
                    for own, x in quantised(part.column(0), part.column(1)):
                        index = ImpactIndex(own, x)
                        for group, (asked_ids, q) in enumerate(shared.value):
                            if q.shape[1] != x.shape[1]:
                                continue
                            for number, (i, row) in enumerate(zip(asked_ids.tolist(), q)):
                                one = i, group, number
                                known = best[one][1][-1] if one in best and len(best[one][1]) == k else -np.inf
                                _merge(best, one, *index.best(row, k, known, i), k)
            for at in range(0, len(best), 1000):
                names = list(best)[at:at + 1000]
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.repeat(np.array([i for i, _, _ in names], np.int64), [len(best[i][0]) for i in names])),
                    pa.array(np.repeat(np.array([(g << 32) + n for _, g, n in names], np.int64), [len(best[i][0]) for i in names])),
                    pa.array(np.concatenate([best[i][0] for i in names]).astype(np.int64)),
                    pa.array(np.concatenate([best[i][1] for i in names]).astype(np.int64))], names=["query_id", "row", "vec_id", "score"])

        one = stored.mapInArrow(run, "query_id bigint, row bigint, vec_id bigint, score bigint")
        found = one if found is None else found.unionByName(one)
    if found is None:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score bigint")
    order = Window.partitionBy("query_id", "row").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def top_k_digest(vectors: DataFrame) -> DataFrame:
    """The best of every vector whose id is divisible by ``EVERY``."""
    return top_k(vectors, vectors.filter(F.col("vec_id") % EVERY == 0))


SQL = """WITH v AS (
  SELECT vec_id, [CAST(floor(64 * CAST(x AS DOUBLE)) AS DOUBLE) FOR x IN embedding] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0
    AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 20 = 0),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20"""
