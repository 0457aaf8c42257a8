"""Isotonic regression by pooling adjacent violators, range by range.

Pooling may be done in any order, so every task pools its own range of values first, and the blocks
of neighbouring ranges are pooled again in fewer and larger ranges, up to one. What is
passed on are blocks, not values: with outcomes of 0 and 1, n rows leave at most about n ** (2/3) blocks
of different means.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Ranges that become one range in the next round.
FAN = 8
_SCHEMA = "lo double, hi double, s double, w double"


def _pool(blocks: DataFrame, ranges: int) -> DataFrame:
    """Blocks (lowest and highest value, sum of outcomes, weight), pooled within each of ``ranges`` ranges."""

    def run(batches):
        stack, schema = [], None
        for batch in batches:
            schema = batch.schema
            for lo, hi, s, w in zip(*(column.to_pylist() for column in batch.columns)):
                # A block joins the one before it while that one's mean is not lower.
                while stack and stack[-1][2] * w >= s * stack[-1][3]:
                    before = stack.pop()
                    lo, s, w = before[0], before[2] + s, before[3] + w
                stack.append((lo, hi, s, w))
        for at in range(0, len(stack), 10_000):
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.float64()) for c in zip(*stack[at:at + 10_000])], schema=schema)

    return blocks.repartitionByRange(ranges, "lo").sortWithinPartitions("lo").mapInArrow(run, _SCHEMA)


def isotonic_blocks(points: DataFrame) -> DataFrame:
    """The blocks of (p, s, w): values with the sum of their outcomes and their weight, one row a value.

    Block means ``s / w`` rise strictly with the values.
    """
    ranges = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocks = _pool(points.select(*[F.col(c).cast("double").alias(a) for c, a in (("p", "lo"), ("p", "hi"), ("s", "s"), ("w", "w"))]), ranges)
    while ranges > 1:
        ranges = max(1, ranges // FAN)
        blocks = _pool(blocks, ranges)
    return blocks


def knots(blocks: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Both ends of all blocks and their means, as a piecewise linear map."""
    rows = sorted(tuple(r) for r in blocks.collect())
    xs = np.array([x for lo, hi, _, _ in rows for x in (lo, hi)], float)
    return xs, np.array([s / w for _, _, s, w in rows for _ in (0, 1)], float)
