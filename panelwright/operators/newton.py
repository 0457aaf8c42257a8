"""Logistic regression by Newton steps over sums that every task adds up on its own.

A step needs the gradient and the curvature matrix: one number for each pair of features, whatever
the number of rows. Tasks sum them over their rows, Spark adds the tasks' sums, and the driver solves
the small system. Few steps reach the optimum to the last digits, so two engines agree on it.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwright.errors import ContractError

#: Features of a fit, so that the sums of a task and the system on the driver stay small.
MOST_FEATURES = 256


def _sums(rows: DataFrame, weights: np.ndarray) -> np.ndarray:
    """Loss, gradient and upper triangle of the curvature at ``weights``, over all rows."""
    size = len(weights)
    upper = np.triu_indices(size)

    def run(batches):
        total = np.zeros(1 + size + len(upper[0]))
        for batch in batches:
            if not batch.num_rows:
                continue
            x = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, size)
            y, w = (batch.column(i).to_numpy(zero_copy_only=False) for i in (1, 2))
            z = x @ weights
            p = 1 / (1 + np.exp(-np.clip(z, -700, 700)))
            total[0] += w @ (np.logaddexp(0, z) - y * z)
            total[1:size + 1] += x.T @ (w * (y - p))
            total[size + 1:] += (x.T @ (x * (w * p * (1 - p))[:, None]))[upper]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), pa.array(total)], names=["i", "v"])

    out = np.zeros(1 + size + len(upper[0]))
    for r in rows.select("x", "y", "w").mapInArrow(run, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).collect():
        out[r["i"]] = r["v"]
    return out


def newton_logistic(rows: DataFrame, ridge, steps=25, tolerance=1e-11) -> np.ndarray:
    """Weights that minimise the weighted log-loss plus ``ridge`` halves of squared weights.

    ``rows``: a stored table of ``x`` (array of doubles, as long as ``ridge``), ``y`` (0 or 1) and ``w``,
    without nulls. A step that would raise the loss is halved until it does not. The system is
    scaled by its diagonal, so features of very different sizes do no harm.
    """
    ridge = np.asarray(ridge, float)
    size = len(ridge)
    if size > MOST_FEATURES:
        raise ContractError(f"a Newton fit takes at most {MOST_FEATURES} features, not {size}")
    upper = np.triu_indices(size)
    weights, step, last = np.zeros(size), np.zeros(size), np.inf
    for _ in range(steps):
        found = _sums(rows, weights)
        loss = found[0] + 0.5 * ridge @ weights ** 2
        if loss > last + 1e-9 * abs(last):
            step = step / 2
            weights = weights - step
            continue
        curve = np.zeros((size, size))
        curve[upper] = found[size + 1:]
        curve = curve + np.triu(curve, 1).T + np.diag(ridge)
        gradient = found[1:size + 1] - ridge * weights
        # A feature that no row has, without ridge, keeps its weight.
        scale = np.sqrt(np.where(np.diag(curve) > 0, np.diag(curve), 1.0))
        scaled = curve / scale[:, None] / scale[None, :]
        step = np.linalg.lstsq(scaled, gradient / scale, rcond=1e-14)[0] / scale
        weights, last = weights + step, loss
        if np.abs(step * scale).max() <= tolerance * max(1.0, np.abs(weights * scale).max()):
            break
    return weights
