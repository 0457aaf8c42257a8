"""Text quality by a sparse ensemble of rules over text statistics.

Boosted shallow trees over statistics of a bounded labelled sample give candidate rules:
every path from a root to a node is a conjunction of comparisons. A lasso logistic fit
keeps few of them with a weight each, and the kept rules are compiled into one Spark
column expression over the statistics, so scoring runs inside the query plan.

Edge cases: a null or empty text has statistics of 0 and gets the score of those; texts of
any length are read whole; conflicting labels of one document count by their smallest;
without labels, or with one class only, the score is the base rate; repeated documents
each get their row. Columns that are not named in ``keep`` are not read.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelwright.llm import textbytes as tb
from panelwright.llm.frames import labelled_sample, per_row, remainder
from panelwright.llm.linear import Sparse, fit_logistic

#: Labelled rows the rules are fitted on at most.
FIT_ROWS = 6000
TREES, DEPTH, LEAST, BINS = 60, 3, 12, 32
THRESHOLD = 0.3
_HASH = tb.Hasher(41)
_CLASSES = {
    "upper": [*range(65, 91)], "lower": [*range(97, 123)], "digits": [*range(48, 58)],
    "stops": [33, 46, 63], "commas": [44, 58, 59], "symbols": [35, 36, 37, 38, 42, 43, 60, 61, 62, 64, 94, 95, 126],
    "bars": [124], "shouts": [33], "newlines": [10], "spaces": [32], "wide": [*range(0xC0, 256)],
}
STATISTICS = ("log_bytes", "log_words", "word_length", *(f"{c}_share" for c in _CLASSES),
              "repeated_share", "distinct_share", "top_run_share", "distinct_line_share", "words_per_line")


def statistics(column):
    """One array per name in ``STATISTICS``."""
    n = len(column)
    out = {name: np.zeros(n) for name in STATISTICS}
    for low, high, data, offsets in tb.each_slice(column):
        size = np.diff(offsets)
        here = slice(low, high)
        per_byte = 1 / np.maximum(size, 1)
        out["log_bytes"][here] = np.log1p(size)
        for name, members in _CLASSES.items():
            table = np.zeros(256, np.uint8)
            table[members] = 1
            sums = np.zeros(len(data) + 1, np.int64)
            np.cumsum(table[data], out=sums[1:])
            out[f"{name}_share"][here] = np.diff(sums[offsets]) * per_byte
        starts, ends, first = tb.words(data, offsets, tb.NOT_SPACE)
        words = np.diff(first)
        per_word = 1 / np.maximum(words, 1)
        out["log_words"][here] = np.log1p(words)
        out["word_length"][here] = np.diff(np.concatenate([[0], np.cumsum(ends - starts)])[first]) * per_word
        own = _HASH.words(tb.LOWER[data], starts, ends)
        row = np.repeat(np.arange(high - low), words)
        same = np.zeros(len(own), np.int64)
        same[1:] = (own[1:] == own[:-1]) & (row[1:] == row[:-1])
        out["repeated_share"][here] = np.diff(np.concatenate([[0], np.cumsum(same)])[first]) * per_word
        keys = np.sort((row.astype(np.uint64) << np.uint64(40)) | (own >> np.uint64(24)))
        fresh = np.concatenate([[True], keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, bool)
        at = np.flatnonzero(fresh)
        of = (keys[at] >> np.uint64(40)).astype(np.int64)
        out["distinct_share"][here] = np.bincount(of, minlength=high - low) * per_word
        most = np.zeros(high - low)
        np.maximum.at(most, of, np.diff(np.append(at, len(keys))))
        out["top_run_share"][here] = most * per_word
        line_starts, line_ends, line_first = tb.words(data, offsets, _NOT_NEWLINE)
        lines = np.diff(line_first)
        own = _HASH.words(data, line_starts, line_ends)
        keys = np.unique((np.repeat(np.arange(high - low), lines).astype(np.uint64) << np.uint64(40)) | (own >> np.uint64(24)))
        out["distinct_line_share"][here] = np.bincount((keys >> np.uint64(40)).astype(np.int64), minlength=high - low) / np.maximum(lines, 1)
        out["words_per_line"][here] = words / np.maximum(lines, 1)
    return [out[name] for name in STATISTICS]


_NOT_NEWLINE = np.ones(256, bool)
_NOT_NEWLINE[[10, 13]] = False


# --- rules ----------------------------------------------------------------------------

def _grow(bins, cuts, gradient, hessian, rows, depth, path, rules, value, rate):
    """Splits ``rows`` by the largest gain and notes the path of every node below the root."""
    if path:
        rules.append(tuple(sorted(path)))
    g, h = gradient[rows], hessian[rows]
    leaf = g.sum() / (h.sum() + 1.0)
    best = (1e-6, None, None)
    if depth and len(rows) >= 2 * LEAST:
        for f in range(bins.shape[1]):
            own = bins[rows, f]
            left_g, left_h = np.cumsum(np.bincount(own, g, BINS))[:-1], np.cumsum(np.bincount(own, h, BINS))[:-1]
            left_n = np.cumsum(np.bincount(own, minlength=BINS))[:-1]
            right_g, right_h = g.sum() - left_g, h.sum() - left_h
            gain = left_g ** 2 / (left_h + 1) + right_g ** 2 / (right_h + 1) - g.sum() ** 2 / (h.sum() + 1)
            gain[(left_n < LEAST) | (len(rows) - left_n < LEAST)] = 0
            i = int(np.argmax(gain))
            if gain[i] > best[0]:
                best = (gain[i], f, i)
    if best[1] is None:
        value[rows] += rate * leaf
        return
    _, f, i = best
    low = bins[rows, f] <= i
    _grow(bins, cuts, gradient, hessian, rows[low], depth - 1, path + [(f, "<=", cuts[f][i])], rules, value, rate)
    _grow(bins, cuts, gradient, hessian, rows[~low], depth - 1, path + [(f, ">", cuts[f][i])], rules, value, rate)


def candidate_rules(x, y):
    """Distinct conjunctions ``((feature, comparison, limit), ...)`` from boosted trees."""
    rng = np.random.default_rng(4)
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(x.shape[1])]
    bins = np.stack([np.searchsorted(cuts[f], x[:, f], "left") for f in range(x.shape[1])], axis=1)
    rate = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    value = np.full(len(y), np.log(rate / (1 - rate)))
    rules = []
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-value))
        rows = np.flatnonzero(rng.random(len(y)) < 0.7)
        step = np.zeros(len(y))
        own = []
        _grow(bins, [list(c) + [np.inf] * (BINS - len(c)) for c in cuts], y - p, p * (1 - p), rows, DEPTH, [], own, step, 0.2)
        value += step
        rules += own
    return list(dict.fromkeys(r for r in rules if all(np.isfinite(c) for _, _, c in r)))


def holds(rule, x):
    out = np.ones(len(x), bool)
    for f, comparison, limit in rule:
        out &= (x[:, f] <= limit) if comparison == "<=" else (x[:, f] > limit)
    return out


class RuleModel:
    """Kept rules with weights, and an intercept."""

    def __init__(self, rules, weights, intercept):
        self.rules, self.weights, self.intercept = rules, weights, intercept

    def column(self) -> Column:
        """Probability of the label 1 as an expression over the columns ``STATISTICS``."""
        total = F.lit(float(self.intercept))
        for rule, weight in zip(self.rules, self.weights):
            condition = F.lit(True)
            for f, comparison, limit in rule:
                name = F.col(STATISTICS[f])
                condition = condition & ((name <= float(limit)) if comparison == "<=" else (name > float(limit)))
            total = total + F.when(condition, float(weight)).otherwise(0.0)
        return 1 / (1 + F.exp(-total))


def fit_rules(x, y, l1=6e-3) -> RuleModel:
    y = np.asarray(y, float)
    rate = float(np.clip(y.mean(), 1e-3, 1 - 1e-3)) if len(y) else 0.5
    if not len(y) or y.min() == y.max():
        return RuleModel([], [], float(np.log(rate / (1 - rate))))
    rules = candidate_rules(x, y)
    matrix = np.stack([holds(r, x) for r in rules], axis=1).astype(float) if rules else np.zeros((len(y), 0))
    support = matrix.mean(axis=0)
    scale = np.sqrt(np.maximum(support * (1 - support), 1e-4))     # the penalty treats rare and common rules alike
    _, v, b = fit_logistic(Sparse(np.zeros(0), np.zeros(len(y) + 1), 1), y, l2=0.0, l1=l1, steps=400, dense=matrix / scale)
    kept = np.flatnonzero(v)
    return RuleModel([rules[i] for i in kept], (v / scale)[kept], b)


def train(docs: DataFrame, labels: DataFrame, bound=FIT_ROWS) -> RuleModel:
    """Fitted on at most ``bound`` labelled documents."""
    known = labels.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    chosen = labelled_sample(known, "doc_id", bound)    # at most ``bound`` rows, so small enough to broadcast
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    found = sorted(with_statistics(rows, keep=("doc_id", "quality")).collect())
    x = np.array([r[2:] for r in found], float).reshape(len(found), len(STATISTICS))
    return fit_rules(x, [r["quality"] for r in found])


def with_statistics(docs: DataFrame, keep=("doc_id",)) -> DataFrame:
    return per_row(docs, lambda column: [pa.array(x) for x in statistics(column)],
                   ", ".join(f"{name} double" for name in STATISTICS), keep=keep)


def score(docs: DataFrame, model: RuleModel, keep=("doc_id",), threshold=THRESHOLD) -> DataFrame:
    """``keep`` with ``score`` and ``predicted``."""
    keep = list(keep)
    columns = [f"_k{i}" for i in range(len(keep))]
    named = docs.select(*[F.col(k).alias(c) for k, c in zip(keep, columns)], "text")
    scored = with_statistics(named, columns).withColumn("score", model.column())
    return scored.select(*[F.col(c).alias(k) for c, k in zip(columns, keep)], "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def held_out():
    return remainder("doc_id", 5) == 0


def quality_digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document as the query returns it."""
    model = train(docs, labels.filter(~held_out()))
    return score(docs, model).select("doc_id", held_out().alias("held_out"), "score", "predicted")
