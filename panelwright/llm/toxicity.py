"""Toxicity by a chain of linear models over categories.

Categories are predicted one after another; the probability of every earlier category is a
feature of the later models. In training, those probabilities are out-of-fold predictions,
so a later model sees them as good as they will be on new texts. Features are whole words
and word beginnings that tell the categories apart in a bounded sample of labelled rows.

Edge cases: a null or empty text has no features and gets the base rates; texts are read
whole whatever their length; a document labelled more than once counts as toxic if one
label says so; without labels, or with one class only, probabilities are the base rates;
repeated documents each get their row. Columns that are not named in ``keep`` are not read.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwright.llm import textbytes as tb
from panelwright.llm.frames import labelled_sample, per_row
from panelwright.llm.linear import Sparse, fit_logistic, sigmoid

#: Labelled rows the chain is fitted on at most.
FIT_ROWS = 6000
FEATURES = 1000
FOLDS = 5
#: A chosen feature is in this share of the rows, and this share of its rows is in a category.
LEAST_ROWS, LEAST_PRECISION = 0.001, 0.7
PREFIXES = (4, 5, 6)
#: Words whose presence in a toxic document marks its category.
TERMS = {
    "insult": ("idiot", "moron", "loser", "clown", "scum"),
    "contempt": ("trash", "disgusting", "worthless", "pathetic", "stupid"),
}
CATEGORIES = (*TERMS, "toxic")
KEPT = 1 << 20
_HASH = tb.Hasher(101)


def word_features(data, starts, ends):
    """Hashes of the whole word and of its beginnings, one column each; 0 where it is too short."""
    sums, length = _HASH.sums(data), ends - starts
    columns = [_HASH.ranges(sums, starts, ends)]
    for n in PREFIXES:
        own = np.zeros(len(starts), np.uint64)
        fits = np.flatnonzero(length > n)
        own[fits] = _HASH.ranges(sums, starts[fits], starts[fits] + n) ^ np.uint64(n)
        columns.append(own)
    return np.stack(columns, axis=1)


class Chain:
    """``features``: sorted hashes; per category weights on them, on earlier categories, and an intercept."""

    def __init__(self, features, models, threshold=0.5):
        self.features, self.models, self.threshold, self.kept = features, models, threshold, None

    def presence(self, column):
        """Distinct chosen features of each row as a sparse matrix."""
        rows, numbers = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        if self.kept is None:
            self.kept = np.zeros(KEPT, np.uint64)      # words known to have no feature
        width = len(self.features)
        for low, _, data, offsets in tb.each_slice(column):
            data = tb.LOWER[data]
            starts, ends, first = tb.words(data, offsets, tb.ALNUM)
            if not len(starts) or not width:
                continue
            own = _HASH.words(data, starts, ends)
            slot = (own >> np.uint64(44)).astype(np.int64)
            new = np.flatnonzero(self.kept[slot] != own)
            hashes = word_features(data, starts[new], ends[new])
            at = np.minimum(np.searchsorted(self.features, hashes), width - 1)
            found = self.features[at] == hashes
            none = new[~found.any(axis=1)]
            self.kept[slot[none]] = own[none]
            word, which = np.nonzero(found)
            row = np.searchsorted(first, new[word], "right") - 1
            pairs = np.unique((row + low) * width + at[word, which])
            rows.append(pairs // width)
            numbers.append(pairs % width)
        rows, numbers = np.concatenate(rows), np.concatenate(numbers)
        return Sparse(numbers, np.concatenate([[0], np.cumsum(np.bincount(rows, minlength=len(column)))]), max(1, width))

    def predict(self, column):
        """One column of probabilities per category."""
        x = self.presence(column)
        out = np.zeros((len(column), len(self.models)))
        for c, (w, v, b) in enumerate(self.models):
            out[:, c] = sigmoid(x.times(w) + out[:, :c] @ v + b)
        return out


def one_of_each(texts):
    """Places of texts without further near copies, by the smallest hash of three words."""
    key = np.zeros(len(texts), np.uint64)
    for low, _, data, offsets in tb.each_slice(pa.array(texts, pa.string())):
        data = tb.LOWER[data]
        starts, ends, first = tb.words(data, offsets, tb.ALNUM)
        hashes, begin = tb.shingles(_HASH.words(data, starts, ends), first, 3)
        filled = np.flatnonzero(np.diff(begin))
        if len(filled):
            key[low + filled] = np.minimum.reduceat(hashes, begin[filled])
    return np.sort(np.unique(key, return_index=True)[1])


def chosen_features(texts, y, most=FEATURES):
    """The features whose presence tells any category apart best, by a likelihood ratio.

    A feature must be common enough and mostly in texts of the category.
    """
    hashes, rows = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for low, _, data, offsets in tb.each_slice(pa.array(texts, pa.string())):
        data = tb.LOWER[data]
        starts, ends, first = tb.words(data, offsets, tb.ALNUM)
        if not len(starts):
            continue
        own = word_features(data, starts, ends)
        row = np.repeat(np.searchsorted(first, np.arange(len(starts)), "right") - 1, own.shape[1])
        by = np.lexsort((own.ravel(), row))
        h, r = own.ravel()[by], row[by]
        fresh = np.concatenate([[True], (h[1:] != h[:-1]) | (r[1:] != r[:-1])]) & (h != 0)
        hashes.append(h[fresh])
        rows.append(r[fresh] + low)
    hashes, rows = np.concatenate(hashes), np.concatenate(rows)
    names, number, count = np.unique(hashes, return_inverse=True, return_counts=True)
    best, n = np.zeros(len(names)), len(y)
    for c in range(y.shape[1]):
        m = y[:, c].sum()
        if not 0 < m < n:
            continue
        inside = np.bincount(number, y[rows, c], len(names))
        outside, expected = count - inside, count * m / n
        with np.errstate(divide="ignore", invalid="ignore"):
            ratio = 2 * (np.where(inside > 0, inside * np.log(inside / expected), 0)
                         + np.where(outside > 0, outside * np.log(outside / (count - expected)), 0))
        good = (inside >= LEAST_PRECISION * count) & (count >= max(3, LEAST_ROWS * n))
        best = np.maximum(best, np.where(good, ratio, 0))
    strong = np.flatnonzero(best)
    return np.sort(names[strong[np.argsort(-best[strong], kind="stable")[:most]]])


def with_single_features(x: Sparse, y, dense):
    """The rows, and for each of a row's features a copy that has it alone.

    A text may hold one telling word only, so each has to carry the decision by itself.
    """
    alone = np.arange(len(x.columns))
    begin = np.concatenate([x.begin, x.begin[-1] + 1 + alone])
    both = Sparse(np.concatenate([x.columns, x.columns]), begin, x.width)
    return both, np.concatenate([y, y[x.row]]), np.concatenate([dense, dense[x.row]])


def fit_chain(texts, y, folds=FOLDS, l1=1e-5, steps=400) -> Chain:
    """``y``: one 0/1 column per category, in the order of the chain."""
    y = np.asarray(y, float)
    y = y[:, None] if y.ndim == 1 else y
    if not len(texts):
        return Chain(np.zeros(0, np.uint64), [(np.zeros(1), np.zeros(c), -3.0) for c in range(y.shape[1])])
    kept = one_of_each(texts)
    texts, y = [texts[i] for i in kept], y[kept]
    chain = Chain(chosen_features(texts, y), [])
    x = chain.presence(pa.array(texts, pa.string()))
    fold = np.arange(len(texts)) % folds
    folds_of = np.concatenate([fold, fold[x.row]])
    earlier = np.zeros((len(texts), 0))
    for c in range(y.shape[1]):
        rate = np.clip(y[:, c].mean(), 1e-3, 1 - 1e-3)
        if y[:, c].min() == y[:, c].max():
            model = np.zeros(x.width), np.zeros(c), float(np.log(rate / (1 - rate)))
            out = np.full(len(texts), rate)
        else:
            rows, truth, dense = with_single_features(x, y[:, c], earlier)
            out = np.zeros(len(texts))
            for f in range(folds):
                w, v, b = fit_logistic(rows, truth, l2=0.0, l1=l1, steps=steps, dense=dense, weight=(folds_of != f).astype(float))
                test = fold == f
                out[test] = sigmoid(x.times(w) + earlier @ v + b)[test]
            model = fit_logistic(rows, truth, l2=0.0, l1=l1, steps=steps, dense=dense)
        chain.models.append(model)
        earlier = np.column_stack([earlier, out])
    return chain


def train(docs: DataFrame, labels: DataFrame, bound=FIT_ROWS) -> Chain:
    """Fitted on at most ``bound`` labelled documents; categories before the last are weak labels."""
    known = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = labelled_sample(known, "doc_id", bound)    # at most ``bound`` rows, so small enough to broadcast
    lower = F.lower(F.col("text"))
    has = lambda words: lower.rlike(r"(?<![a-z0-9])(" + "|".join(words) + r")(?![a-z0-9])")
    rows = docs.filter(F.col("text").isNotNull()).select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select(
        "doc_id", "text", *[((F.col("toxic") > 0) & has(words)).cast("int").alias(name) for name, words in TERMS.items()],
        (F.col("toxic") > 0).cast("int").alias("toxic"))
    got = sorted(rows.collect(), key=lambda r: (r["doc_id"], r["text"]))
    y = np.array([[r[c] for c in CATEGORIES] for r in got], float).reshape(len(got), len(CATEGORIES))
    return fit_chain([r["text"] for r in got], y)


def score(docs: DataFrame, chain: Chain, keep=("doc_id",)) -> DataFrame:
    """``keep`` with one probability per category and ``is_toxic`` by the last one."""
    shared = docs.sparkSession.sparkContext.broadcast(chain)

    def function(column):
        return [pa.array(x) for x in shared.value.predict(column).T]

    found = per_row(docs, function, ", ".join(f"p_{c} double" for c in CATEGORIES), keep=keep)
    return found.withColumn("is_toxic", F.col(f"p_{CATEGORIES[-1]}") >= chain.threshold)


def toxicity_digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return score(docs, train(docs, labels))
