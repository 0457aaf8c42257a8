"""Masked pseudo-likelihood of texts by a small bidirectional window network.

A word is predicted from the words on both sides of it; the summed conditional
log-probabilities score a document. The network's vocabulary are the most frequent words
of the whole corpus, and classes of the others by their endings. Within its class every
other word has its own probability, its share of the class' counted words, so what is
counted grows with the corpus: tasks keep a bounded number of frequent words, the rest are
joined with the table of counts. The network adds an embedding
per context position, applies tanh, and has a two-level softmax (group, then member), so
no step costs as much as the vocabulary is large. It is trained in numpy where the
documents are: every task starts from the same weights, runs through all its documents,
and the tasks' weights are averaged by the number of words they have seen. Each word of
every document is a training target in one of the rounds.

Edge cases: a null, empty or wordless text has no words, log-probability 0 and a null
mean; a word that was never counted has what a word counted once has; texts of any length are read whole; an empty corpus gives an untrained network;
repeated documents each count and each get their row. Columns not in ``keep`` are not read.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwright.llm import textbytes as tb
from panelwright.llm.frames import cut_lineage, per_row

GROUPS = MEMBERS = 32
VOCABULARY = GROUPS * MEMBERS
#: Most frequent words with a number of their own; the rest of the vocabulary are ending classes.
FREQUENT = 768
CLASSES = VOCABULARY - FREQUENT
#: Counts of about so many further words are kept by the tasks; those of all others are joined.
KEPT = 1 << 18
#: Buckets of counts per power of two.
_BUCKETS = 8
REACH, SIZE = 2, 16
OFFSETS = tuple(o for o in range(-REACH, REACH + 1) if o)
#: Rounds of training; each predicts another share of every document's words, together all of them.
ROUNDS, RATE, BATCH = 2, 1.2, 1024
_HASH, _END = tb.Hasher(61), tb.Hasher(62)
_PART = 2048


def word_hashes(data, offsets):
    data = tb.LOWER[data]
    starts, ends, first = tb.words(data, offsets, tb.ALNUM)
    sums = _HASH.sums(data)
    return (_HASH.ranges(sums, starts, ends).view(np.int64),
            _END.ranges(_END.sums(data), np.maximum(starts, ends - 3), ends), first)


def classes(endings):
    """Number of the class of words with these hashes of their endings."""
    return (endings % np.uint64(CLASSES)).astype(np.int64)


def word_counts(docs: DataFrame) -> DataFrame:
    """``word`` (its hash), ``n`` over all documents and ``class``, counted per task and then by one shuffle."""
    def run(batches):
        for batch in batches:
            parts = [word_hashes(data, offsets)[:2] for _, _, data, offsets in tb.each_slice(batch.column(0))]
            words, endings = (np.concatenate(x) for x in zip(*parts)) if parts else (np.zeros(0, np.int64), np.zeros(0, np.uint64))
            words, at, n = np.unique(words, return_index=True, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(words), pa.array(n.astype(np.int64)), pa.array(classes(endings[at]).astype(np.int32))],
                                             names=["word", "n", "class"])

    return docs.select("text").mapInArrow(run, "word bigint, n bigint, class int").groupBy("word").agg(
        F.sum("n").alias("n"), F.min("class").alias("class"))


class Vocabulary:
    """Counted words: ``own`` are the sorted hashes of those with numbers of their own.

    ``kept`` are sorted hashes of further frequent words with the logarithms ``logs`` of
    their counts, ``totals`` the counted words of each class, and ``rest`` the table of the
    words that are neither and were counted more than once; it stays on the driver.
    """

    def __init__(self, own, kept=(), logs=(), totals=None, rest=None):
        self.own, self.rest = own, rest
        self.kept, self.logs = np.array(kept, np.int64), np.array(logs, np.float64)
        self.log_totals = np.log1p(np.zeros(CLASSES) if totals is None else totals)

    def __getstate__(self):
        return self.__dict__ | {"rest": None}

    def __len__(self):
        return len(self.own)

    def within(self, words, tokens):
        """Logarithm of each word's share of its class, and the places of words whose count is still to be joined.

        At those it is the share of a word counted once. Each class leaves one count to uncounted words.
        """
        out = np.zeros(len(tokens))
        other = np.flatnonzero(tokens >= FREQUENT)
        out[other] = -self.log_totals[tokens[other] - FREQUENT]
        if len(self.kept):
            at = np.minimum(np.searchsorted(self.kept, words[other]), len(self.kept) - 1)
            found = self.kept[at] == words[other]
            out[other[found]] += self.logs[at[found]]
            other = other[~found]
        return out, other


def vocabulary(docs: DataFrame, most=KEPT):
    """The counted words of ``docs`` and the numbers of the most frequent ones."""
    counts = cut_lineage(word_counts(docs))
    top = counts.orderBy(F.desc("n"), "word").limit(FREQUENT).collect()
    words = np.array([r["word"] for r in top], np.int64)
    by = np.argsort(words)
    last = (top[-1]["n"], top[-1]["word"]) if top else (0, 0)
    others = counts.filter((F.col("n") < last[0]) | ((F.col("n") == last[0]) & (F.col("word") > last[1])))
    totals = np.zeros(CLASSES)
    for r in others.groupBy("class").agg(F.sum("n").alias("n")).collect():
        totals[r["class"]] = r["n"]
    bucket = F.floor(F.log2("n") * _BUCKETS)
    least, size = None, 0
    for b, n in sorted(((r["b"], r["count"]) for r in others.groupBy(bucket.alias("b")).count().collect()), reverse=True):
        if size + n > most:
            break
        least, size = b, size + n
    keeps = F.lit(False) if least is None else bucket >= least
    kept = others.filter(keeps).select("word", "n").toArrow()
    kept, n = kept.column("word").to_numpy(), kept.column("n").to_numpy()
    order = np.argsort(kept)
    rest = others.filter(~keeps & (F.col("n") > 1)).select("word", "n")
    return Vocabulary(words[by], kept[order], np.log(n[order]), totals, rest), by


class Network:
    """Weights by name; ``frequent`` is the vocabulary, ``numbers`` those of its own words.

    ``seen`` counts the words that were predicted in training.
    """

    SHAPES = {"context": (len(OFFSETS), VOCABULARY + 1, SIZE), "hidden": (SIZE,), "group": (SIZE + 1, GROUPS),
              "member": (GROUPS, SIZE + 1, MEMBERS)}

    def __init__(self, frequent, numbers, weights=None):
        self.frequent, self.numbers, self.seen = frequent, numbers, 0
        rng = np.random.default_rng(6)
        self.weights = weights or {k: (rng.normal(size=s) * 0.1).astype(np.float32) for k, s in self.SHAPES.items()}

    def tokens(self, words, endings):
        """Vocabulary numbers; the frequent words are spread over the groups by their rank."""
        out = FREQUENT + classes(endings)
        own = self.frequent.own
        if len(own):
            at = np.minimum(np.searchsorted(own, words), len(own) - 1)
            out = np.where(own[at] == words, self.numbers[at], out)
        return out

    def contexts(self, tokens, first, at):
        """Tokens at every offset from ``at``; the last number stands for what is outside the text."""
        row = np.searchsorted(first, at, "right") - 1
        out = np.full((len(OFFSETS), len(at)), VOCABULARY, np.int16)
        for i, o in enumerate(OFFSETS):
            inside = (at + o >= first[row]) & (at + o < first[row + 1])
            out[i, inside] = tokens[at[inside] + o]
        return out

    def hidden(self, contexts):
        w = self.weights
        h = np.tanh(sum((w["context"][i][c] for i, c in enumerate(contexts)), w["hidden"]))
        return np.concatenate([h, np.ones((len(h), 1), np.float32)], axis=1)

    def log_probabilities(self, tokens, first, at):
        h = self.hidden(self.contexts(tokens, first, at))
        group, member = np.divmod(tokens[at], MEMBERS)
        logits = h @ self.weights["group"]
        out = logits[np.arange(len(at)), group] - _log_sum(logits)
        by = np.argsort(group, kind="stable")
        edges = np.searchsorted(group[by], np.arange(GROUPS + 1))
        for g in range(GROUPS):
            own = by[edges[g]:edges[g + 1]]
            if len(own):
                logits = h[own] @ self.weights["member"][g]
                out[own] += logits[np.arange(len(own)), member[own]] - _log_sum(logits)
        return out

    def learn(self, contexts, tokens, rate):
        """One gradient step on the mean log-probability of ``tokens`` beside their ``contexts``."""
        w, n = self.weights, len(tokens)
        group, member = np.divmod(tokens, MEMBERS)
        by = np.argsort(group.astype(np.int8), kind="stable")    # small types sort in linear time
        contexts, group, member, rows = contexts[:, by], group[by], member[by], np.arange(n)
        h = self.hidden(contexts)
        error = -_softmax(h @ w["group"])
        error[rows, group] += 1
        back = error @ w["group"].T
        change_group = h.T @ error / n
        edges = np.searchsorted(group, np.arange(GROUPS + 1))
        slices = [(g, slice(edges[g], edges[g + 1])) for g in range(GROUPS) if edges[g] < edges[g + 1]]
        logits = np.empty((n, MEMBERS), np.float32)
        for g, own in slices:
            logits[own] = h[own] @ w["member"][g]
        error = -_softmax(logits)
        error[rows, member] += 1
        for g, own in slices:
            back[own] += error[own] @ w["member"][g].T
            w["member"][g] += rate * (h[own].T @ error[own]) / np.float32(np.sqrt(n * (own.stop - own.start)))
        w["group"] += rate * change_group * 4
        back = back[:, :SIZE] * (1 - h[:, :SIZE] ** 2)
        w["hidden"] += rate * back.mean(axis=0)
        for i, c in enumerate(contexts):
            order = np.argsort(c, kind="stable")
            c = c[order]
            begin = np.flatnonzero(np.concatenate([[True], c[1:] != c[:-1]]))
            total = np.add.reduceat(back[order], begin, axis=0)
            count = np.diff(np.append(begin, n))[:, None]
            w["context"][i][c[begin]] += total * (rate / np.sqrt(n * count)).astype(np.float32)

    def flat(self):
        return np.concatenate([self.weights[k].ravel() for k in self.SHAPES])

    def with_flat(self, flat):
        weights, at = {}, 0
        for k, shape in self.SHAPES.items():
            size = int(np.prod(shape))
            weights[k] = flat[at:at + size].reshape(shape).astype(np.float32)
            at += size
        return Network(self.frequent, self.numbers, weights)


def _log_sum(x):
    top = x.max(axis=1)
    return top + np.log(np.exp(x - top[:, None]).sum(axis=1))


def _softmax(x):
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def targets(first, number, rounds):
    """Places of the words that round ``number`` predicts, counted from the start of each text."""
    place = np.arange(first[-1]) - np.repeat(first[:-1], np.diff(first))
    return np.flatnonzero(place % rounds == number)


def _round(docs: DataFrame, network: Network, number: int, rounds: int, rate: float) -> Network:
    """One run of every task over its documents, and the average of what the tasks learned."""
    shared = docs.sparkSession.sparkContext.broadcast(network)

    def run(batches):
        own, seen = shared.value.with_flat(shared.value.flat()), 0
        for batch in batches:
            for _, _, data, offsets in tb.each_slice(batch.column(0)):
                words, endings, first = word_hashes(data, offsets)
                tokens = own.tokens(words, endings)
                at = targets(first, number, rounds)
                contexts, tokens = own.contexts(tokens, first, at), tokens[at]
                for low in range(0, len(at), BATCH):
                    own.learn(contexts[:, low:low + BATCH], tokens[low:low + BATCH], rate)
                seen += len(at)
        flat = own.flat().astype(np.float64) * seen
        parts = range(0, len(flat), _PART)
        yield pa.RecordBatch.from_arrays([
            pa.array(list(range(len(parts))), pa.int32()), pa.array([flat[i:i + _PART].tobytes() for i in parts], pa.binary()),
            pa.array([seen] * len(parts), pa.int64())], names=["part", "sums", "seen"])

    def add(batches):
        totals: dict = {}
        for batch in batches:
            for part, sums, seen in zip(*(c.to_pylist() for c in batch.columns)):
                a, n = totals.get(part, (0, 0))
                totals[part] = (a + np.frombuffer(sums), n + seen)
        names = list(totals)
        yield pa.RecordBatch.from_arrays([
            pa.array(names, pa.int32()), pa.array([totals[p][0].tobytes() for p in names], pa.binary()),
            pa.array([int(totals[p][1]) for p in names], pa.int64())], names=["part", "sums", "seen"])

    schema = "part int, sums binary, seen bigint"
    rows = docs.select("text").mapInArrow(run, schema).repartition("part").mapInArrow(add, schema).orderBy("part").collect()
    if not rows or not rows[0]["seen"]:
        return network
    learned = network.with_flat(np.concatenate([np.frombuffer(r["sums"]) / r["seen"] for r in rows]))
    learned.seen = network.seen + rows[0]["seen"]
    return learned


def train(docs: DataFrame, rounds=ROUNDS, rate=RATE) -> Network:
    """Vocabulary and weights from all documents; every word is predicted in one of the rounds."""
    network = Network(*vocabulary(docs))
    for number in range(rounds):
        network = _round(docs, network, number, rounds, rate)
    return network


def score(docs: DataFrame, network: Network, keep=("doc_id",)) -> DataFrame:
    """``keep`` with ``n_words``, ``log_probability`` and its mean per word.

    A row whose words' counts the tasks do not all keep gets them by a join over a row number.
    """
    keep = list(keep)
    shared = docs.sparkSession.sparkContext.broadcast(network)

    def function(column):
        n, total, rest = np.zeros(len(column), np.int64), np.zeros(len(column)), []
        for low, high, data, offsets in tb.each_slice(column):
            words, endings, first = word_hashes(data, offsets)
            tokens = shared.value.tokens(words, endings)
            logs, open_ = shared.value.frequent.within(words, tokens)
            for at in range(0, len(tokens), 1 << 15):
                here = np.arange(at, min(at + (1 << 15), len(tokens)))
                logs[here] += shared.value.log_probabilities(tokens, first, here)
            n[low:high] = np.diff(first)
            total[low:high] = np.diff(np.concatenate([[0], np.cumsum(logs)])[first])
            begin = np.searchsorted(open_, first).astype(np.int32)
            rest.append(pa.ListArray.from_arrays(pa.array(begin), pa.array(words[open_], pa.int64())))
        rest = pa.concat_arrays(rest) if rest else pa.array([], pa.list_(pa.int64()))
        return [pa.array(n), pa.array(total), rest]

    found = per_row(docs, function, "n_words bigint, log_probability double, _rest array<bigint>", keep=keep)
    rest = network.frequent.rest
    if rest is None:
        total = F.col("log_probability")
    else:
        found = cut_lineage(found.withColumn("_row", F.monotonically_increasing_id()))
        more = found.select("_row", F.explode("_rest").alias("word")).join(rest, "word").groupBy("_row").agg(
            F.sum(F.log("n")).alias("_more"))
        found = found.join(more, "_row", "left")
        total = F.col("log_probability") + F.coalesce("_more", F.lit(0.0))
    return found.select(*keep, "n_words", total.alias("log_probability"), F.when(
        F.col("n_words") > 0, total / F.col("n_words")).alias("mean_log_probability"))


def lm_digest(docs: DataFrame) -> DataFrame:
    return score(docs, train(docs))
