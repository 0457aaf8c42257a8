"""Language of texts by a linear-chain conditional random field over their words.

Every word has affix, inner n-gram and whole-word (lexicon) features; learned transitions
say how readily one language follows another in code-switched text. Forward-backward gives
each word's probability of each language, and a document's language is the one with the
largest expected number of letters. The model is fitted in numpy on a bounded sample of
labelled rows, some joined to sequences that change language in the middle.

Forward and backward messages are exact for texts of any length: words are cut into blocks,
all blocks advance together, and the blocks' transfer matrices are chained per text.

Edge cases: a null text or one without any letter is ``und`` with score 0; ties go to the
smaller language name; without labelled rows every text is ``und``; repeated rows each get
their prediction. Columns that are not named in ``keep`` are not read.
"""

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwright.llm import textbytes as tb
from panelwright.llm.frames import labelled_sample, per_row, remainder

#: Labelled rows the model is fitted on at most.
FIT_ROWS = 3000
FIT_WORDS = 48
WIDTH = 1 << 17
_HASH = tb.Hasher(51)
#: A word is a run of letters: ASCII letters and all bytes of longer characters.
LETTERS = np.zeros(256, bool)
LETTERS[65:91] = LETTERS[97:123] = LETTERS[128:] = True
UNKNOWN = "und"
BLOCK = 32
#: Words whose scores a process keeps.
KEPT = 1 << 19
_SALTS = tuple(np.uint64(x) for x in (0x1F3D, 0x2E5B, 0x3C79, 0x4A97, 0x58B5, 0x66D3, 0x74F1, 0x8311))


def word_features(data, starts, ends):
    """Feature numbers of every word, flat, with begin positions.

    The whole word, prefixes and suffixes of 1 to 4 bytes, and all inner runs of 2 and 3 bytes.
    """
    sums, length = _HASH.sums(data), ends - starts
    blocks = [(np.arange(len(starts)), _HASH.ranges(sums, starts, ends), _SALTS[0])]
    for n in (1, 2, 3, 4):
        fits = np.flatnonzero(length >= n)
        blocks.append((fits, _HASH.ranges(sums, starts[fits], starts[fits] + n), _SALTS[1]))
        blocks.append((fits, _HASH.ranges(sums, ends[fits] - n, ends[fits]), _SALTS[2]))
    for n in (2, 3):
        counts = np.maximum(length - n + 1, 0)
        begin = np.cumsum(counts) - counts
        at = np.arange(counts.sum()) + np.repeat(starts - begin, counts)
        blocks.append((np.repeat(np.arange(len(starts)), counts), _HASH.ranges(sums, at, at + n), _SALTS[3]))
    word = np.concatenate([w for w, _, _ in blocks])
    number = np.concatenate([(tb.mix(h ^ (salt << np.uint64(40))) & np.uint64(WIDTH - 1)).astype(np.int64) for _, h, salt in blocks])
    by = np.argsort(word, kind="stable")
    return number[by], np.concatenate([[0], np.cumsum(np.bincount(word, minlength=len(starts)))]).astype(np.int64)


def emissions(weights, numbers, begin):
    """Sum of the weight rows of each word's features."""
    return np.add.reduceat(weights[numbers], begin[:-1], axis=0) if len(begin) > 1 else np.zeros((0, weights.shape[1]))


def marginals(scores, first, transition):
    """Per word the probability of each label: exact forward-backward over all rows at once.

    Messages are only scaled every few words; no value comes near the limits of a double.
    """
    n, k = scores.shape
    out = np.zeros((n, k))
    count = np.diff(first)
    blocks_of = -(-count // BLOCK)
    total = int(blocks_of.sum())
    if not total:
        return out
    begin = np.cumsum(blocks_of) - blocks_of
    row = np.repeat(np.arange(len(count)), blocks_of)
    start = first[row] + (np.arange(total) - begin[row]) * BLOCK
    size = np.minimum(BLOCK, first[row + 1] - start)
    order = np.argsort(-size, kind="stable")          # blocks that still have a word come first
    start = start[order]
    live = [int(np.searchsorted(-size[order], -i)) for i in range(BLOCK)]
    step = np.exp(np.clip(transition, -15, 15))
    emit = np.exp(np.maximum(scores - scores.max(axis=1, keepdims=True), -15))
    transfer = np.tile(np.eye(k), (total, 1, 1))
    for i in range(BLOCK):
        m = live[i]
        part = transfer[:m]
        np.multiply((part.reshape(-1, k) @ step).reshape(m, k, k), emit[start[:m] + i][:, None, :], out=part)
        if i % 4 == 3:
            part /= part.sum(axis=(1, 2))[:, None, None]
    back = np.empty(total, np.int64)
    back[order] = np.arange(total)
    transfer = transfer[back]
    before, after = np.full((total, k), 1 / k), np.full((total, k), 1 / k)
    for i in range(1, int(blocks_of.max())):
        at = begin[blocks_of > i] + i
        new = np.einsum("bi,bij->bj", before[at - 1], transfer[at - 1])
        before[at] = new / new.sum(axis=1, keepdims=True)
    for i in range(1, int(blocks_of.max())):
        at = (begin + blocks_of)[blocks_of > i] - 1 - i
        new = np.einsum("bij,bj->bi", transfer[at + 1], after[at + 1])
        after[at] = new / new.sum(axis=1, keepdims=True)
    before, after = before[order], after[order]
    for i in range(BLOCK):
        m = live[i]
        new = (before[:m] @ step) * emit[start[:m] + i]
        if i % 4 == 3:
            new /= new.sum(axis=1, keepdims=True)
        before[:m] = out[start[:m] + i] = new
    for i in range(BLOCK - 1, -1, -1):
        m = live[i]
        at = start[:m] + i
        out[at] *= after[:m]
        new = (emit[at] * after[:m]) @ step.T
        if i % 4 == 3:
            new /= new.sum(axis=1, keepdims=True)
        after[:m] = new
    out /= out.sum(axis=1, keepdims=True)
    return out


class LanguageModel:
    def __init__(self, labels, weights, transition):
        self.labels, self.weights, self.transition, self.kept = labels, weights, transition, None

    def word_marginals(self, data, offsets):
        starts, ends, first = tb.words(data, offsets, LETTERS)
        if not len(starts) or not self.labels:
            return starts, ends, first, np.zeros((len(starts), len(self.labels)))
        return starts, ends, first, marginals(self.word_scores(data, starts, ends), first, self.transition)

    def word_scores(self, data, starts, ends):
        """Feature scores; those of words met before are kept by their hash, within a fixed table."""
        if self.kept is None:
            self.kept = np.zeros(KEPT, np.uint64), np.zeros((KEPT, len(self.labels)), np.float32)
        keys, rows = self.kept
        own = _HASH.words(data, starts, ends)
        slot = (own >> np.uint64(64 - KEPT.bit_length() + 1)).astype(np.int64)
        scores, new = rows[slot], np.flatnonzero(keys[slot] != own)
        _, kind, number = np.unique(own[new], return_index=True, return_inverse=True)
        at = new[kind]
        made = emissions(self.weights, *word_features(data, starts[at], ends[at]))
        scores[new] = made[number]
        keys[slot[at]], rows[slot[at]] = own[at], made
        return scores

    def predict(self, column):
        """Language and its share of the text's letters for every row."""
        best, share = np.full(len(column), -1), np.zeros(len(column))
        for low, high, data, offsets in tb.each_slice(column, 1 << 19):
            starts, ends, first, p = self.word_marginals(tb.LOWER[data], offsets)
            filled = np.flatnonzero(np.diff(first))
            if not len(filled) or not self.labels:
                continue
            letters = np.add.reduceat(p * (ends - starts)[:, None], first[filled], axis=0)
            share[low + filled] = letters.max(axis=1) / letters.sum(axis=1)
            best[low + filled] = letters.argmax(axis=1)
        return best, np.clip(share, 0, 1)


def fit_model(texts, langs, epochs=3, rate=0.5, l2=1e-5, batch=64) -> LanguageModel:
    """Maximises the log-likelihood of word labels by adaptive gradient steps.

    Half of the sequences are a run of one text; the other half joins runs of two texts, so
    transitions between languages are seen as well.
    """
    labels = sorted(set(langs))
    k = len(labels)
    weights, transition = np.zeros((WIDTH, k), np.float32), np.zeros((k, k))
    if k < 2:
        return LanguageModel(labels, weights, transition)
    rng = np.random.default_rng(5)
    of = np.array([labels.index(x) for x in langs])
    data, offsets = tb.raw(pa.array(texts, pa.string()))
    data = tb.LOWER[data]
    starts, ends, first = tb.words(data, offsets, LETTERS)
    usable = np.flatnonzero(np.diff(first))
    seen, seen_t = np.full((WIDTH, k), 1e-2, np.float32), np.full((k, k), 1.0)
    for _ in range(epochs):
        order = rng.permutation(usable)
        for at in range(0, len(order), batch):
            words, truth, size = [], [], []
            for i in order[at:at + batch]:
                parts = [i, rng.choice(usable)] if rng.random() < 0.5 else [i]
                length = 0
                for j in parts:
                    n = int(min(first[j + 1] - first[j], rng.integers(4, FIT_WORDS + 1)))
                    begin = first[j] + int(rng.integers(0, first[j + 1] - first[j] - n + 1))
                    words.append(np.arange(begin, begin + n))
                    truth.append(np.full(n, of[j]))
                    length += n
                size.append(length)
            words, truth = np.concatenate(words), np.concatenate(truth)
            own = np.concatenate([[0], np.cumsum(size)])
            numbers, begin = word_features(data, starts[words], ends[words])
            scores = emissions(weights, numbers, begin).astype(float)
            p = marginals(scores, own, transition)
            g = -p
            g[np.arange(len(truth)), truth] += 1
            # Pair marginals from the words' own: P(a, b) is proportional to what each side sends.
            inner = np.ones(len(truth), bool)
            inner[own[1:] - 1] = False
            left = np.flatnonzero(inner)
            g_t = _pair_gradient(scores, own, transition, left, truth)
            flat = np.repeat(g, np.diff(begin), axis=0).astype(np.float32)
            touched, back = np.unique(numbers, return_inverse=True)
            step = np.stack([np.bincount(back, flat[:, c], len(touched)) for c in range(k)], axis=1).astype(np.float32)
            step -= l2 * len(size) * weights[touched]
            seen[touched] += step ** 2
            weights[touched] += rate * 0.1 * step / np.sqrt(seen[touched])
            seen_t += g_t ** 2
            transition += rate * g_t / np.sqrt(seen_t)
    return LanguageModel(labels, weights, transition)


def _pair_gradient(scores, own, transition, left, truth):
    """Observed minus expected numbers of label pairs, by plain forward and backward passes."""
    k = scores.shape[1]
    emit, step = np.exp(scores - scores.max(axis=1, keepdims=True)), np.exp(transition)
    count = np.diff(own)
    forward, backward = np.zeros(scores.shape), np.full(scores.shape, 1 / k)
    for i in range(int(count.max())):
        live = own[:-1][count > i] + i
        new = emit[live] * ((forward[live - 1] @ step) if i else 1.0)
        forward[live] = new / new.sum(axis=1, keepdims=True)
    for i in range(1, int(count.max())):
        live = own[1:][count > i] - 1 - i
        new = (emit[live + 1] * backward[live + 1]) @ step.T
        backward[live] = new / new.sum(axis=1, keepdims=True)
    pair = forward[left][:, :, None] * step * (emit[left + 1] * backward[left + 1])[:, None, :]
    pair /= pair.sum(axis=(1, 2), keepdims=True)
    seen = np.zeros((k, k))
    np.add.at(seen, (truth[left], truth[left + 1]), 1)
    return seen - pair.sum(axis=0)


def train(docs: DataFrame, bound=FIT_ROWS) -> LanguageModel:
    """Fitted on at most ``bound`` of the given rows that have a language and a letter."""
    rows = labelled_sample(docs.filter(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}")).select("doc_id", "text", "lang"), "doc_id", bound)
    got = sorted((r["lang"], r["text"]) for r in rows.select("text", "lang").collect())
    return fit_model([t for _, t in got], [x for x, _ in got])


def identify(docs: DataFrame, model: LanguageModel, keep=("doc_id",)) -> DataFrame:
    """``keep`` with ``lang_pred`` and ``score``, the share of letters in that language."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def function(column):
        best, share = shared.value.predict(column)
        has_letter = pc.fill_null(pc.match_substring_regex(column, r"\pL"), False).to_numpy(zero_copy_only=False)
        best = np.where(has_letter, best, -1)
        names = [*shared.value.labels, UNKNOWN]
        return [pa.array([names[i] for i in best.tolist()], pa.string()), pa.array(np.where(best < 0, 0.0, share))]

    return per_row(docs, function, "lang_pred string, score double", keep=keep)


def held_out():
    return remainder("doc_id", 3) == 1


def language_digest(docs: DataFrame) -> DataFrame:
    """One row per document as the query returns it."""
    return identify(docs, train(docs.filter(~held_out()))).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
