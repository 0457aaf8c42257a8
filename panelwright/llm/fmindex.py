"""FM-index over a sequence of small integers: wavelet-tree ranks and sampled suffix positions."""

import numpy as np


def suffix_array(text):
    """Start positions of all suffixes in order, by prefix doubling of what is still tied."""
    n = len(text)
    _, rank = np.unique(text, return_inverse=True)
    rank = rank.astype(np.int64)
    order = np.argsort(rank, kind="stable")
    sorted_rank = rank[order]
    head = np.concatenate([[True], sorted_rank[1:] != sorted_rank[:-1]])
    group = np.flatnonzero(head)[np.cumsum(head) - 1]   # a rank is the first place of its group
    rank[order] = group
    step = 1
    while True:
        tied = np.concatenate([~head[1:], [False]]) | ~head
        places = np.flatnonzero(tied)
        if not len(places):
            return order
        at = order[places]
        after = at + step
        second = np.where(after < n, rank[np.minimum(after, n - 1)], -1)
        by = np.lexsort((second, rank[at]))
        at, second = at[by], second[by]
        order[places] = at
        first = rank[at]
        new = np.concatenate([[True], (first[1:] != first[:-1]) | (second[1:] != second[:-1])])
        head[places] = new
        rank[at] = places[np.flatnonzero(new)[np.cumsum(new) - 1]]
        step *= 2


class FMIndex:
    """Index of ``text``, an array of integers above 0; a closing 0 is added."""

    SAMPLE = 8

    def __init__(self, text, symbols):
        text = np.concatenate([text, [0]]).astype(np.int64)
        self.n, self.symbols = len(text), symbols
        order = suffix_array(text)
        level = text[order - 1]
        self.before = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=symbols + 1))])
        self.bits = max(1, int(symbols).bit_length())
        self.ones, self.zeros = [], []
        for b in reversed(range(self.bits)):
            bit = (level >> b) & 1
            ones = np.zeros(self.n + 1, np.int32)
            np.cumsum(bit, out=ones[1:])
            self.ones.append(ones)
            self.zeros.append(self.n - int(ones[-1]))
            level = np.concatenate([level[bit == 0], level[bit == 1]])
        self.origin = self._walk(np.arange(symbols + 1), np.zeros(symbols + 1, np.int64))
        kept = order % self.SAMPLE == 0
        self.sampled = np.concatenate([[0], np.cumsum(kept)])
        self.samples = order[kept]

    def _walk(self, symbol, place):
        for b, ones, zeros in zip(reversed(range(self.bits)), self.ones, self.zeros):
            set_before = ones[place]
            place = np.where((symbol >> b) & 1, zeros + set_before, place - set_before)
        return place

    def step(self, symbol, place):
        """Where suffixes that start with ``symbol`` and go on as those before ``place`` end."""
        return self.before[symbol] + self._walk(symbol, place) - self.origin[symbol]

    def search(self, patterns, begin):
        """Suffix range of every pattern; pattern ``i`` is ``patterns[begin[i]:begin[i + 1]]``."""
        low = np.zeros(len(begin) - 1, np.int64)
        high = np.full(len(begin) - 1, self.n, np.int64)
        at = begin[1:] - 1
        live = np.arange(len(low))
        while len(live):
            symbol = patterns[at[live]]
            low[live], high[live] = self.step(symbol, low[live]), self.step(symbol, high[live])
            at[live] -= 1
            live = live[(low[live] < high[live]) & (at[live] >= begin[live])]
        return low, np.maximum(low, high)

    def locate(self, places):
        """Text positions of suffixes, walking back to the nearest sampled one."""
        out = np.zeros(len(places), np.int64)
        todo, place, walked = np.arange(len(places)), places.copy(), 0
        while len(todo):
            kept = self.sampled[place + 1] > self.sampled[place]
            out[todo[kept]] = self.samples[self.sampled[place[kept]]] + walked
            todo, place = todo[~kept], place[~kept]
            symbol, down = np.zeros(len(place), np.int64), place
            for ones, zeros in zip(self.ones, self.zeros):
                bit = ones[down + 1] - ones[down]
                symbol = symbol * 2 + bit
                down = np.where(bit == 1, zeros + ones[down], down - ones[down])
            place = self.before[symbol] + down - self.origin[symbol]
            walked += 1
        return out
