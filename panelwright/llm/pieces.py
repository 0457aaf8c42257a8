"""Ids of whole texts by a public sentence-piece file, in bytes.

If no piece of the vocabulary has a space after another character, no token crosses from
another character to a space. Texts are then cut there, distinct chunks are encoded once, and
their ids are put together again. Any other file encodes text by text.
"""

import numpy as np

from panelwright.llm import textbytes as tb

_SPACE = "▁"
_HASHES = tb.Hasher(31), tb.Hasher(32)
#: Chunks a process keeps with their ids, found by 128 bits of hash.
_KEPT = 1 << 20
_SLICE = 4 << 20
_LOADED: dict = {}


class PieceCoder:
    """Encodes bytes of texts that each start with a space, the one that the model puts before a text."""

    def __init__(self, path):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        count = self.model.get_piece_size()
        self.bytes = [self._bytes(i) for i in range(count)]
        self.lengths = np.array([len(b) for b in self.bytes], np.int64)
        self.table = np.frombuffer(b"".join(self.bytes), np.uint8)
        self.places = np.cumsum(self.lengths) - self.lengths
        pieces = [self.model.id_to_piece(i) for i in range(count)]
        self.space = pieces.index(_SPACE) if _SPACE in pieces else None
        lossless = self.model.encode("a  b ", out_type=int) and self._decoded(self.model.encode("a  b ", out_type=int)) == b" a  b "
        self.cuts = bool(lossless) and self.space is not None and not any(
            x != _SPACE and y == _SPACE for p in pieces for x, y in zip(p, p[1:]))
        self.forget()

    def _bytes(self, i):
        if self.model.is_byte(i):
            return bytes([int(self.model.id_to_piece(i)[1:-1], 16)])
        if self.model.is_control(i) or self.model.is_unknown(i):
            return b""
        return self.model.id_to_piece(i).replace(_SPACE, " ").encode()

    def _decoded(self, ids):
        return b"".join(self.bytes[i] for i in ids)

    def forget(self):
        self.keys = np.zeros((2, _KEPT), np.uint64)
        self.begin, self.size = np.zeros(_KEPT, np.int64), np.zeros(_KEPT, np.int32)
        self.pool, self.filled = np.zeros(8 * _KEPT, np.int32), 0

    def _store(self, ids):
        if self.filled + len(ids) > len(self.pool):
            self.size[:], self.filled = 0, 0
            if len(ids) > len(self.pool):
                self.pool = np.zeros(len(ids), np.int32)
        at = self.filled
        self.pool[at:at + len(ids)] = ids
        self.filled += len(ids)
        return at

    def _chunks(self, texts):
        """Ids of texts in bytes, each with its space first."""
        plain = [t[1:].decode() for t in texts]
        coded = self.model.encode(plain, out_type=int, num_threads=1)
        return [ids if t else [self.space] for t, ids in zip(plain, coded)]

    def encode(self, data, offsets):
        """``(ids, bounds of rows, exact)``; ``exact`` tells which rows the ids give back byte by byte."""
        parts, counts, exact = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, bool)]
        for low, high in tb.slices(offsets, _SLICE):
            own = offsets[low:high + 1]
            ids, sizes, same = self._slice(data[own[0]:own[-1]], own - own[0])
            parts.append(ids)
            counts.append(sizes)
            exact.append(same)
        return np.concatenate(parts), np.concatenate([[0], np.cumsum(np.concatenate(counts))]).astype(np.int64), np.concatenate(exact)

    def _slice(self, data, offsets):
        cut = np.zeros(len(data) + 1, bool)
        if self.cuts:
            cut[1:-1] = (data[1:] == 32) & (data[:-1] != 32)
        cut[offsets] = True
        starts = np.flatnonzero(cut[:-1])
        ends = np.append(starts[1:], len(data))
        if not len(starts):
            return np.zeros(0, np.int64), np.zeros(len(offsets) - 1, np.int64), np.diff(offsets) == 0
        one, two = (h.words(data, starts, ends) for h in _HASHES)
        _, first, inverse = np.unique(one ^ tb.mix(two), return_index=True, return_inverse=True)
        one, two = one[first], two[first]
        slot = (one >> np.uint64(44)).astype(np.int64)
        known = (self.size[slot] > 0) & (self.keys[0][slot] == one) & (self.keys[1][slot] == two)
        # Ids of this slice stay apart, as new chunks may push kept ones out.
        begin, size = np.zeros(len(first), np.int64), np.zeros(len(first), np.int64)
        kept_ids, kept_size = self.pool, self.size[slot] * known
        gather = lambda pool, places, sizes: pool[np.arange(sizes.sum()) + np.repeat(places - (np.cumsum(sizes) - sizes), sizes)]
        old = gather(kept_ids, self.begin[slot][known], kept_size[known].astype(np.int64))
        size[known] = kept_size[known]
        view, new = memoryview(data), np.flatnonzero(~known)
        coded = self._chunks([bytes(view[starts[i]:ends[i]]) for i in first[new].tolist()]) if len(new) else []
        size[new] = [len(ids) for ids in coded]
        fresh = np.array([i for ids in coded for i in ids], np.int32)
        begin[known] = np.cumsum(size[known]) - size[known]
        begin[new] = len(old) + np.cumsum(size[new]) - size[new]
        pool = np.concatenate([old, fresh])
        at = self._store(fresh)
        slot = slot[new]
        self.keys[0][slot], self.keys[1][slot] = one[new], two[new]
        self.begin[slot], self.size[slot] = at + begin[new] - len(old), size[new]
        # A chunk is exact if its ids' bytes are its own.
        total = self.lengths[pool]
        edge = np.concatenate([[0], np.cumsum(total)])
        same = edge[begin + size] - edge[begin] == (ends - starts)[first]
        check = np.flatnonzero(same)
        lengths = (ends - starts)[first][check]
        given = gather(self.table, self.places[gather(pool, begin[check], size[check])], self.lengths[gather(pool, begin[check], size[check])])
        differ = given != gather(data, starts[first][check], lengths)
        same[check] = np.diff(np.concatenate([[0], np.cumsum(differ)])[np.concatenate([[0], np.cumsum(lengths)])]) == 0
        ids = gather(pool, begin[inverse], size[inverse]).astype(np.int64)
        bound = np.searchsorted(starts, offsets)
        row_sizes = np.diff(np.concatenate([[0], np.cumsum(size[inverse])])[bound])
        wrong = np.diff(np.concatenate([[0], np.cumsum(~same[inverse])])[bound])
        return ids, row_sizes, wrong == 0


def piece_coder(path) -> PieceCoder:
    if path not in _LOADED:
        _LOADED[path] = PieceCoder(path)
    return _LOADED[path]
