"""Words of many texts at once, as numpy arrays over the UTF-8 bytes of an Arrow column.

Every separator used here is an ASCII character, so a byte decides alone whether it
belongs to a word: bytes of longer code points are 128 and above. Texts are processed in
slices of bounded size, cut between rows.
"""

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 20
_BLOCK = 1 << 18
_U = np.uint64

#: A-Z to a-z, all other bytes as they are.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: `[^\x20\x09-\x0D]`
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[32, 9, 10, 11, 12, 13]] = False
#: `[^\x00-\x2F\x3A-\x60\x7B-\x7F]`, for lower-cased bytes
ALNUM = np.zeros(256, bool)
ALNUM[48:58] = ALNUM[97:123] = ALNUM[128:] = True
_STARTS_CODE_POINT = (np.arange(256) & 0xC0) != 0x80


def raw(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of an Arrow string array; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset:column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data, offsets


def slices(offsets, limit=SLICE_BYTES):
    """Row ranges whose texts together hold at most ``limit`` bytes, or one longer row."""
    low, rows = 0, len(offsets) - 1
    while low < rows:
        high = int(np.searchsorted(offsets, offsets[low] + limit, "right")) - 1
        high = min(max(high, low + 1), rows)
        yield low, high
        low = high


def each_slice(column, limit=SLICE_BYTES):
    """``(low, high, bytes, offsets from 0)`` of every slice of the rows."""
    data, offsets = raw(column)
    for low, high in slices(offsets, limit):
        own = offsets[low:high + 1]
        yield low, high, data[own[0]:own[-1]], own - own[0]


def words(data, offsets, member):
    """Start and end of every maximal run of member bytes within a row, and the first word of each row."""
    inside = member[data]
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    starts, ends = inside.copy(), inside.copy()
    starts[1:] &= ~inside[:-1] | edge[1:-1]
    ends[:-1] &= ~inside[1:] | edge[1:-1]
    starts, ends = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def mix(x):
    """A bijection of 64-bit words that spreads every bit."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


class Hasher:
    """64-bit hashes of byte ranges from one running sum per slice of bytes.

    A range hashes to the sum of its bytes' random values times the powers of an odd
    number, divided by the power at its start, which odd numbers allow modulo 2**64.
    """

    def __init__(self, seed):
        rng = np.random.default_rng(seed)
        self.table = rng.integers(0, 2**64, 256, np.uint64)
        base = int(rng.integers(0, 2**61)) * 8 + 5
        powers = np.full(_BLOCK, base, np.uint64)
        powers[0] = 1
        self.powers = np.cumprod(powers, dtype=np.uint64)
        inverse = pow(base, -1, 2**64)
        powers = np.full(_BLOCK, inverse, np.uint64)
        powers[0] = 1
        self.inverses = np.cumprod(powers, dtype=np.uint64)
        self.step, self.back = pow(base, _BLOCK, 2**64), pow(inverse, _BLOCK, 2**64)

    def sums(self, data):
        out = np.zeros(len(data) + 1, np.uint64)
        factor, total = 1, _U(0)
        for low in range(0, len(data), _BLOCK):
            part = self.table[data[low:low + _BLOCK]]
            part *= self.powers[:len(part)]
            if factor != 1:
                part *= _U(factor)
            np.cumsum(part, out=part)
            part += total
            out[low + 1:low + 1 + len(part)] = part
            total, factor = part[-1], factor * self.step % 2**64
        return out

    def ranges(self, sums, starts, ends):
        difference = sums[ends] - sums[starts]
        block = starts // _BLOCK
        difference *= self.inverses[starts % _BLOCK]
        if len(starts) and block[-1]:
            factors = np.full(int(block.max()) + 1, self.back, np.uint64)
            factors[0] = 1
            difference *= np.cumprod(factors, dtype=np.uint64)[block]
        return mix(difference + (ends - starts).astype(np.uint64) * _U(0x9E3779B97F4A7C15))

    def words(self, data, starts, ends):
        return self.ranges(self.sums(data), starts, ends)


def shingles(hashes, first, k):
    """Hashes of ``k`` consecutive words per row, and each row's first shingle.

    A row of fewer words, but not none, has its whole sequence as one shingle.
    """
    counts = np.diff(first)
    sizes = np.where(counts >= k, counts - k + 1, np.minimum(counts, 1))
    begin = np.concatenate([[0], np.cumsum(sizes)])
    at = np.arange(begin[-1]) + np.repeat(first[:-1] - begin[:-1], sizes)
    length = np.repeat(np.minimum(counts, k), sizes)
    out = mix(length.astype(np.uint64) + _U(k))
    for j in range(k):
        live = length > j
        word = hashes[np.where(live, at + j, 0)] if len(hashes) else hashes
        out = np.where(live, mix(out * _U(0x9E3779B97F4A7C15) + word), out)
    return out, begin


def code_point_offsets(data):
    """Code points before each byte position of a text."""
    return np.concatenate([[0], np.cumsum(_STARTS_CODE_POINT[data])])
