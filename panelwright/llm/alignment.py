"""Alignment of two tokenizers' tokens over the same texts.

A text's bytes are cut by tokenizer A and by tokenizer B. Two tokens are linked if their
byte ranges overlap, and linked tokens form groups that both tokenizers cut alike. Groups are found
by pointer jumping: every token points to the token of the other side that it overlaps and
that reaches farthest right, and replacing each pointer by its pointer's pointer converges to
the group's terminal token in logarithmically many vectorised steps.

Ids are written once; counting and scoring read them instead of tokenizing again. How many
documents hold an id pair is added up in the tasks and then by pair. Frequent pairs are sent to
the tasks in a table of bounded size, all others are joined, so every link gets its exact
count. The best count of each A id is a table of A's vocabulary.

Edge cases: a null or empty text, or one that a tokenizer does not give back byte by byte (such
as one with the character that stands for a space), has no tokens and zeros; repeated rows are
documents of their own; a text of any length is one document and is read whole; pairs
with equal counts are all best; an empty table gives no rows. Columns that are not named are
not read.
"""

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwright.llm import textbytes as tb
from panelwright.llm import tokens
from panelwright.llm.frames import per_row
from panelwright.llm.pieces import piece_coder
from panelwright.session import cut_lineage, discard

#: Pairs of the table that is sent to the tasks, at 16 bytes each.
TABLE_PAIRS = 1 << 19
#: Pairs a task gathers before it adds them up, and distinct ones that it then passes on.
GATHERED, PASSED = 1 << 20, 1 << 18
#: Bytes of text encoded, and bytes of ids aligned, at a time.
TEXT_BYTES, ID_BYTES = 2 << 20, 1 << 20
#: An id pair is one number, A's id above B's.
_SHIFT = 32


def default_paths():
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def both_ids(column, paths):
    """Per row the A and B ids of a space and the text, as two pairs of flat ids and row bounds."""
    data, offsets = tb.raw(column)
    sizes = np.diff(offsets)
    # A space before each text, in one piece of memory.
    begin = np.concatenate([[0], np.cumsum(sizes + (sizes > 0))])
    spaced = np.full(begin[-1], 32, np.uint8)
    at = np.arange(sizes.sum()) + np.repeat(begin[:-1] + 1 - (np.cumsum(sizes) - sizes), sizes)
    spaced[at] = data[offsets[0]:offsets[-1]]
    texts = pa.LargeStringArray.from_buffers(len(sizes), pa.py_buffer(begin.astype(np.int64)), pa.py_buffer(spaced))
    a, a_begin = tokens.encode(texts, paths[0])
    b, b_begin, exact = piece_coder(paths[1]).encode(spaced, begin)
    exact &= np.diff(np.concatenate([[0], np.cumsum(_lengths(paths[0])[a])])[a_begin]) == np.diff(begin)
    return _only(a.astype(np.int64), a_begin, exact), _only(b, b_begin, exact)


def _only(ids, begin, rows):
    """Ids of the chosen rows; the others become empty."""
    sizes = np.diff(begin) * rows
    return ids[np.repeat(rows, np.diff(begin))], np.concatenate([[0], np.cumsum(sizes)])


def _lengths(path):
    """Bytes of each A id."""
    own = tokens.coder(path)
    if own.whole is not None:
        raise ValueError("tokenizer A must be byte-level")
    return own.lengths


def _reach(ids, begin, lengths):
    """End of each token in the bytes of all rows, and each row's bytes."""
    ends = np.cumsum(lengths[ids])
    return ends, np.concatenate([[0], ends])[begin]


class Alignment:
    """Links and groups of the rows of ``a`` and ``b``, pairs of flat ids and row bounds over equal bytes."""

    def __init__(self, a, b, a_lengths, b_lengths):
        (self.a, self.a_begin), (self.b, self.b_begin) = a, b
        a_end, rows = _reach(self.a, self.a_begin, a_lengths)
        b_end, _ = _reach(self.b, self.b_begin, b_lengths)
        n = len(self.a)
        # The token of the other side that holds a token's last byte reaches farthest right.
        to_b, to_a = np.searchsorted(b_end, a_end), np.searchsorted(a_end, b_end)
        pointer = np.concatenate([np.where(b_end[to_b] > a_end, n + to_b, np.arange(n)) if n else to_b, to_a])
        while True:
            farther = pointer[pointer]
            if np.array_equal(farther, pointer):
                break
            pointer = farther
        terminal = pointer[:n] == np.arange(n)
        number = np.cumsum(terminal) - 1
        #: Group of every A and B token, numbered from left to right.
        self.a_group, self.b_group = number[pointer[:n]], number[pointer[n:]]
        self.n_groups = np.diff(np.concatenate([[0], np.cumsum(terminal)])[self.a_begin])
        # Each stretch between neighbouring ends lies in one token of either side: a link.
        ends = np.union1d(a_end, b_end)
        self.link_a, self.link_b = np.searchsorted(a_end, ends), np.searchsorted(b_end, ends)
        self.link_begin = np.searchsorted(ends, rows, "right")
        self.pairs = (self.a[self.link_a] << _SHIFT) | self.b[self.link_b]
        self.link_row = np.repeat(np.arange(len(self.link_begin) - 1), np.diff(self.link_begin))

    def by_document(self):
        """``(row, pair, times)`` of the distinct pairs of each row."""
        order = np.lexsort((self.pairs, self.link_row))
        row, pair = self.link_row[order], self.pairs[order]
        new = np.ones(len(pair), bool)
        new[1:] = (pair[1:] != pair[:-1]) | (row[1:] != row[:-1])
        at = np.flatnonzero(new)
        return row[at], pair[at], np.diff(np.append(at, len(pair)))

    def texts(self):
        """The groups of each row as ``a1,a2|b1;a3|b2,b3`` in bytes."""
        ids = np.concatenate([self.a, self.b])
        group = np.concatenate([self.a_group, self.b_group])
        side = np.repeat([0, 1], [len(self.a), len(self.b)])
        order = np.argsort(2 * group + side, kind="stable")
        ids, key = ids[order], (2 * group + side)[order]
        row = np.concatenate([np.repeat(np.arange(len(x) - 1), np.diff(x)) for x in (self.a_begin, self.b_begin)])[order]
        digits, sizes, table_begin = _decimals(int(ids.max()) + 1 if len(ids) else 1)
        long = sizes[ids] + 1
        begin = np.cumsum(long) - long
        text = np.empty(long.sum(), np.uint8)
        text[np.arange(len(text) - len(ids)) + np.repeat(np.arange(len(ids)), long - 1)] = digits[
            np.arange(len(text) - len(ids)) + np.repeat(table_begin[ids] - (np.cumsum(long - 1) - (long - 1)), long - 1)]
        last = np.ones(len(ids), bool)
        last[:-1] = key[1:] != key[:-1]
        text[begin + long - 1] = np.where(~last, ord(","), np.where(key % 2 == 0, ord("|"), ord(";")))
        edge = np.append(begin, len(text))[np.searchsorted(row, np.arange(len(self.a_begin)))]
        whole = memoryview(text)
        return [whole[x:max(x, y - 1)] for x, y in zip(edge.tolist(), edge[1:].tolist())]


_DIGITS: dict = {}


def _decimals(count):
    """Decimal digits of the numbers below ``count`` one after another, their sizes and places."""
    count = 1 << max(17, count.bit_length())
    if count not in _DIGITS:
        texts = [str(i) for i in range(count)]
        sizes = np.array([len(t) for t in texts])
        _DIGITS[count] = np.frombuffer("".join(texts).encode(), np.uint8), sizes, np.cumsum(sizes) - sizes
    return _DIGITS[count]


def _raw(column):
    """Bytes and offsets from 0 of an Arrow binary array."""
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset:column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8)[offsets[0]:offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def _kinds(paths):
    """Unsigned little-endian types that hold all ids of A and of B."""
    return ["<u2" if len(lengths) <= 1 << 16 else "<u4" for lengths in (_lengths(paths[0]), piece_coder(paths[1]).lengths)]


def _flat(column, kind):
    data, offsets = _raw(column)
    ids = data.view(kind)
    return ids.astype(np.int64), offsets // ids.itemsize


def _as_binary(parts, kind):
    ids = np.concatenate([ids for ids, _ in parts]).astype(kind)
    sizes = np.concatenate([np.diff(begin) for _, begin in parts])
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(sizes), [
        None, pa.py_buffer(np.concatenate([[0], np.cumsum(sizes * ids.itemsize)]).astype(np.int64)), pa.py_buffer(ids)]).cast(pa.binary())


def write_ids(docs: DataFrame, paths, keep) -> DataFrame:
    """A written table of ``keep``, ``_row``, and the ids ``_a`` and ``_b`` of every document, in the types of :func:`_kinds`."""

    def encoded(column):
        none = np.zeros(0, np.int64), np.zeros(1, np.int64)
        a, b = [none], [none]
        for low, high in tb.slices(tb.raw(column)[1], TEXT_BYTES):
            one, two = both_ids(column.slice(low, high - low), paths)
            a.append(one)
            b.append(two)
        return [_as_binary(parts, kind) for parts, kind in zip((a, b), _kinds(paths))]

    found = per_row(docs, encoded, "_a binary, _b binary", keep=keep)
    return cut_lineage(found.withColumn("_row", F.monotonically_increasing_id()))


def _aligned(batch, paths):
    names = batch.schema.names
    a, b = (_flat(batch.column(names.index(c)), kind) for c, kind in zip(("_a", "_b"), _kinds(paths)))
    return Alignment(a, b, _lengths(paths[0]), piece_coder(paths[1]).lengths)


def pair_counts(ids: DataFrame, paths) -> DataFrame:
    """``pair`` and ``n``, the number of documents that hold the pair linked."""

    def added(parts):
        pairs, inverse = np.unique(np.concatenate([p for p, _ in parts]), return_inverse=True)
        return pairs, np.bincount(inverse, np.concatenate([n for _, n in parts]), len(pairs)).astype(np.int64)

    def run(batches):
        parts, size = [], 0
        for batch in _small(batches):
            pairs, n = np.unique(_aligned(batch, paths).by_document()[1], return_counts=True)
            parts.append((pairs, n))
            size += len(pairs)
            if size > GATHERED:
                parts = [added(parts)]
                size = len(parts[0][0])
                if size > PASSED:
                    yield from _rows(*parts[0])
                    parts, size = [], 0
        if parts:
            yield from _rows(*added(parts))

    gathered = ids.select("_a", "_b").mapInArrow(run, "pair bigint, n bigint")
    return gathered.groupBy("pair").agg(F.sum("n").alias("n"))


def _rows(pairs, counts, most=1 << 16):
    for low in range(0, len(pairs), most):
        yield pa.RecordBatch.from_arrays([pa.array(pairs[low:low + most]), pa.array(counts[low:low + most])], names=["pair", "n"])


def _small(batches, most=ID_BYTES):
    """Batches of a bounded number of id bytes, or of one longer row."""
    for whole in batches:
        if whole.num_rows:
            names = whole.schema.names
            size = sum(np.diff(_raw(whole.column(names.index(c)))[1]) for c in ("_a", "_b"))
            for low, high in tb.slices(np.concatenate([[0], np.cumsum(size)]), most):
                yield whole.slice(low, high - low)


def frequent(counts: DataFrame, most) -> int:
    """The smallest power of two that at most ``most`` pairs reach with their counts."""
    levels = counts.groupBy((F.length(F.bin("n")) - 1).alias("level")).agg(F.count("*").alias("pairs"))
    limit, total = 0, 0
    for level, pairs in sorted(((r["level"], r["pairs"]) for r in levels.collect()), reverse=True):
        total += pairs
        if total > most:
            return 1 << (level + 1)
        limit = level
    return 1 << limit


def align(docs: DataFrame, paths=None, keep=("doc_id",), groups=False, table_pairs=TABLE_PAIRS) -> DataFrame:
    """Per document ``keep``, ``n_a``, ``n_b``, ``n_groups``, ``n_links``, ``n_best``, ``count_sum`` and
    ``groups_sha256`` of the groups as ``a1,a2|b1;a3|b2,b3``; with ``groups``, that text as well.

    ``keep`` must not name these columns. ``paths``: files of a byte-level tokenizer A and of a sentence-piece tokenizer B.
    """
    paths, keep = paths or default_paths(), list(keep)
    ids = write_ids(docs, paths, keep)
    counts = cut_lineage(pair_counts(ids, paths))
    a_id = F.shiftright("pair", _SHIFT)
    # At most one row for every id of A's vocabulary.
    tops = counts.groupBy(a_id.cast("int").alias("a")).agg(F.max("n").alias("_top"))
    best = tops.toArrow()
    limit = frequent(counts, table_pairs)
    table = counts.filter(F.col("n") >= limit).toArrow()
    pairs, n = table["pair"].to_numpy(), table["n"].to_numpy()
    order = np.argsort(pairs)
    best_of = np.zeros(len(_lengths(paths[0])), np.int64)
    best_of[best["a"].to_numpy()] = best["_top"].to_numpy()
    sent = docs.sparkSession.sparkContext.broadcast((pairs[order], n[order], best_of))
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ids.schema if f.name not in ("_a", "_b"))
    names = [f.name for f in ids.schema if f.name not in ("_a", "_b")]
    numbers = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"]

    def run(batches):
        known, known_n, top = sent.value
        for batch in _small(batches):
            own = _aligned(batch, paths)
            row, pair, times = own.by_document()
            at = np.minimum(np.searchsorted(known, pair), max(0, len(known) - 1))
            hit = known[at] == pair if len(known) else np.zeros(len(pair), bool)
            count = np.where(hit, known_n[at] if len(known) else 0, 0)
            is_best = hit & (count == top[pair >> _SHIFT])
            rows = batch.num_rows
            made = [np.diff(own.a_begin), np.diff(own.b_begin), own.n_groups, np.diff(own.link_begin),
                    _sums(row, times * is_best, rows), _sums(row, times * count, rows)]
            rest_begin = np.concatenate([[0], np.cumsum(np.bincount(row[~hit], minlength=rows))]).astype(np.int32)
            rest = pa.ListArray.from_arrays(pa.array(rest_begin), pa.StructArray.from_arrays(
                [pa.array(pair[~hit]), pa.array(times[~hit])], names=["pair", "times"]))
            texts = own.texts()
            shown = [pa.array([str(t, "ascii") for t in texts], pa.string())] if groups else []
            digests = [hashlib.sha256(t).hexdigest() if len(t) else "" for t in texts]
            yield pa.RecordBatch.from_arrays(
                [batch.column(batch.schema.names.index(c)) for c in names] + [pa.array(x, pa.int64()) for x in made]
                + [pa.array(digests, pa.string()), rest, *shown],
                names=[*names, *numbers, "groups_sha256", "_rest", *["groups"] * groups])

    schema = (f"{kept}, {', '.join(f'{c} bigint' for c in numbers)}, groups_sha256 string, "
              f"_rest array<struct<pair:bigint,times:bigint>>{', groups string' if groups else ''}")
    scored = cut_lineage(ids.mapInArrow(run, schema))
    # A pair outside the table has fewer documents than the limit, so no key of this join is hot.
    rest = scored.select("_row", F.inline("_rest")).join(counts.filter(F.col("n") < limit), "pair")
    rest = rest.join(tops, a_id == F.col("a")).groupBy("_row").agg(
        F.sum(F.when(F.col("n") == F.col("_top"), F.col("times")).otherwise(0)).alias("_best"), F.sum(F.col("times") * F.col("n")).alias("_sum"))
    out = scored.drop("_rest").join(rest, "_row", "left").withColumns({"n_best": F.col("n_best") + F.coalesce("_best", F.lit(0)),
                                "count_sum": F.col("count_sum") + F.coalesce("_sum", F.lit(0))}).drop("_row", "_best", "_sum")
    sent.destroy()
    discard(ids)
    return out


def _sums(row, values, rows):
    """Exact integer sums of ``values`` by row; ``row`` is ascending."""
    total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return np.diff(total[np.searchsorted(row, np.arange(rows + 1))])


def alignment_digest(docs: DataFrame, paths=None) -> DataFrame:
    """One row per document as the query returns it."""
    return align(docs, paths).select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
