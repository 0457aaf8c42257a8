"""N-gram Jaccard join with a prefix tree, and the groups its links make.

A document is the set of hashes of its distinct shingles. All sets are put into one global
order, rare shingles first (by a fixed-size count of hashed shingles over all documents,
then by hash), so two sets that link share a shingle in their short beginnings. Documents
of equal sets are one class, with a representative. Candidate pairs are compared in
prefix trees: candidates of one probe are stored from their most frequent shingle on, so
similar sets share paths, the overlap with the probe is counted once per shared path, and
a subtree is left as soon as the lengths that remain cannot reach the needed overlap.

Before whole sets are moved, pairs are tested by profiles (buckets that hold a hash, and
numbers of hashes per bucket), which bound the overlap from above. Groups need no list of all pairs. A few rounds compare each set with one pivot per
shared shingle, which joins copies to few components in linear work. A last
round compares every remaining candidate pair of different components, so no link that
matters is lost. Components are merged by star contractions.

Shuffles: shingles are pre-aggregated, and every join on a shingle, class or node can be
split by adaptive execution. Nothing that grows with the corpus is broadcast: the count
table and the two membership tables have fixed sizes and only decide order and pruning.

Edge cases: documents without words (null or empty text) are empty and alone; documents of
fewer words than a shingle are one shingle; repeated rows and equal texts are one class;
an empty table has no rows; a null ``doc_id`` never becomes a ``component_id`` unless all documents
of the component have none; rows of one id with different texts are documents of their own; texts of any
length are read whole, and a tree drops its sets after some megabytes. Columns other than ``doc_id`` and
``text`` are not read.
"""

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwright.llm import textbytes as tb
from panelwright.llm.components import components
from panelwright.llm.frames import cut_lineage, discard, small_batches

SHINGLE = 4
#: Link when ``DEN * intersection >= NUM * union``.
NUM, DEN = 85, 100
_COUNTERS = 1 << 21
#: Bits of a membership table for each of its keys, and at most (16 MB).
_BITS_A_KEY, _MOST_BITS = 16, 1 << 27
#: Buckets of a set's profile: how many of its hashes fall into each.
_PROFILE = 256
#: Long words of a set's bit profile: which of 64 times as many buckets hold a hash.
_WORDS = 8
#: Rounds in which sets are compared with pivots only, before all remaining pairs are.
PIVOT_ROUNDS = 2
#: Candidate sets in one prefix tree, and candidates of a probe in one group of rows.
TREE = 128
#: Bytes of candidate sets that a tree holds before it is used and dropped.
TREE_BYTES = 8 << 20
#: Rows of documents handled at a time.
ROWS = 1000
_PART = 1 << 10


def least_overlap(a, b):
    """Smallest intersection of linked sets of sizes ``a`` and ``b``."""
    return -(-NUM * (a + b) // (NUM + DEN))


def prefix_length(n):
    """Shingles at the start of a set of ``n`` among which any linked set shares one."""
    return n + (-NUM * n // DEN) + 1


# --- sets of documents ----------------------------------------------------------------

def sets_of(column, k, seed):
    """``(row, sorted distinct shingle hashes)`` of every row with words."""
    hasher = tb.Hasher(seed)
    for low, high, data, offsets in tb.each_slice(column):
        starts, ends, first = tb.words(data, offsets, tb.NOT_SPACE)
        hashes, begin = tb.shingles(hasher.words(tb.LOWER[data], starts, ends), first, k)
        for i in np.flatnonzero(np.diff(begin)).tolist():
            own = np.sort(hashes[begin[i]:begin[i + 1]])
            if len(own) > 1:
                own = own[np.concatenate([[True], own[1:] != own[:-1]])]
            yield low + i, own


def class_key(own):
    """Two independent 64-bit sums over a set; the first is the class id, the second proves it."""
    n = np.uint64(len(own))
    return int((tb.mix(own ^ np.uint64(0x5851F42D)).sum() + n).view(np.int64)), int(
        (tb.mix(own + np.uint64(0x14057B7E)).sum() ^ n).view(np.int64))


def in_order(own, levels):
    """A set's shingles from rare to frequent; equal levels by hash."""
    key = (levels[(own & np.uint64(_COUNTERS - 1)).astype(np.int64)].astype(np.uint64) << np.uint64(44)) | (own >> np.uint64(20))
    return own[np.argsort(key, kind="stable")]


def _spread(keys, size):
    return (tb.mix(np.asarray(keys).astype(np.int64).view(np.uint64)) & np.uint64(size - 1)).astype(np.int64)


def is_member(keys, table):
    """Whether each of the long keys may be in a packed membership table."""
    at = _spread(keys, 8 * len(table))
    return (table[at >> 3] >> (at & 7).astype(np.uint8)) & 1 > 0


def _blocks(counts):
    """Non-empty parts of a counter array as rows of compressed integers."""
    table = counts.reshape(-1, _PART)
    used = np.flatnonzero(table.any(axis=1))
    return used, [zlib.compress(table[i].astype("<i8").tobytes(), 1) for i in used]


def _opened(counts):
    return np.frombuffer(zlib.decompress(counts), "<i8")


def _sum_blocks(rows: DataFrame):
    """The counter array whose parts ``(block, counts)`` add up to; its size is fixed."""
    def add(batches):
        totals: dict = {}
        for batch in batches:
            for block, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                totals[block] = totals[block] + _opened(counts) if block in totals else _opened(counts)
        yield pa.RecordBatch.from_arrays([pa.array(list(totals), pa.int32()), pa.array(
            [zlib.compress(t.tobytes(), 1) for t in totals.values()], pa.binary())], names=["block", "counts"])

    return rows.repartition("block").mapInArrow(add, "block int, counts binary").collect()


def _table(rows, size):
    out = np.zeros(size, np.int64)
    for r in rows:
        out[r["block"] * _PART:(r["block"] + 1) * _PART] = _opened(r["counts"])
    return out


def membership(keys: DataFrame, count: int) -> np.ndarray:
    """A packed table that says yes wherever one of the ``count`` long keys may be.

    It has 16 bits a key, up to 16 MB in all; with still more keys it says yes more often.
    """
    size = min(max(1 << (_BITS_A_KEY * max(1, count) - 1).bit_length(), 8 * _PART), _MOST_BITS)

    def run(batches):
        bits = np.zeros(size // 8, np.uint8)
        for batch in batches:
            at = _spread(batch.column(0).fill_null(-1), size)
            np.bitwise_or.at(bits, at >> 3, np.left_shift(1, at & 7).astype(np.uint8))
        parts = bits.reshape(-1, _PART)
        used = np.flatnonzero(parts.any(axis=1))
        for low in range(0, len(used), 1024):
            own = used[low:low + 1024]
            yield pa.RecordBatch.from_arrays([pa.array(own, pa.int32()), pa.array([zlib.compress(parts[i].tobytes(), 1) for i in own], pa.binary())],
                                             names=["block", "bits"])

    def join(batches):
        totals: dict = {}
        for batch in batches:
            for block, bits in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                own = np.frombuffer(zlib.decompress(bits), np.uint8)
                totals[block] = totals[block] | own if block in totals else own
        yield pa.RecordBatch.from_arrays([pa.array(list(totals), pa.int32()), pa.array(
            [zlib.compress(t.tobytes(), 1) for t in totals.values()], pa.binary())], names=["block", "bits"])

    out = np.zeros(size // 8, np.uint8)
    rows = keys.mapInArrow(run, "block int, bits binary").repartition("block").mapInArrow(join, "block int, bits binary").collect()
    for r in rows:
        out[r["block"] * _PART:(r["block"] + 1) * _PART] = np.frombuffer(zlib.decompress(r["bits"]), np.uint8)
    return out


def _few(batches, size=ROWS):
    return (whole.slice(at, size) for whole in batches for at in range(0, whole.num_rows, size))


def _scan(docs: DataFrame, k, seed) -> DataFrame:
    """Per document its set's size and class, and per task the counts of hashed shingles."""
    def run(batches):
        counts = np.zeros(_COUNTERS, np.int32)
        names = ["doc_id", "text_key", "n_shingles", "cid", "proof", "block", "counts"]
        for batch in _few(batches):
            n, keys = np.zeros(batch.num_rows, np.int64), np.zeros((2, batch.num_rows), np.int64)
            for row, own in sets_of(batch.column(2), k, seed):
                n[row] = len(own)
                keys[:, row] = class_key(own)
                np.add.at(counts, (own & np.uint64(_COUNTERS - 1)).astype(np.int64), 1)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n), pa.array(keys[0]), pa.array(keys[1]),
                                              pa.nulls(batch.num_rows, pa.int32()), pa.nulls(batch.num_rows, pa.binary())], names=names)
        used, blocks = _blocks(counts)
        for at in range(0, len(used), 256):
            own = used[at:at + 256]
            empty = pa.nulls(len(own), pa.int64())
            yield pa.RecordBatch.from_arrays([empty, empty, empty, empty, empty, pa.array(own, pa.int32()),
                                              pa.array(blocks[at:at + 256], pa.binary())], names=names)

    return docs.select("doc_id", F.xxhash64("text").alias("text_key"), "text").mapInArrow(
        run, "doc_id bigint, text_key bigint, n_shingles bigint, cid bigint, proof bigint, block int, counts binary")


def _each_set(batches, k, seed, chosen):
    """Sets of rows whose ``doc_id`` may be a representative, each class once per task."""
    seen = set()
    for batch in _few(batches):
        rows = np.flatnonzero(is_member(batch.column(0).fill_null(-1), chosen))
        if not len(rows):
            continue
        for row, own in sets_of(batch.column(1).take(pa.array(rows)), k, seed):
            cid = class_key(own)[0]
            if cid not in seen:
                seen.add(cid)
                yield cid, own


def _batches(rows, names, kinds, size=2000, most=4 << 20):
    """Rows of columns as Arrow batches of bounded length and bytes."""
    held, weight = [], 0
    for row in rows:
        held.append(row)
        weight += sum(len(v) for v in row if isinstance(v, bytes))
        if len(held) >= size or weight > most:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), kinds)], names=names)
            held, weight = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), kinds)], names=names)


def _beginnings(docs, k, seed, chosen, levels) -> DataFrame:
    """``(token, cid)`` of the beginning of every set."""
    def run(batches):
        tokens, cids, held = [], [], 0
        for cid, own in _each_set(batches, k, seed, chosen.value):
            begin = in_order(own, levels.value)[:prefix_length(len(own))]
            tokens.append(begin)
            cids.append(np.full(len(begin), cid, np.int64))
            held += len(begin)
            if held > 100_000:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(tokens).view(np.int64)), pa.array(np.concatenate(cids))], names=["token", "cid"])
                tokens, cids, held = [], [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(tokens).view(np.int64)), pa.array(np.concatenate(cids))], names=["token", "cid"])

    return docs.mapInArrow(run, "token bigint, cid bigint")


def profile(own):
    """Numbers of hashes per bucket, at most 255."""
    return np.minimum(np.bincount((own >> np.uint64(56)).astype(np.int64), minlength=_PROFILE), 255).astype(np.uint8)


def bit_profile(own):
    """The buckets of a set as 64-bit words."""
    bits = np.zeros(64 * _WORDS, np.uint8)
    bits[(own >> np.uint64(64 - 9)).astype(np.int64)] = 1
    return np.packbits(bits, bitorder="little").view("<i8").tolist()


def _candidates(docs, k, seed, chosen, levels, shared) -> DataFrame:
    """Sets whose beginning holds a shingle that may be shared: where, and the set's profiles."""
    names = ["cid", "n", "profile", "bits", "tokens", "places"]

    def run(batches):
        held, weight = [], 0

        def batch():
            cids, sizes, profiles, bits, tokens, places = zip(*held)
            bounds = pa.array(np.concatenate([[0], np.cumsum([len(t) for t in tokens])]).astype(np.int32))
            return pa.RecordBatch.from_arrays([
                pa.array(cids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(profiles, pa.binary()), pa.array(bits, pa.list_(pa.int64())),
                pa.ListArray.from_arrays(bounds, pa.array(np.concatenate(tokens))), pa.ListArray.from_arrays(bounds, pa.array(np.concatenate(places)))], names=names)

        for cid, own in _each_set(batches, k, seed, chosen.value):
            own = in_order(own, levels.value)
            begin = own[:prefix_length(len(own))].view(np.int64)
            at = np.flatnonzero(is_member(begin, shared.value))
            if len(at):
                held.append((cid, len(own), profile(own).tobytes(), bit_profile(own), begin[at], at.astype(np.int32)))
                weight += 400 + 12 * len(at)
                if weight > 4 << 20:
                    yield batch()
                    held, weight = [], 0
        if held:
            yield batch()

    return docs.mapInArrow(run, "cid bigint, n bigint, profile binary, bits array<bigint>, tokens array<bigint>, places array<int>")


def _sets(docs, k, seed, chosen, levels) -> DataFrame:
    """``(cid, tokens)`` of the sets of chosen rows, in global order."""
    def run(batches):
        rows = ((cid, in_order(own, levels.value).astype("<u8").tobytes()) for cid, own in _each_set(batches, k, seed, chosen.value))
        yield from _batches(rows, ["cid", "tokens"], [pa.int64(), pa.binary()])

    return docs.mapInArrow(run, "cid bigint, tokens binary")


def possible(pairs: DataFrame, profiles: DataFrame) -> DataFrame:
    """The ``pairs`` whose profiles leave room for the overlap they need.

    A bucket shares no more hashes than the smaller of its two numbers, so the sum of these
    bounds the overlap; a number at its limit bounds nothing.
    """
    side = lambda m: profiles.select(*[F.col(c).alias(f"{m}{c}") for c in ("cid", "n", "profile")])
    wide = pairs.join(side("a_"), F.col("a") == F.col("a_cid")).join(side("b_"), F.col("b") == F.col("b_cid"))

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            one, two = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint8).reshape(-1, _PROFILE) for i in (4, 5))
            least = np.minimum(one, two)
            room = np.where((least == 255).any(axis=1), np.iinfo(np.int64).max, least.sum(axis=1, dtype=np.int64))
            need = least_overlap(np.asarray(batch.column(2)), np.asarray(batch.column(3)))
            yield batch.select(["a", "b"]).filter(pa.array(room >= need))

    return wide.select("a", "b", "a_n", "b_n", "a_profile", "b_profile").mapInArrow(run, "a bigint, b bigint").distinct()


# --- the prefix tree ------------------------------------------------------------------

class PrefixTree:
    """Sets in global order, frequent shingles first, as paths of a compressed trie."""

    def __init__(self, sets):
        keys = [s[::-1].astype(">u8").tobytes() for s in sets]
        self.order = sorted(range(len(sets)), key=keys.__getitem__)
        self.paths = [sets[i][::-1] for i in self.order]
        self.sizes = np.array([len(p) for p in self.paths])
        self.common = np.zeros(len(sets), np.int64)         # with the path before
        for i in range(1, len(sets)):
            a, b = self.paths[i - 1], self.paths[i]
            m = min(len(a), len(b))
            differ = np.flatnonzero(a[:m] != b[:m])
            self.common[i] = differ[0] if len(differ) else m

    def linked(self, probe):
        """``(index, overlap)`` of all stored sets that link with ``probe`` (hashes in any order)."""
        probe, n = np.sort(probe), len(probe)
        out, todo = [], [(0, len(self.paths), 0, 0)]
        while todo:
            low, high, depth, overlap = todo.pop()
            end = int(self.sizes[low]) if high - low == 1 else int(self.common[low + 1:high].min())
            edge = self.paths[low][depth:end]
            if len(edge):
                at = np.minimum(np.searchsorted(probe, edge), n - 1)
                overlap += int(np.count_nonzero(probe[at] == edge))
            sizes = self.sizes[low:high]
            # What can still be shared is bounded by what is left of the longest path and of the probe.
            if overlap + min(int(sizes.max()) - end, n - overlap) < least_overlap(n, int(sizes.min())):
                continue
            if high - low == 1:
                if overlap >= least_overlap(n, end):
                    out.append((self.order[low], overlap))
                continue
            cuts = [low, *(low + 1 + np.flatnonzero(self.common[low + 1:high] == end)).tolist(), high]
            todo += [(a, b, end, overlap) for a, b in zip(cuts, cuts[1:])]
        return out


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The ``pairs`` (``a`` the probe, ``b`` the candidate) that link, with their overlap.

    Candidates of a probe are dealt out in groups of about ``TREE``; the probe goes to each
    of its groups, and each task builds one tree per group as its rows stream by.
    """
    sizes = pairs.groupBy("a").agg(F.count("*").alias("m")).withColumn("groups", F.ceil(F.col("m") / TREE).cast("int"))
    dealt = pairs.join(sizes, "a").withColumn("part", F.pmod(F.xxhash64("b"), F.col("groups")).cast("int"))
    probes = sizes.select("a", F.explode(F.sequence(F.lit(0), F.col("groups") - 1)).alias("part"))
    slim = sets.select("cid", "tokens")
    rows = probes.join(slim, F.col("a") == F.col("cid")).select("a", "part", F.lit(None).cast("bigint").alias("b"), "tokens").unionByName(
        dealt.join(slim, F.col("b") == F.col("cid")).select("a", "part", "b", "tokens"))
    ordered = rows.repartition("a", "part").sortWithinPartitions("a", "part", F.col("b").asc_nulls_first())

    def links(batches):
        group, probe, held, weight = None, None, [], 0

        def flush():
            if held and probe is not None:
                for i, overlap in PrefixTree([s for _, s in held]).linked(probe):
                    yield group[0], held[i][0], overlap

        for batch in (whole.slice(at, 256) for whole in batches for at in range(0, whole.num_rows, 256)):
            for a, part, b, tokens in zip(*(c.to_pylist() for c in batch.columns)):
                own = np.frombuffer(tokens, "<u8")
                if (a, part) != group:
                    yield from flush()
                    group, probe, held, weight = (a, part), None, [], 0
                if b is None:
                    probe = own
                else:
                    held.append((b, own))
                    weight += own.nbytes
                    if len(held) >= 4 * TREE or weight > TREE_BYTES:
                        yield from flush()
                        held, weight = [], 0
        yield from flush()

    def run(batches):
        yield from _batches(links(batches), ["a", "b", "overlap"], [pa.int64()] * 3)

    return ordered.mapInArrow(run, "a bigint, b bigint, overlap bigint")


# --- the join -------------------------------------------------------------------------

def _classes(docs, k):
    """The scan's tables, under a hash seed for which no two different sets share a class id."""
    for seed in range(71, 79):
        scanned = cut_lineage(_scan(docs, k, seed))
        documents = scanned.filter("block is null").select("doc_id", "text_key", "n_shingles", "cid", "proof")
        classes = documents.filter("n_shingles > 0").groupBy("cid").agg(
            F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n"), (F.min("proof") != F.max("proof")).alias("mixed"))
        classes = cut_lineage(classes)
        if not classes.filter("mixed").limit(1).count():
            return seed, documents, classes, scanned.filter("block is not null").select("block", "counts")
    raise RuntimeError("class ids collide under every seed")


_BITWORDS = [f"b{i}" for i in range(_WORDS)]


def _placed(shared: DataFrame, roots) -> DataFrame:
    """Shared shingles of sets with their components, where a shingle has several components."""
    placed = shared.withColumn("root", F.col("cid")) if roots is None else shared.drop("root").join(
        roots, F.col("cid") == F.col("node"), "left").select(*shared.columns[:4], F.coalesce("root", "cid").alias("root"))
    mixed = placed.groupBy("token").agg(F.min("root").alias("x"), F.max("root").alias("y")).filter("x <> y").select("token")
    return placed.join(mixed, "token").select("cid", "n", "token", "pos", "root")


_NEED = f"({NUM} * (n + n_r) + {NUM + DEN - 1}) div {NUM + DEN}"


def _near_in_size():
    return (F.col("root") != F.col("root_r")) & (DEN * F.least("n", "n_r") >= NUM * F.greatest("n", "n_r"))


def _alike():
    """Bit profiles that differ no more than those of linked sets can."""
    need = F.expr(_NEED)
    alone = lambda x, y: F.expr(" + ".join(f"bit_count(b{i}{x} & ~b{i}{y})" for i in range(_WORDS)))
    return (alone("", "_r") <= F.col("n") - need) & (alone("_r", "") <= F.col("n_r") - need)


def _pivots(placed: DataFrame, bits: DataFrame, salt: int) -> DataFrame:
    """Each set beside the pivot of each of its shared shingles, where they may link.

    Bit profiles join each distinct pair, not each shingle of a set.
    """
    own = F.struct(F.col("cid").alias("cid_r"), F.col("n").alias("n_r"), F.col("root").alias("root_r"))
    groups = placed.groupBy("token").agg(F.min_by(own, F.xxhash64("cid", "token", F.lit(salt))).alias("p")).select("token", "p.*")
    pairs = placed.join(groups, "token").filter(_near_in_size()).select("cid", "n", "cid_r", "n_r").distinct()
    other = bits.select(F.col("cid").alias("cid_r"), *[F.col(b).alias(f"{b}_r") for b in _BITWORDS])
    return pairs.join(bits, "cid").join(other, "cid_r").filter(_alike()).select(F.col("cid_r").alias("a"), F.col("cid").alias("b"))


def _across(placed: DataFrame, bits: DataFrame) -> DataFrame:
    """All candidate pairs of different components: a shared shingle within both beginnings
    that the pair's sizes ask for, and positions that leave room for the needed overlap."""
    left = placed.join(bits, "cid")
    right = left.select("token", *[F.col(c).alias(f"{c}_r") for c in ["cid", "n", "root", "pos", *_BITWORDS]])
    need = F.expr(_NEED)
    return left.join(right, "token").filter(
        (F.col("root") < F.col("root_r")) & (F.col("pos") <= F.col("n") - need) & (F.col("pos_r") <= F.col("n_r") - need)
        & (F.least("pos", "pos_r") + F.least(F.col("n") - F.col("pos"), F.col("n_r") - F.col("pos_r")) >= need) & _near_in_size() & _alike()
    ).select(F.col("cid").alias("a"), F.col("cid_r").alias("b")).distinct()


def jaccard_groups(docs: DataFrame, k=SHINGLE) -> DataFrame:
    """``doc_id``, ``n_shingles`` and ``component_id`` of every document."""
    return jaccard_rows(docs, k).select("doc_id", "n_shingles", "component_id")


def jaccard_rows(docs: DataFrame, k=SHINGLE) -> DataFrame:
    """As :func:`jaccard_groups`, with ``text_key`` (the xxhash64 of the text) and ``root``, the component's class,
    null for documents without words; rows of one ``doc_id`` or of none stay apart by them.

    Every pass over the texts runs here, in small batches; what is returned only joins stored tables.
    """
    with small_batches(docs.sparkSession):
        return _rows(docs, k)


def _rows(docs, k):
    context = docs.sparkSession.sparkContext
    slim = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    seed, documents, classes, counters = _classes(slim, k)
    counts = _table(_sum_blocks(counters), _COUNTERS)
    levels = context.broadcast((np.log2(1.0 + counts) * 16384).astype(np.uint32))
    chosen = context.broadcast(membership(classes.select("rep"), classes.count()))
    tokens = cut_lineage(_beginnings(slim, k, seed, chosen, levels).groupBy("token").agg(
        F.min("cid").alias("x"), F.max("cid").alias("y")).filter("x <> y").select("token"))
    shared_bits = context.broadcast(membership(tokens, tokens.count()))
    candidates = cut_lineage(_candidates(slim, k, seed, chosen, levels, shared_bits))
    shared_bits.destroy()
    chosen.destroy()
    bits = candidates.select("cid", *[F.col("bits")[i].alias(b) for i, b in enumerate(_BITWORDS)])
    hits = candidates.select("cid", "n", F.inline(F.arrays_zip("tokens", "places"))).select("cid", "n", F.col("tokens").alias("token"), F.col("places").alias("pos"))
    placed = cut_lineage(hits.join(tokens, "token").select("cid", "n", "token", "pos", F.col("cid").alias("root")))
    discard(tokens)

    def links(pairs):
        """Candidate pairs that link: by profiles, then by the sets of what is left."""
        left = cut_lineage(possible(pairs, candidates))
        ids = cut_lineage(classes.join(left.select(F.explode(F.array("a", "b")).alias("cid")).distinct(), "cid").select("rep"))
        wanted = context.broadcast(membership(ids, ids.count()))
        sets = cut_lineage(_sets(slim, k, seed, wanted, levels))
        found = cut_lineage(verified(left, sets).select("a", "b"))
        wanted.destroy()
        discard(left, ids, sets)
        return found

    parts, roots = [], None
    for number in range(PIVOT_ROUNDS + 1):
        if roots is not None:
            # A shingle whose sets are in one component has nothing left to say in later rounds.
            old, placed = placed, cut_lineage(_placed(placed, roots))
            discard(old)
        parts.append(links(_pivots(placed, bits, number) if number < PIVOT_ROUNDS else _across(placed, bits)))
        found = parts[0]
        for more in parts[1:]:
            found = found.unionByName(more)
        roots = components(found)
    levels.destroy()
    discard(candidates, placed, *parts)
    placed = classes.join(roots, F.col("cid") == F.col("node"), "left").select("cid", "rep", F.coalesce("root", "cid").alias("root"))
    smallest = placed.groupBy("root").agg(F.min("rep").alias("component_id"))
    of_class = placed.join(smallest, "root").select("cid", "root", "component_id")
    full = documents.filter("n_shingles > 0").join(of_class, "cid").select("doc_id", "text_key", "n_shingles", "root", "component_id")
    return full.unionByName(documents.filter("n_shingles = 0").select(
        "doc_id", "text_key", "n_shingles", F.lit(None).cast("bigint").alias("root"), F.col("doc_id").alias("component_id")))
