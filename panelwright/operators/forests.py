"""Random forests of deep trees.

Rows carry bin numbers, and a bootstrap deals them to the trees. A table of up to ``TASK_BYTES`` of bin numbers is
packed and given whole to each of a few tasks, which draw the bootstrap of their trees themselves and grow them one
after another, so no row is copied for every tree. Of a larger table, nodes of more than
``NODE_ROWS`` rows have their bins counted by one aggregate a level, see :mod:`panelwright.operators.trees`;
every smaller node is one group of a shuffle by (tree, node), whose subtree is grown from that
group's rows. Both ways give the same trees.

A forest is a table of pieces: a split of a large node, or the subtree of a smaller one. Scoring gives every task
chunks of distinct bin rows and the pieces of some trees; no task and not the driver holds a forest.
Shares are whole multiples of ``2 ** -40``, so their sums do not depend on the order.
"""

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelwright.operators.trees import POISSON, impurity
from panelwright.session import cut_lineage, discard

#: Rows of a node that one task grows further.
NODE_ROWS = 100_000
#: Cuts of a numeric feature; a bin number fits a byte.
BINS = 32
#: Bin numbers, and rows, of a table that one task takes whole.
TASK_BYTES, TASK_ROWS = 96 << 20, 1 << 22
#: Bytes of packed pieces, and rows, that one task scores; rows of one chunk, and rows that walk down a tree together.
PIECE_BYTES = 32 << 20
SCORE_ROWS = 500_000
CHUNK_ROWS = 4096
WALK_ROWS = 16_384
#: Groups a scoring run is cut into at least.
LEAST_GROUPS = 24
_ONE = 1 << 40
_LEAST_GAIN = 1e-9
#: Rows are counted in the low bits of a float, events above them; both sums are exact.
_EVENTS = float(1 << 26)
_PIECE = "tree int, node bigint, top boolean, nodes binary, gains array<double>"
_PIECE_ARROW = pa.schema([("tree", pa.int32()), ("node", pa.int64()), ("top", pa.bool_()), ("nodes", pa.binary()), ("gains", pa.list_(pa.float64()))])


def _parted(cells):
    """Rows and events of sums of both."""
    events = np.floor(cells * (1 / _EVENTS))
    return cells - events * _EVENTS, events


def _best_bins(own, codes, base, weight, counts, sums, bins):
    """Per node the gain and code of the best split by its own feature; rows come node by node."""
    nodes = len(own)
    key = codes.take(base + np.repeat(own, counts)) + np.repeat(np.arange(nodes) * bins, counts)
    cells = np.bincount(key, weight, nodes * bins)
    at = np.flatnonzero(cells)  # most bins of a small node are empty
    node = at // bins
    total, pos = _parted(sums)
    n_l, pos_l = _parted(np.cumsum(cells[at]) - (np.cumsum(sums) - sums)[node])
    n_r, pos_r = total[node] - n_l, pos[node] - pos_l
    both = n_r > 0
    left = pos_l * (n_l - pos_l) / n_l
    right = pos_r * (n_r - pos_r) / np.where(both, n_r, 1.0)
    won = np.where(both, (pos * (total - pos) / total)[node] - left - right, 0.0)
    most = np.maximum.reduceat(won, np.flatnonzero(np.diff(node, prepend=-1)))
    hit = np.flatnonzero(won == most[node])
    first = hit[np.flatnonzero(np.diff(node[hit], prepend=-1))]
    return most, at[first] - node[first] * bins


def _grown(codes, y, w, level, depth, draw, rng):
    """Arrays (feature, code, left child, share) of the nodes of a subtree, level by level, and its gains by feature.

    A feature of -1 marks a leaf; the right child follows the left one. Rows are kept in the order of their
    nodes, so each level reads and counts them in one pass; those of a node without both outcomes are left behind.
    """
    n_features = codes.shape[1]
    codes, weight = np.ascontiguousarray(codes), w + w * y * _EVENTS
    counts = np.array([len(y)])
    nodes, first, gains, parts = 1, 0, np.zeros(n_features), []
    every = np.arange(n_features)
    bins = int(codes.max()) + 1

    def keep(chosen):
        """Leave the rows of other nodes behind."""
        nonlocal codes, weight, counts
        if not chosen.all():
            rows = np.flatnonzero(np.repeat(chosen, counts))
            codes, weight, counts = codes.take(rows, axis=0), weight.take(rows), counts[chosen]

    while True:
        sums = np.add.reduceat(weight, np.cumsum(counts) - counts)
        total, pos = _parted(sums)
        gain, feature, code = np.zeros(nodes), np.full(nodes, -1), np.zeros(nodes, np.int64)
        if level < depth:
            drawn = rng.random((nodes, n_features)) if draw < n_features else None
            mixed = (pos > 0) & (pos < total)
            asked = np.flatnonzero(mixed)
            if len(asked):
                keep(mixed)
                drawn = np.tile(every, (len(asked), 1)) if drawn is None else np.argpartition(drawn[asked], draw - 1, axis=1)[:, :draw]
                base, flat = np.arange(len(codes)) * n_features, codes.ravel()
                for own in drawn.T:
                    most, best = _best_bins(own, flat, base, weight, counts, sums[asked], bins)
                    better = most > gain[asked]
                    to = asked[better]
                    gain[to], feature[to], code[to] = most[better], own[better], best[better]
        split = gain > _LEAST_GAIN
        parts.append((np.where(split, feature, -1), code, np.where(split, first + nodes + 2 * (np.cumsum(split) - 1), -1), pos / total))
        if not split.any():
            break
        np.add.at(gains, feature[split], gain[split])
        keep(split[asked])
        right = codes.ravel().take(np.arange(len(codes)) * n_features + np.repeat(feature[split], counts)) > np.repeat(code[split], counts)
        start = np.cumsum(counts) - counts
        many = np.add.reduceat(right, start, dtype=np.int64)
        before = np.cumsum(right) - right  # rows that go right among all before
        before -= np.repeat(before[start], counts)
        place = np.arange(len(codes))
        place = np.where(right, np.repeat(start + counts - many, counts) + before, place - before)
        order = np.empty(len(codes), np.int64)
        order[place] = np.arange(len(codes))
        codes, weight = codes.take(order, axis=0), weight.take(order)
        counts = np.stack([counts - many, many], axis=1).ravel()
        first, nodes, level = first + nodes, 2 * int(split.sum()), level + 1
    return [np.concatenate(x) for x in zip(*parts)], gains


_M64 = (1 << 64) - 1
_P1, _P2, _P3, _P4, _P5 = 0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5


def _hash64(value, seed, wide):
    """``xxhash64`` of long (``wide``) or int values in a chain that begins with a seed of 42; arrays of unsigned longs."""
    u = np.uint64
    turned = lambda x, n: (x << u(n)) | (x >> u(64 - n))
    value = np.atleast_1d(np.asarray(value, np.int64)).view(u)
    if wide:
        h = (seed + u((_P5 + 8) & _M64)) ^ (turned(value * u(_P2), 31) * u(_P1))
        h = turned(h, 27) * u(_P1) + u(_P4)
    else:
        h = (seed + u((_P5 + 4) & _M64)) ^ ((value & u(0xFFFFFFFF)) * u(_P1))
        h = turned(h, 23) * u(_P2) + u(_P3)
    h = (h ^ (h >> u(33))) * u(_P2)
    h = (h ^ (h >> u(29))) * u(_P3)
    return h ^ (h >> u(32))


def _hashes(seed, *columns):
    """The hash of (value, is a long) columns and of ``seed``, as :func:`bootstrap` and :func:`_split_large` take it."""
    h = np.array([42], np.uint64)
    for value, wide in (*columns, (seed, not -(1 << 31) <= seed < 1 << 31)):
        h = _hash64(value, h, wide)
    return h


def _bootstrap(row, tree, seed):
    """:func:`bootstrap` of an array of row numbers."""
    u = (_hashes(seed, (row, True), (tree, False)) >> np.uint64(11)).astype(float) / float(1 << 53)
    return sum((u > p).astype(np.int8) for p in POISSON)


def _half_gini(n, pos):
    return pos * (n - pos) / n


def _large_split(codes, y, w, tree, node, draw, seed):
    """(place, code, gain) of one node, or None, as :func:`_split_large` finds it."""
    n_features = codes.shape[1]
    h = _hashes(seed, (tree, False), (node, True), (np.arange(n_features), False)).view(np.int64)
    n, pos, found = w.sum(), (w * y).sum(), None
    for place in sorted(np.argsort(h, kind="stable")[:draw].tolist()):
        held, held_pos = np.bincount(codes[:, place], w), np.bincount(codes[:, place], w * y)
        n_l, pos_l = np.cumsum(held), np.cumsum(held_pos)
        at = np.flatnonzero((held > 0) & (n_l < n))
        if len(at):
            gain = _half_gini(n, pos) - _half_gini(n_l[at], pos_l[at]) - _half_gini(n - n_l[at], pos - pos_l[at])
            best = int(gain.argmax())
            if gain[best] > _LEAST_GAIN and (found is None or gain[best] > found[2]):
                found = place, int(at[best]), float(gain[best])
    return found


def _whole_tree(codes, y, w, tree, depth, draw, seed, large):
    """The pieces of one tree, as tuples (tree, node, top, nodes, gains); nodes above ``large`` rows are split one by one."""
    n_features = codes.shape[1]
    waiting = [(1, codes, y, w)] if len(y) else []
    while waiting:
        node, codes, y, w = waiting.pop()
        level = node.bit_length() - 1
        if len(y) <= large or level >= depth:
            nodes, gains = _grown(codes, y, w, level, depth, draw, np.random.default_rng([abs(seed), tree, node]))
            yield tree, node, False, _packed(*nodes)[0], gains.tolist()
            continue
        found, gains = _large_split(codes, y, w, tree, node, draw, seed), [0.0] * n_features
        place, code, gain = found or (-1, 0, 0.0)
        nodes = _packed([place], [code], [-1], [(w * y).sum() / w.sum()])[0]
        if found:
            gains[place] = gain
            right = codes[:, place] > code
            waiting += [(2 * node + side, codes[rows], y[rows], w[rows]) for side, rows in ((0, ~right), (1, right))]
        yield tree, node, found is not None, nodes, gains


def _matrix(column, width):
    """Lists of bin numbers as rows of a matrix."""
    return np.asarray(column.combine_chunks().flatten() if isinstance(column, pa.ChunkedArray) else column.flatten()).reshape(len(column), width)


def _bytes(values, kind):
    """Whole numbers as compressed bytes, the lowest of each first."""
    return zlib.compress(np.ascontiguousarray(np.asarray(values, kind).view(np.uint8).reshape(len(values), np.dtype(kind).itemsize).T).tobytes(), 1)


def _numbers(data, kind):
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(zlib.decompress(data), np.uint8).reshape(size, -1).T).view(kind).ravel()


def _packed(feature, code, child, share):
    """One value of all nodes: which are leaves, the others' features and codes, the leaves' shares; children follow from the order.

    A split of a large node keeps its share and has its children in other pieces.
    """
    feature, share = np.asarray(feature), np.rint(np.asarray(share, float) * _ONE)
    split = feature >= 0
    top = bool(split.any() and np.asarray(child)[split][0] < 0)
    parts = (zlib.compress(np.packbits(split).tobytes(), 1), _bytes(feature[split], "<i2"), _bytes(np.asarray(code)[split], "<i2"),
             b"" if top else _bytes(share[~split], "<i8"))
    return (np.array([len(split), *map(len, parts)], "<i4").tobytes() + b"".join(parts),)


def _unpacked(nodes):
    """(feature, code, child, share) of :func:`_packed`."""
    count, *sizes = np.frombuffer(nodes, "<i4", 5).tolist()
    ends = np.cumsum([20, *sizes]).tolist()
    mask, features, codes, shares = (nodes[a:b] for a, b in zip(ends, ends[1:]))
    split = np.unpackbits(np.frombuffer(zlib.decompress(mask), np.uint8), count=count).astype(bool)
    feature, code, child, share = np.full(count, -1, "<i2"), np.zeros(count, "<i2"), np.full(count, -1, "<i4"), np.zeros(count, "<i8")
    feature[split], code[split], child[split] = _numbers(features, "<i2"), _numbers(codes, "<i2"), 1 + 2 * np.arange(int(split.sum()))
    if shares:
        share[~split] = _numbers(shares, "<i8")
    return feature, code, child, share


def _pieces_batch(tuples):
    return pa.RecordBatch.from_arrays([pa.array(list(x), f.type) for x, f in zip(zip(*tuples), _PIECE_ARROW)], schema=_PIECE_ARROW)


def _whole_trees(coded: DataFrame, n_features, trees, depth, draw, seed) -> DataFrame:
    """The pieces of all trees; every task packs up the whole table and grows the trees dealt to it."""
    deals, large = min(trees, 3 * coded.sparkSession.sparkContext.defaultParallelism), NODE_ROWS

    def pack(batches):
        for batch in batches:
            if batch.num_rows:
                row, y = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(2))
                codes = _matrix(batch.column(2), n_features).astype(np.int8)
                yield pa.RecordBatch.from_arrays([pa.array([v], pa.binary()) for v in (
                    _bytes(np.diff(row, prepend=0), "<i8"), _bytes(y, "<i8"), zlib.compress(codes.tobytes(), 1))], names=["row", "y", "codes"])

    def run(batches):
        held, mine = [[], [], []], set()
        for batch in batches:
            for deal, *values in zip(*(c.to_pylist() for c in batch.columns)):
                mine.add(deal)
                if deal == min(mine):
                    row, y, codes = values
                    for to, v in zip(held, (np.cumsum(_numbers(row, "<i8")), _numbers(y, "<i8").astype(np.int8), np.frombuffer(zlib.decompress(codes), np.int8).reshape(-1, n_features))):
                        to.append(v)
        if not mine:
            return
        row, y, codes = (np.concatenate(x) for x in held)
        held.clear()
        for deal in sorted(mine):
            for tree in range(deal + 1, trees + 1, deals):
                w = _bootstrap(row, tree, seed)
                bag = np.flatnonzero(w)
                if len(bag):
                    yield _pieces_batch(_whole_tree(codes[bag], y[bag].astype(float), w[bag].astype(float), tree, depth, draw, seed, large))

    packed = coded.select("row", "y", "codes").mapInArrow(pack, "row binary, y binary, codes binary")
    dealt = packed.select(F.explode(F.sequence(F.lit(0), F.lit(deals - 1))).alias("deal"), "*")
    return dealt.repartitionById(deals, "deal").mapInArrow(run, _PIECE)


def _subtrees(rows: DataFrame, n_features, depth, draw, seed) -> DataFrame:
    """One piece for each (tree, node) of ``rows``."""
    def grow(key, table):
        tree, node = (k.as_py() for k in key)
        y, w = (table[c].to_numpy().astype(float) for c in ("y", "w"))
        rng = np.random.default_rng([abs(seed), tree, node])
        nodes, gains = _grown(_matrix(table["codes"], n_features), y, w, node.bit_length() - 1, depth, draw, rng)
        return pa.Table.from_batches([_pieces_batch([(tree, node, False, _packed(*nodes)[0], gains.tolist())])])

    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.select("tree", "node", "y", "w", "codes").repartition(tasks, "tree", "node").groupBy("tree", "node").applyInArrow(grow, _PIECE)


def _split_large(rows: DataFrame, totals: DataFrame, n_features, draw, seed) -> DataFrame:
    """(tree, node, place, code, gain): the best split of each node of ``totals`` among the features drawn for it."""
    h = F.transform(F.sequence(F.lit(0), F.lit(n_features - 1)), lambda i: F.struct(F.xxhash64("tree", "node", i, F.lit(seed)).alias("h"), i.alias("i")))
    drawn = F.transform(F.slice(F.array_sort(h), 1, draw), lambda x: x["i"])
    asked = totals.select("tree", "node", F.col("n").alias("_n"), F.col("pos").alias("_pos"), drawn.alias("_drawn"))
    tall = rows.join(F.broadcast(asked.select("tree", "node", "_drawn")), ["tree", "node"]).select("tree", "node", "w", "y", "codes", F.explode("_drawn").alias("place"))
    counts = tall.groupBy("tree", "node", "place", F.col("codes")[F.col("place")].alias("code")).agg(
        F.sum("w").alias("n"), F.sum(F.col("w") * F.col("y")).alias("pos"))
    # A window holds the bins of one feature at one node.
    upto = Window.partitionBy("tree", "node", "place").orderBy("code").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    held = counts.select("tree", "node", "place", "code", F.sum("n").over(upto).alias("n_l"), F.sum("pos").over(upto).alias("pos_l")).join(asked, ["tree", "node"])
    n_r, pos_r = F.col("_n") - F.col("n_l"), F.col("_pos") - F.col("pos_l")
    gain = impurity(F.col("_n"), F.col("_pos")) - impurity(F.col("n_l"), F.col("pos_l")) - impurity(n_r, pos_r)
    first = Window.partitionBy("tree", "node").orderBy(F.desc("gain"), "place", "code")
    return held.filter(n_r > 0).withColumn("gain", gain).filter(F.col("gain") > _LEAST_GAIN).withColumn("_r", F.row_number().over(first)).filter("_r = 1").select(
        "tree", "node", "place", F.col("code").cast("int").alias("code"), "gain")


def _top_pieces(found: DataFrame, n_features) -> DataFrame:
    """Pieces of large nodes from (tree, node, place, code, gain, share); a place of -1 is a leaf."""

    def pack(batches):
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                gains = [0.0] * n_features
                if r["place"] >= 0:
                    gains[r["place"]] = r["gain"]
                out.append((r["tree"], r["node"], r["place"] >= 0, _packed([r["place"]], [r["code"]], [-1], [r["share"]])[0], gains))
            if out:
                yield _pieces_batch(out)

    return found.select("tree", "node", "place", "code", "gain", "share").mapInArrow(pack, _PIECE)


def bootstrap(row, tree, seed):
    """How often a tree draws a row: a Poisson count by the hash of its number."""
    u = F.shiftrightunsigned(F.xxhash64(row, tree, F.lit(seed)), 11).cast("double") / F.lit(float(1 << 53))
    return sum((u > p).cast("int") for p in POISSON)


def grow(coded: DataFrame, n_features: int, trees: int, depth: int, draw: int, seed: int) -> tuple[DataFrame, float]:
    """The pieces of a forest on (row, y, codes), and the share of events among all rows.

    ``draw`` features compete at a split. Row numbers drive the bootstrap, so ``coded`` is a stored table.
    """
    size, base = coded.agg(F.count("*"), F.avg("y")).first()
    if size <= min(TASK_ROWS, TASK_BYTES // n_features):
        return cut_lineage(_whole_trees(coded, n_features, trees, depth, draw, seed)), float(base)
    tree = F.explode(F.sequence(F.lit(1), F.lit(trees))).alias("tree")
    rows = coded.select("row", "y", "codes", tree).withColumn("w", bootstrap("row", F.col("tree"), seed)).filter("w > 0").select(
        "tree", F.lit(1).cast("bigint").alias("node"), "y", "w", "codes")
    pieces = []
    level, stored = 0, None
    while size > NODE_ROWS and level < depth:
        if stored is None:
            rows = stored = cut_lineage(rows)
        totals = cut_lineage(rows.groupBy("tree", "node").agg(F.count("*").alias("rows"), F.sum("w").alias("n"), F.sum(F.col("w") * F.col("y")).alias("pos")))
        large = totals.filter(F.col("rows") > NODE_ROWS)
        small = totals.filter(F.col("rows") <= NODE_ROWS).select("tree", "node")
        pieces.append(cut_lineage(_subtrees(rows.join(F.broadcast(small), ["tree", "node"], "left_semi"), n_features, depth, draw, seed)))
        best = cut_lineage(_split_large(rows, large, n_features, draw, seed))
        tops = large.join(best, ["tree", "node"], "left").select(
            "tree", "node", F.coalesce("place", F.lit(-1)).alias("place"), F.coalesce("code", F.lit(0)).alias("code"),
            F.coalesce("gain", F.lit(0.0)).alias("gain"), (F.col("pos") / F.col("n")).alias("share"))
        pieces.append(cut_lineage(_top_pieces(tops, n_features)))
        size = totals.agg(F.max("rows")).first()[0] or 0
        right = (F.col("codes")[F.col("place")] > F.col("code")).cast("int")
        rows = cut_lineage(rows.join(F.broadcast(best.select("tree", "node", "place", "code")), ["tree", "node"]).select(
            "tree", (F.col("node") * 2 + right).alias("node"), "y", "w", "codes"))
        discard(stored, totals, best)
        stored, level = rows, level + 1
    pieces.append(cut_lineage(_subtrees(rows, n_features, depth, draw, seed)))
    if stored is not None:
        discard(stored)
    whole = pieces[0]
    for one in pieces[1:]:
        whole = whole.unionByName(one)
    return whole, float(base)


def _words(feature, code, child):
    """Each node as one number: the left child, the feature and the code; a leaf is its own child, whatever the row."""
    leaf = feature < 0
    return (np.where(leaf, np.arange(len(feature)), child).astype(np.int64) << 32) | (np.where(leaf, 0, feature).astype(np.int64) << 8) | np.where(leaf, 127, code)


def _ends(flat, starts, words):
    found, ids = np.zeros(len(starts), np.int64), np.arange(len(starts))
    at = found
    while True:
        word = words.take(at)
        to = (word >> 32) + (flat.take(starts + ((word >> 8) & 0xFFFFFF)) > (word & 255).astype(np.int8))
        going = to != at
        left = np.count_nonzero(going)
        if left < 0.75 * len(ids):
            found[ids] = to
            if not left:
                return found
            ids, to, starts = ids[going], to[going], starts[going]
        at = to


def _leaves(flat, starts, feature, code, child):
    """The leaf that each row of bin numbers, beginning at ``starts`` in ``flat``, ends in."""
    words = _words(feature, code, child)
    return np.concatenate([np.zeros(0, np.int64), *[_ends(flat, starts[a:a + WALK_ROWS], words) for a in range(0, len(starts), WALK_ROWS)]])


def _leaf_shares(codes, pieces, trees, base):
    """Sum over ``trees`` of the share of each row's leaf; ``pieces`` are tuples (tree, node, top, nodes) in order of (tree, node)."""
    total = np.zeros(len(codes), np.int64)
    codes = np.ascontiguousarray(codes, np.int8)
    flat, starts, every = codes.ravel(), np.arange(len(codes)) * codes.shape[1], np.arange(len(codes))
    waiting, tree = {}, None
    seen = 0
    for number, node, top, nodes in pieces:
        if number != tree:
            tree, waiting, seen = number, {1: every}, seen + 1
        rows = waiting.pop(node, None)
        if rows is None or not len(rows):
            continue
        feature, code, child, share = _unpacked(nodes)
        if top:
            right = codes[rows, feature[0]] > code[0]
            waiting[2 * node], waiting[2 * node + 1] = rows[~right], rows[right]
            continue
        if rows is every:
            total += share[_leaves(flat, starts, feature, code, child)]
        else:
            total[rows] += share[_leaves(flat, starts[rows], feature, code, child)]
    return total + (trees - seen) * base  # a tree that drew no row knows only the whole


@dataclass
class Forest:
    """Pieces of all trees, with what their scores need."""

    pieces: DataFrame
    trees: int
    n_features: int
    base: float

    def _chunks(self, kinds: DataFrame) -> DataFrame:
        """(chunk, codes): the rows of bin numbers, ``CHUNK_ROWS`` of them in one value. Stored."""
        width, most = self.n_features, CHUNK_ROWS

        def pack(batches):
            number, held, size = TaskContext.get().partitionId() << 32, [], 0

            def chunks(least):
                nonlocal number, size
                data, at = b"".join(held), 0
                held.clear()
                while size >= least:
                    part = data[at * width:(at + most) * width]
                    yield pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([part], pa.binary())], names=["chunk", "codes"])
                    number, at, size = number + 1, at + most, size - len(part) // width
                held.append(data[at * width:])

            for batch in batches:
                held.append(b"".join(batch.column(0).to_pylist()))
                size += batch.num_rows
                if size >= most:
                    yield from chunks(most)
            yield from chunks(1)

        return cut_lineage(kinds.mapInArrow(pack, "chunk bigint, codes binary"))

    def score(self, kinds: DataFrame) -> DataFrame:
        """(codes, p) of distinct rows of bin numbers, as binary values: the mean share over all trees. Stored."""
        spark, width, whole, base = kinds.sparkSession, self.n_features, float(_ONE * self.trees), int(round(self.base * _ONE))
        chunks = self._chunks(kinds)
        numbers = sorted(r["chunk"] for r in chunks.select("chunk").collect())
        held = self.pieces.agg(F.sum(F.length("nodes"))).first()[0] or 0
        deals = min(self.trees, max(1, -(-held // PIECE_BYTES)))
        blocks = max(1, min(len(numbers), max(-(-len(numbers) * CHUNK_ROWS // SCORE_ROWS), LEAST_GROUPS // deals)))
        sizes = [len(range(d, self.trees + 1, deals)) - (d == 0) for d in range(deals)]
        every = lambda n, name: F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias(name)
        dealt = spark.createDataFrame([(n, i * blocks // len(numbers)) for i, n in enumerate(numbers)], "chunk bigint, block int")
        group = (F.col("block") * deals + F.col("deal")).alias("group")
        none = lambda kind: F.lit(None).cast(kind)
        left = chunks.join(F.broadcast(dealt), "chunk").select("*", every(deals, "deal")).select(
            group, "chunk", none("int").alias("tree"), none("bigint").alias("node"), none("boolean").alias("top"), F.col("codes").alias("data"))
        right = self.pieces.select("tree", "node", "top", "nodes", (F.col("tree") % deals).alias("deal"), every(blocks, "block")).select(
            group, none("bigint").alias("chunk"), "tree", "node", "top", F.col("nodes").alias("data"))

        def run(batches):
            asked, pieces = {}, {}
            for batch in batches:
                for number, chunk, tree, node, top, data in zip(*(c.to_pylist() for c in batch.columns)):
                    if chunk is None:
                        pieces.setdefault(number, []).append((tree, node, top, data))
                    else:
                        asked.setdefault(number, []).append((chunk, data))
            for number, rows in asked.items():
                codes = np.frombuffer(b"".join(x for _, x in rows), np.int8).reshape(-1, width)
                sums = _leaf_shares(codes, sorted(pieces.get(number, []), key=lambda x: x[:2]), sizes[number % deals], base)
                at = 0
                for chunk, data in rows:
                    end = at + len(data) // width
                    yield pa.RecordBatch.from_arrays([pa.array([chunk], pa.int64()), pa.array([data], pa.binary()), pa.array([sums[at:end].tobytes()], pa.binary())],
                                                     names=["chunk", "codes", "sums"])
                    at = end

        def add(batches):
            """Chunks come in order, each as often as there are deals."""
            chunk = codes = sums = None

            def rows():
                ends = pa.array(np.arange(len(sums) + 1, dtype=np.int32) * width)
                one = pa.Array.from_buffers(pa.binary(), len(sums), [None, ends.buffers()[1], pa.py_buffer(codes)])
                return pa.RecordBatch.from_arrays([one, pa.array(sums / whole, pa.float64())], names=["codes", "p"])

            for batch in batches:
                for number, data, part in zip(*(c.to_pylist() for c in batch.columns)):
                    if number != chunk:
                        if chunk is not None:
                            yield rows()
                        chunk, codes, sums = number, data, np.zeros(len(data) // width, np.int64)
                    sums = sums + np.frombuffer(part, np.int64)
            if chunk is not None:
                yield rows()

        parts = left.unionByName(right).repartitionById(blocks * deals, "group").mapInArrow(run, "chunk bigint, codes binary, sums binary")
        if deals > 1:
            parts = parts.repartition("chunk").sortWithinPartitions("chunk")
        scores = cut_lineage(parts.mapInArrow(add, "codes binary, p double"))
        discard(chunks)
        return scores

    def importances(self) -> list:
        """Per feature: each tree's share of the gains, averaged over the trees and summing to 1."""
        per = self.pieces.select("tree", F.posexplode("gains").alias("i", "g")).groupBy("tree", "i").agg(F.sum("g").alias("g"))
        total = per.groupBy("tree").agg(F.sum("g").alias("total"))
        found = {r["i"]: r["s"] for r in per.join(total, "tree").filter("total > 0").groupBy("i").agg(F.sum(F.col("g") / F.col("total")).alias("s")).collect()}
        whole = sum(found.values()) or 1.0
        return [found.get(i, 0.0) / whole for i in range(self.n_features)]
