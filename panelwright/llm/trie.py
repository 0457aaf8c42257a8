"""Prefix trie of conversations from vertical bitmaps.

The turns of all conversations are put in one order of (conversation, position) and cut into
shards of bounded size. A shard's index maps (position, turn) to the set of conversations that
have the turn there, as a bitset. A depth-first walk intersects a node's bitset with the
postings of the next position: what is left is a child, its population count is the
child's conversations, and the conversations that end at a node are its end list. Shards'
nodes are then added up by the node's hash, which is a sum over its turns, so a conversation that is
cut between shards goes on from the sum of what came before.

Subtree sums (leaves, tokens saved) come by pointer doubling over shared nodes: in round k every
node passes its sum to its ancestor at distance 2**k. A node of one conversation has one leaf
below it and saves nothing, so such nodes take no part.

A hot conversation, first turn or group of copies is spread over shards and one row of each; the
end list of a node is hashed in one stream of its shards' lists, 512 ids a row, never held as a whole.
What the driver sees is two rows for each partition (what to add to a conversation that a partition
cuts). Turns and nodes are told apart by 128 bits of hash.

Edge cases: a null role or text is empty; a null turn comes first; turns of one number are
ordered by the md5 of their role's length, role and text (so repeated rows are turns of
their own); rows without a conv_id belong to no conversation; an empty table has no nodes; texts
are hashed and counted whole. A negative id's remainder is that of truncated division. Columns other
than conv_id, turn, role and text are not read.
"""

import hashlib

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelwright.session import cut_lineage, discard

#: Turns and conversations of a shard.
SHARD_TURNS = 1 << 15
SHARD_CONVERSATIONS = 4096
#: Conversation ids in one row of an end list.
LISTED = 512
#: Turns taken from the base conversation at most.
MOST_SHARED = 5
#: ``at`` of the row that ends a conversation.
END = MOST_SHARED + 2
_MASK = (1 << 64) - 1
_BASES = 0x9E3779B97F4A7C15 | 1, 0xD1342543DE82EF95 | 1
NODE = ("rel boolean, edge int, part int, depth bigint, a bigint, b bigint, pa bigint, pb bigint, cp bigint, "
        "n bigint, conv_id bigint, ends string")


def turns(conversations: DataFrame) -> DataFrame:
    """``conv_id``, ``turn``, two halves of the md5 of role and text, and the text's code points; no texts."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text))
    half = lambda at: F.conv(F.substring(digest, at, 16), 16, -10).cast("bigint")
    return conversations.filter(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("bigint").alias("conv_id"), "turn", half(1).alias("k1"), half(17).alias("k2"), F.length(text).cast("bigint").alias("cp"))


def whole(own: DataFrame) -> DataFrame:
    """Rows of :func:`prefix_trie` for conversations as they are."""
    return _rows(own.select("conv_id").distinct(), own.withColumn("at", F.lit(1)))


def rebuilt(own: DataFrame) -> DataFrame:
    """Rows for conversations that start with the first turns of their base conversation.

    Of conversation c - c % 100 the first h = crc32(c) % 6 turns come first (all if fewer, none
    if absent), then the own turns after the first h. The first turns are ranked by a window
    limit, which every task applies before the shuffle, and taken out as a difference of
    row multisets, so no window holds a whole conversation.
    """
    order = Window.partitionBy("conv_id").orderBy("turn", "k1", "k2")
    first = own.withColumn("at", F.row_number().over(order)).filter(F.col("at") <= MOST_SHARED)
    shared = lambda c: (F.crc32(F.col(c).cast("string").cast("binary")) % (MOST_SHARED + 1)).cast("int")
    marks = own.select("conv_id").distinct()
    based = first.filter(F.col("conv_id") % 100 == 0).withColumnRenamed("conv_id", "base")
    taken = marks.withColumn("base", F.col("conv_id") - F.col("conv_id") % 100).join(based, "base").filter(F.col("at") <= shared("conv_id"))
    rest = own.exceptAll(first.filter(F.col("at") <= shared("conv_id")).select(*own.columns))
    return _rows(marks, taken.select("conv_id", "at", "turn", "k1", "k2", "cp"),
                 rest.withColumn("at", F.lit(MOST_SHARED + 1)))


def _rows(marks, *parts):
    """For every conversation a first row ``at`` 0, its turns, ordered by ``at``, turn and hash, and a last row."""
    out = marks.select("conv_id", F.explode(F.array(F.lit(0), F.lit(END))).alias("at"),
                       *[F.lit(None).cast("bigint").alias(c) for c in ("turn", "k1", "k2", "cp")])
    for part in parts:
        out = out.unionByName(part.select("conv_id", "at", F.col("turn").cast("bigint").alias("turn"), "k1", "k2", "cp"))
    return out


class Shard:
    """Segments of conversations and the index of their turns."""

    def __init__(self, powers):
        self.powers = powers
        self.convs, self.starts, self.states, self.last = [], [], [], []
        self.sequences, self.points, self.postings, self.size = [], {}, {}, 0

    def open(self, conv, start, state):
        """A segment whose turns follow position ``start``, where the prefix hash is ``state``."""
        self.convs.append(conv)
        self.starts.append(start)
        self.states.append(state)
        self.sequences.append([])
        self.last.append(False)

    def add(self, turn, points):
        own = self.sequences[-1]
        own.append(turn)
        self.points[turn] = points
        self.postings.setdefault((self.starts[-1] + len(own), turn), []).append(len(self.convs) - 1)
        self.size += 1

    def walk(self, rel):
        """Rows of nodes: ``(rel, depth, hash, parent's hash, points, count, least id, end ids)``."""
        bits = {key: sum(1 << j for j in members) for key, members in self.postings.items()}
        over, roots = {}, {}
        for j, own in enumerate(self.sequences):
            place = self.starts[j] + len(own)
            over[place] = over.get(place, 0) | 1 << j
            roots[self.starts[j], self.states[j]] = roots.get((self.starts[j], self.states[j]), 0) | 1 << j
        stack = []
        for (depth, state), members in roots.items():
            # A root counts at depth 0 only: a cut conversation was counted there before.
            whole = depth == 0 and not rel
            ended = members & over.get(depth, 0)
            ids = self._ids(ended)
            if whole or ids:
                yield rel, depth, state, None, None, members.bit_count() if whole else 0, self.convs[_least(members)] if whole else None, ids
            stack.append((depth, state, members & ~ended))
        while stack:
            depth, state, members = stack.pop()
            while members:
                j = _least(members)
                turn = self.sequences[j][depth - self.starts[j]]
                child = members & bits[depth + 1, turn]
                members &= ~child
                below = self.powers.add(state, turn, depth + 1)
                ended = child & over.get(depth + 1, 0)
                yield rel, depth + 1, below, state, self.points[turn], child.bit_count(), self.convs[_least(child)], self._ids(ended)
                if child != ended:
                    stack.append((depth + 1, below, child & ~ended))

    def _ids(self, ended):
        ids = []
        while ended:
            j = _least(ended)
            if self.last[j]:
                ids.append(self.convs[j])
            ended &= ended - 1
        return ids


def _least(bits):
    return (bits & -bits).bit_length() - 1


class Powers:
    """Node hashes: two sums of a turn's halves times powers of odd numbers, modulo 2**64."""

    def __init__(self):
        self.kept = [(1, 1)]

    def at(self, depth):
        while len(self.kept) <= depth:
            if len(self.kept) > 1 << 16:
                return tuple(pow(base, depth, 1 << 64) for base in _BASES)
            self.kept.append(tuple(p * base & _MASK for p, base in zip(self.kept[-1], _BASES)))
        return self.kept[depth]

    def add(self, state, turn, depth):
        power = self.at(depth)
        return (state[0] + turn[0] * power[0]) & _MASK, (state[1] + turn[1] * power[1]) & _MASK

    def shifted(self, state, before, depth):
        """``state`` counted from 0, after ``before`` at ``depth``."""
        power = self.at(depth)
        return (before[0] + state[0] * power[0]) & _MASK, (before[1] + state[1] * power[1]) & _MASK


def _signed(x):
    return x - (1 << 64) if x >> 63 else x


def _batches(rows, most=4096):
    """Arrow batches of node rows; long end lists go to further rows that count nothing."""
    made = []

    def batch():
        columns = list(zip(*made))
        made.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _TYPES)], names=_NAMES)

    for rel, edge, part, depth, state, parent, cp, n, conv, ids in rows:
        key = depth, *map(_signed, state), *(map(_signed, parent) if parent is not None else (None, None)), cp
        chunks = [ids[i:i + LISTED] for i in range(0, len(ids), LISTED)] or [None]
        for i, chunk in enumerate(chunks):
            made.append((rel, edge, part, *key, 0 if i else n, chunk[0] if conv is None or i else conv,
                         None if chunk is None else ",".join(map(str, chunk))))
            if len(made) >= most:
                yield batch()
    if made:
        yield batch()


_NAMES = [f.split(" ")[0] for f in NODE.split(", ")]
_TYPES = [{"boolean": pa.bool_(), "int": pa.int32(), "bigint": pa.int64(), "string": pa.string()}[f.split(" ")[1]] for f in NODE.split(", ")]


def partial_nodes(rows: DataFrame, shard_turns=SHARD_TURNS, shard_conversations=SHARD_CONVERSATIONS) -> DataFrame:
    """A written table of every shard's nodes.

    A partition may begin within a conversation, whose nodes are then counted from there (``rel``).
    Rows with an ``edge`` say how far a partition's first (0) and last (1) conversation goes in it.
    """

    def rows_of(batches):
        powers, edges = Powers(), []
        conv, rel, position, state, shard = None, False, 0, (0, 0), Shard(powers)
        for batch in batches:
            for c, at, k1, k2, cp in zip(*(column.to_pylist() for column in batch.columns)):
                full = shard.size >= shard_turns
                if c != conv:
                    if conv is not None:
                        edges = edges or [(conv, rel, position, state)]
                        if rel or full or len(shard.convs) >= shard_conversations:
                            yield from shard.walk(rel)
                            shard = Shard(powers)
                    conv, rel, position, state = c, at != 0, 0, (0, 0)
                    shard.open(c, 0, state)
                elif full:
                    yield from shard.walk(rel)
                    shard = Shard(powers)
                    shard.open(c, position, state)
                if at == END:
                    shard.last[-1] = True
                elif at:
                    turn = k1 & _MASK, k2 & _MASK
                    shard.add(turn, cp)
                    position += 1
                    state = powers.add(state, turn, position)
        if conv is not None:
            yield from shard.walk(rel)
            last = conv, rel, position, state
            yield from ((i, *edge) for i, edge in enumerate((edges[0] if edges else last, last)))

    def run(batches):
        part = TaskContext.get().partitionId()

        def shaped():
            for row in rows_of(batches):
                if len(row) == 5:
                    i, c, rel, position, state = row
                    yield rel, i, part, position, state, None, None, 0, c, []
                else:
                    yield row[0], None, part, *row[1:]

        yield from _batches(shaped())

    order = ["conv_id", "at", "turn", "k1", "k2"]
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    return cut_lineage(dealt.select("conv_id", "at", "k1", "k2", "cp").mapInArrow(run, NODE))


def _before(partial: DataFrame) -> dict:
    """By partition that begins within a conversation: the depth and hash its first conversation has there."""
    edges = {}
    for r in partial.filter(F.col("edge").isNotNull()).select("part", "edge", "conv_id", "rel", "depth", "a", "b").collect():
        edges[r["part"], r["edge"]] = r["conv_id"], r["rel"], r["depth"], (r["a"] & _MASK, r["b"] & _MASK)
    before, powers, now = {}, Powers(), None
    for part in sorted({p for p, _ in edges}):
        (first, cut, _, _), (last, _, depth, state) = edges[part, 0], edges[part, 1]
        if cut:
            before[part] = now
        if cut and first == last:
            now = now[0] + depth, powers.shifted(state, now[1], now[0])
        else:
            now = depth, state
    return before


def _from_the_root(partial: DataFrame) -> DataFrame:
    """Node rows, all counted from the root."""
    before = _before(partial)

    def run(batches):
        powers = Powers()
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                depth, state = before[r["part"]]
                shift = lambda a, b: map(_signed, powers.shifted((a & _MASK, b & _MASK), state, depth))
                r["a"], r["b"] = shift(r["a"], r["b"])
                if r["pa"] is not None:
                    r["pa"], r["pb"] = shift(r["pa"], r["pb"])
                r["depth"] += depth
                rows.append(r)
            yield pa.RecordBatch.from_pylist(rows, schema=batch.schema)

    found = partial.filter(F.col("edge").isNull())
    return found.filter(~F.col("rel")).unionByName(found.filter(F.col("rel")).mapInArrow(run, found.schema))


def _subtrees(nodes: DataFrame, children: DataFrame) -> DataFrame:
    """``n_leaves`` and ``saved_tokens`` below every node that several conversations share, and below the root."""
    shared = nodes.filter((F.col("n") > 1) | (F.col("depth") == 0)).join(children, ["a", "b"], "left")
    state = cut_lineage(shared.select(
        "a", "b", "depth", F.col("pa").alias("qa"), F.col("pb").alias("qb"),
        F.coalesce("singles", F.lit(1)).alias("n_leaves"), ((F.col("n") - 1) * F.coalesce("cp", F.lit(0))).alias("saved_tokens")))
    deepest, distance = state.agg(F.max("depth")).first()[0] or 0, 1
    while distance <= deepest:
        passed = state.filter(F.col("qa").isNotNull()).groupBy(F.col("qa").alias("a"), F.col("qb").alias("b")).agg(
            F.sum("n_leaves").alias("_leaves"), F.sum("saved_tokens").alias("_saved"))
        # Only pointers that stay below the root are looked up.
        far = F.col("depth") >= 2 * distance
        farther = state.filter(far).join(state.select(F.col("a").alias("qa"), F.col("b").alias("qb"), F.col("qa").alias("ra"), F.col("qb").alias("rb")),
                                         ["qa", "qb"]).drop("qa", "qb").withColumnsRenamed({"ra": "qa", "rb": "qb"})
        ended = state.filter(~far).withColumns({c: F.lit(None).cast("bigint") for c in ("qa", "qb")})
        moved = farther.unionByName(ended).join(passed, ["a", "b"], "left").select(
            "a", "b", "depth", "qa", "qb", (F.col("n_leaves") + F.coalesce("_leaves", F.lit(0))).alias("n_leaves"),
            (F.col("saved_tokens") + F.coalesce("_saved", F.lit(0))).alias("saved_tokens"))
        old, state = state, cut_lineage(moved)
        discard(old)
        distance *= 2
    return state.select("a", "b", "n_leaves", "saved_tokens")


def prefix_trie(rows: DataFrame, shard_turns=SHARD_TURNS, shard_conversations=SHARD_CONVERSATIONS) -> tuple[DataFrame, DataFrame]:
    """Nodes and end lists of the conversations of :func:`whole` or :func:`rebuilt`.

    A node has its hash ``a``, ``b``, ``depth``, ``conv_id`` (its smallest conversation, whose turn at ``depth`` is the
    node's), ``parent_conv_id``, ``n_convs``, ``n_children``, ``n_leaves`` and ``saved_tokens``. An end list has rows of up to
    512 ids: ``a``, ``b``, ``first`` and ``ids``, ascending and joined by commas.
    """
    found = _from_the_root(partial_nodes(rows, shard_turns, shard_conversations))
    nodes = cut_lineage(found.groupBy("a", "b").agg(*[F.max(c).alias(c) for c in ("depth", "pa", "pb", "cp")],
                                                    F.sum("n").alias("n"), F.min("conv_id").alias("conv_id")))
    below = nodes.filter(F.col("pa").isNotNull())
    # A child of one conversation has one leaf below or at it.
    children = cut_lineage(below.groupBy(F.col("pa").alias("a"), F.col("pb").alias("b")).agg(
        F.count("*").alias("n_children"), F.count_if(F.col("n") == 1).alias("singles")))
    parents = below.select("a", "b", "pa", "pb").join(
        nodes.select(F.col("a").alias("pa"), F.col("b").alias("pb"), F.col("conv_id").alias("parent_conv_id")), ["pa", "pb"])
    out = nodes.join(children, ["a", "b"], "left").join(_subtrees(nodes, children), ["a", "b"], "left").join(
        parents.select("a", "b", "parent_conv_id"), ["a", "b"], "left")
    zero, one = F.lit(0).cast("bigint"), F.lit(1).cast("bigint")
    ends = found.filter(F.col("ends").isNotNull()).select(
        "a", "b", F.substring_index("ends", ",", 1).cast("bigint").alias("first"), F.col("ends").alias("ids"))
    return out.select("a", "b", "conv_id", "depth", "parent_conv_id", F.col("n").alias("n_convs"), F.coalesce("n_children", zero).alias("n_children"),
                      F.coalesce("n_leaves", one).alias("n_leaves"), F.coalesce("saved_tokens", zero).alias("saved_tokens")), ends


def _digests(ends: DataFrame) -> DataFrame:
    """SHA-256 of each node's whole end list, in one stream of its rows in order."""

    def run(batches):
        key, running = None, None
        for batch in batches:
            out = []
            for a, b, _, ids in zip(*(column.to_pylist() for column in batch.columns)):
                if (a, b) != key:
                    if key is not None:
                        out.append((*key, running.hexdigest()))
                    key, running = (a, b), hashlib.sha256(ids.encode())
                else:
                    running.update(b"," + ids.encode())
            yield from _digest_rows(out)
        if key is not None:
            yield from _digest_rows([(*key, running.hexdigest())])

    return ends.repartition("a", "b").sortWithinPartitions("a", "b", "first").mapInArrow(run, "a bigint, b bigint, ends_sha256 string")


def _digest_rows(out):
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out)], names=["a", "b", "ends_sha256"])


def trie_digest(conversations: DataFrame) -> DataFrame:
    """One row per node of the rebuilt conversations' trie as the query returns it."""
    nodes, ends = prefix_trie(rebuilt(cut_lineage(turns(conversations))))
    out = nodes.join(_digests(ends), ["a", "b"], "left")
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
                      F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"))


# crc32 of the decimal id: its bytes enter one by one, each followed by eight shifts (-1).
_CRC = ("xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), flatten(list_transform(string_split(CAST(c AS VARCHAR), ''), "
        "lambda s: list_prepend(CAST(ascii(s) AS BIGINT), list_transform(range(8), lambda q: CAST(-1 AS BIGINT)))))), "
        "lambda x, y: CASE WHEN y >= 0 THEN xor(x, y) WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END), 4294967295)")
SQL = f"""WITH t AS (
  SELECT conv_id AS c, r, x, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(length(r) || ':' || r || x)) AS i
  FROM (SELECT *, coalesce(role, '') AS r, coalesce(text, '') AS x FROM conversations WHERE conv_id IS NOT NULL)),
h AS (SELECT c, {_CRC} % {MOST_SHARED + 1} AS h FROM (SELECT DISTINCT c FROM t)),
s AS (
  SELECT h.c, 0 AS own, i, r, x FROM h JOIN t ON t.c = h.c - h.c % 100 AND t.i <= h.h
  UNION ALL SELECT h.c, 1, i, r, x FROM h JOIN t ON t.c = h.c AND t.i > h.h),
w AS (SELECT c, list(md5(length(r) || ':' || r || x) ORDER BY own, i) AS w, list(length(x) ORDER BY own, i) AS p FROM s GROUP BY c
  UNION ALL SELECT c, [], [] FROM h WHERE c NOT IN (SELECT c FROM s)),
places AS (SELECT c, w, p, unnest(range(0, len(w) + 1)) AS d FROM w),
nodes AS (
  SELECT array_to_string(w[1:d], '') AS node, any_value(w[1:d]) AS w, d, min(c) AS conv_id, count(*) AS n, coalesce(any_value(p[d]), 0) AS cp,
    coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (len(w) = d), '') AS ends
  FROM places GROUP BY node, d),
below AS (SELECT array_to_string(w[1:d - 1], '') AS node, count(*) AS n_children FROM nodes WHERE d > 0 GROUP BY 1),
sums AS (
  SELECT array_to_string(w[1:j], '') AS node, count(*) FILTER (leaf) AS n_leaves, sum((n - 1) * cp) AS saved
  FROM (SELECT w, n, cp, n_children IS NULL AS leaf, unnest(range(0, d + 1)) AS j FROM nodes LEFT JOIN below USING (node)) GROUP BY 1)
SELECT m.conv_id, m.d AS depth, up.conv_id AS parent_conv_id, m.n AS n_convs, coalesce(n_children, 0) AS n_children,
  n_leaves, CAST(saved AS BIGINT) AS saved_tokens, sha256(m.ends) AS ends_sha256
FROM nodes m JOIN sums USING (node) LEFT JOIN below USING (node)
  LEFT JOIN nodes up ON m.d > 0 AND up.d = m.d - 1 AND up.node = array_to_string(m.w[1:m.d - 1], '')"""
