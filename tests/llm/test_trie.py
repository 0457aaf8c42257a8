"""The conversation trie against a plain one of nested prefixes."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from panelwright.llm import trie

NAMES = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def plain_sequences(rows, rebuild=True):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            own[conv].append((turn is not None, turn or 0, hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest(), role, text))
    own = {c: [t[3:] for t in sorted(turns, key=lambda t: (t[0], t[1], _halves(t[2])))] for c, turns in own.items()}
    if not rebuild:
        return own
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - (abs(c) % 100) * (1 if c >= 0 else -1)
        out[c] = own.get(base, [])[:h] + turns[h:]
    return out


def _halves(digest):
    return tuple(x - (1 << 64) if x >> 63 else x for x in (int(digest[:16], 16), int(digest[16:], 16)))


def plain_trie(sequences):
    members = defaultdict(list)
    for c in sorted(sequences):
        for d in range(len(sequences[c]) + 1):
            members[tuple(sequences[c][:d])].append(c)
    children, leaves, saved = defaultdict(int), defaultdict(int), defaultdict(int)
    for p in members:
        if p:
            children[p[:-1]] += 1
    for p, m in members.items():
        for j in range(len(p) + 1):
            leaves[p[:j]] += p not in children
            saved[p[:j]] += (len(m) - 1) * len(p[-1][1]) if p else 0
    return sorted((m[0], len(p), members[p[:-1]][0] if p else None, len(m), children[p], leaves[p], saved[p],
                   hashlib.sha256(",".join(str(c) for c in m if len(sequences[c]) == len(p)).encode()).hexdigest()) for p, m in members.items())


def rows_of(frame):
    return sorted(tuple(r[c] for c in NAMES) for r in frame.collect())


@pytest.fixture(scope="module")
def mixed():
    """Copies, shared beginnings, nulls, ties, repeated rows, absent bases, a long conversation and negative ids."""
    rng, rows = random.Random(2), []
    turns = [(rng.choice(["user", "assistant", None]), rng.choice(["a", "bb", "", None, "é" * 9, "the same"])) for _ in range(6)]
    for c in [*range(0, 230), *range(-120, -90), 1003, 70_000_000_001]:
        for t in range(rng.randint(1, 7)):
            rows.append((c, None if rng.random() < 0.05 else t, *(turns[0] if t == 0 and c % 3 else rng.choice(turns))))
    rows += [(c, t, "user", f"copy {t}") for c in range(300, 500) for t in range(5)]
    rows += [(600, t, "user", "again") for t in range(130)] + [(601, t, "user", "again") for t in range(70)]
    rows += [(602, 1, "user", "tied"), (602, 1, "user", "tied"), (602, 1, "assistant", "tied"), (602, None, None, None)]
    return rows + [(None, 1, "user", "nobody's")] + rng.sample(rows, 20)


SCHEMA = "conv_id bigint, turn int, role string, text string"


def test_trie_equals_brute_force(spark, mixed):
    frame = spark.createDataFrame(mixed, SCHEMA).selectExpr("*", "1 AS a", "'clash' AS depth")
    assert rows_of(trie.trie_digest(frame)) == plain_trie(plain_sequences(mixed))


def test_small_shards_cut_conversations_and_lose_nothing(spark, mixed):
    frame = spark.createDataFrame(mixed, SCHEMA)
    expected = plain_trie(plain_sequences(mixed, rebuild=False))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    for partitions, turns, convs in ((13, 5, 3), (3, 10_000, 10_000)):
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        try:
            partial = trie.partial_nodes(trie.whole(trie.turns(frame)), turns, convs)
            assert partitions == 3 or len(trie._before(partial)) > 5
            nodes, ends = trie.prefix_trie(trie.whole(trie.turns(frame)), turns, convs)
            empty = hashlib.sha256(b"").hexdigest()
            got = nodes.join(trie._digests(ends), ["a", "b"], "left").fillna(empty, ["ends_sha256"])
            assert rows_of(got) == expected
            assert sum(len(r["ids"].split(",")) for r in ends.collect()) == len({r[0] for r in mixed} - {None})
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", before)
            spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_trie_of_the_table_and_of_no_rows(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    rows = [tuple(r) for r in table.select("conv_id", "turn", "role", "text").collect()]
    assert rows_of(trie.trie_digest(table)) == plain_trie(plain_sequences(rows))
    assert trie.trie_digest(table.limit(0)).count() == 0
    absent = spark.createDataFrame([(101, 1, "user", "x")], SCHEMA)
    assert rows_of(trie.trie_digest(absent)) == plain_trie(plain_sequences([(101, 1, "user", "x")]))
