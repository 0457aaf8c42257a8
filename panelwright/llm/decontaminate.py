"""Benchmark decontamination: an FM-index per shard of training documents.

A document is contaminated if enough of its words lie inside occurrences of benchmark
windows (13 consecutive words, or a whole shorter item). Benchmark windows are searched
backwards in the index of each shard, their occurrences are located and merged to spans.

Edge cases: a null, empty or wordless text has no words, no spans and is clean; a
wordless item has no windows; items without an id mark words but are not listed; items
of the same id count once; an empty benchmark leaves all documents clean. Repeated
documents each get their row. Columns that are not named in ``keep`` are not read.
"""

from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwright.llm import textbytes as tb
from panelwright.llm.fmindex import FMIndex
from panelwright.llm.frames import per_row
from panelwright.session import cut_lineage

WINDOW = 13
#: Benchmark text per pass over the documents; a larger benchmark takes several passes. A block costs a process
#: about 100 times its text, so about 200 MB; a single item is never cut.
BLOCK_BYTES = 2 << 20
#: Words of a shard that go into one index.
SHARD_WORDS = 1 << 20
_HASH = tb.Hasher(11)
SCHEMA = ("n_words bigint, n_hit bigint, n_items bigint, items array<string>, "
          "spans array<struct<start:bigint,end:bigint>>")


def hashed_words(column):
    """Word hashes and first words of rows, slice by slice."""
    for low, high, data, offsets in tb.each_slice(column):
        data = tb.LOWER[data]
        starts, ends, first = tb.words(data, offsets, tb.ALNUM)
        yield low, high, _HASH.words(data, starts, ends), first


class Phrases:
    """The windows of benchmark items as sequences of vocabulary numbers."""

    def __init__(self, ids, texts, window=WINDOW):
        found: dict = {}
        items = []
        parts = [h[f[i]:f[i + 1]] for low, high, h, f in hashed_words(pa.array(texts, pa.string()))
                 for i in range(high - low)]
        self.vocabulary = np.unique(np.concatenate(parts)) if parts else np.zeros(0, np.uint64)
        for name, words in zip(ids, parts):
            # 1 ends a run; words are numbered from 2
            symbols = np.searchsorted(self.vocabulary, words) + 2
            for i in range(max(1, len(symbols) - window + 1) if len(symbols) else 0):
                key = symbols[i:i + window].tobytes()
                number = found.setdefault(key, len(found))
                if number == len(items):
                    items.append(set())
                if name is not None:
                    items[number].add(str(name))
        phrases = [np.frombuffer(key, np.int64) for key in found]
        self.items = items
        self.lengths = np.array([len(p) for p in phrases], np.int64)
        self.begin = np.concatenate([[0], np.cumsum(self.lengths)]).astype(np.int64)
        self.symbols = np.concatenate(phrases) if phrases else np.zeros(0, np.int64)
        self.shortest = int(self.lengths.min()) if phrases else 0

    def number(self, hashes):
        """Vocabulary number of every word, 1 if no benchmark item has it."""
        at = np.minimum(np.searchsorted(self.vocabulary, hashes), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[at] == hashes, at + 2, 1)


class Shard:
    """What the index keeps of documents: runs of benchmark words long enough for a window.

    No window can lie outside such a run, so leaving the rest out loses no occurrence.
    """

    def __init__(self):
        self.symbols, self.rows, self.words, self.size = [], [], [], 0

    def add(self, phrases, low, hashes, first):
        if not len(phrases.lengths) or not len(hashes):
            return
        known = phrases.number(hashes)
        inside = known > 1
        edge = np.zeros(len(hashes) + 1, bool)
        edge[first] = True
        starts, ends = inside.copy(), inside.copy()
        starts[1:] &= ~inside[:-1] | edge[1:-1]
        ends[:-1] &= ~inside[1:] | edge[1:-1]
        starts, ends = np.flatnonzero(starts), np.flatnonzero(ends) + 1
        fits = ends - starts >= phrases.shortest
        starts, ends = starts[fits], ends[fits]
        sizes = ends - starts + 1                    # with the closing 1
        if not len(sizes):
            return
        begin = np.cumsum(sizes) - sizes
        at = np.arange(sizes.sum()) - np.repeat(begin - starts, sizes)
        closing = begin + sizes - 1
        symbols = known[np.minimum(at, len(known) - 1)]
        symbols[closing] = 1
        row = np.repeat(np.searchsorted(first, starts, "right") - 1, sizes)
        self.symbols.append(symbols)
        self.rows.append(row + low)
        self.words.append(at - first[row])
        self.size += len(symbols)

    def search(self, phrases):
        """``(row, phrase)`` pairs that occur and ``(row, start, end)`` of merged spans."""
        symbols, rows, words = (np.concatenate(x) for x in (self.symbols, self.rows, self.words))
        index = FMIndex(symbols, len(phrases.vocabulary) + 1)
        low, high = index.search(phrases.symbols, phrases.begin)
        counts = high - low
        phrase = np.repeat(np.arange(len(low)), counts)
        places = np.arange(counts.sum()) + np.repeat(low - (np.cumsum(counts) - counts), counts)
        at = index.locate(places)
        change = np.zeros(len(symbols) + 1, np.int64)
        np.add.at(change, at, 1)
        np.add.at(change, at + phrases.lengths[phrase], -1)
        covered = np.concatenate([[0], np.cumsum(change)[:-1] > 0, [0]])
        start, end = np.flatnonzero(np.diff(covered) == 1), np.flatnonzero(np.diff(covered) == -1)
        pairs = np.unique(rows[at] * len(low) + phrase) if len(at) else at
        return pairs // max(1, len(low)), pairs % max(1, len(low)), rows[start], words[start], words[end - 1] + 1


def searched(phrases, shard_words):
    def function(column):
        n_words = np.zeros(len(column), np.int64)
        items, spans = defaultdict(set), defaultdict(list)
        shard = Shard()

        def flush():
            if shard.size:
                rows, numbers, span_rows, starts, ends = shard.search(phrases)
                for row, number in zip(rows.tolist(), numbers.tolist()):
                    items[row] |= phrases.items[number]
                for row, a, b in zip(span_rows.tolist(), starts.tolist(), ends.tolist()):
                    spans[row].append({"start": a, "end": b})

        for low, high, hashes, first in hashed_words(column):
            n_words[low:high] = np.diff(first)
            shard.add(phrases, low, hashes, first)
            if shard.size >= shard_words:
                flush()
                shard = Shard()
        flush()
        rows = range(len(column))
        hit = [sum(s["end"] - s["start"] for s in spans[i]) if i in spans else 0 for i in rows]
        return [pa.array(n_words), pa.array(hit, pa.int64()),
                pa.array([len(items[i]) if i in items else 0 for i in rows], pa.int64()),
                pa.array([sorted(items[i]) if i in items else [] for i in rows], pa.list_(pa.string())),
                pa.array([spans[i] if i in spans else [] for i in rows],
                         pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))]
    return function


def merged(spans):
    """Column expression: overlapping or touching spans of one document joined."""
    ordered = F.array_sort(spans)
    empty = F.slice(ordered, 1, 0)
    last = lambda acc: F.element_at(acc, -1)
    return F.aggregate(ordered, empty, lambda acc, s: F.when(
        (F.size(acc) > 0) & (F.try_element_at(acc, F.lit(-1))["end"] >= s["start"]),
        F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(
            last(acc)["start"].alias("start"), F.greatest(last(acc)["end"], s["end"]).alias("end")))))
        .otherwise(F.concat(acc, F.array(s))))


def contamination(docs: DataFrame, benchmark: DataFrame, keep=("doc_id",), window=WINDOW,
                  block_bytes=BLOCK_BYTES, shard_words=SHARD_WORDS) -> DataFrame:
    """Per document: ``n_words``, ``n_hit``, ``n_items``, ``items`` and ``spans`` (of word numbers).

    The benchmark is sent to the tasks block by block; with more than one block, each pass
    is written and the passes are merged per row.
    """
    keep = list(keep)
    size = benchmark.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = int(size // block_bytes) + 1
    chosen = benchmark.filter(F.col("text").isNotNull()).select("item_id", "text")
    if blocks == 1:
        return _one_pass(docs, chosen, keep, window, shard_words)
    rows = cut_lineage(docs.select(*keep, "text").withColumn("_row", F.monotonically_increasing_id()))
    found = None
    for b in range(blocks):
        part = chosen.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b)
        one = cut_lineage(_one_pass(rows, part, ["_row"], window, shard_words))
        found = one if found is None else found.unionByName(one)
    sums = found.groupBy("_row").agg(
        F.max("n_words").alias("n_words"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
        F.flatten(F.collect_list("spans")).alias("_spans")).withColumn("spans", merged(F.col("_spans")))
    sums = sums.select("_row", "n_words", F.aggregate("spans", F.lit(0).cast("bigint"), lambda a, s: a + s["end"] - s["start"]).alias("n_hit"),
                       F.size("items").cast("bigint").alias("n_items"), "items", "spans")
    return rows.drop(*({"text"} - set(keep))).join(sums, "_row").drop("_row")


def _one_pass(docs, items, keep, window, shard_words):
    rows = items.collect()
    phrases = docs.sparkSession.sparkContext.broadcast(
        Phrases([r["item_id"] for r in rows], [r["text"] for r in rows], window))

    def function(column):
        return searched(phrases.value, shard_words)(column)

    return per_row(docs, function, SCHEMA, keep=keep)


def is_contaminated():
    return (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))


def contamination_digest(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per document as the query returns it."""
    return contamination(docs, benchmark).select(
        "doc_id", "n_words", "n_hit", "n_items", F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
        is_contaminated().alias("contaminated"))


_WORDS = (r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
          r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')")
SQL = f"""WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
i AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
windows AS (
  SELECT DISTINCT item_id, least(len(w), 13) AS n, array_to_string(w[p:p + least(len(w), 13) - 1], ' ') AS words
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS p FROM i WHERE len(w) > 0)),
lengths AS (SELECT DISTINCT n FROM windows),
places AS (
  SELECT doc_id, n, p, array_to_string(w[p:p + n - 1], ' ') AS words
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM d CROSS JOIN lengths WHERE len(w) >= n)),
found AS (SELECT doc_id, item_id, p, n FROM places JOIN windows USING (n, words)),
hit AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS q FROM found) GROUP BY doc_id),
items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(name, ',' ORDER BY name) AS names
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS name FROM found WHERE item_id IS NOT NULL) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)"""


