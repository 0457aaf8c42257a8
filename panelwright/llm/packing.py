"""Vector bin packing of tokenized documents into training sequences.

A sequence has simultaneous limits on tokens, segments and loss-bearing tokens. Pieces
are placed by the dot-product heuristic: of the pieces that fit, the one whose demands
have the largest dot product with what the open sequence has left, all in shares of the
limits. When no piece fits, one is cut to what is left, so full sequences have no
padding; where the limit on segments or loss ends a sequence, it is cut to a power of two, and the
last few tokens of a task go to sequences of such lengths.

A sequence only holds pieces of one task, and a task keeps one batch of documents and
less than a sequence of leftovers; there is no shuffle. Sequence ids combine the number
of the partition and a counter.

Edge cases: a null or empty text is its end token alone; a text of any length is cut into
several pieces; equal and repeated documents are packed one by one; an empty table gives
no rows. Columns that are not named in ``keep`` are not read.
"""

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwright.llm import tokens

CAPACITY = 2048
SEGMENTS = 256
END = 1
#: Pieces the heuristic chooses among; further ones wait their turn.
CHOICE = 512
#: Documents tokenized at a time.
ROWS = 2000
#: Partition number above, counter below: 2**38 sequences a task.
_SHIFT = 38


class Packer:
    """Fills sequences from a pool of pieces ``(key, start, ids, loss per token, document's tokens)``."""

    def __init__(self, capacity, segments, loss, first_id):
        self.limits = np.array([capacity, segments, loss], float)
        self.pool, self.waiting, self.tokens = [], 0, 0
        self.next, self.rows = first_id, []

    def add(self, key, start, ids, rate, total):
        if len(ids):
            self.pool.append((key, start, ids, rate, total))
            self.tokens += len(ids)

    def fill(self, capacity):
        """One sequence of at most ``capacity`` tokens; takes its pieces out of the pool."""
        room = np.array([capacity, self.limits[1], self.limits[2]])
        offset, placed = 0, []
        window = self.pool[-CHOICE:]
        base = len(self.pool) - len(window)
        demand = np.array([[len(ids), 1.0, len(ids) * rate] for _, _, ids, rate, _ in window])
        score_by = demand / self.limits
        free = np.ones(len(window), bool)
        taken, rest = [], []
        while room[0] >= 1 and room[1] >= 1 and free.any():
            fits = free & (demand <= room + 1e-9).all(axis=1)
            score = score_by @ (room / self.limits)
            if fits.any():
                i = int(np.argmax(np.where(fits, score, -1.0)))
                length = len(window[i][2])
            else:
                i = int(np.argmax(np.where(free, score, -1.0)))
                rate = window[i][3]
                length = int(min(room[0], room[2] // rate if rate else room[0]))
                if length < 1:
                    break
            key, start, ids, rate, total = window[i]
            placed.append((key, start, ids[:length], rate, total))
            if length < len(ids):
                rest.append((key, start + length, ids[length:], rate, total))
            offset += length
            room -= [length, 1, length * rate]
            free[i] = False
            taken.append(i)
        for i in sorted(taken, reverse=True):
            del self.pool[base + i]
        self.pool += rest
        if offset < capacity:
            # Another limit ends the sequence, which is cut to a power of two: no padding, and at least half of it stays.
            offset = 1 << (offset.bit_length() - 1)
        at = 0
        for key, start, ids, rate, total in placed:
            fits = max(0, min(len(ids), offset - at))
            if fits:
                self.rows.append((key, start, ids[:fits], total, self.next, at))
            if fits < len(ids):
                self.pool.append((key, start + fits, ids[fits:], rate, total))
            at += fits
        self.tokens -= offset
        self.next += 1

    def full(self):
        while self.tokens >= self.limits[0]:
            self.fill(int(self.limits[0]))

    def close(self):
        self.full()
        while self.tokens:
            self.fill(1 << (self.tokens.bit_length() - 1))


def pack_documents(docs: DataFrame, tokenizer_path=None, capacity=CAPACITY, segments=SEGMENTS,
                   loss_tokens=None, loss_rate=None, end=END, keep=("doc_id",)) -> DataFrame:
    """Pieces of all documents: ``keep``, ``start``, ``length``, ``ids`` (little-endian 32-bit),
    ``doc_tokens``, ``sequence_id`` and ``offset``.

    ``loss_rate`` names a column with the share of a document's tokens that bear loss, within 0 and 1
    (null, NaN or no column: all do); ``loss_tokens`` bounds their sum per sequence, ``capacity`` if
    not given. Limits that one token would exceed are refused. A null ``tokenizer_path`` means the
    50k byte-level vocabulary; strings of its special tokens are these tokens.
    """
    keep = list(keep)
    if capacity < 1 or segments < 1 or (loss_tokens is not None and not loss_tokens >= 1):
        raise ValueError("every limit must leave room for one token")
    share = F.lit(1.0) if loss_rate is None else F.col(loss_rate).cast("double")
    rate = F.when(share.isNull() | F.isnan(share), F.lit(1.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), share)))
    chosen = docs.select(*keep, rate.alias("_rate"), F.col("text").alias("_text"))
    schema = chosen.schema
    kept = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in schema[:-2])
    most_loss = loss_tokens or capacity

    def run(batches):
        packer = Packer(capacity, segments, most_loss, TaskContext.get().partitionId() << _SHIFT)

        def rows():
            made, packer.rows = packer.rows, []
            if not made:
                return
            for at in range(0, len(made), 5000):
                part = made[at:at + 5000]
                keys, start, ids, total, sequence, offset = zip(*part)
                columns = [pa.array([k[i] for k in keys], kinds[i]) for i in range(len(keep))]
                yield pa.RecordBatch.from_arrays(
                    columns + [pa.array(start, pa.int64()), pa.array([len(x) for x in ids], pa.int64()),
                               pa.array([x.tobytes() for x in ids], pa.binary()), pa.array(total, pa.int64()),
                               pa.array(sequence, pa.int64()), pa.array(offset, pa.int64())],
                    names=[*keep, "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])

        kinds = []
        for whole in batches:
            kinds = [whole.schema.field(i).type for i in range(len(keep))]
            for at in range(0, whole.num_rows, ROWS):
                batch = whole.slice(at, ROWS)
                flat, begin = tokens.encode(batch.column(len(keep) + 1), tokenizer_path, special=True)
                keys = list(zip(*(batch.column(i).to_pylist() for i in range(len(keep))))) if keep else [()] * batch.num_rows
                shares = batch.column(len(keep)).to_pylist()
                for i, key in enumerate(keys):
                    ids = np.append(flat[begin[i]:begin[i + 1]], [end]).astype("<u4")
                    packer.add(key, 0, ids, shares[i], len(ids))
                packer.full()
                yield from rows()
        packer.close()
        yield from rows()

    return chosen.mapInArrow(run, f"{kept}start bigint, length bigint, ids binary, doc_tokens bigint, sequence_id bigint, offset bigint")


def packing_digest(docs: DataFrame, tokenizer_path=None) -> DataFrame:
    """One row per piece as the query returns it."""
    return pack_documents(docs, tokenizer_path).select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
