"""Serial numbers taken greedily in document order: 1, then the next 2 after it, and so on.

What a stretch of lines does to the expected serial is a map: it leads each serial that it holds
to the one expected after it, and every other serial to itself. Maps of neighbouring stretches compose,
so no task needs a whole document. A block of pages is one map, folded in a task; the maps
of a document's blocks are composed in a binary tree by joins; going down the tree, each
block learns the serial expected at its start and takes its lines on its own.

Serials compress to small files, which make every table here look small; its joins are merge
joins, as their sides grow with the documents and must not be sent through the driver.
"""

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwright.session import cut_lineage, discard

#: Pages that one task folds at a time.
BLOCK_PAGES = 64
_BLOCK = ["document", "_block"]


def _fields(df: DataFrame, *names) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name in names)


def _by_block(rows: DataFrame, *order) -> DataFrame:
    return rows.repartition(*_BLOCK).sortWithinPartitions(*_BLOCK, *order)


def _batch(columns, schema):
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def block_maps(found: DataFrame) -> DataFrame:
    """(document, block, serial, next): where each serial that a block holds leads within it.

    Read backwards, a line with serial v leads v to wherever v + 1 leads after it.
    """

    def run(batches):
        key, leads, schema = None, {}, None

        def rows():
            return _batch([[key[0]] * len(leads), [key[1]] * len(leads), list(leads), list(leads.values())], schema)

        for batch in batches:
            schema = pa.schema([*(batch.schema.field(i).with_nullable(True) for i in range(2)), ("serial", pa.int64()), ("next", pa.int64())])
            for document, block, serial in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if (document, block) != key:
                    if leads:
                        yield rows()
                    key, leads = (document, block), {}
                leads[serial] = leads.get(serial + 1, serial + 1)
        if leads:
            yield rows()

    rows = found.select(*_BLOCK, "serial", "page", "line_no")
    return _by_block(rows, F.desc("page"), F.desc("line_no")).select(*_BLOCK, "serial").mapInArrow(
        run, _fields(found, *_BLOCK) + ", serial bigint, next bigint")


def _composed(maps: DataFrame) -> DataFrame:
    """Maps of pairs of neighbouring nodes; many serials may lead to one, a key that adaptive execution can split."""
    up = maps.withColumn("_up", F.floor(F.col("_node") / 2))
    left = up.filter(F.col("_node") % 2 == 0).select("document", "_blocks", F.col("_up").alias("_node"), "serial", "next")
    right = up.filter(F.col("_node") % 2 == 1).select("document", "_blocks", F.col("_up").alias("_node"), "serial", "next")
    after = right.select("document", "_node", F.col("serial").alias("next"), F.col("next").alias("_after"))
    through = left.join(after.hint("merge"), ["document", "_node", "next"], "left").select(
        "document", "_blocks", "_node", "serial", F.coalesce("_after", "next").alias("next"))
    return through.unionByName(right.join(left.hint("merge"), ["document", "_node", "serial"], "left_anti"))


def block_starts(found: DataFrame) -> DataFrame:
    """(document, block, start): the serial expected where each block begins."""
    blocks = found.select(*_BLOCK).distinct()
    own = blocks.groupBy("document").agg(F.min("_block").alias("_first"), (F.max("_block") - F.min("_block") + 1).alias("_blocks"))
    most = own.agg(F.max("_blocks")).first()[0] or 0
    start = own.select("document", "_blocks", "_first", F.lit(0).cast("bigint").alias("_node"), F.lit(1).cast("bigint").alias("start"))
    levels = []
    if most > 1:
        own = cut_lineage(own)
        start = own.select("document", "_blocks", "_first", F.lit(0).cast("bigint").alias("_node"), F.lit(1).cast("bigint").alias("start"))
        many = block_maps(found.join(own.filter("_blocks > 1").select("document").hint("merge"), "document", "left_semi"))
        levels.append(cut_lineage(many.join(own.hint("merge"), "document").select(
            "document", "_blocks", (F.col("_block") - F.col("_first")).alias("_node"), "serial", "next")))
        while 2 ** len(levels) < most:  # documents leave the tree at their own height
            levels.append(cut_lineage(_composed(levels[-1].filter(F.col("_blocks") > 2 ** len(levels)))))
    for height in reversed(range(len(levels))):
        leads = levels[height].select("document", F.col("_node").alias("_child"), F.col("serial").alias("start"), F.col("next").alias("_after"))
        here = start.withColumn("_child", F.col("_node") * 2)
        right = here.filter((F.col("_child") + 1) * 2 ** height < F.col("_blocks")).join(leads.hint("merge"), ["document", "_child", "start"], "left").select(
            "document", "_blocks", "_first", (F.col("_child") + 1).alias("_node"), F.coalesce("_after", "start").alias("start"))
        old, start = start, cut_lineage(here.select("document", "_blocks", "_first", F.col("_child").alias("_node"), "start").unionByName(right))
        if height < len(levels) - 1:
            discard(old)
    if levels:
        discard(*levels)
    return start.select("document", (F.col("_first") + F.col("_node")).alias("_block"), "start")


def take_serials(found: DataFrame, block_pages=BLOCK_PAGES) -> DataFrame:
    """The rows of (document, page, line_no, serial) that are taken as 1, 2, 3, ... in document order.

    Serials are positive and pages are integers. A task holds one entry for each serial of a
    block. Rows without a document or page are not taken.
    """
    found = found.filter(F.col("document").isNotNull() & F.col("page").isNotNull()).withColumn("_block", F.floor(F.col("page") / block_pages))
    found = cut_lineage(found.select(*_BLOCK, "page", "line_no", "serial"))

    def run(batches):
        key, expected = None, None
        for batch in batches:
            out = []
            for i, (document, block, serial, start) in enumerate(zip(*(batch.column(j).to_pylist() for j in (0, 1, 4, 5)))):
                if (document, block) != key:
                    key, expected = (document, block), start
                if serial == expected:
                    out.append(i)
                    expected += 1
            yield batch.take(pa.array(out, pa.int64())).select([0, 2, 3, 4])

    rows = found.join(block_starts(found).hint("merge"), _BLOCK).select(*found.columns, "start")
    return _by_block(rows, "page", "line_no").mapInArrow(run, _fields(found, "document", "page", "line_no", "serial"))
