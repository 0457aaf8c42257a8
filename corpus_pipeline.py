"""A training-data pipeline of five stages; each reads what the one before it wrote.

Language identification drops texts without a language, the n-gram Jaccard join keeps the
smallest ``doc_id`` of each group of near duplicates, decontamination drops documents that
hold benchmark text, personal data is masked, and the rest is packed into sequences.
"""

import functools
import uuid

from pyspark.sql import functions as F

from panelwright.llm import decontaminate, jaccard, language, packing, pii
from panelwright.llm.frames import BATCH_ROWS, limit_batches
from panelwright.session import checkpoint_dir

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def identify_language(spark, docs, sf_dir):
    """Documents in a known language, also mixed ones; the model learns from all labelled ``docs``."""
    found = language.identify(docs, language.train(docs), keep=COLUMNS)
    return found.filter(F.col("lang_pred") != language.UNKNOWN).select(*COLUMNS)


def drop_near_duplicates(spark, docs, sf_dir):
    """One document of each group of near duplicates: the one with the smallest id (none comes last), then text key.

    A row is told by its id and its text's key, so rows of one id with different texts, or of no id, are documents
    of their own; of equal rows one stays. Documents without words resemble nothing and all stay.
    """
    rows = jaccard.jaccard_rows(docs).filter("root IS NOT NULL")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key"))
    kept = rows.groupBy("root").agg(first.alias("m")).select(F.col("m.doc_id").alias("_id"), F.col("m.text_key").alias("_key"))
    keyed = docs.select(*COLUMNS, F.xxhash64("text").alias("_key"))
    wordless = ~F.coalesce(F.col("text"), F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    chosen = keyed.filter(~wordless).join(kept.withColumnRenamed("_key", "_of"), (F.col("_key") == F.col("_of")) & F.col("doc_id").eqNullSafe(F.col("_id")), "left_semi")
    return chosen.dropDuplicates(["_key", "doc_id"]).unionByName(keyed.filter(wordless)).select(*COLUMNS)


def drop_contaminated(spark, docs, sf_dir):
    """Documents that are not contaminated by benchmark items."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontaminate.contamination(docs, items, keep=COLUMNS).filter(~decontaminate.is_contaminated()).select(*COLUMNS)


def mask_personal_data(spark, docs, sf_dir):
    """All documents, every span of personal data replaced by its kind."""
    found = pii.masked_documents(docs, keep=[c for c in COLUMNS if c != "text"]).withColumnRenamed("masked", "text")
    return found.withColumn("n_chars", F.length("text").cast("bigint")).select(*COLUMNS)


def pack(spark, docs, sf_dir):
    """Pieces of packed sequences, with their token ids."""
    return packing.pack_documents(docs)


def _in_small_batches(stage):
    """The stage, whose result is computed later by whoever writes it, under the session's lower limit on batches."""
    @functools.wraps(stage)
    def limited(spark, docs, sf_dir):
        limit_batches(spark)
        return stage(spark, docs, sf_dir)

    return limited


STAGES = [(name, _in_small_batches(stage)) for name, stage in (
    ("language", identify_language), ("jaccard_join", drop_near_duplicates), ("decontamination", drop_contaminated),
    ("personal_data", mask_personal_data), ("packing", pack))]
#: Fitted models decide in three stages, which SQL cannot express.
ORACLE_SQL = None


def run(spark, sf_dir):
    """All stages over ``documents``, each written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{checkpoint_dir(spark)}/pipeline/{uuid.uuid4().hex}"
    before = spark.conf.get(BATCH_ROWS)
    try:
        for number, (name, stage) in enumerate(STAGES):
            path = f"{folder}/{number}_{name}"
            stage(spark, docs, sf_dir).write.parquet(path)
            docs = spark.read.parquet(path)
    finally:
        spark.conf.set(BATCH_ROWS, before)
    return docs
