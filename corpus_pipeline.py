"""A training-corpus pipeline: language ID, near-duplicate removal, repeated-string removal, packing.

Each stage takes (spark, docs, sf_dir), docs having the columns of the documents table, and returns a DataFrame that is
written as Parquet and read again as the next stage's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyloom.llm.frames import checkpointed, delete, temporary
from skyloom.llm.language_id import fit, identify
from skyloom.llm.packing import pack
from skyloom.llm.simhash import BROADCAST_IDS, near_duplicate_classes
from skyloom.llm.suffix_dedup import remove_repeated_strings
from skyloom.session import importable

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
PASSAGE_BYTES = 200
"""A passage of over 50 words has as many bytes: of the repeated runs of 51 words and more in the test tables 99 % have 192 or
more, half of them 467."""


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that the language classifier, fitted on docs' own labels, doesn't reject.

    Rejected: texts without a letter (null and empty ones, too), and texts far from every centroid of their language.
    The columns stay as they are; extra columns go. Repeated rows are judged alike, so all of them stay or go.
    """
    model = fit(docs)
    return identify(docs.select(*COLUMNS), model).where(~F.col("rejected")).select(*COLUMNS)


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps exactly one row of each group of near duplicates: a Jaccard similarity of 0.8 or more of five-word shingles,
    found by MinHash bands and verified. Repeated rows and rows with a null id are rows like any other. The row kept is that
    of the smallest id (null last), and of these the least text, lang, source and n_chars; an id doesn't tell a row, so
    texts that share one are judged each by itself."""
    own = docs.select(*COLUMNS, F.xxhash64(F.coalesce("text", F.lit(""))).alias("node"))
    # groups: texts linked with others, and texts of several rows; all other rows stay as they are
    roots = near_duplicate_classes(docs)
    counted = own.groupBy("node").count().where("count > 1").select("node", F.col("node").alias("root"))
    groups = checkpointed(roots.unionAll(counted.join(roots, "node", "left_anti")))
    held = F.broadcast(groups) if groups.count() <= BROADCAST_IDS else groups
    alone = own.join(held, "node", "left_anti").select(*COLUMNS)
    row = F.struct(F.col("doc_id").isNull().alias("no_id"), *COLUMNS)
    kept = own.join(held, "node").groupBy("root").agg(F.min(row).alias("row"))
    return alone.unionAll(kept.select(*[F.col(f"row.{c}").alias(c) for c in COLUMNS]))


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts every string of PASSAGE_BYTES that also starts earlier (in a document of a smaller id, or earlier in the same
    one) out of the texts, so that of a passage that documents share one occurrence stays. All documents stay, with an
    empty text where nothing else was in it, and with their lang and source; n_chars is the length of the text that is
    left (what is left of a character that was cut goes with it)."""
    kept = remove_repeated_strings(docs, length=PASSAGE_BYTES, with_text=True, keep=["lang", "source"], keep_first=True)
    return kept.select("doc_id", F.col("kept_text").alias("text"), "lang", "source", F.char_length("kept_text").cast("long").alias("n_chars"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the texts into sequences of 4096 tokens: one row per piece."""
    return pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("language_id", language_id), ("simhash_dedup", simhash_dedup), ("suffix_dedup", suffix_dedup), ("packing", packing)]

ORACLE_SQL = None
"""SQL can express neither the classifier nor the fingerprints; tests/llm compares the stages with brute-force versions."""


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table; what a stage returns goes through Parquet in the shared folder, and goes away when
    the next one has read it (that of the last but one when the driver ends)."""
    importable(spark)
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        path = temporary(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        if before:
            delete(spark, before)
        docs, before = spark.read.parquet(path), path
    return STAGES[-1][1](spark, docs, sf_dir)
