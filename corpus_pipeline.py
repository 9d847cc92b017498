"""The training-data pipeline: five stages, from raw documents to packed sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes
it to the shared folder and hands it to the next stage. All stages but the
last return the columns of documents (doc_id, text, lang, source, n_chars).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqlake.llm import decontamination, near_dedup, packing, quality, suffix_dedup
from seqlake.llm.common import BROADCAST_IDS, Scratch, documents, with_row_ids
from seqlake.llm.tokens import default_path

#: Bytes of a repeated passage that the pipeline removes: about fifty short words.
PASSAGE_BYTES = 250

#: None of the stages (trained model, sketches, suffix windows, latent search, tokenizer) has a SQL form.
ORACLE_SQL = None


def _without(docs: DataFrame, key: str, gone: DataFrame, scratch: Scratch) -> DataFrame:
    """Rows whose number isn't among ``gone``; a broadcast only while those are few. The number's column goes."""
    gone = scratch.keep(gone.select(F.col("uid").alias(key)).distinct(), "gone")
    gone = F.broadcast(gone) if gone.count() <= BROADCAST_IDS else gone
    return docs.join(gone, key, "left_anti").drop(key)


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go.

    Null and empty texts stay; equal rows are judged alike; rows that share an
    id but not the text are judged each; an empty table stays one; other
    columns are kept, whatever their names.
    """
    scratch = Scratch(spark, "stage7")
    rows, key, _ = with_row_ids(docs, scratch)
    judged = quality.judged(rows, spark.read.parquet(f"{sf_dir}/labels.parquet"), key)
    return _without(rows, key, judged.filter("NOT kept"), scratch)


def near_deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays: the one with the smallest id.

    Texts without words are groups of their own; of equal rows (id and text)
    one stays; rows that share an id but not the text are documents of their
    own, and where such a row is in a group any one of the group stays; an
    empty table stays one; other columns are kept, whatever their names.
    """
    scratch = Scratch(spark, "stage5")
    rows, key, repeat = with_row_ids(docs, scratch)
    found = near_dedup.near_duplicates(rows.select(F.col(key).alias("doc_id"), "text"))
    gone = found.filter("NOT kept").select(F.col("doc_id").alias("uid"))
    if not repeat:
        return _without(rows, key, gone, scratch)
    again = scratch.keep(rows.groupBy(key).count().filter("count > 1").select(key), "again")
    again = F.broadcast(again) if again.count() <= BROADCAST_IDS else again
    one = rows.join(again, key, "left_anti").unionByName(rows.join(again, key, "left_semi").dropDuplicates([key]))
    return _without(one, key, gone, scratch).select(*(F.col(f"`{c}`") for c in docs.columns))


def suffix_deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that occur more than once are cut out of the texts in all places but the first, by document id and place.

    Null, empty and short texts stay as they are; texts of any length are
    searched whole; equal rows count as one; an empty table stays one; other
    columns are kept, whatever their names.
    """
    rows, key, _ = with_row_ids(docs, Scratch(spark, "stage3"))
    return suffix_dedup.without_repeats(rows, PASSAGE_BYTES, keep_first=True, key=key)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go.

    Null and empty texts stay; equal rows are judged alike; rows that share an
    id but not the text are judged each; an empty table stays one; other
    columns are kept, whatever their names.
    """
    scratch = Scratch(spark, "stage6")
    rows, key, _ = with_row_ids(docs, scratch)
    found = decontamination.contaminated(rows, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), key)
    return _without(rows, key, found, scratch)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents, and their places in sequences.

    A null text is an empty one; repeated rows are packed each; longer texts
    than a sequence are cut; an empty table gives no piece; other columns
    don't matter.
    """
    return packing.pack(docs, default_path(packing.VOCABULARY))


STAGES = [
    ("quality_classifier", quality_classifier),
    ("minhash_near_dedup", near_deduplication),
    ("suffix_array_dedup", suffix_deduplication),
    ("benchmark_decontamination", benchmark_decontamination),
    ("best_fit_packing", best_fit_packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written and read again as the next one's documents."""
    scratch = Scratch(spark, "pipeline")
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = scratch.keep(stage(spark, docs, sf_dir), name)
    return docs
