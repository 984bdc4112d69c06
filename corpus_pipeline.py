"""A corpus pipeline over the documents table: toxicity, line dedup, near dedup, PII, packing.

Every stage takes (spark, docs, sf_dir) and works on all rows of ``docs``; all but the last return the
columns of documents. Between stages the rows are written to Parquet in the shared folder and read
again, so a lost executor repeats one stage at most.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evloom.llm import line_dedup, near_dedup, packing, pii, toxicity
from evloom.llm.tables import bounded_batches, table, written
from evloom.llm.vocabulary import read_added, read_ranks

#: Key of the surrogates; a deployment passes its own secret.
SURROGATE_KEY = "corpus"


def _recounted(docs: DataFrame, columns: list[str]) -> DataFrame:
    """``n_chars`` follows the text where a stage has changed it; a null text keeps its count."""
    if "n_chars" not in columns:
        return docs.select(*columns)
    count = F.coalesce(F.char_length("text").cast("long"), F.col("n_chars"))
    return docs.withColumn("n_chars", count).select(*columns)


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score one half or more go. Trained on the labels that no test holds out."""
    bounded_batches(spark)
    labels = table(spark, sf_dir, "labels")
    known = labels.where(F.crc32(F.col("doc_id").cast("string")) % 5 != 0)
    return toxicity.drop_toxic(docs, known)


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of repeated line runs go, and documents of which nothing is left."""
    cleaned = line_dedup.drop_repeated_lines(docs)
    left = cleaned.where((F.col("n_removed_lines") == 0) | F.col("text").rlike("\\S"))
    return _recounted(left, docs.columns)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every group of near duplicates (0.8 on five-word shingles) stays; rows without an id stay."""
    groups = near_dedup.near_duplicates(docs, percent=80)
    dropped = written(groups.where(~F.col("kept")).select("doc_id").distinct(), "dropped")
    return docs.join(dropped, "doc_id", "left_anti").select(*docs.columns)


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in the texts become surrogates."""
    return _recounted(pii.replace_private(docs, SURROGATE_KEY), docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece of a document in a sequence of 1024 tokens."""
    bounded_batches(spark)
    ranks = read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return packing.pack(docs, ranks, public_tokenizers.PATTERN, added=read_added(public_tokenizers.path("byte_bpe_50k.json")))


STAGES = [("toxicity", toxicity_stage), ("line dedup", line_dedup_stage), ("near dedup", near_dedup_stage),
          ("pii", pii_stage), ("packing", packing_stage)]

#: The toxicity model and the signatures have no SQL form; tests compare the pipeline with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
