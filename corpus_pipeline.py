"""Corpus preparation in five stages over `documents`.

Each stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept. Rows are told apart by
doc_id and place in the table, so repeated rows and ids are fine.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shrinkwise.llm.common import saved_texts, table
from shrinkwise.llm.exact_dedup import exact_duplicates
from shrinkwise.llm.packing import pack_files
from shrinkwise.llm.queries import DECISION, learnable
from shrinkwise.llm.simhash import simhash_near_duplicates
from shrinkwise.llm.substring_dedup import remove_repeated_passages
from shrinkwise.llm.toxicity import fit_toxicity, score_toxicity

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def numbered(docs: DataFrame, label: str) -> DataFrame:
    """Documents as files: rel_path is the doc_id with the row's place, which tells repeated ids apart.

    They are a table in the shared folder, so that every later scan sees a row with the same place.
    """
    place = F.monotonically_increasing_id().alias("place")
    return saved_texts(docs.select(F.struct("doc_id", place).alias("rel_path"), *COLUMNS), label)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored below the decision threshold; labels of the fold held out are not learned from."""
    files = docs.select(F.col("doc_id").alias("rel_path"), "text")
    model = fit_toxicity(files, learnable(spark, sf_dir, 4, 2))
    whole = docs.select(F.struct(*COLUMNS).alias("rel_path"), "text")
    return score_toxicity(whole, model).where(F.col("score") < DECISION).select("rel_path.*")


def drop_exact_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal texts, the one with the largest doc_id."""
    files = numbered(docs, "exact")
    copies = exact_duplicates(files.select("rel_path", "text")).where("not kept").select("rel_path")
    return files.join(copies.hint("merge"), "rel_path", "left_anti").select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates by SimHash, the document with the smallest doc_id."""
    files = numbered(docs, "near")
    groups = simhash_near_duplicates(files.select("rel_path", "text"))
    copies = groups.where("rel_path != component_id").select("rel_path")
    return files.join(copies.hint("merge"), "rel_path", "left_anti").select(*COLUMNS)


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the passages that occur elsewhere; a text that has none stays as it is."""
    files = docs.withColumnRenamed("doc_id", "rel_path")
    left = remove_repeated_passages(files, whole=True, carry=("lang", "source", "n_chars"))
    size = F.when(F.col("n_removed") > 0, F.length("kept").cast("bigint")).otherwise(F.col("n_chars"))
    return left.select(F.col("rel_path").alias("doc_id"), F.col("kept").alias("text"), "lang", "source", size.alias("n_chars"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences."""
    files = docs.select(F.col("doc_id").alias("rel_path"), "text")
    return pack_files(files, public_tokenizers.path("word_bpe_49k.json")).withColumnRenamed("rel_path", "doc_id")


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_exact_duplicates),
    ("simhash_near_dedup", drop_near_duplicates),
    ("substring_dedup", cut_repeated_passages),
    ("packing", pack),
]

#: No SQL: toxicity is a learned score.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to `documents`; what each returns is a Parquet table in the shared folder."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = saved_texts(stage(spark, docs, sf_dir), name)
    return docs
