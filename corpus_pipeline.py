"""From raw documents to packed training sequences, stage by stage.

Each stage takes all documents its predecessor kept and returns those it keeps, with the columns of
``documents``; the last returns the places of their tokens.  ``run`` applies the stages to the
documents table and writes every result as Parquet in the shared folder before the next reads it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexweave.llm import line_dedup, ngram_join, packing, quality, toxicity
from lexweave.llm.common import materialize, read

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
# What the pipeline calls near; op3 alone keeps the defaults of its contract.
NEAR = ngram_join.Settings(words=5, percent=80)


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the network does not find toxic; it learns from the labels of the documents that are left."""
    scored = toxicity.score(docs.select(*COLUMNS), read(spark, sf_dir, "labels"))
    return scored.where("predicted = 0").select(*COLUMNS)


def reject_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weakly labelled scorer keeps."""
    return quality.score(docs.select(*COLUMNS)).where("keep").select(*COLUMNS)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes repeated chunks and passages of lines out of the texts; a document of which nothing is left goes.

    ``n_chars`` follows the text where it was changed.
    """
    cleaned = line_dedup.dedup_lines(docs.select(*COLUMNS), words=line_dedup.PASSAGE_WORDS)
    length = F.when(F.col("removed_chunks") > 0, F.char_length("text").cast("long")).otherwise(F.col("n_chars"))
    return cleaned.where("removed_chunks = 0 or text <> ''").withColumn("n_chars", length).select(*COLUMNS)


def keep_one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (5-word shingles, Jaccard of 0.8 or more) the document with the smallest id.

    Rows that share an id with it stay together; rows without an id always stay.
    """
    groups = ngram_join.near_duplicates(docs, NEAR)
    others = groups.where("doc_id <> component_id").select("doc_id").distinct()
    return docs.select(*COLUMNS).join(others, "doc_id", "left_anti").select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of every document and their places in the sequences."""
    return packing.pack_documents(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", reject_toxic),
    ("quality", reject_low_quality),
    ("line_dedup", drop_repeated_lines),
    ("near_duplicates", keep_one_of_near_duplicates),
    ("packing", pack),
]

# A trained network and a tokenizer cannot be said in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written as Parquet and read by the next."""
    docs = read(spark, sf_dir, "documents").select(*COLUMNS)
    for at, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if at < len(STAGES) - 1:
            docs = materialize(docs, f"stage-{name}")
    return docs
