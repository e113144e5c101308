"""Texts to embed, and upkeep of the embedding column."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.ml.feature import HashingTF, Normalizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text


def chunk_text() -> Column:
    """Title, section and content of a chunk, cut to the model's limit."""
    return text.truncate_for_embedding(
        text.embedding_text("document_title", "section_title", "section_number", "content")
    )


def embed_table(
    df: DataFrame,
    model: Callable[[list[str]], list[list[float]]] | None = None,
    dimension: int = 64,
    batch_size: int = 100,
) -> DataFrame:
    """Add ``embedding`` to a table with a ``text`` column.

    ``model`` turns a list of texts into vectors of ``dimension``, in order; it
    runs inside the tasks on batches of ``batch_size``, and no more texts than
    that are Python strings at a time.  Without a model the
    words are hashed and L2-normalised by the ML library, with no Python.
    """
    if model is None:
        tokens = df.withColumn("__words", text.words(F.coalesce("text", F.lit(""))))
        hashed = HashingTF(inputCol="__words", outputCol="__counts", numFeatures=dimension).transform(tokens)
        unit = Normalizer(inputCol="__counts", outputCol="__unit", p=2.0).transform(hashed)
        embedding = F.when(F.size("__words") > 0, vector_to_array("__unit", "float32"))
        return unit.withColumn("embedding", embedding).drop("__words", "__counts", "__unit")

    def embed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("text"))
            for start in range(0, batch.num_rows, batch_size):
                part = texts.slice(start, batch_size).to_pylist()
                found = model(part)
                if len(found) != len(part) or any(len(vector) != dimension for vector in found):
                    raise ValueError(f"the model must return {len(part)} vectors of {dimension}")
                vectors = pa.array(found, pa.list_(pa.float32()), from_pandas=True)
                columns = [*batch.slice(start, batch_size).columns, vectors]
                yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names, "embedding"])

    return df.mapInArrow(embed, T.StructType([*df.schema.fields, T.StructField("embedding", T.ArrayType(T.FloatType()))]))


def missing_embeddings(
    df: DataFrame, archive: str | None = None, resume_from: int | None = None, limit: int | None = None
) -> DataFrame:
    """Rows without an embedding, from an id on; in order of id when a limit is asked for."""
    found = df.where(F.col("embedding").isNull())
    if archive is not None:
        found = found.where(F.col("archive_filename") == archive)
    if resume_from is not None:
        found = found.where(F.col("id") >= resume_from)
    return found if limit is None else found.orderBy("id").limit(limit)


def apply_embeddings(df: DataFrame, updates: DataFrame) -> DataFrame:
    """``df`` with the embeddings of ``updates`` (``id, embedding``) written over its own."""
    new = updates.select("id", F.col("embedding").alias("new_embedding"))
    joined = df.join(new, "id", "left")
    return joined.withColumn("embedding", F.coalesce("new_embedding", "embedding")).select(*df.columns)


def failed_updates(df: DataFrame, updates: DataFrame) -> DataFrame:
    """Updates that match no row, and updates without a vector, with the reason."""
    unknown = updates.join(df.select("id"), "id", "left_anti").select("id", F.lit("unknown id").alias("reason"))
    empty = (
        updates.where("embedding is null")
        .join(df.select("id"), "id", "left_semi")
        .select("id", F.lit("no embedding").alias("reason"))
    )
    return unknown.unionByName(empty)


def embedding_size_stats(chunks: DataFrame, truncate_at: int = 18000) -> DataFrame:
    """One row: how many contents are empty, large, very large, or would be truncated."""
    length = F.length("content")
    blank = text.is_blank("content")
    return chunks.agg(
        F.count("*").alias("total"),
        F.count_if(blank).alias("empty_chunks"),
        F.count_if(~blank & (length > 100_000) & (length <= 500_000)).alias("large_chunks"),
        F.count_if(~blank & (length > 500_000)).alias("very_large_chunks"),
        F.count_if(~blank & (length > truncate_at)).alias("truncated_chunks"),
    )
