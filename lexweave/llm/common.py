"""Small helpers the operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialize, scratch_dir  # noqa: F401  (re-exported)

# Bytes of text a task turns into Python objects at once; a longer text stands alone.
SLICE_BYTES = 4 << 20
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def ascii_lower(column: Column) -> Column:
    """Lower-cases A-Z only."""
    return F.translate(column, UPPER, LOWER)


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, text)`` alone, null texts as empty; other columns cannot clash."""
    return docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")
    )


def discard(table: DataFrame) -> None:
    """Removes the files of a table that ``materialize`` wrote, once nothing reads them any more."""
    spark = table.sparkSession
    for name in {file.rpartition("/")[0] for file in table.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def text_slices(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows of ``batches`` in slices whose texts have ``limit`` bytes, or one text more."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).cumsum()
        cuts = [0, *((sizes[1:] // limit != sizes[:-1] // limit).nonzero()[0] + 1).tolist(), batch.num_rows]
        for first, upto in zip(cuts, cuts[1:], strict=False):
            if upto > first:
                yield batch.slice(first, upto - first)


def with_text_results(
    docs: DataFrame, text_col: str, added: T.StructType, compute: Callable[[list[str]], list[pa.Array]],
    limit: int = SLICE_BYTES,
) -> DataFrame:
    """``docs`` with the columns ``added``, which ``compute`` gives for a list of texts (null texts are empty ones).

    The other columns stay in Arrow as they are, whatever their types and values.
    """
    names = [*docs.columns, *added.names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches, text_col, limit):
            found = compute([text or "" for text in part.column(text_col).to_pylist()])
            yield pa.RecordBatch.from_arrays([*part.columns, *found], names)

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, *added.fields]))
