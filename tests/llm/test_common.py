import pyarrow as pa
from pyspark.sql import Row
from pyspark.sql import types as T

from lexweave.llm.common import text_slices, with_text_results


def test_other_columns_pass_untouched(spark):
    rows = [
        (2**53 + 1, "one two", Row(**{"a b": 1}), None, [2**60 + 1]),
        (None, None, None, 2**62 + 1, None),
        (-(2**63), "", Row(**{"a b": None}), -7, []),
    ]
    schema = T.StructType().add("doc_id", T.LongType()).add("text", T.StringType())
    schema = schema.add("odd", T.StructType().add("a b", T.IntegerType())).add("n", T.LongType()).add("list", T.ArrayType(T.LongType()))
    docs = spark.createDataFrame(rows, schema).coalesce(1)
    found = with_text_results(docs, "text", T.StructType().add("size", T.IntegerType()), lambda texts: [pa.array(map(len, texts), pa.int32())])
    assert sorted(map(repr, found.collect())) == sorted(
        repr(Row(doc_id=row[0], text=row[1], odd=row[2], n=row[3], list=row[4], size=len(row[1] or ""))) for row in rows
    )


def test_slices_are_bounded_and_whole():
    texts = ["a" * 30, None, "b" * 500, "", "c" * 5, "d" * 90, "e"]
    batch = pa.record_batch({"text": texts, "at": list(range(7))})
    parts = list(text_slices(iter([batch, batch.slice(0, 0)]), limit=100))
    assert [at for part in parts for at in part.column("at").to_pylist()] == list(range(7))
    assert all(part.num_rows == 1 or sum(len(t or "") for t in part.column("text").to_pylist()) <= 600 for part in parts) and len(parts) > 2
