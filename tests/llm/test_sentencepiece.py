import re

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece as library
from conftest import plan_of
from pyspark.sql import functions as F
from sentencepiece import sentencepiece_model_pb2 as model_file

from lexweave.llm import sentencepiece
from llm_fixtures import none, odd  # noqa: F401

SMALL = "/root/testdata/sf0.001"
ODD = ["", None, " ", "\n", "  two  spaces ", "é \x00\t日本 zz 🙂", "x" * 300, "a", "a", "\n\n a\nb"]


def unigram():
    """The pieces of the file as a unigram model; its two scores far below the others would drown in single precision."""
    described = model_file.ModelProto()
    with open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as file:
        described.ParseFromString(file.read())
    described.trainer_spec.model_type = 1
    for piece in described.pieces:
        piece.score = max(piece.score, -40_000.0)
    return library.SentencePieceProcessor(model_proto=described.SerializeToString())


def test_ids_are_those_of_the_library_and_decode_to_the_text(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text")
    rows = sentencepiece.decode(sentencepiece.encode(docs)).collect()
    reference, compared = unigram(), 0
    for row in rows:
        assert row["decoded"] == row["text"]
        if "  " not in row["text"]:
            compared += 1
            ids = reference.encode(row["text"])
            score = lambda found: sum(reference.get_score(at) for at in found)
            assert row["ids"] == ids or abs(score(row["ids"]) - score(ids)) < 1e-3 * abs(score(ids))
            assert reference.decode(row["ids"]) == row["text"]
    assert compared > 100


def test_odd_texts_both_ways(spark, odd, none):
    docs = odd(ODD)
    rows = sentencepiece.decode(sentencepiece.encode(docs)).collect()
    assert len(rows) == docs.count() and all(row["decoded"] == (row["text"] or "") for row in rows)
    known = {(row["doc_id"], row["text"]): row["ids"] for row in rows}
    for row in sentencepiece.encode(docs, max_dictionary_bytes=0).collect():
        assert row["ids"] == known[row["doc_id"], row["text"]]
    assert sentencepiece.encode(none).count() == 0


def test_a_large_table_of_units_moves_no_text(spark, odd):
    texts = [" ".join(f"w{at % 97}é{at * at % 89}" for at in range(first, first + 40)) for first in range(0, 4_000, 20)]
    docs = odd([*ODD, *texts]).repartition(3)
    far = sentencepiece.encode(docs, max_dictionary_bytes=0, held_bytes=3_000)
    known = sentencepiece.encode(docs)
    assert far.columns == known.columns and far.schema["ids"].dataType == known.schema["ids"].dataType
    assert sorted(map(tuple, far.select("doc_id", "text", "ids").fillna("").collect()), key=str) == sorted(
        map(tuple, known.select("doc_id", "text", "ids").fillna("").collect()), key=str
    )
    fixed = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text")
    assert "Exchange" not in plan_of(sentencepiece.encode(fixed, max_dictionary_bytes=0))


def test_units_with_the_same_hash_are_told_apart():
    def block(*rows):
        columns = [pa.array(list(column), field.type) for column, field in zip(zip(*rows), sentencepiece.BLOCK_SCHEMA)]
        batch = pa.RecordBatch.from_arrays(columns, schema=sentencepiece.BLOCK_SCHEMA)
        return rows[0][0], rows[-1][0], batch.serialize()

    blocks = [block((-5, "a", [1]), (3, "b", [2, 2]), (3, "c", [3])), block((3, "d", [4]), (9, "e", [5, 6, 7]))]
    found, hashes = ["d", "e", "b", "c"], np.array([3, 9, 3, 3])
    starts, sizes, values = sentencepiece._ids_of(found, hashes, iter(blocks))
    assert [values[at : at + n].tolist() for at, n in zip(starts, sizes)] == [[4], [5, 6, 7], [2, 2], [3]]
    with pytest.raises(RuntimeError, match="1 units"):
        sentencepiece._ids_of(["d", "z"], np.array([3, 3]), iter(blocks))


def test_units_are_segmented_in_parts(spark, monkeypatch):
    docs = spark.createDataFrame([(at, f"{chr(97 + at % 26)}{chr(97 + at // 26)}") for at in range(100)], "doc_id long, text string")
    known, seen = sentencepiece.encode(docs).collect(), []
    segment = sentencepiece.segment
    monkeypatch.setattr(sentencepiece, "TASK_UNITS", 16)
    monkeypatch.setattr(sentencepiece, "segment", lambda words, *rest: (seen.append(words.rdd.getNumPartitions()), segment(words, *rest))[1])
    assert sorted(sentencepiece.encode(docs).collect()) == sorted(known)
    assert seen == [100 // 16 + 1]


def test_lattice_against_all_segmentations(spark):
    table = spark.createDataFrame(
        [("a", 10, -1.0), ("b", 11, -1.5), ("ab", 12, -2.0), ("ba", 13, -2.6), ("aba", 14, -3.1)],
        "piece string, id int, score double",
    )
    scores = {row["piece"]: (row["score"], row["id"]) for row in table.collect()}

    def best(word):
        if not word:
            return 0.0, []
        found = []
        for cut in range(1, len(word) + 1):
            head = word[:cut]
            if head in scores or cut == 1:
                rest, ids = best(word[cut:])
                score, at = scores[head] if head in scores else (-13.1, 100 + ord(head))
                found.append((score + rest, [at, *ids]))
        return max(found)

    words = ["a", "ab", "aba", "ababab", "bbaab", "axb", "x"]
    found = sentencepiece.segment(spark.createDataFrame([(word,) for word in words], "unit string"), table, 100)
    for row in found.collect():
        want = best(row["unit"])[0]
        total = sum(next((s for s, i in scores.values() if i == at), -13.1) for at in row["ids"])
        assert abs(total - want) < 1e-9


def test_a_word_is_one_unit_whatever_mark_follows(spark):
    pattern = sentencepiece.unit_pattern()
    texts = ["word, word. word", "it's (word)! x1 42, \n a&&&b --- é,É\x0b", "', ,'", "日本, ①"]
    rows = spark.createDataFrame([(text,) for text in texts], "text string").select("text", sentencepiece.units(F.col("text"), pattern))
    for text, found in rows.collect():
        assert found == sentencepiece.units_of(text, pattern)
        assert "".join(found) == sentencepiece.SPACE + text.replace(" ", sentencepiece.SPACE)
    assert sentencepiece.units_of(texts[0], pattern) == ["▁word", ",", "▁word", ".", "▁word"]
    processor = sentencepiece._processor(None)
    for at in range(3, processor.get_piece_size()):
        piece = processor.id_to_piece(at)
        if not processor.is_byte(at) and piece.strip(sentencepiece.SPACE):
            assert re.findall(pattern, piece) == [piece]


def test_units_of_very_long_words(spark):
    pattern = sentencepiece.unit_pattern()
    texts = ["x" * 200_000, "-" * 200_000, "日," * 100_000, "日1" * 100_000 + " a,", " " * 200_000]
    rows = spark.createDataFrame([(text,) for text in texts], "text string").select("text", sentencepiece.units(F.col("text"), pattern))
    for text, found in rows.collect():
        assert found == sentencepiece.units_of(text, pattern)
        assert "".join(found) == sentencepiece.SPACE + text.replace(" ", sentencepiece.SPACE)


def test_the_dictionary_is_held_in_few_bytes(spark, tmp_path):
    units = spark.range(200_000).selectExpr("xxhash64(cast(id as string)) hash", "array(cast(id % 30000 as int), 7) ids")
    units.write.parquet(f"file://{tmp_path}/units")
    files = spark.read.parquet(f"file://{tmp_path}/units").inputFiles()
    held = sentencepiece._Dictionary(files, 200_000, 400_000, sentencepiece.unit_pattern())
    arrays = [value for value in vars(held).values() if hasattr(value, "nbytes")]
    assert sum(array.nbytes for array in arrays) <= 200_000 * 20
    at = held.places(["5", "199999"])
    assert [held.values[held.starts[i] : held.starts[i] + held.sizes[i]].tolist() for i in at] == [[5, 7], [19_999, 7]]
