import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from lexweave.llm import packing
from llm_fixtures import none, odd  # noqa: F401

SMALL = "/root/testdata/sf0.001"
TEXTS = ["", None, "hello", "é 日本 🙂 it's\n\n  x", "word " * 5000, "a" * 3000, "hello", "don't  stop <|endoftext|> now", "<|endoftext|>"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def test_ids_are_those_of_the_library(spark, library):
    encoder = packing.token_encoder()
    texts = [row["text"] for row in spark.read.parquet(f"{SMALL}/documents.parquet").collect()] + [t or "" for t in TEXTS]
    for text in texts:
        assert encoder.encode_to_numpy(text, allowed_special="all").tolist() == library.encode(text, add_special_tokens=False).ids


def test_pieces_and_places(spark, library):
    texts = TEXTS * 12
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = packing.pack_documents(docs, with_ids=True).collect()
    pieces, places = defaultdict(list), defaultdict(list)
    for row in rows:
        pieces[row["doc_id"]].append((row["start"], row["ids"]))
        places[row["sequence_id"]].append((row["offset"], row["length"]))
        assert row["length"] == len(row["ids"])
        assert row["ids_crc32"] == zlib.crc32(np.array(row["ids"], "<u4").tobytes())
    for doc_id, text in enumerate(texts):
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 0]
        assert [at for _, part in sorted(pieces[doc_id]) for at in part] == ids
        assert {row["doc_tokens"] for row in rows if row["doc_id"] == doc_id} == {len(ids)}
    for parts in places.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= packing.CAPACITY
    total = sum(row["length"] for row in rows)
    assert len(places) <= total / packing.CAPACITY * 1.05 + 3


def test_sequences_hold_their_pieces(spark):
    packed = packing.pack_documents(spark.createDataFrame([(1, "a b c"), (2, "d")], "doc_id long, text string"), with_ids=True)
    (row,) = packing.sequences(packed).collect()
    assert len(row["ids"]) == 6 and row["ids"].count(0) == 2


def test_solver_holds_every_demand_near_the_bound():
    rng = np.random.default_rng(8)
    for n in (1, 7, 300, 20_000):
        sizes, counts = np.unique(rng.integers(1, 64, n), return_counts=True)
        demand = dict(zip(sizes.tolist(), counts.tolist(), strict=True))
        patterns, held = packing.cutting_stock(demand, 64), defaultdict(int)
        for pattern in patterns:
            assert sum(size * amount for size, amount in pattern.amounts.items()) <= 64
            for size, amount in pattern.amounts.items():
                held[size] += amount * pattern.times
        assert all(held[size] >= count for size, count in demand.items())
        least = sum(size * count for size, count in demand.items()) / 64
        assert sum(pattern.times for pattern in patterns) <= least * 1.02 + 8
    assert packing.cutting_stock({}, 64) == []


def test_knapsack_against_all_choices():
    sizes, prices = np.array([3, 4, 7]), np.array([0.3, 0.45, 0.8])
    best = max(
        a * 0.3 + b * 0.45 + c * 0.8 for a in range(9) for b in range(7) for c in range(4) if 3 * a + 4 * b + 7 * c <= 25
    )
    value, amounts = packing.knapsack(sizes, prices, 25)
    assert abs(value - best) < 1e-9 and amounts @ sizes <= 25 and abs(amounts @ prices - best) < 1e-9


def test_odd_rows_and_empty_table(spark, odd, none):
    assert packing.pack_documents(odd(["x", "y z"])).count() == 4
    assert packing.pack_documents(none).count() == 0
