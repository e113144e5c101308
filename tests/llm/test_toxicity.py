import random
import zlib

import numpy as np
import pytest

from lexweave.llm import toxicity
from pyspark.sql import functions as F
from llm_fixtures import none, odd  # noqa: F401

TINY = toxicity.Settings(window=12, stride=8, train_documents=150, epochs=4, least_steps=60, batch=64)


def corpus(seed, count):
    rng = random.Random(seed)
    texts, labels = [], []
    for at in range(count):
        words = [rng.choice(["ala", "bela", "cora", "dun", "est", "fio", "gru"]) + rng.choice(["", "s", "t"]) for _ in range(rng.randrange(4, 90))]
        toxic = at % 3 == 0
        for _ in range(1 + len(words) // 30 if toxic else 0):
            words[rng.randrange(len(words))] = rng.choice(["scum", "vile" + rng.choice(["ta", "ro", "mi", "su"])])
        texts.append(" ".join(words) + ".")
        labels.append(int(toxic))
    return texts, labels


def test_gradients_against_differences():
    settings = toxicity.Settings(window=7, stride=4, hidden=3, embedding=2)
    known = np.arange(5, dtype=np.uint64)
    network = toxicity.Network(settings, known, known)
    rng = np.random.default_rng(0)
    network.weights = {name: rng.standard_normal(value.shape) for name, value in network.weights.items()}
    inputs, windows = rng.standard_normal((9, 4)), rng.integers(1, 9, (5, 7))
    inputs[0], windows[2, 5:], windows[4, 1:] = 0, 0, 0
    targets, weight = np.array([1, 0, 1, 0, 1.0]), np.array([1, 0.3, 1, 1, 2.0])

    def loss():
        found = 1 / (1 + np.exp(-network.logits(inputs, windows)))
        return float((-weight * (targets * np.log(found) + (1 - targets) * np.log(1 - found))).mean())

    found, to_inputs = network.gradients(inputs, windows, targets, weight)

    def slope(values, at):
        before = values[at]
        sides = []
        for step in (1e-2, -1e-2):
            values[at] = before + step
            sides.append(loss())
        values[at] = before
        return (sides[0] - sides[1]) / 2e-2

    for name, gradient in found.items():
        flat = network.weights[name].reshape(-1)
        for at in range(min(5, flat.size)):
            assert slope(flat, at) == pytest.approx(np.asarray(gradient).reshape(-1)[at], abs=2e-3)
    for at in ((1, 0), (4, 2), (8, 3)):
        assert slope(inputs, at) == pytest.approx(to_inputs[at], abs=2e-3)


def test_windows_cover_every_word():
    for n in (0, 1, 11, 12, 13, 20, 21, 100):
        windows = toxicity.windows_of(list(range(1, n + 1)), TINY)
        assert set(windows.ravel()) - {0} == set(range(1, n + 1)) and windows.shape[1] == 12


def test_words_and_trigrams_are_hashed_by_their_bytes():
    vocabulary = toxicity.Vocabulary(TINY)
    assert vocabulary.ids(["ab", "é", "ab", "x"]) == [1, 2, 1, 3]
    words, grams, firsts = vocabulary.hashes()
    code = lambda data: [data[i] << 16 | data[i + 1] << 8 | data[i + 2] for i in range(len(data) - 2)]
    assert grams.tolist() == code(b"^ab$") + code("^é$".encode()) + code(b"^x$")
    assert firsts.tolist() == [0, 2, 4] and len(set(words.tolist())) == 3


def test_held_out_documents_are_told_apart(spark):
    texts, labels = corpus(1, 600)
    docs = spark.createDataFrame([(at, text, "de") for at, text in enumerate(texts)], "doc_id long, text string, score string")
    table = spark.createDataFrame(list(enumerate(labels)), "doc_id long, toxic int")
    rows = toxicity.score(docs, table, TINY).withColumn("out", toxicity.held_out(F.col("doc_id"))).collect()
    assert all(row["out"] == (zlib.crc32(str(row["doc_id"]).encode()) % 5 == 0) for row in rows)
    unseen = [row for row in rows if row["out"]]
    right = sum(row["predicted"] == labels[row["doc_id"]] for row in unseen)
    assert len(unseen) > 80 and right / len(unseen) >= 0.9
    assert all(0 <= row["score"] <= 1 and row["predicted"] == int(row["score"] >= 0.5) for row in rows)


def test_held_out_labels_change_nothing(spark):
    texts, labels = corpus(2, 150)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    flipped = [1 - label if zlib.crc32(str(at).encode()) % 5 == 0 else label for at, label in enumerate(labels)]
    samples = [
        toxicity.training_sample(docs, spark.createDataFrame(list(enumerate(found)), "doc_id long, toxic int"))
        for found in (labels, flipped)
    ]
    assert samples[0] == samples[1]


def test_odd_rows_and_missing_labels(spark, odd, none):
    docs = odd(["scum " * 3, None, "", "x" * 20_000, "a b c " * 5000])
    labels = spark.createDataFrame([(0, 1), (1, None), (None, 0)], "doc_id long, toxic int")
    rows = toxicity.score(docs, labels, TINY).collect()
    assert len(rows) == docs.count() and all(0 <= row["score"] <= 1 for row in rows)
    assert toxicity.score(none, labels, TINY).count() == 0
    blank = toxicity.train([""] * 8, [0, 1] * 4, TINY)
    assert np.isfinite(toxicity.score_block(blank, ["", "ala"])[0]).all()
    texts, truth = corpus(4, 120)
    network = toxicity.train(texts, truth, TINY)
    scores, worst = toxicity.score_block(network, ["", "ala scum bela", "dun " * 3000])
    assert len(scores) == 3 and np.isfinite(scores).all() and worst[0] == 0
