import numpy as np

from lexweave.llm import quality
from llm_fixtures import none, odd  # noqa: F401

SMALL = "/root/testdata/sf0.01"


def test_estimated_rates_are_those_that_made_the_votes():
    rng = np.random.default_rng(6)
    good = rng.random(30_000) < 0.8
    rates = [(0.03, 0.7), (0.02, 0.5), (0.05, 0.6), (0.01, 0.4), (0.04, 0.55)]
    votes = np.empty((len(good), len(rates)), int)
    for at, (on_good, on_bad) in enumerate(rates):
        bad_vote = rng.random(len(good)) < np.where(good, on_good, on_bad)
        votes[:, at] = np.where(bad_vote, quality.BAD, np.where(rng.random(len(good)) < 0.1, quality.ABSTAIN, quality.GOOD))
    patterns, back, counts = np.unique(votes, axis=0, return_inverse=True, return_counts=True)
    posterior, found, prior = quality.fit_labellers(["".join(map(str, row)) for row in patterns], counts.tolist())
    assert abs(prior - good.mean()) < 0.1
    assert ((posterior[back.ravel()] >= 0.5) == good).mean() > 0.92
    assert all(found[at, quality.BAD, quality.BAD] > found[at, quality.GOOD, quality.BAD] + 0.2 for at in range(len(rates)))


def test_measures_of_plain_and_broken_texts():
    plain = "The quick brown fox jumps over the lazy dog, and then it rests for a while. " * 1
    assert quality.votes(quality.measures(plain))[:4] == [quality.GOOD] * 4
    assert quality.votes(quality.measures("BUY!! NOW!! " * 40))[0] == quality.BAD
    assert quality.votes(quality.measures("word " * 100))[3] == quality.BAD
    assert quality.votes(quality.measures("a | b | c | " * 20))[2] == quality.BAD
    assert quality.votes(quality.measures(""))[-1] == quality.BAD
    assert np.isfinite(quality.features("")).all() and quality.features("x").sum() > 0


def test_scorer_learns_soft_targets():
    rng = np.random.default_rng(7)
    rows = rng.standard_normal((400, 6)).astype(np.float32)
    targets = 1 / (1 + np.exp(-6 * rows[:, 0]))
    weights, bias = quality.fit_scorer(rows, targets)
    assert ((rows @ weights + bias > 0) == (targets > 0.5)).mean() > 0.95


def test_against_the_labels_it_never_sees(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    labels = spark.read.parquet(f"{SMALL}/labels.parquet").select("doc_id", "quality")
    scored = quality.score(docs.select("doc_id", "text"))
    rows = scored.withColumnRenamed("quality", "found").join(labels, "doc_id").collect()
    clean = [row["keep"] for row in rows if row["quality"] == 1]
    junk = [row["keep"] for row in rows if row["quality"] == 0]
    assert sum(clean) / len(clean) > 0.98 and sum(junk) / len(junk) < 0.1


def test_odd_rows(spark, odd, none):
    docs = odd(["A good enough sentence about nothing.", None, "", "!!! " * 5000, "x" * 100_000])
    rows = quality.score(docs)
    assert rows.count() == docs.count() and set(docs.columns) <= set(rows.columns)
    assert quality.score(none).count() == 0
