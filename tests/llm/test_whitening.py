import math

import numpy as np
import pytest

from lexweave.llm import whitening


def brute(vectors, components=16):
    """The contract, entry by entry, in Python integers."""
    rows = {
        at: [math.floor(64 * float(c)) + 1000000 for c in vector]
        for at, vector in vectors
        if vector is not None and all(c is not None and math.isfinite(c) for c in vector)
    }
    fit = sorted({tuple(x) for x in rows.values()})
    n, dims = len(fit), len(fit[0])
    sums = [sum(x[j] for x in fit) for j in range(dims)]
    cov = np.array([[sum((n * x[i] - sums[i]) * (n * x[j] - sums[j]) for x in fit) / n**3 for j in range(dims)] for i in range(dims)])
    values, directions = np.linalg.eigh(cov)
    order = np.argsort(-values)[:components]
    found = {}
    for at, x in rows.items():
        apart = [n * c - s for c, s in zip(x, sums, strict=True)]
        centred = np.array([c / n for c in apart])
        for k, column in enumerate(order, start=1):
            value = centred @ directions[:, column] / math.sqrt(values[column])
            found[at, k] = (n, sum(c * c for c in apart), value, values[column] / np.trace(cov))
    return found


def random_vectors(seed, rows, dims):
    rng = np.random.default_rng(seed)
    return (rng.normal(size=(rows, dims)) * np.linspace(0.2, 3, dims) + rng.normal(size=dims)).tolist()


@pytest.mark.parametrize("spread", [3, 500, 1 << 40])
def test_scatter_is_exact(spread):
    rng = np.random.default_rng(spread % 97)
    for count in (1, 63, 64, 65, 300):
        rows = rng.integers(-spread, spread, size=(count, 5), endpoint=True)
        found = whitening.scatter(rows)
        exact = rows.astype(object)
        assert found.count == count and found.sums == list(exact.sum(axis=0))
        assert (found.products == exact.T @ exact).all()


def test_planes_hold_every_bit():
    rows = np.random.default_rng(1).integers(0, 1 << 9, size=(130, 3)).astype(np.uint64)
    packed = whitening.planes(rows)
    assert packed.shape == (9, 3, 3)
    ones = np.bitwise_count(packed).sum(axis=2)
    assert (ones == [[int((rows[:, j] >> np.uint64(k) & np.uint64(1)).sum()) for j in range(3)] for k in range(9)]).all()


def test_against_brute_force(spark):
    vectors = list(enumerate(random_vectors(7, 200, 20)))
    vectors += [(200 + at, vectors[0][1]) for at in range(60)]  # copies count once
    vectors += [(300, None), (301, [*vectors[1][1][:-1], None]), (302, [*vectors[1][1][:-1], float("nan")]), (303, [*vectors[1][1][:-1], float("inf")])]
    found = whitening.whiten(spark.createDataFrame(vectors, "vec_id long, embedding array<double>")).collect()
    want = brute(vectors)
    assert {(row["vec_id"], row["component"]) for row in found} == set(want) and len(found) == len(want)
    signs = {}
    for row in found:
        n, deviation, value, explained = want[row["vec_id"], row["component"]]
        assert (row["n"], row["deviation"]) == (n, deviation) and row["n"] == 200
        assert row["explained"] == pytest.approx(explained, rel=1e-9)
        assert row["identity_error"] < 1e-9
        if abs(value) > 1e-6:
            signs.setdefault(row["component"], np.sign(row["whitened"]) == np.sign(value))
            sign = 1 if signs[row["component"]] else -1
            assert row["whitened"] * sign == pytest.approx(value, rel=1e-6, abs=1e-8)


def test_whole_table_against_brute_force(spark):
    table = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    vectors = [(row["vec_id"], row["embedding"]) for row in table.collect()]
    want = brute(vectors)
    found = whitening.whiten(table).collect()
    assert len(found) == len(want)
    for row in found:
        n, deviation, value, _ = want[row["vec_id"], row["component"]]
        assert (row["n"], row["deviation"]) == (n, deviation)
        assert abs(row["whitened"]) == pytest.approx(abs(value), rel=1e-5, abs=1e-6)


def test_odd_rows(spark):
    rows = [(None, [1.0, 2.0], "a"), (1, [3.0, 1.0], "b"), (1, [0.0, 0.5], "c"), (2, [1.0], "d"), (3, [], "e"), (2**53 + 1, [2.0, 2.0], None)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, component string")
    found = whitening.whiten(table).collect()
    assert sorted((row["vec_id"] or 0, row["component"]) for row in found) == [
        (0, 1), (0, 2), (1, 1), (1, 1), (1, 2), (1, 2), (2**53 + 1, 1), (2**53 + 1, 2)
    ]
    assert {row["n"] for row in found} == {4}


def test_huge_entries_and_flat_directions(spark):
    rows = [(0, [1e300, 0.0]), (1, [-1e300, 0.0]), (2, [1e15, 0.0])]
    found = whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert [row["component"] for row in found] == [1, 1, 1] and all(math.isfinite(row["whitened"]) for row in found)
    assert all(row["deviation"] is None for row in found)


@pytest.mark.parametrize("rows", [[], [(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [1.0, 2.0])], [(1, None)], [(1, [])]])
def test_nothing_varies(spark, rows):
    found = whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    assert found.columns[0] == "vec_id" and found.count() == 0
