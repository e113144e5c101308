import itertools
import random

import numpy as np
import pytest
import xxhash

from lexweave.llm import golay_simhash as gs
from llm_fixtures import none, odd  # noqa: F401


def brute_fingerprint(text):
    words = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ").replace("\x0b", " ").replace("\x0c", " ").replace("\r", " ").split(" ") if w]
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64(gram.encode(), seed=42).intdigest() for gram in grams]
    return sum(1 << bit for bit in range(64) if 2 * sum(h >> bit & 1 for h in hashes) > len(hashes))


def brute_groups(fingerprints):
    """Smallest place that links reach, by comparing all pairs of distinct fingerprints."""
    values = np.array(sorted(set(fingerprints)), np.uint64)
    parent = list(range(len(values)))

    def root(at):
        while parent[at] != at:
            parent[at] = at = parent[parent[at]]
        return at

    for a in range(len(values)):
        for b in np.flatnonzero(np.bitwise_count(values[a] ^ values) <= 3):
            low, high = sorted((root(a), root(int(b))))
            parent[high] = low
    number, least = {int(v): root(i) for i, v in enumerate(values)}, {}
    for at, value in enumerate(fingerprints):
        least.setdefault(number[value], at)
    return [least[number[value]] for value in fingerprints]


def unsigned(value):
    return value % (1 << 64)


def test_code_is_perfect():
    _, errors = gs._tables()
    assert len(set(errors.tolist())) == 1 << gs.CHECKS
    rng = np.random.default_rng(3)
    words = rng.integers(0, 1 << 23, 2000).astype(np.uint32)
    own = gs.decode(words)
    again = np.array([next(c for c in (int(i) << 11 | low for low in range(1 << 11)) if gs._remainder(c) == 0) for i in own[:50]])
    assert (np.bitwise_count(again.astype(np.uint32) ^ words[:50]) <= 3).all()


@pytest.mark.parametrize("width", [21, 22, 23])
def test_segments_with_one_bit_between_them_meet(width):
    segments = np.random.default_rng(width).integers(0, 1 << width, 3000).astype(np.uint32)
    own, near, real = gs.nearby(segments, width)
    assert real.sum(axis=1).max() == gs.NEARBY and real[:, 0].all()
    if width == 23:
        assert set(real.sum(axis=1).tolist()) == {1, gs.NEARBY}
    for bit in range(width):
        other = gs.decode(segments ^ np.uint32(1 << bit))
        assert ((near == other[:, None]) & real).any(axis=1).all()
    assert ((near == own[:, None]) & real).any(axis=1).all()


def test_all_that_links_shares_a_key():
    rng = random.Random(5)
    for weight in (1, 2, 3):
        for _ in range(400):
            a = rng.getrandbits(64)
            b = a
            for bit in rng.sample(range(64), weight):
                b ^= 1 << bit
            rows, keys = gs.keys(np.array([a, b], np.uint64))
            first, second = set(keys[rows == 0].tolist()), set(keys[rows == 1].tolist())
            assert first & second
            assert len(first) == (rows == 0).sum()


def test_fingerprints():
    texts = ["", "  \n", "One", "one two", "A b C d e a b c", "Ünï çödé x   y z", "a " * 1000, "x y z x y z x y z"]
    assert [gs.fingerprint(text) for text in texts] == [brute_fingerprint(text) for text in texts]
    long = " ".join(f"w{i * i % 977}" for i in range(gs.SLICE_SHINGLES + 100))
    assert gs.fingerprint(long) == brute_fingerprint(long)


def clouds(seed, centres, size, spread):
    """Fingerprints around centres, with up to so many turned bits; some chains, many far apart."""
    rng = random.Random(seed)
    found = [0, (1 << 64) - 1]
    for _ in range(centres):
        centre = rng.getrandbits(64)
        for _ in range(size):
            value = centre
            for bit in rng.sample(range(64), rng.randint(0, spread)):
                value ^= 1 << bit
            found.append(value)
            if rng.random() < 0.05:
                centre = value
    return found


@pytest.mark.parametrize(("centres", "size", "spread", "block"), [(40, 30, 8, 512), (3, 500, 4, 16), (2, 400, 12, 7), (1, 900, 6, 32)])
def test_links_against_brute_force(spark, centres, size, spread, block):
    values = clouds(centres * size, centres, size, spread)
    want = brute_groups(values)
    distinct = spark.createDataFrame([(value - (1 << 64) if value >> 63 else value,) for value in set(values)], "fp long")
    found = {unsigned(row["fp"]): row["label"] for row in gs.linked(distinct, block=block).collect()}
    groups = {}
    for at, value in enumerate(values):
        groups.setdefault(found.get(value, value - (1 << 64) if value >> 63 else value), []).append(at)
    assert sorted(group[0] for group in groups.values()) == sorted(set(want))
    for group in groups.values():
        assert {want[at] for at in group} == {group[0]}


def test_whole_table_against_brute_force(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = sorted((row["doc_id"], row["text"]) for row in table.collect())
    fingerprints = [brute_fingerprint(text) for _, text in rows]
    want = [(doc_id, fp, rows[first][0]) for (doc_id, _), fp, first in zip(rows, fingerprints, brute_groups(fingerprints), strict=True)]
    found = sorted((row["doc_id"], unsigned(row["fp"]), row["component_id"]) for row in gs.near_duplicates(table).collect())
    assert found == want and len({component for *_, component in want}) < len(want)


def test_odd_rows(odd, none):  # noqa: F811
    texts = [None, "", "word", "Word", "a longer text of some words here", " \t "]
    found = gs.near_duplicates(odd(texts, first=2**53 + 1)).collect()
    base = 2**53 + 1
    of = {}
    for row in found:
        of.setdefault(row["doc_id"], []).append(row["component_id"])
    assert of[None] == [None]
    assert of[base] == [base] and of[base + 1] == [base] and of[base + 5] == [base, base]
    assert of[base + 3] == [base + 2] and of[base + 4] == [base + 4]
    assert gs.near_duplicates(none).count() == 0


def test_distance_is_bounded_by_the_keys(none):  # noqa: F811
    with pytest.raises(ValueError, match="3"):
        gs.near_duplicates(none, distance=4)


def test_ties_of_half():
    # Two shingles: a bit set in one of two is not set in over half.
    text = "a b c d"
    hashes = [xxhash.xxh64_intdigest(gram, 42) for gram in (b"a b c", b"b c d")]
    assert gs.fingerprint(text) == hashes[0] & hashes[1]
    assert all(gs.fingerprint(t) == brute_fingerprint(t) for t in map(" ".join, itertools.permutations("abcd")))
