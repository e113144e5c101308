import random
import re
from itertools import combinations

import numpy as np

from lexweave.llm import ngram_join
from lexweave.llm.components import components
from llm_fixtures import none, odd  # noqa: F401

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingle_set(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return {tuple(words[i : i + 4]) for i in range(max(1, len(words) - 3))} if words else set()


def brute(texts):
    sets, parent = [shingle_set(text) for text in texts], list(range(len(texts)))

    def root(at):
        while parent[at] != at:
            at = parent[at]
        return at

    for a, b in combinations(range(len(sets)), 2):
        common = len(sets[a] & sets[b])
        if common and 100 * common >= 85 * (len(sets[a]) + len(sets[b]) - common):
            low, high = sorted((root(a), root(b)))
            parent[high] = low
    return {at: (len(found), root(at)) for at, found in enumerate(sets)}


def edited(rng, words, edits):
    words = list(words)
    for _ in range(edits):
        at = rng.randrange(len(words))
        words[at : at + rng.randrange(2)] = [f"n{rng.randrange(10**6)}"]
    return words


def corpus():
    rng = random.Random(11)
    vocabulary = [f"w{i}" for i in range(400)]
    draw = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    texts, hot = [], draw(60)
    for size in (3, 5, 8, 13, 20, 30, 45, 80, 150, 300):
        base = draw(size)
        # Chains: each an edit of the last, so that ends of a component need not be alike.
        for _ in range(12):
            texts.append(" ".join(base))
            base = edited(rng, base, rng.randrange(1, 2 + size // 60))
    for _ in range(40):
        own = draw(rng.randrange(1, 60))
        texts.append(" ".join(own[:5] + hot + own[5:]))
    texts += ["", None, " \t\n", "One", "one", "a B\x0bc", "A b\x0cC", "a b d", "\xa0x y z w", "x y z w"]
    texts += [texts[40]] * 5 + [texts[40].upper()] + ["long " * 30_000]
    rng.shuffle(texts)
    return texts


def test_against_brute_force(spark):
    texts = corpus()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    found = ngram_join.near_duplicates(docs).collect()
    want = brute(texts)
    assert len({c for _, c in want.values()}) < len(texts) - 25
    assert {row["doc_id"]: (row["n_shingles"], row["component_id"]) for row in found} == want


def test_pairs_at_the_bound_share_a_block():
    rng, settings = np.random.default_rng(4), ngram_join.Settings()
    for size in [*range(2, 40), 64, 100, 171, 400, 1000]:
        for _ in range(15):
            common = int(np.ceil(0.85 * size))
            base = rng.integers(0, 1 << 63, common, dtype=np.uint64)
            left = np.unique(np.append(base, rng.integers(0, 1 << 63, size - common, dtype=np.uint64)))
            extra = max(0, common * 100 // 85 - size)
            right = np.unique(np.append(base, rng.integers(0, 1 << 63, extra, dtype=np.uint64)))
            inside = len(np.intersect1d(left, right))
            if len(left) == inside == len(right) or 100 * inside < 85 * (len(left) + len(right) - inside):
                continue
            shared = np.intersect1d(ngram_join.block_keys(left, settings), ngram_join.block_keys(right, settings))
            assert len(shared)


def test_rows_that_share_an_id(spark):
    rows = [(1, "a b c d e"), (1, "v w x y z"), (2, "a b c d e"), (3, "v w x y z"), (None, "a b c d e")]
    found = ngram_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(found.collect(), key=str) == sorted(
        [(1, 2, 1), (1, 2, 1), (2, 2, 1), (3, 2, 1), (None, 2, None)], key=str
    )


def test_a_row_without_id_before_its_twin(spark):
    words = [f"w{i}" for i in range(40)]
    rows = [(None, " ".join(words)), (1, " ".join(words)), (2, " ".join([*words[:-1], "other"]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    found = {row["doc_id"]: row["component_id"] for row in ngram_join.near_duplicates(docs).collect()}
    assert found == {None: None, 1: 1, 2: 1}


def test_clashing_columns_and_empty_table(spark, odd, none):
    docs = odd(["a b c d", "A B C D", None])
    assert ngram_join.near_duplicates(docs).count() == docs.count()
    assert ngram_join.near_duplicates(none).count() == 0


def test_components_of_paths_and_stars(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(201, 200), (200, 201), (300, 300), (None, 4)]
    found = components(spark.createDataFrame(links, "a long, b long")).collect()
    labels = {row["node"]: row["label"] for row in found}
    assert len(found) == len(labels)
    assert labels == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 160)} | {200: 200, 201: 200}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_chains_of_unlike_texts_are_parted_before_their_sets_travel(spark, monkeypatch):
    words = [f"w{i}" for i in range(4000)]
    # Each text shares seven tenths with the next; two of them have a near copy.
    texts = [" ".join(words[at : at + 400]) for at in range(0, 3500, 70)]
    texts += [texts[7] + " end", texts[30] + " last words"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sizes, multiply = [], ngram_join.multiply

    def seen(docs, placed, *others):
        sizes.extend(row["count"] for row in placed.groupBy("label").count().collect())
        return multiply(docs, placed, *others)

    monkeypatch.setattr(ngram_join, "multiply", seen)
    found = {row["doc_id"]: row["component_id"] for row in ngram_join.near_duplicates(docs).collect()}
    assert sorted(sizes) == [2, 2]
    assert found == {at: at for at in range(50)} | {50: 7, 51: 30}


def test_plans_do_not_double_with_each_step(spark, monkeypatch):
    docs = spark.createDataFrame([(at, f"a b c d {at % 3} e f g h") for at in range(9)], "doc_id long, text string")
    scans, write = {}, ngram_join.materialize

    def written(table, name):
        plan = table._jdf.queryExecution().optimizedPlan().toString()
        scans[name] = max(scans.get(name, 0), plan.count("Relation ["))
        return write(table, name)

    monkeypatch.setattr(ngram_join, "materialize", written)
    monkeypatch.setattr(ngram_join, "components", lambda links: (written(links, "links"), components(links))[1])
    assert ngram_join.near_duplicates(docs).count() == 9
    assert max(scans.values()) <= 12, scans


def test_sketches_rule_out_no_link():
    rng = np.random.default_rng(9)
    for settings in (ngram_join.Settings(), ngram_join.Settings(words=5, percent=80)):
        sets = []
        for size in [1, 2, 3, 9, 40, 63, 64, 65, 127, 128, 130, 500, 520, 1024, 1030, 90_000]:
            base = rng.integers(0, 1 << 63, size, dtype=np.uint64)
            for share in (0, 2, 5, 8, 10, 15, 40):
                cut = base[: size - size * share // 100]
                sets.append(np.unique(np.append(cut, rng.integers(0, 1 << 63, size * share // 200, dtype=np.uint64))))
        inside = lambda a, b: len(np.intersect1d(a, b))
        side = np.arange(len(sets)), np.array([len(item) for item in sets]), [ngram_join.sketch(item) for item in sets]
        joined = ngram_join._joined(ngram_join.sketched_pairs(side, side, settings))[1]
        for a, b in combinations(range(len(sets)), 2):
            common = inside(sets[a], sets[b]) if abs(a - b) < 7 else 0
            if 100 * common >= settings.percent * (len(sets[a]) + len(sets[b]) - common):
                assert joined[a] == joined[b]
        # Sets without common shingles stay apart.
        large = [at for at in range(len(sets)) if len(sets[at]) > 30]
        assert all(joined.get(a, a) != joined.get(b, b) for a in large for b in large if a // 7 != b // 7)
