import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexweave.llm import divergence

BILLION = 1000000000


def brute(rows, min_documents=3, top=200):
    """The contract over (text, lang, source) rows, term by term."""
    counts, seen = defaultdict(Counter), defaultdict(Counter)
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        found = Counter(re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", lowered))
        counts[lang, source].update(found)
        seen[lang].update(found.keys())
    result = set()
    for lang in {lang for lang, _ in counts}:
        kept = [term for term, n in seen[lang].items() if n >= min_documents]
        sources = [source for at, source in counts if at == lang]

        def shares(count, kept=kept):
            total = sum(count[term] for term in kept) + len(kept)
            return {term: 1 + BILLION * (count[term] + 1) // total for term in kept}

        whole = shares(sum((counts[lang, source] for source in sources), Counter()))
        by = {source: shares(counts[lang, source]) for source in sources}
        for source in sources:
            p = by[source]
            pairs = [(sum((p[t] - by[o][t]) ** 2 // by[o][t] for t in kept), o) for o in sources if o != source]
            terms = [((p[t] - whole[t]) ** 2 // whole[t], t) for t in kept if counts[lang, source][t] and p[t] > whole[t]]
            for part, found, limit in (("pair", pairs, None), ("term", terms, top)):
                ranked = sorted(found, key=lambda x: (-x[0], x[1].encode()))[:limit]
                result |= {(lang, source, part, item, value, at) for at, (value, item) in enumerate(ranked, start=1)}
    return result


def rows_of(found):
    rows = [tuple(row[name] for name in ("lang", "source", "part", "item", "value", "rank")) for row in found.collect()]
    assert len(set(rows)) == len(rows)
    return set(rows)


def made(seed, documents, sources, words):
    rng = random.Random(seed)
    vocabulary = ["w" + chr(97 + i % 26) * (1 + i // 26) for i in range(words)] + ["ÜBER", "naïve", "Δέλτα", "语言"]
    rows = []
    for _ in range(documents):
        source = min(int(rng.expovariate(0.5)), sources - 1)
        text = " ".join(rng.choice(vocabulary[source % 5 :]) + rng.choice(["", ",", "1", "\n"]) for _ in range(rng.randrange(0, 60)))
        rows.append((text, rng.choice(["en", "de"]), f"s{source}"))
    return rows


def frame(spark, rows):
    return spark.createDataFrame(rows, "text string, lang string, source string").withColumn("doc_id", F.monotonically_increasing_id())


@pytest.mark.parametrize(("documents", "sources", "words"), [(60, 3, 30), (300, 9, 80), (200, 1, 20)])
def test_against_brute_force(spark, documents, sources, words):
    rows = made(documents, documents, sources, words)
    assert rows_of(divergence.audit(frame(spark, rows))) == brute(rows)


def test_whole_table_against_brute_force(spark):
    table = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(row["text"], row["lang"], row["source"]) for row in table.collect()]
    assert rows_of(divergence.audit(table)) == brute(rows)


def test_small_slices_give_the_same(spark, monkeypatch):
    # Tasks run in other processes, so the tree is cut here instead.
    rng = np.random.default_rng(4)
    paths = Counter()
    for _ in range(400):
        places = sorted(rng.choice(6, rng.integers(1, 6), replace=False).tolist())
        paths[tuple((place, int(rng.integers(1, 3)) * 100 + 7) for place in places)] += 1
    ordered = sorted(paths)

    def sums(groups):
        total = Counter()
        for group in groups:
            length = np.array([len(path) for path in group])
            place, p = (np.ones((len(group), int(length.max())), np.int64) for _ in range(2))
            for at, path in enumerate(group):
                place[at, : len(path)], p[at, : len(path)] = zip(*path, strict=True)
            terms = np.array([paths[path] for path in group])
            for deep, above, forth, back, passing in divergence.tree_corrections(place, p, np.full_like(p, 3), length, terms):
                for name, value in divergence._exact_sums(deep << 32 | above, forth, passing):
                    total[name] += value
                for name, value in divergence._exact_sums(above << 32 | deep, back, passing):
                    total[name] += value
        return total

    want = Counter()
    f = lambda p, q: (p - q) ** 2 // q
    for path, n in paths.items():
        for a, p in path:
            for b, q in path:
                if a != b:
                    want[a << 32 | b] += n * (f(p, q) - f(p, 3) - f(3, q) + f(3, 3))
    assert sums([ordered]) == want
    assert sums([ordered[at : at + 7] for at in range(0, len(ordered), 7)]) == want


def test_exact_sums_do_not_overflow():
    corrections = np.array([-4 * 10**18, 4 * 10**18, 123456789012345678], np.int64)
    terms = np.array([10**9, 10**9 + 1, 7], np.int64)
    found = dict(divergence._exact_sums(np.array([1, 1, 2]), corrections, terms))
    assert found == {1: 4 * 10**18, 2: 7 * 123456789012345678}


def test_odd_rows(spark):
    rows = [
        (None, None, None), ("", "en", None), ("One one ONE", "en", "a"), ("one", "en", "b"), ("one, two", "en", "b"),
        ("two two", "en", "c"), ("two", "en", "c"), ("nothing else", "fr", "x"), ("123 456", "fr", "y"), ("one", None, "a"),
        ("k" * 200000 + " one", "en", "a"),
    ]
    docs = frame(spark, rows).withColumns({"term": F.lit("x"), "value": F.lit(1), "rank": F.lit(None), "place": F.lit(2), "n": F.lit(0)})
    found = rows_of(divergence.audit(docs))
    assert found == brute(rows)
    assert ("fr", "x", "pair", "y", 0, 1) in found and ("", "", "pair", "a", 0, 1) in found


def test_ties_are_ranked_by_bytes(spark):
    rows = [("a é z 语 𝔘", "en", "s")] * 3 + [("q q q q", "en", "t")] * 3
    found = sorted((row[5], row[3]) for row in rows_of(divergence.audit(frame(spark, rows))) if row[1:3] == ("s", "term"))
    assert [item for _, item in found] == sorted((item for _, item in found), key=str.encode) and len(found) == 5


def test_no_documents(spark):
    assert divergence.audit(frame(spark, [])).count() == 0


def test_top_terms(spark):
    rows = made(9, 200, 4, 60)
    assert rows_of(divergence.audit(frame(spark, rows), top_terms=5)) == brute(rows, top=5)
