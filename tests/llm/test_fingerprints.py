import hashlib
import random
import re
from collections import Counter

import xxhash

from lexweave.llm import fingerprints
from pyspark.sql import functions as F
from llm_fixtures import none, odd  # noqa: F401

K, S, UNIT = fingerprints.K, fingerprints.S, fingerprints.UNIT


def signed(value):
    return value - (1 << 64) if value >= 1 << 63 else value


def hashed(*values):
    """Spark's hash of longs in a row, or of one string."""
    seed = 42
    for value in values:
        data = value.encode() if isinstance(value, str) else value.to_bytes(8, "little", signed=True)
        seed = xxhash.xxh64_intdigest(data, seed)
    return signed(seed)


def brute_anchors(text):
    words = [hashed(unit) for unit in re.findall(r"[^\x20\x09-\x0D]{1,%d}" % UNIT, text)]
    if not words:
        return []
    if len(words) < S:
        runs = [hashed(*words)]
    else:
        runs = [hashed(*words[i : i + S]) for i in range(len(words) - S + 1)]
    inner = K - S
    if len(runs) <= inner:
        return [(hashed(*runs), 0)]
    out = []
    for i in range(len(runs) - inner):
        window = runs[i : i + inner + 1]
        if min(window) in (window[0], window[-1]):
            out.append((hashed(*window[0 :: S], window[-1]), i))
    return out


def corpus():
    rng = random.Random(9)
    words = [f"wört{i}" for i in range(40)] + ["x" * 50, "日本語"]
    texts = [" ".join(rng.choice(words) for _ in range(n)) for n in (0, 1, 2, 3, 4, 5, 6, 7, 20, 21, 60, 200)]
    return texts + [None, "", " \t\n", texts[8], texts[8], "a\x00b 🙂 c", "one two three four five"]


def test_anchors_against_brute_force(spark):
    docs = spark.createDataFrame([(text or "",) for text in corpus()], "text string")
    for row in docs.select("text", fingerprints.anchors(F.col("text")).alias("found")).collect():
        assert [tuple(item) for item in row["found"]] == brute_anchors(row["text"])


def test_edits_against_brute_force(spark):
    texts = corpus()
    ids = [7 * at for at in range(len(texts))]
    docs = spark.createDataFrame(list(zip(ids, texts, strict=True)), "doc_id long, text string")
    jaccard = lambda a, b: 1.0 if not a | b else len(a & b) / len(a | b)
    sets = lambda text: {anchor for anchor, _ in brute_anchors(text)}
    plain = [text or "" for text in texts]
    want = {}
    for at, text in enumerate(plain):
        following = plain[at - 1]  # descending ids; before the first comes the last
        half = len(text) // 2
        changed = text[: len(text) - half] + following[:half]
        want[ids[at]] = (
            hashlib.sha256(changed.encode()).hexdigest(), jaccard(sets(text), sets(changed)), jaccard(sets(text), sets(following))
        )
    for rows in (1, 3, 2000):
        old, fingerprints.with_next.__defaults__ = fingerprints.with_next.__defaults__, (rows, 100_000)
        try:
            found = fingerprints.fingerprint_edits(docs).select(
                "doc_id", F.sha2(F.encode("edited_text", "UTF-8"), 256),
                fingerprints.likeness(F.col("anchors"), F.col("edited_anchors")),
                fingerprints.likeness(F.col("anchors"), F.col("next_anchors")), fingerprints.digest(F.col("anchors")),
            ).collect()
        finally:
            fingerprints.with_next.__defaults__ = old
        assert {row[0]: tuple(row)[1:4] for row in found} == want
        names = {row[0]: row[4] for row in found}
        assert names[ids[8]] == names[ids[15]] == names[ids[16]]


def test_a_shared_passage_has_its_anchors_anywhere(spark):
    passage = " ".join(f"p{i}" for i in range(60))
    docs = spark.createDataFrame([(1, "some words before " + passage), (2, passage + " and after")], "doc_id long, text string")
    rows = fingerprints.anchor_rows(docs)
    best = fingerprints.match_positions(rows.where("doc_id = 1"), rows.where("doc_id = 2")).orderBy(F.desc("matches")).first()
    assert best["shift"] == -3 and best["matches"] >= 20


def test_odd_rows(spark, odd, none):
    docs = odd(["a b c d e f", None, "", "a b c d e f"])
    found = fingerprints.fingerprint_edits(docs).collect()
    assert len(found) == docs.count()
    assert Counter(row["doc_id"] for row in found) == Counter(row["doc_id"] for row in docs.collect())
    assert all(row["next_anchors"] is not None for row in found)
    single = fingerprints.fingerprint_edits(docs.limit(1)).first()
    assert single["anchors"] == single["next_anchors"]
    assert fingerprints.fingerprint_edits(none).count() == 0


def test_ids_over_the_whole_long_range(spark):
    """Hashed ids, an outlier beside crowded ids, nulls: the ranges are bounded and the order is kept."""
    low, high = -(1 << 63), (1 << 63) - 1
    rng = random.Random(4)
    for ids in ([low, high, *(rng.randrange(low, high) for _ in range(300))], [*range(400), high], [low, None, None, 5]):
        docs = spark.createDataFrame([(at, f"text {place}") for place, at in enumerate(ids)], "doc_id long, text string")
        placed = fingerprints.with_next(docs, range_rows=10)
        sizes = [row["count"] for row in placed.groupBy("range").count().collect()]
        assert max(sizes) <= 40 and (len(ids) < 100 or len(sizes) > 10)
        found = {row["text"]: row["edited_text"] for row in fingerprints.fingerprint_edits(docs).collect()}
        order = sorted(range(len(ids)), key=lambda at: (ids[at] is not None, ids[at] or 0, f"text {at}"), reverse=True)
        for at, following in zip(order, order[1:] + order[:1], strict=True):
            text, other = f"text {at}", f"text {following}"
            half = len(text) // 2
            assert found[text] == text[: len(text) - half] + other[:half]


def test_range_of_many_ends(spark):
    ends = sorted(random.Random(3).sample(range(-500, 500), 90))
    values = list(range(-520, 520)) + [None]
    rows = spark.createDataFrame([(value,) for value in values], "v long")
    for chosen in (ends, ends[:1], []):
        found = rows.where("v is not null").select("v", fingerprints.range_of(F.col("v"), chosen)).collect()
        assert all(at == sum(end < value for end in chosen) for value, at in found)
