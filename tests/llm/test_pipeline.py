import zlib
from collections import defaultdict

import corpus_pipeline
import pytest

from lexweave.llm import packing
from test_line_dedup import brute_registered

SMALL = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    found = [("documents", docs)]
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.materialize(stage(spark, docs, SMALL), "test-stage")
        found.append((name, docs))
    return found


def test_names_and_columns(stages):
    assert [name for name, _ in stages[1:]] == ["toxicity", "quality", "line_dedup", "near_duplicates", "packing"]
    assert all(docs.columns == corpus_pipeline.COLUMNS for _, docs in stages[1:-1])


def test_filters_keep_clean_documents(spark, stages):
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    for at, (name, bad) in enumerate((("toxicity", "toxic = 1"), ("quality", "quality = 0")), start=1):
        before, after = stages[at - 1][1].select("doc_id"), stages[at][1].select("doc_id")
        clean = labels.where("toxic = 0 and quality = 1").join(before, "doc_id")
        assert clean.join(after, "doc_id").count() >= 0.9 * clean.count()
        rejected = labels.where(bad).join(before, "doc_id").join(after, "doc_id", "left_anti").count()
        assert rejected >= 0.6 * labels.where(bad).join(before, "doc_id").count()


def test_lines_and_groups_against_brute_force(stages):
    texts = [{row["doc_id"]: row["text"] for row in docs.collect()} for _, docs in stages[2:5]]
    cleaned = brute_registered(list(texts[0].items()))
    assert texts[1] == {at: text for at, text in cleaned.items() if text or not texts[0][at]}
    ids = sorted(texts[1])
    kept = {ids[place] for place in near_groups([texts[1][at] for at in ids], 5, 0.8)}
    assert set(texts[2]) == kept and all(texts[2][at] == texts[1][at] for at in kept)


def test_packing_holds_every_token(stages):
    encoder, pieces = packing.token_encoder(), defaultdict(list)
    for row in stages[-1][1].collect():
        pieces[row["doc_id"]].append((row["start"], row["length"], row["ids_crc32"]))
    texts = {row["doc_id"]: row["text"] for row in stages[-2][1].collect()}
    assert set(pieces) == set(texts)
    for doc_id, parts in pieces.items():
        ids = [*encoder.encode_ordinary(texts[doc_id]), packing.END]
        assert sum(length for _, length, _ in parts) == len(ids)
        for start, length, crc in parts:
            part = b"".join(at.to_bytes(4, "little") for at in ids[start : start + length])
            assert zlib.crc32(part) == crc


def test_no_documents(spark, tmp_path):
    for name in ("documents", "labels"):
        spark.read.parquet(f"{SMALL}/{name}.parquet").limit(0).write.parquet(str(tmp_path / f"{name}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def near_groups(texts, words, share):
    """Kept places under shingles of so many words, by comparing all pairs."""
    sets = []
    for text in texts:
        found = text.lower().split()
        sets.append({tuple(found[i : i + words]) for i in range(max(1, len(found) - words + 1))} if found else set())
    group = list(range(len(texts)))
    for b in range(len(sets)):
        for a in range(b):
            common = len(sets[a] & sets[b])
            if common and common >= share * (len(sets[a]) + len(sets[b]) - common):
                old, new = max(group[a], group[b]), min(group[a], group[b])
                group = [new if at == old else at for at in group]
    return [at for at, first in enumerate(group) if at == first]


def test_near_duplicates_at_five_words_and_four_fifths(spark):
    texts = []
    for base in range(20):
        words = [f"b{base}w{i}" for i in range(60)]
        texts.append(" ".join(words))
        # Edits in the middle cost five shingles each: from equal to well below the bound.
        for edits in range(1, 5):
            changed = [f"e{edits}" if i % 14 == 13 and i // 14 < edits else word for i, word in enumerate(words)]
            texts.append(" ".join([*changed, *[f"t{base}e{edits}n{i}" for i in range(base % 5)]]))
    rows = [(at, text, "x", "y", len(text)) for at, text in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    found = sorted(row["doc_id"] for row in corpus_pipeline.keep_one_of_near_duplicates(spark, docs, SMALL).collect())
    want = near_groups(texts, 5, 0.8)
    assert found == want and want != near_groups(texts, 4, 0.85)
