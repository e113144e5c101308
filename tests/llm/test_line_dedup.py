import random
import re

import xxhash

from lexweave.llm import line_dedup
from llm_fixtures import none, odd  # noqa: F401


def signed(value):
    return value - (1 << 64) if value >= 1 << 63 else value


def xx(seed, data):
    return xxhash.xxh64_intdigest(data, seed % (1 << 64))


def brute_chunks(text):
    lines = text.split("\n")
    hashes = [signed(xx(42, line.encode())) for line in lines]
    value = lambda at: hashes[at].to_bytes(8, "little", signed=True) if at >= 0 else (0).to_bytes(4, "little")
    hit = [signed(xx(xx(42, value(i)), value(i - 1) if i else (0).to_bytes(8, "little"))) % line_dedup.DIVISOR == 0 for i in range(len(lines))]
    last, out, start = len(lines) - 1, [], 0
    for i in range(len(lines)):
        if i == last or (hit[i] and i > 0 and not hit[i - 1] and i < last - 1):
            out.append("\n".join(lines[start : i + 1]))
            start = i + 1
    return out


def brute(docs):
    owner, result = {}, {}
    for doc_id in sorted(d for d, _ in docs if d is not None):
        text = dict(docs)[doc_id]
        if text is None or "\n" not in text:
            result[doc_id] = text
            continue
        kept = []
        for part in brute_chunks(text):
            counts = "\n" in part and any(c.isalnum() for c in part)
            if counts and part in owner:
                continue
            owner[part] = doc_id
            kept.append(part)
        result[doc_id] = "\n".join(kept)
    return result


def brute_registered(docs, words=line_dedup.PASSAGE_WORDS):
    """Chunks of several lines and passages of whole lines together, as the query and the pipeline ask for them; ids are unique."""
    runs = {}
    for doc_id, text in docs:
        if doc_id is None or text is None:
            continue
        lines, spans, at = text.split("\n"), set(), 0
        for part in brute_chunks(text):
            upto = at + part.count("\n") + 1
            if upto - at > 1:
                spans.add((at, upto))
            at = upto
        counts = [len(re.findall(r"[^\x20\x09-\x0D]+", line)) for line in lines]
        for i, count in enumerate(counts):
            if count > words:
                spans.add((i, i + 1))
                continue
            spans |= set([(i, j) for j in range(i + 1, len(lines) + 1) if sum(counts[i:j]) > words][:1])
            spans |= set([(j, i + 1) for j in range(i, -1, -1) if sum(counts[j : i + 1]) > words][:1])
        runs[doc_id] = {span for span in spans if any(c.isalnum() for c in "".join(lines[span[0] : span[1]]))}
    first = {}
    texts = dict(docs)
    for doc_id in sorted(runs):
        for a, b in sorted(runs[doc_id]):
            first.setdefault("\n".join(texts[doc_id].split("\n")[a:b]), (doc_id, a, b))
    result = dict(docs)
    for doc_id, spans in runs.items():
        lines, gone = texts[doc_id].split("\n"), set()
        for a, b in spans:
            if first["\n".join(lines[a:b])] != (doc_id, a, b):
                gone |= set(range(a, b))
        result[doc_id] = "\n".join(line for at, line in enumerate(lines) if at not in gone)
    return result


def test_registered_setting_against_brute_force(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    docs = [(row["doc_id"], row["text"]) for row in table.select("doc_id", "text").collect()]
    found = line_dedup.dedup_lines(table.select("doc_id", "text"), words=line_dedup.PASSAGE_WORDS).collect()
    assert {row["doc_id"]: row["text"] for row in found} == brute_registered(docs)


def corpus():
    rng = random.Random(3)
    passages = [[f"passage {p} line {i} of words" for i in range(9)] for p in range(4)]
    docs = []
    for doc_id in range(60):
        lines = [f"own {doc_id} {i}" for i in range(rng.randrange(1, 12))]
        if rng.random() < 0.6:
            at = rng.randrange(len(lines) + 1)
            lines[at:at] = rng.choice(passages)
        docs.append((doc_id, "\n".join(lines)))
    docs += [(60, docs[5][1]), (61, docs[5][1]), (62, ""), (63, None), (64, "one line"), (65, "one line"), (66, "\n\n\n"), (67, "\n\n\n")]
    return docs + [(68, "x\n" * 5000 + "end")]


def test_against_brute_force(spark):
    docs = corpus()
    found = line_dedup.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert {row["doc_id"]: row["text"] for row in found} == brute(docs)
    by_id = {row["doc_id"]: row for row in found}
    assert by_id[60]["text"] == "" and by_id[61]["removed_chunks"] > 0


def test_chunks_give_the_text_back(spark):
    docs = spark.createDataFrame([(at, text) for at, text in corpus() if text is not None], "doc_id long, text string")
    rows = docs.select("text", line_dedup.chunks(docs.text).alias("parts")).collect()
    assert all("\n".join(row["parts"]) == row["text"] for row in rows)
    assert all("\n" in part for row in rows for part in row["parts"] if "\n" in row["text"])


def test_odd_rows_and_columns(spark, odd, none):
    docs = odd(["a b\nc d\ne f\ng h", None, "", "a b\nc d\ne f\ng h", "z"])
    found = line_dedup.dedup_lines(docs)
    assert found.columns == [*docs.columns, "removed_chunks"] and found.count() == docs.count()
    assert line_dedup.dedup_lines(none).count() == 0


def brute_passages(docs, words):
    """Without chunks: a line goes if it stands in a run of lines with more words that starts earlier elsewhere."""
    seen, result = set(), {}
    for doc_id, text in sorted(docs):
        lines = text.split("\n")
        gone, spans = set(), [(i, j) for i in range(len(lines)) for j in range(i, len(lines))]
        for i, j in spans:
            run = "\n".join(lines[i : j + 1])
            if len(run.split()) > words:
                if run in seen:
                    gone.update(range(i, j + 1))
                seen.add(run)
        result[doc_id] = "\n".join(line for at, line in enumerate(lines) if at not in gone)
    return result


def test_passages_between_random_neighbours(spark):
    rng = random.Random(8)
    line = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    passages = [[line(rng.choice([20, 30, 45])) for _ in range(n)] for n in (2, 3, 4, 5) for _ in range(6)]
    passages += [[line(60)] for _ in range(4)] + [[line(30), "", line(30), line(5), ""], [line(5)] * 30, [line(50)], [line(8), line(9)]]
    docs = []
    for doc_id in range(150):
        lines = [line(rng.randrange(0, 40)) for _ in range(rng.randrange(0, 6))]
        for _ in range(rng.randrange(3)):
            at = rng.randrange(len(lines) + 1)
            lines[at:at] = rng.choice(passages)
        docs.append((doc_id, "\n".join(lines)))
    docs += [(150, "\n".join(passages[-5])), (151, line(70)), (152, docs[-1][1])]
    docs.append((153, docs[151][1]))
    never = 2**31 - 1  # no boundary inside a text: the brute force knows no chunks
    found = line_dedup.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string").repartition(7), divisor=never, words=50)
    want = brute_passages(docs, 50)
    # A whole text of two lines or more is still one chunk, however few words it has.
    first = {}
    for doc_id, text in docs:
        if "\n" in text and first.setdefault(text, doc_id) != doc_id and any(c.isalnum() for c in text):
            want[doc_id] = ""
    assert sum(text != dict(docs)[doc_id] for doc_id, text in want.items()) > 60
    assert {row["doc_id"]: row["text"] for row in found.collect()} == want


def test_query_and_stage_take_whole_passages(spark, tmp_path):
    import corpus_pipeline
    from lexweave.llm import queries

    rng = random.Random(2)
    line = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    passages = [[line(30) for _ in range(n)] for n in (2, 3, 4, 5)] + [[line(51)]]
    own = [[line(9), line(9)] for _ in range(40)]
    docs = [(at, "\n".join([own[at][0], *passages[at % 5], own[at][1]]), "x", "y", 0) for at in range(40)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    want = {at: docs[at][1] if at < 5 else "\n".join(own[at]) for at in range(40)}
    for found in (
        queries.QUERIES["op8_line_dedup"](spark, str(tmp_path)),
        corpus_pipeline.drop_repeated_lines(spark, spark.read.parquet(str(tmp_path / "documents.parquet")), str(tmp_path)),
    ):
        assert {row["doc_id"]: row["text"] for row in found.collect()} == want


def test_texts_that_share_an_id(spark):
    # The second text of id 2 repeats the text of id 1; the first has other lines at these places.
    rows = [(1, "a b\nc d"), (2, "e f\ng h"), (2, "a b\nc d"), (2, "a b\nc d")]
    found = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted((row["doc_id"], row["text"]) for row in found.collect()) == [(1, "a b\nc d"), (2, ""), (2, ""), (2, "e f\ng h")]
