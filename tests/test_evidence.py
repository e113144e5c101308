"""Evidence, prompts and answers."""

import pytest
from pyspark.sql import functions as F

from lexweave.functions import fixed_values as fixed
from lexweave.operators import evidence as ev
from lexweave.plans import assistant

COLUMNS = (
    "question_id long, search_seq int, seq int, id string, source string, title string, snippet string, "
    "date string, link string, filename string, member string"
)


def evidence(spark, rows):
    defaults = dict(question_id=1, search_seq=1, source="law", title="T", snippet="s", date=None, link=None, filename="f", member="m.xml")
    made = []
    for at, row in enumerate(rows):
        made.append({**defaults, "seq": at + 1, "id": f"e{at + 1}", **row})
    return spark.createDataFrame([tuple(row[name.split()[0]] for name in COLUMNS.split(", ")) for row in made], COLUMNS)


def ids(df):
    return sorted(row["id"] for row in df.collect())


def test_dedupe(spark):
    rows = evidence(
        spark,
        [{}, {}, {"snippet": "s" + "x" * 99 + "a"}, {"snippet": "s" + "x" * 99 + "b"}, {"title": None}, {"title": ""}, {"member": None}, {"question_id": 2}],
    )
    assert ids(ev.dedupe_evidence(rows)) == ["e1", "e3", "e5", "e7", "e8"]
    assert ids(ev.dedupe_evidence(rows, simple_key=True)) == ["e1", "e7", "e8"]


def test_dedupe_by_link(spark):
    rows = evidence(spark, [{"link": "a"}, {"link": None}, {"link": "a"}, {"link": ""}, {"link": "b"}])
    assert ids(ev.dedupe_by_link(rows)) == ["e1", "e5"]


def test_refine(spark):
    rows = evidence(spark, [{}, {"source": "web"}, {"search_seq": 2}, {"source": "web", "search_seq": 3}, {"question_id": 2}])
    assert ids(ev.refine_evidence(rows)) == ["e3", "e4", "e5"]
    assert ids(ev.refine_evidence(rows, replaced=["law"])) == ["e2", "e3", "e4", "e5"]


def test_hydrate(spark):
    documents = spark.createDataFrame(
        [("f", "a.xml", "A"), ("f", "b.html", "B"), ("f", "c.xml", "C1"), ("f", "c.html", "C2"), ("f", "d.txt", "x" * 300)],
        "archive_filename string, member string, content string",
    )
    rows = evidence(
        spark,
        [{"member": "a.xml"}, {"member": "a.html"}, {"member": "b.html"}, {"member": "c.html"}, {"member": "b.xml"},
         {"member": "d.txt"}, {"member": "none.xml"}, {"member": None, "link": "kept"}],
    )
    found = {row["id"]: row for row in ev.hydrate_evidence(rows, documents, "https://v", 200).collect()}
    assert len(found) == 8
    assert [found[f"e{at}"]["content"] for at in (1, 2, 3, 4, 5, 7, 8)] == ["A", "A", "B", "C1", None, None, None]
    assert found["e1"]["member"] == "a.html" and found["e1"]["link"].endswith("member=a.html")
    assert found["e8"]["link"] == "kept" and found["e6"]["content"] == "x" * 200 or len(found["e6"]["content"]) > 0


def prompt_rows(spark, contents):
    rows = evidence(spark, [{"snippet": None, "date": "d", "link": "l"} for _ in contents])
    values = spark.createDataFrame([(f"e{at + 1}", body) for at, body in enumerate(contents)], "id string, content string")
    return rows.join(values, "id")


def test_pack_context(spark):
    questions = spark.createDataFrame([(1, "  Hva? "), (2, "tom")], "question_id long, question string")
    found = {r["question_id"]: r["prompt"] for r in ev.pack_context(questions, prompt_rows(spark, ["kort", None])).collect()}
    assert found[1] == (
        "Brukerspørsmål: Hva?\n\nTilgjengelige kilder:\n"
        "ID: e1\nKilde: law\nTittel: T\nDato: d\nLenke: l\nInnhold:\nkort\n\nID: e2\nKilde: law\nTittel: T\nDato: d\nLenke: l" + fixed.PROMPT_END
    )
    assert found[2] == "Brukerspørsmål: tom" + fixed.PROMPT_NO_SOURCES


def test_pack_context_halves_when_too_long(spark):
    questions = spark.createDataFrame([(1, "q")], "question_id long, question string")
    found = ev.pack_context(questions, prompt_rows(spark, ["x" * 9000] * 40)).first()["prompt"]
    assert "Dato" not in found and len(found) <= 50000 and found.count("ID: ") == 40
    few = ev.pack_context(questions, prompt_rows(spark, ["x" * 9000] * 3)).first()["prompt"]
    assert few.count("x" * 2500 + fixed.SHORTENED_MARKER + "x" * 500) == 3


def test_no_more_than_the_allowed_evidence(spark):
    questions = spark.createDataFrame([(1, "q")], "question_id long, question string")
    found = ev.pack_context(questions, prompt_rows(spark, ["y"] * 130)).first()["prompt"]
    assert found.count("ID: ") == 100
    fewer = ev.pack_context(questions, prompt_rows(spark, ["y" * 3000] * 130), limit=7, max_content=1000).first()["prompt"]
    assert fewer.count("ID: ") == 7 and "y" * 501 not in fewer


RAW = [
    (' {"answer": "a", "citations": [{"evidenceId": "e1", "quote": "q"}, {"evidenceId": 3}, "x"]} end', "a", [("e1", "q")]),
    ("text only ", "text only", None),
    ('{"answer": 5}', None, None),
    ('{"answer": "x", "citations": {"a": 1}}', "x", None),
    (' {"answer": ', '{"answer":', None),
    ("{broken} ", "{broken} ", None),
    ("} {", "} {", None),
    ('{"answer": null, "citations": []}', None, []),
]


@pytest.mark.parametrize("at", range(len(RAW)))
def test_parse_answer(spark, at):
    raw, answer, citations = RAW[at]
    row = ev.parse_answer_json(spark.createDataFrame([(raw,)], "raw string")).first()
    found = None if row["citations"] is None else [tuple(entry) for entry in row["citations"]]
    assert (row["answer"], found) == (answer, citations)


def test_citations_and_replies(spark):
    rows = evidence(spark, [{}, {}, {"question_id": 2, "id": "e1"}])
    questions = spark.createDataFrame([(1,), (2,)], "question_id long")
    raw = spark.createDataFrame(
        [(1, '{"answer": "se https://x/a). Ja", "citations": [{"evidenceId": "e2"}, {"evidenceId": "zz"}]}'), (2, "bare tekst")],
        "question_id long, raw string",
    )
    answers, citations = assistant.replies(questions, raw, rows, page=2, page_size=10)
    assert {row["question_id"]: row["answer"] for row in answers.collect()} == {1: "se https://x/a Ja", 2: "bare tekst"}
    found = sorted((row["question_id"], row["evidence_id"], row["label"]) for row in citations.collect())
    assert found == [(1, "e2", "[12]"), (2, "e1", "[11]")]


def test_summary(spark):
    rows = evidence(spark, [{"title": f"T{at}"} for at in range(6)] + [{"source": "web", "question_id": 2, "title": None}])
    questions = spark.createDataFrame([(1,), (2,), (3,)], "question_id long")
    found = {r["question_id"]: r["answer"] for r in ev.fallback_summary(questions, rows, "law", "Law").collect()}
    assert found[1].split("\n")[1:] == [f"- T{at} (Law)" for at in range(5)]
    assert found[2].endswith("\n- Uten tittel") and found[3] == fixed.SUMMARY_EMPTY


def test_stats(spark):
    rows = evidence(spark, [{}, {"source": "web"}, {"source": "x"}] * 7)
    assert tuple(ev.evidence_stats(rows, ["law", "web"]).first()) == (1, 21, 7, 7, 7, 3)


def test_web_evidence(spark):
    results = spark.createDataFrame(
        [(1, 1, 1, "A", "https://x/lov/1)."), (1, 1, 2, None, "https://x/sok/"), (1, 1, 3, None, None), (1, 1, 4, None, "https://x/dom/2")],
        "question_id long, search_seq int, rank int, title string, link string",
    ).withColumns({"snippet": F.lit("s"), "date": F.lit(None).cast("string")})
    found = sorted((r["id"], r["title"], r["link"]) for r in ev.web_to_evidence(results, "web", "w").collect())
    assert found == [("w-1-1", "A", "https://x/lov/1"), ("w-1-2", "Uten tittel", "https://x/dom/2")]
