"""Hand-derived results of the text functions."""

import posixpath

from pyspark.sql import functions as F

from lexweave.functions import text


def test_normalize(column):
    given = ["  a\r\nb\rc\t\t d e\n\n\n\nf 　", "﻿", "a  b"]
    assert column(given, "t string", text.normalize_text("t")) == ["a\nb\nc d e\n\nf", "", "a b"]


def test_decode_is_ordered(column):
    given = ["&amp;lt;b&amp;gt; &quot;&#39;&nbsp;"]
    assert column(given, "t string", text.decode_entities("t")) == ["&lt;b&gt; \"'&nbsp;"]
    assert column(given, "t string", text.decode_entities("t", nbsp=True)) == ["&lt;b&gt; \"' "]


def test_title_and_date(column):
    given = [
        "<title>B</title><tittel>A &lt;x</tittel>",
        "<TITTEL1 id='1'> C </TITTEL1>",
        "<tittel></tittel><overskrift>D</overskrift>",
        "<p>no</p>",
        "<tittel>" + "x" * 300 + "</tittel>",
    ]
    assert column(given, "t string", text.extract_title("t")) == ["A <x", "C", "D", None, "x" * 200]
    assert column(["<published>1</published><dato> 2 </dato>"], "t string", text.extract_date("t")) == ["2"]


def test_year_quirk(column):
    given = [
        ("bare 2019 here", None),
        ("år: 2019", None),
        ("i 2018 år", None),
        ("år 1850, 2020 år", None),
        ("", "12.3.1987"),
        ("år 2001", "x19870"),
    ]
    schema = "t string, d string"
    assert column(given, schema, text.extract_year("t", "d")) == [None, 2019, 2018, 2020, 1987, 2001]
    assert column(given, schema, text.extract_year("t", "d", "any")) == [2019, 2019, 2018, 2020, 1987, 2001]


def test_code_points(column):
    given = ["a😀b" * 5]
    assert column(given, "t string", text.truncate_for_embedding("t", 10)) == ["a😀ba😀ba..."]
    assert column(given, "t string", text.truncate_for_embedding("t", 15)) == given


def test_labelled_values(column):
    given = ["x Departement: A  B tittel - C. D Titteldel RefID"]
    found = column(given, "t string", text.labelled_values("t"))[0]
    assert [(entry["label"], entry["value"]) for entry in found] == [
        ("Departement", "A B"), ("tittel", "C. D Titteldel"), ("RefID", ""),
    ]


def test_sections(column):
    given = ["§ 12b og kapittel 3", "Kapittel  4 PARAGRAF 5", "<kapittel x> Ny </kapittel>", "y" * 2000 + "§ 1"]
    assert column(given, "t string", text.section_number("t")) == ["12b", "5", "Ny", None]
    given = ["a\n## Head two\nb", "Under\n====\n", "<heading>&nbsp;</heading>\n# Next", "plain"]
    assert column(given, "t string", text.section_title("t")) == ["Head two", "Under", " ", None]


def test_embedding_text(column):
    row = [("T", None, "3", "c"), ("", "S", None, "c")]
    schema = "t string, s string, n string, c string"
    assert column(row, schema, text.embedding_text("t", "s", "n", "c")) == ["Dokument: T\n\n§3\n\nc", "Seksjon: S\n\nc"]


def test_shrink(column):
    found = column(["x" * 100, "x" * 60, "x" * 10], "t string", text.shrink_schedule("t", 20, 100))
    assert [(row["attempt"], row["limit"], row["text"]) if row else None for row in found] == [
        (3, 51, "x" * 48 + "..."), (0, 100, "x" * 60), (0, 100, "x" * 10),
    ]
    assert column(["x" * 100], "t string", text.shrink_schedule("t", 10, 100)) == [None]


def test_query_words(column):
    given = ["Lov om Ål-fiske, lov og ål12 ab"]
    assert column(given, "t string", text.query_words("t")) == [["lov", "fiske", "ål12"]]
    assert column(given, "t string", text.split_words("t")) == [["lov", "ål-fiske,", "lov", "ål12"]]


def test_window_snippet(column):
    body = "x" * 400 + " alpha beta " + "y" * 400
    found = column([(body, ["alpha", "beta"]), ("short alpha", ["zz"])], "t string, q array<string>", text.best_window_snippet("t", "q"))
    assert found[0].startswith("…") and found[0].endswith("…") and "alpha beta" in found[0]
    assert found[0] == "…" + body[300:450] + "…"
    assert found[1] == "short alpha"


def test_window_snippet_reads_the_whole_text(column):
    # the best window lies far behind the beginning, which has one of the words
    body = "Alpha " + "é🙂\n" * 4_000 + "z" * 60 + " alpha BETA " + "y" * 400
    schema, found = "t string, q array<string>", text.best_window_snippet("t", "q")
    start = body.index("alpha") // 100 * 100
    assert column([(body, ["alpha", "beta"])], schema, found) == ["…" + body[start : start + 150] + "…"]
    at_end = "x" * 250_030 + "omega"
    assert column([(at_end, ["omega"])], schema, found) == ["…" + at_end[249_900:250_050]]
    assert column([("", ["a"]), (None, ["a"]), ("ab", None)], schema, found) == ["", None, "ab"]
    near = text.best_window_snippet("t", "q", reach=10_000)
    assert column([(body, ["alpha", "beta"]), ("y" * 9_980 + "alpha" + "z" * 99, ["alpha"])], schema, near) == [
        body[:150] + "…", "…" + "y" * 80 + "alpha" + "z" * 65 + "…",
    ]

    def plain(body, wanted, width, step):
        scores = [sum(token in body[at : at + width] for token in wanted) for at in range(0, len(body), step)]
        at = scores.index(max(scores)) * step if max(scores) else 0
        return ("…" if at else "") + body[at : at + width] + ("…" if at + width < len(body) else "")

    body = "".join("abcdefgh"[at * at % 31 % 8] for at in range(3_000))
    for width, step in ((150, 100), (40, 50), (90, 30), (7, 7)):
        wanted = ["aebd", "hh", "cb", "b"]
        assert column([(body, wanted)], schema, text.best_window_snippet("t", "q", width, step)) == [plain(body, wanted, width, step)]


def test_truncate_middle(column):
    body = "a" * 50 + " " * 20 + "b" * 50
    assert column([body], "t string", text.truncate_middle("t", 100, 40)) == ["a" * 50 + "\n...\n" + "b" * 40]
    assert column([body], "t string", text.truncate_middle("t", 30, 40)) == ["b" * 40]
    assert column([None], "t string", text.truncate_middle("t", 30, 40)) == [None]


def test_storage_path(column):
    given = ["a/b.xml", "../../x", "/abs//p", "a/../b", "a/b/../../c", "./d", "q?<>:\"|*\x01z", "..\\..\\w", "a\\b"]
    found = column(given, "m string", text.storage_path(F.lit("z.zip"), "m"))
    assert found == [
        "z.zip/a/b.xml", "z.zip/x", "z.zip/abs/p", "z.zip/b", "z.zip/c", "z.zip/d", "z.zip/qz", "z.zip/w", "z.zip/a/b",
    ]
    inside = [path for path in given if "\\" not in path and "?" not in path]
    for path in inside:
        expected = posixpath.normpath("/" + path).lstrip("/")
        assert "z.zip/" + expected in found


def test_is_html(column):
    given = ["<HTML>", "<!DocType html>", "x" * 1000 + "<html", None, ""]
    assert column(given, "t string", text.is_html("t")) == [True, True, False, False, False]
