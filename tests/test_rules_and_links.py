"""Rule lists and links: boundaries, order and the odd cases."""

from pyspark.sql import functions as F

from lexweave.functions import links, rules


def test_boundaries_are_ascii(column):
    given = ["lovå", "ålov", "lov", "lover", "en lov.", "_lov"]
    # å is no ASCII word character, so a boundary stands next to it
    assert column(given, "t string", rules.has_word("t", "lov")) == [True, True, True, False, True, False]


def test_law_type(column):
    given = [
        ("Forskrift om lov", "x"),
        ("Ukjent", "et vedtak og en lov"),
        (None, "Folketrygdloven gjelder"),
        (None, "folketrygdloven gjelder"),
        (None, "CIRKULÆR nr. 3"),
        (None, "a circular letter"),
        ("", "rundskriv"),
        (None, "ingenting"),
    ]
    assert column(given, "t string, c string", rules.classify_law_type("t", "c")) == [
        "Lov", "Lov", "Lov", None, "Cirkulær", "Cirkulær", "Rundskriv", None,
    ]


def test_ministry(column):
    given = ["fra FD", "Justis-og beredskapsdepartementet", "Landbruks- og matdepartementet sier", "asdf", "Kulturdepartement"]
    assert column(given, "c string", rules.extract_ministry(F.lit(None).cast("string"), "c")) == [
        "Finansdepartementet", "Justis- og beredskapsdepartementet", "Landbruks- og matdepartementet", None, None,
    ]


def test_sifting_equals_the_rule_chain(column):
    listed = rules.document_ministry_rules()
    given = [" ".join(names) for names in (["ud", "hod"], ["xud", "ud"], ["oed.", "asd"], [], ["barne-  og familiedepartementet", "bfd"])]
    assert column(given, "c string", rules.first_rule_of_long_text("c", listed)) == column(
        given, "c string", rules.first_rule("c", listed)
    )


def test_query_filters(column):
    given = ["forskrift til lov om x", "Forskrift til\nny lov", "lov fra 1991", "2018 lov", "kun 2018", "vedtak i 1899", "justisdepartementet"]
    assert column(given, "q string", rules.query_law_type("q")) == [
        "Forskrift", "Forskrift", "Lov", "Lov", None, "Vedtak", None,
    ]
    assert column(given, "q string", rules.query_year("q")) == [None, None, 1991, 2018, None, None, None]
    assert column(given, "q string", rules.query_year("q", bare_year=True))[4] == 2018
    assert column(given, "q string", rules.query_ministry("q"))[6] == "Justis- og beredskapsdepartementet"


def test_core_terms(column):
    given = ["Forskrift til lov om register", "lov om  arv", "forskrift om skatt", "Lov om ", "om lov om"]
    assert column(given, "q string", rules.core_terms("q")) == ["register", "arv", "skatt", "Lov om ", "om lov om"]


def test_expansion(column):
    found = column(["Ekteskap, (leie) x"], "q string", rules.expand_terms("q"))[0]
    assert found == "Ekteskap, (leie) x ekteskapsloven ekteskapsloven ekteskapsrett ekteskapsbrudd husleieloven leieforhold leierett"
    assert column(["arveloven"], "q string", rules.expand_terms("q")) == ["arveloven lov om arv arvelov"]


def test_base_law(column):
    base = "Lov 4. juli 1991 nr. 47 om ekteskap"
    given = [
        (base, "ekteskapsloven § 1"), (base, "arv"), (base + " endring", "ekteskapsloven"), (None, "ekteskapsloven"),
        ("Lov 8. april 1981 nr. 7 om ekteskap", "ekteskap"), ("Lov 3. mårs 1990 nr. 2 om ekteskap", "ekteskap"),
    ]
    assert column(given, "t string, q string", rules.is_exact_base_law("t", "q")) == [True, False, False, False, True, False]
    assert column(given, "t string, q string", rules.title_tier("t", "q")) == [0, 1, 2, 1, 0, 1]


def test_document_links(column):
    given = ["https://x/lov/1", "https://x/register/lov/", "https://x/lov/1?q=2", "https://x/lov/1?z=2", "https://x/", None]
    assert column(given, "u string", links.is_document_link("u")) == [True, False, False, True, False, False]


def test_sanitize_link(column):
    given = [
        "https://x/lov/2017-03-31-12).", 'https://x/doc").', "https://x/a_(b)", "https://x/a_(b))", " https://x/p., ", "..", None, "",
    ]
    assert column(given, "u string", links.sanitize_link("u")) == [
        "https://x/lov/2017-03-31-12", "https://x/doc", "https://x/a_(b", "https://x/a_(b)", "https://x/p", None, None, None,
    ]


def test_sanitize_answer(column):
    given = [
        '<a href="https://x/d))">T</a>', '<a href="https://x/d)">T</a>', '<a href="https://x/(d))">T</a>',
        '<a href="u">T )</a>', "se https://x/d). Og", "se https://x/(d). Og", "se https://x/d", "<a href=u))>",
    ]
    assert column(given, "a string", links.sanitize_answer_links("a")) == [
        '<a href="https://x/d">T</a>', '<a href="https://x/d">T</a>', '<a href="https://x/(d)">T</a>',
        '<a href="u">T</a>', "se https://x/d Og", "se https://x/(d Og", "se https://x/d", "<a href=u>",
    ]


def test_links_in_text(column):
    given = ['a <a href="https://x/1">one</a> https://y/2 <a class="z" href="https://w">no</a>']
    found = column(given, "t string", links.links_in("t"))[0]
    assert [(e["kind"], e["url"], e["label"]) for e in found] == [
        ("html", "https://x/1", "one"), ("plain", "https://y/2", None), ("plain", "https://w", None),
    ]


def test_viewer_url(column):
    given = [("a b.zip", "x/å.XML"), ("a", ""), (None, "b")]
    assert column(given, "f string, m string", links.viewer_url("f", "m", "https://v/")) == [
        "https://v/api/documents/xml?filename=a+b.zip&member=x%2F%C3%A5.html", None, None,
    ]


def test_custom_rules_with_capitals_and_overlaps(column):
    capitals = [("S", ["Statute"])]
    assert column(["see the Statute here", "STATUTE", "statutes"], "t string", rules.first_rule_of_long_text("t", capitals)) == [
        "S", "S", None,
    ]
    overlapping = [("B", ["two three"]), ("A", ["one two"])]
    assert not rules.stand_apart(overlapping)
    given = ["one two three", "one two", "two three"]
    assert column(given, "t string", rules.first_rule_of_long_text("t", overlapping)) == ["B", "A", "B"]
    nested = [("long", ["one two"]), ("short", ["two"]), ("other", ["one"])]
    given = ["one two", "two one", "one"]
    for listed in (nested, nested[::-1]):
        found = column(given, "t string", rules.first_rule_of_long_text("t", listed))
        assert found == column(given, "t string", rules.first_rule("t", listed))


def test_rules_pass_over_other_letters_and_odd_cases(column):
    rules_of = [("K", ["kreg", "ski"]), ("A", ["arv"])]
    given = ["KREG", "x Kreg.", "ſki", "x ARV ikke", "akreg", "", None, "kregs", "ski-kreg"]
    plain = column(given, "text string", rules.first_rule("text", rules_of))
    assert column(given, "text string", rules.first_rule_of_long_text("text", rules_of)) == plain
    assert plain == ["K", "K", "K", "A", None, None, None, None, "K"]
    texts = ["i Finansdepartementet", "et DEPARTEMENT", "Fjellovene", "Fjelloven", "fjelloven", "Fjellove", "ski", "", None]
    generic = column(texts, "text string", rules.extract_ministry(F.lit(""), "text", rules_of))
    assert generic[:2] == ["Finansdepartementet", None] and generic[6] == "K"
    named = column(texts, "text string", rules.classify_law_type(F.lit(""), "text", rules_of))
    assert named == [None, None, None, "Lov", None, "Lov", "K", None, None]
    pattern = rules.sifted(F.col("text"), rules_of)._jc.toString()
    assert "(?=[aks])" in pattern
