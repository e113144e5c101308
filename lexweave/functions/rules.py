"""Rule lists turned into column expressions.

A rule list is data: an ordered list of (result, words).  Each list becomes one
nested ``coalesce(when ...)``, so classifying costs one pass and no shuffle.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed_values as fixed
from .text import BOUNDARY, WS, as_column, first_group, let, null_if_empty, trim_ws


def word_pattern(words: list[str]) -> str:
    return f"(?iu){BOUNDARY}(?:{'|'.join(words)}){BOUNDARY}"


def has_word(text, *words: str) -> Column:
    return as_column(text).rlike(word_pattern(list(words)))


def first_rule(text, rules: list[tuple[str, list[str]]]) -> Column:
    """Result of the first rule with a word in ``text``; null when none has."""
    return F.coalesce(*[F.when(has_word(text, *words), F.lit(result)) for result, words in rules])


def sifted(text, rules: list[tuple[str, list[str]]]) -> Column:
    """The words of the rules that occur in ``text``, one per line, found in a single pass.

    Only for lists whose phrases ``stand_apart``: then running the list over this
    gives the same result as over the text, for a fraction of the work.
    """
    words = "|".join(word for _, listed in rules for word in listed)
    # Most places are passed over by their letter, before the look around for a boundary.
    firsts = {word[:1] for _, listed in rules for word in listed}
    ahead = f"(?=[{''.join(sorted(firsts))}])" if all(first.isalnum() for first in firsts) else ""
    found = F.regexp_extract_all(
        as_column(text), F.lit(f"(?iu){ahead}{BOUNDARY}(?:{words}){BOUNDARY}"), F.lit(0)
    )
    return F.array_join(F.array_distinct(F.transform(found, F.lower)), "\n")


def stand_apart(rules: list[tuple[str, list[str]]]) -> bool:
    """True when a match of one rule can never hide a match of another.

    Phrases of different rules are compared word by word: none may end with words
    that another begins with.  (A phrase inside another does no harm: the rules run over what was
    found, and of two that start at one place the earlier rule is found.)  White space and optional parts of a pattern
    separate words; any other pattern counts as unsafe.
    """
    phrases = set()
    for number, (_, listed) in enumerate(rules):
        for word in listed:
            plain = word.lower().replace(WS, " ").replace("-?", " ").replace(" *", " ").replace(" +", " ")
            if re.search(r"[\\\[\](){}|^$*+?.]", plain):
                return False
            phrases.add((number, tuple(re.findall(r"[^\W_]+", plain))))
    for rule, one in phrases:
        for other in (phrase for at, phrase in phrases if at != rule):
            if any(one[-n:] == other[:n] for n in range(1, min(len(one), len(other)))):
                return False
    return True


def first_rule_of_long_text(text, rules: list[tuple[str, list[str]]]) -> Column:
    if not stand_apart(rules):
        return first_rule(text, rules)
    return let(sifted(text, rules), lambda mentioned: first_rule(mentioned, rules))


def with_title(title, text) -> Column:
    return F.concat_ws(" ", null_if_empty(title), F.coalesce(as_column(text), F.lit("")))


def classify_law_type(title, text, rules=fixed.LAW_TYPES) -> Column:
    """Type named in the title, else in title and text, else by a capitalised ``...loven`` name."""
    everything = with_title(title, text)
    # the pattern tries every word, so texts without its fixed letters are left out first
    named_law = everything.contains("love") & everything.rlike(f"{BOUNDARY}[A-ZÆØÅ][a-zæøå]+loven?{BOUNDARY}")
    return F.coalesce(
        first_rule(title, rules),
        first_rule_of_long_text(everything, rules),
        F.when(named_law, F.lit("Lov")),
    )


def ministry_words(name: str) -> str:
    """Pattern of a ministry name; the hyphen and the spaces around ``og`` may be missing."""
    return name.lower().replace("- og ", rf"-?{WS}*og{WS}*")


def document_ministry_rules(ministries=fixed.MINISTRIES) -> list[tuple[str, list[str]]]:
    return [
        (name, [ministry_words(name), short, *others]) for name, short, others, _ in ministries
    ]


def query_ministry_rules(ministries=fixed.MINISTRIES) -> list[tuple[str, list[str]]]:
    return [(name, [ministry_words(name), *others]) for name, _, _, others in ministries]


def extract_ministry(title, text, rules=None) -> Column:
    """First ministry named in title or text, else any ``...departement(et)`` word as written."""
    everything = with_title(title, text)
    generic = (
        f"(?iu){BOUNDARY}([A-ZÆØÅ][a-zæøå]+(?:-?{WS}*og{WS}*[a-zæøå]+)?departementet?){BOUNDARY}"
    )
    return F.coalesce(
        first_rule_of_long_text(everything, rules or document_ministry_rules()),
        F.when(F.lower(everything).contains("departement"), first_group(everything, generic)),
    )


def query_law_type(text, rules=fixed.QUERY_LAW_TYPES) -> Column:
    """Like ``classify_law_type`` for queries; a regulation *to* a law is a regulation."""
    to_law = f"(?iu){BOUNDARY}forskrift{WS}+til{WS}+(?:.*lov|lov){BOUNDARY}"
    return F.when(as_column(text).rlike(to_law), F.lit("Forskrift")).otherwise(first_rule(text, rules))


def query_year(text, bare_year: bool = False) -> Column:
    """Year after a context word or before a type word; ``bare_year`` also takes a lone year."""
    patterns = [
        rf"(?iu)(?:fra|from|i|in|år|year){WS}+(\d{{4}}){BOUNDARY}",
        rf"(?iu){BOUNDARY}(\d{{4}}){WS}+(?:lov|forskrift|vedtak|reglement)",
    ]
    if bare_year:
        patterns.append(rf"{BOUNDARY}((?:19|20)\d{{2}}){BOUNDARY}")
    found = [first_group(text, pattern).try_cast("int") for pattern in patterns]
    return F.coalesce(*[F.when(year.between(1900, 2100), year) for year in found])


def query_ministry(text, rules=None) -> Column:
    return first_rule(text, rules or query_ministry_rules())


def core_terms(text) -> Column:
    """The query without a leading "forskrift til lov om" and its shorter forms."""
    prefixes = [
        rf"(?iu)\A(?:forskrift{WS}+til{WS}+)?lov{WS}+om{WS}+",
        rf"(?iu)\Aforskrift{WS}+til{WS}+",
        rf"(?iu)\Alov{WS}+om{WS}+",
        rf"(?iu)\Aforskrift{WS}+om{WS}+",
    ]
    cleaned = as_column(text)
    for prefix in prefixes:
        cleaned = F.regexp_replace(cleaned, prefix, "")
    cleaned = trim_ws(cleaned)
    return F.when(cleaned != "", cleaned).otherwise(as_column(text))


def is_amendment(title, words: list[str] = fixed.AMENDMENT_WORDS) -> Column:
    lowered = F.lower(as_column(title))
    return F.coalesce(lowered.rlike("|".join(words)) | lowered.startswith("forskrift"), F.lit(False))


def is_exact_base_law(
    title, query, named=fixed.BASE_LAW_TITLES, stem: str = fixed.BASE_LAW_STEM
) -> Column:
    """The title is that of the base law the query asks for."""
    title, query = F.lower(as_column(title)), F.lower(as_column(query))

    def spaced(pattern: str) -> str:
        return "(?iu)" + pattern.replace(r"\s", WS).replace("^", r"\A")

    hit = F.lit(False)
    for name, patterns in named.items():
        hit = hit | (query.contains(name) & title.rlike("|".join(spaced(p) for p in patterns)))
    numbered = title.rlike(spaced(r"^lov\s+\d+\.?\s+[0-9A-Za-z_]+\s+\d+\s+nr\.?\s+\d+\s+om\s+"))
    hit = hit | (numbered & query.contains(stem) & title.contains(stem))
    return F.coalesce(hit & ~is_amendment(title), F.lit(False))


def title_tier(title, query) -> Column:
    """0 for the base law asked for, 2 for documents that change others, 1 for the rest."""
    return (
        F.when(is_amendment(title), 2).when(is_exact_base_law(title, query), 0).otherwise(1)
    )


def expand_terms(
    text, expansions=fixed.TERM_EXPANSIONS, titles=fixed.OFFICIAL_TITLES
) -> Column:
    """The text followed by the related terms of its words, then by the official titles."""
    text = as_column(text)
    cleaned = F.transform(
        F.split(F.lower(text), WS + "+", -1),
        lambda word: F.regexp_replace(word, r"[^\p{L}\p{N}]", ""),
    )

    def looked_up(entries: dict[str, list[str]]) -> Column:
        pairs = []
        for key, values in entries.items():
            pairs += [F.lit(key), F.array(*[F.lit(value) for value in values])]
        table = F.create_map(*pairs)
        return F.flatten(
            F.filter(
                F.transform(cleaned, lambda word: F.try_element_at(table, word)),
                lambda values: values.isNotNull(),
            )
        )

    return F.array_join(F.concat(F.array(text), looked_up(expansions), looked_up(titles)), " ")


def matcher_score(text, matchers: list[dict]) -> Column:
    """Highest weight among the matchers whose tokens are all in the text, clamped to 0..1."""
    lowered = F.lower(as_column(text))
    scores = [F.lit(0.0)]
    for matcher in matchers:
        fires = F.lit(True)
        for token in matcher.get("includes", []):
            fires = fires & lowered.contains(token.lower())
        for token in matcher.get("excludes", []):
            fires = fires & ~lowered.contains(token.lower())
        scores.append(F.when(fires, F.lit(float(matcher.get("weight", 0.6)))).otherwise(0.0))
    score = F.greatest(*scores) if len(scores) > 1 else scores[0]
    return F.greatest(F.least(score, F.lit(1.0)), F.lit(0.0))


def query_embedding_text(text, law_type=None, year=None, ministry=None, core: bool = True) -> Column:
    """Lines that put a query into context before it is embedded."""

    def line(label: str, value) -> Column:
        if value is None:
            return F.lit(None).cast("string")
        value = as_column(value).cast("string")
        return F.when(~value.isin("", "0"), F.concat(F.lit(label), value))

    text = as_column(text)
    lines = [F.lit(fixed.EMBEDDING_QUERY_INTRO), text]
    if core:
        terms = core_terms(text)
        lines.append(F.when(terms != text, F.concat(F.lit("Kjernebegreper: "), terms)))
    lines += [line("Dokumenttype: ", law_type), line("År: ", year), line("Departement: ", ministry)]
    return F.concat_ws("\n", *lines, F.lit(fixed.EMBEDDING_QUERY_END))
