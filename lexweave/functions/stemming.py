"""Norwegian stems as column expressions: endings are cut inside a region of the word, in three steps.

The rules are the published ones of the Snowball project for Norwegian (Bokmål).  The region
(R1) starts behind the first letter that is no vowel and follows a vowel, and behind the third letter at the earliest.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import as_column, let

# Fixed values of the rules: vowels, letters an s-ending may stand behind, and the endings of each step.
VOWELS = "aeiouyæåø"
S_LETTERS = "bcdfghjlmnoprtvyz"
DROPPED = [
    "a", "e", "ede", "ande", "ende", "ane", "ene", "hetene", "en", "heten", "ar", "er", "heter", "as", "es", "edes",
    "endes", "enes", "hetenes", "ens", "hetens", "ers", "ets", "et", "het", "ast",
]
SHORTENED = ["erte", "ert"]
LAST = ["leg", "eleg", "ig", "eig", "lig", "elig", "els", "lov", "elov", "slov", "hetslov"]


def _ending(word: Column, start: Column, endings: list[str]) -> Column:
    """The longest of ``endings`` that ends the word and lies behind its first ``start`` letters; empty if none does."""
    region = F.substring(word, start + 1, F.length(word))
    return F.regexp_extract(region, f"(?:{'|'.join(sorted(endings, key=len, reverse=True))})$", 0)


def _without(word: Column, letters: Column) -> Column:
    return F.substring(word, F.lit(1), F.length(word) - letters)


def _region_start(word: Column) -> Column:
    found = F.length(F.regexp_extract(word, f"^[^{VOWELS}]*[{VOWELS}]+[^{VOWELS}]", 0))
    return F.when(found > 0, F.greatest(found, F.lit(3))).otherwise(F.length(word))


def norwegian_stem(word) -> Column:
    """The stem of a lower-cased word; null stays null."""

    def first(word: Column, start: Column) -> Column:
        def cut(ending: Column) -> Column:
            before = F.substring(word, F.lit(1), F.length(word) - 1)
            may_go = before.rlike(f"[{S_LETTERS}]$") | before.rlike(f"[^{VOWELS}]k$")
            return (
                F.when(ending == "s", F.when(may_go, before).otherwise(word))
                .when(ending.isin(SHORTENED), F.concat(_without(word, F.length(ending)), F.lit("er")))
                .otherwise(_without(word, F.length(ending)))
            )

        return let(_ending(word, start, [*DROPPED, "s", *SHORTENED]), cut)

    def second(word: Column, start: Column) -> Column:
        return F.when(_ending(word, start, ["dt", "vt"]) != "", _without(word, F.lit(1))).otherwise(word)

    def third(word: Column, start: Column) -> Column:
        return _without(word, F.length(_ending(word, start, LAST)))

    def steps(word: Column) -> Column:
        return let(
            _region_start(word),
            lambda start: let(first(word, start), lambda one: let(second(one, start), lambda two: third(two, start))),
        )

    return let(as_column(word), steps)
