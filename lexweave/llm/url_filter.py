"""URL filters by a cascade of Bloom filters.

A list of rules (``host/path`` prefixes) is held as a cascade: level 0 encodes
the listed keys, level 1 the keys of the corpus that level 0 takes for listed by
mistake, level 2 the listed keys that level 1 catches by mistake, and so on until
a level makes no mistake.  The levels are built over every key the corpus can ask
for, so asking is exact although nothing is joined: a key is tested against bit
arrays that travel inside the plan.

The bit arrays are bounded (``MAX_BITS`` each).  A longer list is cut by a hash of
the key into blocks of that size, which are applied one after the other.

Nulls and edge cases: a null url, or one without ``://``, has an empty host and
path and gets the default verdict; empty rules and nulls in the rules are left
out; a rule listed twice with both actions blocks.  Repeated urls are judged
alike, an empty table gives an empty result, and all columns of the input are
kept unless one has the name of an output column, which then is replaced.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, materialize

BITS_PER_KEY = 10
HASHES = 5
# Bits of one filter: 1 MB as a literal of the plan.
MAX_BITS = 1 << 23

_HOST_PATH = r"://([^/?#]*)([^?#]*)"


def host(url: Column) -> Column:
    """What stands between the first ``://`` and ``/``, ``?``, ``#`` or the end; A-Z lower-cased."""
    return F.coalesce(ascii_lower(F.regexp_extract(url, _HOST_PATH, 1)), F.lit(""))


def path(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, _HOST_PATH, 2), F.lit(""))


@dataclass(frozen=True)
class Level:
    seed: int
    bits: int
    words: list[int]

    def has(self, key: Column) -> Column:
        """True for every encoded key, and for a few others."""
        array = F.split(F.lit(",".join(map(str, self.words))), ",").cast("array<bigint>")
        tests = [
            F.getbit(F.get(array, F.floor(at / 64).cast("int")), (at % 64).cast("int")) == 1
            for at in _positions(key, self.seed, self.bits)
        ]
        found = tests[0]
        for test in tests[1:]:
            found = found & test
        return found


def _positions(key: Column, seed: int, bits: int) -> list[Column]:
    # Halves of 31 bits, so that the sums stay within a long.
    first = F.xxhash64(key, F.lit(seed)).bitwiseAND(F.lit(0x7FFFFFFF))
    step = F.xxhash64(key, F.lit(seed), F.lit(1)).bitwiseAND(F.lit(0x7FFFFFFF))
    return [(first + step * F.lit(j)) % F.lit(bits) for j in range(HASHES)]


def _level(keys: DataFrame, count: int, seed: int) -> Level:
    """The filter of ``keys``; bits are merged in tasks first, the driver gets its words only."""
    bits = max(64, 64 * math.ceil(count * BITS_PER_KEY / 64))
    at = F.explode(F.array(*_positions(F.col("key"), seed, bits))).alias("at")
    words = (
        keys.select(at)
        .groupBy(F.floor(F.col("at") / 64).cast("int").alias("word"))
        .agg(F.expr("bit_or(shiftleft(1L, cast(at % 64 as int)))").alias("value"))
    )
    array = [0] * (bits // 64)
    for row in words.collect():
        array[row["word"]] = row["value"]
    return Level(seed, bits, array)


@dataclass
class Cascade:
    """Levels that alternate between listed and unlisted keys."""

    levels: list[Level] = field(default_factory=list)

    def has(self, key: Column) -> Column:
        """Whether ``key`` is listed; exact for every key of the universe it was built over."""
        answer = F.lit(len(self.levels) % 2 == 1)
        for depth in reversed(range(len(self.levels))):
            answer = F.when(self.levels[depth].has(key), answer).otherwise(F.lit(depth % 2 == 1))
        return answer


def build_cascade(listed: DataFrame, universe: DataFrame) -> Cascade:
    """The cascade of the distinct keys ``listed`` within ``universe``; both have one column ``key``.

    Only keys that pass level 0 leave their task, so the universe itself is never
    shuffled.
    """
    count = listed.count()
    if count == 0:
        return Cascade()
    levels = [_level(listed, count, 0)]
    passing = universe.where(levels[0].has(F.col("key"))).select("key", F.lit(0).alias("listed"))
    known = materialize(
        listed.select("key", F.lit(1).alias("listed")).unionByName(passing).groupBy("key").agg(F.max("listed").alias("listed")),
        "cascade",
    )
    while True:
        side = len(levels) % 2
        # Mistakes of the last level: keys of the other side that passed all levels so far.
        wrong = known.where(F.col("listed") == 1 - side)
        for level in levels[1:]:
            wrong = wrong.where(level.has(F.col("key")))
        count = wrong.count()
        if count == 0:
            return Cascade(levels)
        levels.append(_level(wrong, count, len(levels)))


def rule_keys(rules: DataFrame) -> DataFrame:
    """``(key, block)`` of rules ``(rule, action)``; the host of a rule is lower-cased."""
    lowered = F.concat(
        ascii_lower(F.regexp_extract("rule", r"^[^/]*", 0)), F.regexp_extract("rule", r"^[^/]*(.*)$", 1)
    )
    return (
        rules.where("rule is not null and rule <> '' and action in ('block', 'allow')")
        .select(lowered.alias("key"), (F.col("action") == "block").alias("block"))
        .groupBy("key")
        .agg(F.max("block").alias("block"))
    )


def candidate_keys(host: Column, path: Column, shapes: list[tuple[int, int]]) -> Column:
    """Every rule that could fit: the last ``labels`` labels of the host and the first ``chars`` of the path.

    ``shapes`` has the pairs (labels, chars) that occur in the rules; there are at
    most as many as host depths times path lengths, however long the list is.
    """
    literal = F.array(*[F.struct(F.lit(a).alias("labels"), F.lit(b).alias("chars")) for a, b in shapes])
    depth = F.size(F.split(host, r"\.", -1))
    fits = F.filter(literal, lambda s: (s["labels"] <= depth) & (s["chars"] <= F.length(path)))
    # The end of the host by labels: everything behind the dot before the wanted label.
    tail = lambda labels: F.array_join(F.slice(F.split(host, r"\.", -1), -labels, labels), ".")
    return F.transform(fits, lambda s: F.concat(tail(s["labels"]), F.substr(path, F.lit(1), s["chars"])))


def judge(
    pages: DataFrame, rules: DataFrame, url_col: str = "url", default: str = "allow", max_bits: int = MAX_BITS
) -> DataFrame:
    """``pages`` with ``host``, ``path``, ``rule`` (the longest that fits, or null) and ``verdict``.

    A rule fits its host and all subdomains if the path starts with the rule's.
    Which candidates are rules, and which rules block, is asked of two cascades.
    A url without a rule is in neither and gets ``default``.  Rules of equal
    length: the one that sorts last wins.
    """
    kept = [name for name in pages.columns if name not in ("host", "path", "rule", "verdict")]
    judged = pages.select(*kept, host(F.col(url_col)).alias("host"), path(F.col(url_col)).alias("path"))
    keys = materialize(rule_keys(rules), "rules")
    shapes = [
        tuple(row)
        for row in keys.select(
            F.size(F.split(F.regexp_extract("key", r"^[^/]*", 0), r"\.", -1)),
            F.length(F.regexp_extract("key", r"^[^/]*(.*)$", 1)),
        ).distinct().collect()
    ]
    if not shapes:
        return judged.withColumns({"rule": F.lit(None).cast("string"), "verdict": F.lit(default)})
    candidates = candidate_keys(F.col("host"), F.col("path"), sorted(shapes))
    blocks = max(1, math.ceil(keys.count() * BITS_PER_KEY / max_bits))
    for block in range(blocks):
        mine = lambda key, at=block: F.pmod(F.xxhash64(key, F.lit(-1)), F.lit(blocks)) == at
        asked = judged.select(F.explode(candidates).alias("key")).where(mine(F.col("key")))
        here = keys.where(mine(F.col("key")))
        listed = build_cascade(here.select("key"), asked)
        blocking = build_cascade(here.where("block").select("key"), here.select("key"))
        hits = F.filter(candidates, lambda key: mine(key) & listed.has(key))
        best = F.array_max(
            F.transform(
                hits,
                lambda key: F.struct(F.length(key).alias("n"), key.alias("key"), blocking.has(key).alias("block")),
            )
        )
        if block == 0:
            judged = judged.withColumn("__best", best)
        else:
            judged = judged.withColumn("__best", F.greatest("__best", best))
        if block < blocks - 1:
            judged = materialize(judged, "judged")
    verdict = F.when(F.col("__best")["block"], "block").when(~F.col("__best")["block"], "allow").otherwise(default)
    return judged.withColumns({"rule": F.col("__best")["key"], "verdict": verdict}).drop("__best")
