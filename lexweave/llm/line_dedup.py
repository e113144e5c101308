"""Removes passages of whole lines that repeat across documents.

A document is a list of lines.  Two kinds of runs of its lines are looked up.

Chunks: a hash that rolls over the hashes of neighbouring lines puts boundaries where its value is
a multiple of a divisor, so that the same run of lines is cut at the same places wherever it stands,
whatever was inserted before it.  A chunk has two lines at least: neighbouring boundaries
count as one, and the first and the last line are never cut off alone.

Passages, if a number of ``words`` is given: from each line on the shortest run with more
words, and up to each line the shortest.  Any run of one line or more that has more words and occurs
before consists of such runs, so it goes whole whatever stands around it; no other line goes for
this.  Words are what ASCII white space separates.

A run that occurs before (smaller id first, then earlier in the document) is removed; everything else
stays.  Runs are equal if their bytes are: those whose 64-bit hash repeats are spelled out, and a hash that
stands for two different runs removes neither.

Only DataFrame functions.  What is shuffled are hashes, the bytes of runs whose
hash repeats (once per task), and the texts by id.  Counting merges within tasks first, so that a
run that a third of all documents share is one row per task.

Nulls and edge cases: null and empty texts stay as they are; runs without a letter or digit stay.  A text of one line
is no chunk, but may be a passage.  A text that repeats itself keeps its first period.  Rows that share an
id and their text count as one document and are cleaned alike; texts that differ under one id are documents of their
own, ordered by their hash.  Rows with a null id are kept as they are.  An empty table gives an empty table.  All columns are returned in their
order; the added one replaces a column of its name.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import small_side
from .common import materialize

# Lines the rolling value at a line covers: this one and those before it.
WINDOW = 2
# One rolling value in so many makes a boundary.
DIVISOR = 3
# A run of whole lines with more words than this goes wherever it stands.
PASSAGE_WORDS = 50
# Numbers whose running sum is built at once.
BLOCK = 512


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _ends(lines: Column, window: int, divisor: int) -> Column:
    """The last lines of the chunks."""

    def rolled(hashes: Column, at: Column) -> Column:
        parts = [F.coalesce(F.get(hashes, at - F.lit(back)), F.lit(0)) for back in range(window)]
        return F.pmod(F.xxhash64(*parts), F.lit(divisor)) == 0

    last = F.size(lines) - 1
    hashes = F.transform(lines, lambda line: F.xxhash64(line))
    hits = _let(hashes, lambda found: F.transform(found, lambda _, at: rolled(found, at)))
    return _let(
        hits,
        lambda hit: F.filter(
            F.sequence(F.lit(0), last),
            lambda at: (at == last)
            | (F.get(hit, at) & ~F.get(hit, at - 1) & (at > 0) & (at < last - 1)),
        ),
    )


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _run(lines: Column, first: Column, last: Column) -> Column:
    return F.slice(lines, first + 1, last - first + 1)


def chunks(text: Column, window: int = WINDOW, divisor: int = DIVISOR) -> Column:
    """The chunks of a text in order; joined by line feeds they give the text."""

    def cut(lines: Column, found: Column) -> Column:
        def chunk(end: Column, i: Column) -> Column:
            return F.array_join(_run(lines, F.coalesce(F.get(found, i - 1) + 1, F.lit(0)), end), "\n")

        return F.transform(found, chunk)

    return _let(_lines(text), lambda lines: _let(_ends(lines, window, divisor), lambda found: cut(lines, found)))


# A run of lines as one number, since arrays of numbers are made distinct by hashing.
def _span(first: Column, last: Column) -> Column:
    return F.shiftleft(first.cast("long"), 32).bitwiseOR(last.cast("long"))


def _first(span: Column) -> Column:
    return F.shiftright(span, 32).cast("int")


def _last(span: Column) -> Column:
    return span.bitwiseAND(F.lit(0xFFFFFFFF)).cast("int")


def _before(numbers: Column) -> Column:
    """The sum of all numbers before each; by blocks, as an array that grows is copied at each step."""

    def sums(part: Column) -> Column:
        zero = F.array(F.lit(0).cast("long"))
        return F.aggregate(part, zero, lambda acc, x: F.array_append(acc, F.element_at(acc, -1) + x))

    def total(part: Column) -> Column:
        return F.aggregate(part, F.lit(0).cast("long"), lambda acc, x: acc + x)

    def joined(blocks: Column) -> Column:
        def shifted(part: Column, i: Column, offsets: Column) -> Column:
            return F.transform(F.slice(sums(part), F.lit(1), F.size(part)), lambda x: x + F.get(offsets, i))

        return _let(
            sums(F.transform(blocks, total)),
            lambda offsets: F.flatten(F.transform(blocks, lambda part, i: shifted(part, i, offsets))),
        )

    places = F.sequence(F.lit(0), F.floor((F.size(numbers) - 1) / BLOCK).cast("int"))
    return _let(F.transform(places, lambda i: F.slice(numbers, i * BLOCK + 1, F.lit(BLOCK))), joined)


def _least(low: Column, high: Column, holds: Callable[[Column], Column]) -> Column:
    """The least number from ``low`` for which ``holds`` is true, ``high`` if there is none below it; halves the rest at each step."""

    def halved(state: Column, _: Column) -> Column:
        middle = F.shiftright(state["low"] + state["high"], 1)
        return F.when(state["low"] >= state["high"], state).otherwise(
            _let(
                holds(middle),
                lambda hit: F.struct(
                    F.when(hit, state["low"]).otherwise(middle + 1).alias("low"),
                    F.when(hit, middle).otherwise(state["high"]).alias("high"),
                ),
            )
        )

    steps = F.sequence(F.lit(0), F.length(F.bin(high - low)))
    return F.aggregate(steps, F.struct(low.alias("low"), high.alias("high")), halved, lambda state: state["low"])


def _passages(lines: Column, words: int) -> Column:
    """Spans of the shortest runs with more than ``words`` words from each line on and up to each line."""

    def spans(counts: Column, before: Column) -> Column:
        def after(at: Column) -> Column:
            return F.get(before, at) + F.get(counts, at)

        def both(count: Column, at: Column) -> Column:
            end = _least(at, F.size(counts), lambda j: after(j) - F.get(before, at) > words)
            start = _least(F.lit(0), at + 1, lambda i: after(at) - F.get(before, i) <= words) - 1
            found = F.array(
                _let(end, lambda j: F.when(j < F.size(counts), _span(at, j))),
                _let(start, lambda i: F.when(i >= 0, _span(i, at))),
            )
            return F.when(count > words, F.array(_span(at, at))).otherwise(F.array_compact(found))

        return F.flatten(F.transform(counts, both))

    counts = F.transform(lines, lambda line: F.regexp_count(line, F.lit(r"[^\x20\x09-\x0D]+")).cast("long"))
    return _let(counts, lambda found: _let(_before(found), lambda before: spans(found, before)))


def runs(text: Column, window: int = WINDOW, divisor: int = DIVISOR, words: int | None = None) -> Column:
    """``array<struct<span, key>>``: the runs of lines of a text that are looked up, and hashes of them."""

    def spans(lines: Column) -> Column:
        cut = _let(
            _ends(lines, window, divisor),
            lambda found: F.transform(found, lambda end, i: _span(F.coalesce(F.get(found, i - 1) + 1, F.lit(0)), end)),
        )
        several = F.filter(cut, lambda span: _last(span) > _first(span))
        found = several if words is None else F.array_distinct(F.concat(several, _passages(lines, words)))
        return F.filter(
            found, lambda span: F.exists(_run(lines, _first(span), _last(span)), lambda line: line.rlike(r"[\p{L}\p{N}]"))
        )

    def keyed(lines: Column) -> Column:
        return _let(
            F.transform(lines, lambda line: F.xxhash64(line)),
            lambda hashes: F.transform(
                spans(lines),
                lambda span: F.struct(span.alias("span"), F.xxhash64(_run(hashes, _first(span), _last(span))).alias("key")),
            ),
        )

    return _let(_lines(text), keyed)


def repeated_lines(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, divisor: int = DIVISOR,
    words: int | None = None,
) -> DataFrame:
    """``(doc, mark, drop)``: the lines of each document, known by id and hash of its text, that stand in runs which occur before."""
    known = docs.select(F.col(id_col).alias("doc"), F.xxhash64(text_col).alias("mark"), F.col(text_col).alias("text"))
    known = known.where("doc is not null and text is not null")
    if words is None:
        known = known.where(F.col("text").contains("\n"))
    thin = materialize(
        known.select("doc", "mark", F.inline(runs(F.col("text"), window, divisor, words))), "runs"
    )
    owners = (
        thin.groupBy("key")
        .agg(F.count("*").alias("n"), F.min(F.struct("doc", "mark", "span")).alias("first"))
        .where("n > 1")
        .select("key", "first")
    )
    own = F.struct("doc", "mark", "span") == F.col("first")
    suspects = materialize(thin.join(owners, "key").select("doc", "mark", "span", "key", own.alias("own")), "suspects")
    asked = suspects.groupBy("doc", "mark").agg(F.collect_set(F.struct("span", "key")).alias("found"))

    def spelled(lines: Column, found: Column) -> Column:
        def part(run: Column) -> Column:
            return F.array_join(_run(lines, _first(run["span"]), _last(run["span"])), "\n")

        return F.transform(found, lambda run: F.struct(run["key"].alias("key"), part(run).alias("part")))

    parts = known.join(asked, ["doc", "mark"]).select(
        F.inline(_let(_lines(F.col("text")), lambda lines: spelled(lines, F.col("found"))))
    )
    unlike = materialize(parts.distinct().groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key"), "unlike")
    equal = suspects.where("not own").join(small_side(unlike), "key", "left_anti")
    places = F.flatten(F.transform("spans", lambda span: F.sequence(_first(span), _last(span))))
    return equal.groupBy("doc", "mark").agg(F.collect_set("span").alias("spans")).select(
        "doc", "mark", F.array_sort(F.array_distinct(places)).alias("drop")
    )


def dedup_lines(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, divisor: int = DIVISOR,
    words: int | None = None,
) -> DataFrame:
    """``docs`` without the lines of repeated runs, and the number of places they were taken from as ``removed_chunks``.

    Repeated chunks are taken out, and with ``words`` every repeated passage of more words too.
    """
    names = [name for name in docs.columns if name != "removed_chunks"]
    drops = repeated_lines(docs, id_col, text_col, window, divisor, words).select(
        F.col("doc").alias("__doc"), F.col("mark").alias("__mark"), F.col("drop").alias("__drop")
    )
    kept = _let(
        _lines(F.col(text_col)),
        lambda lines: F.transform(
            F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("__drop")), lambda at: F.get(lines, at)
        ),
    )
    gaps = F.filter("__drop", lambda at, i: F.coalesce(F.get("__drop", i - 1) != at - 1, F.lit(True)))
    cleaned = F.when(F.col("__drop").isNull(), F.col(text_col)).otherwise(F.array_join(kept, "\n"))
    same = (F.col(id_col) == F.col("__doc")) & (F.xxhash64(text_col) == F.col("__mark"))
    joined = docs.select(*names).join(drops, same, "left")
    return joined.withColumns(
        {text_col: cleaned, "removed_chunks": F.when(F.col("__drop").isNull(), 0).otherwise(F.size(gaps))}
    ).select(*names, "removed_chunks")
