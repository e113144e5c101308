"""Document fingerprints from closed syncmers of words.

A text is a sequence of units: words, longer ones cut every ``UNIT`` characters.  A run of
``k`` units is an anchor if, among the hashes of its inner runs of ``s`` units,
the smallest stands at the first or the last place.  Whether a run is chosen
depends on the run alone, so equal passages have equal anchors in whatever text
they stand, and every stretch of a passage has some.  Anchors with their positions
serve positional matching (``anchor_rows``, ``match_positions``); their set gives
a digest and a likeness (Jaccard).

Only DataFrame functions.  Each text is moved once, to a range of ids where its
next document stands beside it.

Nulls and edge cases: a null text is an empty one.  A text with fewer than ``k``
units has one anchor, the hash of them all; without units it has none.  Two texts
without anchors are alike (1), a text with and one without are not (0).  Documents
with equal ids are ordered by text; rows with a null id come last.  A single
document is its own next one.  An empty table gives an empty table.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import texts

K, S = 5, 2
UNIT = 16
# Documents of one range of ids; a range is sorted by one task.
RANGE_ROWS = 2000
# Most ranges, which bounds the table of their ends that is broadcast (24 bytes a row).
MAX_RANGES = 100_000


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def units(text: Column, unit: int = UNIT) -> Column:
    return F.regexp_extract_all(text, F.lit(r"[^\x20\x09-\x0D]{1,%d}" % unit), F.lit(0))


def _inner_hashes(text: Column, s: int, unit: int) -> Column:
    """Hashes of all runs of ``s`` units; of the whole if there are fewer, none without units."""

    def runs(hashes: Column) -> Column:
        count = F.size(hashes) - s + 1
        rolled = F.transform(
            F.slice(hashes, 1, F.greatest(count, F.lit(0))),
            lambda first, i: F.xxhash64(first, *[F.get(hashes, i + j) for j in range(1, s)]),
        )
        return F.when(count > 0, rolled).when(F.size(hashes) > 0, F.array(F.xxhash64(hashes))).otherwise(rolled)

    return _let(F.transform(units(text, unit), lambda word: F.xxhash64(word)), runs)


def anchors(text: Column, k: int = K, s: int = S, unit: int = UNIT) -> Column:
    """``array<struct<anchor bigint, at int>>``: the closed syncmers of a text and the units they start at."""
    inner = k - s

    def chosen(runs: Column) -> Column:
        last = F.size(runs) - 1 - inner

        def closed(i: Column) -> Column:
            values = [F.get(runs, i + j) for j in range(inner + 1)]
            edge = F.least(values[0], values[-1])
            return edge <= F.least(*values[1:-1]) if inner > 2 else edge <= values[1] if inner == 2 else F.lit(True)

        def anchor(i: Column) -> Column:
            return F.struct(F.xxhash64(*[F.get(runs, i + j) for j in range(0, inner + 1, s)], F.get(runs, i + inner)).alias("anchor"), i.alias("at"))

        whole = F.array(F.struct(F.xxhash64(runs).alias("anchor"), F.lit(0).alias("at")))
        none = F.filter(whole, lambda _: F.lit(False))
        return (
            F.when(last >= 0, F.transform(F.filter(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), closed), anchor))
            .when(F.size(runs) > 0, whole)
            .otherwise(none)
        )

    return _let(_inner_hashes(text, s, unit), chosen)


def anchor_set(text: Column, k: int = K, s: int = S, unit: int = UNIT) -> Column:
    """The distinct anchors of a text, in the order of their first places."""
    return F.array_distinct(F.transform(anchors(text, k, s, unit), lambda a: a["anchor"]))


def digest(anchor_set: Column) -> Column:
    """A short name for a set of anchors: 64 bits over all of them in order, and their number."""
    return F.concat_ws("-", F.lpad(F.lower(F.hex(F.xxhash64(anchor_set))), 16, "0"), F.size(anchor_set))


def likeness(left: Column, right: Column) -> Column:
    """Jaccard of two sets of anchors."""
    shared = F.size(F.array_intersect(left, right))
    either = F.size(left) + F.size(right)
    return F.when(either == 0, F.lit(1.0)).otherwise(
        _let(shared, lambda common: common.cast("double") / (either - common))
    )


def anchor_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K, s: int = S) -> DataFrame:
    """``(doc_id, anchor, at)``, one row per anchor."""
    return texts(docs, id_col, text_col).select("doc_id", F.inline(anchors(F.col("text"), k, s)))


def match_positions(left: DataFrame, right: DataFrame) -> DataFrame:
    """``(left_id, right_id, shift, matches)``: anchors that texts share at one distance, from two tables of ``anchor_rows``.

    Meant for a stated set of texts on the left against all on the right; an
    anchor that is frequent on both sides is split by Spark's skew join.
    """
    a = left.select(F.col("doc_id").alias("left_id"), "anchor", F.col("at").alias("left_at"))
    b = right.select(F.col("doc_id").alias("right_id"), "anchor", F.col("at").alias("right_at"))
    return (
        a.join(b, "anchor")
        .groupBy("left_id", "right_id", (F.col("right_at") - F.col("left_at")).alias("shift"))
        .agg(F.count("*").alias("matches"))
    )


def edited(text: Column, following: Column) -> Column:
    """``text`` with its last ``floor(n / 2)`` code points replaced by the first as many (or all) of ``following``."""
    half = F.floor(F.char_length(text) / 2).cast("int")
    return F.concat(
        F.substring(text, F.lit(1), F.char_length(text) - half), F.substring(following, F.lit(1), half)
    )


def range_ends(ids: DataFrame, id_col: str, ranges: int) -> list[int]:
    """Up to ``ranges - 1`` ids that cut a table into ranges of about equal numbers of rows, wherever the ids lie."""
    if ranges < 2:
        return []
    # The shares as one folded literal; there may be many.
    shares = F.split(F.lit(",".join(str(i / ranges) for i in range(1, ranges))), ",").cast("array<double>")
    found = ids.agg(F.percentile_approx(id_col, shares, F.lit(max(10_000, 4 * ranges)))).first()[0]
    return sorted(set(found or []))


def range_of(value: Column, ends: list[int]) -> Column:
    """How many of the sorted ``ends`` are below ``value``, found in two steps of about the root of their number."""
    width = max(1, math.isqrt(len(ends)))
    blocks = [ends[at : at + width] for at in range(0, len(ends), width)] or [[]]

    def numbers(values: list[int]) -> Column:
        return F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>") if values else F.array().cast("array<bigint>")

    def below(values: Column) -> Column:
        return F.size(F.filter(values, lambda end: end < value))

    table = F.transform(F.split(F.lit(";".join(",".join(map(str, block)) for block in blocks)), ";"), lambda block: F.split(block, ",").cast("array<bigint>"))
    if len(blocks) == 1:
        return below(numbers(blocks[0])).cast("long")
    # Whole blocks before the one that holds the place, then places within it.
    last = numbers([block[-1] for block in blocks])
    return _let(below(last), lambda at: at * width + F.coalesce(below(F.get(table, at)), F.lit(0))).cast("long")


def with_next(docs: DataFrame, range_rows: int = RANGE_ROWS, max_ranges: int = MAX_RANGES) -> DataFrame:
    """``(doc_id, text, range, guest)``: documents by ranges of ids, each range with a guest, the document that follows its last.

    Documents follow each other by descending id, and the first follows the last.
    Ranges end at quantiles of the ids, which may span all longs and crowd anywhere; rows that share an id
    (or have none) share a range.
    """
    source = texts(docs)
    count = source.agg(F.count("doc_id")).first()[0]
    ends = range_ends(source, "doc_id", min(max_ranges, max(1, math.ceil(count / range_rows))))
    own = F.when(F.col("doc_id").isNull(), F.lit(-1).cast("long")).otherwise(range_of(F.col("doc_id"), ends))
    # The highest document of each range is the guest of the next range above it; of the highest, in the lowest.
    tops = source.select("doc_id", own.alias("range")).groupBy("range").agg(F.max("doc_id").alias("top"))
    above = F.lead("range").over(Window.orderBy("range"))
    lowest = F.min("range").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    guests = tops.select(F.col("range").alias("__range"), "top", F.coalesce(above, lowest).alias("visits"))
    joined = source.withColumn("range", own).join(
        F.broadcast(guests), (F.col("range") == F.col("__range")) & F.col("doc_id").eqNullSafe(F.col("top")), "left"
    )
    places = F.when(F.col("visits").isNull(), F.array(F.struct(F.col("range"), F.lit(False).alias("guest")))).otherwise(
        F.array(
            F.struct(F.col("range"), F.lit(False).alias("guest")),
            F.struct(F.col("visits").alias("range"), F.lit(True).alias("guest")),
        )
    )
    return joined.select("doc_id", "text", F.inline(places))


def fingerprint_edits(docs: DataFrame, k: int = K, s: int = S) -> DataFrame:
    """``(doc_id, text, edited_text, anchors, edited_anchors, next_anchors)`` of every document."""
    order = Window.partitionBy("range").orderBy("guest", F.col("doc_id").desc_nulls_last(), F.desc("text"))
    placed = with_next(docs).withColumn("next_text", F.lead("text").over(order))
    changed = placed.withColumn("edited_text", edited(F.col("text"), F.col("next_text"))).drop("next_text")
    marked = changed.withColumns(
        {
            "anchors": anchor_set(F.col("text"), k, s),
            "edited_anchors": F.when(~F.col("guest"), anchor_set(F.col("edited_text"), k, s)),
        }
    )
    beside = marked.withColumn("next_anchors", F.lead("anchors").over(order))
    return beside.where("not guest").drop("range", "guest")
