"""How far the sources of a language differ in their words: exact integer divergences from a frequent-pattern tree.

Each kept term of a language is a row of counts by source.  With ``p = 1 + floor(scale * (count + 1) / (N + V))`` a
pair of sources differs in a term by ``floor((p - q)^2 / q)``.  Most counts are zero, so the sum over all terms of a pair is
that of zeros everywhere, plus a correction for each nonzero count against a zero, plus one for each term in which
both have counts.  The last comes from a frequent-pattern tree: the nonzero counts of a term, ordered by how many terms
a source has, are inserted as a path with the number of terms that have it; terms that begin alike share nodes.  Each
node is met with its ancestors once, with the number of terms that pass through it, so the work follows the nodes and not
the terms.  The paths are sorted and dealt out by ranges: a node is a run of sorted paths with equal beginnings, so a task holds
a slice of them only, and a node that is cut by a boundary counts in parts that add up.

Words are counted per document inside tasks in tables of bounded size, and meet by language and term.

Nulls and edge cases: null texts, languages and sources are empty strings.  Every row is a document, also rows that
share an id or have none.  A language without kept terms has zero for every pair and no terms; a
source without kept terms has zero counts.  A source alone in its language has no pairs.  An
empty table gives an empty result.  Other columns are not looked at.
"""

from __future__ import annotations

import decimal
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import small_side
from .common import materialize

SCALE = 1_000_000_000
MIN_DOCUMENTS = 3
TOP_TERMS = 200
# Code points that stand in no term, as bytes: all of ASCII but letters.  Bytes of other code points are above.
_TERM = re.compile(rb"[A-Za-z\x80-\xff]+")
# What a task counts before it hands over: different terms, and their bytes.
HELD_TERMS, HELD_BYTES = 200_000, 32 << 20
# Items of a path that are looked at to deal paths out by ranges.
RANGE_ITEMS = 4
# Entries of one slice of the tree, and pairs of sources a task sums before it hands over.
SLICE_ENTRIES = 1 << 19
HELD_PAIRS = 1 << 18
_LIMB = 21


def counted(docs: DataFrame) -> DataFrame:
    """``(lang, source, term, n, docs)``: occurrences and documents of each term, in parts that add up."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple[str, str], dict[bytes, list[int]]] = {}
        terms = size = 0

        def given() -> pa.RecordBatch:
            rows = [(*group, term, *numbers) for group, held in found.items() for term, numbers in held.items()]
            kinds = {"lang": pa.string(), "source": pa.string(), "term": pa.binary(), "n": pa.int64(), "docs": pa.int64()}
            return pa.record_batch({name: pa.array([row[at] for row in rows], kind) for at, (name, kind) in enumerate(kinds.items())})

        for batch in batches:
            columns = (batch.column(name) for name in ("lang", "source", "text"))
            for lang, source, text in zip(*columns, strict=True):
                held = found.setdefault((lang.as_py(), source.as_py()), {})
                # The pattern is one of bytes; lower() changes A-Z only.
                for term, n in Counter(_TERM.findall(text.as_py().encode().lower())).items():
                    numbers = held.get(term)
                    if numbers is None:
                        held[term] = [n, 1]
                        terms, size = terms + 1, size + len(term)
                    else:
                        numbers[0] += n
                        numbers[1] += 1
                if terms > HELD_TERMS or size > HELD_BYTES:
                    yield given()
                    found, terms, size = {}, 0, 0
        if terms:
            yield given()

    source = docs.select(*(F.coalesce(F.col(name), F.lit("")).alias(name) for name in ("lang", "source", "text")))
    parts = source.mapInArrow(count, "lang string, source string, term binary, n bigint, docs bigint")
    return parts.select("lang", "source", F.decode("term", "UTF-8").alias("term"), "n", "docs")


def kept_counts(docs: DataFrame, min_documents: int = MIN_DOCUMENTS) -> DataFrame:
    """``(lang, term, source, n, total, leads)`` of terms in enough documents of their language.

    ``total`` is the count over the language; one row of each term leads.
    """
    of_term = Window.partitionBy("lang", "term")
    dealt = counted(docs).repartition("lang", "term")
    counts = dealt.groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    summed = counts.withColumns(
        {
            "total": F.sum("n").over(of_term),
            "in_docs": F.sum("docs").over(of_term),
            "leads": F.row_number().over(of_term.orderBy("source")) == 1,
        }
    )
    return summed.where(F.col("in_docs") >= min_documents).select("lang", "term", "source", "n", "total", "leads")


def share(count: Column, total: Column) -> Column:
    """``1 + floor(SCALE * (count + 1) / total)`` as a long; null for a total of zero."""
    scaled = (count + 1).cast("decimal(20,0)") * F.lit(SCALE).cast("decimal(10,0)")
    whole = F.call_function("div", scaled, F.nullif(total, F.lit(0)).cast("decimal(20,0)"))
    return (whole + 1).cast("long")


def distance(p: Column, q: Column) -> Column:
    """``floor((p - q)^2 / q)``."""
    return F.call_function("div", (p - q) * (p - q), q)


def groups(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """``(lang, source, place, of, v, zero, lang_of)`` of every language and source.

    ``of`` and ``lang_of`` are the denominators of the source and the language, ``v`` the terms kept, ``zero`` the share of a count of
    zero; ``place`` orders the sources of a language by the terms they have, most first.
    """
    every = docs.select(*(F.coalesce(F.col(name), F.lit("")).alias(name) for name in ("lang", "source"))).distinct()
    by_source = kept.groupBy("lang", "source").agg(F.sum("n").alias("n"), F.count("*").alias("terms"))
    by_lang = kept.groupBy("lang").agg(F.sum("n").alias("lang_n"), F.count_if("leads").alias("v"))
    joined = every.join(by_source, ["lang", "source"], "left").join(by_lang, "lang", "left").na.fill(0, ["n", "terms", "lang_n", "v"])
    order = Window.partitionBy("lang").orderBy(F.desc("terms"), "source")
    return joined.select(
        "lang",
        "source",
        F.row_number().over(order).alias("place"),
        (F.col("n") + F.col("v")).alias("of"),
        "v",
        share(F.lit(0), F.col("n") + F.col("v")).alias("zero"),
        (F.col("lang_n") + F.col("v")).alias("lang_of"),
    )


def paths(placed: DataFrame) -> DataFrame:
    """``(lang, path, terms)``: the distinct paths, and how many terms have each."""
    item = F.struct("place", "p", "zero")
    rows = placed.groupBy("lang", "term").agg(F.sort_array(F.collect_list(item)).alias("path"))
    return rows.groupBy("lang", "path").agg(F.count("*").alias("terms"))


def _distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // q


def tree_corrections(place: np.ndarray, p: np.ndarray, zero: np.ndarray, length: np.ndarray, terms: np.ndarray) -> Iterator[tuple]:
    """``(deep, above, correction to (deep, above), to (above, deep), terms)`` of nodes and ancestors, a level and an ancestor's level at a time.

    Rows are sorted paths of one language, padded; a node is a run of rows that agree up to its level.
    """
    rows, depth = place.shape
    same = np.zeros(rows, np.int64)  # how many first items a row shares with the one before
    if rows > 1:
        agree = (place[1:] == place[:-1]) & (p[1:] == p[:-1]) & (np.arange(depth) < np.minimum(length[1:], length[:-1])[:, None])
        same[1:] = np.logical_and.accumulate(agree, axis=1).sum(axis=1)
    for level in range(1, depth):
        inside = np.flatnonzero(length > level)
        if not len(inside):
            return
        # A row opens a node unless it shares this level with the row before.
        opens = np.flatnonzero(same[inside] <= level)
        first, passing = inside[opens], np.add.reduceat(terms[inside], opens)
        a, za = p[first, level], zero[first, level]
        for up in range(level):
            b, zb = p[first, up], zero[first, up]
            forth = _distance(a, b) - _distance(a, zb) - _distance(za, b) + _distance(za, zb)
            back = _distance(b, a) - _distance(zb, a) - _distance(b, za) + _distance(zb, za)
            yield place[first, level], place[first, up], forth, back, passing


def _exact_sums(pair: np.ndarray, correction: np.ndarray, terms: np.ndarray) -> Iterator[tuple[int, int]]:
    """``(pair, sum of correction * terms)``, in limbs that cannot overflow."""
    named, at = np.unique(pair, return_inverse=True)
    mask, totals = (1 << _LIMB) - 1, [0] * len(named)
    for shift, limb in ((0, correction & mask), (_LIMB, correction >> _LIMB & mask), (2 * _LIMB, correction >> 2 * _LIMB)):
        sums = np.zeros(len(named), np.int64)
        np.add.at(sums, at, limb * terms)
        totals = [total + (part << shift) for total, part in zip(totals, sums.tolist(), strict=True)]
    return zip(named.tolist(), totals, strict=True)


def corrections(tree: DataFrame) -> DataFrame:
    """``(lang, place, other, value)``: what terms with counts of both add, from sorted ranges of paths."""

    def slices(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            langs = batch.column("lang").to_pylist()
            lengths = batch.column("path").value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            first = 0
            while first < len(langs):
                upto, longest = first, 1
                while upto < len(langs) and langs[upto] == langs[first] and (upto - first + 1) * max(longest, lengths[upto]) <= max(SLICE_ENTRIES, lengths[upto]):
                    longest, upto = max(longest, int(lengths[upto])), upto + 1
                yield langs[first], batch.slice(first, upto - first), lengths[first:upto]
                first = upto

    def padded(part: pa.RecordBatch, lengths: np.ndarray) -> list[np.ndarray]:
        items = part.column("path").flatten()
        row, at = np.repeat(np.arange(len(lengths)), lengths), np.arange(len(items)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        found = []
        for name in ("place", "p", "zero"):
            full = np.ones((len(lengths), int(lengths.max())), np.int64)
            full[row, at] = items.field(name).to_numpy(zero_copy_only=False)
            found.append(full)
        return found

    def correct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: Counter = Counter()

        def given() -> pa.RecordBatch:
            rows = list(sums.items())
            return pa.record_batch(
                {
                    "lang": pa.array([lang for (lang, _), _ in rows], pa.string()),
                    "place": pa.array([pair >> 32 for (_, pair), _ in rows], pa.int32()),
                    "other": pa.array([pair & (1 << 32) - 1 for (_, pair), _ in rows], pa.int32()),
                    "value": pa.array([decimal.Decimal(total) for _, total in rows], pa.decimal128(38, 0)),
                }
            )

        for lang, part, lengths in slices(batches):
            terms = part.column("terms").to_numpy(zero_copy_only=False)
            for deep, above, forth, back, passing in tree_corrections(*padded(part, lengths), lengths, terms):
                for pair, correction in ((deep << 32 | above, forth), (above << 32 | deep, back)):
                    for name, total in _exact_sums(pair, correction, passing):
                        sums[lang, name] += total
                if len(sums) > HELD_PAIRS:
                    yield given()
                    sums.clear()
        if sums:
            yield given()

    # Ranges are found from the beginnings of paths, as the driver samples them; paths that begin alike are spread.
    head = F.transform(F.slice("path", 1, RANGE_ITEMS), lambda item: F.shiftleft(item["place"].cast("long"), 32) + item["p"])
    ordered = tree.repartitionByRange("lang", head, F.xxhash64("path")).sortWithinPartitions("lang", "path")
    return ordered.mapInArrow(correct, "lang string, place int, other int, value decimal(38,0)")


def _pairs(kept: DataFrame, table: DataFrame) -> DataFrame:
    """``(lang, source, item, value)`` of every ordered pair of sources of a language."""
    side = small_side(table.select("lang", F.col("place").alias("other"), F.col("zero").alias("other_zero")))
    placed = kept.join(small_side(table), ["lang", "source"]).withColumn("p", share(F.col("n"), F.col("of")))
    total = F.col("value").cast("decimal(38,0)")
    zeros = distance(F.col("zero"), F.col("other_zero"))
    base = table.join(side, "lang").where("place <> other").select(
        "lang", "place", "other", F.coalesce(zeros.cast("decimal(19,0)") * F.col("v").cast("decimal(19,0)"), F.lit(0)).cast("decimal(38,0)").alias("value")
    )
    # One count against a zero, in both directions, once for all terms with this count.
    singles = placed.groupBy("lang", "place", "zero", "p").agg(F.count("*").alias("terms"))
    against = singles.join(side, "lang").where("place <> other")
    back = distance(F.col("other_zero"), F.col("p")) - distance(F.col("other_zero"), F.col("zero"))
    forth = distance(F.col("p"), F.col("other_zero")) - zeros
    times = F.col("terms").cast("decimal(18,0)")
    one_sided = against.select(
        "lang",
        F.inline(
            F.array(
                F.struct(F.col("place"), F.col("other"), (forth.cast("decimal(19,0)") * times).cast("decimal(38,0)").alias("value")),
                F.struct(F.col("other").alias("place"), F.col("place").alias("other"), (back.cast("decimal(19,0)") * times).cast("decimal(38,0)").alias("value")),
            )
        ),
    )
    parts = base.unionByName(one_sided).unionByName(corrections(paths(placed)))
    sums = parts.groupBy("lang", "place", "other").agg(F.sum(total).alias("value"))
    names = table.select("lang", "place", "source")
    return (
        sums.join(small_side(names), ["lang", "place"])
        .join(small_side(names.select("lang", F.col("place").alias("other"), F.col("source").alias("item"))), ["lang", "other"])
        .select("lang", "source", "item", F.col("value").cast("long").alias("value"))
    )


def _terms(kept: DataFrame, table: DataFrame) -> DataFrame:
    """``(lang, source, item, value)`` of terms that a source has more often than its language."""
    found = kept.join(small_side(table), ["lang", "source"]).select(
        "lang", "source", "term", share(F.col("n"), F.col("of")).alias("p"), share(F.col("total"), F.col("lang_of")).alias("q")
    )
    return found.where("p > q").select("lang", "source", F.col("term").alias("item"), distance(F.col("p"), F.col("q")).alias("value"))


def audit(docs: DataFrame, min_documents: int = MIN_DOCUMENTS, top_terms: int = TOP_TERMS) -> DataFrame:
    """``(lang, source, part, item, value, rank)``: the distances of every source to the others, and the terms that set it apart.

    Part ``pair`` has every other source of the language; part ``term`` has ``top_terms`` terms at most.
    """
    kept = materialize(kept_counts(docs, min_documents), "kept")
    table = materialize(groups(docs, kept), "groups")
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = _pairs(kept, table).select("lang", "source", F.lit("pair").alias("part"), "item", "value", F.row_number().over(order).alias("rank"))
    terms = _terms(kept, table).select("lang", "source", F.lit("term").alias("part"), "item", "value", F.row_number().over(order).alias("rank"))
    return pairs.unionByName(terms.where(F.col("rank") <= top_terms))
