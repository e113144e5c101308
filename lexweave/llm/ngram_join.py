"""Near duplicates by Jaccard of word shingles, exactly, as a blocked sparse matrix product.

Rows of the matrix are the distinct sets of shingles, columns the shingles.  The columns
are cut into blocks by the value of their hash.  Two sets of sizes ``a`` and ``b`` that link differ in
at most ``d = (a + b)(1 - t) / (1 + t)`` shingles, so with more than ``d`` blocks some
block is equal in both: pairs without an equal block are below the bound and are never
multiplied.  Sizes are cut into overlapping ranges, so that sets which can link at all share a
range and its number of blocks.

Sets that share fewer blocks with all others together than the bound of their size asks for
are left out, and of the blocks of a set as many of the most frequent as it could do without.
What still shares a block forms clusters, which chains of texts with little in common make very large.  They are
parted by sketches first: a set's parities of how many of its shingles fall on each of about as many bits as it has shingles.  Two sets
differ in at least as many shingles as their sketches in bits, so pairs whose sketches differ in more than ``d`` bits
cannot link; only sets joined by the others stay together.  A sketch has a fiftieth of the bytes of its set,
and only those travel to many blocks.  The rows of what remains are multiplied in
the tasks, a bounded block of rows with another, over the columns both have: overlaps are
accumulated, pairs below the bound of their sizes are discarded, and a task hands over only as many links
as join what it found linked.  Pairs are never rows of a table.

Nulls and edge cases: null and empty texts, and texts without words, have no
shingles and link with nothing.  Fewer words than a shingle has are one shingle.  Texts with equal sets are
one row of the matrix.  Rows that share an id stay separate rows with their own size, and one component.
Rows with a null id link with nothing
and have a null component.  An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import small_side
from .common import discard, materialize, text_slices
from .components import components

# Sets of one block of rows, and columns multiplied at once.
BLOCK = 256
COLUMNS = 4096
# Sketches of one block, bits of the largest sketch, and words of sketches compared at once.
SKETCH_BLOCK = 2048
SKETCH_BITS = 1 << 16
SLICE_WORDS = 1 << 21
# Words whose hashes a task remembers, and hashes it hands over at once.
CACHED_WORDS = 1 << 16
SLICE_HASHES = 1 << 19
_ODD = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xD6E8FEB86659FD93)


@dataclass(frozen=True)
class Settings:
    """Links: ``100 * intersection >= percent * union`` over shingles of ``words`` words."""

    words: int = 4
    percent: int = 85
    growth: float = 1.5


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        found = self[word] = xxhash.xxh3_64_intdigest(word)
        return found


def _mixed(values: np.ndarray) -> np.ndarray:
    values = (values ^ (values >> np.uint64(32))) * _MIX
    return values ^ (values >> np.uint64(29))


def shingles(text: str, words: int, cache: _Hashes) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of a text."""
    found = text.encode().lower().split()  # bytes: A-Z and the six ASCII spaces only
    if not found:
        return np.empty(0, np.uint64)
    if len(cache) > CACHED_WORDS:
        cache.clear()
    hashes = np.fromiter(map(cache.__getitem__, found), np.uint64, len(found))
    width = min(words, len(found))
    count = len(found) - width + 1
    rolled = np.full(count, width, np.uint64)
    for j in range(width):
        rolled = _mixed(rolled * _ODD + hashes[j : j + count])
    return np.unique(rolled)


def size_ranges(size: int, settings: Settings) -> list[tuple[int, int]]:
    """``(range, largest size)`` of the ranges a set belongs to; sets that can link share one.

    Range ``g`` holds sizes from ``growth ** g`` up to what can link with one below ``growth ** (g + 1)``.
    """
    share, first = settings.percent / 100, math.log(settings.growth)
    top = int(math.log(size) / first + 1e-9)
    found = []
    for g in range(max(0, top - 2), top + 2):
        largest = math.floor(settings.growth ** (g + 1) / share)
        if settings.growth**g <= size <= largest:
            found.append((g, largest))
    return found


def most_different(total: int, settings: Settings) -> int:
    """How many shingles two sets that link, of ``total`` size together, may have in one of them only."""
    return (100 - settings.percent) * total // (100 + settings.percent)


def empty_blocks(differ: int) -> int:
    """Empty blocks a set may have without giving their keys."""
    return 2 + differ // 64


def block_count(largest: int, settings: Settings) -> int:
    """Blocks of a range: more than may differ, so that sets which link share a good number."""
    differ = most_different(2 * largest, settings)
    return differ + 3 + differ // 12


def least_equal(size: int, settings: Settings) -> int:
    """The fewest keys a set of a size shares with any set it links with."""
    found = []
    for _, largest in size_ranges(size, settings):
        differ, partner = most_different(2 * largest, settings), min(largest, 100 * size // settings.percent)
        found.append(block_count(largest, settings) - most_different(size + partner, settings) - empty_blocks(differ))
    return min(found)


def block_keys(grams: np.ndarray, settings: Settings) -> np.ndarray:
    """Keys of the blocks of a set; equal blocks (of one range) have equal keys.

    If a set has so many empty blocks that they might be all it has in common with another,
    their keys are given too.
    """
    keys = []
    for g, largest in size_ranges(len(grams), settings):
        differ = most_different(2 * largest, settings)
        if differ == 0:
            continue  # such sets link only if they are equal
        count = block_count(largest, settings)
        block = ((grams >> np.uint64(32)) * np.uint64(count)) >> np.uint64(32)
        starts = np.flatnonzero(np.append(True, block[1:] != block[:-1]))
        sums = np.add.reduceat(_mixed(grams), starts)
        names = block[starts]
        empty = np.setdiff1d(np.arange(count, dtype=np.uint64), names)
        if len(empty) > empty_blocks(differ):
            names, sums = np.append(names, empty), np.append(sums, np.zeros(len(empty), np.uint64))
        keys.append(_mixed(_mixed(sums * _ODD + names) + np.uint64(g + 1)))
    return np.concatenate(keys) if keys else np.empty(0, np.uint64)


def sketch(grams: np.ndarray) -> np.ndarray:
    """The parities of how many shingles fall on each bit, by the low bits of their hashes, as 64-bit words.

    There are as many bits as shingles, up to the next power of two, at least 64 and at most ``SKETCH_BITS``.
    """
    bits = min(max(64, 1 << (len(grams) - 1).bit_length()), SKETCH_BITS)
    odd = (np.bincount((grams & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1).astype(np.uint8)
    return np.packbits(odd, bitorder="little").view(np.uint64)


def folded(sketches: np.ndarray, words: int) -> np.ndarray:
    """The same sketches (a row each) with fewer words."""
    while sketches.shape[1] > words:
        half = sketches.shape[1] // 2
        sketches = sketches[:, :half] ^ sketches[:, half:]
    return sketches


def _lists(values: list[np.ndarray | None]) -> pa.Array:
    """Arrays of numbers, or nulls, as a column of lists."""
    sizes = np.array([0 if value is None else len(value) for value in values], np.int32)
    offsets = pa.array(np.append(0, np.cumsum(sizes)), pa.int32())
    held = [value for value in values if value is not None]
    missing = pa.array([value is None for value in values], pa.bool_())
    flat = np.concatenate(held) if held else np.empty(0, np.int64)
    return pa.ListArray.from_arrays(offsets, pa.array(flat, pa.int64()), mask=missing)


def _flushed(rows: Iterator[tuple], columns: list[str], lists: int = 1) -> Iterator[pa.RecordBatch]:
    """Rows as batches of bounded size; the last ``lists`` of ``columns`` hold arrays of numbers or None, the others numbers or None."""

    def given(held: list[tuple]) -> pa.RecordBatch:
        found = list(zip(*held, strict=True))
        numbers = [pa.array(column, pa.int64()) for column in found[:-lists]]
        return pa.RecordBatch.from_arrays([*numbers, *(_lists(list(column)) for column in found[-lists:])], columns)

    held, weight = [], 0
    for row in rows:
        held.append(row)
        weight += 64 + sum(len(item) for item in row[-lists:] if item is not None)
        if weight >= SLICE_HASHES:
            yield given(held)
            held, weight = [], 0
    if held:
        yield given(held)


def signed(docs: DataFrame, settings: Settings, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_shingles, node, least, sketch, keys)``: ``node`` is the hash of the set, null if it is empty.

    ``least`` is the number of keys it shares with any set it links with.

    A task gives the sketch and the keys of equal sets once, for a row with an id.
    """

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, seen = _Hashes(), set()

        def rows():
            for part in text_slices(batches):
                for doc_id, text in zip(*(part.column(name).to_pylist() for name in ("doc_id", "text")), strict=True):
                    grams = shingles(text, settings.words, cache)
                    if not len(grams):
                        yield doc_id, 0, None, 0, None, None
                        continue
                    node = _node(grams)
                    known = doc_id is not None  # rows without an id link with nothing and stand for no other
                    fresh = known and node not in seen
                    if known:
                        seen.add(node)
                    lists = [item.view(np.int64) for item in (sketch(grams), block_keys(grams, settings))] if fresh else [None, None]
                    yield doc_id, len(grams), node, least_equal(len(grams), settings), *lists

        yield from _flushed(rows(), ["doc_id", "n_shingles", "node", "least", "sketch", "keys"], lists=2)

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(text_col, F.lit("")).alias("text"))
    schema = "doc_id bigint, n_shingles bigint, node bigint, least bigint, sketch array<bigint>, keys array<bigint>"
    return source.mapInArrow(sign, schema)


def _node(grams: np.ndarray) -> int:
    """The name of a set."""
    return xxhash.xxh3_64_intdigest(grams.tobytes()) - (1 << 63)


def _sets(docs: DataFrame, chosen: DataFrame, settings: Settings, node: str) -> DataFrame:
    """``chosen`` (``doc_id`` and other numbers) with ``grams`` in place of the id; its column ``node`` names the set.

    The ids are broadcast if counted to be few, else joined by a shuffle.  A set is computed once for
    rows of one document that follow each other.
    """
    names = [name for name in chosen.columns if name != "doc_id"]
    at = names.index(node)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = _Hashes()

        def rows():
            last, grams, name = None, None, None
            for part in text_slices(batches):
                for doc_id, text, *others in zip(*(column.to_pylist() for column in part.columns), strict=True):
                    if (doc_id, text) != last:
                        last, grams = (doc_id, text), shingles(text, settings.words, cache).view(np.int64)
                        name = _node(grams)
                    if others[at] == name:  # else another row with this id
                        yield *others, grams

        yield from _flushed(rows(), [*names, "grams"])

    schema = ", ".join(f"{name} bigint" for name in names)
    return (
        docs.join(small_side(chosen), "doc_id").select("doc_id", "text", *(F.col(name).cast("long") for name in names))
        .mapInArrow(hashed, f"{schema}, grams array<bigint>")
    )


def overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """The product of two blocks of rows: how many shingles each set of ``left`` shares with each of ``right``.

    Only columns that both blocks have are multiplied, ``COLUMNS`` at a time, and the counts add up.
    """
    found = [np.concatenate(side) for side in (left, right)]
    rows = [np.repeat(np.arange(len(side)), [len(item) for item in side]) for side in (left, right)]
    columns = np.intersect1d(np.unique(found[0]), np.unique(found[1]), assume_unique=True)
    counts = np.zeros((len(left), len(right)), np.float32)
    if not len(columns):
        return counts
    entries = []
    for values, row in zip(found, rows, strict=True):
        at = np.minimum(np.searchsorted(columns, values), len(columns) - 1)
        hit = columns[at] == values
        order = np.argsort(at[hit], kind="stable")
        entries.append((at[hit][order], row[hit][order]))
    for first in range(0, len(columns), COLUMNS):
        width, dense = min(COLUMNS, len(columns) - first), []
        for (at, row), side in zip(entries, (left, right), strict=True):
            begin, end = np.searchsorted(at, [first, first + width])
            block = np.zeros((len(side), width), np.float32)
            block[row[begin:end], at[begin:end] - first] = 1
            dense.append(block)
        counts += dense[0] @ dense[1].T
    return counts


def _forest(pairs: np.ndarray) -> list[tuple[int, int]]:
    """As many of ``pairs`` as join what they all join."""
    return _joined(pairs)[0]


def _joined(pairs: np.ndarray) -> tuple[list[tuple[int, int]], dict[int, int]]:
    """As many of ``pairs`` as join what they all join, and one name for all that is joined, by its members."""
    parent: dict[int, int] = {}

    def root(at: int) -> int:
        while parent.setdefault(at, at) != at:
            parent[at] = at = parent[parent[at]]
        return at

    kept = []
    for a, b in pairs.tolist():
        low, high = root(a), root(b)
        if low != high:
            parent[high] = low
            kept.append((a, b))
    return kept, {at: root(at) for at in list(parent)}


def block_pairs(placed: DataFrame, settings: Settings, block: int) -> DataFrame:
    """``placed`` (``doc_id``, ``node``, ``size``, ``label``), once per pair of blocks it takes part in.

    A cluster (``label``) of up to ``block`` sets is one block.  A larger one is cut by classes of size, so
    that only equal and neighbouring classes can link, and these by hash into blocks.
    """
    ratio = math.log(100 / settings.percent)
    totals = placed.groupBy("label").agg(F.count("*").alias("total"))
    classed = placed.join(totals, "label").withColumn(
        "c", F.when(F.col("total") <= block, 0).otherwise(F.floor(F.log(F.col("size").cast("double")) / ratio + 1e-9)).cast("int")
    )
    counts = materialize(classed.groupBy("label", "c").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks")), "classes")
    above = counts.select("label", (F.col("c") - 1).alias("c"), F.col("blocks").alias("above"))
    below = counts.select("label", (F.col("c") + 1).alias("c"), F.col("blocks").alias("below"))
    counts = counts.join(above, ["label", "c"], "left").join(below, ["label", "c"], "left")
    cut = classed.join(counts, ["label", "c"]).withColumn("sub", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))

    def places(count: Column, make) -> Column:
        return F.transform(F.sequence(F.lit(0), F.coalesce(count, F.lit(0)) - 1), make)

    def place(c: Column, i: Column, step: int, j: Column, right: Column) -> Column:
        return F.struct(
            c.alias("c"), i.alias("i"), F.lit(step).alias("step"), j.alias("j"), right.cast("int").alias("right")
        )

    c, sub = F.col("c"), F.col("sub")
    none = F.array().cast("array<struct<c:int,i:int,step:int,j:int,right:int>>")
    own = places(F.col("blocks"), lambda j: place(c, F.least(sub, j), 0, F.greatest(sub, j), sub > j))
    up = F.when(F.col("above").isNull(), none).otherwise(places(F.col("above"), lambda j: place(c, sub, 1, j, F.lit(0))))
    down = F.when(F.col("below").isNull(), none).otherwise(places(F.col("below"), lambda i: place(c - 1, i, 1, sub, F.lit(1))))
    return cut.select("doc_id", "node", "size", "label", F.inline(F.concat(own, up, down)))


def sketched_pairs(left: tuple, right: tuple, settings: Settings) -> np.ndarray:
    """As many pairs of places in ``left`` and ``right`` as join what all pairs join that their sketches leave possible.

    A side is its names, sizes and sketches.  Pairs are compared a slice of rows at a time; those that
    join nothing new are dropped with each slice.
    """
    percent, kept = settings.percent, []
    _, names = np.unique(np.concatenate([left[0], right[0]]), return_inverse=True)
    label = np.arange(names.max() + 1)

    def by_width(side: tuple, own: np.ndarray) -> dict[int, tuple]:
        widths = np.array([len(item) for item in side[2]])
        return {
            width: (at := np.flatnonzero(widths == width), own[at], side[1][at], np.stack([side[2][i] for i in at]))
            for width in np.unique(widths).tolist()
        }

    sides = by_width(left, names[: len(left[0])]), by_width(right, names[len(left[0]) :])
    for a, (places, a_names, a_sizes, a_sketches) in sides[0].items():
        for b, (others, b_names, b_sizes, b_sketches) in sides[1].items():
            if percent * max(a, b) >= 200 * min(a, b):
                continue  # their sizes are too far apart
            words = min(a, b)
            a_words, b_words = folded(a_sketches, words), folded(b_sketches, words)
            step = max(1, SLICE_WORDS // (len(others) * words))
            for first in range(0, len(places), step):
                rows = slice(first, first + step)
                differ = np.bitwise_count(a_words[rows, None, :] ^ b_words[None, :, :]).sum(axis=2, dtype=np.int32)
                one, other = a_sizes[rows, None], b_sizes[None, :]
                near = (100 + percent) * differ <= (100 - percent) * (one + other)
                near &= 100 * np.minimum(one, other) >= percent * np.maximum(one, other)
                near &= label[a_names[rows]][:, None] != label[b_names][None, :]
                at, to = np.nonzero(near)
                if not len(at):
                    continue
                pairs = np.stack([label[a_names[rows][at]], label[b_names[to]], places[rows][at], others[to]], axis=1)
                _, once = np.unique(np.sort(pairs[:, :2], axis=1), axis=0, return_index=True)
                pairs = pairs[once]
                known = {(x, y): place for x, y, *place in pairs.tolist()}
                forest, roots = _joined(pairs[:, :2])
                kept += [known[pair] for pair in forest]
                moved = np.arange(len(label))
                moved[list(roots)] = list(roots.values())
                label = moved[label]
    return np.array(kept, np.int64).reshape(-1, 2)


def parted(placed: DataFrame, sketches: DataFrame, settings: Settings, block: int = SKETCH_BLOCK) -> DataFrame:
    """Pairs (``a``, ``b``) that join all sets of ``placed`` whose sketches do not rule out that they link.

    ``sketches`` has one of each ``node``.
    """

    def compared(frame: pd.DataFrame) -> pd.DataFrame:
        def side(rows: pd.DataFrame) -> tuple:
            return rows["node"].to_numpy(), rows["size"].to_numpy(), [np.asarray(item).view(np.uint64) for item in rows["sketch"]]

        left, right = (side(frame[frame["right"] == which]) for which in (0, 1))
        right = right if len(right[0]) else left
        if not len(left[0]):
            return pd.DataFrame({"a": [], "b": []})
        found = sketched_pairs(left, right, settings)
        return pd.DataFrame({"a": left[0][found[:, 0]], "b": right[0][found[:, 1]]})

    dealt = block_pairs(placed, settings, block).drop("doc_id").join(sketches, "node")
    return dealt.groupBy("label", "c", "i", "step", "j").applyInPandas(compared, "a bigint, b bigint")


def multiply(docs: DataFrame, placed: DataFrame, settings: Settings, block: int) -> DataFrame:
    """Links (``a``, ``b``) that join all sets of ``placed`` which links join, from products of blocks in the tasks."""
    percent = settings.percent

    def product(frame: pd.DataFrame) -> pd.DataFrame:
        sides = [frame[frame["right"] == side] for side in (0, 1)]
        if sides[1].empty:
            sides[1] = sides[0]
        if sides[0].empty:
            return pd.DataFrame({"a": [], "b": []})
        counts = overlaps(sides[0]["grams"].tolist(), sides[1]["grams"].tolist())
        sizes = [side["grams"].str.len().to_numpy(dtype=np.float64) for side in sides]
        total = sizes[0][:, None] + sizes[1][None, :]
        found = np.argwhere(100 * counts >= percent * (total - counts))
        names = [side["node"].to_numpy() for side in sides]
        pairs = np.stack([names[0][found[:, 0]], names[1][found[:, 1]]], axis=1)
        return pd.DataFrame(_forest(pairs[pairs[:, 0] != pairs[:, 1]]), columns=["a", "b"])

    chosen = materialize(block_pairs(placed, settings, block).drop("size"), "blocks")
    sets = _sets(docs, chosen, settings, "node")
    return sets.groupBy("label", "c", "i", "step", "j").applyInPandas(product, "a bigint, b bigint")


def near_duplicates(
    docs: DataFrame, settings: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text",  # noqa: B008
    block: int = BLOCK,
) -> DataFrame:
    """``(doc_id, n_shingles, component_id)`` of every row; the component is named by its smallest id."""
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(text_col, F.lit("")).alias("text"))
    table = materialize(signed(docs, settings).withColumn("row", F.monotonically_increasing_id()), "signed")
    rows = materialize(table.drop("keys"), "sizes")
    # What several branches read is written first, here and below: a plan that holds its inputs again in each branch doubles
    # with every step, and the driver keeps all of it.
    owners = materialize(
        rows.where("node is not null and doc_id is not null").groupBy("node").agg(
            F.min("doc_id").alias("doc_id"), F.first("n_shingles").alias("size"), F.first("least").alias("least")
        ),
        "owners",
    )
    # Row numbers stand for nodes here, since they shrink better; a key that occurs once is no candidate.  Every key goes through
    # one exchange only, and is counted where it arrives.
    entries = table.where("doc_id is not null").select("row", F.explode("keys").alias("key"))
    shared = entries.withColumn("n", F.count("*").over(Window.partitionBy("key"))).where("n > 1").select("row", "key")
    found = shared.join(rows.select("row", "node"), "row")
    found = materialize(found.select("key", "node").distinct(), "found")
    discard(table)
    members = found
    for step in (_pruned, _pruned, _rarest):
        found, members = members, materialize(step(members, owners), "members")
        discard(found)
    hubs = members.groupBy("key").agg(F.min("node").alias("hub"))
    near = members.join(hubs, "key").where("node <> hub").select(F.col("hub").alias("a"), F.col("node").alias("b"))
    clusters = components(near)
    discard(members)
    sketches = rows.where("sketch is not null").dropDuplicates(["node"]).select("node", "sketch")
    parts = components(parted(_placed(clusters, owners), sketches, settings))
    labels = components(multiply(docs, _placed(parts, owners), settings, block))

    named = rows.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    smallest = named.where("label is not null").groupBy("label").agg(F.min("doc_id").alias("least_id"))
    return named.join(smallest, "label", "left").select(
        "doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("least_id", "doc_id")).alias("component_id")
    )


def _placed(clusters: DataFrame, owners: DataFrame) -> DataFrame:
    """The sets of ``clusters`` with an id and their size."""
    return materialize(clusters.join(owners, "node").select("doc_id", "node", "size", "label"), "placed")


def _pruned(found: DataFrame, owners: DataFrame) -> DataFrame:
    """``found`` without sets that share too few keys to link with any, and then without keys of one set."""
    counted = found.groupBy("node").agg(F.count("*").alias("n")).join(owners.select("node", "least"), "node")
    kept = found.join(counted.where("n >= least").select("node"), "node").select("key", "node")
    several = kept.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    return kept.join(several, "key").select("key", "node")


def _rarest(members: DataFrame, owners: DataFrame) -> DataFrame:
    """``members`` without the ``least - 1`` most frequent keys of each set.

    Two sets that link share ``least`` keys of either, so in one order of all keys one of those that
    are left is still common to them.
    """
    frequent = members.groupBy("key").agg(F.count("*").alias("n"))
    counted = members.join(frequent, "key").join(owners.select("node", "least"), "node")
    order = Window.partitionBy("node").orderBy(F.desc("n"), "key")
    return counted.withColumn("at", F.row_number().over(order)).where("at >= least").select("key", "node")
