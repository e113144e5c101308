"""Near duplicates by SimHash, with fuzzy keys from the Golay code.

A fingerprint of 64 bits is cut into three segments of at most 23 bits.  The perfect binary Golay code of
length 23 puts every word within three bits of exactly one codeword, named by an index of twelve bits.  A
segment is decoded itself and with each of its bits turned, which gives the indices of all codewords nearby (one if
it stands close to a codeword, else six); two segments that differ in one bit have the own index of either
among the nearby ones of the other.

Two fingerprints that link differ in at most three bits, which three segments share out: either some
segment is equal and another differs in at most one bit, or each differs in exactly one.  So a fingerprint has
a key for each ordered pair of segments and nearby index of the first (with the second as it is), and for the triple
(own index everywhere but nearby in the first segment, or in the other two).  Fingerprints that link share a key.

Fingerprints of one key are sorted beside each other.  Each is verified against the smallest, and what links is
joined; only keys that still hold several components, and more than two fingerprints, are looked at again: cut
into bounded blocks in which one component is alone if it is large, and multiplied block by block but never
within one component.  Tasks hand over spanning links only, and equal fingerprints are one all along.

Nulls and edge cases: null and empty texts, and texts without words, have the fingerprint zero, which
links like any other.  Fewer words than a shingle has are one shingle.  Rows that share an id stay separate
rows, each in the component of its own text.  Rows with a null id have a fingerprint, link with nothing and have a null
component.  An empty table gives an empty result.  Other columns are not looked at.
"""

from __future__ import annotations

import functools
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize, texts
from .components import components

WORDS, SEED, DISTANCE = 3, 42, 3
# Fixed values of the code: its length, the degree of its generator, and the generator
# x^11 + x^9 + x^7 + x^6 + x^5 + x + 1.
LENGTH, CHECKS, GENERATOR = 23, 11, 0b101011100011
# Segments: first bit and width.
SEGMENTS = ((0, 22), (22, 21), (43, 21))
NEARBY = 6
# Shingles counted at once, fingerprints keyed at once, and fingerprints of one block.
SLICE_SHINGLES = 1 << 15
SLICE_KEYED = 1 << 12
BLOCK = 512


def fingerprint(text: str, words: int = WORDS) -> int:
    """A bit is set if it is in the hashes of more than half of the shingles."""
    found = text.encode().lower().split()  # bytes: A-Z and the six ASCII spaces only
    if not found:
        return 0
    joined = b" ".join(found)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
    width = min(words, len(found))
    starts = np.append(0, ends[:-1] + 1)[: len(found) - width + 1].tolist()
    ends = ends[width - 1 :].tolist()
    ones = np.zeros(64, np.int64)
    for first in range(0, len(starts), SLICE_SHINGLES):
        upto = first + SLICE_SHINGLES
        hashes = [xxhash.xxh64_intdigest(joined[a:b], SEED) for a, b in zip(starts[first:upto], ends[first:upto], strict=True)]
        bits = np.unpackbits(np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(starts), bitorder="little").view("<u8")[0])


def signed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS) -> DataFrame:
    """``(doc_id, fp)`` of every row; the fingerprint as a signed long."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.fromiter((fingerprint(text.as_py(), words) for text in batch.column("text")), np.uint64, batch.num_rows)
            yield pa.record_batch({"doc_id": batch.column("doc_id"), "fp": pa.array(found.view(np.int64))})

    return texts(docs, id_col, text_col).mapInArrow(sign, "doc_id bigint, fp bigint")


def _remainder(word: int) -> int:
    for place in range(LENGTH - 1, CHECKS - 1, -1):
        if word >> place & 1:
            word ^= GENERATOR << (place - CHECKS)
    return word


@functools.cache
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Remainders of each byte at each of three places, and the error of at most three bits of each remainder."""
    bytes_at = np.array([[_remainder(byte << shift & (1 << LENGTH) - 1) for byte in range(256)] for shift in (0, 8, 16)], np.uint32)
    errors = np.zeros(1 << CHECKS, np.uint32)
    for weight in range(1, 4):
        for places in itertools.combinations(range(LENGTH), weight):
            error = sum(1 << place for place in places)
            errors[_remainder(error)] = error
    return bytes_at, errors


def decode(words: np.ndarray) -> np.ndarray:
    """Index of the codeword within three bits of each word of ``LENGTH`` bits."""
    bytes_at, errors = _tables()
    remainder = bytes_at[0][words & 0xFF] ^ bytes_at[1][words >> 8 & 0xFF] ^ bytes_at[2][words >> 16]
    return (words ^ errors[remainder]) >> CHECKS


def nearby(segments: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Own index of each segment, and the distinct indices with at most one of its ``width`` bits turned (padded, with a mask)."""
    turned = np.append(np.uint32(0), np.uint32(1) << np.arange(width, dtype=np.uint32))
    found = decode(segments[:, None] ^ turned)
    own = found[:, 0].copy()
    found.sort(axis=1)
    fresh = np.ones(found.shape, bool)
    fresh[:, 1:] = found[:, 1:] != found[:, :-1]
    order = np.argsort(~fresh, axis=1, kind="stable")[:, :NEARBY]
    return own, np.take_along_axis(found, order, 1), np.take_along_axis(fresh, order, 1)


def keys(fingerprints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(row, key)`` of every key of every fingerprint (unsigned 64-bit)."""
    parts = [((fingerprints >> np.uint64(first)) & np.uint64((1 << width) - 1)).astype(np.uint32) for first, width in SEGMENTS]
    own, near, real = zip(*(nearby(part, width) for part, (_, width) in zip(parts, SEGMENTS, strict=True)), strict=True)
    own, near = [index.astype(np.int64) for index in own], [index.astype(np.int64) for index in near]
    rows, found = [], []

    def give(kind: int, values: np.ndarray, mask: np.ndarray) -> None:
        row = np.nonzero(mask)[0]
        rows.append(row)
        found.append((kind << 40) | values[mask])

    for kind, (fuzzy, exact) in enumerate(itertools.permutations(range(3), 2)):
        give(kind, near[fuzzy] << 22 | parts[exact].astype(np.int64)[:, None], real[fuzzy])
    # Each segment differs in one bit: one side looks around in the first, the other in the second and third.
    give(6, near[0] << 24 | (own[1] << 12 | own[2])[:, None], real[0] & (near[0] != own[0][:, None]))
    give(6, own[0][:, None, None] << 24 | near[1][:, :, None] << 12 | near[2][:, None, :], real[1][:, :, None] & real[2][:, None, :])
    return np.concatenate(rows), np.concatenate(found)


def _keyed(distinct: DataFrame) -> DataFrame:
    """``(key, fp)`` of distinct fingerprints."""

    def give(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, SLICE_KEYED):
                fps = batch.column("fp").slice(first, SLICE_KEYED).to_numpy(zero_copy_only=False)
                rows, found = keys(fps.view(np.uint64))
                yield pa.record_batch({"key": pa.array(found), "fp": pa.array(fps[rows])})

    return distinct.select("fp").mapInArrow(give, "key bigint, fp bigint")


def _close(left: np.ndarray, right: np.ndarray, distance: int) -> np.ndarray:
    return np.bitwise_count(left.view(np.uint64) ^ right.view(np.uint64)) <= distance


def _gathered(keyed: DataFrame, distance: int) -> DataFrame:
    """``(key, fp, hub, near)`` of keys that several fingerprints share; the hub is the smallest of them.

    Keys stand sorted in a task, which remembers no more of a key than its hub.
    """

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, hub, told = None, None, False  # the key that is open, its hub, and whether the hub has been given
        for batch in batches:
            key, fp = (batch.column(name).to_numpy(zero_copy_only=False) for name in ("key", "fp"))
            if not len(key):
                continue
            starts = np.append(at is None or key[0] != at, key[1:] != key[:-1])
            place = np.maximum.accumulate(np.where(starts, np.arange(len(key)), -1))
            hubs = np.where(place < 0, hub if hub is not None else 0, fp[place])
            given = ~starts
            given[:-1] |= starts[:-1] & ~starts[1:]
            out = [key[given], fp[given], hubs[given]]
            if not starts[0] and not told:
                out = [np.append(first, rest) for first, rest in zip((at, hub, hub), out, strict=True)]
            told = bool(given[-1]) or (not starts[-1])
            at, hub = key[-1], hubs[-1]
            yield pa.record_batch(
                {"key": pa.array(out[0]), "fp": pa.array(out[1]), "hub": pa.array(out[2]), "near": pa.array(_close(out[1], out[2], distance))}
            )

    ordered = keyed.repartition("key").sortWithinPartitions("key", "fp")
    return ordered.mapInArrow(gather, "key bigint, fp bigint, hub bigint, near boolean")


def _blocks(members: DataFrame, block: int) -> DataFrame:
    """``(key, one, two, fp, label)``: the members of each key by pairs of blocks (``one`` and ``two``) to compare.

    A component with more than a block of members of a key has blocks of its own there; all others share some.
    """
    sizes = members.groupBy("key", "label").agg(F.count("*").alias("n"))
    large = sizes.where(F.col("n") > block).select("key", "label", F.lit(True).alias("large"))
    placed = members.join(large, ["key", "label"], "left").withColumn("alone", F.when(F.col("large"), F.col("label")))
    counts = placed.groupBy("key", "alone").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    numbered = counts.groupBy("key").agg(F.collect_list(F.struct("alone", "blocks")).alias("groups"))  # one entry for a block at least
    numbered = numbered.select(
        "key",
        F.flatten(
            F.transform("groups", lambda g: F.transform(F.sequence(F.lit(0), g["blocks"] - 1), lambda i: F.struct(g["alone"].alias("alone"), i.alias("i"))))
        ).alias("all"),
    )
    groups = counts.join(numbered, "key").withColumn("mine", F.col("alone"))
    cut = placed.join(
        groups.select(F.col("key").alias("k"), "mine", "blocks", "all"), (F.col("key") == F.col("k")) & F.col("alone").eqNullSafe(F.col("mine"))
    ).withColumn("own", F.struct("alone", F.pmod(F.xxhash64("fp", "label"), F.col("blocks")).cast("int").alias("i")))
    others = F.filter("all", lambda other: F.coalesce(other["alone"] != F.col("alone"), F.lit(True)))
    pairs = cut.select("key", "fp", "label", "own", F.explode(others).alias("other"))
    return pairs.select(
        "key",
        F.least("own", "other").alias("one"),
        F.greatest("own", "other").alias("two"),
        "fp",
        "label",
    )


def _forest(pairs: np.ndarray) -> list[tuple[int, int]]:
    """As many of ``pairs`` as join what they all join."""
    parent: dict[int, int] = {}

    def root(at: int) -> int:
        while parent.setdefault(at, at) != at:
            parent[at] = at = parent[parent[at]]
        return at

    kept = []
    for a, b in np.unique(pairs, axis=0).tolist():
        low, high = root(a), root(b)
        if low != high:
            parent[high] = low
            kept.append((low, high))
    return kept


def _compared(members: DataFrame, distance: int, block: int) -> DataFrame:
    """``(a, b)``: labels of components that a link joins, from blocks of fingerprints that share a key."""

    def links(fp: np.ndarray, label: np.ndarray) -> list[tuple[int, int]]:
        a, b = np.nonzero(_close(fp[:, None], fp[None, :], distance) & (label[:, None] < label[None, :]))
        return _forest(np.stack([label[a], label[b]], axis=1)) if len(a) else []

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] | None = None  # the pair of blocks that is open; a pair is bounded

        def found(group: np.ndarray, columns: list[np.ndarray]) -> list[tuple[int, int]]:
            cuts = np.append(np.flatnonzero(np.append(True, group[1:] != group[:-1])), len(group))
            return [pair for a, b in itertools.pairwise(cuts) for pair in links(*(column[a:b] for column in columns))]

        def given(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
            return pa.record_batch({name: pa.array([pair[at] for pair in pairs], pa.int64()) for at, name in enumerate("ab")})

        for batch in batches:
            now = [batch.column(name).to_numpy(zero_copy_only=False) for name in ("group", "fp", "label")]
            if held is not None:
                now = [np.append(before, after) for before, after in zip(held, now, strict=True)]
            if not len(now[0]):
                continue
            last = np.flatnonzero(np.append(True, now[0][1:] != now[0][:-1]))[-1]
            yield given(found(now[0][:last], [column[:last] for column in now[1:]]) if last else [])
            held = [column[last:] for column in now]
        if held is not None:
            yield given(found(held[0], held[1:]))

    # All of a group are compared, so groups with equal hashes cost time and lose nothing.
    grouped = _blocks(members, block).select(F.xxhash64("key", "one", "two").alias("group"), "fp", "label")
    ordered = grouped.repartition("group").sortWithinPartitions("group")
    return ordered.mapInArrow(compare, "a bigint, b bigint")


def linked(distinct: DataFrame, distance: int = DISTANCE, block: int = BLOCK) -> DataFrame:
    """``(fp, label)`` of distinct fingerprints that link with another; equal labels are one component."""
    gathered = materialize(_gathered(_keyed(distinct), distance), "gathered")
    first = materialize(
        components(gathered.where("near and fp <> hub").select(F.col("hub").alias("a"), F.col("fp").alias("b"))), "first"
    )
    labelled = gathered.select("key", "fp").join(first.withColumnRenamed("node", "fp"), "fp", "left").select(
        "key", "fp", F.coalesce("label", "fp").alias("label")
    )
    # Of two fingerprints the one has been verified against the other already.
    open_keys = labelled.groupBy("key").agg(F.count("*").alias("n"), F.min("label").alias("low"), F.max("label").alias("high"))
    members = materialize(labelled.join(open_keys.where("n > 2 and low <> high").select("key"), "key", "left_semi"), "members")
    second = components(_compared(members, distance, block))
    discard(gathered)
    found = first.unionByName(second.join(first.select("node"), "node", "left_anti"))
    renamed = second.select(F.col("node").alias("label"), F.col("label").alias("last"))
    return found.join(renamed, "label", "left").select(F.col("node").alias("fp"), F.coalesce("last", "label").alias("label"))


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, distance: int = DISTANCE, block: int = BLOCK
) -> DataFrame:
    """``(doc_id, fp, component_id)`` of every row; the component is named by its smallest id.

    ``distance`` may be less than ``DISTANCE``, for which the keys are made, not more.
    """
    if not 0 <= distance <= DISTANCE:
        raise ValueError(f"keys find at most {DISTANCE} differing bits")
    rows = materialize(signed(docs, id_col, text_col, words), "fingerprints")
    distinct = rows.where("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("least_id"))
    named = distinct.join(linked(distinct, distance, block), "fp", "left").withColumn("label", F.coalesce("label", "fp"))
    smallest = named.groupBy("label").agg(F.min("least_id").alias("component_id"))
    found = named.join(smallest, "label").select("fp", "component_id")
    return rows.join(found, "fp", "left").select("doc_id", "fp", F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))
