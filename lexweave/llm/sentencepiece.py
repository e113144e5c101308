"""SentencePiece encoding as a relational lattice, and decoding.

A text becomes units that no piece crosses: a run of word starts (spaces) with the
word behind it, or a line feed; a mark or digit that follows a letter in no piece begins another unit
(``unit_pattern``).  Each distinct unit of the corpus is segmented once: its
substrings of bounded length are exploded and joined to the table of pieces by
equality; the pieces found are the edges of a lattice, which are grouped by unit and
place and folded by the higher-order ``aggregate``: the best sum of scores up to each place
(Viterbi).  Characters without a piece become their bytes.

The segmented units reach the texts without moving them while their table is measured
to be small (``MAX_DICTIONARY_BYTES``): the tasks read it from the shared folder into a few arrays.  A larger
table is sorted by the hash of the unit, and a task goes over it once for each ``HELD_BYTES`` of its texts; texts are never dealt out.

The scores are those of the model file, taken as a unigram model takes them.  A file whose
pieces come from merges (BPE) is segmented by the best sum of its scores too, which is
not always the order of its merges; decoding gives the text back either way.

Nulls and edge cases: null and empty texts have no ids; any other text gets the leading space that
decoding takes off.  U+2581 is taken for a space, as the format does.  Ties go to the
longer piece at the end.  A unit's lattice is bounded by its length; repeated rows are encoded alike, and an
empty table gives an empty result.  Columns beside the two named ones stay, unless they are called ``ids``.
"""

from __future__ import annotations

import re
import string
from collections import defaultdict
from collections.abc import Iterator
from itertools import count, pairwise

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import discard, materialize, text_slices, with_text_results

SPACE = "▁"
UNKNOWN_PENALTY = 10.0
# How an edge is packed into a long: its length and its id take so many bits, the place the rest.
LENGTH_BITS, ID_BITS = 8, 22
# A table of segmented units up to this size is read whole by every Python worker; bytes of a unit beside its ids, while it is read.
MAX_DICTIONARY_BYTES = 256 << 20
UNIT_BYTES = 48
# Units whose place a task remembers.
CACHED_UNITS = 1 << 16
# Bytes of text whose units a task looks up at once.
SLICE_BYTES = 1 << 20
# Units a task segments, and those it sorts by hash.
TASK_UNITS = 1 << 16
SORTED_UNITS = 1 << 19
# Bytes of text a task holds while it goes over a table of units that is too large for it.
HELD_BYTES = 32 << 20
BLOCK_SCHEMA = pa.schema([("hash", pa.int64()), ("unit", pa.string()), ("ids", pa.list_(pa.int32()))])


def _processor(path: str | None):
    import public_tokenizers
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path or public_tokenizers.path("piece_bpe_32k.model"))


def pieces(spark: SparkSession, model: str | None = None) -> DataFrame:
    """``(piece, id, score)`` of the pieces that stand for text; as many rows as the model file has at most."""
    found = _processor(model)
    rows = [
        (found.id_to_piece(at), at, float(found.get_score(at)))
        for at in range(found.get_piece_size())
        if not (found.is_control(at) or found.is_unknown(at) or found.is_byte(at) or found.is_unused(at))
    ]
    return spark.createDataFrame(pd.DataFrame(rows, columns=["piece", "id", "score"]), "piece string, id int, score double")


def unit_pattern(model: str | None = None) -> str:
    """What a unit is, for Java and for Python: no piece crosses its ends.

    The marks and digits that stand behind a letter in no piece begin a unit there, so that a word is one
    unit whatever follows it.  Letters are those of the pieces below U+0100, which Java tests by one look at a table of bits;
    a class of thousands it tests one after the other.  All repeats are possessive: Java takes those in a loop, others by
    a call within a call for each character, which a long word would have too many of.
    """
    found = _processor(model)
    spelled = [found.id_to_piece(at) for at in range(found.get_piece_size()) if not found.is_byte(at)]
    letters = {char for piece in spelled for char in piece if char.isalpha() and ord(char) < 256}
    marks = set(string.punctuation + string.digits)
    marks -= {after for piece in spelled for before, after in pairwise(piece) if before in letters}
    word = f"{SPACE}*+[^{SPACE}\n]"
    if not letters or not marks:
        return f"{word}++|{SPACE}++|\n"
    cut = "".join(f"\\{mark}" if mark in string.punctuation else mark for mark in sorted(marks))
    rest = f"[^{SPACE}\n{cut}]*+"
    return f"{word}{rest}(?:(?<![{''.join(sorted(letters))}])[{cut}]++{rest})*+|{SPACE}++|\n"


def units(text: Column, pattern: str) -> Column:
    marked = F.concat(F.lit(SPACE), F.replace(text, F.lit(" "), F.lit(SPACE)))
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.regexp_extract_all(marked, F.lit(pattern), F.lit(0)))


def units_of(text: str, pattern: str) -> list[str]:
    return re.findall(pattern, SPACE + text.replace(" ", SPACE)) if text else []


def _bytes_ids(char: Column, first_byte: int) -> Column:
    digits = F.hex(F.encode(char, "UTF-8"))
    return F.transform(
        F.sequence(F.lit(1), (F.length(digits) / 2).cast("int")),
        lambda i: F.conv(F.substr(digits, 2 * i - 1, F.lit(2)), 16, 10).cast("int") + first_byte,
    )


def lattice(words: DataFrame, table: DataFrame) -> DataFrame:
    """``(unit, edge)``: every piece that is a substring of a unit, and every character without a piece of its own.

    An edge is one number: where it stops, its length (``LENGTH_BITS``) and its id (``ID_BITS``),
    0 without a piece.  ``table`` is broadcast: it has as many rows as the vocabulary file.
    """
    longest = table.agg(F.max(F.char_length("piece"))).first()[0]
    if longest >= 1 << LENGTH_BITS:
        raise ValueError(f"pieces of {longest} characters")
    size = F.char_length("unit")
    starts = F.explode(F.sequence(F.lit(0), size - 1)).alias("start")
    lengths = F.explode(F.sequence(F.lit(1), F.least(F.lit(longest), size - F.col("start")))).alias("length")
    spans = words.select("unit", starts).select("unit", "start", lengths)
    spans = spans.withColumn("span", F.substr("unit", F.col("start") + 1, F.col("length")))
    joined = spans.join(F.broadcast(table.select("piece", "id")), F.col("span") == F.col("piece"), "left")
    stop = (F.col("start") + F.col("length")).cast("long")
    place = F.shiftleft(stop, LENGTH_BITS) + F.col("length")
    edge = F.shiftleft(place, ID_BITS) + F.coalesce("id", F.lit(0))
    return joined.where(F.col("id").isNotNull() | (F.col("length") == 1)).select("unit", edge.alias("edge"))


def _stop(edge: Column) -> Column:
    return F.shiftright(edge, LENGTH_BITS + ID_BITS).cast("int")


def _length(edge: Column) -> Column:
    return F.shiftright(edge, ID_BITS).bitwiseAND(F.lit((1 << LENGTH_BITS) - 1)).cast("int")


def _id(edge: Column) -> Column:
    return edge.bitwiseAND(F.lit((1 << ID_BITS) - 1)).cast("int")


def best_path(edges: Column, scores: Column) -> Column:
    """The edges of the path with the best sum of ``scores`` (by id), in order; ``edges`` are sorted.

    A step of the first fold takes one edge.  The edges of a place come by length, and each has one of a single character:
    that one adds the cell of the place before, which it starts from, and the longer ones start from cells.  The second
    fold walks back.
    """

    def step(state: Column, edge: Column) -> Column:
        score = F.get(scores, _id(edge))
        ended = F.array(F.struct(state["total"].alias("total"), state["edge"].alias("edge")))
        moved = F.struct(
            F.concat(state["cells"], ended).alias("cells"), (state["total"] + score).alias("total"), edge.alias("edge")
        )
        total = F.get(state["cells"], _stop(edge) - _length(edge))["total"] + score
        # Of equal sums the longer piece stays.
        better = F.struct(state["cells"].alias("cells"), total.alias("total"), edge.alias("edge"))
        return F.when(_length(edge) == 1, moved).when(total >= state["total"], better).otherwise(state)

    def back(state: Column, cell: Column) -> Column:
        edge = cell["edge"]
        moved = F.struct((state["at"] - _length(edge)).alias("at"), F.concat(F.array(edge), state["path"]).alias("path"))
        return F.when(_stop(edge) == state["at"], moved).otherwise(state)

    def walk(state: Column) -> Column:
        last = state["edge"]
        begin = F.struct((_stop(last) - _length(last)).alias("at"), F.array(last).alias("path"))
        # The first cell is the place before all edges.
        return F.aggregate(F.slice(F.reverse(state["cells"]), 1, _stop(last) - 1), begin, back, lambda found: found["path"])

    begin = F.struct(
        F.array().cast("array<struct<total:double,edge:bigint>>").alias("cells"), F.lit(0.0).alias("total"),
        F.lit(0).cast("long").alias("edge"),
    )
    return F.aggregate(edges, begin, step, walk)


def segment(words: DataFrame, table: DataFrame, first_byte: int) -> DataFrame:
    """``(unit, ids)`` of distinct ``words`` (``unit``).

    The scores of the pieces stand in the plan as one array, by id; characters without a piece count less than
    any piece and become their bytes.
    """
    known = {row["id"]: row["score"] for row in table.select("id", "score").collect()}
    unknown = min(known.values()) - UNKNOWN_PENALTY
    listed = ",".join(repr(known.get(at, unknown)) for at in range(max(known) + 1))
    scores = F.split(F.lit(listed), ",").cast("array<double>")
    edges = lattice(words, table).groupBy("unit").agg(F.sort_array(F.collect_list("edge")).alias("edges"))
    path = edges.select("unit", best_path(F.col("edges"), scores).alias("path"))
    ids = F.transform(
        "path",
        lambda edge: F.when(_id(edge) > 0, F.array(_id(edge))).otherwise(
            _bytes_ids(F.substr("unit", _stop(edge), F.lit(1)), first_byte)
        ),
    )
    return path.select("unit", F.flatten(ids).alias("ids"))


class _Dictionary:
    """The ids of units by their hash, from the files of a table; kept while the worker lives."""

    held: dict[str, _Dictionary] = {}

    def __init__(self, files: list[str], n_units: int, n_ids: int, pattern: str):
        from pyarrow import fs, parquet

        # Filled a part at a time: the table never stands beside its arrays.  A file of up to 65,536 pieces has ids of two bytes.
        hashes, sizes = np.empty(n_units, np.int64), np.empty(n_units, np.int32)
        self.values = np.empty(n_ids, np.uint16)
        unit, at = 0, 0
        for uri in files:
            store, place = fs.FileSystem.from_uri(uri)
            with store.open_input_file(place) as file:
                for part in parquet.ParquetFile(file).iter_batches(1 << 16, columns=["hash", "ids"]):
                    ids, upto = part.column("ids").flatten().to_numpy(zero_copy_only=False), unit + part.num_rows
                    if len(ids) and ids.max() > np.iinfo(self.values.dtype).max:
                        self.values = self.values.astype(np.int32)
                    hashes[unit:upto] = part.column("hash").to_numpy(zero_copy_only=False)
                    sizes[unit:upto] = part.column("ids").value_lengths().to_numpy(zero_copy_only=False)
                    self.values[at : at + len(ids)] = ids
                    unit, at = upto, at + len(ids)
        order = np.argsort(hashes)
        self.hashes, self.sizes = hashes[order], sizes[order]
        del hashes
        starts = np.cumsum(sizes, dtype=np.int64)
        starts -= sizes
        self.starts = starts.astype(np.uint32 if n_ids < 1 << 32 else np.int64)[order]
        self.pattern = pattern
        self.cache: dict[str, int] = {}
        pa.default_memory_pool().release_unused()

    @classmethod
    def of(cls, files: list[str], *others) -> _Dictionary:
        if files[0] not in cls.held:
            cls.held.clear()
            cls.held[files[0]] = cls(files, *others)
        return cls.held[files[0]]

    def places(self, found: list[str]) -> np.ndarray:
        cache = self.cache
        if len(cache) > CACHED_UNITS:
            cache.clear()
        missing = list(set(found).difference(cache))
        if missing:
            hashes = _hashes(missing)
            order = np.argsort(hashes)  # neighbours are looked up after each other
            at = np.empty(len(order), np.int64)
            at[order] = np.searchsorted(self.hashes, hashes[order])
            cache.update(zip(missing, at.tolist(), strict=True))
        return np.fromiter(map(cache.__getitem__, found), np.int64, len(found))

    def column(self, texts: list[str]) -> pa.Array:
        """The ids of each text; the texts are those of a slice, so their units are bounded, or one text."""
        ends, found = [0], []
        for text in texts:
            found += units_of(text, self.pattern)
            ends.append(len(found))
        at = self.places(found)
        sizes = self.sizes[at]
        stops = np.append(0, np.cumsum(sizes, dtype=np.int64))
        places = np.repeat(self.starts[at].astype(np.int64) - stops[:-1], sizes)
        places += np.arange(stops[-1])
        return pa.ListArray.from_arrays(pa.array(stops[ends].astype(np.int32)), pa.array(self.values[places].astype(np.int32)))


def encode(
    docs: DataFrame, model: str | None = None, text_col: str = "text", id_col: str = "doc_id",
    max_dictionary_bytes: int = MAX_DICTIONARY_BYTES, held_bytes: int = HELD_BYTES,
) -> DataFrame:
    """``docs`` with ``ids``."""
    source = docs.drop("ids")
    first_byte = _processor(model).piece_to_id("<0x00>")
    table = pieces(docs.sparkSession, model)
    pattern = unit_pattern(model)
    words = source.select(F.explode(units(F.coalesce(F.col(text_col), F.lit("")), pattern)).alias("unit")).distinct()
    # Counted first: the edges of the units of a task are sorted, and would be written to disk if there were many.
    words = materialize(words, "words")
    parts = words.repartition(words.count() // TASK_UNITS + 1, "unit")
    known = materialize(segment(parts, table, first_byte).select(F.xxhash64("unit").alias("hash"), "unit", "ids"), "units")
    discard(words)
    n_units, n_ids = known.agg(F.count("*"), F.coalesce(F.sum(F.size("ids")), F.lit(0))).first()
    if n_units == 0:
        return source.withColumn("ids", F.array().cast("array<int>"))
    if n_units * UNIT_BYTES + n_ids * 2 > max_dictionary_bytes:
        blocks = materialize(_blocks(known, n_units), "unit-blocks")
        discard(known)
        return _encode_by_passes(source, blocks.inputFiles(), text_col, pattern, held_bytes)
    files = known.inputFiles()
    added = T.StructType([T.StructField("ids", T.ArrayType(T.IntegerType()))])
    return with_text_results(source, text_col, added, lambda texts: [_Dictionary.of(files, n_units, n_ids, pattern).column(texts)], SLICE_BYTES)


def _blocks(known: DataFrame, n_units: int) -> DataFrame:
    """``(first, last, rows)``: the units in order of their hash, some thousands to a row, as Arrow reads them without decoding."""
    ordered = known.select("hash", "unit", "ids").repartitionByRange(n_units // SORTED_UNITS + 1, "hash").sortWithinPartitions("hash")

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                rows = pa.Table.from_batches([batch]).cast(BLOCK_SCHEMA).combine_chunks().to_batches()[0]
                hashes, held = rows.column("hash"), rows.serialize().to_pybytes()
                ends = [pa.array([hashes[at].as_py()], pa.int64()) for at in (0, -1)]
                yield pa.RecordBatch.from_arrays([*ends, pa.array([held], pa.binary())], ["first", "last", "rows"])

    return ordered.mapInArrow(packed, "first long, last long, rows binary")


def _read_blocks(files: list[str]) -> Iterator[tuple[int, int, pa.Buffer]]:
    """The rows of ``_blocks``, a few at a time."""
    from pyarrow import fs, parquet

    for uri in files:
        store, place = fs.FileSystem.from_uri(uri)
        with store.open_input_file(place) as file:
            for part in parquet.ParquetFile(file, buffer_size=SLICE_BYTES, pre_buffer=False).iter_batches(4):
                ends = zip(part.column("first").to_pylist(), part.column("last").to_pylist(), strict=True)
                for (first, last), rows in zip(ends, part.column("rows"), strict=True):
                    yield first, last, rows.as_buffer()


def _hashes(found: list[str]) -> np.ndarray:
    """What ``F.xxhash64`` gives for them."""
    return np.array([xxhash.xxh64_intdigest(unit.encode(), 42) for unit in found], np.uint64).view(np.int64)


def _ids_of(found: list[str], hashes: np.ndarray, blocks: Iterator[tuple[int, int, pa.Buffer]]):
    """``(starts, sizes, values)``: the ids of the distinct units ``found``, from one pass over ``blocks``.

    A hash only tells where to look: units are the same if their letters are.
    """
    order = np.argsort(hashes)
    hashes, spelled = hashes[order], pa.array(found, pa.string()).take(pa.array(order))
    starts, sizes = np.zeros(len(order), np.int64), np.full(len(order), -1, np.int32)
    values, at = [], 0
    for first, last, rows in blocks:
        low, high = np.searchsorted(hashes, first), np.searchsorted(hashes, last, "right")
        if low == high:
            continue
        rows = pa.ipc.read_record_batch(rows, BLOCK_SCHEMA)
        have, asked = rows.column("hash").to_numpy(), hashes[low:high]
        begin = np.searchsorted(have, asked)
        several = np.searchsorted(have, asked, "right") - begin
        mine = np.repeat(np.arange(low, high), several)
        theirs = np.arange(len(mine)) + np.repeat(begin - np.cumsum(several) + several, several)
        same = pc.equal(spelled.take(pa.array(mine)), rows.column("unit").take(pa.array(theirs))).to_numpy(zero_copy_only=False)
        ids = rows.column("ids").take(pa.array(theirs[same]))
        lengths, mine = ids.value_lengths().to_numpy(zero_copy_only=False), order[mine[same]]
        sizes[mine], starts[mine] = lengths, at + np.cumsum(lengths, dtype=np.int64) - lengths
        values.append(ids.flatten().to_numpy(zero_copy_only=False))
        at += len(values[-1])
    if len(sizes) and sizes.min() < 0:
        raise RuntimeError(f"{(sizes < 0).sum()} units are not in the table: the texts changed between two reads")
    return starts, sizes, np.concatenate(values) if values else np.empty(0, np.int32)


def _encode_by_passes(source: DataFrame, files: list[str], text_col: str, pattern: str, held_bytes: int) -> DataFrame:
    """A task holds ``held_bytes`` of text and numbers its units, then goes over all units once and takes the ids of its own.

    Neither texts nor ids of units are dealt out, so nothing but the table of units is on disk, and no task holds that.
    """
    names = [*source.columns, "ids"]

    def encoded(held: list[tuple[pa.RecordBatch, list[int], np.ndarray]], found: list[str]) -> Iterator[pa.RecordBatch]:
        starts, sizes, values = _ids_of(found, _hashes(found), _read_blocks(files))
        for part, ends, at in held:
            stops = np.append(0, np.cumsum(sizes[at], dtype=np.int64))
            places = np.repeat(starts[at] - stops[:-1], sizes[at])
            places += np.arange(stops[-1])
            ids = pa.ListArray.from_arrays(pa.array(stops[ends].astype(np.int32)), pa.array(values[places], pa.int32()))
            yield pa.RecordBatch.from_arrays([*part.columns, ids], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, weight, numbers = [], 0, defaultdict(count().__next__)
        for part in text_slices(batches, text_col, SLICE_BYTES):
            ends, found = [0], []
            for text in part.column(text_col).to_pylist():
                found += units_of(text or "", pattern)
                ends.append(len(found))
            held.append((part, ends, np.fromiter(map(numbers.__getitem__, found), np.int32, len(found))))
            weight += pc.sum(pc.binary_length(part.column(text_col))).as_py() or 0
            if weight >= held_bytes:
                yield from encoded(held, list(numbers))
                held, weight, numbers = [], 0, defaultdict(count().__next__)
        if held:
            yield from encoded(held, list(numbers))

    return source.mapInArrow(run, T.StructType([*source.schema.fields, T.StructField("ids", T.ArrayType(T.IntegerType()))]))


def decode(coded: DataFrame, model: str | None = None, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """``coded`` with the text of its ids; a null list is an empty text.

    The bytes of all pieces stand in the plan as one array (as hexadecimal digits); bytes that are no UTF-8 become
    U+FFFD.
    """
    found = _processor(model)
    spelled = [
        found.id_to_piece(at)[3:5] if found.is_byte(at)
        else "" if found.is_control(at) else found.id_to_piece(at).replace(SPACE, " ").encode().hex()
        for at in range(found.get_piece_size())
    ]
    digits = F.split(F.lit(",".join(spelled)), ",")
    whole = F.unhex(F.array_join(F.transform(F.col(ids_col), lambda at: F.get(digits, at)), ""))
    text = F.make_valid_utf8(whole.cast("string"))
    return coded.drop(out_col).withColumn(out_col, F.coalesce(F.regexp_replace(text, "^ ", ""), F.lit("")))
