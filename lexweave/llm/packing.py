"""Packs token sequences of bounded length with little padding, by column generation.

Texts become token ids and pieces of at most ``CAPACITY`` ids.  Full pieces stand
alone; the rest is a cutting-stock problem over a histogram of lengths, whose size does not
depend on the corpus: a linear program over patterns (which lengths share a
sequence) gets new columns from a knapsack over the dual prices, its solution is
rounded down and what is left is packed first-fit.  The pieces of a length are
ranked, and a rank names its place in a pattern by arithmetic, so the assignment
is one join with a small table.

Nulls and edge cases: a null text is an empty one and is its end mark alone;
repeated rows are packed one by one; an empty table gives an empty table.  Rows with
a null id are packed like others.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

CAPACITY = 1024
# Lengths are rounded up to this many ids in the linear program, never in the result.
GRAIN = 4
END = 0
# Share of sequences above the optimum of the linear program at which it stops.
GAP = 0.001
# Ranks of a length are counted in so many parts, so that a length of which there are many is no single task.
PARTS = 64
# Rows a task hands over at once.
SLICE = 4096


def token_encoder(path: str | None = None, pattern: str | None = None):
    """The byte-level vocabulary of a tokenizer file as a fast encoder; a text is split at its added tokens first."""
    import public_tokenizers
    import tiktoken

    with open(path or public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as file:
        described = json.load(file)
    special = {token["content"]: token["id"] for token in described.get("added_tokens", [])}
    ranks = {
        bytes(_BYTES[char] for char in token): at
        for token, at in described["model"]["vocab"].items()
        if token not in special
    }
    return tiktoken.Encoding(
        "file", pat_str=pattern or public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special
    )


def _byte_characters() -> dict[str, int]:
    """The character that stands for each byte: itself where printable, else the next free one from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [byte for byte in range(256) if byte not in plain]
    return {chr(byte): byte for byte in plain} | {chr(256 + at): byte for at, byte in enumerate(other)}


_BYTES = _byte_characters()


def pieces(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY,
    tokenizer: str | None = None, with_ids: bool = False,
) -> DataFrame:
    """``(doc_id, start, length, ids_crc32, doc_tokens[, ids])``: the ids of each text and its end mark, cut at ``capacity``."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = token_encoder(tokenizer)
        columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", *(["ids"] if with_ids else [])]
        held = []
        for batch in batches:
            for doc_id, text in zip(batch["doc_id"], batch["text"], strict=True):
                ids = np.append(encoder.encode_to_numpy(text, allowed_special="all"), np.uint32(END)).astype("<u4")
                for start in range(0, len(ids), capacity):
                    part = ids[start : start + capacity]
                    row = (doc_id, start, len(part), zlib.crc32(part.tobytes()), len(ids))
                    held.append((*row, part.astype(np.int32)) if with_ids else row)
                if len(held) >= SLICE:
                    yield pd.DataFrame(held, columns=columns, dtype=object)
                    held = []
        if held:
            yield pd.DataFrame(held, columns=columns, dtype=object)

    source = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(text_col, F.lit("")).alias("text"))
    kind = source.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint"
    return source.mapInPandas(cut, schema + (", ids array<int>" if with_ids else ""))


@dataclass(frozen=True)
class Pattern:
    """``times`` sequences, each of which holds ``amounts[size]`` pieces of a size."""

    amounts: dict[int, int]
    times: int


def knapsack(sizes: np.ndarray, prices: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The best value within ``capacity`` and how many of each size it takes; sizes may repeat."""
    best = np.zeros(capacity + 1)
    taken = np.full(capacity + 1, -1)
    for room in range(1, capacity + 1):
        fits = np.searchsorted(sizes, room, side="right")
        best[room] = best[room - 1]
        if fits:
            values = best[room - sizes[:fits]] + prices[:fits]
            at = int(values.argmax())
            if values[at] > best[room] + 1e-12:
                best[room], taken[room] = values[at], at
    amounts, room = np.zeros(len(sizes)), capacity
    while room > 0:
        if taken[room] < 0:
            room -= 1
            continue
        amounts[taken[room]] += 1
        room -= sizes[taken[room]]
    return float(best[capacity]), amounts


def cutting_stock(demand: dict[int, int], capacity: int, most_rounds: int = 4000) -> list[Pattern]:
    """Patterns that hold ``demand`` (pieces by size) in few sequences of ``capacity``.

    Revised simplex over generated columns.  The best value of a column bounds how far
    the program is from its optimum, and it stops within ``GAP``; whenever it stops,
    the patterns hold everything.
    """
    sizes = np.array(sorted(size for size, count in demand.items() if count > 0), dtype=int)
    if not len(sizes):
        return []
    counts = np.array([demand[size] for size in sizes.tolist()], dtype=float)
    basis = np.diag((capacity // sizes).astype(float))
    inverse = np.diag(1 / (capacity // sizes))
    solution = inverse @ counts
    for at in range(most_rounds):
        prices = inverse.sum(axis=0)
        value, column = knapsack(sizes, np.maximum(prices, 0), capacity)
        if value <= 1 + GAP:
            break
        used = np.flatnonzero(column)
        direction = (inverse[:, used] * column[used]).sum(axis=1)
        ratios = np.where(direction > 1e-9, solution / np.where(direction > 1e-9, direction, 1), np.inf)
        leaving = int(ratios.argmin())
        if not np.isfinite(ratios[leaving]):
            break
        basis[:, leaving] = column
        if at % 200 == 199:
            inverse = np.linalg.inv(basis)
            solution = np.maximum(inverse @ counts, 0)
            continue
        step = ratios[leaving]
        solution = np.maximum(solution - step * direction, 0)
        solution[leaving] = step
        row = inverse[leaving] / direction[leaving]
        inverse = inverse - np.outer(direction, row)
        inverse[leaving] = row
    times = np.floor(solution + 1e-6).astype(int)
    packed = [
        Pattern({int(sizes[i]): int(basis[i, p]) for i in np.flatnonzero(basis[:, p])}, int(times[p]))
        for p in np.flatnonzero(times)
    ]
    left = np.maximum(counts - basis @ times, 0).astype(int)
    bins: list[tuple[int, dict[int, int]]] = []
    for i in reversed(range(len(sizes))):
        size = int(sizes[i])
        for _ in range(left[i]):
            for at, (room, content) in enumerate(bins):
                if room >= size:
                    content[size] = content.get(size, 0) + 1
                    bins[at] = (room - size, content)
                    break
            else:
                bins.append((capacity - size, {size: 1}))
    return packed + [Pattern(content, 1) for _, content in bins]


def _slots(patterns: list[Pattern]) -> pd.DataFrame:
    """Which ranks of a size go to which sequences: one row for each size of each pattern."""
    rows, used, sequence = [], {}, 0
    for pattern in patterns:
        slot = 0
        for size, amount in sorted(pattern.amounts.items(), reverse=True):
            first = used.get(size, 0)
            used[size] = first + amount * pattern.times
            rows.append((size, first, used[size], sequence, amount, slot))
            slot += amount
        sequence += pattern.times
    return pd.DataFrame(rows, columns=["size", "first", "until", "sequence", "amount", "slot"])


def pack(found: DataFrame, capacity: int = CAPACITY, grain: int = GRAIN, parts: int = PARTS) -> DataFrame:
    """``found`` (with ``doc_id``, ``start``, ``length``) with ``sequence_id`` and ``offset``.

    Tables that travel to the tasks are bounded by the number of sizes
    (``capacity / grain``) times ``parts``, not by the rows.
    """
    spark = found.sparkSession
    size = F.ceil(F.col("length") / grain).cast("int").alias("size")
    part = F.pmod(F.xxhash64("doc_id", "start"), F.lit(parts)).cast("int").alias("part")
    sized = found.select("*", size, part)
    counted = sized.groupBy("size", "part").count().toPandas().sort_values(["size", "part"])
    names = [*found.columns, "sequence_id", "offset"]
    if counted.empty:
        return found.select("*", F.lit(0).cast("long").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    counted["before"] = counted.groupby("size")["count"].cumsum() - counted["count"]
    demand = counted.groupby("size")["count"].sum().to_dict()
    full = capacity // grain
    patterns = cutting_stock({at: n for at, n in demand.items() if at < full}, full)
    if full in demand:
        patterns.append(Pattern({full: 1}, int(demand[full])))
    starts = F.broadcast(spark.createDataFrame(counted[["size", "part", "before"]], "size int, part int, before long"))
    slots = F.broadcast(
        spark.createDataFrame(
            _slots(patterns), "size int, first long, until long, sequence long, amount long, slot long"
        )
    )
    order = Window.partitionBy("size", "part").orderBy("doc_id", "start", "length")
    ranked = sized.withColumn("rank", F.row_number().over(order)).join(starts, ["size", "part"])
    ranked = ranked.withColumn("rank", F.col("rank") - 1 + F.col("before"))
    placed = ranked.join(slots, "size").where("rank >= first and rank < until")
    placed = placed.withColumns(
        {
            "sequence_id": F.col("sequence") + F.floor((F.col("rank") - F.col("first")) / F.col("amount")).cast("long"),
            "place": F.col("slot") + (F.col("rank") - F.col("first")) % F.col("amount"),
        }
    )
    before = Window.partitionBy("sequence_id").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    return placed.withColumn("offset", F.coalesce(F.sum("length").over(before), F.lit(0))).select(*names)


def pack_documents(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY,
    tokenizer: str | None = None, with_ids: bool = False,
) -> DataFrame:
    """Pieces of all documents with their places.  Tokenizing happens once; the pieces are kept in the shared folder."""
    return pack(materialize(pieces(docs, id_col, text_col, capacity, tokenizer, with_ids), "pieces"), capacity)


def sequences(packed: DataFrame) -> DataFrame:
    """``(sequence_id, ids)`` of pieces packed with their ids; at most ``capacity`` ids are gathered a row."""
    parts = packed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("parts"))
    return parts.select("sequence_id", F.flatten(F.col("parts.ids")).alias("ids"))
