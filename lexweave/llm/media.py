"""Bytes as grey PNG images in binary columns, read back with checks, with perceptual hashes.

``to_media`` writes each payload as an image of fixed width, one byte a sample.
``read_media`` parses the chunks (signature, lengths, CRCs), inflates, undoes the
row filters with numpy and hashes the low frequencies of the cosine transform.
Rows are handled one by one inside an Arrow batch; results leave in slices, so
memory follows the longest row.

Nulls and edge cases: a null text is an empty one; an empty payload is one row of
zeros; equal payloads give equal bytes and hashes; broken media raise ``ValueError``
(``strict``) or give null columns.  Only the named columns are taken, so others
cannot clash.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SIGNATURE = b"\x89PNG\r\n\x1a\n"
WIDTH = 64
SIDE, LOW = 32, 8
# Bytes of results a task hands over at once.
SLICE_BYTES = 8 << 20

_COSINES = np.cos(np.pi * (2 * np.arange(SIDE) + 1) * np.arange(LOW)[:, None] / (2 * SIDE))


def padded(payload: bytes, width: int = WIDTH) -> bytes:
    """``payload`` and zeros up to a positive multiple of ``width``."""
    return payload.ljust(max(1, -(-len(payload) // width)) * width, b"\0")


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def encode_png(payload: bytes, width: int = WIDTH, level: int = 4) -> bytes:
    """An 8-bit grey PNG of ``payload``, whose length is a positive multiple of ``width``.

    Rows are stored unfiltered, which suits text.
    """
    samples = np.frombuffer(payload, np.uint8).reshape(-1, width)
    rows = np.zeros((len(samples), width + 1), np.uint8)
    rows[:, 1:] = samples
    header = struct.pack(">IIBBBBB", width, len(samples), 8, 0, 0, 0, 0)
    return (
        SIGNATURE + _chunk(b"IHDR", header) + _chunk(b"IDAT", zlib.compress(rows.tobytes(), level)) + _chunk(b"IEND", b"")
    )


def _chunks(data: bytes) -> Iterator[tuple[bytes, bytes]]:
    if data[:8] != SIGNATURE:
        raise ValueError("not a PNG")
    at = 8
    while at < len(data):
        if at + 12 > len(data):
            raise ValueError("truncated chunk")
        size, kind = struct.unpack(">I4s", data[at : at + 8])
        body = data[at + 8 : at + 8 + size]
        check = data[at + 8 + size : at + 12 + size]
        if len(check) < 4 or struct.unpack(">I", check)[0] != zlib.crc32(kind + body):
            raise ValueError("bad checksum")
        yield kind, body
        at += 12 + size
        if kind == b"IEND":
            return
    raise ValueError("no end chunk")


def _paeth_row(line: np.ndarray, above: np.ndarray) -> np.ndarray:
    out, left, corner = np.empty_like(line), 0, 0
    for x, (value, up) in enumerate(zip(line.tolist(), above.tolist(), strict=True)):
        guess = left + up - corner
        to_left, to_up, to_corner = abs(guess - left), abs(guess - up), abs(guess - corner)
        best = left if to_left <= to_up and to_left <= to_corner else up if to_up <= to_corner else corner
        left = out[x] = (value + best) & 255
        corner = up
    return out


def _average_row(line: np.ndarray, above: np.ndarray) -> np.ndarray:
    out, left = np.empty_like(line), 0
    for x, (value, up) in enumerate(zip(line.tolist(), above.tolist(), strict=True)):
        left = out[x] = (value + (left + up) // 2) & 255
    return out


def unfilter(rows: np.ndarray) -> np.ndarray:
    """Samples of filtered rows (first byte: the filter, 0 to 4)."""
    kinds, samples = rows[:, 0], rows[:, 1:].copy()
    if kinds.max(initial=0) > 4:
        raise ValueError("unknown filter")
    blank = np.zeros(samples.shape[1], np.uint8)
    for y in np.flatnonzero(kinds):
        above = samples[y - 1] if y else blank
        if kinds[y] == 1:
            samples[y] = np.cumsum(samples[y], dtype=np.uint8)
        elif kinds[y] == 2:
            samples[y] += above
        else:
            samples[y] = (_average_row if kinds[y] == 3 else _paeth_row)(samples[y], above)
    return samples


def decode_png(data: bytes) -> np.ndarray:
    """The samples of an 8-bit grey PNG without interlacing; every chunk's checksum is tested."""
    header, body = None, []
    for kind, chunk in _chunks(data):
        if kind == b"IHDR":
            header = struct.unpack(">IIBBBBB", chunk)
        elif kind == b"IDAT":
            body.append(chunk)
    if header is None or header[2:] != (8, 0, 0, 0, 0):
        raise ValueError("not an 8-bit grey image")
    width, height = header[:2]
    try:
        raw = zlib.decompress(b"".join(body))
    except zlib.error as broken:
        raise ValueError("bad pixel data") from broken
    if len(raw) != height * (width + 1):
        raise ValueError("wrong number of samples")
    return unfilter(np.frombuffer(raw, np.uint8).reshape(height, width + 1))


def cosine_hash(image: np.ndarray) -> bytes:
    """64 bits: which of the lowest 8 x 8 frequencies of the shrunk image lie above their median."""
    shrunk = _shrink(_shrink(image.astype(np.float64)).T).T
    low = (_COSINES @ shrunk @ _COSINES.T).ravel()
    return np.packbits(low > np.median(low[1:])).tobytes()


def _shrink(image: np.ndarray) -> np.ndarray:
    """``SIDE`` rows: means of neighbouring rows, or rows repeated."""
    starts = np.arange(SIDE) * len(image) // SIDE
    if len(image) < SIDE:
        return image[starts]
    return np.add.reduceat(image, starts, axis=0) / np.diff(np.append(starts, len(image)))[:, None]


def _sliced(rows: Iterator[tuple], columns: list[str], weight: int) -> Iterator[pd.DataFrame]:
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[weight] or b"")
        if size >= SLICE_BYTES:
            yield pd.DataFrame(held, columns=columns, dtype=object)
            held, size = [], 0
    if held:
        yield pd.DataFrame(held, columns=columns, dtype=object)


def to_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH) -> DataFrame:
    """``(doc_id, n_bytes, media)``: each text in UTF-8, padded with zeros, as an image."""

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def rows(batch):
            for doc_id, text in zip(batch["doc_id"], batch["text"], strict=True):
                payload = text.encode()
                yield doc_id, len(payload), encode_png(padded(payload, width), width)

        for batch in batches:
            yield from _sliced(rows(batch), ["doc_id", "n_bytes", "media"], 2)

    source = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(text_col, F.lit("")).alias("text"))
    kind = source.schema["doc_id"].dataType.simpleString()
    return source.mapInPandas(encode, f"doc_id {kind}, n_bytes bigint, media binary")


def read_media(
    media: DataFrame, id_col: str = "doc_id", media_col: str = "media", keep: tuple[str, ...] = (), strict: bool = True
) -> DataFrame:
    """``(doc_id, *keep, media, payload, cosine_hash)``: samples in row order and the 8-byte hash, from the stored bytes."""
    source = media.select(F.col(id_col).alias("doc_id"), *keep, F.col(media_col).alias("media"))
    columns = [*source.columns, "payload", "cosine_hash"]

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def rows(batch):
            for row in batch.itertuples(index=False, name=None):
                try:
                    image = decode_png(row[-1] if row[-1] is not None else b"")
                except ValueError:
                    if strict:
                        raise
                    yield *row, None, None
                    continue
                yield *row, image.tobytes(), cosine_hash(image)

        for batch in batches:
            yield from _sliced(rows(batch), columns, -2)

    schema = ", ".join(f"{field.name} {field.dataType.simpleString()}" for field in source.schema)
    return source.mapInPandas(decode, f"{schema}, payload binary, cosine_hash binary")
