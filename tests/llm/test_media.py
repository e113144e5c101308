import hashlib
import struct
import zlib

import numpy as np
import pytest

from lexweave.llm import media
from llm_fixtures import none, odd  # noqa: F401


def filtered(image, kinds):
    """Rows filtered by the standard's formulas, pixel by pixel."""
    rows, above = [], [0] * image.shape[1]
    for kind, line in zip(kinds, image.tolist(), strict=True):
        out = []
        for x, value in enumerate(line):
            a, b, c = (line[x - 1] if x else 0), above[x], (above[x - 1] if x else 0)
            p = a + b - c
            paeth = min([(abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c)])[2]
            out.append((value - [0, a, b, (a + b) // 2, paeth][kind]) % 256)
        rows.append([kind, *out])
        above = line
    return np.array(rows, np.uint8)


def test_every_filter_is_undone():
    image = np.random.default_rng(1).integers(0, 256, (10, 16), np.uint8)
    rows = filtered(image, [0, 1, 2, 3, 4, 4, 3, 2, 1, 0])
    assert (media.unfilter(rows) == image).all()
    with pytest.raises(ValueError):
        media.unfilter(np.full((1, 5), 7, np.uint8))


def test_broken_files_are_noticed():
    good = media.encode_png(media.padded(b"some text"))
    assert media.decode_png(good).tobytes() == media.padded(b"some text")
    for bad in (b"", good[:-1], good[:40] + bytes([good[40] ^ 1]) + good[41:], good.replace(b"IEND", b"IENX")):
        with pytest.raises(ValueError):
            media.decode_png(bad)
    header = struct.pack(">IIBBBBB", 64, 2, 8, 0, 0, 0, 0)
    short = media.SIGNATURE + media._chunk(b"IHDR", header) + media._chunk(b"IDAT", zlib.compress(b"\0" * 65)) + media._chunk(b"IEND", b"")
    with pytest.raises(ValueError):
        media.decode_png(short)


def test_round_trip(spark, odd, none):
    texts = ["", None, "a", "é" * 100, "x" * 64, "y" * 200_000, "\x00\n", "a"]
    docs = odd(texts)
    back = media.read_media(media.to_media(docs), keep=("n_bytes",)).collect()
    assert len(back) == docs.count()
    for row in back:
        if row["doc_id"] is None:
            continue
        data = (texts[row["doc_id"]] or "").encode()
        assert row["n_bytes"] == len(data) and bytes(row["payload"]) == media.padded(data)
        assert len(row["cosine_hash"]) == 8
    same = [bytes(row["media"]) for row in back if row["doc_id"] in (2, 7)]
    assert len({hashlib.sha256(item).digest() for item in same}) == 1
    assert media.read_media(media.to_media(none)).count() == 0


def test_hash_is_stable_under_small_changes():
    image = np.random.default_rng(2).integers(0, 200, (64, 64)).astype(np.uint8)
    image = np.repeat(np.repeat(image[::8, ::8], 8, 0), 8, 1)
    bits = lambda data: int.from_bytes(media.cosine_hash(data), "big")
    assert (bits(image) ^ bits(image + np.uint8(3))).bit_count() <= 4
    assert (bits(image) ^ bits(image[::-1])).bit_count() > 10


def test_lenient_reading(spark):
    broken = spark.createDataFrame([(1, bytearray(b"junk")), (2, None)], "doc_id long, media binary")
    assert [row["payload"] for row in media.read_media(broken, strict=False).collect()] == [None, None]
