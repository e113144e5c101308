import base64
import gzip
import hashlib
import io
import random

from lexweave.llm import warc


def pages():
    rng = random.Random(2)
    html = [f"<html>{i}" + "".join(rng.choice("abcdefgh é\r\n") for _ in range(rng.randrange(20, 4000))) for i in range(60)]
    rows = [(at, f"http://x/{at}", text) for at, text in enumerate(html)]
    rows += [(100 + at, "http://again/", html[at % 7]) for at in range(30)]
    rows += [(200, None, None), (201, "http://e\r\nvil: 1", ""), (202, "u", "short"), (203, "u", "short"), (204, "u", "é" * 50)]
    rows += [(205, "u", "é" * 50), (206, "big", "z" * 300_000), (206, "big", "z" * 300_000), (None, "u", html[0])]
    rows += [(-5, "u", html[1]), (-(1 << 63), "u", "n" * 120), ((1 << 63) - 1, "u", "n" * 120), ((1 << 53) + 1, "u", "odd")]
    # Payloads that hold what looks like the start of a record.
    return rows + [(300, "trap", "\x1f\x8b\x08 WARC/1.1\r\n\r\n" * 40)]


def brute(rows):
    first, out = {}, []
    for page_id, _, html in rows:
        data = (html or "").encode()
        if len(data) >= 100 and page_id is not None:
            first[data] = min(page_id, first.get(data, page_id))
    for page_id, _, html in rows:
        data = (html or "").encode()
        other = first.get(data)
        revisit = other is not None and other != page_id
        out.append((page_id, len(data), hashlib.sha256(data).hexdigest(), "revisit" if revisit else "response", other if revisit else None))
    return sorted(out, key=str)


def test_round_trip_over_many_range_sizes(spark):
    rows = pages()
    files = warc.archive(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3))
    assert files.count() <= 3
    for size in (700, 5000, 1 << 20):
        found = warc.read_archives(spark, files, range_bytes=size).select(
            "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"
        )
        assert sorted(map(tuple, found.collect()), key=str) == brute(rows)
    html = {row["page_id"]: bytes(row["payload"]) for row in warc.read_archives(spark, files).where("record_type = 'response'").collect()}
    assert html[206] == b"z" * 300_000 and html[201] == b""


def test_members_are_plain_gzip_and_junk_is_passed_over():
    data = b"<p>" + b"x" * 200
    good = warc.record(5, "http://a/", data, hashlib.sha256(data).hexdigest(), None)
    assert gzip.decompress(good).startswith(b"WARC/1.1\r\n") and gzip.decompress(good).endswith(data + b"\r\n\r\n")
    wrong = warc.record(6, "http://a/", data, "0" * 64, None)
    blob = b"junk" + warc.MAGIC + b"no deflate" + gzip.compress(b"other member") + wrong + good + good[:30]
    window, at, seen = warc._Window(io.BytesIO(blob), len(blob), 0), 0, []
    while (at := window.find_magic(at, len(blob))) >= 0:
        window.let_go(at)
        member = window.member(at)
        row = warc._parsed(member[0]) if member else None
        if row:
            seen.append(row[0])
        at = member[1] if row else at + 1
    assert seen == [5]


def foreign(kind, payload, *more, http=b"HTTP/1.1 200 OK\r\n\r\n", content="application/http;msgtype=response"):
    block = http + payload
    head = ["WARC/1.0", f"WARC-Type: {kind}", "WARC-Record-ID: <urn:uuid:1b2c>", f"Content-Type: {content}", f"Content-Length: {len(block)}", *more]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def test_records_of_other_writers():
    body = b"<p>hello</p>"
    sha256, sha1 = hashlib.sha256(body).hexdigest(), base64.b32encode(hashlib.sha1(body).digest()).decode()
    want = (None, "http://a/", "response", None, len(body), sha256, body)
    for more in ([], [f"WARC-Payload-Digest: sha1:{sha1}"], [f"warc-payload-digest: sha256:{sha256}"], ["WARC-Payload-Digest: md5:0"]):
        assert warc._parsed(foreign("response", body, "WARC-Target-URI: http://a/", *more)) == want
    assert warc._parsed(foreign("response", body, "WARC-Payload-Digest: sha1:" + "A" * 32)) is None
    assert warc._parsed(foreign("warcinfo", b"software: x", http=b"", content="application/warc-fields")) is None
    assert warc._parsed(foreign("request", b"GET /", http=b"")) is None
    assert warc._parsed(foreign("response", body)[:-20]) is None  # cut off
    assert warc._parsed(foreign("revisit", b"", f"WARC-Payload-Digest: sha1:{sha1}"))[2:6] == ("revisit", None, None, f"sha1:{sha1}")
    assert b"WARC-Date: 2" in gzip.decompress(warc.record(1, "u", b"", "0", None, "2024-01-01T00:00:00Z"))


def test_empty_table_and_extra_columns(spark):
    none = spark.createDataFrame([], "page_id long, url string, html string, digest string")
    assert warc.read_archives(spark, warc.archive(none)).count() == 0
    clash = spark.createDataFrame([(1, "u", "h", "d", "p")], "page_id long, url string, html string, digest string, payload string")
    assert warc.read_archives(spark, warc.archive(clash)).first()["payload_bytes"] == 1
