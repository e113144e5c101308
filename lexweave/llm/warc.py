"""WARC archives: written by tasks, read back in byte ranges.

``write_archives`` writes one gzip member per record.  ``read_archives`` cuts every
file into ranges; a task looks for the gzip magic in its range, accepts a place only
if what it inflates starts with a WARC header, and owns the records that start in its
range, wherever they end.  Files of any size are thus read by many tasks, and
a range needs no index.

Files are reached through ``pyarrow.fs`` by their URI (local, s3, gs, hdfs).  A task
writes under a name of its own attempt and reports it; only reported files are
read, so a task that is run twice or lost does no harm.

Records with equal payloads of ``min_bytes`` or more are stored once: that with the
smallest id is the response, others are revisits that name it.

Nulls and edge cases: a null html is an empty payload; null ids are kept (never the
response others refer to); a null url is an empty target; repeated rows give a record each.
An empty table gives no files and reads back as an empty table.  A broken member is skipped like
any bytes that are no record.  In archives of others, records that are neither response nor revisit are passed over,
digests may be SHA-256 (hex) or SHA-1 (base 32 or hex) or absent, and ids that are not ours are null.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from datetime import UTC, datetime

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import scratch_dir

MAGIC = b"\x1f\x8b\x08"
MIN_BYTES = 100
RANGE_BYTES = 8 << 20
READ_BYTES = 1 << 20
# Most tasks that ranges are dealt out to; beyond, a task reads several.
MAX_TASKS = 20_000
# Bytes of records a task hands over at once.
SLICE_BYTES = 8 << 20

NUMBERS = ["page_id", "refers_to", "payload_bytes"]
FOUND = "page_id bigint, url string, record_type string, refers_to bigint, payload_bytes bigint, payload_digest string, payload binary"


def with_first(pages: DataFrame, min_bytes: int = MIN_BYTES) -> DataFrame:
    """``(page_id, url, payload, digest, refers_to)``: which record each revisit refers to, or null.

    Digests are counted before anything is joined, so that only payloads that occur again meet
    a table of their first ids.
    """
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.coalesce("url", F.lit("")).alias("url"),
        F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("payload"),
    ).withColumn("digest", F.sha2("payload", 256))
    again = (
        rows.where(F.octet_length("payload") >= min_bytes)
        .groupBy("digest")
        .agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
        .where("n > 1 and first is not null")
        .select(F.col("digest").alias("__digest"), "first")
    )
    joined = rows.join(again, F.col("digest") == F.col("__digest"), "left")
    refers = F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first"))
    return joined.select("page_id", "url", "payload", "digest", refers.alias("refers_to"))


def record(
    page_id: int | None, url: str, payload: bytes, digest: str, refers_to: int | None, date: str = "1970-01-01T00:00:00Z"
) -> bytes:
    """One WARC record as a gzip member; a revisit has the HTTP header only, which tells the payload's length."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    body = http if refers_to is not None else http + payload
    name = "" if page_id is None else str(page_id)
    # Line breaks would end a header.
    target = re.sub(r"[\r\n]", lambda found: f"%{ord(found[0]):02X}", url)
    fields = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:page:{name}>",
        f"WARC-Date: {date}",
        f"WARC-Target-URI: {target}",
        "Content-Type: application/http; msgtype=response",
        f"WARC-Payload-Digest: sha256:{digest}",
        f"Content-Length: {len(body)}",
    ]
    if refers_to is not None:
        fields += [
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
            f"WARC-Refers-To: <urn:page:{refers_to}>",
        ]
    packer = zlib.compressobj(4, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(fields).encode() + b"\r\n\r\n" + body + b"\r\n\r\n") + packer.flush()


def write_archives(pages: DataFrame, folder: str, min_bytes: int = MIN_BYTES) -> DataFrame:
    """Writes ``pages`` below ``folder``, one file per task, and returns ``(path, records, bytes)`` of the files."""
    date = datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        file, path, records, size = None, None, 0, 0
        for batch in batches:
            for page_id, url, payload, digest, refers_to in zip(
                batch["page_id"], batch["url"], batch["payload"], batch["digest"], batch["refers_to"], strict=True
            ):
                if file is None:
                    path = f"{folder}/part-{uuid.uuid4().hex}.warc.gz"
                    store, place = fs.FileSystem.from_uri(path)
                    store.create_dir(place.rpartition("/")[0], recursive=True)
                    file = store.open_output_stream(place, compression=None)
                member = record(
                    None if pd.isna(page_id) else int(page_id), url, payload, digest,
                    None if pd.isna(refers_to) else int(refers_to), date,
                )
                file.write(member)
                records, size = records + 1, size + len(member)
        if file is not None:
            file.close()
            yield pd.DataFrame({"path": [path], "records": [records], "bytes": [size]})

    # Ids travel as text, since pandas would round big ones beside a null.
    named = with_first(pages, min_bytes).withColumns({name: F.col(name).cast("string") for name in ("page_id", "refers_to")})
    return named.mapInPandas(write, "path string, records bigint, bytes bigint")


class _Window:
    """Bytes of a file from a place on, read as they are asked for and let go behind."""

    def __init__(self, file, size: int, start: int):
        self.file, self.size, self.start, self.data = file, size, start, bytearray()
        file.seek(start)

    def more(self) -> bool:
        read = self.file.read(READ_BYTES)
        self.data += read
        return bool(read)

    def let_go(self, until: int) -> None:
        del self.data[: until - self.start]
        self.start = until

    def find_magic(self, at: int, end: int) -> int:
        """The first magic at ``at`` or later that starts before ``end``, or -1."""
        while True:
            found = self.data.find(MAGIC, at - self.start)
            if found >= 0:
                return self.start + found if self.start + found < end else -1
            at = max(at, self.start + len(self.data) - len(MAGIC) + 1)
            if at >= end or not self.more():
                return -1
            self.let_go(min(at, self.start + len(self.data)))

    def member(self, at: int) -> tuple[bytes, int] | None:
        """What the gzip member at ``at`` inflates to and where it ends; None if there is no WARC record."""
        inflate, out, place = zlib.decompressobj(31), [], at - self.start
        head = b""
        while True:
            block = self.data[place : place + READ_BYTES]
            if not block:
                if not self.more():
                    return None
                continue
            try:
                piece = inflate.decompress(block)
            except zlib.error:
                return None
            if len(head) < 5:
                head += piece[:5]
                if not b"WARC/".startswith(head[:5]):
                    return None
            out.append(piece)
            place += len(block) - len(inflate.unused_data)
            if inflate.eof:
                return b"".join(out), self.start + place


def _digest_holds(payload: bytes, declared: str) -> bool:
    """Whether a payload has the digest its record declares; a missing or unknown kind cannot be held against it."""
    kind, _, value = declared.partition(":")
    if kind.lower() == "sha256":
        return hashlib.sha256(payload).hexdigest() == value.lower()
    if kind.lower() == "sha1":
        digest = hashlib.sha1(payload)  # noqa: S324  (what archives use)
        return value.upper() == base64.b32encode(digest.digest()).decode() or value.lower() == digest.hexdigest()
    return True


def _page_number(urn: str) -> int | None:
    """The page id in a record's name, null if it is none of ours."""
    found = re.fullmatch(r"<urn:page:(-?\d{1,19})>", urn)
    return int(found[1]) if found else None


def _parsed(raw: bytes) -> tuple | None:
    """The row of a response or revisit; None for other records, and for those whose length or digest is wrong."""
    head, gap, body = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not gap or not lines[0].startswith("WARC/"):
        return None
    named = (line.partition(":") for line in lines[1:] if ":" in line)
    fields = {name.strip().lower(): value.removeprefix(" ") for name, _, value in named}
    kind, size = fields.get("warc-type", "").strip(), fields.get("content-length", "").strip()
    if kind not in ("response", "revisit") or not size.isdecimal() or len(body) < int(size):
        return None
    block, declared = body[: int(size)], fields.get("warc-payload-digest", "")
    if fields.get("content-type", "").lower().startswith("application/http"):
        http, _, payload = block.partition(b"\r\n\r\n")
        told = re.search(rb"(?im)^Content-Length:[ \t]*(\d+)", http)
    else:
        payload, told = block, None
    row = (_page_number(fields.get("warc-record-id", "")), fields.get("warc-target-uri", ""), kind)
    if kind == "revisit":
        other = _page_number(fields.get("warc-refers-to", ""))
        return *row, other, int(told[1]) if told else None, declared.removeprefix("sha256:") or None, None
    if told and int(told[1]) != len(payload) or not _digest_holds(payload, declared):
        return None
    return *row, None, len(payload), hashlib.sha256(payload).hexdigest(), payload


def read_archives(spark: SparkSession, files: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """The records of ``files`` (``path``, ``bytes``), with payloads checked against their digests.

    Revisits have no payload; length and digest are those of the payload they refer to, as far as the record tells them.
    """
    names = FOUND.split(", ")
    columns = [name.split(" ")[0] for name in names]

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        held, weight = [], 0
        for batch in batches:
            for path, size, start in zip(batch["path"], batch["bytes"], batch["start"], strict=True):
                end = min(start + range_bytes, size)
                store, place = fs.FileSystem.from_uri(path)
                with store.open_input_file(place) as file:
                    window, at = _Window(file, size, start), start
                    while (at := window.find_magic(at, end)) >= 0:
                        window.let_go(at)
                        member = window.member(at)
                        row = _parsed(member[0]) if member else None
                        if row is None:
                            at += 1
                            continue
                        held.append(row)
                        weight += len(member[0])
                        at = member[1]
                        if weight >= SLICE_BYTES:
                            yield pd.DataFrame(held, columns=columns, dtype=object).astype({name: "Int64" for name in NUMBERS})
                            held, weight = [], 0
        if held:
            yield pd.DataFrame(held, columns=columns, dtype=object).astype({name: "Int64" for name in NUMBERS})

    starts = F.explode(F.sequence(F.lit(0).cast("long"), F.col("bytes") - 1, F.lit(range_bytes).cast("long"))).alias("start")
    ranges = files.where("bytes > 0").select("path", "bytes", starts)
    # A named number of partitions: Spark would merge rows as small as these into one task.
    tasks = max(1, min(MAX_TASKS, ranges.count()))
    return ranges.repartition(tasks, "path", "start").mapInPandas(scan, FOUND)


def archive(pages: DataFrame, folder: str | None = None, min_bytes: int = MIN_BYTES) -> DataFrame:
    """Writes ``pages`` as archives and returns the table of files, which is kept beside them."""
    spark = pages.sparkSession
    folder = folder or scratch_dir(spark, "warc")
    # Without a scheme, the tasks must write where Spark does.
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    folder = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()
    files = write_archives(pages, f"{folder}/archives", min_bytes)
    files.write.parquet(f"{folder}/files")
    return spark.read.parquet(f"{folder}/files")
