"""Archives, stored tables, exchange files, rendering and the ingest plan."""

import bz2
import hashlib
import io
import tarfile
import zipfile

import pandas as pd
import pytest
from conftest import plan_of
from pyspark.sql import functions as F

from lexweave.operators import embedding, quality, render, usage
from lexweave.plans import ingest, search
from lexweave.sources import archives, jsonl, manifest, tables

LAW = (
    "<html><tittel>Lov 4. juli 1991 nr. 47 om ekteskap</tittel>\r\n<dato>1991-07-04</dato>\n"
    "Barne- og familiedepartementet\n§ 1 Om ekteskap og skjevdeling.</html>"
)


def make_archives(folder):
    folder.mkdir(parents=True, exist_ok=True)
    buffer = io.BytesIO()
    with tarfile.open(fileobj=buffer, mode="w") as tar:
        for name, body in (("laws/a.xml", LAW), ("laws/readme.txt", "no"), ("b.HTML", "<title>Forskrift</title> ål å 2001 år")):
            data = body.encode()
            entry = tarfile.TarInfo(name)
            entry.size = len(data)
            tar.addfile(entry, io.BytesIO(data))
        directory = tarfile.TarInfo("laws")
        directory.type = tarfile.DIRTYPE
        tar.addfile(directory)
    (folder / "one.tar.bz2").write_bytes(bz2.compress(buffer.getvalue()))
    with zipfile.ZipFile(folder / "two.zip", "w") as packed:
        packed.writestr("d/", "")
        packed.writestr("d/c.htm", "<title>Vedtak om vern</title>")
    (folder / "three.xml").write_text("<title>Instruks</title>")
    (folder / "broken.zip").write_bytes(b"PK nonsense")


def test_read_archives(spark, tmp_path):
    make_archives(tmp_path / "in")
    rows = archives.read_archives(spark, str(tmp_path / "in")).collect()
    found = {(row["archive_filename"], row["member"]) for row in rows if row["error"] is None}
    assert found == {
        ("one.tar.bz2", "laws/a.xml"), ("one.tar.bz2", "laws/readme.txt"), ("one.tar.bz2", "b.HTML"),
        ("two.zip", "d/c.htm"), ("three.xml", "three.xml"),
    }
    assert [row["archive_filename"] for row in rows if row["error"]] == ["broken.zip"]


def test_zip_members_are_fetched_by_place(spark, tmp_path):
    folder = tmp_path / "with space æ 100%"
    folder.mkdir()
    kinds = [zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED, zipfile.ZIP_BZIP2, zipfile.ZIP_LZMA]
    texts = {f"m{at}.xml": f"tekst æ {at} " * (at * 50) for at in range(40)}
    with zipfile.ZipFile(folder / "big one.zip", "w") as packed:
        for at, (name, body) in enumerate(texts.items()):
            packed.writestr(name, body, kinds[at % 4])
    with zipfile.ZipFile(folder / "empty.zip", "w"):
        pass
    rows = archives.read_archives(spark, str(folder), part_bytes=500).collect()
    assert {row["member"]: row["raw"] for row in rows} == texts and not any(row["error"] for row in rows)
    frame = pd.DataFrame({"filename": ["big one.zip"], "path": [f"file:{folder}/big one.zip"]})
    places = pd.concat(archives.member_places(iter([frame]), 500))
    assert places["part"].nunique() > 5  # so several tasks share the file


def test_a_damaged_member_does_not_take_the_others_along(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as packed:
        for name in ("one.xml", "two.xml", "three.xml"):
            packed.writestr(name, name * 20)
    data = (tmp_path / "a.zip").read_bytes()
    (tmp_path / "a.zip").write_bytes(data.replace(b"two.xmltwo.xml", b"two.xmlTWO.xml", 1))
    rows = archives.read_archives(spark, str(tmp_path)).collect()
    assert {row["member"] for row in rows if not row["error"]} == {"one.xml", "three.xml"}
    assert [row["error"] for row in rows if row["error"]] == ["BadZipFile: length or checksum differs"]


def test_only_pending_files_are_opened(spark, tmp_path):
    make_archives(tmp_path / "in")
    only = spark.createDataFrame([("two.zip",), ("three.xml",), ("absent.zip",)], "filename string")
    found = archives.read_archives(spark, str(tmp_path / "in"), only)
    assert {row["archive_filename"] for row in found.collect()} == {"two.zip", "three.xml"}
    scans = [line for line in plan_of(found).splitlines() if "binaryFile" in line]
    assert scans and all("ReadSchema: struct<path:string,length:bigint>" in line for line in scans)
    nothing = archives.read_archives(spark, str(tmp_path / "in"), only.where("false"))
    assert nothing.count() == 0


def test_ingest_folder(spark, tmp_path):
    make_archives(tmp_path / "in")
    processed = spark.createDataFrame([("three.xml",)], "filename string")
    result = ingest.ingest_folder(spark, str(tmp_path / "in"), processed)
    documents = {row["member"]: row for row in result["documents"].collect()}
    assert set(documents) == {"laws/a.xml", "b.HTML", "d/c.htm"}
    law = documents["laws/a.xml"]
    assert (law["law_type"], law["year"], law["ministry"]) == ("Lov", 1991, "Barne- og familiedepartementet")
    assert law["relative_path"] == "one.tar.bz2/laws/a.xml" and "\r" not in law["content"]
    assert documents["b.HTML"]["year"] == 2001
    assert tuple(result["summary"].first()) == (4, 2, 1, 1)
    assert {row["filename"]: row["document_count"] for row in result["archives"].collect()} == {"one.tar.bz2": 2, "two.zip": 1}
    assert [row["filename"] for row in result["errors"].collect()] == ["broken.zip"]
    chunks = result["chunks"]
    assert chunks.where("embedding is not null").count() == 3
    queries = spark.createDataFrame([(1, "ekteskap skjevdeling")], "query_id long, text string")
    vectors = embedding.embed_table(queries).select("query_id", F.col("embedding").alias("vector"))
    hits = search.hybrid_search(search.index_corpus(chunks), queries.join(vectors, "query_id"), 2)
    assert hits.orderBy("rank").first()["member"] == "laws/a.xml"


def test_embedding_model(spark):
    rows = spark.createDataFrame([(at, "x" * at) for at in range(250)], "id int, text string")
    model = lambda texts: [[float(len(text)), 1.0] for text in texts]
    found = embedding.embed_table(rows, model, dimension=2, batch_size=100).collect()
    assert all(row["embedding"] == [float(row["id"]), 1.0] for row in found) and len(found) == 250
    with pytest.raises(Exception, match="must return"):
        embedding.embed_table(rows, lambda texts: [[1.0, 2.0]], dimension=2).collect()


def test_hashed_embedding(spark):
    rows = spark.createDataFrame([(1, "a b c"), (2, ""), (3, None)], "id int, text string")
    found = {row["id"]: row["embedding"] for row in embedding.embed_table(rows, dimension=16).collect()}
    assert sum(x * x for x in found[1]) == pytest.approx(1) and found[2] is None and found[3] is None


def test_listing(spark):
    rows = spark.createDataFrame([('["a", {"filename": "b"}, "", 1, null]',), ('{"files": ["c"]}',), ("nonsense",)], "raw string")
    assert sorted(row[0] for row in archives.archive_listing(rows).collect()) == ["a", "b", "c"]


def documents(spark, rows):
    return spark.createDataFrame(rows, "id long, archive_filename string, member string, title string")


def test_guard(spark):
    rows = documents(spark, [(1, "a.zip", "m", None), (2, "..", "m", None), (3, "a/b", "m", None), (4, "a.zip", "", None), (5, None, "m", None), (6, "a.zip", "m" * 1001, None)])
    valid, rejected = tables.document_key_guard(rows)
    assert [row["id"] for row in valid.collect()] == [1]
    assert {row["id"] for row in rejected.collect()} == {2, 3, 4, 5, 6}


def test_write_documents_replaces_only_its_archives(spark, tmp_path):
    path = str(tmp_path / "documents")
    tables.write_documents(documents(spark, [(1, "a", "x", "old"), (2, "a", "y", "old"), (3, "b", "x", "old")]), path)
    tables.write_documents(documents(spark, [(4, "a", "x", "new")]), path)
    assert sorted((row["id"], row["title"]) for row in spark.read.parquet(path).collect()) == [(3, "old"), (4, "new")]


def test_an_archive_without_documents_is_emptied(spark, tmp_path):
    path = str(tmp_path / "documents")
    old = documents(spark, [(1, "a b=c", "x", "old"), (2, "kept", "x", "old")])
    tables.write_documents(old, path)
    replaced = spark.createDataFrame([("a b=c",), ("new",)], "archive_filename string")
    incoming = documents(spark, [(3, "new", "x", "new")])
    tables.write_documents(incoming, path, replaced)
    assert sorted(row["id"] for row in spark.read.parquet(path).collect()) == [2, 3]
    assert sorted(row["id"] for row in tables.replace_documents(old, incoming, replaced).collect()) == [2, 3]


def test_upsert(spark):
    old = documents(spark, [(1, "a", "x", "old"), (2, "a", "y", "old")])
    new = documents(spark, [(3, "a", "x", "1"), (4, "a", "x", "2"), (5, "b", "x", "3")])
    found = tables.upsert_documents(old, new, [F.desc("id")]).collect()
    assert sorted(row["id"] for row in found) == [2, 4, 5]


def test_jsonl_round_trip(spark, tmp_path):
    rows = documents(spark, [(2, "a", "x", None), (1, "a", "y", "æ\n\"q\"")]).withColumns(
        {"document_date": F.lit(None).cast("string"), "content": F.lit("c"), "relative_path": F.concat_ws("/", "archive_filename", "member")}
    )
    jsonl.export_jsonl(rows, tables.archive_records(rows), str(tmp_path / "out"))
    lines = [line for file in sorted((tmp_path / "out" / "documents").glob("*.json")) for line in file.read_text().splitlines()]
    assert lines[0].startswith('{"id":1,"archiveFilename":"a"') and '"title":null' in lines[1]
    extra = tmp_path / "out" / "documents" / "part-z.json"
    extra.write_text("\n   \n")
    assert jsonl.import_documents(spark, str(tmp_path / "out" / "documents")).count() == 2
    assert jsonl.import_archives(spark, str(tmp_path / "out" / "archives")).first()["document_count"] == 2


def test_manifest(spark, tmp_path):
    (tmp_path / "d" / "e").mkdir(parents=True)
    (tmp_path / "d" / "e" / "x.xml").write_text("hei")
    (tmp_path / "d" / "y.bin").write_bytes(b"\0")
    found = {row["path"]: row for row in manifest.file_manifest(spark, str(tmp_path / "d"), "p").collect()}
    assert found["p/e/x.xml"]["content_type"] == "application/xml"
    assert found["p/e/x.xml"]["sha256"] == hashlib.sha256(b"hei").hexdigest()
    assert found["p/y.bin"]["content_type"] == "application/octet-stream"
    missing = quality.missing_files(
        spark.createDataFrame([("p",), ("q",)], "filename string"), manifest.file_manifest(spark, str(tmp_path / "d"), "p")
    )
    assert [row[0] for row in missing.collect()] == ["q"]


def test_render(spark):
    body = (
        "Datokode: LOV-1 Departement: Justis\n\nInnhold I Alminnelige regler. II Andre regler. "
        "I Alminnelige regler § 1a Første ledd. Andre ledd. 1. Punkt"
    )
    rows = spark.createDataFrame([(1, "Lov om x", "2020", body), (2, None, None, "bare tekst")], "id long, title string, document_date string, content string")
    found = {row["id"]: row["markdown"] for row in render.render_markdown(rows).collect()}
    first = found[1]
    assert first.startswith("# Lov om x\n\n*Dato:* 2020\n\n- **Datokode:** LOV-1\n- **Departement:** Justis\n\n## Innhold")
    assert "\n### I\nAlminnelige regler" in first and "#### § 1A" in first
    assert found[2] == "bare tekst"
    outline = [(row["level"], row["label"]) for row in render.outline(rows).orderBy("ord").collect()]
    assert outline == [(3, "I"), (3, "II"), (3, "I"), (4, "§ 1A")]


def test_latest_consent_and_scope(spark):
    rows = spark.createDataFrame([(1, "2024-01-01", 1), (1, "2024-02-01", 2), (2, "2024-01-05", 3)], "user_id long, consent_date string, n int")
    latest = usage.latest_consent(rows)
    assert sorted(row["n"] for row in latest.collect()) == [2, 3]
    principals = spark.createDataFrame([("u1", "user", 1), ("s", "service", None)], "principal string, role string, user_id long")
    found = sorted((row["principal"], row["n"]) for row in usage.consent_scope(latest, principals).collect())
    assert found == [("s", 2), ("s", 3), ("u1", 2)]
    assert sorted(row["n"] for row in usage.scope_of(latest, "service").collect()) == [2, 3]
    assert [row["n"] for row in usage.scope_of(latest, "user", 1).collect()] == [2]
    assert usage.scope_of(latest, "user").count() == 0


def test_request_key(spark, column):
    given = [(7, "x"), (None, "::ffff:1.2.3.4"), (None, "[::1]"), (None, None)]
    assert column(given, "u long, a string", usage.request_key(F.col("u"), F.col("a"))) == ["user:7", "1.2.3.4", "::1", "unknown"]


def test_a_model_sees_batches_and_other_columns_stay_as_they_are(spark):
    rows = [(9007199254740993, "ab"), (None, "c"), (3, None), (4, "")]

    def model(texts):
        assert len(texts) <= 2
        return [[float(len(text or "")), 1.0] for text in texts]

    found = embedding.embed_table(spark.createDataFrame(rows, "id long, text string").coalesce(1), model, 2, batch_size=2)
    assert "MapInArrow" in plan_of(found)
    got = sorted(map(tuple, found.collect()), key=str)
    assert got == sorted([(9007199254740993, "ab", [2.0, 1.0]), (None, "c", [1.0, 1.0]), (3, None, [0.0, 1.0]), (4, "", [0.0, 1.0])], key=str)


def test_checksums_read_files_as_streams(spark, tmp_path):
    bodies = {"a b%20.xml": b"x" * 100_000, "sub/b.bin": bytes(range(256)) * 40, "empty.xml": b""}
    for name, body in bodies.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(body)
    listed = manifest.file_manifest(spark, str(tmp_path))
    assert "content:binary" not in plan_of(listed)
    assert {row["path"]: row["sha256"] for row in listed.collect()} == {
        name: hashlib.sha256(body).hexdigest() for name, body in bodies.items() if body
    }
