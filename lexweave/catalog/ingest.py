"""Queries on sources and stored tables (A), chunking (C) and embedding upkeep (D)."""

from __future__ import annotations

import io
import tarfile
import uuid
import zipfile

import pandas as pd
from pyspark.sql import functions as F

from ..functions import text
from ..operators import chunking, embedding
from ..session import materialize, scratch_dir
from ..sources import archives, jsonl, manifest, tables as stored
from .base import DOCUMENTS_SQL, RAW_DOCUMENTS_SQL, RWS, Tables, register, source_number, sql_decode, sql_group, sql_list, sql_trim

SUFFIXES = [".xml", ".HTML", ".htm", ".txt", ".xml.gz", ".xhtml"]


def pack_documents(documents, prefix: str):
    """``(archive_filename, content)``: the documents of each batch as one zip archive."""

    def pack(batches):
        for batch in batches:
            if len(batch):
                buffer = io.BytesIO()
                with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as archive:
                    for name, content in zip(batch["member"], batch["content"]):
                        archive.writestr(name, content)
                name = f"{prefix}-{batch['id'].iloc[0]}.zip"
                yield pd.DataFrame({"archive_filename": [name], "content": [buffer.getvalue()]})

    columns = documents.select("id", "member", "content")
    return columns.mapInPandas(pack, "archive_filename string, content binary")


def zipped(members):
    """``(archive_filename, content)``: the members ``(archive, member, content)`` of each archive as a zip file.

    For archives that are known to be small; each is put together by one task.
    """

    def pack(group: pd.DataFrame) -> pd.DataFrame:
        buffer = io.BytesIO()
        with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as archive:
            for name, content in zip(group["member"], group["content"]):
                archive.writestr(name, content)
        return pd.DataFrame({"archive_filename": [group["archive"].iloc[0] + ".zip"], "content": [buffer.getvalue()]})

    return members.groupBy("archive").applyInPandas(pack, "archive_filename string, content binary")


@register(
    "a1_read_archives",
    "SELECT 'd' || doc_id || '.xml' AS member, length(text) AS n_chars, md5(text) AS raw_md5 FROM documents",
)
def read_archives(t: Tables):
    """Packs the documents of each batch into a zip archive, then reads the archives."""
    members = archives.unpack_files(pack_documents(t.documents(), "a"))
    return members.select("member", F.length("raw").alias("n_chars"), F.md5(F.col("raw").cast("binary")).alias("raw_md5"))


def write_archive_files(documents, folder: str):
    """Writes ``(id, member, content)`` below ``folder``: every tenth document as a file, the others zipped or as tar.bz2.

    Returns ``(path, members)`` of the files.
    """

    def write(batches):
        from pyarrow import fs

        def store(name: str, data: bytes) -> None:
            system, place = fs.FileSystem.from_uri(f"{folder}/{name}")
            with system.open_output_stream(place, compression=None) as stream:
                stream.write(data)

        for batch in batches:
            packed, tarred, counts = io.BytesIO(), io.BytesIO(), {}
            with zipfile.ZipFile(packed, "w", zipfile.ZIP_DEFLATED) as archive, tarfile.open(fileobj=tarred, mode="w:bz2") as tape:
                for number, name, content in zip(batch["id"], batch["member"], batch["content"]):
                    data = content.encode()
                    if number % 10 == 0:
                        store(name, data)
                        counts[name] = 1
                    elif number % 2:
                        archive.writestr(name, data)
                        counts["zip"] = counts.get("zip", 0) + 1
                    else:
                        entry = tarfile.TarInfo(name)
                        entry.size = len(data)
                        tape.addfile(entry, io.BytesIO(data))
                        counts["tar.bz2"] = counts.get("tar.bz2", 0) + 1
            for kind, buffer in (("zip", packed), ("tar.bz2", tarred)):
                if kind in counts:
                    name = f"part-{uuid.uuid4().hex}.{kind}"
                    store(name, buffer.getvalue())
                    counts[name] = counts.pop(kind)
            yield pd.DataFrame({"path": list(counts), "members": list(counts.values())})

    return documents.select("id", "member", "content").mapInPandas(write, "path string, members long")


@register(
    "a1_read_archive_files",
    """SELECT CASE WHEN doc_id % 10 = 0 THEN 'file' WHEN doc_id % 2 = 1 THEN 'zip' ELSE 'tar' END AS kind, 'd' || doc_id || '.xml' AS member,
    length(text) AS n_chars, md5(text) AS raw_md5, CAST(NULL AS VARCHAR) AS error FROM documents""",
)
def read_archive_files(t: Tables):
    """Writes the documents as files, zip files and tar.bz2 files, then reads the folder."""
    folder = scratch_dir(t.spark, "archive-files")
    place = t.spark._jvm.org.apache.hadoop.fs.Path(folder)
    system = place.getFileSystem(t.spark._jsc.hadoopConfiguration())
    system.mkdirs(place)
    folder = system.makeQualified(place).toString()
    materialize(write_archive_files(t.documents(), folder), "archive-list")
    members = archives.read_archives(t.spark, folder)
    name = F.col("archive_filename")
    kind = F.when(name.endswith(".zip"), "zip").when(name.endswith(".tar.bz2"), "tar").otherwise("file")
    return members.select(
        kind.alias("kind"), "member", F.length("raw").alias("n_chars"), F.md5(F.col("raw").cast("binary")).alias("raw_md5"), "error"
    )


@register(
    "a2_searchable_members",
    f"""WITH named AS (SELECT 'd' || doc_id || ({sql_list(SUFFIXES)})[CAST(substr(source, 4) AS INT) % {len(SUFFIXES)} + 1] AS member FROM documents)
    SELECT member FROM named WHERE ends_with(lower(member), '.xml') OR ends_with(lower(member), '.html') OR ends_with(lower(member), '.htm')""",
)
def searchable(t: Tables):
    suffixes = F.array(*[F.lit(suffix) for suffix in SUFFIXES])
    named = t.read("documents").select(
        F.concat(F.lit("d"), "doc_id", F.get(suffixes, source_number() % len(SUFFIXES))).alias("member")
    )
    return archives.searchable_members(named)


LISTING_SQL = """
listing AS (SELECT DISTINCT lang || '-' || source || '.zip' AS filename FROM documents),
processed AS (SELECT DISTINCT lang || '-' || source || '.zip' AS filename
              FROM documents JOIN labels USING (doc_id) WHERE toxic = 1)"""


def listing(t: Tables):
    name = F.concat_ws("", "lang", F.lit("-"), "source", F.lit(".zip")).alias("filename")
    documents = t.read("documents")
    toxic = t.read("labels").where("toxic = 1").select("doc_id")
    return documents.select(name).distinct(), documents.join(toxic, "doc_id").select(name).distinct()


@register("a3_pending_archives", f"WITH {LISTING_SQL} SELECT filename FROM listing WHERE filename NOT IN (SELECT filename FROM processed)")
def pending(t: Tables):
    return archives.pending_archives(*listing(t))


@register(
    "a4_sync_summary",
    f"""WITH {LISTING_SQL}, outcomes AS (
      SELECT lang || '-' || source || '.zip' AS filename,
             CASE WHEN max(n_chars) > 12800 THEN 'too long' END AS error
      FROM documents GROUP BY 1)
    SELECT count(*) AS checked, count(*) FILTER (p.filename IS NULL AND o.error IS NULL) AS processed,
           count(p.filename) AS skipped, count(*) FILTER (p.filename IS NULL AND o.error IS NOT NULL) AS errors
    FROM listing l LEFT JOIN processed p USING (filename) LEFT JOIN outcomes o ON o.filename = l.filename""",
)
def summary(t: Tables):
    files, processed = listing(t)
    outcomes = t.read("documents").groupBy(
        F.concat_ws("", "lang", F.lit("-"), "source", F.lit(".zip")).alias("filename")
    ).agg(F.when(F.max("n_chars") > 12800, "too long").alias("error"))
    run = archives.pending_archives(outcomes, processed)
    return archives.sync_summary(files, processed, run)


@register(
    "a5_archive_listing",
    """WITH names AS (
      SELECT source || '.zip' AS filename FROM documents UNION ALL SELECT lang || '.zip' FROM documents)
    SELECT filename, count(*) AS n FROM names GROUP BY filename""",
)
def archive_listing(t: Tables):
    listed = F.format_string(
        '["%s.zip", {"filename": "%s.zip", "size": 3}, "", {"filename": ""}, 7, null, {"name": "x"}]', "source", "lang"
    )
    wrapped = F.when(F.col("doc_id") % 2 == 0, listed).otherwise(F.concat(F.lit('{"files": '), listed, F.lit("}")))
    found = archives.archive_listing(t.read("documents").select(wrapped.alias("raw")))
    return found.groupBy("filename").agg(F.count("*").alias("n"))


INCOMING_SQL = """
incoming AS (
  SELECT id + 1000000 AS id, archive_filename, member, 'new: ' || title AS title, law_type FROM docs
  WHERE law_type = 'de')"""


def incoming(t: Tables):
    return t.documents().where("law_type = 'de'").withColumns(
        {"id": F.col("id") + 1000000, "title": F.concat(F.lit("new: "), "title")}
    )


@register(
    "a6_replace_documents",
    f"""WITH {DOCUMENTS_SQL}, {INCOMING_SQL}
    SELECT id, archive_filename, member, title, law_type FROM docs
    WHERE archive_filename NOT IN (SELECT archive_filename FROM incoming)
    UNION ALL SELECT id, archive_filename, member, title, law_type FROM incoming""",
)
def replace(t: Tables):
    return stored.replace_documents(t.documents(), incoming(t)).select("id", "archive_filename", "member", "title", "law_type")


NAMES = ["a.zip", "", "../a", "b/c", "d\\e", "ok..zip", "x" * 255, "y" * 256, "æ.zip", "f g"]
GUARD_SQL = f"""keyed AS (
  SELECT doc_id, ({sql_list(NAMES)})[CAST(substr(source, 4) AS INT) % {len(NAMES)} + 1] AS name,
         CASE WHEN n_chars % 7 = 0 THEN '' ELSE repeat('m', CAST(n_chars % 1200 AS INT)) END AS member FROM documents),
reasons AS (
  SELECT doc_id, CASE WHEN name = '' THEN 'empty filename' WHEN length(name) > 255 THEN 'filename too long'
    WHEN contains(name, '..') OR contains(name, '/') OR contains(name, '\\') THEN 'filename has invalid characters'
    WHEN member = '' THEN 'empty member' WHEN length(member) > 1000 THEN 'member too long'
    WHEN name <> 'a.zip' THEN 'archive mismatch' END AS reason FROM keyed)"""


@register("a7_document_key_guard", f"WITH {GUARD_SQL} SELECT doc_id, coalesce(reason, 'valid') AS verdict FROM reasons".replace("'\\\\'", "'\\'"))
def guard(t: Tables):
    names = F.array(*[F.lit(name) for name in NAMES])
    keyed = t.read("documents").select(
        "doc_id",
        F.get(names, source_number() % len(NAMES)).alias("archive_filename"),
        F.when(F.col("n_chars") % 7 == 0, "").otherwise(F.expr("repeat('m', int(n_chars % 1200))")).alias("member"),
    )
    valid, rejected = stored.document_key_guard(keyed, "a.zip")
    return valid.select("doc_id", F.lit("valid").alias("verdict")).unionByName(
        rejected.select("doc_id", F.col("reason").alias("verdict"))
    )


@register("a8_storage_path")
def storage_path(t: Tables):
    return t.read("pages").select("page_id", text.storage_path(F.lit("../pages"), F.concat(F.lit("/./a/../"), "url")).alias("path"))


@register(
    "a9_upsert_documents",
    f"""WITH {DOCUMENTS_SQL}, {INCOMING_SQL}
    SELECT d.archive_filename, d.member, coalesce(i.id, d.id) AS id, coalesce(i.title, d.title) AS title
    FROM docs d LEFT JOIN incoming i USING (archive_filename, member)
    UNION ALL SELECT archive_filename, 'new-' || member, id, title FROM incoming""",
)
def upsert_documents(t: Tables):
    new = incoming(t)
    older = new.withColumn("title", F.lit("older"))
    added = new.withColumn("member", F.concat(F.lit("new-"), "member"))
    arriving = (
        older.withColumn("at", F.lit(1)).unionByName(new.withColumn("at", F.lit(2))).unionByName(added.withColumn("at", F.lit(2)))
    )
    return stored.upsert_documents(t.documents(), arriving, [F.desc("at")]).select("archive_filename", "member", "id", "title")


@register(
    "a10_upsert_archives",
    """WITH existing AS (SELECT source AS filename, count(*) AS document_count FROM documents GROUP BY 1),
    incoming AS (SELECT source AS filename, count(*) AS document_count FROM documents WHERE lang = 'es' GROUP BY 1
                 UNION ALL SELECT lang, count(*) FROM documents GROUP BY 1)
    SELECT filename, coalesce(i.document_count, e.document_count) AS document_count
    FROM existing e FULL JOIN incoming i USING (filename)""",
)
def upsert_archives(t: Tables):
    documents = t.read("documents")
    per = lambda df, name: df.groupBy(F.col(name).alias("filename")).agg(F.count("*").alias("document_count"))
    new = per(documents.where("lang = 'es'"), "source").unionByName(per(documents, "lang"))
    return stored.upsert_archives(per(documents, "source"), new)


@register(
    "a11_export_jsonl",
    f"""WITH {DOCUMENTS_SQL} SELECT id, archive_filename AS "archiveFilename", member, title, document_date AS "documentDate",
    md5(content) AS content, relative_path AS "relativePath" FROM docs""",
)
def export(t: Tables):
    exported = jsonl.export_documents(t.documents())
    return exported.withColumn("content", F.md5(F.col("content").cast("binary")))


@register("a12_export_summary", "SELECT count(DISTINCT source) AS archives, count(*) AS documents FROM documents")
def export_summary(t: Tables):
    records = stored.archive_records(t.documents())
    return jsonl.export_summary(t.documents(), records).drop("generated_at")


@register(
    "a13_import_jsonl",
    f"WITH {DOCUMENTS_SQL} SELECT id, archive_filename, member, title, document_date, md5(content) AS content_md5, relative_path FROM docs",
)
def import_jsonl(t: Tables):
    """Exports the documents, then imports what was written."""
    path = scratch_dir(t.spark, "jsonl")
    jsonl.export_jsonl(t.documents(), stored.archive_records(t.documents()), path)
    imported = jsonl.import_documents(t.spark, f"{path}/documents")
    return imported.select(
        "id", "archive_filename", "member", "title", "document_date",
        F.md5(F.col("content").cast("binary")).alias("content_md5"), "relative_path",
    )


@register("a14_file_manifest")
def file_manifest(t: Tables):
    return manifest.file_manifest(t.spark, t.sf_dir, prefix="data")


def walk_sql(size: int, overlap: int, snap: bool) -> str:
    """The chunk walk as a recursive query; offsets count from 0."""
    window = size * 0.1
    low, nn = f"(target - {window:g})", "chr(10) || chr(10)"

    def after(mark: str, width: int) -> str:
        found = f"strpos(substr(text, CAST(target AS BIGINT) + 1, {int(window) + width}), {mark})"
        return f"CASE WHEN {found} > 0 AND target + {found} - 1 < least(n, target + {window:g}) THEN target + {found} - 1 + {width} END"

    def before(mark: str, width: int) -> str:
        area = f"substr(text, CAST({low} AS BIGINT) + 2, {int(window)} + {width - 1})"
        found = f"strpos(reverse({area}), {mark})"
        return f"CASE WHEN {found} > 0 THEN CAST({low} AS BIGINT) + 1 + length({area}) - {found} - {width - 1} + {width} END"

    boundary = (
        f"coalesce({after(nn, 2)}, {before(nn, 2)}, {after('chr(10)', 1)}, {before('chr(10)', 1)}, target)"
        if snap
        else "target"
    )
    end = f"CASE WHEN target >= n THEN n ELSE least(n, CASE WHEN {boundary} > start THEN {boundary} ELSE target END) END"
    return f"""
walk AS (
  SELECT id, n, 0 AS chunk_index, CAST(0 AS BIGINT) AS start, CAST(({end.replace('start', '0')}) AS BIGINT) AS stop
  FROM (SELECT id, content AS text, length(content) AS n, {size} AS target FROM docs WHERE content <> '')
  UNION ALL
  SELECT id, n, chunk_index, start, CAST({end} AS BIGINT) AS stop FROM (
    SELECT w.id, w.n, w.chunk_index + 1 AS chunk_index, d.content AS text,
      CASE WHEN w.stop - {overlap} > w.start THEN w.stop - {overlap} ELSE w.stop END AS start,
      CASE WHEN w.stop - {overlap} > w.start THEN w.stop - {overlap} ELSE w.stop END + {size} AS target
    FROM walk w JOIN docs d USING (id) WHERE w.stop < w.n))"""


def chunk_rows(chunks):
    return chunks.select(
        "document_id", "chunk_index", "start_char", "end_char", "content_length",
        F.md5(F.col("content").cast("binary")).alias("content_md5"),
    )


def chunk_sql(size: int, overlap: int, snap: bool) -> str:
    return f"""WITH RECURSIVE {DOCUMENTS_SQL}, {walk_sql(size, overlap, snap)}
    SELECT w.id AS document_id, chunk_index, start AS start_char, stop AS end_char, stop - start AS content_length,
           md5(substr(content, start + 1, stop - start)) AS content_md5
    FROM walk w JOIN docs d USING (id)"""


@register("c1_chunk_documents", chunk_sql(12800, 2560, True))
def chunk(t: Tables):
    return chunk_rows(chunking.chunk_documents(t.documents()))


@register("c1_chunk_without_paragraphs", chunk_sql(1000, 200, False))
def chunk_closed_form(t: Tables):
    return chunk_rows(chunking.chunk_documents(t.documents(), 1000, preserve_paragraphs=False))


@register("c2_paragraph_boundary", chunk_sql(1000, 200, True))
def boundary(t: Tables):
    return chunk_rows(chunking.chunk_documents(t.documents(), 1000))


@register(
    "c1_chunks_table_function",
    chunk_sql(1000, 200, True),
)
def chunk_function(t: Tables):
    """The walk called from SQL, once per document."""
    chunking.register_chunks_function(t.spark)
    t.documents().createOrReplaceTempView("documents_to_chunk")
    return t.spark.sql(
        """SELECT d.id AS document_id, c.chunk_index, c.start_char, c.end_char, c.end_char - c.start_char AS content_length,
           md5(CAST(c.content AS BINARY)) AS content_md5 FROM documents_to_chunk d, LATERAL chunks(d.content, 1000) c"""
    )


def sql_sections(source: str) -> tuple[str, str]:
    start = f"left({source}, 2000)"
    numbers = [rf"(?i)§{RWS}*(\d+[a-z]?)", rf"(?i)paragraf{RWS}+(\d+[a-z]?)", rf"(?i)kapittel{RWS}+(\d+[a-z]?)",
               r"(?i)<paragraf[^>]*>([^<]+)", r"(?i)<kapittel[^>]*>([^<]+)"]
    titles = [r"(?i)<%s[^>]*>([^<]{1,200})" % tag for tag in ("overskrift", "tittel", "heading")]
    titles += [rf"(?m)^#+{RWS}+(.+)$", r"(?m)^(.+)\n={3,}$"]
    number = f"coalesce({', '.join(sql_trim(sql_group(start, pattern)) for pattern in numbers)})"
    found = [sql_decode(sql_trim(sql_group(start, pattern)), True) for pattern in titles]
    title = "coalesce(" + ", ".join(f"CASE WHEN length({f}) BETWEEN 1 AND 199 THEN {f} END" for f in found) + ")"
    return title, number


SECTION_TITLE_SQL, SECTION_NUMBER_SQL = sql_sections("raw")


@register(
    "c3_section_metadata",
    f"WITH {RAW_DOCUMENTS_SQL} SELECT doc_id, {SECTION_TITLE_SQL} AS section_title, {SECTION_NUMBER_SQL} AS section_number FROM raw_documents",
)
def sections(t: Tables):
    return t.raw_documents().select(
        "doc_id", text.section_title("raw").alias("section_title"), text.section_number("raw").alias("section_number")
    )


@register(
    "c4_inherit_metadata",
    f"""WITH RECURSIVE {DOCUMENTS_SQL}, {walk_sql(12800, 2560, True)}
    SELECT w.id * 1000000 + chunk_index AS id, d.archive_filename, d.member, 'new: ' || d.title AS document_title, d.law_type
    FROM walk w JOIN docs d USING (id)""",
)
def inherit(t: Tables):
    chunks = chunking.chunk_documents(t.documents())
    renamed = t.documents().withColumn("title", F.concat(F.lit("new: "), "title"))
    return chunking.inherit_metadata(chunks, renamed).select("id", "archive_filename", "member", "document_title", "law_type")


@register(
    "c5_unchunked_documents",
    "SELECT doc_id AS id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) AND source = 'src3'",
)
def unchunked(t: Tables):
    chunked = t.documents().join(t.read("labels").select(F.col("doc_id").alias("id")), "id", "left_semi")
    return chunking.unchunked_documents(t.documents(), chunking.chunk_documents(chunked), archive="src3").select("id")


@register(
    "c5_first_unchunked",
    "SELECT doc_id AS id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) ORDER BY doc_id LIMIT 50",
)
def first_unchunked(t: Tables):
    """The batch form of the operator: the next documents in order of id."""
    chunked = t.documents().join(t.read("labels").select(F.col("doc_id").alias("id")), "id", "left_semi")
    return chunking.unchunked_documents(t.documents(), chunking.chunk_documents(chunked), limit=50).select("id")


UPSERT_CHUNKS_SQL = f"""WITH RECURSIVE {DOCUMENTS_SQL}, {walk_sql(1000, 200, True)}"""


@register(
    "c6_upsert_chunks",
    f"""{UPSERT_CHUNKS_SQL}
    SELECT id AS document_id, chunk_index, CASE WHEN id IN (SELECT doc_id FROM labels) THEN 'old' ELSE 'new' END AS version FROM walk""",
)
def upsert_chunks(t: Tables):
    chunks = chunking.chunk_documents(t.documents(), 1000).select("document_id", "chunk_index")
    known = t.read("labels").select(F.col("doc_id").alias("document_id"))
    existing = chunks.join(known, "document_id", "left_semi").withColumn("version", F.lit("old"))
    return chunking.upsert_chunks(existing, chunks.withColumn("version", F.lit("new")))


@register(
    "c7_chunk_key_violations",
    f"""{UPSERT_CHUNKS_SQL}, faulty AS (
      SELECT id AS document_id, chunk_index FROM walk WHERE NOT (chunk_index = 1 AND id IN (SELECT doc_id FROM labels WHERE toxic = 1))
      UNION ALL SELECT id, chunk_index FROM walk WHERE id IN (SELECT doc_id FROM labels WHERE quality = 0))
    SELECT document_id, count(*) - count(DISTINCT chunk_index) AS repeated, max(chunk_index) + 1 - count(DISTINCT chunk_index) AS missing
    FROM faulty GROUP BY 1 HAVING count(*) > count(DISTINCT chunk_index) OR max(chunk_index) + 1 <> count(DISTINCT chunk_index)""",
)
def violations(t: Tables):
    chunks = chunking.chunk_documents(t.documents(), 1000).select("document_id", "chunk_index")
    labels = t.read("labels").withColumnRenamed("doc_id", "document_id")
    toxic = labels.where("toxic = 1").select("document_id", F.lit(1).alias("chunk_index"))
    dropped = chunks.join(toxic, ["document_id", "chunk_index"], "left_anti")
    repeated = chunks.join(labels.where("quality = 0"), "document_id", "left_semi")
    return chunking.chunk_key_violations(dropped.unionByName(repeated))


def as_chunks(t: Tables):
    """Marked-up documents in the columns the embedding text is made of."""
    return t.raw_documents().select(
        F.col("doc_id").alias("id"),
        text.extract_title("raw").alias("document_title"),
        text.section_title("raw").alias("section_title"),
        text.section_number("raw").alias("section_number"),
        F.col("raw").alias("content"),
    )


def _chunk_text_sql() -> str:
    from .enrichment import TITLE_SQL

    return f"""WITH {RAW_DOCUMENTS_SQL}, c AS (
      SELECT doc_id AS id, {TITLE_SQL} AS t, {SECTION_TITLE_SQL} AS st, {SECTION_NUMBER_SQL} AS sn, raw FROM raw_documents),
    x AS (SELECT id, CASE WHEN t <> '' THEN 'Dokument: ' || t || chr(10) || chr(10) ELSE '' END
      || CASE WHEN st <> '' THEN 'Seksjon: ' || st || chr(10) || chr(10) ELSE '' END
      || CASE WHEN sn <> '' THEN '§' || sn || chr(10) || chr(10) ELSE '' END || raw AS full_text FROM c)"""


@register(
    "d1_embedding_text",
    _chunk_text_sql() + " SELECT id, length(full_text) AS n_chars, md5(full_text) AS text_md5 FROM x",
)
def embedding_text(t: Tables):
    full = text.embedding_text("document_title", "section_title", "section_number", "content")
    texts = as_chunks(t).select("id", full.alias("full_text"))
    return texts.select("id", F.length("full_text").alias("n_chars"), F.md5(F.col("full_text").cast("binary")).alias("text_md5"))


@register(
    "d2_truncate_for_embedding",
    """SELECT doc_id, md5(CASE WHEN length(text) > 20000 THEN left(text, 19997) || '...' ELSE text END) AS bulk_md5,
    md5(left(text, 20000)) AS single_md5, CASE WHEN length(text) > 2000 THEN left(text, 1997) || '...' ELSE text END AS short FROM documents""",
)
def truncate(t: Tables):
    return t.read("documents").select(
        "doc_id",
        F.md5(text.truncate_for_embedding("text").cast("binary")).alias("bulk_md5"),
        F.md5(text.truncate_for_embedding("text", ellipsis=False).cast("binary")).alias("single_md5"),
        text.truncate_for_embedding("text", 2000).alias("short"),
    )


@register(
    "d3_truncate_head_tail",
    """SELECT doc_id, CASE WHEN length(text) > 1800 THEN left(text, 1620) || chr(10) || chr(10) || '[... content truncated for embedding ...]'
    || chr(10) || chr(10) || right(text, 180) ELSE text END AS text, length(text) > 1800 AS was_truncated, length(text) AS original_length,
    length(text) > 18000 AS at_default FROM documents""",
)
def head_tail(t: Tables):
    cut = text.truncate_head_tail("text", 1800).alias("cut")
    default = text.truncate_head_tail("text")["was_truncated"].alias("at_default")
    return t.read("documents").select("doc_id", cut, default).select("doc_id", "cut.*", "at_default")


@register(
    "d4_shrink_schedule",
    """SELECT doc_id, CASE WHEN ceil(least(length(text), 2000) / 3) <= 450 THEN 0 WHEN ceil(least(length(text), 1600) / 3) <= 450 THEN 1
      WHEN ceil(least(length(text), 1280) / 3) <= 450 THEN 2 WHEN ceil(least(length(text), 1024) / 3) <= 450 THEN 3 END AS attempt,
      CASE WHEN length(text) <= 1350 THEN 2000 ELSE 1280 END AS size_limit,
      CASE WHEN length(text) <= 1350 THEN text ELSE left(text, 1277) || '...' END AS text FROM documents""",
)
def shrink(t: Tables):
    fitted = t.read("documents").select("doc_id", text.shrink_schedule("text", 450, 2000).alias("fit"))
    return fitted.select("doc_id", "fit.attempt", F.col("fit.limit").alias("size_limit"), "fit.text")


@register("d5_estimate_tokens", "SELECT doc_id, CAST(ceil(length(text) / 3) AS INT) AS tokens FROM documents")
def tokens(t: Tables):
    return t.read("documents").select("doc_id", text.estimate_tokens("text").alias("tokens"))


@register("d6_embed_table")
def embed(t: Tables):
    return embedding.embed_table(t.read("documents").select("doc_id", "text")).select("doc_id", "embedding")


@register(
    "d6_embedding_shape",
    r"""SELECT doc_id, regexp_matches(text, '[\p{L}\p{N}]') AS embedded,
    CASE WHEN regexp_matches(text, '[\p{L}\p{N}]') THEN 64 END AS dimension,
    CASE WHEN regexp_matches(text, '[\p{L}\p{N}]') THEN 1.0::DOUBLE END AS norm FROM documents""",
)
def embedding_shape(t: Tables):
    vectors = embedding.embed_table(t.read("documents").select("doc_id", "text"))
    squares = F.aggregate("embedding", F.lit(0.0), lambda total, x: total + x.cast("double") * x.cast("double"))
    known = F.col("embedding").isNotNull()
    return vectors.select(
        "doc_id", known.alias("embedded"), F.when(known, F.size("embedding")).alias("dimension"),
        F.round(F.sqrt(squares), 4).alias("norm"),
    )


def lengths(texts: list[str]) -> list[list[float]]:
    """A model without a network: characters and line feeds of each text."""
    return [[float(len(text)), float(text.count("\n"))] for text in texts]


@register(
    "d6_embed_with_model",
    """SELECT doc_id, CAST(length(text) AS DOUBLE) AS chars, CAST(length(text) - length(replace(text, chr(10), '')) AS DOUBLE) AS breaks
    FROM documents""",
)
def embed_with_model(t: Tables):
    vectors = embedding.embed_table(t.read("documents").select("doc_id", "text"), lengths, dimension=2)
    return vectors.select(
        "doc_id", F.get("embedding", F.lit(0)).cast("double").alias("chars"), F.get("embedding", F.lit(1)).cast("double").alias("breaks")
    )


@register(
    "d7_missing_embeddings",
    "SELECT doc_id AS id FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings) AND source = 'src5' AND doc_id >= 600",
)
def missing(t: Tables):
    return embedding.missing_embeddings(t.embedded_documents(), archive="src5", resume_from=600).select("id")


@register("d7_all_missing_embeddings", "SELECT doc_id AS id FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)")
def all_missing(t: Tables):
    return embedding.missing_embeddings(t.embedded_documents()).select("id")


UPDATES_SQL = "updates AS (SELECT vec_id * 3 AS id, CASE WHEN label > 1 THEN embedding END AS embedding FROM embeddings)"


def updates(t: Tables):
    return t.read("embeddings").select(
        (F.col("vec_id") * 3).alias("id"), F.when(F.col("label") > 1, F.col("embedding")).alias("embedding")
    )


@register(
    "d8_apply_embeddings",
    f"""WITH {UPDATES_SQL} SELECT d.doc_id AS id, coalesce(u.embedding, e.embedding)[1] AS first_value
    FROM documents d LEFT JOIN embeddings e ON e.vec_id = d.doc_id LEFT JOIN updates u ON u.id = d.doc_id""",
)
def apply(t: Tables):
    return embedding.apply_embeddings(t.embedded_documents(), updates(t)).select(
        "id", F.get("embedding", F.lit(0)).alias("first_value")
    )


@register(
    "d8_failed_updates",
    f"""WITH {UPDATES_SQL} SELECT id, CASE WHEN id NOT IN (SELECT doc_id FROM documents) THEN 'unknown id' ELSE 'no embedding' END AS reason
    FROM updates WHERE id NOT IN (SELECT doc_id FROM documents) OR embedding IS NULL""",
)
def failed(t: Tables):
    return embedding.failed_updates(t.embedded_documents(), updates(t))


@register(
    "d9_embedding_size_stats",
    f"""WITH sized AS (SELECT repeat(text, CASE WHEN source = 'src1' THEN 40 WHEN source = 'src2' THEN 400 WHEN source = 'src4' THEN 0 ELSE 1 END) AS content FROM documents)
    SELECT count(*) AS total, count(*) FILTER ({sql_trim('content')} = '') AS empty_chunks,
      count(*) FILTER ({sql_trim('content')} <> '' AND length(content) > 100000 AND length(content) <= 500000) AS large_chunks,
      count(*) FILTER (length(content) > 500000) AS very_large_chunks, count(*) FILTER (length(content) > 18000) AS truncated_chunks FROM sized""",
)
def size_stats(t: Tables):
    times = F.when(F.col("source") == "src1", 40).when(F.col("source") == "src2", 400).when(F.col("source") == "src4", 0).otherwise(1)
    sized = t.read("documents").withColumn("times", times).select(F.expr("repeat(text, times)").alias("content"))
    return embedding.embedding_size_stats(sized)


