"""JSON-lines export and import of the document and archive tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ARCHIVE_FIELDS = {"filename": "filename", "processed_at": "processedAt", "document_count": "documentCount"}
DOCUMENT_FIELDS = {
    "id": "id",
    "archive_filename": "archiveFilename",
    "member": "member",
    "title": "title",
    "document_date": "documentDate",
    "content": "content",
    "relative_path": "relativePath",
}
ARCHIVE_SCHEMA = "filename string, processedAt timestamp, documentCount long"
DOCUMENT_SCHEMA = (
    "id long, archiveFilename string, member string, title string, "
    "documentDate string, content string, relativePath string"
)


def _export(df: DataFrame, fields: dict[str, str], order: str) -> DataFrame:
    return df.select(*[F.col(name).alias(field) for name, field in fields.items()]).orderBy(order)


def export_documents(documents: DataFrame) -> DataFrame:
    """Documents under their exchange names, in order of id (a range-partitioned sort)."""
    return _export(documents, DOCUMENT_FIELDS, "id")


def export_archives(archives: DataFrame) -> DataFrame:
    return _export(archives, ARCHIVE_FIELDS, "filename")


def export_jsonl(documents: DataFrame, archives: DataFrame, path: str) -> None:
    keep = {"ignoreNullFields": "false"}
    export_documents(documents).write.mode("overwrite").options(**keep).json(f"{path}/documents")
    export_archives(archives).write.mode("overwrite").options(**keep).json(f"{path}/archives")


def export_summary(documents: DataFrame, archives: DataFrame) -> DataFrame:
    """One row ``(archives, documents, generated_at)``."""
    tagged = archives.select(F.lit(1).alias("a"), F.lit(0).alias("d")).unionAll(
        documents.select(F.lit(0).alias("a"), F.lit(1).alias("d"))
    )
    return tagged.agg(
        F.coalesce(F.sum("a"), F.lit(0)).alias("archives"),
        F.coalesce(F.sum("d"), F.lit(0)).alias("documents"),
        F.current_timestamp().alias("generated_at"),
    )


def _import(spark: SparkSession, path: str, schema: str, fields: dict[str, str]) -> DataFrame:
    lines = spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    return lines.select(*[F.col(field).alias(name) for name, field in fields.items()])


def import_documents(spark: SparkSession, path: str) -> DataFrame:
    """Documents from JSON lines; blank lines are skipped, broken ones fail the job."""
    return _import(spark, path, DOCUMENT_SCHEMA, DOCUMENT_FIELDS)


def import_archives(spark: SparkSession, path: str) -> DataFrame:
    return _import(spark, path, ARCHIVE_SCHEMA, ARCHIVE_FIELDS)


def dry_run(documents: DataFrame, archives: DataFrame) -> DataFrame:
    """What an import would write, without writing it."""
    return export_summary(documents, archives).drop("generated_at")
