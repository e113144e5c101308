"""Coverage checks and reconciliation of tables; aggregates and equi-joins only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import WS, trim_ws


def percent(part, whole, digits: int = 1) -> Column:
    """Share in percent, 0 for an empty table."""
    return F.coalesce(F.round(F.try_divide(part * 100.0, whole), digits), F.lit(0.0))


def null_coverage(df: DataFrame, columns: list[str], table: str) -> DataFrame:
    """``(table, column_name, total, missing, present, percent_missing)``; one pass for all columns."""
    counted = df.agg(
        F.count("*").alias("total"),
        *[F.count_if(F.col(name).isNull()).alias(name) for name in columns],
    )
    entries = F.array(
        *[F.struct(F.lit(name).alias("column_name"), F.col(name).alias("missing")) for name in columns]
    )
    return counted.select("total", F.inline(entries)).select(
        F.lit(table).alias("table_name"),
        "column_name",
        "total",
        "missing",
        (F.col("total") - F.col("missing")).alias("present"),
        percent(F.col("missing"), F.col("total")).alias("percent_missing"),
    )


def embedding_coverage(chunks: DataFrame) -> DataFrame:
    counted = chunks.agg(
        F.count("*").alias("total"), F.count("embedding").alias("with_embedding")
    )
    return counted.select(
        "total",
        "with_embedding",
        (F.col("total") - F.col("with_embedding")).alias("without_embedding"),
        percent(F.col("with_embedding"), F.col("total")).alias("percent_with"),
    )


def value_distribution(df: DataFrame, column: str) -> DataFrame:
    """``(value, n)`` over all rows; missing values are a row of their own."""
    return df.groupBy(F.col(column).cast("string").alias("value")).agg(F.count("*").alias("n"))


def grain_comparison(documents: DataFrame, chunks: DataFrame, column: str = "law_type") -> DataFrame:
    """``(value, documents, chunks)``; both tables are counted before they meet."""
    left = value_distribution(documents, column).withColumnRenamed("n", "documents")
    right = value_distribution(chunks, column).withColumnRenamed("n", "chunks")
    left, right = left.withColumnRenamed("value", "left_value"), right.withColumnRenamed("value", "right_value")
    joined = left.join(right, F.col("left_value").eqNullSafe(F.col("right_value")), "full")
    return joined.select(
        F.coalesce("left_value", "right_value").alias("value"),
        F.coalesce("documents", F.lit(0)).alias("documents"),
        F.coalesce("chunks", F.lit(0)).alias("chunks"),
    )


def reconcile_counts(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """``(key, left_rows, right_rows, matches)`` for the keys of either side."""
    a = left.groupBy(key).agg(F.count("*").alias("left_rows"))
    b = right.groupBy(key).agg(F.count("*").alias("right_rows"))
    joined = a.join(b, key, "full")
    left_rows, right_rows = F.coalesce("left_rows", F.lit(0)), F.coalesce("right_rows", F.lit(0))
    return joined.select(
        key,
        left_rows.alias("left_rows"),
        right_rows.alias("right_rows"),
        (left_rows == right_rows).alias("matches"),
    )


def reconcile_totals(left: DataFrame, right: DataFrame) -> DataFrame:
    """One row ``(left_total, right_total, difference, matches)``."""
    sides = left.select(F.lit(1).alias("l"), F.lit(0).alias("r")).unionAll(
        right.select(F.lit(0).alias("l"), F.lit(1).alias("r"))
    )
    totals = sides.agg(
        F.coalesce(F.sum("l"), F.lit(0)).alias("left_total"),
        F.coalesce(F.sum("r"), F.lit(0)).alias("right_total"),
    )
    return totals.select(
        "left_total",
        "right_total",
        (F.col("left_total") - F.col("right_total")).alias("difference"),
        (F.col("left_total") == F.col("right_total")).alias("matches"),
    )


def reconcile_content(left: DataFrame, right: DataFrame, first: int | None = None) -> DataFrame:
    """``(id, archive_filename, member, reason)``; the reason is null when the rows agree.

    Compares all documents, or the ``first`` by id.  Contents are
    compared by a hash of the text with its white space normalised, so the join
    moves no texts.
    """
    key = ["archive_filename", "member"]

    def fingerprint(content: Column) -> Column:
        return F.sha2(F.regexp_replace(trim_ws(content), WS + "+", " "), 256)

    mine = left.select(
        "id", *key, fingerprint(F.col("content")).alias("text"), "title", "document_date"
    )
    if first is not None:
        mine = left.select("id", *key, "content", "title", "document_date").orderBy("id").limit(first)
        mine = mine.select("id", *key, fingerprint(F.col("content")).alias("text"), "title", "document_date")
    theirs = right.select(
        *key,
        fingerprint(F.coalesce("content", F.lit(""))).alias("other_text"),
        F.col("title").alias("other_title"),
        F.col("document_date").alias("other_date"),
        F.lit(True).alias("found"),
    )
    same_title = F.col("title").eqNullSafe(F.col("other_title"))
    same_date = F.col("document_date").eqNullSafe(F.col("other_date"))
    as_text = lambda flag: F.when(flag, "true").otherwise("false")
    reason = (
        F.when(F.col("found").isNull(), "not found")
        .when(~F.col("text").eqNullSafe(F.col("other_text")), "content differs")
        .when(
            ~(same_title & same_date),
            F.concat(
                F.lit("metadata differs (title: "), as_text(same_title),
                F.lit(", date: "), as_text(same_date), F.lit(")"),
            ),
        )
    )
    return mine.join(theirs, key, "left").select("id", *key, reason.alias("reason"))


def missing_files(archives: DataFrame, manifest: DataFrame) -> DataFrame:
    """Archives without any stored file below their name."""
    stored = manifest.select(F.substring_index("path", "/", 1).alias("filename")).distinct()
    return archives.select("filename").join(stored, "filename", "left_anti")


def reconcile_verdict(
    counts: DataFrame, totals: DataFrame, missing: DataFrame, contents: DataFrame
) -> DataFrame:
    """One row: each check, and whether all of them passed."""
    checks = (
        counts.select(F.lit("counts").alias("kind"), F.col("matches").alias("ok"))
        .unionAll(totals.select(F.lit("totals"), "matches"))
        .unionAll(missing.select(F.lit("files"), F.lit(False)))
        .unionAll(contents.select(F.lit("contents"), F.col("reason").isNull()))
    )
    every = lambda kind: F.coalesce(F.bool_and(F.when(F.col("kind") == kind, F.col("ok"))), F.lit(True))
    return checks.agg(
        every("counts").alias("counts_ok"),
        every("totals").alias("totals_ok"),
        every("files").alias("files_ok"),
        every("contents").alias("contents_ok"),
        F.coalesce(F.bool_and("ok"), F.lit(True)).alias("success"),
    )
