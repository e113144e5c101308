"""Listing of stored files with type and checksum."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .archives import open_file

BLOCK_BYTES = 4 << 20  # of a file that are in memory at a time
XML_TYPE, OTHER_TYPE = "application/xml", "application/octet-stream"


def content_type(path: Column) -> Column:
    return F.when(path.endswith(".xml"), XML_TYPE).otherwise(OTHER_TYPE)


def file_checksums(batches: Iterator[pd.DataFrame], block_bytes: int = BLOCK_BYTES) -> Iterator[pd.DataFrame]:
    """Adds ``sha256``; each file is read from its beginning, block by block."""
    for batch in batches:
        sums = []
        for path in batch["path"]:
            digest = hashlib.sha256()
            with open_file(path) as file:
                while block := file.read(block_bytes):
                    digest.update(block)
            sums.append(digest.hexdigest())
        yield batch.assign(sha256=sums)


def file_manifest(spark: SparkSession, folder: str, prefix: str = "", checksum: bool = True) -> DataFrame:
    """``(path, content_type, length, sha256)`` of all files below a folder.

    Paths are relative to the folder.  Without checksums only the listing is
    read, not the contents.  A checksum depends on every byte before, so one task reads a file, but as a
    stream: files of any size (also beyond the 2 GB of a value) take one block of memory.  Files of length 0
    are left out, as file sources skip them.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path", "length")
    if checksum:
        # Spark deals out the listing by length, so a big file is alone in its task
        files = files.mapInPandas(file_checksums, "path string, length long, sha256 string")
    root = folder.split(":", 1)[-1].rstrip("/")
    relative = F.substring_index("path", root + "/", -1)
    path = F.concat(F.lit(prefix + "/"), relative) if prefix else relative
    return files.select(path.alias("path"), content_type(path).alias("content_type"), "length", *(["sha256"] if checksum else []))
