"""Session defaults, shared scratch space and checked broadcasts."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# A side is broadcast only when it has at most this many rows.  Sides that are
# checked this way are thin (ids, terms, numbers), about 100 bytes a row, so
# the bound is some 20 MB per executor.
BROADCAST_ROWS = 200_000
DROP_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def get_session(app_name: str = "lexweave", master: str | None = None, **conf) -> SparkSession:
    """Session with the settings the jobs rely on; ``conf`` keys use ``__`` for dots."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.sources.partitionOverwriteMode": "dynamic",
        # A table bucketed by one key is joined by this and more keys without being dealt out anew.
        "spark.sql.requireAllClusterKeysForCoPartition": "false",
    }
    settings.update({key.replace("__", "."): value for key, value in conf.items()})
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A fresh path below the folder the cluster shares between its machines.

    The folder is read from ``spark.checkpoint.dir``.  Only a session whose tasks all run
    in this process may go without it; it gets a temporary folder, which is removed
    when the process ends.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[[^]]*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
        base = tempfile.mkdtemp(prefix="lexweave-")
        atexit.register(shutil.rmtree, base, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def spread(scan: DataFrame) -> DataFrame:
    """A scan with fewer splits than cores, dealt out to all of them.

    Text work costs far more than moving the rows, and a file with one row group
    is one split.  Inputs with enough splits are left alone.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if scan.rdd.getNumPartitions() < cores else scan


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """The shuffle files of a query run inside go when it ends, not when the driver's memory is next cleaned up.

    For writes: what they shuffled is never asked for again, and would lie beside all that follows.
    """
    before = spark.conf.get(DROP_SHUFFLES, None)
    spark.conf.set(DROP_SHUFFLES, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(DROP_SHUFFLES)
        else:
            spark.conf.set(DROP_SHUFFLES, before)


def materialize(df: DataFrame, name: str, compression: str | None = None) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Cuts the lineage in a way that survives the loss of executors, for tables
    that several branches of one job read.  ``compression`` names another codec than that of the session.
    """
    path = scratch_dir(df.sparkSession, name)
    with shuffles_dropped(df.sparkSession):
        df.write.parquet(path, compression=compression)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def is_small(df: DataFrame, limit: int = BROADCAST_ROWS) -> bool:
    """True when ``df`` has at most ``limit`` rows; never counts further than that."""
    return df.limit(limit + 1).count() <= limit


def small_side(df: DataFrame, limit: int = BROADCAST_ROWS, rows: int | None = None) -> DataFrame:
    """Hint a broadcast when the side is proven small, else leave it to a shuffle join.

    ``rows`` is a bound already known to the caller (for instance queries times
    page size); without it the side is counted up to the limit.
    """
    small = rows <= limit if rows is not None else is_small(df, limit)
    return F.broadcast(df) if small else df
