"""Vector retrieval: exact cosine top-k, and an approximate variant.

Rows are compared block by block with one matrix product inside a task, and a
task emits only its best ``k`` rows per query, never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import small_side
from .lexical import FILTERS

# Queries whose vectors are sent to every executor; more are handled by a block join.
QUERY_BLOCK = 2_000
# Rows of a group of the block join; keeps a group within a task's memory.
ROW_BLOCK = 20_000
# Scores a task holds at once; the rows of a batch or group are compared in slices of so many.
CELLS = 1 << 21
DECIMALS = 8
# Buckets of each table a query is compared in, and the most planes such a bucket may lie across.
PROBES = 12
FLIPS = 3


def cosine_similarity(left, right) -> Column:
    """Cosine of two array columns in double precision; null for a zero vector."""
    left = F.transform(F.col(left) if isinstance(left, str) else left, lambda x: x.cast("double"))
    right = F.transform(F.col(right) if isinstance(right, str) else right, lambda x: x.cast("double"))

    def dot(a: Column, b: Column) -> Column:
        return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)

    return F.try_divide(dot(left, right), F.sqrt(dot(left, left)) * F.sqrt(dot(right, right)))


def _unit(vectors) -> np.ndarray:
    matrix = np.asarray([np.asarray(vector, dtype=np.float64) for vector in vectors])
    norms = np.linalg.norm(matrix, axis=1, keepdims=True)
    norms[norms == 0] = np.nan
    return matrix / norms


def _best(
    rows: pd.DataFrame, queries: pd.DataFrame, asked: np.ndarray, k: int, filters: list[str], cells: int = CELLS
) -> pd.DataFrame:
    """The best ``k`` of ``rows`` for each of ``queries``; ties go to the smaller id.

    ``asked`` has the unit vectors of the queries.  The rows are compared slice by slice, so that however many rows
    and queries meet, no more than ``cells`` scores (or those of one row) exist at a time.
    """
    step = max(1, cells // max(1, len(queries)))
    best = _best_of_slice(rows.iloc[:step], queries, asked, k, filters)
    for at in range(step, len(rows), step):
        best = _merged(best, _best_of_slice(rows.iloc[at : at + step], queries, asked, k, filters), k)
    return best


def _best_of_slice(
    rows: pd.DataFrame, queries: pd.DataFrame, asked: np.ndarray, k: int, filters: list[str]
) -> pd.DataFrame:
    rows = rows.iloc[np.argsort(rows["id"].to_numpy(), kind="stable")]
    scores = asked @ _unit(rows["embedding"]).T
    np.round(scores, DECIMALS, out=scores)
    for name in filters:
        wanted = queries[f"filter_{name}"].to_numpy(dtype=object)
        have = rows[name].to_numpy(dtype=object)
        free = pd.isnull(wanted)
        scores[~(free[:, None] | (wanted[:, None] == have[None, :]))] = np.nan
    ids = rows["id"].to_numpy()
    np.negative(scores, out=scores)
    order = np.argsort(scores, axis=1, kind="stable")[:, :k]
    query_ids = np.repeat(queries["query_id"].to_numpy(), order.shape[1])
    found = pd.DataFrame(
        {
            "query_id": query_ids,
            "id": ids[order].ravel(),
            "similarity": -np.take_along_axis(scores, order, axis=1).ravel(),
        }
    )
    return found[found["similarity"].notna()]


def _merged(left: pd.DataFrame, right: pd.DataFrame, k: int) -> pd.DataFrame:
    """The best ``k`` of each query from two such tables; a task holds no more."""
    both = pd.concat([left, right]).sort_values(["similarity", "id"], ascending=[False, True], kind="stable")
    return both[both.groupby("query_id", sort=False).cumcount() < k]


def _ids_schema(chunks: DataFrame, queries: DataFrame) -> str:
    return (
        f"query_id {queries.schema['query_id'].dataType.simpleString()}, "
        f"id {chunks.schema['id'].dataType.simpleString()}, similarity double"
    )


def _keep_best(candidates: DataFrame, k: int) -> DataFrame:
    window = Window.partitionBy("query_id").orderBy(F.desc("similarity"), F.asc("id"))
    return candidates.withColumn("rank", F.row_number().over(window)).where(F.col("rank") <= k)


def _inputs(chunks: DataFrame, queries: DataFrame) -> tuple[DataFrame, DataFrame, list[str]]:
    filters = [name for name in FILTERS if f"filter_{name}" in queries.columns and name in chunks.columns]
    rows = chunks.where("embedding is not null").select("id", "embedding", *filters)
    asked = queries.where("vector is not null").select(
        "query_id", "vector", *[f"filter_{name}" for name in filters]
    )
    return rows, asked, filters


def vector_top(chunks: DataFrame, queries: DataFrame, k: int, query_block: int = QUERY_BLOCK) -> DataFrame:
    """Exact ``(query_id, id, similarity, rank)`` of the ``k`` nearest chunks per query.

    Up to ``query_block`` queries (their number is checked) travel to the
    executors and the chunks are read once, without a shuffle.  More queries are
    met in a block join whose groups are bounded on both sides.
    """
    rows, asked, filters = _inputs(chunks, queries)
    known = asked.limit(query_block + 1).toPandas()
    if len(known) > query_block:
        return _block_top(rows, asked, k, filters)
    schema = _ids_schema(chunks, queries)
    if known.empty:
        return _keep_best(chunks.sparkSession.createDataFrame([], schema), k)
    shared = chunks.sparkSession.sparkContext.broadcast((known.drop(columns="vector"), _unit(known["vector"])))

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best = None
        for batch in batches:
            if len(batch):
                found = _best(batch, *shared.value, k, filters)
                best = found if best is None else _merged(best, found, k)
        if best is not None:
            yield best

    return _keep_best(rows.mapInPandas(scan, schema), k)


def _block_top(
    rows: DataFrame, asked: DataFrame, k: int, filters: list[str], keys: list[str] | None = None,
    row_block: int = ROW_BLOCK, query_block: int = QUERY_BLOCK, max_keys: int | None = None,
) -> DataFrame:
    """Best ``k`` per query among rows with equal ``keys``, block against block.

    Rows fall into blocks by a hash of their id and queries likewise; every pair
    of blocks is one group.  The number of blocks follows from the row counts
    per key, so that a hot key simply gets more blocks.
    """
    keys = keys or []
    row_counts, query_counts = rows.groupBy(*keys).count(), asked.groupBy(*keys).count()
    sizes = F.greatest(F.ceil(F.col("count") / row_block).cast("int"), F.lit(1)).alias("row_blocks")
    row_blocks = row_counts.select(*keys, sizes)
    sizes = F.greatest(F.ceil(F.col("count") / query_block).cast("int"), F.lit(1)).alias("query_blocks")
    query_blocks = query_counts.select(*keys, sizes)
    if keys:
        blocks = row_blocks.join(query_blocks, keys)
        rows = rows.join(small_side(blocks, rows=max_keys), keys)
        asked = asked.join(small_side(blocks, rows=max_keys), keys)
    else:
        n_rows, n_queries = row_blocks.first()[0], query_blocks.first()[0]
        rows = rows.withColumns({"row_blocks": F.lit(n_rows), "query_blocks": F.lit(n_queries)})
        asked = asked.withColumns({"row_blocks": F.lit(n_rows), "query_blocks": F.lit(n_queries)})
    row_at = F.pmod(F.xxhash64("id"), F.col("row_blocks")).cast("int")
    query_at = F.pmod(F.xxhash64("query_id"), F.col("query_blocks")).cast("int")
    every_query_block = F.explode(F.sequence(F.lit(0), F.col("query_blocks") - 1))
    every_row_block = F.explode(F.sequence(F.lit(0), F.col("row_blocks") - 1))
    left = rows.withColumn("row_at", row_at).withColumn("query_at", every_query_block)
    right = asked.withColumn("query_at", query_at).withColumn("row_at", every_row_block)
    left, right = left.drop("row_blocks", "query_blocks"), right.drop("row_blocks", "query_blocks")
    schema = _ids_schema(rows, asked)

    def best(row_group: pd.DataFrame, query_group: pd.DataFrame) -> pd.DataFrame:
        if row_group.empty or query_group.empty:
            return pd.DataFrame({"query_id": [], "id": [], "similarity": []})
        return _best(row_group, query_group, _unit(query_group["vector"]), k, filters)

    at = [*keys, "row_at", "query_at"]
    found = left.groupBy(*at).cogroup(right.groupBy(*at)).applyInPandas(best, schema)
    found = found.distinct() if keys else found
    return _keep_best(found, k)


def vector_top_approx(
    chunks: DataFrame, queries: DataFrame, k: int, dimension: int, bits: int = 6, tables: int = 8, seed: int = 7,
    probes: int = PROBES,
) -> DataFrame:
    """Approximate nearest chunks: a query is compared with rows of its random-hyperplane bucket and of those next to it.

    A row is in one bucket of each table, a query asks ``probes`` of them: its own and
    those across the planes it is nearest to, up to ``FLIPS`` planes at once.
    Candidates are scored exactly.  More probes and tables find more of the true neighbours,
    more bits compare fewer rows.  Buckets of any size are split into blocks.
    """
    planes = np.random.default_rng(seed).standard_normal((tables * bits, dimension))
    lengths = np.linalg.norm(planes, axis=1)
    flips = [at for n in range(FLIPS + 1) for at in combinations(range(bits), n)]
    across = np.array([[bit in flip for bit in range(bits)] for flip in flips], dtype=np.float64)

    def bucketed(df: DataFrame, vector: str, probes: int) -> DataFrame:
        schema = df.schema.simpleString()[len("struct<") : -1]

        def buckets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            weights = 1 << np.arange(bits)
            for batch in batches:
                if len(batch):
                    sides = np.asarray(batch[vector].tolist(), dtype=np.float64) @ planes.T
                    codes = ((sides > 0).reshape(len(batch), tables, bits) * weights).sum(axis=2)[:, :, None]
                    if probes > 1:
                        far = ((sides / lengths) ** 2).reshape(len(batch), tables, bits) @ across.T
                        nearest = np.argsort(far, axis=2, kind="stable")[:, :, :probes]
                        codes = codes ^ (across @ weights).astype(np.int64)[nearest]
                    yield batch.assign(buckets=[list(row) for row in codes.astype(np.int32)])

        coded = df.mapInPandas(buckets, f"{schema},buckets:array<array<int>>")
        names = [name for name in df.columns]
        by_table = coded.select(*names, F.posexplode("buckets").alias("hash_table", "bucket"))
        return by_table.withColumn("bucket", F.explode("bucket"))

    rows, asked, filters = _inputs(chunks, queries)
    return _block_top(
        bucketed(rows, "embedding", 1), bucketed(asked, "vector", probes), k, filters,
        keys=["hash_table", "bucket"], max_keys=tables << bits,
    )
