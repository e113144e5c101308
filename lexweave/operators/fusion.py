"""Reciprocal Rank Fusion of ranked lists.

Ranked lists hold at most twice the page size per query, so everything here
works on thin, bounded rows; texts are joined after fusion.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SQL_K, APPLICATION_K = 60, 40


def rank_positions(df: DataFrame, score: str, key: str = "id") -> DataFrame:
    """Position by falling score within each query; missing scores last, ties by id."""
    window = Window.partitionBy("query_id").orderBy(F.desc_nulls_last(score), F.asc(key))
    return df.withColumn("rank", F.row_number().over(window))


def rrf_fuse(branches: dict[str, tuple[DataFrame, str]], k: int = SQL_K, key: str = "id") -> DataFrame:
    """``(query_id, key, <name>..., rrf_score)``: sum of 1/(k + rank) over the branches.

    ``branches`` maps an output column to (ranked list, its score column).  The
    lists are stacked and summed, which equals the full outer join on the id for
    any number of branches with a single shuffle.
    """
    names = list(branches)
    stacked = [
        ranked.select(
            "query_id",
            key,
            (F.lit(1.0) / (k + F.col("rank"))).alias("part"),
            *[
                (F.col(score).cast("double") if name == own else F.lit(None).cast("double")).alias(name)
                for name in names
            ],
        )
        for own, (ranked, score) in branches.items()
    ]
    return (
        reduce(DataFrame.unionByName, stacked)
        .groupBy("query_id", key)
        .agg(*[F.max(name).alias(name) for name in names], F.sum("part").alias("rrf_score"))
    )


def fused_page(
    fused: DataFrame, names: list[str], size: int | Column = 10, offset: int | Column = 0, key: str = "id",
    order_decimals: int = 12,
) -> DataFrame:
    """The rows of one page per query, in order of fused score, then branch scores, then id."""
    order = [F.desc(F.round("rrf_score", order_decimals))]
    order += [F.desc_nulls_last(name) for name in names] + [F.asc(key)]
    window = Window.partitionBy("query_id").orderBy(*order)
    ranked = fused.withColumn("rank", F.row_number().over(window))
    if isinstance(size, int) and isinstance(offset, int):
        # a plain bound lets Spark cut the lists before the shuffle
        ranked = ranked.where(F.col("rank") <= size + offset)
    size = F.lit(size) if isinstance(size, int) else size
    offset = F.lit(offset) if isinstance(offset, int) else offset
    return ranked.where((F.col("rank") > offset) & (F.col("rank") <= offset + size))


def lexical_fallback(lexical: DataFrame, vector: DataFrame, queries: DataFrame, k: int = SQL_K) -> DataFrame:
    """Fusion where queries without a vector keep their lexical list alone."""
    with_vector = queries.where("vector is not null").select("query_id")
    nearest = vector.join(with_vector, "query_id", "left_semi")
    return rrf_fuse({"lexical_score": (lexical, "score"), "similarity": (nearest, "similarity")}, k)
