"""Ordering and shaping of hits after retrieval.

Hits are ``(query_id, rank, ...)``, a bounded number per query, so each query's
window stays small whatever the corpus holds.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed_values as fixed
from ..functions import links, rules, text

# What a remote ranking service takes and gives: hits scored at most, and hits returned beyond the page.
SERVICE_LIMIT, SERVICE_EXTRA = 100, 5
# Hits fetched for reranking where a page needs fewer.
CANDIDATES = 50


def drop_empty_content(hits: DataFrame) -> DataFrame:
    return hits.where(~text.is_blank("content"))


def tier_boost(hits: DataFrame) -> DataFrame:
    """Base law asked for first, documents that change others last, else the order kept.

    Hits carry the text of their query in ``query``.
    """
    window = Window.partitionBy("query_id").orderBy(rules.title_tier("title", "query"), "rank")
    return hits.withColumn("rank", F.row_number().over(window))


def overlap_score(query, candidate) -> Column:
    """Share of the distinct query words that occur in the candidate."""
    asked = text.query_words(query)
    shared = F.size(F.array_intersect(asked, text.words(candidate)))
    return F.coalesce(F.try_divide(shared, F.size(asked)), F.lit(0.0))


def rerank(
    hits: DataFrame,
    scorer: Callable[[list[str], list[str]], list[float]] | None = None,
    size: int | None = None,
    offset: int = 0,
    candidates: int | None = None,
    extra: int = 0,
) -> DataFrame:
    """The hits by the score of (query, title and snippet), with their old rank in ``index``.

    Blank hits are dropped.  With ``candidates`` only the first so many are scored; with ``size`` the
    page and ``extra`` hits beyond it are returned, else all.  ``scorer`` takes the queries and texts of one batch and runs
    inside the tasks; the default is the word overlap.  Queries for which the
    scorer fails keep their order.
    """
    candidate = text.trim_ws(F.concat_ws(" ", F.coalesce("title", F.lit("")), "snippet"))
    taken = hits if candidates is None else hits.where(F.col("rank") <= candidates)
    scored = taken.withColumn("__text", candidate)
    scored = scored.where(F.col("__text") != "").withColumn("index", F.col("rank") - 1)
    if scorer is None:
        scored = scored.withColumn("relevance", overlap_score("query", "__text"))
    else:
        scored = _apply_scorer(scored, scorer)
    window = Window.partitionBy("query_id").orderBy(F.desc_nulls_last("relevance"), "index")
    ranked = scored.withColumn("rank", F.row_number().over(window)).drop("__text")
    return ranked if size is None else ranked.where(F.col("rank") <= offset + size + extra)


def _apply_scorer(hits: DataFrame, scorer: Callable[[list[str], list[str]], list[float]]) -> DataFrame:
    schema = hits.schema.simpleString()[len("struct<") : -1]

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            try:
                scores = list(scorer(batch["query"].tolist(), batch["__text"].tolist()))
                if len(scores) != len(batch):
                    raise ValueError("one score per text expected")
            except Exception:  # noqa: BLE001 - a failing model must not lose the hits
                scores = [None] * len(batch)
            yield batch.assign(relevance=pd.Series(scores, index=batch.index, dtype="float64"))

    scored = hits.mapInPandas(score, f"{schema},relevance:double")
    failed = F.max(F.col("relevance").isNull()).over(Window.partitionBy("query_id"))
    return scored.withColumn("relevance", F.when(~failed, F.col("relevance")))


def rerank_then_boost_page(
    hits: DataFrame, scorer=None, size: int = 10, offset: int = 0, candidates: int | None = None, extra: int = SERVICE_EXTRA
) -> DataFrame:
    boosted = tier_boost(hits)
    return page_hits(tier_boost(rerank(boosted, scorer, size, offset, candidates, extra)), size, offset)


def page_hits(hits: DataFrame, size: int = 10, offset: int = 0) -> DataFrame:
    return hits.where((F.col("rank") > offset) & (F.col("rank") <= offset + size))


def shape_hits(rows: DataFrame, base_url: str, keys: tuple[str, ...] = ("query_id", "rank")) -> DataFrame:
    """``rows`` as the caller of a search sees them, behind ``keys``: title with section, snippet, viewer address.

    Columns that a table without sections or dates lacks count as null.
    """
    def known(name: str) -> Column:
        return F.col(name) if name in rows.columns else F.lit(None).cast("string")

    return rows.select(
        *keys,
        F.col("archive_filename").alias("filename"),
        "member",
        display_title(known("document_title"), known("section_title"), known("section_number")).alias("title"),
        known("document_date").alias("date"),
        text.chunk_snippet("content").alias("snippet"),
        links.viewer_url("archive_filename", "member", base_url).alias("url"),
    )


def display_title(title, section, number) -> Column:
    """Document title, else section title, with the section number behind or instead."""
    shown = F.coalesce(text.null_if_empty(title), text.null_if_empty(section))
    number = text.null_if_empty(number)
    return (
        F.when(number.isNull(), shown)
        .when(shown.isNull(), F.concat(F.lit("§ "), number))
        .otherwise(F.concat(shown, F.lit(" ("), number, F.lit(")")))
    )


def searched_files(page: DataFrame) -> DataFrame:
    """``(query_id, files)``: the archives on a page, in order of first use (at most a page)."""
    ordered = F.sort_array(F.collect_list(F.struct("rank", "filename")))
    return page.groupBy("query_id").agg(
        F.array_distinct(F.transform(ordered, lambda entry: entry["filename"])).alias("files")
    )


def result_totals(queries: DataFrame, hits: DataFrame, counts: DataFrame, size: int = 10) -> DataFrame:
    """``(query_id, total, pages)``: counted matches, else the number of hits, and the pages."""
    found = hits.groupBy("query_id").agg(F.count("*").alias("hits"))
    joined = queries.select("query_id").join(found, "query_id", "left").join(counts, "query_id", "left")
    total = (
        F.when(F.coalesce("hits", F.lit(0)) == 0, 0)
        .when(F.coalesce("total", F.lit(0)) > 0, F.col("total"))
        .otherwise(F.col("hits"))
    )
    return joined.select(
        "query_id",
        total.cast("long").alias("total"),
        F.greatest(F.lit(1), F.ceil(total / size)).cast("long").alias("pages"),
    )


def prioritized_search(
    queries: DataFrame, hits: DataFrame, size: int = 10, types: list[str] = fixed.TYPE_PRIORITY
) -> DataFrame:
    """``(query_id, picked)``: the one type whose hits answer a query without a type filter.

    ``hits`` has the hits of every type, ``(query_id, law_type, ...)``, each type
    searched on its own.  ``picked`` is null when no type has any hit: then the
    search runs without a type filter.
    """
    main, second, *rest = types
    counts = hits.groupBy("query_id").agg(
        *[
            F.least(F.count_if(F.col("law_type") == name), F.lit(size)).alias(f"n_{at}")
            for at, name in enumerate(types)
        ]
    )
    known = queries.select("query_id", "text").join(counts, "query_id", "left")
    n = [F.coalesce(f"n_{at}", F.lit(0)) for at in range(len(types))]
    enough = max(3, size // 2)
    asks_second = rules.has_word("text", second.lower())
    asks_main = rules.has_word("text", main.lower()) & ~asks_second
    by_word = (asks_second & (n[1] > 0)) | (asks_main & (n[0] > 0))

    first_pick = (
        F.when(asks_second & (n[1] > 0), F.lit(second))
        .when(asks_main & (n[0] > 0), F.lit(main))
        .when(n[0] > 0, F.lit(main))
        .when(n[1] > 0, F.lit(second))
    )
    picked_count = F.when(first_pick == main, n[0]).when(first_pick == second, n[1])
    # a pick by the query's own words has to be large enough; the others end the search
    settled = first_pick.isNotNull() & (~by_word | (picked_count >= enough))
    later = F.coalesce(*[F.when(n[at + 2] >= enough, F.lit(name)) for at, name in enumerate(rest)])

    # with no pick at all, a later type replaces an earlier one by more than twice its hits
    best = F.struct(n[2].alias("n"), F.lit(rest[0]).alias("name"))
    for at, name in enumerate(rest[1:], start=3):
        best = F.when(n[at] > best["n"] * 2, F.struct(n[at].alias("n"), F.lit(name).alias("name"))).otherwise(best)
    weak = F.when(best["n"] > 0, best["name"])
    picked = F.when(settled, first_pick).otherwise(F.coalesce(later, first_pick, weak))
    return known.select("query_id", picked.alias("picked"))


def merge_sources(results: dict[str, DataFrame], wanted: int) -> DataFrame:
    """Result lists of several sources under each other, each with its share of the rows.

    Every list has ``(query_id, rank, ...)``; ranks continue over the sources in
    the order given.
    """
    share = -(-wanted // len(results))
    merged = None
    for order, (source, found) in enumerate(results.items()):
        part = found.where(F.col("rank") <= share).withColumns(
            {"source": F.lit(source), "__order": F.lit(order)}
        )
        merged = part if merged is None else merged.unionByName(part)
    window = Window.partitionBy("query_id").orderBy("__order", "rank")
    return merged.withColumn("rank", F.row_number().over(window)).drop("__order")


def prioritize_document_links(results: DataFrame, wanted: int) -> DataFrame:
    """Document links first, order kept otherwise; the first ``wanted`` per query."""
    window = Window.partitionBy("query_id").orderBy((~links.is_document_link("link")).cast("int"), "rank")
    return results.withColumn("rank", F.row_number().over(window)).where(F.col("rank") <= wanted)


def project_web_results(results: DataFrame) -> DataFrame:
    return results.select(
        "query_id",
        "rank",
        "title",
        "link",
        "snippet",
        "date",
        links.is_document_link("link").alias("is_document"),
        "source",
    )


def source_counts(results: DataFrame) -> DataFrame:
    return results.groupBy("query_id", "source").agg(F.count("*").alias("n"))
