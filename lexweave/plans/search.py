"""Hybrid search of a query table: lexical and vector branches, fusion, payload.

``queries`` has ``query_id, text`` and optionally ``vector`` and the filters
``filter_year, filter_law_type, filter_ministry`` (null = no filter).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from ..operators import fusion, lexical, query, ranking, vector
from ..session import materialize, small_side

PAYLOAD = [
    "document_id", "chunk_index", "content", "archive_filename", "member", "document_title",
    "document_date", "section_title", "section_number", "law_type", "year", "ministry",
]


@dataclass
class Corpus:
    """A searchable table and its text index.

    ``rows`` is keyed by ``id`` and has ``content``, maybe ``embedding``, the
    filter columns and the payload.  Where embeddings lie in a table of their own, ``vectors`` has them with ``id`` and the
    filter columns, so that no text moves to its vector.
    """

    rows: DataFrame
    postings: DataFrame
    dictionary: DataFrame
    stats: DataFrame
    vectors: DataFrame | None = None


def index_corpus(rows: DataFrame, positions: bool = False, vectors: DataFrame | None = None) -> Corpus:
    """Builds the text index of ``rows`` and saves index, dictionary and numbers once.

    Each search reads the index several times by column and never cuts the texts
    into words again.  Phrases need ``positions``.
    """
    keep = [name for name in [*lexical.FILTERS, "document_id"] if name in rows.columns]
    postings = materialize(lexical.build_postings(rows, keep=keep, positions=positions), "postings", "zstd")
    return Corpus(
        rows,
        postings,
        materialize(lexical.term_stats(postings), "dictionary"),
        materialize(lexical.corpus_stats(rows, postings), "corpus-stats"),
        vectors,
    )


def plan_terms(
    corpus: Corpus, queries: DataFrame, mode: str = "default", stop_words: list[str] | None = None
) -> tuple[DataFrame, DataFrame]:
    """The term plan of the queries and the index words behind its terms."""
    plan = query.build_match_plan(queries, mode, stop_words)
    return plan, lexical.resolve_terms(plan, corpus.postings, corpus.dictionary)


def lexical_matches(
    corpus: Corpus, queries: DataFrame, mode: str = "default", keep: list[str] | None = None, scored: bool = True,
    stop_words: list[str] | None = None,
) -> DataFrame:
    plan, terms = plan_terms(corpus, queries, mode, stop_words)
    stats = corpus.stats if scored else None
    return lexical.match_terms(corpus.postings, plan, terms, keep=keep, stats=stats, queries=queries)


def ranked_branches(
    corpus: Corpus, queries: DataFrame, limit: int = 10, mode: str = "default",
    phrase_first: bool = False, empty_policy: str = "none", stop_words: list[str] | None = None,
) -> tuple[DataFrame, DataFrame | None]:
    """The lexical and the vector list, each of twice the page size per query."""
    k = 2 * limit
    plan, terms = plan_terms(corpus, queries, mode, stop_words)
    matches = lexical.match_terms(corpus.postings, plan, terms, stats=corpus.stats, queries=queries)
    if phrase_first:
        phrases = lexical.match_phrase(corpus.postings, plan, terms, matches)
        matches = lexical.with_phrase_flag(matches, phrases)
    top = lexical.lexical_top(matches, k, phrase_first=phrase_first)
    top = top.select("query_id", "id", "score", "rank")
    if empty_policy != "none":
        top = top.unionByName(
            lexical.empty_plan_matches(queries, plan, corpus.rows, k, empty_policy)
        )
    embedded = corpus.rows if corpus.vectors is None else corpus.vectors
    nearest = vector.vector_top(embedded, queries, k) if "vector" in queries.columns else None
    return top, nearest


def fused_hits(
    corpus: Corpus, queries: DataFrame, limit: int = 10, offset: int = 0, rrf_k: int = fusion.SQL_K, **options
) -> DataFrame:
    """``(query_id, id, lexical_score, similarity, rrf_score, rank)`` without any payload."""
    top, nearest = ranked_branches(corpus, queries, limit, **options)
    branches = {"lexical_score": (top, "score")}
    if nearest is not None:
        branches["similarity"] = (nearest, "similarity")
    fused = fusion.rrf_fuse(branches, rrf_k)
    if nearest is None:
        fused = fused.withColumn("similarity", F.lit(None).cast("double"))
    return fusion.fused_page(fused, ["lexical_score", "similarity"], limit, offset)


def with_payload(hits: DataFrame, corpus: Corpus, max_rows: int | None = None) -> DataFrame:
    """Hits joined with the stored columns of their rows.

    The hits are the small side: their number is queries times page size, which
    the caller may pass; the corpus is then read once and not shuffled.
    """
    wanted = [name for name in PAYLOAD if name in corpus.rows.columns]
    return corpus.rows.select("id", *wanted).join(small_side(hits, rows=max_rows), "id")


def hybrid_search(
    corpus: Corpus, queries: DataFrame, limit: int = 10, offset: int = 0, rrf_k: int = fusion.SQL_K, **options
) -> DataFrame:
    """Fused hits with payload, blank contents dropped."""
    hits = fused_hits(corpus, queries, limit, offset, rrf_k, **options)
    found = with_payload(hits, corpus, queries.count() * limit)
    return ranking.drop_empty_content(found)


def search_page(
    corpus: Corpus, queries: DataFrame, size: int = 10, page: int = 1, base_url: str = "", scorer=None,
    reranked: bool = True, candidates: int = ranking.CANDIDATES, **options,
) -> DataFrame:
    """One page of results per query: hybrid search, base laws first, reranked, base laws first again, cut.

    ``candidates`` hits are fetched, or as many as the page reaches to.  Without ``reranked`` the page is cut from
    the fused order.  Rows with blank contents are no hits.  Returns
    ``(query_id, rank, id, filename, member, title, date, snippet, url)``; ``rank`` counts over all pages.

    Titles, snippets and addresses are made where the rows are read, so no text meets the hits.
    """
    offset = (page - 1) * size
    wanted = max(candidates, offset + size)
    hits = fused_hits(corpus, queries, wanted, **options).select("query_id", "id", "rank")
    asked = queries.select("query_id", F.col("text").alias("query"))
    hits = hits.join(asked, "query_id")
    shown = ranking.shape_hits(ranking.drop_empty_content(corpus.rows), base_url, ("id",))
    found = shown.join(small_side(hits, rows=queries.count() * wanted), "id")
    if reranked:
        found = ranking.rerank_then_boost_page(found, scorer, size, offset)
    else:
        renumbered = F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))
        found = ranking.page_hits(found.withColumn("rank", renumbered), size, offset)
    return found.select("query_id", "rank", "id", "filename", "member", "title", "date", "snippet", "url")


def type_searches(
    corpus: Corpus, queries: DataFrame, types: list[str], limit: int = 10, **options
) -> DataFrame:
    """Hits of every type for every query, each type searched on its own.

    One search runs for all types: every query is repeated once per type with
    that type as its filter.  Returns ``(query_id, law_type, id, ..., rank)``.
    """
    listed = F.explode(F.array(*[F.lit(name) for name in types])).alias("filter_law_type")
    others = [name for name in queries.columns if name not in ("query_id", "filter_law_type")]
    typed = queries.select(F.col("query_id").alias("asked"), *others, listed)
    typed = typed.withColumn("query_id", F.concat_ws("\t", F.col("asked").cast("string"), "filter_law_type"))
    hits = fused_hits(corpus, typed.drop("asked"), limit, **options)
    key = F.split("query_id", "\t")
    asked_type = queries.schema["query_id"].dataType
    return hits.withColumns({"law_type": key[1], "query_id": key[0].cast(asked_type)})


def search_by_priority(
    corpus: Corpus, queries: DataFrame, limit: int = 10, types: list[str] | None = None, **options
) -> DataFrame:
    """Search without a type filter: one type's hits per query, else an unfiltered search."""
    types = types or ranking.fixed.TYPE_PRIORITY
    hits = materialize(type_searches(corpus, queries, types, limit, **options), "typed-hits")
    picked = ranking.prioritized_search(queries, hits, limit, types)
    chosen = hits.join(
        picked.where("picked is not null").select("query_id", F.col("picked").alias("law_type")),
        ["query_id", "law_type"],
    )
    untyped = queries.join(picked.where("picked is null").select("query_id"), "query_id", "left_semi")
    fallback = fused_hits(corpus, untyped, limit, **options).withColumn("law_type", F.lit(None).cast("string"))
    return chosen.unionByName(fallback)


def document_search(corpus: Corpus, queries: DataFrame, limit: int = 10, reach: int | None = 10_000) -> DataFrame:
    """Lexical search of whole documents, with the best window of each as its snippet.

    Windows begin in the first ``reach`` characters of a document, without it anywhere.
    """
    matches = lexical_matches(corpus, queries)
    top = lexical.lexical_top(matches, limit)
    found = with_payload(top, corpus, queries.count() * limit)
    asked = queries.select("query_id", text.query_words("text").alias("tokens"))
    return found.join(asked, "query_id").withColumn(
        "snippet", text.best_window_snippet("content", "tokens", reach=reach)
    ).drop("tokens")
