"""Query understanding over a table of queries ``(query_id, text, ...)``.

All row-wise except the term plan, which has one row per query term.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rules, text
from ..functions.stemming import norwegian_stem

EXACT, PREFIX, STEM = "exact", "prefix", "stem"


def infer_filters(queries: DataFrame, bare_year: bool = False) -> DataFrame:
    """Add ``filter_year, filter_law_type, filter_ministry`` read from the query text."""
    return queries.withColumns(
        {
            "filter_year": rules.query_year("text", bare_year),
            "filter_law_type": rules.query_law_type("text"),
            "filter_ministry": rules.query_ministry("text"),
        }
    )


def expand_queries(queries: DataFrame, **tables) -> DataFrame:
    """Queries with related terms and official titles appended to their text."""
    return queries.withColumn("text", rules.expand_terms("text", **tables))


def build_match_plan(queries: DataFrame, mode: str = "default", stop_words: list[str] | None = None) -> DataFrame:
    """``(query_id, ord, term, mode, n_terms)``: the terms a document has to contain.

    ``default``     words of three or more; three letters match as a prefix;
    ``split``       the same over pieces between white space;
    ``prefix_all``  every piece between blanks matches as a prefix;
    ``robust``      the same from two letters on;
    ``stemmed``     the stems of words of three or more, each standing for all words with this stem.
    Terms are reduced to their letters and digits; repeated terms count once.  Words in ``stop_words`` are no terms.
    """
    if mode == "default":
        terms = text.query_words("text")
        as_prefix = lambda term: F.length(term) == 3
    elif mode == "split":
        terms = clean_terms(text.split_words("text", 3))
        as_prefix = lambda term: F.length(term) == 3
    elif mode in ("prefix_all", "robust"):
        terms = clean_terms(text.split_words("text", 2 if mode == "robust" else 1))
        as_prefix = lambda term: F.length(term) > 0
    elif mode == "stemmed":
        terms = text.query_words("text")
        as_prefix = lambda term: F.lit(False)
    else:
        raise ValueError(f"unknown mode {mode!r}")
    if stop_words:
        terms = F.filter(terms, lambda term: ~term.isin(stop_words))
    if mode == "stemmed":
        terms = F.array_distinct(F.transform(terms, norwegian_stem))
    listed = queries.select("query_id", terms.alias("terms"))
    return listed.select(
        "query_id", F.size("terms").alias("n_terms"), F.posexplode("terms").alias("ord", "term")
    ).select(
        "query_id",
        "ord",
        "term",
        F.when(as_prefix(F.col("term")), PREFIX).otherwise(STEM if mode == "stemmed" else EXACT).alias("mode"),
        "n_terms",
    )


def clean_terms(pieces: Column) -> Column:
    """Pieces cut into their letter/digit runs, as the text index cuts documents."""
    runs = F.transform(pieces, lambda piece: F.regexp_extract_all(piece, F.lit(text.WORD_RUN), F.lit(0)))
    return F.array_distinct(F.flatten(runs))


def page_bounds(
    queries: DataFrame, max_size: int = 50, default_size: int = 10, page: str = "page", size: str = "page_size"
) -> DataFrame:
    """Clamp page and size and add the row offset.

    The size limit is 50 for searches, 20 for the assistant and 100 for the store.
    """
    clamped_page = F.greatest(F.lit(1), F.coalesce(F.col(page), F.lit(1)))
    clamped_size = F.greatest(F.lit(1), F.least(F.coalesce(F.col(size), F.lit(default_size)), F.lit(max_size)))
    clamped = queries.withColumns({page: clamped_page, size: clamped_size})
    return clamped.withColumn("offset", (F.col(page) - 1) * F.col(size))


def classify_action(queries: DataFrame, site_word: str) -> DataFrame:
    """Add ``action`` (list, fetch, search) and the ``path`` of a fetch.

    ``site_word`` is the word that addresses the data source in a query.
    """
    trimmed = F.lower(text.trim_ws("text"))
    path = F.regexp_extract(
        trimmed, rf"{site_word}{text.WS}+(/[0-9a-z_\-/]+|v[0-9][^{text.WS[1:-1]}]*)", 1
    )
    action = (
        F.when(F.coalesce(trimmed, F.lit("")) == "", "list")
        .when(trimmed.contains("list") & trimmed.contains(site_word), "list")
        .when(path != "", "fetch")
        .otherwise("search")
    )
    return queries.withColumn("action", action).withColumn("path", F.when(F.col("action") == "fetch", path))


def route_queries(
    queries: DataFrame, handlers: dict[str, list[dict]], threshold: float = 0.4, top_k: int = 2
) -> DataFrame:
    """``(query_id, handler, score)``: the best handler of each query, if good enough.

    ``handlers`` maps a name to matchers (includes, excludes, weight).  The
    handlers are a fixed handful, so they are scored and sorted inside the row.
    """
    scored = F.array(
        *[
            F.struct(
                (-rules.matcher_score("text", matchers)).alias("cost"),
                F.lit(order).alias("order"),
                F.lit(name).alias("handler"),
            )
            for order, (name, matchers) in enumerate(handlers.items())
        ]
    )
    leading = F.slice(F.sort_array(scored), 1, top_k)
    good = F.filter(leading, lambda entry: -entry["cost"] >= threshold)
    best = F.get(good, F.lit(0))
    return queries.select(
        "query_id",
        best["handler"].alias("handler"),
        F.coalesce(-best["cost"], F.lit(0.0)).alias("score"),
    )
