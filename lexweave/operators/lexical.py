"""Lexical retrieval: a text index as a table, term matching, BM25.

The index has one row per (chunk, word) with its positions.  It is built inside
each chunk's row, so building shuffles nothing.  Matching works on the distinct
terms of all queries first, however many queries share a term; a query then
looks only at the chunks that hold its rarest term.  Common words are spread
over all chunks and therefore over all tasks.
"""

from __future__ import annotations

from pyspark.ml.feature import StopWordsRemover
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from ..functions.stemming import norwegian_stem
from ..session import BROADCAST_ROWS, is_small, materialize
from .query import EXACT, PREFIX, STEM

K1, B = 1.2, 0.75
FILTERS = ["year", "law_type", "ministry"]
# Bits of a word, words of a block, and the most bits that travel to a task, 32 MB.
WORD_BITS, BLOCK_WORDS, MAX_BITS = 64, 1024, 1 << 28


def build_postings(
    chunks: DataFrame, key: str = "id", column: str = "content", keep: list[str] | None = None,
    stop_words: list[str] | None = None, positions: bool = True,
) -> DataFrame:
    """``(key, *keep, token, prefix3, tf, positions, n_tokens)``.

    Positions count every word, also those dropped as ``stop_words``; they are
    only needed for phrases and can be left out.
    """
    keep = keep or []
    listed = chunks.select(key, *keep, text.words(column).alias("words"))
    # Sorting puts the occurrences of a word side by side; words alone sort much faster than (word, position).
    if positions:
        order = F.transform("words", lambda word, at: F.struct(word.alias("token"), at.alias("at")))
    else:
        order = F.col("words")
    listed = listed.select(key, *keep, F.size("words").alias("n_tokens"), F.sort_array(order).alias("sorted"))

    def token(i: Column) -> Column:
        return F.get("sorted", i)["token"] if positions else F.get("sorted", i)

    starts = F.filter(
        F.sequence(F.lit(0), F.col("n_tokens") - 1), lambda i: (i == 0) | (token(i - 1) != token(i))
    )
    listed = listed.where("n_tokens > 0").select(key, *keep, "n_tokens", "sorted", starts.alias("starts"))

    def run(start: Column, i: Column) -> Column:
        stop = F.coalesce(F.get("starts", i + 1), F.col("n_tokens"))
        fields = [token(start).alias("token"), (stop - start).alias("tf")]
        if positions:
            places = F.transform(F.sequence(start, stop - 1), lambda at: F.get("sorted", at)["at"])
            fields.append(places.alias("positions"))
        return F.struct(*fields)

    found = listed.select(key, *keep, "n_tokens", F.inline(F.transform("starts", run)))
    names = ["tf", "positions", "n_tokens"] if positions else ["tf", "n_tokens"]
    postings = found.select(key, *keep, "token", F.substring("token", 1, 3).alias("prefix3"), *names)
    return postings.where(~F.col("token").isin(stop_words)) if stop_words else postings


def language_stop_words(language: str = "norwegian") -> list[str]:
    """The stop words Spark ships for a language, to be given to ``build_postings``."""
    return StopWordsRemover.loadDefaultStopWords(language)


def write_postings(postings: DataFrame, table: str, buckets: int, key: str = "id") -> None:
    """Save the index bucketed by chunk and sorted by word.

    Each bucket then answers a search alone (no shuffle on the chunk), and the
    word order inside the files lets the scan skip row groups.
    """
    (
        postings.repartition(buckets, key)
        .write.mode("overwrite").format("parquet")
        .bucketBy(buckets, key).sortBy("token").saveAsTable(table)
    )


def term_stats(postings: DataFrame) -> DataFrame:
    """``(token, prefix3, df)``: in how many chunks each word occurs (the dictionary)."""
    return postings.groupBy("token", "prefix3").agg(F.count("*").alias("df"))


def corpus_stats(chunks: DataFrame, postings: DataFrame) -> DataFrame:
    """One row ``(n_docs, avg_tokens)``; the words are counted in the index."""
    sizes = chunks.select(F.lit(1).cast("long").alias("n"), F.lit(0).cast("long").alias("t")).unionAll(
        postings.select(F.lit(0).cast("long"), F.col("tf").cast("long"))
    )
    return sizes.agg(
        F.sum("n").alias("n_docs"), F.try_divide(F.sum("t"), F.sum("n")).alias("avg_tokens")
    )


def resolve_terms(plan: DataFrame, postings: DataFrame, dictionary: DataFrame | None = None) -> DataFrame:
    """``(term_id, term, mode, token, df)``: the index words each distinct term of the plan stands for.

    Every kind of term meets the dictionary by equality: exact terms with the word, prefixes with the
    beginnings of the word that are as long as some prefix of the plan, stems with the stem of the word.  Terms
    and result are small and read several times by the matching, so they are
    written once to the shared folder; that also fixes the numbers.
    """
    dictionary = term_stats(postings) if dictionary is None else dictionary
    numbered = plan.select("term", "mode").distinct().withColumn("term_id", F.monotonically_increasing_id())
    terms = materialize(numbered, "plan-terms")
    of_prefixes = F.collect_set(F.when(F.col("mode") == PREFIX, F.length("term")))  # as many as there are lengths
    n_terms, lengths, n_stems = terms.agg(F.count("*"), of_prefixes, F.count_if(F.col("mode") == STEM)).first()
    hint = F.broadcast if n_terms <= BROADCAST_ROWS else lambda side: side

    def met(entries: DataFrame, mode: str) -> DataFrame:
        found = entries.join(hint(terms.where(F.col("mode") == mode)), "term")
        return found.select("term_id", "term", "mode", "token", "df")

    resolved = met(dictionary.withColumn("term", F.col("token")), EXACT)
    if lengths:
        fitting = F.filter(F.array(*map(F.lit, sorted(lengths))), lambda size: size <= F.length("token"))
        beginnings = F.transform(fitting, lambda size: F.substring(F.col("token"), F.lit(1), size))
        resolved = resolved.unionByName(met(dictionary.withColumn("term", F.explode(beginnings)), PREFIX))
    if n_stems:
        resolved = resolved.unionByName(met(dictionary.withColumn("term", norwegian_stem("token")), STEM))
    return materialize(resolved, "terms")


def numbered_plan(plan: DataFrame, terms: DataFrame) -> DataFrame:
    """``(query_id, ord, n_terms, term_id, df)``; no number when the index has no word for a term."""
    sizes = terms.groupBy("term", "mode", "term_id").agg(F.sum("df").alias("df"))
    return plan.join(sizes, ["term", "mode"], "left").select("query_id", "ord", "n_terms", "term_id", "df")


def bm25(corpus: Column, k1: float = K1, b: float = B) -> Column:
    """BM25 weight of one posting row from ``df, tf, n_tokens`` and the corpus numbers."""
    idf = F.log(1 + (corpus["n_docs"] - F.col("df") + 0.5) / (F.col("df") + 0.5))
    norm = F.col("tf") + k1 * (1 - b + b * F.col("n_tokens") / corpus["avg_tokens"])
    return idf * F.col("tf") * (k1 + 1) / norm


def term_hits(postings: DataFrame, terms: DataFrame, small: bool) -> DataFrame:
    """Posting rows of the words behind the terms, with ``term_id`` and ``df``."""
    words = terms.select("term_id", "token", "df")
    return postings.join(F.broadcast(words) if small else words, "token")


def posting_weight(stats: DataFrame | None) -> Column:
    """The sum of BM25 weights of posting rows, or without ``stats`` of their occurrences."""
    if stats is None:
        return F.sum("tf").cast("double")
    return F.sum(bm25(stats.select(F.struct("n_docs", "avg_tokens")).scalar()))


def doc_terms(
    postings: DataFrame, terms: DataFrame, key: str = "id", keep: list[str] | None = None,
    stats: DataFrame | None = None, positions: bool = False, small: bool | None = None,
) -> DataFrame:
    """``(key, *keep, term_id, weight)``: the terms each chunk has, over all queries at once.

    The weight is the BM25 sum of the words behind the term, or without
    ``stats`` their number.  The words of a chunk combine on the map side.
    ``small`` says whether the terms may be broadcast; otherwise they are counted.
    """
    keep = keep or []
    small = is_small(terms) if small is None else small
    hits, weight = term_hits(postings, terms, small), posting_weight(stats)
    places = [F.flatten(F.collect_list("positions")).alias("positions")] if positions else []
    return hits.groupBy(key, *keep, "term_id").agg(weight.alias("weight"), *places)


def rarest_terms(numbered: DataFrame) -> DataFrame:
    """``(query_id, term_id, n_terms)``: per query the term with the fewest postings."""
    order = F.struct(F.coalesce("df", F.lit(0).cast("long")), "ord")
    rarest = numbered.groupBy("query_id").agg(F.min_by(F.struct("term_id", "n_terms"), order).alias("rarest"))
    return rarest.select("query_id", "rarest.*")


def filter_fits(filters: list[str]) -> Column:
    """Row and query agree on every filter; a null filter of the query fits all rows."""
    fits = F.lit(True)
    for name in filters:
        fits = fits & (F.col(f"filter_{name}").isNull() | (F.col(f"filter_{name}") == F.col(name)))
    return fits


def possibly_among(rows: DataFrame, others: DataFrame, keys: list[str], max_bits: int = MAX_BITS) -> DataFrame:
    """The ``rows`` whose keys may be among those of ``others``: all that are, and a few more.

    A bit for the hash of each key, eight times as many as ``others`` has rows up to ``max_bits``, travel to the tasks in blocks.
    Above that more rows pass; nothing is ever lost.
    """
    bits = WORD_BITS * BLOCK_WORDS
    while bits < min(8 * others.count(), max_bits):
        bits *= 2
    place = F.xxhash64(*keys).bitwiseAND(F.lit(bits - 1))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), (place % WORD_BITS).cast("int"))
    words = others.select(F.floor(place / WORD_BITS).alias("word"), bit.alias("bit"))
    empty = others.sparkSession.range(bits // WORD_BITS).select(F.col("id").alias("word"), F.lit(0).cast("long").alias("bit"))
    words = words.unionByName(empty).groupBy("word").agg(F.bit_or("bit").alias("bit"))
    block = F.floor(F.col("word") / BLOCK_WORDS).alias("__block")
    listed = F.sort_array(F.collect_list(F.struct("word", "bit")))["bit"].alias("__bits")
    blocks = words.groupBy(block).agg(listed)
    placed = rows.withColumn("__place", place).withColumn("__block", F.floor(F.col("__place") / (WORD_BITS * BLOCK_WORDS)))
    word = F.get("__bits", (F.floor(F.col("__place") / WORD_BITS) % BLOCK_WORDS).cast("int"))
    met = placed.join(F.broadcast(blocks), "__block").where(F.getbit(word, (F.col("__place") % WORD_BITS).cast("int")) == 1)
    return met.select(*rows.columns)


def match_terms(
    postings: DataFrame, plan: DataFrame, terms: DataFrame, key: str = "id", keep: list[str] | None = None,
    stats: DataFrame | None = None, queries: DataFrame | None = None,
) -> DataFrame:
    """``(query_id, key, *keep, score)`` for the chunks that have every term of the query.

    ``terms`` comes from ``resolve_terms``.  Chunks with the rarest term of a
    query are its candidates; the filters ``filter_*`` of ``queries`` apply to
    them before the other terms are looked up.  Postings of the other terms meet the candidates by chunk
    and term before anything is added up, so rows of a common word outside the candidates go no further; in an
    index bucketed by chunk they never leave their bucket (with the session settings of ``get_session``).
    """
    keep = keep or []
    filters = [name for name in FILTERS if queries is not None and f"filter_{name}" in queries.columns]
    carried = list(dict.fromkeys([*keep, *filters]))
    small = is_small(terms)
    # the plan has no fewer rows than any of the query sides below
    hint = F.broadcast if is_small(plan) else lambda side: side
    numbered = numbered_plan(plan, terms)
    rarest = rarest_terms(numbered)
    if filters:
        rarest = rarest.join(queries.select("query_id", *[f"filter_{name}" for name in filters]), "query_id")
    rare_words = terms.join(hint(rarest.select("term_id").distinct()), "term_id", "left_semi")
    holders = doc_terms(postings, rare_words, key, carried, small=small).join(hint(rarest), "term_id")
    candidates = holders.where(filter_fits(filters)).select("query_id", key, *keep, "n_terms")
    wanted = materialize(candidates.join(hint(numbered.select("query_id", "term_id")), "query_id"), "wanted", "zstd")
    hits = term_hits(postings.select(key, "token", "tf", "n_tokens"), terms, small)
    # words outside the candidates are most of the index; nearly all of them stay where they are
    hits = possibly_among(hits, wanted, [key, "term_id"])
    present = hits.join(wanted, [key, "term_id"]).groupBy("query_id", key, *keep, "n_terms", "term_id").agg(
        posting_weight(stats).alias("weight")
    )
    # rounded, as the order of summing differs from run to run and would break ties
    grouped = present.groupBy("query_id", key, *keep).agg(
        F.count("*").alias("present"), F.max("n_terms").alias("n_terms"), F.round(F.sum("weight"), 6).alias("score")
    )
    return grouped.where("present = n_terms").select("query_id", key, *keep, "score")


def match_phrase(
    postings: DataFrame, plan: DataFrame, terms: DataFrame, matches: DataFrame, key: str = "id"
) -> DataFrame:
    """``(query_id, key)`` of the ``matches`` with the terms side by side in the order of the query.

    Each occurrence votes for the place where the phrase would start; a start
    with a vote of every term is a hit.
    """
    hint = F.broadcast if is_small(plan) else lambda side: side
    several = numbered_plan(plan, terms).where("n_terms > 1").select("query_id", "ord", "n_terms", "term_id")
    wanted = matches.select("query_id", key).join(hint(several), "query_id")
    occurrences = doc_terms(postings, terms, key, positions=True).select(key, "term_id", "positions")
    starts = wanted.join(occurrences, [key, "term_id"]).select(
        "query_id", key, "n_terms",
        F.explode(F.transform("positions", lambda at: at - F.col("ord"))).alias("start"),
    )
    grouped = starts.where("start >= 0").groupBy("query_id", key, "start").agg(
        F.count("*").alias("votes"), F.max("n_terms").alias("n_terms")
    )
    return grouped.where("votes = n_terms").select("query_id", key).distinct()


def with_phrase_flag(matches: DataFrame, phrases: DataFrame, key: str = "id") -> DataFrame:
    """All-term matches with ``phrase_hit``; a phrase hit always is an all-term match."""
    flagged = phrases.withColumn("phrase_hit", F.lit(True))
    return matches.join(flagged, ["query_id", key], "left").withColumn(
        "phrase_hit", F.coalesce("phrase_hit", F.lit(False))
    )


def lexical_top(matches: DataFrame, k: int, key: str = "id", phrase_first: bool = False) -> DataFrame:
    """The best ``k`` matches per query with their rank.

    Spark keeps the best ``k`` of every map task before the shuffle, so a query
    that matches a third of the corpus sends no more rows than any other.
    """
    order = [F.desc("score"), F.asc(key)]
    if phrase_first:
        order.insert(0, F.desc("phrase_hit"))
    window = Window.partitionBy("query_id").orderBy(*order)
    return matches.withColumn("rank", F.row_number().over(window)).where(F.col("rank") <= k)


def match_count(matches: DataFrame, document: str = "document_id", approximate: bool = False) -> DataFrame:
    """``(query_id, total)``: distinct documents with a match."""
    count = F.approx_count_distinct(document) if approximate else F.count_distinct(document)
    return matches.groupBy("query_id").agg(count.alias("total"))


def unmatched_queries(queries: DataFrame, plan: DataFrame) -> DataFrame:
    """Queries without a single term, for which a policy has to be chosen."""
    return queries.join(plan.select("query_id").distinct(), "query_id", "left_anti")


def empty_plan_matches(
    queries: DataFrame, plan: DataFrame, chunks: DataFrame, k: int, policy: str = "none", key: str = "id"
) -> DataFrame:
    """Matches of the queries without terms: nothing, or (``all``) every chunk.

    All chunks tie, so only the ``k`` first of them can ever be returned; they are
    taken once and given to each such query.
    """
    empty = unmatched_queries(queries, plan).select("query_id")
    ranked = chunks.select(key).orderBy(key).limit(k)
    ranked = ranked.withColumn("rank", F.row_number().over(Window.orderBy(key)))
    if policy == "none":
        ranked = ranked.where(F.lit(False))
    elif policy != "all":
        raise ValueError("policy is 'none' or 'all'")
    # k rows collected into one array: bounded by k, whatever the corpus holds
    listed = ranked.agg(F.sort_array(F.collect_list(F.struct("rank", key))).alias("rows"))
    return empty.withColumn("hit", F.explode(listed.scalar())).select(
        "query_id", F.col(f"hit.{key}").alias(key), F.lit(0.0).alias("score"), F.col("hit.rank").alias("rank")
    )
