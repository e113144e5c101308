"""Queries on query understanding (E), lexical (F) and vector retrieval and fusion (G)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fixed_values as fixed
from ..functions import rules, stemming, text
from ..operators import chunking, fusion, lexical, query, vector
from ..plans import search
from ..session import materialize, small_side
from .base import ASKED_SQL, DOCUMENTS_SQL, QUERIES_SQL, RWS, Tables, register, sql_group, sql_trim
from .enrichment import sql_ministries, sql_rules
from .ingest import walk_sql

# --- E: query understanding -------------------------------------------------


def ordered_terms_sql(source: str, terms: str, name: str = "terms") -> str:
    """Distinct terms of each query in order of first use."""
    return f"""
{name}_all AS (SELECT query_id, unnest(l) AS term, generate_subscripts(l, 1) AS pos FROM (SELECT query_id, {terms} AS l FROM {source})),
{name} AS (SELECT query_id, term, row_number() OVER (PARTITION BY query_id ORDER BY min(pos)) - 1 AS ord,
           count(*) OVER (PARTITION BY query_id) AS n_terms FROM {name}_all GROUP BY query_id, term)"""


WORDS_SQL = r"regexp_extract_all(lower(text), '[\p{L}\p{N}]{3,}')"
SPLIT_SQL = f"list_filter(regexp_split_to_array(lower({sql_trim('text')}), '{RWS}+'), lambda x: length(x) >= 3)"


@register(
    "e1_tokenize",
    f"""WITH {ordered_terms_sql('(SELECT item_id AS query_id, text FROM benchmark)', WORDS_SQL)}
    SELECT query_id AS item_id, list(term ORDER BY ord) AS tokens FROM terms GROUP BY 1""",
)
def tokenize(t: Tables):
    return t.read("benchmark").select("item_id", text.query_words("text").alias("tokens"))


@register("e2_tokenize_sql", f"SELECT item_id, {SPLIT_SQL} AS tokens FROM benchmark")
def tokenize_sql(t: Tables):
    return t.read("benchmark").select("item_id", text.split_words("text").alias("tokens"))


def _dictionary_sql(entries: dict[str, list[str]]) -> str:
    rows = [
        f"('{key}', {at}, '{value}')" for key, values in entries.items() for at, value in enumerate(values)
    ]
    return f"(VALUES {', '.join(rows)}) v(word, i, value)"


@register(
    "e3_expand_terms",
    f"""WITH {ASKED_SQL}, pieces AS (
      SELECT query_id, text, regexp_replace(unnest(w), '[^\\p{{L}}\\p{{N}}]', '', 'g') AS word, generate_subscripts(w, 1) AS pos
      FROM (SELECT query_id, text, regexp_split_to_array(lower(text), '{RWS}+') AS w FROM asked)),
    found AS (SELECT query_id, 1 AS part, pos, i, value FROM pieces JOIN {_dictionary_sql(fixed.TERM_EXPANSIONS)} USING (word)
      UNION ALL SELECT query_id, 2, pos, i, value FROM pieces JOIN {_dictionary_sql(fixed.OFFICIAL_TITLES)} USING (word)),
    added AS (SELECT query_id, string_agg(value, ' ' ORDER BY part, pos, i) AS more FROM found GROUP BY 1)
    SELECT query_id, CASE WHEN more IS NULL THEN text ELSE text || ' ' || more END AS text FROM asked LEFT JOIN added USING (query_id)""",
)
def expand(t: Tables):
    return query.expand_queries(t.asked())


def plan_sql(source: str, mode: str = "default") -> str:
    if mode == "default":
        return ordered_terms_sql(source, WORDS_SQL, "ordered") + """,
plan AS (SELECT query_id, CAST(ord AS INT) AS ord, term, CASE WHEN length(term) = 3 THEN 'prefix' ELSE 'exact' END AS mode,
         CAST(n_terms AS INT) AS n_terms FROM ordered)"""
    least = {"split": 3, "prefix_all": 1, "robust": 2}[mode]
    pieces = f"list_filter(regexp_split_to_array(lower({sql_trim('text')}), '{RWS}+'), lambda x: length(x) >= {least})"
    terms = f"flatten(list_transform({pieces}, lambda x: regexp_extract_all(x, '[\\p{{L}}\\p{{N}}]+')))"
    as_prefix = "length(term) = 3" if mode == "split" else "true"
    return ordered_terms_sql(source, terms, "ordered") + f""",
plan AS (SELECT query_id, CAST(ord AS INT) AS ord, term, CASE WHEN {as_prefix} THEN 'prefix' ELSE 'exact' END AS mode,
         CAST(n_terms AS INT) AS n_terms FROM ordered)"""


@register("e4_build_match_plan", f"WITH {QUERIES_SQL}, {plan_sql('queries')} SELECT query_id, ord, term, mode, n_terms FROM plan")
def match_plan(t: Tables):
    return query.build_match_plan(t.queries())


@register("e4_match_plan_split", f"WITH {QUERIES_SQL}, {plan_sql('queries', 'split')} SELECT query_id, ord, term, mode, n_terms FROM plan")
def match_plan_split(t: Tables):
    return query.build_match_plan(t.queries(), "split")


@register("e5_prefix_all_plan", f"WITH {QUERIES_SQL}, {plan_sql('queries', 'prefix_all')} SELECT query_id, ord, term, mode, n_terms FROM plan")
def prefix_plan(t: Tables):
    return query.build_match_plan(t.queries(), "prefix_all")


@register("e5_robust_plan", f"WITH {QUERIES_SQL}, {plan_sql('queries', 'robust')} SELECT query_id, ord, term, mode, n_terms FROM plan")
def robust_plan(t: Tables):
    return query.build_match_plan(t.queries(), "robust")


def _query_year_sql() -> str:
    patterns = [
        rf"(?i)(?:fra|from|i|in|år|year){RWS}+(\d{{4}})\b",
        rf"(?i)\b(\d{{4}}){RWS}+(?:lov|forskrift|vedtak|reglement)",
    ]
    years = [f"TRY_CAST({sql_group('text', pattern)} AS INT)" for pattern in patterns]
    return "coalesce(" + ", ".join(f"CASE WHEN {year} BETWEEN 1900 AND 2100 THEN {year} END" for year in years) + ")"


QUERY_TYPE_SQL = (
    rf"CASE WHEN regexp_matches(text, '(?i)\bforskrift{RWS}+til{RWS}+.*lov\b') THEN 'Forskrift' ELSE "
    + sql_rules("text", fixed.QUERY_LAW_TYPES)
    + " END"
)
QUERY_MINISTRY_SQL = sql_rules("text", sql_ministries(True))


@register(
    "e6_infer_filters",
    f"""WITH {ASKED_SQL} SELECT query_id, {_query_year_sql()} AS filter_year, {QUERY_TYPE_SQL} AS filter_law_type,
    {QUERY_MINISTRY_SQL} AS filter_ministry FROM asked""",
)
def infer(t: Tables):
    return query.infer_filters(t.asked()).drop("text")


def _core_sql(source: str) -> str:
    cleaned = source
    for pattern in (
        rf"(?i)^(?:forskrift{RWS}+til{RWS}+)?lov{RWS}+om{RWS}+",
        rf"(?i)^forskrift{RWS}+til{RWS}+",
        rf"(?i)^lov{RWS}+om{RWS}+",
        rf"(?i)^forskrift{RWS}+om{RWS}+",
    ):
        cleaned = f"regexp_replace({cleaned}, '{pattern}', '')"
    return f"coalesce(nullif({sql_trim(cleaned)}, ''), {source})"


@register("e7_core_terms", f"WITH {ASKED_SQL} SELECT query_id, {_core_sql('text')} AS core FROM asked")
def core(t: Tables):
    return t.asked().select("query_id", rules.core_terms("text").alias("core"))


@register(
    "e8_query_embedding_text",
    f"""WITH {ASKED_SQL}, f AS (SELECT query_id, text, {_core_sql('text')} AS core, {_query_year_sql()} AS y,
      {QUERY_TYPE_SQL} AS lt, {QUERY_MINISTRY_SQL} AS m FROM asked),
    c AS (SELECT query_id, '{fixed.EMBEDDING_QUERY_INTRO}' || chr(10) || text AS head, core, text,
      coalesce(chr(10) || 'Dokumenttype: ' || lt, '') || coalesce(chr(10) || 'År: ' || y, '') || coalesce(chr(10) || 'Departement: ' || m, '')
      || chr(10) || '{fixed.EMBEDDING_QUERY_END}' AS tail FROM f)
    SELECT query_id, head || CASE WHEN core <> text THEN chr(10) || 'Kjernebegreper: ' || core ELSE '' END || tail AS full_form,
           head || tail AS store_form FROM c""",
)
def embedding_text(t: Tables):
    inferred = query.infer_filters(t.asked())
    columns = ["text", "filter_law_type", "filter_year", "filter_ministry"]
    return inferred.select(
        "query_id",
        rules.query_embedding_text(*columns).alias("full_form"),
        rules.query_embedding_text(*columns, core=False).alias("store_form"),
    )


@register(
    "e9_page_bounds",
    """SELECT event_id, greatest(1, coalesce(k - 30, 1)) AS page, greatest(1, least(coalesce(s, 10), 50)) AS page_size,
    (greatest(1, coalesce(k - 30, 1)) - 1) * greatest(1, least(coalesce(s, 10), 50)) AS "offset"
    FROM (SELECT event_id, CAST(json_extract(props, '$.k') AS INT) AS k, CASE WHEN event_type <> 'view' THEN CAST(floor(value) AS INT) END AS s FROM events)""",
)
def page_bounds(t: Tables):
    events = t.read("events").select(
        "event_id",
        (F.get_json_object("props", "$.k").cast("int") - 30).alias("page"),
        F.when(F.col("event_type") != "view", F.floor("value").cast("int")).alias("page_size"),
    )
    return query.page_bounds(events)


@register(
    "e10_classify_action",
    rf"""WITH {ASKED_SQL}, p AS (SELECT query_id, lower({sql_trim('text')}) AS q FROM asked UNION ALL
      SELECT -1 - conv_id, '' FROM conversations WHERE turn = 0),
    m AS (SELECT query_id, q, regexp_extract(q, 'arkivet{RWS}+(/[0-9a-z_\-/]+|v[0-9][^\t-\r \x{{a0}}]*)', 1) AS path FROM p),
    a AS (SELECT query_id, path, CASE WHEN q = '' THEN 'list' WHEN contains(q, 'list') AND contains(q, 'arkivet') THEN 'list'
      WHEN path <> '' THEN 'fetch' ELSE 'search' END AS action FROM m)
    SELECT query_id, action, CASE WHEN action = 'fetch' THEN path END AS path FROM a""",
)
def action(t: Tables):
    blank = t.read("conversations").where("turn = 0").select((-1 - F.col("conv_id")).alias("query_id"), F.lit(" \n").alias("text"))
    return query.classify_action(t.asked().unionByName(blank), "arkivet").drop("text")


HANDLERS = {
    "archive": [
        {"includes": ["arkivet"], "weight": 0.96},
        {"includes": ["legal", "dataset"], "weight": 0.92},
        {"includes": ["statute"], "excludes": ["2015"], "weight": 0.65},
        {"includes": ["lov"], "weight": 0.35},
    ],
    "web": [{"includes": ["fra"]}, {"includes": ["vedtak"], "weight": 1.7}],
    "other": [{"includes": ["que"], "excludes": ["lov", "fra"], "weight": 0.5}],
}


@register(
    "e11_route_queries",
    f"""WITH {ASKED_SQL}, l AS (SELECT query_id, lower(text) AS q FROM asked),
    s AS (SELECT query_id, unnest([0, 1, 2]) AS pos, unnest(['archive', 'web', 'other']) AS handler, unnest([
      greatest(CASE WHEN contains(q, 'arkivet') THEN 0.96 ELSE 0 END, CASE WHEN contains(q, 'legal') AND contains(q, 'dataset') THEN 0.92 ELSE 0 END,
               CASE WHEN contains(q, 'statute') AND NOT contains(q, '2015') THEN 0.65 ELSE 0 END, CASE WHEN contains(q, 'lov') THEN 0.35 ELSE 0 END),
      greatest(CASE WHEN contains(q, 'fra') THEN 0.6 ELSE 0 END, CASE WHEN contains(q, 'vedtak') THEN 1.0 ELSE 0 END),
      CASE WHEN contains(q, 'que') AND NOT contains(q, 'lov') AND NOT contains(q, 'fra') THEN 0.5 ELSE 0 END]) AS score FROM l),
    best AS (SELECT query_id, handler, CAST(score AS DOUBLE) AS score FROM s
      QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, pos) = 1)
    SELECT query_id, CASE WHEN score >= 0.4 THEN handler END AS handler, CASE WHEN score >= 0.4 THEN score ELSE 0 END AS score FROM best""",
)
def route(t: Tables):
    return query.route_queries(t.asked(), HANDLERS)


# --- F: lexical retrieval ---------------------------------------------------


def postings_sql(source: str = "docs", key: str = "id", column: str = "content", keep: str = "") -> str:
    return f"""
words AS (SELECT {key} AS id{keep}, unnest(w) AS token, generate_subscripts(w, 1) - 1 AS pos, len(w) AS n_tokens
          FROM (SELECT *, regexp_extract_all(lower({column}), '[\\p{{L}}\\p{{N}}]+') AS w FROM {source})),
postings AS (SELECT id{keep}, token, left(token, 3) AS prefix3, count(*) AS tf, list(pos ORDER BY pos) AS positions, n_tokens
             FROM words GROUP BY id{keep}, token, n_tokens),
corpus AS (SELECT count(*) AS n_docs, avg(len(regexp_extract_all(lower({column}), '[\\p{{L}}\\p{{N}}]+'))) AS avg_tokens FROM {source})"""


TERMS_SQL = """
dictionary AS (SELECT token, count(*) AS df FROM postings GROUP BY token),
resolved AS (SELECT query_id, ord, n_terms, token, df FROM plan JOIN dictionary
             ON CASE WHEN mode = 'exact' THEN token = term ELSE starts_with(token, term) END)"""

BM25_SQL = """ln(1 + (n_docs - df + 0.5) / (df + 0.5)) * tf * 2.2
  / (tf + 1.2 * (0.25 + 0.75 * n_tokens / avg_tokens))"""


def matches_sql(filters: str = "true", keep: str = "") -> str:
    return f"""
matches AS (SELECT r.query_id, p.id{keep}, round(sum({BM25_SQL}), 6) AS score
            FROM resolved r JOIN postings p USING (token) CROSS JOIN corpus JOIN q_filters f ON f.query_id = r.query_id
            WHERE {filters} GROUP BY r.query_id, p.id{keep}, r.n_terms HAVING count(DISTINCT ord) = r.n_terms)"""


NO_FILTERS_SQL = "q_filters AS (SELECT query_id FROM queries)"
LEXICAL_SQL = f"""{DOCUMENTS_SQL}, {QUERIES_SQL}, {NO_FILTERS_SQL}, {plan_sql('queries')}, {postings_sql()}, {TERMS_SQL}, {matches_sql()}"""
PHRASES_SQL = """
starts AS (SELECT query_id, id, n_terms, ord, unnest(positions) - ord AS start FROM resolved JOIN postings USING (token) WHERE n_terms > 1),
phrases AS (SELECT DISTINCT query_id, id FROM starts GROUP BY query_id, id, start, n_terms HAVING count(DISTINCT ord) = n_terms)"""


@register(
    "f1_build_postings",
    f"WITH {DOCUMENTS_SQL}, {postings_sql()} SELECT id, token, prefix3, tf, md5(array_to_string(positions, ',')) AS positions_md5, n_tokens FROM postings",
)
def postings(t: Tables):
    built = lexical.build_postings(t.documents())
    listed = F.array_join(F.transform("positions", lambda at: at.cast("string")), ",")
    return built.select("id", "token", "prefix3", "tf", F.md5(listed.cast("binary")).alias("positions_md5"), "n_tokens")


def _planned(t: Tables, mode: str = "default", positions: bool = False):
    """Index, plan and terms of the benchmark sentences."""
    corpus = search.index_corpus(t.documents(), positions)
    return (corpus.postings, *search.plan_terms(corpus, t.queries(), mode))


@register("f2_match_all", f"WITH {LEXICAL_SQL} SELECT query_id, id FROM matches")
def match_all(t: Tables):
    return lexical.match_terms(*_planned(t)).select("query_id", "id")


@register("f3_match_phrase", f"WITH {LEXICAL_SQL}, {PHRASES_SQL} SELECT query_id, id FROM phrases")
def match_phrase(t: Tables):
    planned = _planned(t, positions=True)
    return lexical.match_phrase(*planned, lexical.match_terms(*planned))


@register(
    "f4_match_prefix",
    f"""WITH {DOCUMENTS_SQL}, {QUERIES_SQL}, {NO_FILTERS_SQL}, {plan_sql('queries', 'prefix_all')}, {postings_sql()}, {TERMS_SQL}, {matches_sql()}
    SELECT query_id, id FROM matches""",
)
def match_prefix(t: Tables):
    return lexical.match_terms(*_planned(t, "prefix_all")).select("query_id", "id")


@register(
    "f4_resolve_terms",
    f"""WITH {DOCUMENTS_SQL}, {QUERIES_SQL}, {plan_sql('queries')}, {postings_sql()}, {TERMS_SQL}
    SELECT DISTINCT term, mode, token, df FROM plan JOIN dictionary
    ON CASE WHEN mode = 'exact' THEN token = term ELSE starts_with(token, term) END""",
)
def resolve(t: Tables):
    return _planned(t)[2].drop("term_id")


@register(
    "f5_match_phrase_or_all",
    f"""WITH {LEXICAL_SQL}, {PHRASES_SQL} SELECT m.query_id, m.id, p.id IS NOT NULL AS phrase_hit
    FROM matches m LEFT JOIN phrases p USING (query_id, id)""",
)
def phrase_or_all(t: Tables):
    planned = _planned(t, positions=True)
    matched = lexical.match_terms(*planned).select("query_id", "id")
    return lexical.with_phrase_flag(matched, lexical.match_phrase(*planned, matched))


@register("f6_lexical_rank", f"WITH {LEXICAL_SQL} SELECT query_id, id, score FROM matches")
def lexical_rank(t: Tables):
    corpus = search.index_corpus(t.documents())
    return search.lexical_matches(corpus, t.queries())


FILTERED_QUERIES_SQL = """
q_filters AS (SELECT query_id, CASE item_id % 3 WHEN 1 THEN 'en' WHEN 2 THEN 'fr' END AS filter_law_type FROM queries)"""
FILTER_FITS_SQL = "(f.filter_law_type IS NULL OR f.filter_law_type = p.law_type)"
KEEP_TYPE = ", law_type"


def filtered(queries):
    kind = F.when(F.col("item_id") % 3 == 1, "en").when(F.col("item_id") % 3 == 2, "fr")
    return queries.withColumn("filter_law_type", kind)


@register(
    "f7_metadata_filter",
    f"""WITH {DOCUMENTS_SQL}, {QUERIES_SQL}, {FILTERED_QUERIES_SQL}, {plan_sql('queries')}, {postings_sql(keep=KEEP_TYPE)}, {TERMS_SQL},
    {matches_sql(FILTER_FITS_SQL)} SELECT query_id, id, score FROM matches""",
)
def metadata_filter(t: Tables):
    corpus = search.index_corpus(t.documents())
    return search.lexical_matches(corpus, filtered(t.queries()))


@register(
    "f8_lexical_top",
    f"""WITH {LEXICAL_SQL}, {PHRASES_SQL}, r AS (SELECT m.*, row_number() OVER (PARTITION BY query_id
      ORDER BY (p.id IS NOT NULL) DESC, score DESC, id) AS rank FROM matches m LEFT JOIN phrases p USING (query_id, id))
    SELECT query_id, id, score, rank FROM r WHERE rank <= 20""",
)
def lexical_top(t: Tables):
    corpus = search.index_corpus(t.documents(), positions=True)
    top, _ = search.ranked_branches(corpus, t.queries(), 10, phrase_first=True)
    return top


CHUNKS_SQL = f"""{walk_sql(1000, 200, True)},
chunk_rows AS (SELECT w.id * 1000000 + chunk_index AS id, w.id AS document_id, chunk_index,
  substr(d.content, start + 1, stop - start) AS content, d.law_type FROM walk w JOIN docs d USING (id))"""


@register(
    "f9_match_count",
    f"""WITH RECURSIVE {DOCUMENTS_SQL}, {QUERIES_SQL}, {FILTERED_QUERIES_SQL}, {plan_sql('queries')}, {CHUNKS_SQL},
    {postings_sql('chunk_rows', keep=', document_id, law_type')}, {TERMS_SQL}, {matches_sql(FILTER_FITS_SQL, ', p.document_id')}
    SELECT query_id, count(DISTINCT document_id) AS total FROM matches GROUP BY 1""",
)
def match_count(t: Tables):
    corpus = search.index_corpus(chunking.chunk_documents(t.documents(), 1000))
    matched = search.lexical_matches(corpus, filtered(t.queries()), keep=["document_id"], scored=False)
    return lexical.match_count(matched)


def snippet_sql() -> str:
    return """
found AS (SELECT r.query_id, r.id, r.rank, d.content, t.tokens FROM ranked r JOIN docs d USING (id) JOIN (
    SELECT query_id, list(term) AS tokens FROM plan GROUP BY 1) t USING (query_id)),
windows AS (SELECT query_id, id, rank, content, tokens, unnest(range(0, CAST(least(greatest(length(content), 1), 10000) AS BIGINT), 100)) AS start FROM found),
scored AS (SELECT *, len(list_filter(tokens, lambda x: contains(substr(lower(content), start + 1, 150), x))) AS hits FROM windows),
best AS (SELECT query_id, id, rank, content, CASE WHEN hits > 0 THEN start ELSE 0 END AS start FROM scored
  QUALIFY row_number() OVER (PARTITION BY query_id, id ORDER BY hits DESC, start) = 1)"""


@register(
    "f10_document_search",
    f"""WITH {LEXICAL_SQL}, ranked AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank
      FROM matches QUALIFY rank <= 10), {snippet_sql()}
    SELECT query_id, id, rank, {sql_trim("CASE WHEN start > 0 THEN '…' ELSE '' END || substr(content, start + 1, 150) || CASE WHEN start + 150 < length(content) THEN '…' ELSE '' END")} AS snippet FROM best""",
)
def document_search(t: Tables):
    corpus = search.index_corpus(t.documents())
    return search.document_search(corpus, t.queries()).select("query_id", "id", "rank", "snippet")


@register(
    "f11_empty_plan_policy",
    """WITH short AS (SELECT item_id AS query_id FROM benchmark UNION ALL SELECT 100000 + item_id FROM benchmark WHERE length(text) > 200)
    SELECT query_id, doc_id AS id, CAST(0 AS DOUBLE) AS score, rank FROM (SELECT query_id FROM short WHERE query_id >= 100000),
      (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS rank FROM documents QUALIFY rank <= 20)""",
)
def empty_plan(t: Tables):
    benchmark = t.read("benchmark")
    worded = benchmark.select(F.col("item_id").alias("query_id"), "text")
    empty = benchmark.where(F.length("text") > 200).select(
        (F.col("item_id") + 100000).alias("query_id"), F.regexp_replace("text", r"[\p{L}\p{N}]", "").alias("text")
    )
    queries = worded.unionByName(empty)
    plan = query.build_match_plan(queries)
    return lexical.empty_plan_matches(queries, plan, t.documents(), 20, "all")


# Common words of the given texts, dropped from the index or from the questions.
STOP_WORDS = ["the", "and", "that", "les", "des", "die", "der", "los"]


def stems_sql(name: str, source: str) -> str:
    """``name(word, stem)`` of the words of ``source``, by the published rules step by step."""

    def longest(word: str, endings: list[str]) -> str:
        listed = ", ".join(f"'{ending}'" for ending in sorted(endings, key=len, reverse=True))
        return f"coalesce(list_filter([{listed}], lambda x: length({word}) - length(x) >= p AND ends_with({word}, x))[1], '')"

    return f"""
{name}_region AS (SELECT word, CASE WHEN m = '' THEN length(word) ELSE greatest(3, length(m)) END AS p
  FROM (SELECT word, regexp_extract(word, '^[^{stemming.VOWELS}]*[{stemming.VOWELS}]+[^{stemming.VOWELS}]') AS m FROM {source})),
{name}_ending AS (SELECT word, p, {longest("word", [*stemming.DROPPED, "s", *stemming.SHORTENED])} AS e FROM {name}_region),
{name}_first AS (SELECT word, p, CASE
    WHEN e = 's' THEN CASE WHEN regexp_matches(word, '[{stemming.S_LETTERS}]s$') OR regexp_matches(word, '[^{stemming.VOWELS}]ks$')
                      THEN left(word, length(word) - 1) ELSE word END
    WHEN e IN ('erte', 'ert') THEN left(word, length(word) - length(e)) || 'er'
    ELSE left(word, length(word) - length(e)) END AS w FROM {name}_ending),
{name}_second AS (SELECT word, p, left(w, length(w) - length({longest("w", ["dt", "vt"])}) // 2) AS w FROM {name}_first),
{name} AS (SELECT word, left(w, length(w) - length({longest("w", stemming.LAST)})) AS stem FROM {name}_second)"""


STEMMED_PLAN_SQL = f"""{ordered_terms_sql('queries', WORDS_SQL, 'asked_words')},
asked_listed AS (SELECT DISTINCT term AS word FROM asked_words WHERE term NOT IN ('{"', '".join(STOP_WORDS)}')), {stems_sql("asked_stems", "asked_listed")},
plan AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY min(ord)) - 1 AS INT) AS ord, stem AS term,
         CAST(count(*) OVER (PARTITION BY query_id) AS INT) AS n_terms
         FROM asked_words JOIN asked_stems ON word = term GROUP BY query_id, stem)"""


@register(
    "f12_stems",
    f"""WITH {DOCUMENTS_SQL}, {postings_sql()}, listed AS (SELECT DISTINCT token AS word FROM postings), {stems_sql("stems", "listed")}
    SELECT stem, count(*) AS n_words, min(word) AS first_word, max(word) AS last_word FROM stems GROUP BY stem""",
)
def stems(t: Tables):
    dictionary = lexical.term_stats(lexical.build_postings(t.documents(), positions=False))
    return dictionary.groupBy(stemming.norwegian_stem("token").alias("stem")).agg(
        F.count("*").alias("n_words"), F.min("token").alias("first_word"), F.max("token").alias("last_word")
    )


@register(
    "f12_stemmed_match",
    f"""WITH {DOCUMENTS_SQL}, {QUERIES_SQL}, {NO_FILTERS_SQL}, {postings_sql()},
    {STEMMED_PLAN_SQL},
    dictionary AS (SELECT token, count(*) AS df FROM postings GROUP BY token),
    listed AS (SELECT token AS word FROM dictionary), {stems_sql("stems", "listed")},
    resolved AS (SELECT query_id, ord, n_terms, token, df FROM plan JOIN stems ON stems.stem = plan.term JOIN dictionary ON token = word),
    {matches_sql()} SELECT query_id, id, score FROM matches""",
)
def stemmed_match(t: Tables):
    corpus = search.index_corpus(t.documents())
    return search.lexical_matches(corpus, t.queries(), "stemmed", stop_words=STOP_WORDS)


@register(
    "f12_stop_words",
    f"""WITH {DOCUMENTS_SQL}, {postings_sql()} SELECT token, count(*) AS df FROM postings
    WHERE token NOT IN ('{"', '".join(STOP_WORDS)}') GROUP BY token""",
)
def stop_words(t: Tables):
    built = lexical.build_postings(t.documents(), stop_words=STOP_WORDS, positions=False)
    return lexical.term_stats(built).select("token", "df")


# --- G: vector retrieval and fusion ----------------------------------------

VECTORS_SQL = """
vq AS (SELECT q.query_id, CAST(e.embedding AS DOUBLE[]) AS vector FROM queries q JOIN embeddings e ON e.vec_id = q.item_id)"""


def nearest_sql(k: int, rows: str, filters: str = "true") -> str:
    """Exact nearest rows; ``rows`` has (id, embedding) and the filter columns."""
    return f"""
scored_pairs AS (SELECT v.query_id, p.id, round(list_cosine_similarity(v.vector, CAST(p.embedding AS DOUBLE[])), 8) AS similarity
            FROM vq v CROSS JOIN {rows} p JOIN q_filters f ON f.query_id = v.query_id WHERE {filters}),
nearest AS (SELECT query_id, id, similarity, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, id) AS rank
            FROM scored_pairs QUALIFY rank <= {k})"""


EMBEDDED_SQL = "embedded AS (SELECT d.*, e.embedding FROM docs d JOIN embeddings e ON e.vec_id = d.id)"


@register(
    "g1_cosine_similarity",
    """SELECT a.vec_id, round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6) AS similarity
    FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""",
)
def cosine(t: Tables):
    left = t.read("embeddings").select("vec_id", "embedding")
    right = left.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return left.join(right, "vec_id").select(
        "vec_id", F.round(vector.cosine_similarity("embedding", "other"), 6).alias("similarity")
    )


@register(
    "g2_vector_top",
    f"""WITH {DOCUMENTS_SQL}, {QUERIES_SQL}, {FILTERED_QUERIES_SQL}, {VECTORS_SQL}, {EMBEDDED_SQL}, {nearest_sql(20, 'embedded', FILTER_FITS_SQL)}
    SELECT query_id, id, similarity, rank FROM nearest""",
)
def vector_top(t: Tables):
    return vector.vector_top(t.embedded_documents(), filtered(t.vector_queries()), 20)


@register(
    "g2_vector_top_blocks",
    f"""WITH {DOCUMENTS_SQL}, {QUERIES_SQL}, {FILTERED_QUERIES_SQL}, {VECTORS_SQL}, {EMBEDDED_SQL}, {nearest_sql(20, 'embedded', FILTER_FITS_SQL)}
    SELECT query_id, id, similarity, rank FROM nearest""",
)
def vector_top_blocks(t: Tables):
    """The block join that takes over when there are too many queries to send around."""
    rows, asked, filters = vector._inputs(t.embedded_documents(), filtered(t.vector_queries()))
    return vector._block_top(rows, asked, 20, filters, row_block=100, query_block=50)


@register("g3_vector_top_approx")
def vector_approx(t: Tables):
    return vector.vector_top_approx(t.embedded_documents(), t.vector_queries(), 20, dimension=64)


@register(
    "g4_rank_positions",
    f"""WITH {LEXICAL_SQL} SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC NULLS LAST, id) AS rank
    FROM (SELECT query_id, id, CASE WHEN id % 5 > 0 THEN score END AS score FROM matches QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) <= 50)""",
)
def rank_positions(t: Tables):
    corpus = search.index_corpus(t.documents())
    top = lexical.lexical_top(search.lexical_matches(corpus, t.queries()), 50)
    partly = top.select("query_id", "id", F.when(F.col("id") % 5 > 0, F.col("score")).alias("score"))
    return fusion.rank_positions(partly, "score")


def fuse_sql(k: int, limit: int, offset: int, lexical_rows: str = "matches", vector_rows: str = "nearest") -> str:
    return f"""
lexical AS (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank
            FROM {lexical_rows} QUALIFY rank <= {2 * limit}),
fused AS (SELECT coalesce(l.query_id, v.query_id) AS query_id, coalesce(l.id, v.id) AS id, l.score AS lexical_score, v.similarity,
          coalesce(CAST(1 AS DOUBLE) / ({k} + l.rank), 0) + coalesce(CAST(1 AS DOUBLE) / ({k} + v.rank), 0) AS rrf_score
          FROM lexical l FULL OUTER JOIN {vector_rows} v ON l.query_id = v.query_id AND l.id = v.id),
page AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(rrf_score, 12) DESC, lexical_score DESC NULLS LAST,
         similarity DESC NULLS LAST, id) AS rank FROM fused QUALIFY rank > {offset} AND rank <= {offset + limit})"""


PAGE_COLUMNS = "query_id, id, lexical_score, similarity, round(rrf_score, 9) AS rrf_score, rank"
DOCUMENT_HYBRID_SQL = f"""{LEXICAL_SQL}, {VECTORS_SQL}, {EMBEDDED_SQL}, {nearest_sql(20, 'embedded')}"""


def rounded(hits):
    return hits.select(
        "query_id", "id", "lexical_score", "similarity", F.round("rrf_score", 9).alias("rrf_score"), "rank"
    )


@register(
    "g5_rrf_fuse",
    f"WITH {DOCUMENT_HYBRID_SQL}, {fuse_sql(40, 10, 0)} SELECT query_id, id, lexical_score, similarity, round(rrf_score, 9) AS rrf_score FROM fused",
)
def rrf(t: Tables):
    corpus = search.index_corpus(t.embedded_documents())
    top, nearest = search.ranked_branches(corpus, t.vector_queries(), 10)
    fused = fusion.rrf_fuse({"lexical_score": (top, "score"), "similarity": (nearest, "similarity")}, 40)
    return fused.withColumn("rrf_score", F.round("rrf_score", 9))


@register(
    "g6_fused_page",
    f"WITH {DOCUMENT_HYBRID_SQL}, {fuse_sql(60, 10, 5)} SELECT {PAGE_COLUMNS} FROM page",
)
def fused_page(t: Tables):
    corpus = search.index_corpus(t.embedded_documents())
    return rounded(search.fused_hits(corpus, t.vector_queries(), 10, offset=5))


CHUNK_HYBRID_SQL = f"""{DOCUMENTS_SQL}, {QUERIES_SQL}, {FILTERED_QUERIES_SQL}, {plan_sql('queries')}, {CHUNKS_SQL},
    {postings_sql('chunk_rows', keep=', document_id, law_type')}, {TERMS_SQL}, {matches_sql(FILTER_FITS_SQL)}, {VECTORS_SQL},
    embedded AS (SELECT c.*, e.embedding FROM chunk_rows c JOIN embeddings e ON e.vec_id = c.document_id AND c.chunk_index = 0),
    {nearest_sql(20, 'embedded', FILTER_FITS_SQL)}, {fuse_sql(60, 10, 0)}"""


def embedded_chunks(t: Tables):
    """Chunks of the documents, and the vectors of those that have one: the first of each carries that of its document.

    A chunk stands there once for each of its vectors.  Vectors that repeat an id are counted apart, so that texts stay where they are.
    """
    keys = ["document_id", "chunk_index"]
    vectors = t.read("embeddings").select(
        F.col("vec_id").alias("document_id"), F.lit(0).alias("chunk_index"), "embedding"
    )
    chunks = chunking.chunk_documents(t.documents(), 1000)
    several = materialize(vectors.groupBy(*keys).agg(F.count("*").alias("copies")).where("copies > 1"), "several")
    rows = chunks.join(small_side(several), keys, "left").withColumn(
        "copy", F.explode(F.sequence(F.lit(1).cast("long"), F.coalesce("copies", F.lit(1).cast("long"))))
    )
    names = ["id", *[name for name in lexical.FILTERS if name in chunks.columns]]
    return rows.drop("copies", "copy"), chunks.select(*names, *keys).join(vectors, keys).select(*names, "embedding")


@register(
    "g7_hybrid_search_chunks",
    f"""WITH RECURSIVE {CHUNK_HYBRID_SQL} SELECT p.query_id, p.id, lexical_score, similarity, round(rrf_score, 9) AS rrf_score, rank,
    c.document_id, c.chunk_index, c.law_type, md5(c.content) AS content_md5 FROM page p JOIN chunk_rows c ON c.id = p.id""",
)
def hybrid_chunks(t: Tables):
    rows, vectors = embedded_chunks(t)
    corpus = search.index_corpus(rows, vectors=vectors)
    hits = search.hybrid_search(corpus, filtered(t.vector_queries()), 10)
    return hits.select(
        "query_id", "id", "lexical_score", "similarity", F.round("rrf_score", 9).alias("rrf_score"), "rank",
        "document_id", "chunk_index", "law_type", F.md5(F.col("content").cast("binary")).alias("content_md5"),
    )


@register(
    "g8_hybrid_search_documents",
    f"""WITH {DOCUMENT_HYBRID_SQL}, {fuse_sql(60, 10, 0)} SELECT p.query_id, p.id, lexical_score, similarity, round(rrf_score, 9) AS rrf_score, rank,
    d.archive_filename, d.member FROM page p JOIN docs d ON d.id = p.id""",
)
def hybrid_documents(t: Tables):
    corpus = search.index_corpus(t.embedded_documents())
    hits = search.hybrid_search(corpus, t.vector_queries(), 10)
    return hits.select(
        "query_id", "id", "lexical_score", "similarity", F.round("rrf_score", 9).alias("rrf_score"), "rank",
        "archive_filename", "member",
    )


@register(
    "g9_lexical_fallback",
    f"""WITH {LEXICAL_SQL}, vq AS (SELECT q.query_id, CAST(e.embedding AS DOUBLE[]) AS vector FROM queries q JOIN embeddings e ON e.vec_id = q.item_id WHERE q.item_id % 2 = 0),
    {EMBEDDED_SQL}, {nearest_sql(20, 'embedded')}, {fuse_sql(40, 10, 0)} SELECT {PAGE_COLUMNS} FROM page""",
)
def fallback(t: Tables):
    corpus = search.index_corpus(t.embedded_documents())
    half = t.vector_queries().withColumn("vector", F.when(F.col("item_id") % 2 == 0, F.col("vector")))
    top, nearest = search.ranked_branches(corpus, half, 10)
    fused = fusion.lexical_fallback(top, nearest, half, 40)
    return rounded(fusion.fused_page(fused, ["lexical_score", "similarity"], 10))


TYPES = ["de", "fr", "es", "en"]
TYPED_QUERIES_SQL = """
queries AS (SELECT query_id || chr(9) || lt AS query_id, item_id, text, lt FROM plain_queries CROSS JOIN (VALUES ('de'), ('fr'), ('es'), ('en')) v(lt)),
q_filters AS (SELECT query_id, lt AS filter_law_type FROM queries)"""
PRIORITY_SQL = f"""{DOCUMENTS_SQL}, plain_{QUERIES_SQL.strip()}, {TYPED_QUERIES_SQL}, {plan_sql('queries')}, {postings_sql(keep=KEEP_TYPE)}, {TERMS_SQL},
    {matches_sql(FILTER_FITS_SQL)}, {VECTORS_SQL}, {EMBEDDED_SQL}, {nearest_sql(20, 'embedded', FILTER_FITS_SQL)}, {fuse_sql(60, 10, 0)},
    typed AS (SELECT CAST(split_part(query_id, chr(9), 1) AS BIGINT) AS query_id, split_part(query_id, chr(9), 2) AS law_type, id, rank FROM page),
    counts AS (SELECT q.query_id, q.text, count(*) FILTER (law_type = 'de') AS l, count(*) FILTER (law_type = 'fr') AS f,
      count(*) FILTER (law_type = 'es') AS a, count(*) FILTER (law_type = 'en') AS b
      FROM plain_queries q LEFT JOIN typed t ON t.query_id = q.query_id GROUP BY 1, 2),
    asks AS (SELECT *, regexp_matches(text, '(?i)\\bfr\\b') AS wants_f, regexp_matches(text, '(?i)\\bde\\b') AND NOT regexp_matches(text, '(?i)\\bfr\\b') AS wants_l FROM counts),
    firsts AS (SELECT *, CASE WHEN wants_f AND f > 0 THEN 'fr' WHEN l > 0 THEN 'de' WHEN f > 0 THEN 'fr' END AS pick,
      CASE WHEN wants_f AND f > 0 THEN f >= 5 WHEN wants_l AND l > 0 THEN l >= 5 ELSE l > 0 OR f > 0 END AS settled FROM asks),
    picked AS (SELECT query_id, CASE WHEN settled THEN pick WHEN a >= 5 THEN 'es' WHEN b >= 5 THEN 'en' WHEN pick IS NOT NULL THEN pick
      WHEN b > 2 * a THEN 'en' WHEN a > 0 THEN 'es' END AS picked FROM firsts)"""


@register(
    "h8_prioritized_search",
    f"""WITH {PRIORITY_SQL} SELECT t.query_id, t.law_type, t.id, t.rank FROM typed t JOIN picked p ON p.query_id = t.query_id AND p.picked = t.law_type""",
)
def prioritized(t: Tables):
    corpus = search.index_corpus(t.embedded_documents())
    hits = search.search_by_priority(corpus, t.vector_queries(), 10, TYPES)
    return hits.select("query_id", "law_type", "id", "rank")
