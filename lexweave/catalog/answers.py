"""Queries on ranking and shaping of hits (H) and on evidence and answers (I)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fixed_values as fixed
from ..functions import links, rules, text
from ..operators import evidence as ev
from ..operators import ranking, vector
from ..plans import assistant, search
from .base import DOCUMENTS_SQL, PHRASES, QUERIES_SQL, RWS, Tables, register, sql_list, sql_trim
from .searching import EMBEDDED_SQL, LEXICAL_SQL, NO_FILTERS_SQL, VECTORS_SQL, fuse_sql, nearest_sql

BASE_URL = "https://viewer.example"

# Titles given to the documents by source, so that every tier occurs.
TITLES = [
    "Lov 4. juli 1991 nr. 47 om ekteskap (ekteskapsloven)",
    "Lov om endring i ekteskapsloven",
    "Forskrift om skatt",
    "",
    "LOV 1991 nr 47 om ekteskap",
    "Lov 8. april 1981 nr. 7 om barn og ekteskap",
    "Lov  4 juli  1991 nr 47  om Ekteskap",
    "Ikraftsetting av lov 4. juli 1991 nr. 47 om ekteskap",
    "Delegering av myndighet",
    "OVERFØRING av ansvar",
    "Opphevelse",
    "Lov 3. mårs 1990 nr. 2 om ekteskap",
    "Vedtak",
    "Instruks for arkivet",
    "Om forskrift",
    "Lov 17. juni 2005 nr. 62 om arbeidsmiljø",
    "Ikrafttredelse",
    "Rundskriv",
    "Lov 4. juli 1991 nr. 47 om ekteskapsrett, endring",
    "Reglement",
]
TITLE_SQL = f"nullif(({sql_list(TITLES)})[CAST(substr(archive_filename, 4) AS INT) % 20 + 1], '')"
SNIPPET_SQL = "CASE WHEN length(content) > 300 THEN left(content, 297) || '...' ELSE content END"
HITS_SQL = f"""{DOCUMENTS_SQL}, {QUERIES_SQL}, {NO_FILTERS_SQL}, {VECTORS_SQL}, {EMBEDDED_SQL}, {nearest_sql(20, 'embedded')},
hits AS (SELECT n.query_id, n.id, n.rank, ({sql_list(PHRASES)})[q.item_id % {len(PHRASES)} + 1] || ' ' || q.text AS query,
         archive_filename AS filename, member, {TITLE_SQL} AS title, content, {SNIPPET_SQL} AS snippet, law_type
         FROM nearest n JOIN queries q USING (query_id) JOIN docs d ON d.id = n.id)"""


def title_of(source: str):
    titles = F.array(*[F.lit(title) for title in TITLES])
    return text.null_if_empty(F.get(titles, F.substring(source, 4, 10).cast("int") % 20))


def hits(t: Tables):
    """Nearest documents of each sentence with titles that depend on the source."""
    queries = t.vector_queries()
    nearest = vector.vector_top(t.embedded_documents(), queries, 20)
    phrases = F.array(*[F.lit(phrase) for phrase in PHRASES])
    asked = queries.select(
        "query_id", F.concat(F.get(phrases, (F.col("item_id") % len(PHRASES)).cast("int")), F.lit(" "), "text").alias("query")
    )
    found = nearest.join(asked, "query_id").join(t.documents().drop("title"), "id")
    return found.select(
        "query_id", "id", "rank", "query", F.col("archive_filename").alias("filename"), "member",
        title_of("archive_filename").alias("title"), "content", text.chunk_snippet("content").alias("snippet"), "law_type",
    )


# --- H ----------------------------------------------------------------------


@register(
    "h1_drop_empty_content",
    f"WITH {HITS_SQL}, h AS (SELECT query_id, id, CASE WHEN filename = 'src4' THEN chr(9) || chr(160) WHEN filename <> 'src7' THEN content END AS content FROM hits) "
    f"SELECT query_id, id FROM h WHERE {sql_trim('content')} <> ''",
)
def drop_empty(t: Tables):
    content = F.when(F.col("filename") == "src4", "\t\u00a0").when(F.col("filename") != "src7", F.col("content"))
    return ranking.drop_empty_content(hits(t).withColumn("content", content)).select("query_id", "id")


AMENDMENT_RE = "|".join(fixed.AMENDMENT_WORDS)


def amendment_sql(title: str) -> str:
    return f"coalesce(regexp_matches(lower({title}), '{AMENDMENT_RE}') OR starts_with(lower({title}), 'forskrift'), false)"


def exact_sql(title: str, query: str) -> str:
    space = RWS
    named = (
        rf"regexp_matches(lower({title}), '^lov{space}+4\.?{space}+juli{space}+1991{space}+nr\.?{space}+47{space}+om{space}+ekteskap"
        rf"|lov{space}+1991{space}+nr\.?{space}+47{space}+om{space}+ekteskap')"
    )
    numbered = rf"regexp_matches(lower({title}), '^lov{space}+\d+\.?{space}+\w+{space}+\d+{space}+nr\.?{space}+\d+{space}+om{space}+')"
    asks = f"(contains(lower({query}), 'ekteskapsloven') OR contains(lower({query}), 'ekteskapslova'))"
    stem = f"contains(lower({query}), 'ekteskap') AND contains(lower({title}), 'ekteskap')"
    return f"coalesce((({asks} AND {named}) OR ({numbered} AND {stem})) AND NOT {amendment_sql(title)}, false)"


@register("h2_is_amendment", f"WITH {DOCUMENTS_SQL} SELECT id, {amendment_sql(TITLE_SQL)} AS is_amendment FROM docs")
def amendment(t: Tables):
    return t.documents().select("id", rules.is_amendment(title_of("archive_filename")).alias("is_amendment"))


@register("h3_is_exact_base_law", f"WITH {HITS_SQL} SELECT query_id, id, {exact_sql('title', 'query')} AS is_base_law FROM hits")
def base_law(t: Tables):
    return hits(t).select("query_id", "id", rules.is_exact_base_law("title", "query").alias("is_base_law"))


TIER_SQL = f"CASE WHEN {amendment_sql('title')} THEN 2 WHEN {exact_sql('title', 'query')} THEN 0 ELSE 1 END"
BOOSTED_SQL = f"{HITS_SQL}, boosted AS (SELECT * REPLACE (row_number() OVER (PARTITION BY query_id ORDER BY {TIER_SQL}, rank) AS rank) FROM hits)"


@register("h4_tier_boost", f"WITH {BOOSTED_SQL} SELECT query_id, id, rank FROM boosted")
def boost(t: Tables):
    return ranking.tier_boost(hits(t)).select("query_id", "id", "rank")


def rerank_sql(source: str, name: str, keep: int) -> str:
    words = r"list_distinct(regexp_extract_all(lower(query), '[\p{L}\p{N}]{3,}'))"
    return rf"""
{name}_scored AS (SELECT *, rank - 1 AS index, CAST(len(list_intersect({words}, regexp_extract_all(lower({sql_trim("coalesce(title, '') || ' ' || snippet")}), '[\p{{L}}\p{{N}}]+'))) AS DOUBLE)
  / nullif(len({words}), 0) AS relevance FROM {source} WHERE {sql_trim("coalesce(title, '') || ' ' || snippet")} <> ''),
{name} AS (SELECT * REPLACE (row_number() OVER (PARTITION BY query_id ORDER BY coalesce(relevance, 0) DESC, index) AS rank) FROM {name}_scored
  QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY coalesce(relevance, 0) DESC, index) <= {keep})"""


@register("h5_rerank", f"WITH {HITS_SQL}, {rerank_sql('hits', 'reranked', 10)} SELECT query_id, id, index, round(coalesce(relevance, 0), 6) AS relevance, rank FROM reranked")
def rerank(t: Tables):
    ranked = ranking.rerank(hits(t), size=5, candidates=ranking.SERVICE_LIMIT, extra=ranking.SERVICE_EXTRA)
    return ranked.select("query_id", "id", "index", F.round("relevance", 6).alias("relevance"), "rank")


@register(
    "h6_rerank_then_boost_page",
    f"""WITH {BOOSTED_SQL}, {rerank_sql('boosted', 'reranked', 13)}, again AS (
      SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY {TIER_SQL}, rank) AS rank FROM reranked)
    SELECT query_id, id, rank FROM again WHERE rank > 4 AND rank <= 8""",
)
def rerank_page(t: Tables):
    return ranking.rerank_then_boost_page(hits(t), size=4, offset=4).select("query_id", "id", "rank")


@register("h7_page_hits", f"WITH {BOOSTED_SQL} SELECT query_id, id, rank FROM boosted WHERE rank > 5 AND rank <= 10")
def page(t: Tables):
    return ranking.page_hits(ranking.tier_boost(hits(t)), 5, 5).select("query_id", "id", "rank")


@register("h9_chunk_snippet", f"SELECT doc_id, {SNIPPET_SQL.replace('content', 'text')} AS snippet FROM documents")
def chunk_snippet(t: Tables):
    return t.read("documents").select("doc_id", text.chunk_snippet("text").alias("snippet"))


@register(
    "h10_best_window_snippet",
    rf"""WITH {HITS_SQL}, f AS (SELECT query_id, id, content, lower(content) AS low, list_distinct(regexp_extract_all(lower(query), '[\p{{L}}\p{{N}}]{{3,}}')) AS tokens FROM hits),
    w AS (SELECT query_id, id, content, low, tokens, unnest(range(0, CAST(greatest(length(content), 1) AS BIGINT), 100)) AS start FROM f),
    s AS (SELECT *, len(list_filter(tokens, lambda x: contains(substr(low, start + 1, 150), x))) AS score FROM w),
    b AS (SELECT query_id, id, content, CASE WHEN score > 0 THEN start ELSE 0 END AS start FROM s QUALIFY row_number() OVER (PARTITION BY query_id, id ORDER BY score DESC, start) = 1)
    SELECT query_id, id, {sql_trim("CASE WHEN start > 0 THEN '…' ELSE '' END || substr(content, start + 1, 150) || CASE WHEN start + 150 < length(content) THEN '…' ELSE '' END")} AS snippet FROM b""",
)
def window_snippet(t: Tables):
    return hits(t).select("query_id", "id", text.best_window_snippet("content", text.query_words("query")).alias("snippet"))


@register(
    "h11_display_title",
    f"""WITH {DOCUMENTS_SQL}, s AS (SELECT id, {TITLE_SQL} AS t, CASE law_type WHEN 'en' THEN 'Section' WHEN 'fr' THEN '' END AS st,
      CASE WHEN law_type <> 'de' THEN CAST(id % 3 AS VARCHAR) || 'a' END AS n FROM docs),
    c AS (SELECT id, coalesce(nullif(t, ''), nullif(st, '')) AS shown, n FROM s)
    SELECT id, CASE WHEN n IS NULL THEN shown WHEN shown IS NULL THEN '§ ' || n ELSE shown || ' (' || n || ')' END AS title FROM c""",
)
def display_title(t: Tables):
    section = F.when(F.col("law_type") == "en", "Section").when(F.col("law_type") == "fr", "")
    number = F.when(F.col("law_type") != "de", F.concat((F.col("id") % 3).cast("string"), F.lit("a")))
    return t.documents().select("id", ranking.display_title(title_of("archive_filename"), section, number).alias("title"))


def encode_sql(value: str) -> str:
    return f"replace(replace(replace(url_encode({value}), '%20', '+'), '%2A', '*'), '~', '%7E')"


def viewer_sql(filename: str, member: str) -> str:
    html = rf"regexp_replace({member}, '(?i)\.xml$', '.html')"
    return (
        f"CASE WHEN nullif({filename}, '') IS NOT NULL AND nullif({member}, '') IS NOT NULL THEN "
        f"'{BASE_URL}/api/documents/xml?filename=' || {encode_sql(filename)} || '&member=' || {encode_sql(html)} END"
    )


@register(
    "h12_viewer_url",
    f"""SELECT page_id, {viewer_sql("CASE WHEN page_id % 9 > 0 THEN url ELSE '' END", "left(html, 40) || CASE page_id % 3 WHEN 0 THEN '.XML' WHEN 1 THEN ' å*~.xml' ELSE '.htm' END")} AS url FROM pages""",
)
def viewer_url(t: Tables):
    suffix = F.when(F.col("page_id") % 3 == 0, ".XML").when(F.col("page_id") % 3 == 1, " å*~.xml").otherwise(".htm")
    archive = F.when(F.col("page_id") % 9 > 0, F.col("url")).otherwise("")
    return t.read("pages").select("page_id", links.viewer_url(archive, F.concat(text.head("html", 40), suffix), BASE_URL).alias("url"))


@register(
    "h13_searched_files",
    f"""WITH {HITS_SQL}, f AS (SELECT query_id, filename, min(rank) AS first_at FROM hits WHERE rank <= 10 GROUP BY 1, 2)
    SELECT query_id, list(filename ORDER BY first_at) AS files FROM f GROUP BY 1""",
)
def files(t: Tables):
    return ranking.searched_files(ranking.page_hits(hits(t)))


def search_page_sql(size: int, pages: int, candidates: int) -> str:
    """The first pages of a search, each reranked on its own as a caller asks for it."""
    def one(number: int) -> str:
        offset, name = (number - 1) * size, f"page_{number}"
        return f"""{rerank_sql('boosted', f'{name}_ranked', offset + size + ranking.SERVICE_EXTRA)},
        {name}_again AS (SELECT {number} AS page, * REPLACE (row_number() OVER (PARTITION BY query_id ORDER BY {TIER_SQL}, rank) AS rank) FROM {name}_ranked),
        {name} AS (SELECT * FROM {name}_again WHERE rank > {offset} AND rank <= {offset + size})"""

    numbers = range(1, pages + 1)
    shown = " UNION ALL ".join(
        f"SELECT page, query_id, rank, id, filename, member, title, snippet, {viewer_sql('filename', 'member')} AS url FROM page_{number}" for number in numbers
    )
    return f"""WITH {LEXICAL_SQL}, {VECTORS_SQL}, {EMBEDDED_SQL}, {nearest_sql(2 * candidates, 'embedded')}, {fuse_sql(60, candidates, 0)},
    hits AS (SELECT p.query_id, p.id, p.rank, q.text AS query, archive_filename AS filename, member, {TITLE_SQL} AS title, {SNIPPET_SQL} AS snippet
             FROM page p JOIN queries q USING (query_id) JOIN docs d ON d.id = p.id WHERE {sql_trim('content')} <> ''),
    boosted AS (SELECT * REPLACE (row_number() OVER (PARTITION BY query_id ORDER BY {TIER_SQL}, rank) AS rank) FROM hits),
    {', '.join(map(one, numbers))} {shown}"""


@register("h_search_page", search_page_sql(10, 2, ranking.CANDIDATES))
def search_page(t: Tables):
    """Pages 1 and 2 of every sentence."""
    rows = t.embedded_documents().withColumn("document_title", title_of("archive_filename"))
    corpus, queries = search.index_corpus(rows), t.vector_queries()
    pages = [
        search.search_page(corpus, queries, 10, page, BASE_URL).select(F.lit(page).alias("page"), "*").drop("date") for page in (1, 2)
    ]
    return pages[0].unionByName(pages[1])


COUNTS_SQL = "counts AS (SELECT query_id, count(*) * 3 AS total FROM hits WHERE law_type = 'en' AND rank > 15 GROUP BY 1)"


@register(
    "h14_result_totals",
    f"""WITH {HITS_SQL}, {COUNTS_SQL}, h AS (SELECT query_id, count(*) AS n FROM hits WHERE law_type <> 'en' GROUP BY 1),
    s AS (SELECT query_id, CASE WHEN n IS NULL THEN 0 WHEN total > 0 THEN total ELSE n END AS total FROM queries LEFT JOIN h USING (query_id) LEFT JOIN counts USING (query_id))
    SELECT query_id, total, greatest(1, CAST(ceil(total / 4) AS BIGINT)) AS pages FROM s""",
)
def totals(t: Tables):
    found = hits(t)
    counts = found.where("law_type = 'en' and rank > 15").groupBy("query_id").agg((F.count("*") * 3).alias("total"))
    return ranking.result_totals(t.queries(), found.where("law_type <> 'en'"), counts, 4)


@register(
    "h15_merge_sources",
    f"""WITH {HITS_SQL}, m AS (SELECT query_id, id, 'first' AS source, 1 AS part, rank FROM hits WHERE rank <= 4
      UNION ALL SELECT query_id, id, 'second', 2, rank FROM (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY id) AS rank FROM hits WHERE law_type = 'en') WHERE rank <= 4)
    SELECT query_id, id, source, row_number() OVER (PARTITION BY query_id ORDER BY part, rank) AS rank FROM m""",
)
def merge(t: Tables):
    found = hits(t).select("query_id", "id", "rank", "law_type")
    by_id = F.row_number().over(ranking.Window.partitionBy("query_id").orderBy("id"))
    second = found.where("law_type = 'en'").withColumn("rank", by_id)
    return ranking.merge_sources({"first": found, "second": second}, 7).drop("law_type")


PATHS = [
    "/dokument/NL/lov/1991", "/register/lov/", "/lov/1999?x=1", "/lov/1999?q=a", "/lokaleForskrifter/a", "/dom/2", "/sak/", "/index/lov/",
    "", "/Lov/1", "/liste", "/rettsavgjorelse/7", "/sph2025/", "/search", "/forskrift/?kunngjortDato=1", "/resultater/dom/", "/eosavtalen/", "/husleietvistutvalget/1",
]
LINK_SQL = f"CASE WHEN page_id % 11 > 0 THEN split_part(url, '?', 1) || ({sql_list(PATHS)})[page_id % {len(PATHS)} + 1] END"
IS_DOCUMENT_SQL = "coalesce(NOT regexp_matches(link, '{}') AND regexp_matches(link, '{}'), false)".format(
    "|".join(fixed.NON_DOCUMENT_LINKS), "|".join(fixed.DOCUMENT_LINKS)
)
WEB_SQL = rf"""
web AS (SELECT page_id // 20 AS query_id, page_id % 20 + 1 AS rank, {LINK_SQL} AS link,
        CASE WHEN page_id % 7 > 0 THEN left(html, 30) END AS title, substr(html, 200, 200) AS snippet, CAST(NULL AS VARCHAR) AS date,
        CASE WHEN page_id % 2 = 0 THEN 'one.example' ELSE 'two.example' END AS source FROM pages)"""


def web(t: Tables):
    """Web results: twenty pages per query, with links of every kind."""
    paths = F.array(*[F.lit(path) for path in PATHS])
    link = F.concat(F.substring_index("url", "?", 1), F.get(paths, (F.col("page_id") % len(PATHS)).cast("int")))
    return t.read("pages").select(
        F.floor(F.col("page_id") / 20).alias("query_id"),
        (F.col("page_id") % 20 + 1).alias("rank"),
        F.when(F.col("page_id") % 11 > 0, link).alias("link"),
        F.when(F.col("page_id") % 7 > 0, text.head("html", 30)).alias("title"),
        F.substring("html", 200, 200).alias("snippet"),
        F.lit(None).cast("string").alias("date"),
        F.when(F.col("page_id") % 2 == 0, "one.example").otherwise("two.example").alias("source"),
    )


@register("h16_is_document_link", f"WITH {WEB_SQL} SELECT query_id, rank, {IS_DOCUMENT_SQL} AS is_document FROM web")
def document_link(t: Tables):
    return web(t).select("query_id", "rank", links.is_document_link("link").alias("is_document"))


@register(
    "h17_prioritize_document_links",
    f"""WITH {WEB_SQL}, r AS (SELECT query_id, link, rank AS old, row_number() OVER (PARTITION BY query_id ORDER BY NOT {IS_DOCUMENT_SQL}, rank) AS rank FROM web)
    SELECT query_id, link, rank FROM r WHERE rank <= 8""",
)
def document_links_first(t: Tables):
    return ranking.prioritize_document_links(web(t), 8).select("query_id", "link", "rank")


@register(
    "h18_project_web_results",
    f"WITH {WEB_SQL} SELECT query_id, rank, title, link, snippet, date, {IS_DOCUMENT_SQL} AS is_document, source FROM web",
)
def project_web(t: Tables):
    return ranking.project_web_results(web(t))


@register("h18_source_counts", f"WITH {WEB_SQL} SELECT query_id, source, count(*) AS n FROM web GROUP BY 1, 2")
def source_counts(t: Tables):
    return ranking.source_counts(web(t))


# --- I ----------------------------------------------------------------------

MEMBER_SQL = "CASE WHEN search_seq = 2 AND id % 2 = 1 THEN replace(member, '.xml', '.html') ELSE member END"
SEARCHES_SQL = f"""{HITS_SQL},
searches AS (SELECT query_id AS question_id, search_seq, rank, filename, {MEMBER_SQL} AS member,
             title, CAST(NULL AS VARCHAR) AS date, snippet, CASE WHEN id % 4 = 0 THEN 'https://x.example/' || id || ').' END AS url
             FROM hits CROSS JOIN (VALUES (1), (2)) v(search_seq) WHERE search_seq = 1 OR law_type = 'en')"""


def searches(t: Tables):
    """Two searches per question; the second finds the English documents again, some as .html."""
    found = hits(t).withColumn("search_seq", F.explode(F.array(F.lit(1), F.lit(2))))
    html = (F.col("search_seq") == 2) & (F.col("id") % 2 == 1)
    return found.where("search_seq = 1 or law_type = 'en'").select(
        F.col("query_id").alias("question_id"), "search_seq", "rank", "filename",
        F.when(html, F.replace("member", F.lit(".xml"), F.lit(".html"))).otherwise(F.col("member")).alias("member"),
        "title", F.lit(None).cast("string").alias("date"), "snippet",
        F.when(F.col("id") % 4 == 0, F.concat(F.lit("https://x.example/"), "id", F.lit(")."))).alias("url"),
    )


def sanitize_sql(link: str) -> str:
    ws = RWS + "*"
    s = sql_trim(link)
    s = f"""regexp_replace({s}, '\\){ws}\\.?{ws}"?{ws}$', '')"""
    s = f"""regexp_replace({s}, '"?{ws}\\){ws}\\.{ws}"?{ws}$', '')"""
    return s


def sanitize_ctes(source: str, key: str, link: str, name: str) -> str:
    """Steps of the link clean-up, with the bracket count in between."""
    ws = RWS + "*"
    opened, closed = "length(s) - length(replace(s, '(', ''))", "length(s) - length(replace(s, ')', ''))"
    tail = "CASE WHEN ends_with(s, ')') AND {c} > {o} THEN left(s, length(s) - 1) ELSE s END".format(c=f"({closed})", o=f"({opened})")
    tail = f"""regexp_replace({tail}, '{ws}\\.{ws}"?{ws}$', '')"""
    tail = f"""regexp_replace({tail}, '{ws}"{ws}$', '')"""
    tail = f"""nullif(regexp_replace({tail}, '(?:{RWS}|[.,;:!?])+$', ''), '')"""
    return f"{name}_start AS (SELECT *, {sanitize_sql(link)} AS s FROM {source}), {name} AS (SELECT * EXCLUDE (s), {tail} AS {key} FROM {name}_start)"


FIRST_EVIDENCE_SQL = f"""{SEARCHES_SQL},
numbered AS (SELECT *, row_number() OVER (PARTITION BY question_id, search_seq ORDER BY rank) AS n,
             coalesce(nullif(url, ''), {viewer_sql('filename', 'member')}) AS raw_link FROM searches),
{sanitize_ctes('numbered', 'link', 'raw_link', 'linked')},
evidence AS (SELECT question_id, search_seq, n, (search_seq - 1) * 100 + n AS seq, 'law-' || search_seq || '-' || n AS id, 'law' AS source,
             coalesce(title, filename, '{fixed.UNTITLED}') AS title, snippet, date, link, filename, member FROM linked)"""


def first_evidence(t: Tables):
    found = ev.hits_to_evidence(searches(t), "law", BASE_URL)
    return found.withColumn("seq", (F.col("search_seq") - 1) * 100 + F.col("n"))


@register("i1_hits_to_evidence", f"WITH {FIRST_EVIDENCE_SQL} SELECT question_id, seq, id, source, title, snippet, date, link, filename, member FROM evidence")
def to_evidence(t: Tables):
    return first_evidence(t).drop("search_seq", "n")


WEB_EVIDENCE_SQL = f"""{WEB_SQL},
web_kept AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS n FROM web WHERE link <> '' AND {IS_DOCUMENT_SQL}),
{sanitize_ctes('web_kept', 'clean', 'link', 'web_linked')},
web_evidence AS (SELECT query_id AS question_id, 1 AS search_seq, n, 'web-1-' || n AS id, 'web' AS source, coalesce(title, '{fixed.UNTITLED}') AS title,
                 snippet, date, clean AS link FROM web_linked)"""


def web_evidence(t: Tables):
    results = web(t).withColumnRenamed("query_id", "question_id").withColumn("search_seq", F.lit(1))
    return ev.web_to_evidence(results, "web", "web")


@register("i2_web_to_evidence", f"WITH {WEB_EVIDENCE_SQL} SELECT question_id, n, id, source, title, snippet, date, link FROM web_evidence")
def web_to_evidence(t: Tables):
    return web_evidence(t).drop("search_seq", "filename", "member")


KEY_SQL = "question_id, coalesce(filename, ''), coalesce(member, ''), coalesce(title, ''), left(coalesce(snippet, ''), 100)"
DEDUPED_SQL = f"{FIRST_EVIDENCE_SQL}, deduped AS (SELECT * FROM evidence QUALIFY row_number() OVER (PARTITION BY {KEY_SQL} ORDER BY seq) = 1)"


@register("i3_dedupe_evidence", f"WITH {DEDUPED_SQL} SELECT question_id, seq, id FROM deduped")
def dedupe(t: Tables):
    return ev.dedupe_evidence(first_evidence(t)).select("question_id", "seq", "id")


@register(
    "i3_dedupe_by_file",
    f"WITH {FIRST_EVIDENCE_SQL} SELECT question_id, seq, id FROM evidence QUALIFY row_number() OVER (PARTITION BY question_id, filename, member ORDER BY seq) = 1",
)
def dedupe_by_file(t: Tables):
    return ev.dedupe_evidence(first_evidence(t), simple_key=True).select("question_id", "seq", "id")


@register(
    "i4_dedupe_by_link",
    f"""WITH {FIRST_EVIDENCE_SQL} SELECT question_id, seq, link FROM evidence WHERE link <> '' QUALIFY row_number() OVER (PARTITION BY question_id, link ORDER BY seq) = 1""",
)
def dedupe_by_link(t: Tables):
    return ev.dedupe_by_link(first_evidence(t)).select("question_id", "seq", "link")


BOTH_SQL = f"""{FIRST_EVIDENCE_SQL}, {WEB_EVIDENCE_SQL.replace('query_id AS question_id, 1 AS search_seq', 'query_id * 1000 AS question_id, 1 AS search_seq')},
both_sources AS (SELECT question_id, search_seq, seq, id, source, title, snippet, date, link, filename, member FROM evidence
  UNION ALL SELECT question_id, search_seq, 200 + n, id, source, title, snippet, date, link, NULL, NULL FROM web_evidence)"""


def both_sources(t: Tables):
    found = web_evidence(t).withColumns({"question_id": F.col("question_id") * 1000, "seq": F.col("n") + 200})
    return first_evidence(t).unionByName(found).drop("n")


@register(
    "i5_refine_evidence",
    f"""WITH {BOTH_SQL} SELECT question_id, seq, id, source FROM both_sources
    QUALIFY search_seq = max(search_seq) OVER (PARTITION BY question_id, source)""",
)
def refine(t: Tables):
    return ev.refine_evidence(both_sources(t)).select("question_id", "seq", "id", "source")


ENDINGS = [").", ")\".", " ", ".,;", "(a)", "_(a))", "\"", "))", "?q=1)", ") . \"", "...", "\u00a0)", "a(b).", ")", ")\" "]
BLANK_SQL = f"links_given AS (SELECT page_id, CASE page_id % 13 WHEN 0 THEN '' ELSE '  ' || url END || ({sql_list(ENDINGS)})[page_id % {len(ENDINGS)} + 1] AS given FROM pages)"


@register("i6_sanitize_link", f"WITH {BLANK_SQL}, {sanitize_ctes('links_given', 'link', 'given', 'cleaned')} SELECT page_id, link FROM cleaned")
def sanitize(t: Tables):
    endings = F.array(*[F.lit(ending) for ending in ENDINGS])
    start = F.when(F.col("page_id") % 13 == 0, "").otherwise(F.concat(F.lit("  "), "url"))
    given = F.concat(start, F.get(endings, (F.col("page_id") % len(ENDINGS)).cast("int")))
    return t.read("pages").select("page_id", links.sanitize_link(given).alias("link"))


LINKED_PHRASES = [
    "See <a href=\"https://a.example/x))\">x</a> and <a href=\"https://a.example/y)\">y</a>. ",
    "As <a href=\"https://b.example/(z))\">text )</a> says (https://b.example/q). Next ",
    "<a href=https://c.example/u))>u)</a> or https://c.example/w(1)). ",
    "https://d.example/v)\" . and 'https://d.example/t'). ",
    "(https://e.example/r)\n<a href='https://e.example/s' target=_blank>s</a> ",
    "HTTP://F.example/a)<b> https://f.example/ok ",
    "",
]
ANSWERS_SQL = f"""answers AS (SELECT conv_id * 100 + turn AS question_id, ({sql_list(LINKED_PHRASES)})[(conv_id + turn) % {len(LINKED_PHRASES)} + 1] || text AS answer
  FROM conversations WHERE role = 'assistant')"""


def answers(t: Tables):
    phrases = F.array(*[F.lit(phrase) for phrase in LINKED_PHRASES])
    at = ((F.col("conv_id") + F.col("turn")) % len(LINKED_PHRASES)).cast("int")
    return t.read("conversations").where("role = 'assistant'").select(
        (F.col("conv_id") * 100 + F.col("turn")).alias("question_id"), F.concat(F.get(phrases, at), "text").alias("answer")
    )


def replace_matches_sql(value: str, pattern: str, change: str) -> str:
    """Split at the matches, change each (``m``) and put the pieces together again."""
    escaped = pattern.replace("'", "''")
    pieces = f"regexp_split_to_array({value}, '{escaped}')"
    found = f"list_transform(regexp_extract_all({value}, '{escaped}'), lambda m: {change})"
    return f"array_to_string(list_transform(list_zip({pieces}, list_append({found}, '')), lambda p: p[1] || p[2]), '')"


def answer_steps_sql() -> str:
    inner_ws = RWS[1:-1]
    url = rf"https?://[^{inner_ws}<>\"']+?"
    after = rf"({RWS}|$|[<\"'])"
    count = lambda s, c: f"(length({s}) - length(replace({s}, '{c}', '')))"
    inner = "m[7:length(m) - 2]"
    href = (
        f"CASE WHEN ends_with({inner}, ')') AND {count(inner, ')')} > {count(inner, '(')} "
        f"""THEN 'href="' || left({inner}, length({inner}) - 1) || '"' ELSE m END"""
    )
    quotes = rf"(?:{RWS}|[\"'`])*"
    bracket_ws = rf"\){RWS}*\.?{RWS}*\"?{RWS}*"
    bracket = rf"(?i){url}{bracket_ws}{after}".replace(after, rf"(?:{RWS}|$|[<\"'])")
    # the character after the match is part of it here, as RE2 has no lookahead
    whole = rf"(?i)^({url})({bracket_ws})({RWS}|[<\"'])$".replace("'", "''")
    at_end = rf"(?i)^({url})({bracket_ws})$".replace("'", "''")
    address = f"coalesce(nullif(regexp_extract(m, '{whole}', 1), ''), regexp_extract(m, '{at_end}', 1))"
    rest = f"regexp_extract(m, '{whole}', 3)"
    close = f"CASE WHEN {count(address, ')')} >= {count(address, '(')} THEN {address} || {rest} ELSE m END"
    last = rf"(?i)({url}){quotes}\){RWS}*\.{RWS}*{quotes}{after}".replace("'", "''")
    return f"""
s1 AS (SELECT question_id, {replace_matches_sql('answer', '(?i)href="[^"]*[)]"', href)} AS a FROM answers),
s2 AS (SELECT question_id, regexp_replace(a, '(?i)([^)]){RWS}*\\){RWS}*</a>', '\\1</a>', 'g') AS a FROM s1),
s3 AS (SELECT question_id, regexp_replace(a, '(?i)href=([^{inner_ws}>"]*)\\)\\)>', 'href=\\1>', 'g') AS a FROM s2),
s4 AS (SELECT question_id, {replace_matches_sql('a', bracket, close)} AS a FROM s3),
s5 AS (SELECT question_id, regexp_replace(a, '{last}', '\\1\\2', 'g') AS a FROM s4)"""


@register("i7_sanitize_answer_links", f"WITH {ANSWERS_SQL}, {answer_steps_sql()} SELECT question_id, a AS answer FROM s5")
def sanitize_answers(t: Tables):
    return answers(t).select("question_id", links.sanitize_answer_links("answer").alias("answer"))


ANCHOR_SQL = rf"<a{RWS}+href=[\"''](?P<u>[^\"'']+)[\"''][^>]*>([^<]+)</a>".replace("?P<u>", "")
PLAIN_SQL = rf"https?://[^{RWS[1:-1]}<>\"'']+"
EVERY_TEXT_SQL = f"""{ANSWERS_SQL}, every AS (SELECT question_id, answer FROM answers UNION ALL SELECT -1 - page_id, url || ' ' || html FROM pages)"""


@register(
    "i8_extract_links",
    f"""WITH {EVERY_TEXT_SQL}, f AS (SELECT question_id, unnest(l) AS m, generate_subscripts(l, 1) - 1 AS pos FROM (
      SELECT question_id, regexp_extract_all(answer, '(?i){ANCHOR_SQL}|{PLAIN_SQL}') AS l FROM every))
    SELECT question_id, CAST(pos AS INT) AS pos, CASE WHEN lower(left(m, 2)) = '<a' THEN 'html' ELSE 'plain' END AS kind,
      CASE WHEN lower(left(m, 2)) = '<a' THEN regexp_extract(m, '(?i){ANCHOR_SQL}', 1) ELSE m END AS url,
      CASE WHEN lower(left(m, 2)) = '<a' THEN regexp_extract(m, '(?i){ANCHOR_SQL}', 2) END AS label FROM f""",
)
def extract_links(t: Tables):
    pages = t.read("pages").select((-1 - F.col("page_id")).alias("question_id"), F.concat_ws(" ", "url", "html").alias("answer"))
    return ev.answer_links(answers(t).unionByName(pages))


def middle_sql(content: str, limit: str, tail: int, marker: str) -> str:
    head_part = rf"regexp_replace(left({content}, greatest({limit} - {tail}, 0)), '{RWS}+$', '')"
    tail_part = rf"regexp_replace(right({content}, {tail}), '^{RWS}+', '')"
    return (
        f"CASE WHEN length({content}) <= {limit} THEN {content} WHEN {head_part} = '' THEN {tail_part} "
        f"ELSE {head_part} || {marker} || {tail_part} END"
    )


STORED_SQL = """stored_docs AS (SELECT archive_filename, CASE WHEN id % 6 = 1 THEN replace(member, '.xml', '.html') ELSE member END AS stored, content FROM docs WHERE id % 7 > 0)"""
HYDRATED_SQL = f"""{DEDUPED_SQL}, {STORED_SQL},
looked AS (SELECT e.*, s.stored, s.content AS body FROM deduped e LEFT JOIN stored_docs s ON s.archive_filename = e.filename
  AND (s.stored = e.member OR (ends_with(e.member, '.html') AND s.stored = replace(e.member, '.html', '.xml')))
  QUALIFY row_number() OVER (PARTITION BY question_id, seq ORDER BY (stored IS NOT NULL AND ends_with(stored, '.xml')) DESC) = 1),
hydrated AS (SELECT question_id, search_seq, seq, id, source, title, snippet, date, filename, replace(member, '.xml', '.html') AS shown_member,
  {viewer_sql('filename', 'member')} AS viewer, {middle_sql('body', '2000', 1000, "chr(10) || '...' || chr(10)")} AS content FROM looked)"""


def stored(t: Tables):
    html = F.when(F.col("id") % 6 == 1, F.replace("member", F.lit(".xml"), F.lit(".html"))).otherwise(F.col("member"))
    return t.documents().withColumn("member", html).where("id % 7 > 0")


@register(
    "i9_hydrate_evidence",
    f"WITH {HYDRATED_SQL} SELECT question_id, seq, id, shown_member AS member, viewer AS link, md5(content) AS content_md5 FROM hydrated",
)
def hydrate(t: Tables):
    hydrated = ev.hydrate_evidence(ev.dedupe_evidence(first_evidence(t)), stored(t), BASE_URL, 2000)
    return hydrated.select("question_id", "seq", "id", "member", "link", F.md5(F.col("content").cast("binary")).alias("content_md5"))


@register(
    "i10_truncate_middle",
    f"""SELECT doc_id, md5({middle_sql('text', '20000', 1000, "chr(10) || '...' || chr(10)")}) AS long_md5,
    {middle_sql('text', '3000', 500, "chr(10) || '... [innhold forkortet] ...' || chr(10)")} AS prompt_form,
    {middle_sql('text', '400', 500, "chr(10) || '... [innhold forkortet] ...' || chr(10)")} AS tail_form FROM documents""",
)
def middle(t: Tables):
    return t.read("documents").select(
        "doc_id",
        F.md5(text.truncate_middle("text").cast("binary")).alias("long_md5"),
        text.truncate_middle("text", 3000, 500, fixed.SHORTENED_MARKER).alias("prompt_form"),
        text.truncate_middle("text", 400, 500, fixed.SHORTENED_MARKER).alias("tail_form"),
    )


def lines_sql(limit: str, short: bool) -> str:
    body = middle_sql("nullif(content, '')", limit, 500, "chr(10) || '... [innhold forkortet] ...' || chr(10)")
    parts = ["'ID: ' || id", "'Kilde: ' || source", "'Tittel: ' || nullif(title, '')"]
    if not short:
        parts += ["'Dato: ' || nullif(date, '')", "'Lenke: ' || nullif(viewer, '')"]
    parts += ["'Utdrag: ' || nullif(snippet, '')", f"'Innhold:' || chr(10) || ({body})"]
    return "concat_ws(chr(10), " + ", ".join(parts) + ")"


NL2 = "chr(10) || chr(10)"
QUESTION_SQL = f"""questions AS (SELECT query_id AS question_id, left({sql_trim("repeat(text || ' ', CASE WHEN item_id % 5 = 0 THEN 300 ELSE 1 END)")}, 5000) AS question FROM queries)"""
OPEN_SQL = f"'{fixed.PROMPT_QUESTION}' || question || {NL2} || 'Tilgjengelige kilder:' || chr(10)"
CLOSE_SQL = f"{NL2} || '{fixed.PROMPT_END.strip()}'"
FRAME = len(fixed.PROMPT_QUESTION) + len(fixed.PROMPT_SOURCES) + len(fixed.PROMPT_END)


def packed_sql(limit_full: str, limit_short: str) -> str:
    return f"""{QUESTION_SQL},
items AS (SELECT h.*, q.question, length(q.question) AS ql, count(*) OVER (PARTITION BY question_id) AS n_items FROM hydrated h JOIN questions q USING (question_id)),
shares AS (SELECT *, {limit_full} AS share, {limit_short} AS half FROM items),
prompts AS (SELECT question_id, any_value(question) AS question, string_agg({lines_sql('share', False)}, {NL2} ORDER BY seq) AS full_form,
  string_agg({lines_sql('half', True)}, {NL2} ORDER BY seq) AS short_form FROM shares GROUP BY 1)"""


@register(
    "i11_pack_context",
    f"""WITH {HYDRATED_SQL.replace("'2000'", "2000")}, {packed_sql("least(3000, CAST(floor(greatest(50000 - ql - 200, 10000) / n_items) AS INT))", f"CAST(floor((50000 - {FRAME} - ql) / n_items / 2) AS INT)")}
    SELECT q.question_id, md5(CASE WHEN p.question_id IS NULL THEN '{fixed.PROMPT_QUESTION}' || q.question || {NL2} || '{fixed.PROMPT_NO_SOURCES.strip()}'
      WHEN length({OPEN_SQL.replace('question', 'q.question')} || full_form || {CLOSE_SQL}) > 50000 THEN {OPEN_SQL.replace('question', 'q.question')} || short_form || {CLOSE_SQL}
      ELSE {OPEN_SQL.replace('question', 'q.question')} || full_form || {CLOSE_SQL} END) AS prompt_md5
    FROM questions q LEFT JOIN prompts p USING (question_id)""",
)
def pack(t: Tables):
    times = F.when(F.col("item_id") % 5 == 0, 300).otherwise(1)
    questions = t.queries().withColumn("times", times).select(
        F.col("query_id").alias("question_id"), F.expr("repeat(concat(text, ' '), times)").alias("question")
    )
    hydrated = ev.hydrate_evidence(ev.dedupe_evidence(first_evidence(t)), stored(t), BASE_URL, 2000)
    packed = ev.pack_context(questions, hydrated)
    return packed.select("question_id", F.md5(F.col("prompt").cast("binary")).alias("prompt_md5"))


@register(
    "i12_cap_evidence",
    f"WITH {FIRST_EVIDENCE_SQL} SELECT question_id, seq, id, row_number() OVER (PARTITION BY question_id ORDER BY seq) AS n FROM evidence QUALIFY row_number() OVER (PARTITION BY question_id ORDER BY seq) <= 6",
)
def cap(t: Tables):
    return ev.cap_evidence(first_evidence(t), 6).select("question_id", "seq", "id", "n")


# Shapes a generated answer may have, by position of the text in them.
ANSWER_STARTS = [
    'Here: {"answer": "', '{"answer": 7, "citations": [{"evidenceId": "law-1-1"}], "rest": "', "no json ", '{"broken": ', '{"citations": {"a": 1}, "answer": "', "} back {",
]
ANSWER_ENDS = [
    '", "citations": [{"evidenceId": "law-1-2", "quote": "q"}, {"evidenceId": 5}, {"evidenceId": "law-9-9"}, "x"]} done', '"}', "", "}", '"}', "",
]
RAW_SQL = f"""raw_answers AS (SELECT conv_id * 100 + turn AS question_id, ({sql_list(ANSWER_STARTS)})[conv_id % 6 + 1] || regexp_replace(text, '[^\\p{{L}}\\p{{N}} ]', ' ', 'g')
  || ({sql_list(ANSWER_ENDS)})[conv_id % 6 + 1] || ' ' AS raw FROM conversations WHERE role = 'assistant')"""


def raw_answers(t: Tables):
    starts, ends = (F.array(*[F.lit(value) for value in values]) for values in (ANSWER_STARTS, ANSWER_ENDS))
    at = (F.col("conv_id") % 6).cast("int")
    plain = F.regexp_replace("text", r"[^\p{L}\p{N} ]", " ")
    return t.read("conversations").where("role = 'assistant'").select(
        (F.col("conv_id") * 100 + F.col("turn")).alias("question_id"),
        F.concat(F.get(starts, at), plain, F.get(ends, at), F.lit(" ")).alias("raw"),
    )


PARSED_SQL = f"""{RAW_SQL}, braces AS (SELECT question_id, raw, {sql_trim('raw')} AS t FROM raw_answers),
cand AS (SELECT *, strpos(t, '{{') AS a, strpos(reverse(t), '}}') AS b,
  substr(t, greatest(strpos(t, '{{'), 1), greatest(length(t) - strpos(reverse(t), '}}') + 2 - strpos(t, '{{'), 0)) AS c FROM braces),
parsed AS (SELECT question_id, CASE WHEN a = 0 OR b = 0 THEN t WHEN NOT json_valid(c) THEN raw
    WHEN json_type(c, '$.answer') = 'VARCHAR' THEN json_extract_string(c, '$.answer') END AS answer,
  CASE WHEN a > 0 AND b > 0 AND json_valid(c) AND json_type(c, '$.citations') = 'ARRAY' THEN json_extract(c, '$.citations[*]') END AS cited FROM cand)"""


@register(
    "i13_parse_answer_json",
    f"""WITH {PARSED_SQL} SELECT question_id, answer, len(list_filter(cited, lambda x: json_type(x, '$.evidenceId') = 'VARCHAR')) AS n_citations FROM parsed""",
)
def parse(t: Tables):
    return ev.parse_answer_json(raw_answers(t)).select(
        "question_id", "answer", F.when(F.col("citations").isNotNull(), F.size("citations")).alias("n_citations")
    )


GIVEN_SQL = """given AS (SELECT query_id AS question_id, v.ord, v.evidence_id, v.quote FROM queries
  CROSS JOIN (VALUES (0, 'law-1-3', 'q'), (1, 'law-7-1', NULL), (2, 'law-1-1', NULL)) v(ord, evidence_id, quote) WHERE item_id % 2 = 0)"""


@register(
    "i14_resolve_citations",
    f"""WITH {FIRST_EVIDENCE_SQL}, {GIVEN_SQL}, p AS (SELECT question_id, id AS evidence_id, row_number() OVER (PARTITION BY question_id ORDER BY seq) + 10 AS position FROM evidence)
    SELECT g.question_id, g.ord, g.evidence_id, '[' || position || ']' AS label, g.quote FROM given g JOIN p USING (question_id, evidence_id)
    UNION ALL SELECT question_id, CAST(position - 11 AS INT), evidence_id, '[' || position || ']', NULL FROM p
    WHERE question_id IN (SELECT query_id FROM queries) AND question_id NOT IN (SELECT question_id FROM given)""",
)
def citations(t: Tables):
    rows = F.array(
        *[
            F.struct(F.lit(at).alias("ord"), F.lit(name).alias("evidence_id"), F.lit(quote).cast("string").alias("quote"))
            for at, (name, quote) in enumerate([("law-1-3", "q"), ("law-7-1", None), ("law-1-1", None)])
        ]
    )
    questions = t.queries().withColumnRenamed("query_id", "question_id")
    given = questions.where("item_id % 2 = 0").select("question_id", F.inline(rows))
    return ev.resolve_citations(questions, given, first_evidence(t), page=2, page_size=10)


@register(
    "i15_fallback_summary",
    f"""WITH {BOTH_SQL}, c AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY seq) AS k FROM both_sources QUALIFY k <= 5),
    l AS (SELECT question_id, string_agg('- ' || coalesce(title, '{fixed.UNTITLED}') || CASE WHEN source = 'law' THEN ' (Law)' ELSE '' END, chr(10) ORDER BY k) AS lines FROM c GROUP BY 1)
    SELECT query_id AS question_id, coalesce('{fixed.SUMMARY_INTRO}' || chr(10) || lines, '{fixed.SUMMARY_EMPTY}') AS answer
    FROM queries q LEFT JOIN l ON l.question_id = q.query_id""",
)
def summary(t: Tables):
    questions = t.queries().withColumnRenamed("query_id", "question_id")
    return ev.fallback_summary(questions, both_sources(t), "law", "Law")


@register(
    "i16_evidence_stats",
    f"""WITH {BOTH_SQL} SELECT question_id, count(*) AS total, count(*) FILTER (source = 'law') AS n_0, count(*) FILTER (source <> 'law') AS other,
    greatest(1, CAST(ceil(count(*) / 10) AS BIGINT)) AS pages FROM both_sources GROUP BY 1""",
)
def evidence_stats(t: Tables):
    return ev.evidence_stats(both_sources(t), ["law"])


@register("i_prompts")
def prompts(t: Tables):
    """The whole way from two searches to the prompt of each question."""
    questions = t.queries().select(F.col("query_id").alias("question_id"), F.col("text").alias("question"))
    packed = assistant.prompts(questions, first_evidence(t), stored(t), BASE_URL)
    return packed.select("question_id", F.length("prompt").alias("n_chars"), F.md5(F.col("prompt").cast("binary")).alias("prompt_md5"))
