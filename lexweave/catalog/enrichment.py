"""Queries on document enrichment (B)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fixed_values as fixed
from ..functions import rules, text
from ..operators import enrich
from .base import RAW_DOCUMENTS_SQL, RWS, Tables, register, sql_decode, sql_group, sql_normalize, sql_trim


def digest(column):
    """Hash of a long text, so that results stay thin."""
    return F.md5(F.coalesce(column, F.lit("")).cast("binary"))


@register(
    "b1_normalize_text",
    f"""WITH {RAW_DOCUMENTS_SQL}, n AS (SELECT doc_id, {sql_normalize('raw')} AS t FROM raw_documents)
    SELECT doc_id, length(t) AS n_chars, md5(t) AS content_md5 FROM n""",
)
def normalize(tables: Tables):
    normal = tables.raw_documents().select("doc_id", text.normalize_text("raw").alias("t"))
    return normal.select("doc_id", F.length("t").alias("n_chars"), digest(F.col("t")).alias("content_md5"))


def sql_tags(tags: list[str], length: int, source: str = "raw") -> str:
    found = [
        sql_decode(sql_trim(sql_group(source, f"(?i)<{tag}[^>]*>([^<]{{1,{length}}})"))) for tag in tags
    ]
    return f"coalesce({', '.join(found)})"


TITLE_SQL, DATE_SQL = sql_tags(fixed.TITLE_TAGS, 200), sql_tags(fixed.DATE_TAGS, 50)


@register("b2_extract_title", f"WITH {RAW_DOCUMENTS_SQL} SELECT doc_id, {TITLE_SQL} AS title FROM raw_documents")
def title(tables: Tables):
    return tables.raw_documents().select("doc_id", text.extract_title("raw").alias("title"))


@register(
    "b2_page_titles",
    f"SELECT page_id, {sql_tags(fixed.TITLE_TAGS, 200, 'html')} AS title FROM pages",
)
def page_titles(tables: Tables):
    return tables.read("pages").select("page_id", text.extract_title("html").alias("title"))


@register("b3_extract_date", f"WITH {RAW_DOCUMENTS_SQL} SELECT doc_id, {DATE_SQL} AS document_date FROM raw_documents")
def date(tables: Tables):
    return tables.raw_documents().select("doc_id", text.extract_date("raw").alias("document_date"))


def sql_year(source: str, pattern: str) -> str:
    year = f"TRY_CAST({sql_group(source, pattern)} AS INT)"
    return f"CASE WHEN {year} BETWEEN 1900 AND 2100 THEN {year} END"


BARE_YEAR = r"\b((?:19|20)\d{2})\b"
YEAR_SQL = (
    f"coalesce({sql_year('document_date', BARE_YEAR)}, "
    f"{sql_year('raw', rf'(?i)år(?::|{RWS})+(\d{{4}})')}, {sql_year('raw', rf'(?i)(\d{{4}}){RWS}*år')})"
)
ANY_YEAR_SQL = f"coalesce({sql_year('document_date', BARE_YEAR)}, {sql_year('raw', BARE_YEAR)})"


@register(
    "b4_extract_year",
    f"""WITH {RAW_DOCUMENTS_SQL}, d AS (SELECT doc_id, raw, {DATE_SQL} AS document_date FROM raw_documents)
    SELECT doc_id, {YEAR_SQL} AS labelled_year, {ANY_YEAR_SQL} AS any_year FROM d""",
)
def year(tables: Tables):
    dated = tables.raw_documents().withColumn("document_date", text.extract_date("raw"))
    return dated.select(
        "doc_id",
        text.extract_year("raw", "document_date").alias("labelled_year"),
        text.extract_year("raw", "document_date", "any").alias("any_year"),
    )


def sql_rules(source: str, rule_list: list[tuple[str, list[str]]]) -> str:
    cases = []
    for result, words in rule_list:
        pattern = r"(?i)\b(?:" + "|".join(words) + r")\b"
        cases.append(f"WHEN regexp_matches({source}, '{pattern}') THEN '{result}'")
    return "CASE " + " ".join(cases) + " END"


def sql_ministry_words(name: str) -> str:
    return name.lower().replace("- og ", rf"-?{RWS}*og{RWS}*")


def sql_ministries(for_queries: bool) -> list[tuple[str, list[str]]]:
    return [
        (name, [sql_ministry_words(name), *(asked if for_queries else [short, *others])])
        for name, short, others, asked in fixed.MINISTRIES
    ]


def sql_everything(title_column: str, source: str) -> str:
    return f"(CASE WHEN coalesce({title_column}, '') <> '' THEN {title_column} || ' ' ELSE '' END || {source})"


LAW_TYPE_SQL = (
    f"coalesce({sql_rules('title', fixed.LAW_TYPES)}, {sql_rules('everything', fixed.LAW_TYPES)}, "
    r"CASE WHEN regexp_matches(everything, '\b[A-ZÆØÅ][a-zæøå]+loven?\b') THEN 'Lov' END)"
)
MINISTRY_SQL = (
    f"coalesce({sql_rules('everything', sql_ministries(False))}, "
    + sql_group("everything", rf"(?i)\b([A-ZÆØÅ][a-zæøå]+(?:-?{RWS}*og{RWS}*[a-zæøå]+)?departementet?)\b")
    + ")"
)
WITH_TITLE_SQL = f"""{RAW_DOCUMENTS_SQL},
titled AS (SELECT doc_id, raw, {TITLE_SQL} AS title, {DATE_SQL} AS document_date FROM raw_documents),
whole AS (SELECT *, {sql_everything('title', 'raw')} AS everything FROM titled)"""


@register("b5_classify_law_type", f"WITH {WITH_TITLE_SQL} SELECT doc_id, {LAW_TYPE_SQL} AS law_type FROM whole")
def law_type(tables: Tables):
    titled = tables.raw_documents().withColumn("title", text.extract_title("raw"))
    return titled.select("doc_id", rules.classify_law_type("title", "raw").alias("law_type"))


# Words of the given texts by language, to run the rule engine on the whole texts; with capitals, and phrases that overlap.
LANGUAGE_RULES = [
    ("English of the", ["of the"]),
    ("English", ["With", "From", "the and", "in of", "This"]),
    ("French", ["avec", "dans", "pour"]),
    ("German", ["nicht", "sich", "auch"]),
    ("Spanish", ["para", "como", "los"]),
]


@register(
    "b5_custom_rules",
    f"""SELECT doc_id, {sql_rules('text', LANGUAGE_RULES)} AS law_type FROM documents""",
)
def custom_rules(tables: Tables):
    return tables.read("documents").select(
        "doc_id", rules.first_rule_of_long_text("text", LANGUAGE_RULES).alias("law_type")
    )


@register("b6_extract_ministry", f"WITH {WITH_TITLE_SQL} SELECT doc_id, {MINISTRY_SQL} AS ministry FROM whole")
def ministry(tables: Tables):
    titled = tables.raw_documents().withColumn("title", text.extract_title("raw"))
    return titled.select("doc_id", rules.extract_ministry("title", "raw").alias("ministry"))


@register(
    "b7_decode_entities",
    f"""SELECT page_id, md5({sql_decode('html')}) AS decoded_md5, md5({sql_decode('html', True)}) AS with_nbsp_md5
    FROM pages""",
)
def decode(tables: Tables):
    return tables.read("pages").select(
        "page_id",
        digest(text.decode_entities("html")).alias("decoded_md5"),
        digest(text.decode_entities("html", nbsp=True)).alias("with_nbsp_md5"),
    )


@register(
    "b8_is_html",
    f"""WITH {RAW_DOCUMENTS_SQL}, every AS (
      SELECT 'page' AS kind, page_id AS id, html AS t FROM pages
      UNION ALL SELECT 'document', doc_id, raw FROM raw_documents)
    SELECT kind, id, contains(lower(left(t, 1000)), '<html') OR contains(lower(left(t, 1000)), '<!doctype html') AS is_html
    FROM every""",
)
def html(tables: Tables):
    pages = tables.read("pages").select(F.lit("page").alias("kind"), F.col("page_id").alias("id"), text.is_html("html").alias("is_html"))
    documents = tables.raw_documents().select(F.lit("document").alias("kind"), F.col("doc_id").alias("id"), text.is_html("raw").alias("is_html"))
    return pages.unionByName(documents)


ARTICLE_SQL = """
articles AS (
  SELECT page_id, CASE page_id % 4
    WHEN 0 THEN '<article id="a" class="x legalArticle" DATA-Source-URL="' || url || '">'
    WHEN 1 THEN '<article data-source-url=''' || url || ''' class="legalArticle y">'
    WHEN 2 THEN '<article data-source-url="/first"><article data-source-url=" ' || url || ' " class="legalArticle">'
    ELSE '' END || html AS t FROM pages)
"""


def _source_url_sql() -> str:
    value = r"""data-source-url=["'']([^"'']+)["'']"""
    css = r"""class=["''][^"'']*legalArticle[^"'']*["'']"""
    patterns = [rf"(?i)<article[^>]*{css}[^>]*{value}", rf"(?i)<article[^>]*{value}[^>]*{css}", rf"(?i)<article[^>]*{value}"]
    found = ", ".join(f"nullif(regexp_extract(t, '{pattern}', 1), '')" for pattern in patterns)
    return f"split_part({sql_trim(f'coalesce({found})')}, '?', 1)"


@register(
    "b9_extract_source_url",
    f"""WITH {ARTICLE_SQL}, p AS (SELECT page_id, {_source_url_sql()} AS path FROM articles)
    SELECT page_id, CASE WHEN starts_with(path, '/') THEN 'https://site.example' || path
      ELSE 'https://site.example/' || path END AS source_url FROM p""",
)
def source_url(tables: Tables):
    url = F.col("url")
    opening = (
        F.when(F.col("page_id") % 4 == 0, F.concat(F.lit('<article id="a" class="x legalArticle" DATA-Source-URL="'), url, F.lit('">')))
        .when(F.col("page_id") % 4 == 1, F.concat(F.lit("<article data-source-url='"), url, F.lit("' class=\"legalArticle y\">")))
        .when(F.col("page_id") % 4 == 2, F.concat(F.lit('<article data-source-url="/first"><article data-source-url=" '), url, F.lit(' " class="legalArticle">')))
        .otherwise(F.lit(""))
    )
    articles = tables.read("pages").select("page_id", F.concat(opening, "html").alias("t"))
    return articles.select(
        "page_id", text.extract_source_url("t", "data-source-url", "https://site.example").alias("source_url")
    )


LABELS_RE = r"(?i)\b(" + "|".join(fixed.METADATA_LABELS) + r")\b"
LABELLED_SQL = f"""WITH {RAW_DOCUMENTS_SQL},
cut AS (SELECT doc_id, regexp_extract_all(raw, '{LABELS_RE}', 1) AS found,
               regexp_split_to_array(raw, '{LABELS_RE.replace('(Datokode', '(?:Datokode')}') AS between FROM raw_documents),
listed AS (SELECT doc_id, unnest(generate_series(1, len(found))) AS n, found, between FROM cut)
SELECT doc_id AS id, CAST(n - 1 AS INT) AS ord, found[n] AS label,
  regexp_replace({sql_trim(rf"regexp_replace(between[n + 1], '^(?:{RWS}|[:.-])+', '')")}, '{RWS}{{2,}}', ' ', 'g') AS value
FROM listed"""


@register("b10_labelled_metadata", LABELLED_SQL)
def labelled(tables: Tables):
    documents = tables.raw_documents().select(F.col("doc_id").alias("id"), F.col("raw").alias("content"))
    return enrich.labelled_metadata(documents)


STORED_SQL = f"""{WITH_TITLE_SQL},
stored AS (
  SELECT w.doc_id AS id, w.raw AS content, w.title, w.document_date, w.everything, w.raw,
         CASE WHEN l.quality = 1 THEN 'Lov' END AS law_type,
         CASE WHEN l.toxic = 1 THEN 1950 END AS year,
         CASE WHEN l.toxic = 0 THEN 'kjent' END AS ministry
  FROM whole w LEFT JOIN labels l USING (doc_id))"""
CHANGED_SQL = f"""{STORED_SQL},
found AS (
  SELECT id, year AS old_year, ministry AS old_ministry, {LAW_TYPE_SQL.replace('everything', 's.everything')} AS law_type,
         {ANY_YEAR_SQL} AS found_year, {MINISTRY_SQL} AS found_ministry
  FROM stored s WHERE s.law_type IS NULL),
changed AS (
  SELECT id, law_type, coalesce(old_year, found_year) AS year, coalesce(old_ministry, found_ministry) AS ministry
  FROM found WHERE law_type IS NOT NULL OR (old_year IS NULL AND found_year IS NOT NULL)
    OR (old_ministry IS NULL AND found_ministry IS NOT NULL))"""


def stored_documents(tables: Tables):
    """Marked-up documents whose metadata is only partly filled, by ``labels``."""
    flags = tables.read("labels").select("doc_id", "quality", "toxic")
    raw = tables.raw_documents().join(flags, "doc_id", "left")
    return raw.select(
        F.col("doc_id").alias("id"),
        F.col("raw").alias("content"),
        text.extract_title("raw").alias("title"),
        text.extract_date("raw").alias("document_date"),
        F.when(F.col("quality") == 1, "Lov").alias("law_type"),
        F.when(F.col("toxic") == 1, 1950).alias("year"),
        F.when(F.col("toxic") == 0, "kjent").alias("ministry"),
    )


@register("b11_backfill_metadata", f"WITH {CHANGED_SQL} SELECT id, law_type, year, ministry FROM changed")
def backfill(tables: Tables):
    return enrich.backfill_metadata(stored_documents(tables))


@register(
    "b12_propagate_metadata",
    f"""WITH {CHANGED_SQL}, chunk_rows AS (
      SELECT id * 10 + i AS id, id AS document_id, law_type, year, ministry FROM stored, (VALUES (0), (1)) v(i))
    SELECT c.id, c.document_id, coalesce(n.law_type, c.law_type) AS law_type, coalesce(n.year, c.year) AS year,
           coalesce(n.ministry, c.ministry) AS ministry
    FROM chunk_rows c LEFT JOIN changed n ON n.id = c.document_id""",
)
def propagate(tables: Tables):
    stored = stored_documents(tables)
    halves = stored.select(
        F.explode(F.array(F.lit(0), F.lit(1))).alias("i"), F.col("id").alias("document_id"), "law_type", "year", "ministry"
    )
    chunks = halves.select((F.col("document_id") * 10 + F.col("i")).alias("id"), "document_id", "law_type", "year", "ministry")
    return enrich.propagate_metadata(enrich.backfill_metadata(stored), chunks)


@register(
    "b13_backfill_stats",
    f"""WITH {CHANGED_SQL}, pairs AS (
      SELECT 'law_type' AS kind, law_type AS value FROM changed
      UNION ALL SELECT 'year', CAST(year AS VARCHAR) FROM changed
      UNION ALL SELECT 'ministry', ministry FROM changed)
    SELECT kind, value, count(*) AS n FROM pairs WHERE value IS NOT NULL GROUP BY ALL""",
)
def stats(tables: Tables):
    return enrich.backfill_stats(enrich.backfill_metadata(stored_documents(tables)))


@register(
    "b_enrich_documents",
    f"""WITH {WITH_TITLE_SQL}
    SELECT doc_id, title, document_date, md5({sql_normalize('raw')}) AS content_md5, {LAW_TYPE_SQL} AS law_type,
           {YEAR_SQL} AS year, {MINISTRY_SQL} AS ministry FROM whole""",
)
def enrich_all(tables: Tables):
    raw = tables.raw_documents().withColumns(
        {"archive_filename": F.lit("a"), "member": F.concat(F.lit("d"), "doc_id", F.lit(".xml"))}
    )
    enriched = enrich.enrich_documents(raw)
    return enriched.select(
        "doc_id", "title", "document_date", digest(F.col("content")).alias("content_md5"), "law_type", "year", "ministry"
    )


