"""Registry of runnable queries with their SQL twins, and the tables they read."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import WS_CHARS
from ..session import spread

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    """Add a query ``(tables) -> DataFrame`` and, where SQL can say it, its twin."""

    def add(build: Callable[["Tables"], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: build(Tables(spark, sf_dir))
        if sql is not None:
            ORACLES[name] = sql
        return build

    return add


class Tables:
    """The given tables, read as Parquet, and the domain tables derived from them."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def read(self, name: str) -> DataFrame:
        scan = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        return spread(scan) if name in ("documents", "pages") else scan

    def documents(self) -> DataFrame:
        """``documents`` in the shape of the document table."""
        return self.read("documents").select(
            F.col("doc_id").alias("id"),
            F.col("source").alias("archive_filename"),
            member().alias("member"),
            F.substring_index("text", "\n", 1).alias("title"),
            F.lit(None).cast("string").alias("document_date"),
            F.col("text").alias("content"),
            F.concat_ws("/", "source", member()).alias("relative_path"),
            F.col("lang").alias("law_type"),
            F.lit(None).cast("int").alias("year"),
            F.lit(None).cast("string").alias("ministry"),
        )

    def raw_documents(self) -> DataFrame:
        """Whole texts behind a marked-up header that depends on the source."""
        headers = F.array(*[F.lit(header) for header in HEADERS])
        return self.read("documents").select(
            "doc_id",
            F.concat(F.get(headers, source_number() % len(HEADERS)), "text").alias("raw"),
        )

    def queries(self) -> DataFrame:
        """``(query_id, item_id, text)``: the sentences of the benchmark texts with a word of three letters."""
        sentences = self.read("benchmark").select(
            "item_id", F.posexplode(F.split("text", r"[.\n]", -1)).alias("at", "text")
        )
        return sentences.where(F.col("text").rlike(r"[\p{L}\p{N}]{3,}")).select(
            (F.col("item_id") * 1000 + F.col("at")).alias("query_id"), "item_id", "text"
        )

    def vector_queries(self) -> DataFrame:
        vectors = self.read("embeddings").select(
            F.col("vec_id").alias("item_id"), F.col("embedding").alias("vector")
        )
        return self.queries().join(vectors, "item_id", "left")

    def embedded_documents(self) -> DataFrame:
        vectors = self.read("embeddings").select(F.col("vec_id").alias("id"), "embedding")
        return self.documents().join(vectors, "id", "left")

    def asked(self) -> DataFrame:
        """``(query_id, text)``: questions of the conversations behind Norwegian phrases."""
        phrases = F.array(*[F.lit(phrase) for phrase in PHRASES])
        return self.read("conversations").where("role = 'user'").select(
            (F.col("conv_id") * 100 + F.col("turn")).alias("query_id"),
            F.concat(
                F.get(phrases, (F.col("conv_id") % len(PHRASES)).cast("int")), F.lit(" "), "text"
            ).alias("text"),
        )


def member() -> Column:
    return F.concat(F.lit("d"), F.col("doc_id"), F.lit(".xml"))


def source_number() -> Column:
    return F.substring("source", 4, 10).cast("int")


def sql_list(values: list[str]) -> str:
    return "[" + ", ".join("'" + value.replace("'", "''") + "'" for value in values) + "]"


# Headers put before the texts: titles, dates, types and ministries in many spellings.
HEADERS = [
    "<html><tittel>Lov 4. juli 1991 nr. 47 om ekteskap</tittel>\r\n<dato>1991-07-04</dato> Barne- og familiedepartementet\r\n\r\n\r\n\r\n",
    "<tittel>Forskrift om  &amp;lt;skatt&amp;gt; </tittel>\n<dato> 2003 </dato>\nFinansdepartementet\t  §  3 a\n",
    "<TITLE>Vedtak om vern</TITLE>\nkunngjort år: 2019, klima- og miljødepartementet\n",
    "<overskrift>Cirkulær til Æ</overskrift><ikrafttredelse>12.03.1987</ikrafttredelse> KMD kapittel 2\n",
    "<tittel1>Rundskriv nr. 5</tittel1><kunngjort>i 2001</kunngjort> hod\n",
    "<title>Instruks &quot;A&quot; &#39;b&#39;</title><published>2024-02-29T10:00</published> Utenriksdepartementet\n",
    "<title>Reglement</title> gjelder 1999 og 2011 år ufd\n",
    "<overskrift>Vedlegg B</overskrift> Olje-  og energidepartementet paragraf 12b\n",
    "Folketrygdloven gjelder. arbeids- og sosialdepartementet år 1850\n",
    "<tittel>Om endring i ting</tittel> forskrift 2018 Landbruks- og matdepartementet\n",
    "<tittel></tittel><title> </title><dato>  </dato> regulations apply; samferdselsdepartementet\n",
    "lovå er ikke lov. Ålov heller. barneogfamiliedepartementet 1066 år\n",
    "<dato>ikke satt</dato> Annex 4, FD, § 7\n",
    "<!DOCTYPE HTML><tittel lang=\"nb\">Lov om arv</tittel><dato>2019-06-14</dato> Justis- og beredskapsdepartementet\n",
    "<tittel>Beslutning</tittel> decision of 2020. Departementet\n",
    "# Overskrift i Markdown\nAct of 1814 dfd\n",
    "Kapittel en\n=====\nsirkulære, appendix, nfd\n",
    "Datokode LOV-2017 Departement: Kulturdepartementet Publisert  I 2017 Tittel - Lov om    film RefID x/1\n",
    "Korttittel: Filmloven i kraft fra 01.01.2018 Annet om dokumentet: ingen\n",
    "Innhold i dette: circular letter, ud. asd2\n",
]

# Phrases put before questions.
PHRASES = [
    "Forskrift til lov om register",
    "lov om ekteskap fra 1991",
    "Hva sier ekteskapsloven om skjevdeling?",
    "2018 forskrift fra Finansdepartementet",
    "Forskrift om 2020",
    "vedtak i 2021 fra Helse- og omsorgsdepartementet",
    "Rundskriv år 1899",
    "instruks for justisdepartementet",
    "reglement",
    "gjelder oppsigelse, sykefravær og (leie)",
    "lovå",
    "list data fra arkivet",
    "arkivet /v1/public/list",
    "",
    "legal dataset",
    "statute from 2015",
    "Lov om",
    "forskrift til endring i lov",
]

RAW_DOCUMENTS_SQL = f"""
raw_documents AS (
  SELECT doc_id, ({sql_list(HEADERS)})[CAST(substr(source, 4) AS INT) % {len(HEADERS)} + 1] || text AS raw
  FROM documents)
"""

DOCUMENTS_SQL = """
docs AS (
  SELECT doc_id AS id, source AS archive_filename, 'd' || doc_id || '.xml' AS member,
         split_part(text, chr(10), 1) AS title, CAST(NULL AS VARCHAR) AS document_date,
         text AS content, source || '/d' || doc_id || '.xml' AS relative_path, lang AS law_type,
         CAST(NULL AS INT) AS year, CAST(NULL AS VARCHAR) AS ministry
  FROM documents)
"""

QUERIES_SQL = r"""
queries AS (
  SELECT item_id * 1000 + n - 1 AS query_id, item_id, text FROM (
    SELECT item_id, unnest(s) AS text, generate_subscripts(s, 1) AS n
    FROM (SELECT item_id, regexp_split_to_array(text, '[.\n]') AS s FROM benchmark))
  WHERE regexp_matches(text, '[\p{L}\p{N}]{3,}'))
"""

ASKED_SQL = f"""
asked AS (
  SELECT conv_id * 100 + turn AS query_id, ({sql_list(PHRASES)})[conv_id % {len(PHRASES)} + 1] || ' ' || text AS text
  FROM conversations WHERE role = 'user')
"""

# White space for RE2, and for trim().
RWS = r"[\t-\r \x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]"
TRIM_SET = "'" + WS_CHARS + "'"


def sql_trim(expression: str) -> str:
    return f"trim({expression}, {TRIM_SET})"


def sql_decode(expression: str, nbsp: bool = False) -> str:
    pairs = [("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&"), ("&quot;", '"'), ("&#39;", "''")]
    if nbsp:
        pairs.append(("&nbsp;", " "))
    for entity, char in pairs:
        expression = f"replace({expression}, '{entity}', '{char}')"
    return expression


def sql_group(text: str, pattern: str) -> str:
    """Group 1 of the first match or NULL."""
    escaped = pattern.replace("'", "''")
    return f"nullif(regexp_extract({text}, '{escaped}', 1), '')"


def sql_normalize(expression: str) -> str:
    expression = rf"regexp_replace({expression}, '\r\n?', chr(10), 'g')"
    expression = f"replace({expression}, chr(160), ' ')"
    expression = rf"regexp_replace({expression}, '[ \t]+', ' ', 'g')"
    expression = rf"regexp_replace({expression}, '\n{{3,}}', chr(10) || chr(10), 'g')"
    return sql_trim(expression)
