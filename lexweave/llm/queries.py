"""The registered queries of this subpackage: one per operator, over whole tables, with SQL twins where SQL can say them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    divergence,
    fingerprints,
    golay_simhash,
    line_dedup,
    media,
    ngram_join,
    packing,
    quality,
    sentencepiece,
    toxicity,
    url_filter,
    warc,
    whitening,
)
from .common import LOWER, UPPER, read

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(build: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[build.__name__] = build
    return build


# Rules the url query is asked with.
URL_RULES = [
    ("com/en/", "block"),
    ("example.com/en/7", "allow"),
    ("net/de/", "allow"),
    ("example.net/de/8", "block"),
    ("org/es/", "block"),
]


@register
def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "rule string, action string")
    pages = read(spark, sf_dir, "pages").select("page_id", "url")
    return url_filter.judge(pages, rules).select("page_id", "host", "path", "rule", "verdict")


ORACLES["op1_url_filter"] = f"""
WITH rules(rule, action) AS (VALUES {", ".join(str(rule) for rule in URL_RULES)}),
parts AS (
  SELECT page_id,
         coalesce(translate(regexp_extract(url, '://([^/?#]*)', 1), '{UPPER}', '{LOWER}'), '') AS host,
         coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages),
fits AS (
  SELECT page_id, max(struct_pack(n := length(rule), rule := rule, action := action)) AS best
  FROM parts, rules
  WHERE (host = split_part(rule, '/', 1) OR ends_with(host, '.' || split_part(rule, '/', 1)))
    AND starts_with(path, substr(rule, strpos(rule, '/')))
  GROUP BY page_id)
SELECT page_id, host, path, best.rule AS rule, coalesce(best.action, 'allow') AS verdict
FROM parts LEFT JOIN fits USING (page_id)
"""


@register
def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup.dedup_lines(docs, words=line_dedup.PASSAGE_WORDS)


@register
def op2_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = media.to_media(read(spark, sf_dir, "documents"))
    return media.read_media(stored, keep=("n_bytes",)).select(
        "doc_id",
        "n_bytes",
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.substring("payload", -64, 64)).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        F.lower(F.hex("cosine_hash")).alias("feature"),
    )


@register
def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack_documents(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return packed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


@register
def op6_syncmer_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = fingerprints.fingerprint_edits(read(spark, sf_dir, "documents"))
    return marked.select(
        "doc_id",
        F.char_length("text").cast("long").alias("n_chars"),
        F.sha2(F.encode("edited_text", "UTF-8"), 256).alias("edited_sha256"),
        fingerprints.digest(F.col("anchors")).alias("fingerprint"),
        fingerprints.digest(F.col("edited_anchors")).alias("edited_fingerprint"),
        fingerprints.likeness(F.col("anchors"), F.col("edited_anchors")).alias("near_edited"),
        fingerprints.likeness(F.col("anchors"), F.col("next_anchors")).alias("near_next"),
    )


@register
def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = warc.archive(read(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return warc.read_archives(spark, files).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"
    )


ORACLES["op7_warc"] = f"""
WITH payloads AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest
  FROM pages),
firsts AS (
  SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM payloads)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= {warc.MIN_BYTES} AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= {warc.MIN_BYTES} AND page_id <> first THEN first END AS refers_to
FROM firsts
"""


@register
def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read(spark, sf_dir, "documents").select("doc_id", "text"), read(spark, sf_dir, "labels")
    return toxicity.score(docs, labels).select(
        "doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted"
    )


@register
def op3_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicates(read(spark, sf_dir, "documents"))


ORACLES["op3_ngram_jaccard_join"] = rf"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(
    regexp_split_to_array(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) END AS s
  FROM words),
grams AS (SELECT doc_id, len(s) AS n, unnest(s) AS gram FROM sets),
pairs AS (
  SELECT a.doc_id AS low, b.doc_id AS high
  FROM grams a JOIN grams b ON a.gram = b.gram AND a.doc_id < b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n
  HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
links AS (SELECT low AS a, high AS b FROM pairs UNION ALL SELECT high, low FROM pairs),
reached(doc_id, other) AS (
  SELECT doc_id, doc_id FROM documents
  UNION
  SELECT reached.doc_id, links.b FROM reached JOIN links ON reached.other = links.a)
SELECT doc_id, len(s) AS n_shingles, component_id
FROM sets JOIN (SELECT doc_id, min(other) AS component_id FROM reached GROUP BY doc_id) USING (doc_id)
"""


@register
def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return quality.score(docs).select("doc_id", F.round("quality", 6).alias("quality"), "keep")


@register
def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = sentencepiece.encode(read(spark, sf_dir, "documents").select("doc_id", "text"))
    back = sentencepiece.decode(coded)
    return back.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_ids"),
        F.lower(F.hex(F.xxhash64("ids"))).alias("ids_hash"),
        (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("round_trip"),
    )


@register
def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(read(spark, sf_dir, "embeddings"))


@register
def op12_golay_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = golay_simhash.near_duplicates(read(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@register
def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(read(spark, sf_dir, "documents").select("text", "lang", "source"))


ORACLES["op13_source_divergence"] = rf"""
WITH docs AS (
  SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS text
  FROM documents),
occurrences AS (
  SELECT row, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM docs),
kept AS (
  SELECT lang, term, count(*) AS n FROM occurrences GROUP BY lang, term HAVING count(DISTINCT row) >= 3),
counts AS (
  SELECT lang, source, term, count(*) AS n FROM occurrences GROUP BY lang, source, term),
langs AS (SELECT lang, count(*) AS v, sum(n) AS total FROM kept GROUP BY lang),
groups AS (SELECT DISTINCT lang, source FROM docs),
totals AS (
  SELECT lang, source, sum(counts.n) AS total
  FROM counts JOIN kept USING (lang, term) GROUP BY lang, source),
grid AS (
  SELECT lang, source, term, coalesce(counts.n, 0) AS n,
         1 + (1000000000::HUGEINT * (coalesce(counts.n, 0) + 1)) // (coalesce(totals.total, 0) + v) AS p,
         1 + (1000000000::HUGEINT * (kept.n + 1)) // (langs.total + v) AS q
  FROM groups JOIN kept USING (lang) JOIN langs USING (lang)
  LEFT JOIN totals USING (lang, source) LEFT JOIN counts USING (lang, source, term)),
found AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item,
         coalesce((SELECT sum((x.p - y.p) * (x.p - y.p) // y.p) FROM grid x JOIN grid y ON x.lang = y.lang AND x.term = y.term
                   WHERE x.lang = a.lang AND x.source = a.source AND y.source = b.source), 0)::BIGINT AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  UNION ALL
  SELECT lang, source, 'term', term, ((p - q) * (p - q) // q)::BIGINT FROM grid WHERE n > 0 AND p > q),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank FROM found)
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= {divergence.TOP_TERMS}
"""
