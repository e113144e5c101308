"""Queries on rendering (J), data quality (K), usage (L) and streaming (M)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fixed_values as fixed
from ..functions import text
from ..operators import chunking, quality, render, usage
from ..session import materialize, scratch_dir, shuffles_dropped
from ..sources import manifest
from ..streaming import jobs
from .base import DOCUMENTS_SQL, Tables, register, sql_trim
from .ingest import pack_documents, walk_sql, zipped


# --- J ----------------------------------------------------------------------


def rendered_source(t: Tables):
    raw = t.raw_documents()
    return raw.select(
        F.col("doc_id").alias("id"), text.extract_title("raw").alias("title"),
        text.extract_date("raw").alias("document_date"), F.col("raw").alias("content"),
    )


@register("j1_render_markdown")
def markdown(t: Tables):
    return render.render_markdown(rendered_source(t))


@register("j2_outline")
def outline(t: Tables):
    return render.outline(rendered_source(t))


# --- K ----------------------------------------------------------------------

LABELLED_SQL = """labelled AS (SELECT doc_id AS id, source AS archive_filename, text AS content,
  CASE WHEN quality = 1 THEN lang END AS law_type, toxic AS year, e.embedding
  FROM documents LEFT JOIN labels USING (doc_id) LEFT JOIN embeddings e ON e.vec_id = doc_id)"""


def labelled(t: Tables):
    labels = t.read("labels").select(F.col("doc_id").alias("id"), "quality", "toxic")
    joined = t.embedded_documents().drop("year").join(labels, "id", "left")
    return joined.withColumn("law_type", F.when(F.col("quality") == 1, F.col("law_type"))).withColumnRenamed("toxic", "year")


def coverage_sql(column: str) -> str:
    return (
        f"SELECT 'documents' AS table_name, '{column}' AS column_name, count(*) AS total, count(*) - count({column}) AS missing, "
        f"count({column}) AS present, coalesce(round((count(*) - count({column})) * 100.0 / nullif(count(*), 0), 1), 0) AS percent_missing FROM labelled"
    )


@register("k1_null_coverage", f"WITH {LABELLED_SQL} " + " UNION ALL ".join(coverage_sql(c) for c in ("law_type", "year", "embedding")))
def null_coverage(t: Tables):
    return quality.null_coverage(labelled(t), ["law_type", "year", "embedding"], "documents")


@register(
    "k2_embedding_coverage",
    f"""WITH {LABELLED_SQL} SELECT count(*) AS total, count(embedding) AS with_embedding, count(*) - count(embedding) AS without_embedding,
    coalesce(round(count(embedding) * 100.0 / nullif(count(*), 0), 1), 0) AS percent_with FROM labelled""",
)
def embedding_coverage(t: Tables):
    return quality.embedding_coverage(labelled(t))


@register("k3_value_distribution", f"WITH {LABELLED_SQL} SELECT law_type AS value, count(*) AS n FROM labelled GROUP BY 1")
def distribution(t: Tables):
    return quality.value_distribution(labelled(t), "law_type")


@register(
    "k4_grain_comparison",
    f"""WITH RECURSIVE {DOCUMENTS_SQL}, {walk_sql(1000, 200, True)}, {LABELLED_SQL},
    d AS (SELECT law_type, count(*) AS n FROM labelled WHERE law_type <> 'fr' OR law_type IS NULL GROUP BY 1),
    c AS (SELECT law_type, count(*) AS n FROM walk JOIN labelled USING (id) WHERE law_type <> 'de' OR law_type IS NULL GROUP BY 1)
    SELECT coalesce(d.law_type, c.law_type) AS value, coalesce(d.n, 0) AS documents, coalesce(c.n, 0) AS chunks
    FROM d FULL JOIN c ON d.law_type IS NOT DISTINCT FROM c.law_type""",
)
def grains(t: Tables):
    rows = labelled(t)
    chunks = chunking.chunk_documents(rows.select("id", "content", "law_type"), 1000)
    other = lambda value: (F.col("law_type") != value) | F.col("law_type").isNull()
    return quality.grain_comparison(rows.where(other("fr")), chunks.where(other("de")))


@register(
    "k5_reconcile_counts",
    """WITH a AS (SELECT o_orderkey AS orderkey, count(*) AS n FROM orders WHERE o_orderstatus <> 'P' GROUP BY 1),
    b AS (SELECT l_orderkey AS orderkey, count(*) AS n FROM lineitem WHERE l_linenumber <= 2 GROUP BY 1)
    SELECT orderkey, coalesce(a.n, 0) AS left_rows, coalesce(b.n, 0) AS right_rows, coalesce(a.n, 0) = coalesce(b.n, 0) AS matches FROM a FULL JOIN b USING (orderkey)""",
)
def reconcile(t: Tables):
    orders = t.read("orders").where("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("orderkey"))
    lines = t.read("lineitem").where("l_linenumber <= 2").select(F.col("l_orderkey").alias("orderkey"))
    return quality.reconcile_counts(orders, lines, "orderkey")


@register(
    "k5_reconcile_lines",
    """WITH a AS (SELECT o_orderkey AS orderkey, count(*) AS n FROM orders GROUP BY 1),
    b AS (SELECT l_orderkey AS orderkey, count(*) AS n FROM lineitem GROUP BY 1)
    SELECT orderkey, coalesce(a.n, 0) AS left_rows, coalesce(b.n, 0) AS right_rows, coalesce(a.n, 0) = coalesce(b.n, 0) AS matches FROM a FULL JOIN b USING (orderkey)""",
)
def reconcile_lines(t: Tables):
    """All orders against all lines."""
    orders = t.read("orders").select(F.col("o_orderkey").alias("orderkey"))
    return quality.reconcile_counts(orders, t.read("lineitem").select(F.col("l_orderkey").alias("orderkey")), "orderkey")


@register(
    "k5_archive_counts",
    """WITH a AS (SELECT source, count(*) AS n FROM documents GROUP BY 1), b AS (SELECT source, count(*) AS n FROM documents JOIN labels USING (doc_id) WHERE toxic = 1 GROUP BY 1)
    SELECT source, a.n AS left_rows, coalesce(b.n, 0) AS right_rows, a.n = coalesce(b.n, 0) AS matches FROM a LEFT JOIN b USING (source)""",
)
def archive_counts(t: Tables):
    documents = t.read("documents").select("doc_id", "source")
    toxic = documents.join(t.read("labels").where("toxic = 1").select("doc_id"), "doc_id", "left_semi")
    return quality.reconcile_counts(documents, toxic, "source")


@register(
    "k6_reconcile_totals",
    """SELECT (SELECT count(*) FROM lineitem) AS left_total, (SELECT count(*) FROM orders) AS right_total,
    (SELECT count(*) FROM lineitem) - (SELECT count(*) FROM orders) AS difference, (SELECT count(*) FROM lineitem) = (SELECT count(*) FROM orders) AS matches""",
)
def totals(t: Tables):
    return quality.reconcile_totals(t.read("lineitem"), t.read("orders"))


COPY_SQL = f"""{DOCUMENTS_SQL}, copied AS (
  SELECT archive_filename, member, CASE WHEN law_type = 'es' THEN upper(content) WHEN law_type = 'fr' THEN '  ' || replace(content, ' ', '  ') ELSE content END AS content,
    CASE WHEN id % 10 = 1 THEN NULL ELSE title END AS title, CASE WHEN id % 10 = 2 THEN '2020' END AS document_date
  FROM docs WHERE archive_filename <> 'src9'),
compared AS (SELECT d.id, d.archive_filename, d.member, CASE WHEN c.archive_filename IS NULL THEN 'not found'
    WHEN regexp_replace({sql_trim('d.content')}, '\\s+', ' ', 'g') <> regexp_replace({sql_trim('c.content')}, '\\s+', ' ', 'g') THEN 'content differs'
    WHEN d.title IS DISTINCT FROM c.title OR d.document_date IS DISTINCT FROM c.document_date
      THEN 'metadata differs (title: ' || (d.title IS NOT DISTINCT FROM c.title) || ', date: ' || (d.document_date IS NOT DISTINCT FROM c.document_date) || ')' END AS reason
  FROM docs d LEFT JOIN copied c USING (archive_filename, member))"""


def copied(t: Tables):
    content = (
        F.when(F.col("law_type") == "es", F.upper("content"))
        .when(F.col("law_type") == "fr", F.concat(F.lit("  "), F.replace("content", F.lit(" "), F.lit("  "))))
        .otherwise(F.col("content"))
    )
    changed = t.documents().where("archive_filename <> 'src9'").withColumns(
        {
            "content": content,
            "title": F.when(F.col("id") % 10 != 1, F.col("title")),
            "document_date": F.when(F.col("id") % 10 == 2, "2020"),
        }
    )
    return changed


@register("k7_reconcile_content", f"WITH {COPY_SQL} SELECT id, archive_filename, member, reason FROM compared")
def content(t: Tables):
    return quality.reconcile_content(t.documents(), copied(t), first=None)


@register("k7_reconcile_first", f"WITH {COPY_SQL} SELECT id, archive_filename, member, reason FROM compared ORDER BY id LIMIT 10")
def first_contents(t: Tables):
    """The spot check of the first documents, which is the operator's default."""
    return quality.reconcile_content(t.documents(), copied(t), first=10)


FILES_SQL = """archives AS (SELECT DISTINCT source AS filename FROM documents),
stored_files AS (SELECT DISTINCT source AS filename FROM documents JOIN labels USING (doc_id) WHERE toxic = 1 AND quality = 0)"""


def stored_files(t: Tables):
    labels = t.read("labels").where("toxic = 1 and quality = 0").select("doc_id")
    kept = t.read("documents").join(labels, "doc_id", "left_semi")
    archives = t.read("documents").select(F.col("source").alias("filename")).distinct()
    return archives, kept.select(F.concat_ws("/", "source", "doc_id").alias("path"))


@register("k8_missing_files", f"WITH {FILES_SQL} SELECT filename FROM archives WHERE filename NOT IN (SELECT filename FROM stored_files)")
def missing_files(t: Tables):
    return quality.missing_files(*stored_files(t))


@register(
    "k9_reconcile_verdict",
    f"""WITH {COPY_SQL}, {FILES_SQL}, n AS (SELECT source, count(*) AS a FROM documents GROUP BY 1)
    SELECT true AS counts_ok, (SELECT count(*) FROM docs) = (SELECT count(*) FROM copied) AS totals_ok,
      (SELECT count(*) FROM archives WHERE filename NOT IN (SELECT filename FROM stored_files)) = 0 AS files_ok,
      (SELECT count(reason) FROM compared) = 0 AS contents_ok, false AS success""",
)
def verdict(t: Tables):
    documents, copies = t.documents(), copied(t)
    return quality.reconcile_verdict(
        quality.reconcile_counts(documents, documents, "archive_filename"),
        quality.reconcile_totals(documents, copies),
        quality.missing_files(*stored_files(t)),
        quality.reconcile_content(documents, copies, first=None),
    )


@register("k_stored_types")
def stored_types(t: Tables):
    """Number and size of the given files by content type."""
    files = manifest.file_manifest(t.spark, t.sf_dir, checksum=False)
    return files.groupBy("content_type").agg(F.count("*").alias("n"), F.sum("length").alias("bytes"))


# --- L ----------------------------------------------------------------------

CONSENTS_SQL = """consents AS (SELECT event_id, user_id, ts AS consent_date, event_type IN ('click', 'view', 'signup') AS data_processing,
  CASE WHEN event_type <> 'view' THEN value > 5 END AS data_storage, CASE WHEN event_type = 'click' THEN true END AS data_sharing,
  CASE WHEN event_type = 'signup' THEN value > 20 END AS marketing FROM events)"""


def consents(t: Tables, events=None):
    events = t.read("events") if events is None else events
    kind = F.col("event_type")
    return events.select(
        "event_id", "user_id", F.col("ts").alias("consent_date"),
        kind.isin("click", "view", "signup").alias("data_processing"),
        F.when(kind != "view", F.col("value") > 5).alias("data_storage"),
        F.when(kind == "click", True).alias("data_sharing"),
        F.when(kind == "signup", F.col("value") > 20).alias("marketing"),
    )


@register(
    "l1_validate_consents",
    f"""WITH {CONSENTS_SQL} SELECT event_id, coalesce(data_processing AND data_storage, false) AS accepted, coalesce(data_sharing, false) AS data_sharing,
    coalesce(marketing, false) AS marketing, consent_date, '1.0' AS version FROM consents""",
)
def validate(t: Tables):
    accepted, rejected = usage.validate_consents(consents(t))
    columns = ["event_id", "accepted", "data_sharing", "marketing", "consent_date", "version"]
    return accepted.withColumn("accepted", F.lit(True)).select(*columns).unionByName(
        rejected.withColumn("accepted", F.lit(False)).select(*columns)
    )


LATEST_SQL = f"""{CONSENTS_SQL}, latest AS (SELECT * FROM consents QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY consent_date DESC, event_id DESC) = 1)"""


@register("l2_latest_consent", f"WITH {LATEST_SQL} SELECT user_id, event_id, consent_date, data_processing FROM latest")
def latest(t: Tables):
    return usage.latest_consent(consents(t), ["consent_date", "event_id"]).select("user_id", "event_id", "consent_date", "data_processing")


PRINCIPALS_SQL = """principals AS (SELECT 'u' || user_id AS principal, 'user' AS role, user_id FROM (SELECT user_id FROM events WHERE event_type = 'signup' GROUP BY 1)
  UNION ALL SELECT 'service-' || lang, 'service', NULL FROM (SELECT DISTINCT lang FROM documents WHERE lang <> 'en'))"""


@register(
    "l3_consent_scope",
    f"""WITH {LATEST_SQL}, {PRINCIPALS_SQL} SELECT principal, c.user_id, event_id FROM principals p JOIN latest c ON p.user_id = c.user_id OR p.role = 'service'""",
)
def scope(t: Tables):
    current = usage.latest_consent(consents(t), ["consent_date", "event_id"]).select("user_id", "event_id")
    users = t.read("events").where("event_type = 'signup'").select("user_id").distinct()
    services = t.read("documents").where("lang <> 'en'").select("lang").distinct()
    principals = users.select(F.concat(F.lit("u"), "user_id").alias("principal"), F.lit("user").alias("role"), "user_id").unionByName(
        services.select(F.concat(F.lit("service-"), "lang").alias("principal"), F.lit("service").alias("role"), F.lit(None).cast("long").alias("user_id"))
    )
    return usage.consent_scope(current, principals)


@register("l3_scope_of_service", f"WITH {LATEST_SQL} SELECT user_id, event_id FROM latest")
def scope_of_service(t: Tables):
    current = usage.latest_consent(consents(t), ["consent_date", "event_id"]).select("user_id", "event_id")
    return usage.scope_of(current, "service")


def traces(t: Tables):
    return t.read("events").select(
        F.col("event_type").alias("name"), F.when(F.col("value") > 50, "chain").otherwise("tool").alias("run_type"),
        F.when(F.col("event_type") == "error", "error").otherwise("success").alias("status"), (F.col("value") / 10).alias("seconds"),
    )


TRACES_SQL = """traces AS (SELECT event_type AS name, CASE WHEN value > 50 THEN 'chain' ELSE 'tool' END AS run_type,
  CASE WHEN event_type = 'error' THEN 'error' ELSE 'success' END AS status, value / 10 AS seconds FROM events)"""
BOUNDS_SQL = ", ".join(f"({bound}, '{bound}')" for bound in fixed.DURATION_BUCKETS) + ", (CAST('Infinity' AS DOUBLE), '+Inf')"


@register(
    "l4_duration_histogram",
    f"""WITH {TRACES_SQL} SELECT name, run_type, status, le, count(*) FILTER (seconds <= bound) AS n
    FROM traces CROSS JOIN (VALUES {BOUNDS_SQL}) b(bound, le) GROUP BY 1, 2, 3, 4""",
)
def histogram(t: Tables):
    return usage.duration_histogram(traces(t), ["name", "run_type", "status"])


@register(
    "l4_duration_summary",
    f"""WITH {TRACES_SQL} SELECT name, run_type, count(*) AS n, round(sum(seconds), 6) AS total_seconds,
    quantile_disc(seconds, 0.5) AS p50, quantile_disc(seconds, 0.95) AS p95 FROM traces GROUP BY 1, 2""",
)
def duration_summary(t: Tables):
    found = usage.duration_summary(traces(t), ["name", "run_type"])
    return found.withColumn("total_seconds", F.round("total_seconds", 6))


@register("l5_error_counts", f"WITH {TRACES_SQL} SELECT name, run_type, count(*) AS errors FROM traces WHERE status = 'error' GROUP BY 1, 2")
def errors(t: Tables):
    return usage.error_counts(traces(t), ["name", "run_type"])


@register(
    "l6_timing_log_summary",
    """SELECT event_type AS operation, count(*) AS n, round(avg(value), 6) AS mean_ms, max(value) AS max_ms FROM events
    WHERE CAST(json_extract(props, '$.k') AS INT) % 2 = 0 GROUP BY 1""",
)
def timing(t: Tables):
    """Writes the events as a timing log in JSON lines, then sums the log up."""
    k = F.get_json_object("props", "$.k").cast("int")
    state = F.when(k % 2 == 0, "Completed").otherwise("Starting")
    lines = t.read("events").select(
        F.to_json(
            F.struct(
                F.lit(30).alias("level"),
                F.concat(F.lit("[TIMING] "), state, F.lit(": "), "event_type").alias("msg"),
                F.col("event_type").alias("operation"),
                F.when(k % 2 == 0, F.col("value")).alias("durationMs"),
            )
        ).alias("value")
    )
    path = scratch_dir(t.spark, "timing-log")
    lines.write.text(path)
    summary = usage.timing_log_summary(t.spark.read.schema(usage.TIMING_SCHEMA).json(path))
    return summary.withColumn("mean_ms", F.round("mean_ms", 6))


REQUESTS_SQL = """requests AS (SELECT ts, CASE WHEN event_type = 'view' THEN 'anonymous' ELSE 'user:' || user_id END AS requester FROM events)"""
WINDOWS_SQL = f"""WITH {REQUESTS_SQL} SELECT requester, time_bucket(INTERVAL 15 MINUTE, ts) AS window_start, count(*) AS requests, count(*) > 3 AS over_limit
FROM requests GROUP BY 1, 2"""


def requests(events):
    user = F.when(F.col("event_type") != "view", F.col("user_id"))
    return events.select("ts", usage.request_key(user, F.lit("::ffff:anonymous")).alias("requester"))


@register("l7_request_windows", WINDOWS_SQL)
def windows(t: Tables):
    return usage.request_windows(requests(t.read("events")), limit=3)


# --- M ----------------------------------------------------------------------


def event_stream(t: Tables):
    events = t.read("events")
    return t.spark.readStream.schema(events.schema).parquet(f"{t.sf_dir}/events.parquet*")


@register(
    "m1_ingest_stream",
    "SELECT 'd' || doc_id || '.xml' AS member, length(text) > 0 AS has_text, doc_id % 2 = 0 AS in_first_run FROM documents",
)
def ingest_stream(t: Tables):
    """Packs the documents into archives in two runs; the second run of the job reads only the new ones."""
    arriving, target, state = (scratch_dir(t.spark, name) for name in ("archives", "ingested", "ingest-state"))
    seen = None
    for run in (0, 1):
        packed = pack_documents(t.documents().where(F.col("id") % 2 == run), f"run{run}")
        packed.write.mode("append").parquet(arriving)
        files = t.spark.readStream.schema("archive_filename string, content binary").parquet(arriving)
        jobs.ingest_stream(files, target, state).awaitTermination()
        if run == 0:
            seen = t.spark.read.parquet(f"{target}/documents").select("archive_filename").distinct()
            seen = materialize(seen.withColumn("first", F.lit(True)), "first-run")
    documents = t.spark.read.parquet(f"{target}/documents").join(seen, "archive_filename", "left")
    return documents.select(
        "member", (F.length("content") > 0).alias("has_text"), F.col("first").isNotNull().alias("in_first_run")
    )


@register("m2_request_windows_stream", WINDOWS_SQL)
def windows_stream(t: Tables):
    out, state = scratch_dir(t.spark, "windows"), scratch_dir(t.spark, "windows-state")
    timed = event_stream(t).withColumn("ts", F.col("ts").cast("timestamp"))
    jobs.request_windows_stream(requests(timed), out, state, delay="40 days", limit=3).awaitTermination()
    newest = jobs.newest_rows(t.spark, out, ["requester", "window_start"])
    return newest.withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@register("m3_latest_consent_stream", f"WITH {LATEST_SQL} SELECT user_id, event_id, consent_date, data_processing FROM latest")
def consent_stream(t: Tables):
    out, state = scratch_dir(t.spark, "consents"), scratch_dir(t.spark, "consents-state")
    stream = consents(t, event_stream(t))
    query = jobs.latest_consent_stream(stream, out, state, ["consent_date", "event_id"])
    query.awaitTermination()
    newest = query.lastProgress["batchId"]
    return t.spark.read.parquet(f"{out}/batch={newest}").select("user_id", "event_id", "consent_date", "data_processing")


COUNTED = ["documents", "recorded", "rejects", "errors"]
BLOCK = 1000


@register(
    "m1_ingest_replaced",
    f"""WITH archives AS (SELECT source || '-' || doc_id // {BLOCK} AS archive, source, count(*) AS n,
      CAST(substr(source, 4) AS INT) % 2 = 1 AS odd FROM documents GROUP BY ALL)
    SELECT archive AS archive_filename, CASE WHEN odd THEN n ELSE 0 END AS documents, CASE WHEN odd THEN n ELSE 0 END AS recorded,
      CASE WHEN odd THEN 0 ELSE n END AS rejects, 0 AS errors FROM archives
    UNION ALL SELECT 'first-' || archive, n, n, 0, 0 FROM archives
    UNION ALL SELECT DISTINCT 'broken-' || source, 0, 0, 0, 1 FROM archives""",
)
def ingest_replaced(t: Tables):
    """Counts per archive in the tables of an ingest in two runs, where the second replaces archives of the first.

    An archive holds the documents of a source and a block of ids.  The first run brings each twice, under two names.
    The second brings one of them again: for odd sources the same, for even ones only members with too long a name,
    so that the archive is emptied; and a broken archive for each source.
    """
    arriving, target, state = (scratch_dir(t.spark, name) for name in ("archives", "ingested", "ingest-state"))
    archive = F.concat_ws("-", "archive_filename", F.floor(F.col("id") / BLOCK))
    given = t.documents().select("archive_filename", archive.alias("archive"), "member", F.coalesce("content", F.lit("")).alias("content"))
    odd = F.substring("archive_filename", 4, 9).cast("int") % 2 == 1
    too_long = F.concat(F.repeat(F.lit("m"), 1001), "member")
    both = F.explode(F.array("archive_filename", F.concat(F.lit("first-"), "archive_filename"))).alias("archive_filename")
    first = zipped(given.drop("archive_filename")).select(both, "content")
    again = given.withColumn("member", F.when(odd, F.col("member")).otherwise(too_long)).drop("archive_filename")
    broken = given.select(F.concat(F.lit("broken-"), "archive_filename", F.lit(".zip")).alias("archive_filename")).distinct()
    broken = broken.withColumn("content", F.lit("none").cast("binary"))
    for arrived in (first, zipped(again).unionByName(broken)):
        with shuffles_dropped(t.spark):
            arrived.write.mode("append").parquet(arriving)
        files = t.spark.readStream.schema("archive_filename string, content binary").parquet(arriving)
        jobs.ingest_stream(files, target, state).awaitTermination()
    parts = None
    for table, name in (("documents", "documents"), ("archives", "recorded"), ("rejects", "rejects"), ("errors", "errors")):
        found = F.col("document_count") if name == "recorded" else F.lit(1).cast("long")
        counts = [(found if other == name else F.lit(0).cast("long")).alias(other) for other in COUNTED]
        key = F.replace(F.col(jobs.INGESTED[table]), F.lit(".zip"), F.lit("")).alias("archive_filename")
        part = jobs.ingested(t.spark, target, table).select(key, *counts)
        parts = part if parts is None else parts.unionByName(part)
    return parts.groupBy("archive_filename").agg(*[F.sum(name).alias(name) for name in COUNTED])


@register("m3_consents_over_batches", f"WITH {LATEST_SQL} SELECT user_id, event_id, consent_date, data_processing FROM latest")
def consents_over_batches(t: Tables):
    """The events arrive in four files without order, one per batch, so old users come again and older records late."""
    arriving, out, state = (scratch_dir(t.spark, name) for name in ("events", "consents", "consents-state"))
    events = t.read("events")
    events.repartition(4, F.xxhash64("event_id")).write.parquet(arriving)
    stream = t.spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(arriving)
    jobs.latest_consent_stream(consents(t, stream), out, state, ["consent_date", "event_id"]).awaitTermination()
    return jobs.newest_rows(t.spark, out, ["user_id"]).select("user_id", "event_id", "consent_date", "data_processing")


@register(
    "m2_late_requests",
    f"""WITH {REQUESTS_SQL.replace('FROM events', ', event_id % 5 = 0 AS late FROM events')},
    seen AS (SELECT max(ts) - INTERVAL 10 DAY AS watermark FROM requests WHERE NOT late)
    SELECT requester, time_bucket(INTERVAL 15 MINUTE, ts) AS window_start, count(*) AS requests, count(*) > 3 AS over_limit
    FROM requests, seen WHERE NOT late OR time_bucket(INTERVAL 15 MINUTE, ts) + INTERVAL 15 MINUTE > watermark GROUP BY 1, 2""",
)
def late_requests(t: Tables):
    """A fifth of the events arrives after all others; of these, windows that ended ten days before stay as they were."""
    arriving, out, state = (scratch_dir(t.spark, name) for name in ("events", "windows", "windows-state"))
    events = t.read("events").withColumn("ts", F.col("ts").cast("timestamp"))
    for late in (False, True):
        events.where((F.col("event_id") % 5 == 0) == late).write.mode("append").parquet(arriving)
        stream = t.spark.readStream.schema(events.schema).parquet(arriving)
        jobs.request_windows_stream(requests(stream), out, state, delay="10 days", limit=3).awaitTermination()
    newest = jobs.newest_rows(t.spark, out, ["requester", "window_start"])
    return newest.withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@register(
    "m4_dedupe_stream",
    "SELECT DISTINCT user_id AS question_id, event_type AS title, 'f' || CAST(floor(value / 20) AS INT) AS filename FROM events",
)
def dedupe_stream(t: Tables):
    out, state = scratch_dir(t.spark, "evidence"), scratch_dir(t.spark, "evidence-state")
    evidence = event_stream(t).select(
        F.col("ts").cast("timestamp").alias("ts"), F.col("user_id").alias("question_id"), F.col("event_type").alias("title"),
        F.concat(F.lit("f"), F.floor(F.col("value") / 20).cast("int")).alias("filename"),
        F.lit(None).cast("string").alias("member"), F.lit(None).cast("string").alias("snippet"),
    )
    jobs.dedupe_stream(evidence, out, state, delay="40 days").awaitTermination()
    return t.spark.read.parquet(out).select("question_id", "title", "filename")
