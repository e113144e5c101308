"""Evidence of questions: building, deduplicating, hydrating, packing, citing.

Evidence is ``(question_id, seq, id, source, title, snippet, date, link,
filename, member)``; ``seq`` is the order of arrival within the question.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed_values as fixed
from ..functions import links, text
from ..session import materialize, small_side

MAX_EVIDENCE, MAX_QUESTION = 100, 5000
MAX_CONTENT, MAX_PROMPT, PROMPT_OVERHEAD, MIN_EVIDENCE_SPACE = 3000, 50000, 200, 10000
SHORT_TAIL = 500


def hits_to_evidence(hits: DataFrame, source: str, base_url: str) -> DataFrame:
    """Evidence from search hits; ids restart at 1 in every search and are told apart by it.

    ``hits`` has ``(question_id, search_seq, rank, filename, member, title, date, snippet, url)``.
    """
    window = Window.partitionBy("question_id", "search_seq").orderBy("rank")
    number = F.row_number().over(window)
    return hits.select(
        "question_id",
        "search_seq",
        number.alias("n"),
        F.concat(F.lit(source + "-"), F.col("search_seq"), F.lit("-"), number).alias("id"),
        F.lit(source).alias("source"),
        F.coalesce("title", "filename", F.lit(fixed.UNTITLED)).alias("title"),
        "snippet",
        "date",
        links.sanitize_link(
            F.coalesce(text.null_if_empty("url"), links.viewer_url("filename", "member", base_url))
        ).alias("link"),
        "filename",
        "member",
    )


def web_to_evidence(results: DataFrame, source: str, label: str) -> DataFrame:
    """Evidence from web results; only document links, numbered after the filter."""
    is_document = links.is_document_link("link")
    if "is_document" in results.columns:
        is_document = F.coalesce("is_document", is_document)
    kept = results.where((F.col("link") != "") & is_document)
    window = Window.partitionBy("question_id", "search_seq").orderBy("rank")
    number = F.row_number().over(window)
    return kept.select(
        "question_id",
        "search_seq",
        number.alias("n"),
        F.concat(F.lit(label + "-"), F.col("search_seq"), F.lit("-"), number).alias("id"),
        F.lit(source).alias("source"),
        F.coalesce("title", F.lit(fixed.UNTITLED)).alias("title"),
        "snippet",
        "date",
        links.sanitize_link("link").alias("link"),
        F.lit(None).cast("string").alias("filename"),
        F.lit(None).cast("string").alias("member"),
    )


def first_per_key(df: DataFrame, keys: list, order: list) -> DataFrame:
    """The first row of every key; each map task keeps one row per key before the shuffle."""
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__n", F.row_number().over(window)).where("__n = 1").drop("__n")


def evidence_key() -> list[Column]:
    return [
        F.coalesce("filename", F.lit("")),
        F.coalesce("member", F.lit("")),
        F.coalesce("title", F.lit("")),
        text.head(F.coalesce("snippet", F.lit("")), 100),
    ]


def dedupe_evidence(evidence: DataFrame, simple_key: bool = False) -> DataFrame:
    """First evidence per (file, member, title, start of the snippet) of a question."""
    key = evidence_key()[:2] if simple_key else evidence_key()
    return first_per_key(evidence, ["question_id", *key], ["seq"])


def dedupe_by_link(evidence: DataFrame) -> DataFrame:
    """First evidence per link of a question; evidence without a link is dropped."""
    linked = evidence.where(text.null_if_empty("link").isNotNull())
    return first_per_key(linked, ["question_id", "link"], ["seq"])


def refine_evidence(evidence: DataFrame, replaced: list[str] | None = None) -> DataFrame:
    """Keep only the evidence of the newest search of each source.

    ``replaced`` limits this to some sources; evidence of others stays.
    """
    latest = evidence.groupBy("question_id", "source").agg(F.max("search_seq").alias("latest"))
    joined = evidence.join(latest, ["question_id", "source"])
    stays = F.col("search_seq") == F.col("latest")
    if replaced is not None:
        stays = stays | ~F.col("source").isin(replaced)
    return joined.where(stays).select(*evidence.columns)


def hydrate_evidence(evidence: DataFrame, documents: DataFrame, base_url: str, limit: int = 20000) -> DataFrame:
    """Evidence with the (shortened) content of its document, links and members as ``.html``.

    An ``.html`` member is looked up as ``.xml`` first and as itself otherwise.
    Only the wanted documents are read in full: their keys are sent to the scan.  The evidence, which has no texts
    yet, is written once, as its keys and its rows are needed apart.
    """
    evidence = materialize(evidence, "evidence")
    wanted = evidence.where("filename is not null and member is not null")
    # both spellings of a member are one key, so a single equi-join finds either
    spelled = links.xml_member("member")
    keys = wanted.select(F.col("filename").alias("archive_filename"), spelled.alias("key")).distinct()
    contents = (
        documents.select("archive_filename", "member", "content")
        .withColumn("key", spelled)
        .join(small_side(keys), ["archive_filename", "key"], "left_semi")
        .select(
            F.col("archive_filename").alias("filename"),
            "key",
            (F.col("member") == F.col("key")).alias("as_xml"),
            F.col("member").alias("stored"),
            text.truncate_middle("content", limit).alias("content"),
        )
    )
    asked_html = F.lower("member").endswith(".html")
    keyed = evidence.withColumns({"key": spelled, "asked_html": asked_html})
    joined = keyed.join(contents, ["filename", "key"], "left")
    fits = F.col("as_xml") & F.col("asked_html") | (F.col("stored") == F.col("member"))
    order = Window.partitionBy("question_id", "seq").orderBy(
        F.when(F.col("asked_html") & F.col("as_xml"), 0).when(F.col("stored") == F.col("member"), 1).otherwise(2),
        "stored",
    )
    first = joined.withColumn("__n", F.row_number().over(order)).where("__n = 1")
    known = F.col("filename").isNotNull() & F.col("member").isNotNull()
    shown = [name for name in evidence.columns if name not in ("link", "member", "content")]
    return first.select(
        *shown,
        F.when(known, links.html_member("member")).otherwise(F.col("member")).alias("member"),
        F.when(known, links.viewer_url("filename", "member", base_url)).otherwise(F.col("link")).alias("link"),
        F.when(fits, F.col("content")).alias("content"),
    )


def cap_evidence(evidence: DataFrame, limit: int = MAX_EVIDENCE) -> DataFrame:
    window = Window.partitionBy("question_id").orderBy("seq")
    return evidence.withColumn("n", F.row_number().over(window)).where(F.col("n") <= limit)


def cap_question(question) -> Column:
    return text.head(text.trim_ws(question), MAX_QUESTION)


def evidence_text(item_limit: Column, short: bool) -> Column:
    """The lines of one evidence item; the short form has no date and no link."""

    def line(label: str, value) -> Column:
        value = text.null_if_empty(value)
        return F.when(value.isNotNull(), F.concat(F.lit(label), value))

    body = text._truncate_middle(
        text.null_if_empty("content"), item_limit, SHORT_TAIL, fixed.SHORTENED_MARKER
    )
    lines = [line("ID: ", "id"), line("Kilde: ", "source"), line("Tittel: ", "title")]
    if not short:
        lines += [line("Dato: ", "date"), line("Lenke: ", "link")]
    lines += [line("Utdrag: ", "snippet"), line("Innhold:\n", body)]
    return F.concat_ws("\n", *lines)


def pack_context(
    questions: DataFrame, evidence: DataFrame, limit: int = MAX_EVIDENCE, max_prompt: int = MAX_PROMPT,
    max_content: int = MAX_CONTENT,
) -> DataFrame:
    """``(question_id, prompt)``: question and sources within the prompt limit.

    Each item gets an equal share of the room.  When the whole is still too long
    the share is halved and date and link are left out.  A question has at most
    ``limit`` items here, each already shortened, so the lists that are
    put together are bounded.
    """
    asked = questions.select("question_id", cap_question("question").alias("question"))
    capped = cap_evidence(evidence, limit).withColumn(
        "items", F.count("*").over(Window.partitionBy("question_id"))
    )
    # ``questions`` may hold any number of rows, so the join is left to the optimizer
    items = capped.join(
        asked.select("question_id", F.length("question").alias("question_length")), "question_id"
    )
    room = F.greatest(F.lit(max_prompt) - F.col("question_length") - PROMPT_OVERHEAD, F.lit(MIN_EVIDENCE_SPACE))
    share = F.least(F.lit(max_content), F.floor(room / F.col("items"))).cast("int")
    frame = len(fixed.PROMPT_QUESTION) + len(fixed.PROMPT_SOURCES) + len(fixed.PROMPT_END)
    left = F.lit(max_prompt) - frame - F.col("question_length")
    half = F.floor(left / F.col("items") / 2).cast("int")
    rendered = items.select(
        "question_id",
        F.struct(
            "seq", evidence_text(share, False).alias("full"), evidence_text(half, True).alias("short")
        ).alias("item"),
    )
    packed = rendered.groupBy("question_id").agg(F.sort_array(F.collect_list("item")).alias("items"))

    def prompt(name: str) -> Column:
        return F.concat(
            F.lit(fixed.PROMPT_QUESTION),
            F.col("question"),
            F.lit(fixed.PROMPT_SOURCES),
            F.array_join(F.transform("items", lambda item: item[name]), "\n\n"),
            F.lit(fixed.PROMPT_END),
        )

    empty = F.concat(F.lit(fixed.PROMPT_QUESTION), F.col("question"), F.lit(fixed.PROMPT_NO_SOURCES))
    return asked.join(packed, "question_id", "left").select(
        "question_id",
        F.when(F.col("items").isNull(), empty)
        .when(F.length(prompt("full")) > max_prompt, prompt("short"))
        .otherwise(prompt("full"))
        .alias("prompt"),
    )


def parse_answer_json(answers: DataFrame, column: str = "raw") -> DataFrame:
    """Add ``answer`` and ``citations`` from the JSON object inside a generated text.

    Text without braces or with broken JSON is itself the answer; an answer that
    is no string and citations that are no list count as absent.
    """
    raw, trimmed = F.col(column), text.trim_ws(column)
    start = F.locate("{", trimmed)
    from_end = F.locate("}", F.reverse(trimmed))
    candidate = F.substring(trimmed, start, F.length(trimmed) - from_end + 2 - start)
    parsed = F.try_parse_json(candidate)
    answer, citations = F.try_variant_get(parsed, "$.answer", "variant"), F.try_variant_get(
        parsed, "$.citations", "array<variant>"
    )
    typed = F.when(F.schema_of_variant(answer) == "STRING", F.try_variant_get(parsed, "$.answer", "string"))

    def text_field(entry: Column, path: str) -> Column:
        is_text = F.schema_of_variant(F.try_variant_get(entry, path, "variant")) == "STRING"
        return F.when(is_text, F.try_variant_get(entry, path, "string"))

    cited = F.filter(
        F.transform(
            citations,
            lambda entry: F.struct(
                text_field(entry, "$.evidenceId").alias("evidence_id"),
                text_field(entry, "$.quote").alias("quote"),
            ),
        ),
        lambda entry: entry["evidence_id"].isNotNull(),
    )
    no_braces = (start == 0) | (from_end == 0)
    return answers.withColumns(
        {
            "answer": F.when(no_braces, trimmed).when(parsed.isNull(), raw).otherwise(typed),
            "citations": F.when(~no_braces, cited),
        }
    )


def resolve_citations(
    questions: DataFrame, citations: DataFrame, evidence: DataFrame, page: int = 1, page_size: int = 10
) -> DataFrame:
    """``(question_id, ord, evidence_id, label, quote)`` with labels by position of the evidence.

    ``citations`` has ``(question_id, ord, evidence_id, quote)``.  Unknown ids are
    dropped; a question without any citation cites all its evidence in order.
    """
    first = (page - 1) * page_size
    window = Window.partitionBy("question_id").orderBy("seq")
    numbered = evidence.select(
        "question_id",
        F.col("id").alias("evidence_id"),
        (F.row_number().over(window) + first).alias("position"),
    )
    label = F.concat(F.lit("["), F.col("position"), F.lit("]")).alias("label")
    given = citations.join(numbered, ["question_id", "evidence_id"]).select(
        "question_id", F.col("ord").cast("int").alias("ord"), "evidence_id", label, "quote"
    )
    silent = questions.select("question_id").join(
        citations.select("question_id").distinct(), "question_id", "left_anti"
    )
    default = numbered.join(silent, "question_id", "left_semi").select(
        "question_id",
        (F.col("position") - first - 1).alias("ord"),
        "evidence_id",
        label,
        F.lit(None).cast("string").alias("quote"),
    )
    return given.unionByName(default)


def fallback_summary(
    questions: DataFrame, evidence: DataFrame, marked_source: str, suffix: str, items: int = 5
) -> DataFrame:
    """``(question_id, answer)``: the first titles as a list, or the text for no evidence."""
    first = cap_evidence(evidence, items)
    bullet = F.concat(
        F.lit("- "),
        F.coalesce("title", F.lit(fixed.UNTITLED)),
        F.when(F.col("source") == marked_source, F.lit(f" ({suffix})")).otherwise(F.lit("")),
    )
    listed = first.groupBy("question_id").agg(
        F.sort_array(F.collect_list(F.struct("n", bullet.alias("line")))).alias("lines")
    )
    summary = F.concat(
        F.lit(fixed.SUMMARY_INTRO + "\n"),
        F.array_join(F.transform("lines", lambda entry: entry["line"]), "\n"),
    )
    return questions.select("question_id").join(listed, "question_id", "left").select(
        "question_id", F.coalesce(summary, F.lit(fixed.SUMMARY_EMPTY)).alias("answer")
    )


def evidence_stats(evidence: DataFrame, sources: list[str], page_size: int = 10) -> DataFrame:
    """``(question_id, total, one count per source, other, pages)``."""
    counts = [F.count_if(F.col("source") == name).alias(f"n_{at}") for at, name in enumerate(sources)]
    return evidence.groupBy("question_id").agg(
        F.count("*").alias("total"),
        *counts,
        F.count_if(~F.col("source").isin(sources)).alias("other"),
        F.greatest(F.lit(1), F.ceil(F.count("*") / page_size)).cast("long").alias("pages"),
    )


def answer_links(answers: DataFrame, key: str = "question_id", column: str = "answer") -> DataFrame:
    """``(key, pos, kind, url, label)``: the links of each answer in order."""
    return answers.select(key, F.posexplode(links.links_in(column)).alias("pos", "link")).select(
        key, "pos", "link.kind", "link.url", "link.label"
    )
