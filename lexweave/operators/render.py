"""Rendering documents as Markdown, and their outline as a table; row-wise, no Python."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed_values as fixed
from ..functions import text

UPPER, LOWER = "[A-ZÆØÅ]", "[a-zæøå]"
ROMAN = rf"{text.BOUNDARY}([IVX]{{1,4}}){text.BOUNDARY}{text.WS}+(?={UPPER})"
PARAGRAPH = rf"(?iu)§{text.WS}*(\d+[a-z]?(?:-\d+)?)"


def split_contents(normalised: Column) -> tuple[Column, Column]:
    """(metadata part, content part): the content starts at the table of contents."""
    lowered = F.lower(normalised)
    at_line, in_line = F.locate("\ninnhold", lowered), F.locate(" innhold ", lowered)
    at = F.when(at_line > 0, at_line).otherwise(in_line)
    before = F.when(at > 0, F.substring(normalised, F.lit(1), at - 1)).otherwise(normalised)
    after = F.when(at > 0, F.substring(normalised, at, F.length(normalised))).otherwise(F.lit(""))
    return text.trim_ws(F.regexp_replace(before, rf"\A(?:{text.WS}|[.-])+", "")), after


def _body(content: Column) -> Column:
    body = F.regexp_replace(text.trim_ws(content), rf"(?iu)\AInnhold{text.WS}*", "## Innhold\n\n")
    body = F.regexp_replace(body, ROMAN, "\n\n### $1\n")
    body = text.replace_matches(
        body,
        PARAGRAPH,
        lambda match: F.concat(
            F.lit("\n\n#### § "), F.upper(F.regexp_extract(match, PARAGRAPH, 1)), F.lit("\n")
        ),
    )
    body = F.regexp_replace(body, rf"([.!?]){text.WS}+(?={UPPER})", "$1\n\n")
    body = F.regexp_replace(body, rf"(?m)(\n|^)({UPPER}.*?:){text.WS}+(?={UPPER})", "$1$2\n")
    body = F.regexp_replace(body, rf"(?iu)({LOWER})\){text.WS}+", "$1) ")
    body = F.regexp_replace(body, rf"([0-9]+)\.{text.WS}+(?={UPPER})", "\n- ")
    body = F.regexp_replace(body, "\n +", "\n")
    return text.trim_ws(F.regexp_replace(body, "\n{3,}", "\n\n"))


def _without_title(body: Column, title: Column) -> Column:
    starts = F.lower(F.left(body, F.length(title))) == F.lower(title)
    rest = F.regexp_replace(
        F.substring(body, F.length(title) + 1, F.length(body)), rf"\A(?:{text.WS}|\.)*", ""
    )
    return F.when(starts & (title != ""), text.trim_ws(rest)).otherwise(body)


def _list_contents(body: Column) -> Column:
    """The table of contents as a list, one item per roman numeral."""
    block = rf"(?s)## Innhold{text.WS}*\n\n([^#]+?)(?=\n\n###|\n####|\z)"
    found = F.regexp_extract(body, block, 0)
    entries = F.split(
        text.trim_ws(F.regexp_replace(F.regexp_extract(body, block, 1), text.WS + "+", " ")),
        rf"{text.WS}+(?=[IVX]{{1,4}}(?:\.|{text.BOUNDARY}))",
        -1,
    )
    items = F.transform(
        F.filter(F.transform(entries, text.trim_ws), lambda entry: entry != ""),
        lambda entry: F.concat(F.lit("- "), F.regexp_replace(entry, r"[.:]\z", "")),
    )
    listed = F.when(
        F.size(items) > 0, F.concat(F.lit("## Innhold\n\n"), F.array_join(items, "\n"))
    ).otherwise(F.lit("## Innhold"))
    at = F.locate("## Innhold", body)
    first = F.position(found, body)
    return F.when(
        (at > 0) & (found != ""),
        F.concat(
            F.substring(body, F.lit(1), first - 1),
            listed,
            F.substring(body, first + F.length(found), F.length(body)),
        ),
    ).otherwise(body)


def render_markdown(documents: DataFrame, key: str = "id") -> DataFrame:
    """``(key, markdown)`` from ``content, title, document_date``."""
    steps = documents.select(
        key,
        F.coalesce("title", F.lit("")).alias("title"),
        "document_date",
        text.normalize_text("content").alias("normalised"),
    )
    head, tail = split_contents(F.col("normalised"))
    steps = steps.withColumns({"head": head, "tail": tail})
    source = F.when(F.col("tail") != "", F.col("tail")).otherwise(F.col("normalised"))
    steps = steps.withColumn("body", _body(source))
    steps = steps.withColumn("body", _without_title(F.col("body"), F.col("title")))
    steps = steps.withColumn("body", _list_contents(F.col("body")))
    at = F.locate("## Innhold", F.col("body"))
    steps = steps.withColumn(
        "body",
        F.when(at > 1, text.trim_start_ws(F.substring("body", at, F.length("body")))).otherwise(F.col("body")),
    )
    bullets = F.array_join(
        F.transform(
            text.labelled_values("head"),
            lambda entry: text.trim_ws(
                F.concat(F.lit("- **"), entry["label"], F.lit(":** "), entry["value"])
            ),
        ),
        "\n",
    )
    return steps.select(
        key,
        F.regexp_replace(
            F.concat_ws(
                "\n\n",
                F.when(F.col("title") != "", F.concat(F.lit("# "), F.col("title"))),
                F.when(F.col("document_date") != "", F.concat(F.lit("*Dato:* "), F.col("document_date"))),
                text.null_if_empty(text.trim_ws(bullets)),
                text.null_if_empty("body"),
            ),
            "\n{3,}",
            "\n\n",
        ).alias("markdown"),
    )


def write_markdown(rendered: DataFrame, path: str, key: str = "id") -> None:
    """Save as Parquet; one row per document keeps the number of files free of the corpus size."""
    rendered.select(key, "markdown").write.mode("overwrite").parquet(path)


def outline(documents: DataFrame, key: str = "id", column: str = "content") -> DataFrame:
    """``(key, ord, level, label)``: chapters (3) and paragraphs (4) in order."""
    found = F.regexp_extract_all(
        text.normalize_text(column), F.lit(f"{ROMAN}|{PARAGRAPH.replace('(?iu)', '').replace('[a-z]', '[a-zA-Z]')}"), F.lit(0)
    )
    anchors = documents.select(key, F.posexplode(found).alias("ord", "anchor"))
    is_paragraph = F.col("anchor").startswith("§")
    return anchors.select(
        key,
        "ord",
        F.when(is_paragraph, 4).otherwise(3).alias("level"),
        F.when(
            is_paragraph,
            F.concat(F.lit("§ "), F.upper(F.regexp_replace("anchor", rf"§{text.WS}*", ""))),
        )
        .otherwise(text.trim_ws("anchor"))
        .alias("label"),
    )
