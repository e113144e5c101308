"""Text functions on columns.

Lengths and positions count code points.  White space and word boundaries are
spelled out, because Java, RE2 and ECMAScript disagree on ``\\s`` and ``\\b``
outside ASCII.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed_values as fixed

# White space as ECMAScript defines it.
WS_CHARS = (
    "\t\n\x0b\x0c\r \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
    "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
)
WS = "[\t-\r \u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff]"

# Boundary between an ASCII word character and anything else.
BOUNDARY = (
    "(?:(?<=[0-9A-Za-z_])(?![0-9A-Za-z_])|(?<![0-9A-Za-z_])(?=[0-9A-Za-z_]))"
)

WORD_RUN = r"[\p{L}\p{N}]+"
QUERY_WORD = r"[\p{L}\p{N}]{3,}"


def as_column(value) -> Column:
    return value if isinstance(value, Column) else F.col(value)


def trim_ws(text) -> Column:
    return F.btrim(as_column(text), F.lit(WS_CHARS))


def trim_end_ws(text) -> Column:
    return F.regexp_replace(as_column(text), WS + r"+\z", "")


def trim_start_ws(text) -> Column:
    return F.regexp_replace(as_column(text), r"\A" + WS + "+", "")


def null_if_empty(text) -> Column:
    return F.nullif(as_column(text), F.lit(""))


def is_blank(text) -> Column:
    return F.coalesce(trim_ws(text) == "", F.lit(True))


def head(text, length: int) -> Column:
    return F.substring(as_column(text), 1, length)


def first_group(text, pattern: str) -> Column:
    """Group 1 of the first match; null when nothing (or the empty string) matched."""
    return null_if_empty(F.regexp_extract(as_column(text), pattern, 1))


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once, however often ``use`` mentions it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def replace_matches(text, pattern: str, change: Callable[[Column], Column]) -> Column:
    """Rewrite every match with a column function, where a pattern alone cannot decide."""
    text = as_column(text)
    pieces = F.split(text, pattern, -1)
    changed = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), change)
    return F.array_join(
        F.zip_with(pieces, F.concat(changed, F.array(F.lit(""))), lambda piece, new: F.concat(piece, new)),
        "",
    )


def normalize_text(text) -> Column:
    text = F.regexp_replace(as_column(text), "\r\n?", "\n")
    text = F.replace(text, F.lit("\u00a0"), F.lit(" "))
    text = F.regexp_replace(text, "[ \t]+", " ")
    text = F.regexp_replace(text, "\n{3,}", "\n\n")
    return trim_ws(text)


def decode_entities(text, nbsp: bool = False) -> Column:
    text = as_column(text)
    pairs = [("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&"), ("&quot;", '"'), ("&#39;", "'")]
    if nbsp:
        pairs.append(("&nbsp;", " "))
    for entity, char in pairs:
        text = F.replace(text, F.lit(entity), F.lit(char))
    return text


def tag_text(text, tag: str, length: int) -> Column:
    """Text after the first opening tag whose name starts with ``tag``, entities decoded."""
    found = first_group(text, f"(?iu)<{tag}[^>]*>([^<]{{1,{length}}})")
    return decode_entities(trim_ws(found))


def extract_title(text, tags: list[str] = fixed.TITLE_TAGS) -> Column:
    return F.coalesce(*[tag_text(text, tag, 200) for tag in tags])


def extract_date(text, tags: list[str] = fixed.DATE_TAGS) -> Column:
    return F.coalesce(*[tag_text(text, tag, 50) for tag in tags])


def extract_year(text, date, content_fallback: str = "labelled") -> Column:
    """Year of the date string, else of the text.

    ``labelled`` accepts only ``år: 2019`` / ``2019 år`` in the text; ``any``
    takes the first four-digit year, as the backfill does.
    """
    bare_year = BOUNDARY + r"((?:19|20)\d{2})" + BOUNDARY

    def in_range(pattern: str) -> Column:
        year = first_group(text, pattern).try_cast("int")
        return F.when(year.between(1900, 2100), year)

    from_date = first_group(date, bare_year).try_cast("int")
    if content_fallback == "any":
        return F.coalesce(from_date, in_range(bare_year))
    if content_fallback != "labelled":
        raise ValueError("content_fallback is 'labelled' or 'any'")
    return F.coalesce(
        from_date,
        in_range(rf"(?iu)år(?::|{WS})+(\d{{4}})"),
        in_range(rf"(?iu)(\d{{4}}){WS}*år"),
    )


def is_html(text) -> Column:
    start = F.lower(head(text, 1000))
    return F.coalesce(start.contains("<html") | start.contains("<!doctype html"), F.lit(False))


def extract_source_url(text, attribute: str, site: str, css_class: str = "legalArticle") -> Column:
    """Address of the first article that carries ``attribute``, query string dropped.

    An article of ``css_class`` wins over any other; the class may stand before
    or after the attribute.
    """
    value = rf"{attribute}=[\"']([^\"']+)[\"']"
    css = rf"class=[\"'][^\"']*{css_class}[^\"']*[\"']"
    found = F.coalesce(
        first_group(text, rf"(?iu)<article[^>]*{css}[^>]*{value}"),
        first_group(text, rf"(?iu)<article[^>]*{value}[^>]*{css}"),
        first_group(text, rf"(?iu)<article[^>]*{value}"),
    )
    path = F.substring_index(trim_ws(found), "?", 1)
    return F.when(path.startswith("/"), F.concat(F.lit(site), path)).otherwise(
        F.concat(F.lit(site + "/"), path)
    )


def labelled_values(text, labels: list[str] = fixed.METADATA_LABELS) -> Column:
    """``array<struct<label, value>>``: each value runs to the next label."""
    text = as_column(text)
    pattern = f"(?iu){BOUNDARY}({'|'.join(labels)}){BOUNDARY}"
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(1))
    between = F.split(text, pattern, -1)

    def clean(value: Column) -> Column:
        value = F.regexp_replace(value, rf"\A(?:{WS}|[:.-])+", "")
        return F.regexp_replace(trim_ws(value), WS + "{2,}", " ")

    return F.zip_with(
        found,
        F.slice(between, F.lit(2), F.size(found)),
        lambda label, value: F.struct(label.alias("label"), clean(value).alias("value")),
    )


def section_number(text) -> Column:
    start = head(text, 2000)
    patterns = [
        rf"(?iu)§{WS}*(\d+[a-z]?)",
        rf"(?iu)paragraf{WS}+(\d+[a-z]?)",
        rf"(?iu)kapittel{WS}+(\d+[a-z]?)",
        r"(?iu)<paragraf[^>]*>([^<]+)",
        r"(?iu)<kapittel[^>]*>([^<]+)",
    ]
    return F.coalesce(*[trim_ws(first_group(start, pattern)) for pattern in patterns])


def section_title(text) -> Column:
    start = head(text, 2000)
    patterns = [r"(?iu)<%s[^>]*>([^<]{1,200})" % tag for tag in ("overskrift", "tittel", "heading")]
    patterns += [rf"(?m)^#+{WS}+(.+)$", r"(?m)^(.+)\n={3,}$"]
    found = [decode_entities(trim_ws(first_group(start, pattern)), nbsp=True) for pattern in patterns]
    return F.coalesce(*[F.when(F.length(title).between(1, 199), title) for title in found])


def embedding_text(title, section, number, content) -> Column:
    def labelled(label: str, value) -> Column:
        return F.when(null_if_empty(value).isNotNull(), F.concat(F.lit(label), as_column(value)))

    return F.concat_ws(
        "\n\n",
        labelled("Dokument: ", title),
        labelled("Seksjon: ", section),
        labelled("§", number),
        as_column(content),
    )


def truncate_for_embedding(text, limit: int = 20000, ellipsis: bool = True) -> Column:
    text = as_column(text)
    cut = F.concat(head(text, limit - 3), F.lit("...")) if ellipsis else head(text, limit)
    return F.when(F.length(text) > limit, cut).otherwise(text)


def truncate_head_tail(text, limit: int = 18000) -> Column:
    """``struct<text, was_truncated, original_length>``: first 90 % and last 10 % of the limit."""
    text = as_column(text)
    head_chars = int(limit * 0.9)
    cut = F.concat(
        head(text, head_chars), F.lit(fixed.TRUNCATED_MARKER), F.right(text, F.lit(limit - head_chars))
    )
    long = F.length(text) > limit
    return F.struct(
        F.when(long, cut).otherwise(text).alias("text"),
        long.alias("was_truncated"),
        F.length(text).alias("original_length"),
    )


def estimate_tokens(text) -> Column:
    return F.ceil(F.length(as_column(text)) / 3).cast("int")


def shrink_schedule(text, token_budget: int, limit: int = 20000, retries: int = 3) -> Column:
    """``struct<attempt, limit, text>``: first limit of the schedule that fits the budget.

    The limit falls by a fifth per attempt; null when even the last one is too long.
    """
    text = as_column(text)
    fitting = None
    for attempt in range(retries + 1):
        size = int(limit * 0.8**attempt)
        cut = truncate_for_embedding(text, size)
        choice = F.struct(F.lit(attempt).alias("attempt"), F.lit(size).alias("limit"), cut.alias("text"))
        fits = F.ceil(F.least(F.length(text), F.lit(size)) / 3) <= token_budget
        fitting = F.when(fits, choice) if fitting is None else fitting.when(fits, choice)
    return fitting


def truncate_middle(text, limit: int = 20000, tail: int = 1000, marker: str = "\n...\n") -> Column:
    """Head and tail of a long text around ``marker``; null stays null."""
    text = as_column(text)
    return _truncate_middle(text, F.lit(limit), tail, marker)


def _truncate_middle(text: Column, limit: Column, tail: int, marker: str) -> Column:
    head_part = trim_end_ws(F.substring(text, F.lit(1), F.greatest(limit - tail, F.lit(0))))
    tail_part = trim_start_ws(F.right(text, F.lit(tail)))
    return (
        F.when(F.length(text) <= limit, text)
        .when(head_part == "", tail_part)
        .otherwise(F.concat(head_part, F.lit(marker), tail_part))
    )


def query_words(text) -> Column:
    """Distinct lower-cased letter/digit runs of three or more, in order of first use."""
    return F.array_distinct(
        F.regexp_extract_all(F.lower(as_column(text)), F.lit(QUERY_WORD), F.lit(0))
    )


def words(text) -> Column:
    """Every lower-cased letter/digit run, in order."""
    return F.regexp_extract_all(F.lower(as_column(text)), F.lit(WORD_RUN), F.lit(0))


def split_words(text, min_length: int = 3) -> Column:
    """Lower-cased pieces between white space, punctuation and repeats kept."""
    pieces = F.split(F.lower(trim_ws(text)), WS + "+", -1)
    return F.filter(pieces, lambda piece: F.length(piece) >= min_length)


def chunk_snippet(text, limit: int = 300) -> Column:
    return truncate_for_embedding(text, limit)


def best_window_snippet(text, tokens, width: int = 150, step: int = 100, reach: int | None = None) -> Column:
    """The earliest window with the most distinct query tokens in it, ellipses at the cuts.

    A window begins every ``step`` characters of the whole text, or of its first ``reach`` if the caller says so.  The
    text is cut into pieces of ``step`` once and windows are put together from neighbours, so the work grows with the
    length of a text and not with its square.
    """
    text, tokens = as_column(text), as_column(tokens)
    searched, size = text, F.length(text)
    if reach is not None:
        searched, size = head(text, reach + width), F.least(size, F.lit(reach))
    pieces = F.regexp_extract_all(F.lower(searched), F.lit(f"(?s).{{1,{step}}}+"), F.lit(0))
    # lower case may be longer than the text itself, in which no window begins beyond its end
    begun = F.ceil(size / step).cast("int")

    def scored(cut: Column, wanted: Column) -> Column:
        def score(piece: Column, at: Column) -> Column:
            behind = [F.coalesce(F.get(cut, at + n), F.lit("")) for n in range(1, -(-width // step))]
            return let(
                F.substring(F.concat(piece, *behind), 1, width),
                lambda window: F.struct(
                    F.size(F.filter(wanted, lambda token: window.contains(token))).alias("score"),
                    (-at * step).alias("back"),
                ),
            )

        return F.array_max(F.transform(F.slice(cut, F.lit(1), begun), score))

    best = let(pieces, lambda cut: let(tokens, lambda wanted: scored(cut, wanted)))
    return let(best, lambda found: _window_text(text, found, width))


def _window_text(text: Column, best: Column, width: int) -> Column:
    start = F.when(best["score"] > 0, -best["back"]).otherwise(F.lit(0))
    cut = F.concat(
        F.when(start > 0, F.lit("…")).otherwise(F.lit("")),
        F.substring(text, start + 1, F.lit(width)),
        F.when(start + width < F.length(text), F.lit("…")).otherwise(F.lit("")),
    )
    return trim_ws(cut)


def storage_segment(path) -> Column:
    """A member or archive name made safe as a storage path segment.

    Resolves ``.`` and ``..`` parts, drops what would climb above the root,
    leading and doubled slashes, and characters file systems reserve.
    """
    parts = F.split(as_column(path), "/", -1)
    empty = F.array().cast("array<string>")
    resolved = F.aggregate(
        parts,
        empty,
        lambda kept, part: F.when(part.isin("", "."), kept)
        .when(part == "..", F.slice(kept, F.lit(1), F.greatest(F.size(kept) - 1, F.lit(0))))
        .otherwise(F.concat(kept, F.array(part))),
    )
    cleaned = F.regexp_replace(F.array_join(resolved, "/"), r"\A(?:\.\.(?:[/\\]|\z))+", "")
    cleaned = F.regexp_replace(cleaned, r"\A[/\\]+", "")
    cleaned = F.regexp_replace(cleaned, r"[/\\]+", "/")
    return F.regexp_replace(cleaned, "[<>:\"|?*\\x00-\\x1f]", "")


def storage_path(archive, member) -> Column:
    return F.concat(storage_segment(archive), F.lit("/"), storage_segment(member))
