"""Text functions as column expressions; none leaves the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from leafmill.functions import patterns as P


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with the value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def strip(x: Column) -> Column:
    """x without white space at both ends (all Unicode white space, not only blanks)."""
    return F.regexp_replace(x, rf"\A{P.WS}+|{P.WS}+\z", "")


def is_blank(x: Column) -> Column:
    return strip(x) == ""


def collapse_ws(x: Column) -> Column:
    """Runs of white space become one blank, none at the ends."""
    return F.trim(F.regexp_replace(x, rf"{P.WS}+", " "))


def tidy(x: Column) -> Column:
    """No white space at line ends, at most two blank lines in a row, stripped, one line feed at the end."""
    lines = F.regexp_replace(x, rf"{P.WS_IN_LINE}+(\n|\z)", "$1")
    return F.concat(strip(F.regexp_replace(lines, r"\n{4,}", "\n\n\n")), F.lit("\n"))


def promote_headings(x: Column) -> Column:
    """Structural words on a line of their own become headings of the second level, articles of the third."""
    return F.regexp_replace(F.regexp_replace(x, f"(?imud){P.DIVISION_LINE}", "## $1"), f"(?imud){P.ARTICLE_LINE}", "### $1")


def roman_heading(line: Column) -> Column:
    """A line of capitals behind a Roman numeral becomes a heading of the second level."""
    return F.when(line.rlike(P.ROMAN_LINE.replace("^", r"\A").replace("$", r"\z")), F.concat(F.lit("## "), line)).otherwise(line)


def is_marker(x: Column) -> Column:
    text = strip(x)
    return (F.length(text) <= 6) & ((text == "") | text.isin(*P.BULLETS) | text.rlike(f"(?i){P.MARKER}"))


def marker_prefix(x: Column) -> Column:
    """How a marker begins its item: a number with a point, a dash, or the marker itself."""
    text = strip(x)
    return F.when(text.rlike(r"^[0-9]{1,4}$"), F.concat(text, F.lit(". "))).when(text.isin(*P.BULLETS), F.lit("- ")).when(text != "", F.concat(text, F.lit(" "))).otherwise("")


def strip_glyphs(x: Column) -> Column:
    """Removes the names of glyphs that had no character."""
    return F.regexp_replace(x, P.GLYPH, "")


def strip_fence(x: Column) -> Column:
    """The inside of a text that is one code fence; any other text unchanged."""
    text = strip(x)
    whole = rf"(?s)\A```(?:markdown)?{P.WS}*\n(.*?)\n```{P.WS}*\z"
    return F.when(text.rlike(whole), strip(F.regexp_extract(text, whole, 1))).otherwise(x)


def paragraphs(x: Column) -> Column:
    """Stripped non-blank parts between blank lines."""
    return F.filter(F.transform(F.split(x, rf"\n{P.WS}*\n", -1), strip), lambda p: p != "")


def sanitize_filename(x: Column) -> Column:
    """A name for a download: other characters become underscores, `.md` at the end, `document` for none."""
    name = F.regexp_replace(F.coalesce(F.nullif(x, F.lit("")), F.lit("document")), r"[^A-Za-z0-9._-]", "_")
    return F.when(name.endswith(".md"), name).otherwise(F.concat(name, F.lit(".md")))


def basename(url: Column) -> Column:
    """Last part of a URL without query, fragment and last extension."""
    last = F.substring_index(F.substring_index(F.substring_index(url, "?", 1), "#", 1), "/", -1)
    return F.coalesce(F.nullif(F.regexp_replace(last, r"\.[^.]+$", ""), F.lit("")), F.lit("document"))


def _decoded(x: Column) -> Column:
    """Percent decoding that leaves plus signs alone."""
    return F.coalesce(F.try_url_decode(F.replace(x, F.lit("+"), F.lit("%2B"))), x)


def filename_from_url(url: Column, content_type: Column) -> Column:
    """File name of a URL, with the extension of its content type if it has none."""
    path = F.regexp_replace(F.substring_index(F.substring_index(url, "#", 1), "?", 1), r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/]*", "")
    name = F.coalesce(F.nullif(F.substring_index(_decoded(path), "/", -1), F.lit("")), F.lit("document"))
    kind = F.lower(strip(F.substring_index(F.coalesce(content_type, F.lit("")), ";", 1)))
    table = F.create_map(*(F.lit(v) for pair in P.EXTENSIONS.items() for v in pair))
    return F.when(F.contains(name, F.lit(".")), name).otherwise(F.concat(name, F.coalesce(F.try_element_at(table, kind), F.lit(""))))


def anchor(query: Column) -> Column:
    """What follows the first #, decoded and stripped; null if there is none or it is blank."""
    return F.when(F.contains(query, F.lit("#")), F.nullif(strip(_decoded(F.regexp_extract(query, r"(?s)#(.*)\z", 1))), F.lit("")))


def token_estimate(x: Column) -> Column:
    """A quarter of the characters, rounded down."""
    return F.floor(F.length(x) / 4).cast("long")


def decode_bytes(content: Column) -> Column:
    """Text of bytes: by byte order mark, else UTF-8 where valid, else Latin-1."""
    head = F.hex(F.substring(content, 1, 3))
    return (
        F.when(head == "EFBBBF", F.decode(content.substr(F.lit(4), F.length(content)), "UTF-8"))
        .when(F.substring(head, 1, 4) == "FFFE", F.decode(content.substr(F.lit(3), F.length(content)), "UTF-16LE"))
        .when(F.substring(head, 1, 4) == "FEFF", F.decode(content.substr(F.lit(3), F.length(content)), "UTF-16BE"))
        .when(F.is_valid_utf8(content.cast("string")), content.cast("string"))
        .otherwise(F.decode(content, "ISO-8859-1"))
    )
