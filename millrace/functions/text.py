"""Text functions (SC1-SC6, SC11-SC16, SC18)."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# The marker line between script cells and the fence around code replies.
CELL_MARKER = "# COMMAND ----------"
FENCE = "```"
FENCE_LANGUAGE = "python"

# Characters allowed in names.
STEP_NAME_CHARS = "a-zA-Z0-9_"
PIPELINE_NAME_CHARS = "a-zA-Z0-9_-"

# \R and \s (with Unicode classes) lack these separators, which count as breaks or blanks here.
_BREAK = r"\R|[\x1c-\x1e]"
_BLANK = r"[\s\x1c-\x1f]"
_BLANK_IN_LINE = r"[\s\x1c-\x1f&&[^\n]]"


def joined(*parts: Column | str | int, null_as: str | None = None) -> Column:
    """`+` on mixed values: plain Python values are literals, numbers become text.

    A null part makes the result null (right for keys); `null_as` puts a text in its place
    (right for message bodies).
    """
    texts = [(p if isinstance(p, Column) else F.lit(p)).cast("string") for p in parts]
    if null_as is not None:
        texts = [F.coalesce(t, F.lit(null_as)) for t in texts]
    return F.concat(*texts)


def replaced(text: Column, old: str, new: str) -> Column:
    """Replace every occurrence of a literal text."""
    return F.replace(text, F.lit(old), F.lit(new))


def part_at(text: Column, separator: str, index: int) -> Column:
    """Zero-based part of a split by a literal separator, null when there is no such part."""
    return F.get(F.split(text, java_quote(separator)), F.lit(index))


def parts(text: Column, separator: str) -> Column:
    return F.split(text, java_quote(separator))


def java_quote(literal: str) -> str:
    """A regular expression that matches just the literal."""
    return re.sub(r"([^0-9A-Za-z\s])", r"\\\1", literal)


def clean_step_name(name: Column) -> Column:
    return F.regexp_replace(name, f"[^{STEP_NAME_CHARS}]", "_")


def clean_pipeline_name(name: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(name, f"[^{PIPELINE_NAME_CHARS}]", "_"), "_+", "_")


def stripped(text: Column) -> Column:
    """Drop blanks of every kind, line breaks included, at both ends."""
    return F.regexp_replace(text, rf"(?U)\A{_BLANK}+|{_BLANK}+\z", "")


def fenced_code(reply: Column) -> Column:
    """The first fenced block of a reply, else the whole reply; stripped, without fence marks."""
    pattern = f"(?s){FENCE}{FENCE_LANGUAGE}(.*?){FENCE}"
    body = F.when(F.regexp_like(reply, F.lit(pattern)), F.regexp_extract(reply, pattern, 1)).otherwise(reply)
    return replaced(stripped(body), FENCE, "")


def unified_breaks(text: Column) -> Column:
    return F.regexp_replace(text, _BREAK, "\n")


def lines(text: Column) -> Column:
    """Array of lines; a break at the very end starts no further line, an empty text has none."""
    body = F.regexp_replace(unified_breaks(text), r"\n\z", "")
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(body, "\n"))


def cells(script: Column, marker: str = CELL_MARKER) -> Column:
    """Array of cells: the text between marker lines without blank edge lines; blank cells are dropped."""
    cut = rf"(?mU)^{_BLANK_IN_LINE}*{java_quote(marker)}{_BLANK_IN_LINE}*$"
    pieces = F.split(unified_breaks(script), cut)
    edges = rf"(?U)\A{_BLANK}*\z|\A{_BLANK}*\n|\n{_BLANK}*\z"
    return F.filter(F.transform(pieces, lambda c: F.regexp_replace(c, edges, "")), lambda c: c != "")


def html_escaped(text: Column) -> Column:
    for plain, entity in HTML_ENTITIES:
        text = replaced(text, plain, entity)
    return text


# The ampersand goes first.
HTML_ENTITIES = (
    ("&", "&amp;"),
    ("<", "&lt;"),
    (">", "&gt;"),
    ('"', "&quot;"),
    ("'", "&#x27;"),
)


def html_lines(text: Column) -> Column:
    """Escaped text whose line feeds became `<br>`."""
    return replaced(html_escaped(text), "\n", "<br>")


def formatted(template: str, *cols: Column) -> Column:
    return F.format_string(template, *cols)
