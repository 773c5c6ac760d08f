"""Text functions as Columns."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from ridgeline.functions import fixed

TERM = r"[A-Za-z0-9_$.]+"
#: Terms of the index: letters and digits of any script.
INDEX_TERM = r"[\p{L}\p{N}_$.]+"
_PART = r"[A-Z]+(?![a-z])|[A-Z][a-z0-9]*|[a-z0-9]+"


def decoded(content: Column) -> Column:
    """UTF-8 text of bytes; invalid sequences become U+FFFD."""
    return F.make_valid_utf8(content.cast("string"))


def ink_length(text: Column) -> Column:
    """Characters that are not Unicode white space."""
    return F.length(F.regexp_replace(text, r"(?U)\s", ""))


def terms(text: Column) -> Column:
    """The ASCII terms of a text, in order, with repeats."""
    return F.regexp_extract_all(text, F.lit(TERM), F.lit(0))


def index_terms(text: Column) -> Column:
    """The lower-case terms of a text as the index holds them."""
    return F.regexp_extract_all(F.lower(text), F.lit(INDEX_TERM), F.lit(0))


def split_identifier(word: Column) -> Column:
    """The lower-case parts of an identifier of several parts, else an empty array."""
    parts = F.transform(F.regexp_extract_all(word, F.lit(_PART), F.lit(0)), F.lower)
    return F.when(F.size(parts) >= 2, parts).otherwise(F.array().cast("array<string>"))


def identifier_tokens(text: Column) -> Column:
    """The distinct parts of a text's identifiers, in the order they are first seen."""
    return F.array_distinct(F.flatten(F.transform(terms(text), split_identifier)))


def query_terms(query: str) -> list[str]:
    """The distinct terms of a query and the parts of each, in lower case, in order; OR-ed by the search."""
    out: dict[str, None] = {}
    for word in re.findall(TERM, query):
        out.setdefault(word.lower())
        parts = re.findall(_PART, word)
        if len(parts) > 1:
            for p in parts:
                out.setdefault(p.lower())
    return list(out)


def line_count(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1


def end_line(start: Column, text: Column) -> Column:
    """The last line of a body that begins at `start`; a closing line feed opens no further line."""
    return F.greatest(start, start + line_count(text) - 1 - F.endswith(text, F.lit("\n")).cast("int"))


def preview(text: Column, lines: int = fixed.PREVIEW_LINES) -> Column:
    """The first lines of a text, joined by line feeds; any line break counts, a closing one opens no line."""
    whole = F.split(F.regexp_replace(text, r"\R\z", ""), r"\R")
    return F.array_join(F.slice(whole, 1, lines), "\n")


def fingerprint(text: Column) -> Column:
    """The first 400 characters with white space collapsed."""
    return F.substring(F.trim(F.regexp_replace(text, r"(?U)\s+", " ")), 1, fixed.FINGERPRINT_CHARS)


def embed_text(header: Column, text: Column) -> Column:
    """What an embedder sees: the header line, if any, before the body."""
    return F.when(F.coalesce(header, F.lit("")) != "", F.concat(header, F.lit("\n"), text)).otherwise(text)
