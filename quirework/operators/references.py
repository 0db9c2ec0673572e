"""Reference apparatus: finding it in a paragraph, and taking notes off the head of the paragraph they are glued to."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import text as tx

# The shapes of references, in the order in which they are looked for.
LATIN = r"\b(?:ibid\.|op\.\s*cit\.|loc\.\s*cit\.)"
SOURCES = r"\bprincipal sources?\s+(?:used|utilized|consulted)"
IMPRINT = r"\([^()]{0,120}:\s*[^()]{0,120}\b(?:1[6-9]|20)\d{2}\s*\)"
ENDNOTE = r"(?<![\w-])\d{1,3}\.\s+[^.;]{0,60}?\bpp?\.\s*\d"
PAGES = r"\bpp?\.\s*[A-Za-z]?-?\d[\w.–—-]*(?:\s*(?:and|through|,|&)\s*(?:\bpp?\.\s*)?[A-Za-z]?-?\d[\w.–—-]*)*"
LEAST_PROSE = 80

SHAPES = ["(?iU)" + LATIN, "(?iU)" + SOURCES, "(?U)" + IMPRINT, "(?U)" + ENDNOTE]

#: A note's number, at most 80 characters without a full stop, and its pages or imprint.
_NOTE = rf"\d{{1,3}}\.\s+(?:(?:ibid\.|op\.\s*cit\.|loc\.\s*cit\.)[,\s]*)?[^.;]{{0,80}}?(?:{PAGES}|{IMPRINT})(?:\s*{PAGES})?\.?(?=\s|$)"
#: Notes in a row, none of them given back, and then a bare number before a sentence.
HEAD = rf"(?iU)^(?:(?>{_NOTE})\s*)++(?-i:\d{{1,3}}\.\s+(?=[\"'“‘A-Z]))?"


def apparatus(text) -> Column:
    """The first reference that the text holds, or null."""
    return F.coalesce(*[F.nullif(F.regexp_extract(tx.c(text), shape, 0), F.lit("")) for shape in SHAPES])


def without_head(text) -> Column:
    """The text without the notes at its head; as it was if what is left is short or still holds references."""
    t = tx.c(text)
    rest = F.regexp_replace(t, HEAD, "")
    return F.when((F.length(rest) >= LEAST_PROSE) & apparatus(rest).isNull(), rest).otherwise(t)
