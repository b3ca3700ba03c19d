"""Text: normal forms, masks, escapes."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

MASK = "***REDACTED***"

#: Dates and times, in the order in which they are taken out.
_WHEN = (r"\b\d{4}[-/]\d{1,2}[-/]\d{1,2}\b", r"\b\d{1,2}[-/]\d{1,2}[-/]\d{2,4}\b", r"\b\d{1,2}[-/]\d{1,2}\b", r"\b\d{1,2}:\d{2}(?::\d{2})?\b")


def normalize_description(text: Column) -> Column:
    """Lower-case words of a to z, without dates, times and words that hold a digit; '' from null."""
    s = F.coalesce(text.cast("string"), F.lit(""))
    for pattern in _WHEN:
        s = F.regexp_replace(s, pattern, " ")
    s = F.lower(F.trim(F.regexp_replace(s, r"\s+", " ")))
    for pattern in (r"\b[a-z0-9]*\d[a-z0-9]*\b", r"[^a-z ]+", r"\s+"):
        s = F.regexp_replace(s, pattern, " ")
    return F.trim(s)


def mask(column: Column) -> Column:
    """The mask in place of any text but null and ''."""
    return F.when(column.isNotNull() & (column != ""), F.lit(MASK)).otherwise(column)


def fold_header(name: str) -> str:
    """A header without accents, case and punctuation."""
    plain = unicodedata.normalize("NFKD", name).encode("ascii", "ignore").decode()
    return re.sub(r"[^a-z0-9]+", "", plain.lower())


def sanitize_prompt(text: Column) -> Column:
    """Text that can't pass for instructions: no control characters, role marks or fences."""
    s = F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x00-\x09\x0b-\x1f]", "")
    s = F.regexp_replace(s, r"(?i)\[(SYSTEM|INST)", "($1")
    return F.replace(s, F.lit("```"), F.lit(""))


def sanitize_source_name(name: Column) -> Column:
    """A name fit for logs: control and direction characters as '?', 255 at most."""
    return F.substring(F.regexp_replace(name, r"[\x00-\x1f\x7f‎‏‪-‮⁦-⁩]", "?"), 1, 255)


def context_slice(needle: Column, text: Column, around: int = 80) -> Column:
    """The stretch of ``text`` around the first place of ``needle``, whatever the case; null if it isn't there."""
    at = F.instr(F.lower(text), F.lower(needle))
    begin = F.greatest(at - around, F.lit(1))
    return F.when((needle != "") & (at > 0), F.trim(F.substring(text, begin, at + F.length(needle) + around - begin)))


def first_page_with(needle: Column, pages: Column) -> Column:
    """0-based place of the first page that contains the text, whatever the case."""
    hits = F.transform(pages, lambda p: F.contains(F.lower(p), F.lower(needle)))
    return F.when(F.coalesce(needle, F.lit("")) != "", (F.nullif(F.array_position(hits, F.lit(True)), F.lit(0)) - 1).cast("int"))


def ledger_text(text: Column) -> Column:
    """One line, as plain-text ledgers take it."""
    return F.trim(F.replace(F.replace(text, F.lit("\n"), F.lit(" ")), F.lit("\r"), F.lit("")))


def quoted_text(text: Column) -> Column:
    """The inside of a quoted string: one line, with backslashes and quotes escaped."""
    s = F.replace(ledger_text(text), F.lit("\\"), F.lit("\\\\"))
    return F.replace(s, F.lit('"'), F.lit('\\"'))
