"""Column functions on text: redaction, paths, patterns, JSON text of arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters that count as white space in session text.
WHITESPACE = (
    "\t\n\u000b\u000c\r\u001c\u001d\u001e\u001f \u0085\u00a0\u1680\u2000\u2001\u2002\u2003\u2004"
    "\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
_WS = f"[{WHITESPACE}]"

#: Texts from so many bytes on are not trimmed from the right in place.
TRIM_BYTES = 1 << 20

# What is redacted and by what, applied in this order.
# (?U) gives Unicode classes; (?md) lets only \n end a line.
SECRET_PATTERNS = [
    (r"AKIA[0-9A-Z]{16}", "[REDACTED:aws]"),
    (r"gh[pousr]_[A-Za-z0-9]{20,}", "[REDACTED:github]"),
    (rf"Bearer{_WS}+[A-Za-z0-9._\-]+", "Bearer [REDACTED:bearer]"),
    (r"eyJ[A-Za-z0-9_\-]+\.[A-Za-z0-9_\-]+\.[A-Za-z0-9_\-]+", "[REDACTED:jwt]"),
    (r"(?md)^([A-Z][A-Z0-9_]*(?:PASSWORD|SECRET|TOKEN|KEY))=.+$", "$1=[REDACTED:env]"),
]

# Openings of a user message that corrects the assistant.
CORRECTION_PATTERN = rf"(?iU)^{_WS}*(no|don't|stop|wait|actually)\b"

# A slash command at the start of a message.
SLASH_PATTERN = r"(?U)^/([a-zA-Z0-9_\-:]+)\b"

# The message a user leaves a session with.
EXIT_TAG = "<command-name>/exit</command-name>"


def scrub(col: Column) -> Column:
    """Replace secrets by tags.  Null and empty text stay as they are."""
    for pattern, tag in SECRET_PATTERNS:
        col = F.regexp_replace(col, pattern, tag)
    return col


def normalize_path(col: Column, home: str) -> Column:
    """Write ``~`` for every occurrence of the home folder."""
    return F.replace(col, F.lit(home), F.lit("~")) if home else col


def strip(col: Column) -> Column:
    """Without white space at both ends.

    Trimming from the right needs eight bytes for each byte of a text, so a long text is turned round for it.
    """
    space = F.lit(WHITESPACE)
    turned = F.reverse(F.ltrim(F.reverse(F.ltrim(col, space)), space))
    return F.when(F.octet_length(col) < TRIM_BYTES, F.btrim(col, space)).otherwise(turned)


def lstrip(col: Column) -> Column:
    return F.ltrim(col, F.lit(WHITESPACE))


def is_correction(col: Column, pattern: str = CORRECTION_PATTERN) -> Column:
    return F.coalesce(col.rlike(pattern), F.lit(False))


def slash_command(col: Column) -> Column:
    """Name of the slash command a message starts with, else null."""
    return F.nullif(F.regexp_extract(lstrip(col), SLASH_PATTERN, 1), F.lit(""))


def array_json(col: Column) -> Column:
    """JSON text of a string array with ``", "`` between elements."""
    quoted = F.transform(col, lambda x: F.regexp_extract(F.to_json(F.array(x)), r"(?s)^\[(.*)\]$", 1))
    return F.concat(F.lit("["), F.array_join(quoted, ", "), F.lit("]"))


def snippet(col: Column, width: int = 60) -> Column:
    """One-line preview: white space collapsed, cut to ``width`` with dots."""
    flat = F.regexp_replace(strip(F.coalesce(col, F.lit(""))), f"{_WS}+", " ")
    return F.when(F.length(flat) > width, F.concat(F.substring(flat, 1, width - 3), F.lit("..."))).otherwise(flat)
