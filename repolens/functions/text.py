"""Text columns: decoding, lines, stripping, patterns, redaction."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from repolens import constants as K


def java_pattern(pattern: str) -> str:
    """Give a Java pattern the Unicode rules of Python's ``re`` on ``str``.

    ``(?U)`` makes ``\\s``, ``\\w`` and ``\\b`` Unicode, ``(?u)`` the case folding; Python also
    counts the four separators U+001C to U+001F as white space.
    """
    return "(?U)(?u)" + pattern.replace(r"\s", r"[\s\x1c-\x1f]")


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once, however often ``body`` uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def decode_source(content: Column) -> Column:
    """Bytes to text: invalid UTF-8 becomes U+FFFD, every newline becomes ``\\n``."""
    return F.regexp_replace(F.make_valid_utf8(content.cast("string")), "\r\n?", "\n")


def strip(col: Column) -> Column:
    """Python's ``str.strip``: all Unicode blanks, not only the space."""
    return F.btrim(col, F.lit(K.BLANKS))


def split_lines(text: Column) -> Column:
    """Python's ``str.splitlines``: Unicode line breaks, no empty line after the last break."""
    parts = F.split(text, f"\r\n|[{K.LINE_BREAKS}]")
    return let(
        parts, lambda p: F.when(F.element_at(p, -1) == "", F.slice(p, 1, F.size(p) - 1)).otherwise(p)
    )


def split_lines_keep_ends(text: Column) -> Column:
    """Lines with their line break; joining them with '' gives the text back.

    The text must come from :func:`decode_source`, so that ``\\r`` never stands before ``\\n``.
    """
    return F.split(text, f"(?<=[{K.LINE_BREAKS}])")


def evidence_line(lines: Column, number: Column) -> Column:
    """The stripped line ``number`` (1-based), or '' outside the file."""
    return F.coalesce(F.when(number >= 1, strip(F.get(lines, number - 1))), F.lit(""))


def redact_py(line: Column) -> Column:
    """Replace every quoted value after ``=``."""
    return F.regexp_replace(line, java_pattern(K.PY_REDACT_PATTERN), "$1[REDACTED]$2")


def redact_js(line: Column) -> Column:
    """Replace every quoted value after ``=`` or ``:``."""
    return F.regexp_replace(line, java_pattern(K.JS_REDACT_PATTERN), "$1[REDACTED]$2")


def is_js_code(line: Column) -> Column:
    """False for blank lines and for lines that start with ``//`` or ``*``."""
    start = F.ltrim(line, F.lit(K.BLANKS))
    return ~F.substring(start, 1, 2).isin("", "//") & (F.substring(start, 1, 1) != "*")


def replace_first(text: Column, old: str, new: str) -> Column:
    """Replace the first occurrence of a literal."""
    at = F.instr(text, old)
    return F.when(at > 0, F.overlay(text, F.lit(new), at, F.lit(len(old)))).otherwise(text)


def not_blank(text: Column) -> Column:
    """True if the text has anything but blanks; null counts as blank."""
    return F.coalesce(F.length(strip(text)) > 0, F.lit(False))


def lookup_map(mapping: dict) -> Column:
    """A literal map column from a dictionary."""
    return F.create_map(*[F.lit(x) for pair in mapping.items() for x in pair])
