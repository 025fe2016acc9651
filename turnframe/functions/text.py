"""Column-level string helpers with Python ``str`` semantics, built only
from JVM-side Spark SQL functions (no Python UDFs)."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import constants as C


def _chars(ranges) -> str:
    return "".join(chr(c) for lo, hi in ranges for c in range(lo, hi + 1))


WHITESPACE = _chars(C.WHITESPACE_RANGES)


def _class_body(ranges) -> str:
    parts = []
    for lo, hi in ranges:
        parts.append(f"\\x{{{lo:X}}}" if lo == hi else f"\\x{{{lo:X}}}-\\x{{{hi:X}}}")
    return "".join(parts)


# Java/RE2-compatible character class for Python whitespace.
WS_CLASS = "[" + _class_body(C.WHITESPACE_RANGES) + "]"
# Python's \w for str patterns: letters, numbers and underscore.
WORD_CLASS = r"[\p{L}\p{N}_]"
# Python str.splitlines() boundaries ("\r\n" counts as one).
SPLITLINES_REGEX = "\\r\\n|[" + "".join(f"\\x{{{c:X}}}" for c in C.SPLITLINES_CHARS) + "]"
# Universal newlines of Python text-mode reading.
NEWLINE_REGEX = "\\r\\n|\\r|\\n"


def strip(col: Column | str) -> Column:
    """``str.strip()``: trim Unicode whitespace at both ends (``trim`` only
    removes U+0020)."""
    return F.btrim(F.col(col) if isinstance(col, str) else col, F.lit(WHITESPACE))


def is_blank(col: Column | str) -> Column:
    return F.length(strip(col)) == 0


def _escape(phrase: str) -> str:
    out = []
    for ch in phrase:
        out.append("\\" + ch if not ch.isalnum() and ch not in " _" else ch)
    return "".join(out)


def word_pattern(phrases) -> str:
    """Case-insensitive whole-word alternation with Python's Unicode ``\\b``
    expressed as explicit look-arounds (Java ``\\b`` treats combining marks
    and joiners differently)."""
    alts = "|".join(_escape(p) for p in phrases)
    return f"(?iu)(?<!{WORD_CLASS})(?:{alts})(?!{WORD_CLASS})"


SYSTEM_REGEX = word_pattern(C.SYSTEM_PHRASES)
MEDIA_REGEX = word_pattern(C.MEDIA_PHRASES)
EDIT_MARKER_REGEX = f"(?iu){WS_CLASS}*{_escape(C.EDIT_MARKER)}{WS_CLASS}*"


# Prefilter anchors: every phrase contains one of these (lower case), and
# none uses i, s or k, the letters with extra case-insensitive equivalents
# (dotless/dotted i, long s, Kelvin sign), so ``lower(text)`` containing one
# of them is a superset of the regex matches.  The regex runs only then.
SYSTEM_ANCHORS = ["left", "added", "removed", "created", "group", "changed", "end-to-end", "adm"]
MEDIA_ANCHORS = ["tted", "deleted"]


def _any_anchor(col: Column, anchors) -> Column:
    low = F.lower(col)
    cond = low.contains(anchors[0])
    for a in anchors[1:]:
        cond = cond | low.contains(a)
    return cond


def is_system_text(col: Column) -> Column:
    return F.when(_any_anchor(col, SYSTEM_ANCHORS), F.regexp_like(col, F.lit(SYSTEM_REGEX))).otherwise(F.lit(False))


def is_media_placeholder(col: Column) -> Column:
    return F.when(_any_anchor(col, MEDIA_ANCHORS), F.regexp_like(col, F.lit(MEDIA_REGEX))).otherwise(F.lit(False))


def strip_edit_marker(col: Column) -> Column:
    """Remove every edit marker with its surrounding whitespace, then strip.
    The regex only runs on texts containing '<' (which has no case
    variants), a cheap exact prefilter."""
    return strip(F.when(F.instr(col, "<") > 0, F.regexp_replace(col, F.lit(EDIT_MARKER_REGEX), F.lit("")))
                 .otherwise(col))


def drop_trailing_empty(arr: Column) -> Column:
    """``split`` keeps an empty last element after a final separator;
    Python line iteration does not."""
    n = F.size(arr)
    return F.when((n > 0) & (F.element_at(arr, -1) == F.lit("")), F.slice(arr, 1, n - 1)).otherwise(arr)


def split_newlines(col: Column) -> Column:
    """Lines of a text read in Python text mode (universal newlines)."""
    return drop_trailing_empty(F.split(col, NEWLINE_REGEX, -1))


def split_lines(col: Column) -> Column:
    """``str.splitlines()``: all Unicode line boundaries, no trailing empty."""
    return drop_trailing_empty(F.split(col, SPLITLINES_REGEX, -1))


@lru_cache(maxsize=1)
def unicode_digits() -> tuple[str, str]:
    """(all decimal digits, their ASCII values) built by rule from the
    Unicode database, for ``translate``."""
    src, dst = [], []
    for cp in range(0x110000):
        ch = chr(cp)
        if cp > 0x7F and unicodedata.category(ch) == "Nd":
            src.append(ch)
            dst.append(str(unicodedata.decimal(ch)))
    return "".join(src), "".join(dst)


@lru_cache(maxsize=1)
def digit_not_decimal_class() -> str:
    """Characters for which ``str.isdigit()`` holds but ``int()`` fails
    (superscripts, circled digits...), built by rule."""
    cps = [cp for cp in range(0x110000) if chr(cp).isdigit() and not chr(cp).isdecimal()]
    return "[" + "".join(f"\\x{{{cp:X}}}" for cp in cps) + "]"


def ascii_digits(col: Column) -> Column:
    src, dst = unicode_digits()
    return F.translate(col, src, dst)
