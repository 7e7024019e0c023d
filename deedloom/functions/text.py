"""Column-returning text functions; everything here stays inside whole-stage code generation.

Null in gives null out unless a function says otherwise; empty text is an ordinary value.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The code point ranges that Python's str.isspace() accepts in the Basic Multilingual Plane.
SPACE_RANGES = (
    (0x09, 0x0D), (0x1C, 0x20), (0x85, 0x85), (0xA0, 0xA0), (0x1680, 0x1680),
    (0x2000, 0x200A), (0x2028, 0x2029), (0x202F, 0x202F), (0x205F, 0x205F), (0x3000, 0x3000),
)
SPACE_CHARS = "".join(chr(c) for a, b in SPACE_RANGES for c in range(a, b + 1))
SPACE = "[" + "".join(f"\\u{a:04x}-\\u{b:04x}" for a, b in SPACE_RANGES) + "]"

# Limits on numbered lines and headings.
MAX_CLAUSE_REMAINDER = 500
MAX_CLAUSE_TITLE = 120
MAX_HEADING_TITLE = 120
MAX_HEADING_TEXT = 150

CLAUSE = r"(?d)^(\p{Nd}+(?:\.\p{Nd}+)+)\.? (.+)$"
SECTION = r"(?d)^(\p{Nd}+)\.? (.+)$"
LETTER = r"(?id)^\(([a-z])\) (.+)$"
HEADING = rf"(?d)^(\p{{Nd}}+(?:\.\p{{Nd}}+)*){SPACE}+(.+)$"


def py_strip(c: Column) -> Column:
    """Remove leading and trailing white space of every Unicode kind (``trim`` knows only U+0020)."""
    return F.regexp_replace(c, rf"^{SPACE}+|{SPACE}+\z", "")


def collapse_ws(c: Column) -> Column:
    """White space runs become one blank; both ends are stripped."""
    return F.trim(F.regexp_replace(c, f"{SPACE}+", " "))


def is_blank(c: Column) -> Column:
    """True for null, empty and white-space-only text."""
    return F.coalesce(F.length(py_strip(c)) == 0, F.lit(True))


def group_or_null(c: Column, pattern: str, group: int) -> Column:
    """A capture group, null (not '') where the pattern does not match."""
    return F.when(c.rlike(pattern), F.regexp_extract(c, pattern, group))


def dots(c: Column) -> Column:
    """How many full stops a locator has."""
    return F.length(c) - F.length(F.replace(c, F.lit("."), F.lit("")))


def numbered_clause(norm: Column) -> Column:
    """Struct(number, remainder) of ``7.1 text``; null when it is none or the remainder exceeds 500 characters.

    ``norm`` has to be collapsed already.
    """
    number, rest = F.regexp_extract(norm, CLAUSE, 1), F.regexp_extract(norm, CLAUSE, 2)
    return F.when(
        norm.rlike(CLAUSE) & (F.length(rest) <= MAX_CLAUSE_REMAINDER),
        F.struct(number.alias("number"), rest.alias("remainder")),
    )


def section_line(norm: Column) -> Column:
    """Struct(number, title) of ``7. Title``, null otherwise."""
    return F.when(
        norm.rlike(SECTION),
        F.struct(F.regexp_extract(norm, SECTION, 1).alias("number"), F.regexp_extract(norm, SECTION, 2).alias("title")),
    )


def letter_item(norm: Column) -> Column:
    """The letter of ``(a) text`` in lower case, null otherwise."""
    return F.lower(group_or_null(norm, LETTER, 1))


def is_section_heading(block_type: Column, text: Column) -> Column:
    """The strict heading test: a text block of at most 150 characters whose title has at most 120."""
    stripped = py_strip(text)
    pattern = rf"(?d)^(\p{{Nd}}+)\.?{SPACE}+(.+)$"
    return F.coalesce(
        (block_type == "text")
        & (stripped != "")
        & stripped.rlike(pattern)
        & (F.length(py_strip(F.regexp_extract(stripped, pattern, 2))) <= MAX_HEADING_TITLE)
        & (F.length(stripped) <= MAX_HEADING_TEXT),
        F.lit(False),
    )


def parse_heading(heading: Column) -> Column:
    """Struct(locator, title, level): ``2.1 Fees`` gives (2.1, Fees, 2), any other text (null, text, null)."""
    stripped = py_strip(heading)
    hit = stripped.rlike(HEADING)
    locator = F.when(hit, F.regexp_extract(stripped, HEADING, 1))
    return F.struct(
        locator.alias("locator"),
        F.when(hit, py_strip(F.regexp_extract(stripped, HEADING, 2))).otherwise(stripped).alias("title"),
        (dots(locator) + 1).cast("int").alias("level"),
    )


def evidence_fold(nfkc_text: Column) -> Column:
    """The comparison form of evidence: ASCII letters and digits in lower case, everything else one blank."""
    return F.lower(F.trim(F.regexp_replace(nfkc_text, "[^a-zA-Z0-9]+", " ")))


def holds(haystack: Column, needle: Column) -> Column:
    """``needle in haystack`` as a definite boolean; a null on either side is False, an empty needle True."""
    return F.coalesce(F.contains(haystack, needle), F.lit(False))


def file_suffix(name: Column) -> Column:
    """The suffix with its dot as pathlib has it: none for dot files and names that end in a dot."""
    base = F.regexp_extract(name, r"([^/]*)/*$", 1)
    return F.regexp_extract(base, r"^.*[^./].*?(\.[^./]+)$", 1)
