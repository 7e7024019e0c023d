"""Look-alike characters and invisible ones: what several operators need to compare texts as a reader sees them."""

from __future__ import annotations

import sys
import unicodedata
from collections import defaultdict
from functools import lru_cache

from pyspark.sql import SparkSession

# Letters of other scripts and the Latin letter each looks like.
LOOKALIKES = dict(
    zip(
        "аеорсухіјѕһԁԛԝѵӏոԍАВЕКМНОРСТУХІЈЅҮԌԚԜӀαονιγρυΑΒΕΖΗΙΚΜΝΟΡΤΥΧϲϳℓ".replace(" ", ""),
        "aeopcyxijshdqwvlngABEKMHOPCTYXIJSYGQWIaovıypuABEZHIKMNOPTYXcjl".replace("ı", "i"),
    )
)
# Code points without any width.
INVISIBLE = "".join(
    map(chr, [0xAD, 0x34F, 0x61C, 0x115F, 0x1160, 0x17B4, 0x17B5, *range(0x180B, 0x180F), *range(0x200B, 0x2010),
              *range(0x202A, 0x202F), *range(0x2060, 0x2070), *range(0xFE00, 0xFE10), 0xFEFF])
)
# Marks that look like another one.
PUNCTUATION = {
    **dict.fromkeys(map(chr, (0x2010, 0x2011, 0x2012, 0x2013, 0x2212, 0x2D7, 0x2043)), "-"),
    **dict.fromkeys(map(chr, (0x2018, 0x2019, 0x201B, 0x2032, 0x2BC, 0x2B9, 0x60, 0xB4)), "'"),
    **dict.fromkeys(map(chr, (0x201C, 0x201D, 0x201F, 0x2033)), '"'),
    chr(0x2044): "/",
    chr(0x2215): "/",
    chr(0x2024): ".",
    chr(0x37E): ";",
    chr(0x2236): ":",
}
_REMOVE = dict.fromkeys(map(ord, INVISIBLE))
#: The small table, by code point, for comparisons that only fold words: without any session.
FEW = {ord(k): v for k, v in {**LOOKALIKES, **PUNCTUATION}.items()}

# How the public data write an ASCII character's prototype, where that differs from the character.
_PUBLIC_ASCII = {"l": "l1I|", "O": "O0", "'": "'`", "''": '"', "rn": "m"}


def prototype(c: str, public: str) -> str:
    """What stands for ``c``, given its prototype in the public data, which know no difference between l, 1, I and |,
    between O and 0, or between rn and m. A reader does, so the kind of ``c`` chooses: digits by digits, capitals by
    capitals, signs by signs."""
    able = _PUBLIC_ASCII.get(public)
    if able is None:
        return public
    kind = unicodedata.category(c)
    fits = [x for x in able if (x.isdigit() if kind[0] == "N" else x.isupper() if kind in ("Lu", "Lt") else not x.isalnum() if kind[0] in "PSM" else x.islower())]
    return (fits or [able[0]])[0] if public != "rn" or kind == "Ll" else public


@lru_cache(maxsize=4)
def confusables(spark: SparkSession) -> dict[int, str]:
    """The public table of look-alikes (Unicode's confusables, from the library that Spark brings along) by code point,
    bounded by the number of code points. Characters that decompose, by looks to ASCII letters and digits or to
    a letter with its accents, are left to that; accents stay as they are, and so does ASCII but for the backtick. The
    small table's entries come first."""
    checker = spark._jvm.com.ibm.icu.text.SpoofChecker.Builder().build()
    every = [chr(i) for i in range(0x80, min(sys.maxunicode, 0x1FFFF) + 1) if unicodedata.category(chr(i))[0] in "LNPS"]
    found = dict(zip(every, checker.getSkeleton("\n".join(every)).split("\n")))
    table = {}
    for c, public in found.items():
        compat = unicodedata.normalize("NFKD", c)
        if not (compat.isascii() and compat.isalnum()) and public != c and unicodedata.normalize("NFD", c) == c:
            table[ord(c)] = prototype(c, public)
    table |= FEW
    while True:  # prototypes of prototypes, so that skeletons of skeletons are the same
        closed = {c: _replaced(p, table) for c, p in table.items()}
        if closed == table:
            return table
        table = closed


def _replaced(text: str, table: dict[int, str]) -> str:
    """Prototypes before and after decomposition, since some characters lose their looks by it."""
    s = unicodedata.normalize("NFKD", text.translate(table)).translate(table)
    return unicodedata.normalize("NFKD", s).translate(_REMOVE)


def skeleton(text: str, table: dict[int, str] = FEW) -> str:
    """Drop what has no width, replace every character by its prototype, decompose, replace and decompose again; one
    blank for any run of white space. Visible accents, case, digits and words stay apart. Idempotent."""
    if text.isascii() and "`" not in text:
        return " ".join(text.split())
    return " ".join(_replaced(text.translate(_REMOVE), table).split())


def plain(text: str) -> str:
    """Skeleton in lower case without accents: for comparisons that ignore both."""
    s = skeleton(text).lower()
    return s if s.isascii() else "".join(c for c in s if not unicodedata.combining(c))
