"""Oversized texts cut at natural boundaries with overlap (problem 7): balanced targets, each moved to the strongest
boundary near by."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LIMIT, OVERLAP = 2_400, 200
#: Strength from which a boundary ends a sentence or more.
SENTENCE = 4

# Boundaries from strong to weak; a cut falls behind the match.
BOUNDARIES = (
    (6, re.compile(r"\n[ \t]*\n\s*")),
    (5, re.compile(r"\n+")),
    (4, re.compile(r"[.!?…]+[\"'”’»)\]]*\s+|[。！？]+[」』）]*|</[A-Za-z]\w*>\s*")),
    (3, re.compile(r"[;:]\s+|[；：]")),
    (2, re.compile(r",\s+|[、，]|\s[-–—]\s")),
    (1, re.compile(r"\s+|[-/|_](?=\w)")),
)


def boundaries(text: str) -> list[tuple[int, int]]:
    """(position, strength) of all natural cuts inside the text, by position; the strongest kind counts."""
    best: dict[int, int] = {}
    for strength, pattern in reversed(BOUNDARIES):
        for m in pattern.finditer(text):
            if 0 < m.end() < len(text):
                best[m.end()] = strength
    return sorted(best.items())


def spans(text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int]]:
    """(start, end) of the pieces in code points: at most ``limit`` long, each but the first starting ``overlap`` before
    the end of the one before it. A text within the limit is one piece, an empty one none.

    The smallest number of pieces gives equal targets. Each cut moves to the strongest boundary within a third of a
    piece around its target, the nearest of equals; if none is there, to the last boundary below the limit; if there is
    none either, the cut is hard, though never before a combining mark. When the remaining pieces cannot hold the rest,
    there is one piece more.
    """
    if not 0 <= overlap < limit:
        raise ValueError("the overlap must be smaller than the limit")
    n = len(text)
    if n <= limit:
        return [(0, n)] if n else []
    step = limit - overlap
    marks = boundaries(text)
    places = [p for p, _ in marks]
    from bisect import bisect_left, bisect_right

    out, start, done = [], 0, 0
    while n - start > limit:
        left = -(-(n - start - overlap) // step)  # pieces still needed, at the least
        fresh = (n - done) / left if done else (n - overlap) / left + overlap
        target = done + fresh if done else fresh
        highest = start + limit
        lowest = max(done + 1, start + overlap + 1)
        reach = step / 3
        hi = bisect_right(places, min(highest, target + reach))
        # no cut so early that the pieces counted on can't hold the rest, unless only that gives a whole sentence
        near = marks[bisect_left(places, max(lowest, target - reach, n - (left - 1) * step)) : hi]
        if max((m[1] for m in near), default=0) < SENTENCE:
            near = marks[bisect_left(places, max(lowest, target - reach)) : hi]
        if near:
            cut = max(near, key=lambda m: (m[1], -abs(m[0] - target)))[0]
        else:
            k = bisect_right(places, highest) - 1
            cut = places[k] if k >= 0 and places[k] >= lowest else 0
        if not cut:
            cut = min(highest, max(lowest, round(target)))
            while cut > lowest and unicodedata.combining(text[cut]):
                cut -= 1
        out.append((start, cut))
        done, start = cut, cut - overlap
    out.append((start, n))
    return out


def rebuild(pieces: list[str], overlap: int = OVERLAP) -> str:
    """The text the pieces were cut from."""
    return "".join(p if i == 0 else p[overlap:] for i, p in enumerate(pieces))


def oversized(chunks: DataFrame, limit: int = LIMIT) -> DataFrame:
    """Chunks whose text is longer than the limit and that no row of the same file names in ``resplit_of``.

    Reported lengths are not trusted. Exact duplicate rows count once; null texts are not too long; a chunk without a
    file or chunk id can't have been cut yet.
    """
    cut = chunks.select("filename", F.col("resplit_of").alias("chunk_id")).where("chunk_id is not null").distinct()
    long = chunks.where(F.length("text") > limit).select("dense_id", "filename", "chunk_id", "text").distinct()
    return long.join(cut, ["filename", "chunk_id"], "left_anti")


def split(rows: DataFrame, key: str, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """(key, piece_no, start, end, text): the pieces of every row's text, numbered from 0. Null texts have none."""
    kind = dict(rows.dtypes)[key]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for ident, text in zip(b.iloc[:, 0], b.iloc[:, 1]):
                if text:
                    out += [(ident, i, s, e, text[s:e]) for i, (s, e) in enumerate(spans(text, limit, overlap))]
            yield pd.DataFrame(out, columns=["k", "piece_no", "start", "end", "text"])

    cut = rows.select(F.col(key).alias("k"), F.col("text")).mapInPandas(run, f"k {kind}, piece_no int, start int, end int, text string")
    return cut.withColumnRenamed("k", key)
