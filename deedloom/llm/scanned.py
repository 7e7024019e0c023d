"""Noise in text from scanned pages (problem 2): lines are labelled by a linear-chain model over layout features, then
paragraphs are put together again, broken words joined and misread words set right by corpus counts."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


#: Where every line is shorter, a scanner may have cut the text into lines; where some are longer, too, if a sentence
#: goes on from one line to the next.
SHORT_LINE = 100
#: A line is so much longer than the ones that were filled if it isn't one of them.
BEYOND_WIDTH = 1.4
#: A running line repeats in at least so many chunks of its contract.
REPEATS = 2

# What is printed -> what a scanner makes of it.
MISREADINGS = (
    ("i", "l"), ("i", "1"), ("l", "1"), ("l", "i"), ("c", "e"), ("e", "c"), ("o", "0"), ("t", "f"), ("f", "t"), ("s", "5"),
    ("g", "9"), ("b", "6"), ("h", "b"), ("b", "h"), ("y", "v"), ("v", "y"), ("u", "ii"), ("n", "ri"), ("m", "rn"), ("rn", "m"),
    ("d", "cl"), ("cl", "d"), ("li", "h"), ("h", "li"), ("w", "vv"), ("n", "u"), ("u", "n"), ("z", "2"), ("b", "8"), ("q", "9"),
    ("a", "o"), ("o", "c"), ("m", "nn"), ("nn", "rm"), ("q", "g"), ("ri", "n"), ("ii", "u"), ("l", "t"), ("t", "l"), ("j", "i"), ("h", "n"), ("r", "i"),
)
HYPHENS = "-­¬‐‑"

PAGE_NUMBER = re.compile(
    r"""(?xi)^(?:
      [-–—\[(|•\s]*\d{1,5}[-–—\])|•\s]*                   # 12, - 12 -, [12]
    | p\s?a\s?g\s?e\s+\d{1,5}(?:\s*(?:of|/)\s*\d{1,5})?   # page 12, P a g e  12, Page 12 of 30
    | (?:p|pg|pp|seite|blatt|folio)\.?\s*\d{1,5}
    | \d{1,5}\s*(?:/|of)\s*\d{1,5}                         # 12 / 30
    | [-–—\[(\s]*[ivxl]{1,7}[-–—\])\s]*                    # roman
    )$"""
)
BARE_NUMBER = re.compile(r"^(?:\d{1,5}|[ivxl]{1,7})$", re.I)
NUMBERED = re.compile(r"^\d+(?:\.\d+)*\.?\s+\S")
BREAK = re.compile(rf"(\w[\w'’.-]*)[{HYPHENS}]\s*$")
STRIP_END = " \t\"'”’»)]"
FINAL = tuple(".;:!?．。；：")
STRIP = " \t\r\n.,;:!?()[]{}<>\"'“”‘’«»„…*_|/\\–—"


def line_key(line: Column) -> Column:
    """What running lines have in common over pages: numbers and misread letters don't matter."""
    k = F.lower(F.regexp_replace(line, r"\b\d+\b", "#"))
    k = F.regexp_replace(F.regexp_replace(k, r"\s{2,}#\s*$", ""), r"\s+", "")
    k = F.regexp_replace(F.regexp_replace(F.regexp_replace(k, "rn|ni", "m"), "cl", "d"), "ri|ii", "u")
    return F.translate(k, "i1|jft0e596h8vu", "llllllocsgbbbyn")


def is_cut(text: Column) -> Column:
    """The text was cut into lines: none is long, or some sentence goes on in lower case in the next line."""
    short = ~F.exists(F.split(text, "\n"), lambda x: F.length(x) > SHORT_LINE)
    return short | text.rlike(r"""(?<=[^\s.;:!?．。；："'”’»)\]]["'”’»)\]]{0,2}[ \t]{0,9})\n\s*\p{Ll}""")


def page_width(lines: list[str]) -> int:
    """The width to which lines were filled. Lines that go on in lower case show it; longer ones by far don't count."""
    lengths = [len(x) for x in lines]
    filled = [len(a) for a, b in zip(lines, lines[1:]) if a and b and a.rstrip(STRIP_END)[-1:] not in FINAL and b[:1].islower()]
    limit = BEYOND_WIDTH * max(filled, default=0)
    return max((n for n in lengths if not filled or n <= limit), default=0)


@dataclass
class Line:
    """A line with its features; ``label`` is what Viterbi gives it."""

    text: str
    repeats: int
    heading: bool = False
    label: str = ""


LABELS = ("B", "K", "H", "P", "E")  # body that goes on, body before a break, running header or footer, page number, empty
# Log weights of a label following another; a sentence often continues behind what interrupts it. A break
# is body to its neighbours.
_STEPS = {
    ("B", "B"): 0.0, ("B", "H"): -1.5, ("B", "P"): -1.5, ("B", "E"): -0.5,
    ("H", "B"): -0.2, ("H", "H"): -2.0, ("H", "P"): -0.7, ("H", "E"): -0.5,
    ("P", "B"): -0.2, ("P", "H"): -0.7, ("P", "P"): -3.0, ("P", "E"): -0.5,
    ("E", "B"): -0.5, ("E", "H"): -0.7, ("E", "P"): -0.7, ("E", "E"): -1.0,
}
TRANSITIONS = {(a, b): _STEPS[a.replace("K", "B"), b.replace("K", "B")] for a in LABELS for b in LABELS}
#: What the less fitting of the two body labels costs.
BREAK_COST = 2.0


# Marks of composition that running lines have and sentences lack: gaps, separators, capitals throughout,
# a code of letters, numbers and signs at the end.
COMPOSED = re.compile(r"\s{2,}\S|\s[-–|/]\s|^\W*(?:[^\Wa-z]{2,}\W+)+[^\Wa-z]{3,}\W*\d*$|\b[A-Z]{2,}[-/]\d[\w/-]*$")


def passing(line: Line) -> bool:
    """Blank, or what a sentence passes over by all appearance."""
    t = line.text.strip()
    composed = t and t[-1] not in ".;:" and not t[0].islower() and (line.repeats >= REPEATS and len(t) < 60 or COMPOSED.search(t))
    return not t or bool(composed) or bool(PAGE_NUMBER.match(t))


def neighbours(lines: list[Line]) -> tuple[list[str], list[str]]:
    """For each line the nearest before and behind it that sentences don't pass over, by one scan each way."""

    def scan(order: list[Line]) -> list[str]:
        out, last = [], ""
        for x in order:
            out.append(last)
            if not passing(x):
                last = x.text.strip()
        return out

    return scan(lines), scan(lines[::-1])[::-1]


def emissions(line: Line, before: str, after: str, width: int, wrapped: bool) -> dict[str, float]:
    """Log weights of the labels for a line from layout features: repetition in the contract, width against the page,
    whether the next word would still have fitted, sentence ends around it, number patterns."""
    t = line.text.strip()
    none = -1e9
    if not t:
        return {"B": none, "K": none, "H": none, "P": none, "E": 0.0}
    if line.heading:
        return {"B": 0.0, "K": none, "H": none, "P": none, "E": none}
    ended = not before or before[-1] in ".;:!?"
    body = header = page = 0.0
    if PAGE_NUMBER.match(t):
        bare = bool(BARE_NUMBER.match(t))
        page = 4.0 if not bare else 2.5
        if bare and (before.endswith(":") or (not wrapped and t.isdigit())):
            page = -6.0
        body, header = (-2.0 if page > 0 else 2.0), -4.0
        return {"B": body, "K": body - BREAK_COST, "H": header, "P": page, "E": none}
    page = none
    # the greedy filling of lines: a body line stops where the next word doesn't fit, or at a sentence's end
    first = after.split(" ", 1)[0] if after else ""
    fits = bool(first) and len(t) + 1 + len(first) <= width - 2
    final = t[-1] in FINAL
    ends = bool(after) and (not wrapped or fits and (final or not after[0].islower()))
    interrupts = not ended and after[:1].islower() and t[0].isupper()
    if line.repeats >= REPEATS and final and interrupts and len(t.split()) > 2:
        header += 6.0
    if line.repeats >= REPEATS:
        header += 2.0
    if line.repeats >= 3 * REPEATS:
        header += 0.5
    if final:
        body += 4.0
    if t[0].islower() or t[0] in "(;,":
        body += 4.0
    if t[-1] == "," or BREAK.search(line.text):
        body += 2.0
    if COMPOSED.search(t):
        header += 3.0
    if fits and not final:
        header += 2.0
    if not fits and not final and after and not COMPOSED.search(t):
        body += 1.5
    if not after and not final:
        header += 4.0
    if not ended and (t[0].isupper() or t[0].isdigit()) and fits:
        header += 1.0
    if not wrapped:
        header -= 1.0
    return {"B": body - BREAK_COST * ends, "K": body - BREAK_COST * (not ends), "H": header - 1.8, "P": page, "E": none}


def label(lines: list[Line]) -> list[Line]:
    """The likeliest sequence of labels (Viterbi)."""
    if not lines:
        return lines
    before, after = neighbours(lines)
    width = page_width([x.text.rstrip() for x in lines if not passing(x)])
    wrapped = evidence_of_wrapping(lines)
    score = {s: 0.0 for s in LABELS}
    back: list[dict[str, str]] = []
    for k, line in enumerate(lines):
        e = emissions(line, before[k], after[k], width, wrapped)
        if k == 0:
            score = dict(e)
            continue
        step, prev = {}, {}
        for s in LABELS:
            prev[s] = max(LABELS, key=lambda p: score[p] + TRANSITIONS[p, s])
            step[s] = score[prev[s]] + TRANSITIONS[prev[s], s] + e[s]
        back.append(prev)
        score = step
    s = max(LABELS, key=lambda x: score[x])
    for k in range(len(lines) - 1, -1, -1):
        lines[k].label = s
        if k:
            s = back[k - 1][s]
    return lines


def evidence_of_wrapping(lines: list[Line]) -> bool:
    """Somewhere a sentence goes on in the next line that isn't repeated by looks, a number or a heading."""
    inside = lambda t: t[0].islower() or t[0] in "(;," or t[-1] in ".;:!?"
    body = [x for x in lines if x.text.strip() and not x.heading and (x.repeats < REPEATS or inside(x.text.strip())) and not PAGE_NUMBER.match(x.text.strip())]
    for a, b in zip(body, body[1:]):
        end, start = a.text.strip()[-1], b.text.strip()[0]
        if end not in ".;:!?" and not re.match(r"\([a-z]\)", b.text.strip()) and (start.islower() or start.isdigit() or len(a.text) > 30):
            return True
    return False


def heading_lines(text: str, headings: list[str]) -> int:
    """How many lines at the start of the text are its headings."""
    joined = "\n".join(headings)
    return joined.count("\n") + 1 if headings and text.startswith(joined) else 0


def running_heading(heading: str) -> bool:
    """A heading that is none: unnumbered and composed like a running line."""
    h = heading.strip()
    return not NUMBERED.match(h) and bool(re.search(r"\s[-–|/]\s|\s{2,}|\d", h) or (h.isupper() and len(h.split()) > 1))


def tokens(text: str) -> list[str]:
    """Words in lower case without surrounding punctuation; those without letters are left out."""
    out = []
    for w in text.split():
        w = w.strip(STRIP).lower()
        if sum(c.isalpha() for c in w) >= 2 or (len(w) > 1 and any(c.isalpha() for c in w)):
            out.append(w)
    return out


def broken_word(line: str, follow: str) -> tuple[int, str, str] | None:
    """(where it begins, left, right) of a word that is broken at the line's end and goes on in the next."""
    m, first = BREAK.search(line), re.match(r"\S+", follow)
    if m and first and first[0][0].isalpha() and (first[0][0].islower() or line.rstrip()[-1] == "-" and m[1][-1:].isupper()):
        return m.start(), m[0].strip()[:-1], first[0]
    return None


def joined_words(lines: list[str]) -> tuple[str, list[tuple[str, str]]]:
    """(the lines as one text without the broken words, the broken words as (left, right))."""
    out, broken = [], []
    todo = [x.rstrip() for x in lines if x.strip()]
    k = 0
    carry = todo[0] if todo else ""
    while k < len(todo):
        follow = todo[k + 1].lstrip() if k + 1 < len(todo) else ""
        word = broken_word(carry, follow)
        if word:
            start, left, right = word
            broken.append((left, right))
            out.append(carry[:start])
            carry = follow[len(right) :]
        else:
            out.append(carry)
            carry = follow
        k += 1
    return "\n".join(out), broken


#: A piece of a paragraph: text as it stands, or a broken word as [left, right].
Piece = str | list[str]


def reassembled(lines: list[str], wrapped: bool, breaks: list[bool] | None = None) -> list[list[Piece]]:
    """Body lines as paragraphs. A line goes on in the next one if its last word is broken, or if the next word would no
    longer have fitted, or in lower case behind no sentence's end; lines that no scanner wrapped stay by themselves. Where
    the lines were labelled, ``breaks`` tells which end a paragraph.

    Where a full line ends a sentence, nothing shows whether the paragraph ends too; it is taken to go on.
    """
    told = [b for x, b in zip(lines, breaks) if x.strip()] if breaks else None
    todo = [x.strip() for x in lines if x.strip()]
    width = page_width(todo)
    out: list[list[Piece]] = []
    new, carry, size = True, todo[0] if todo else "", len(todo[0]) if todo else 0
    for k in range(len(todo)):
        follow = todo[k + 1] if k + 1 < len(todo) else ""
        if new:
            out.append([])
        elif carry and isinstance(out[-1][-1], str):
            out[-1].append(" ")
        word = broken_word(carry, follow)
        if word:
            start, left, right = word
            out[-1] += [carry[:start], [left, right]]
            new, carry = False, follow[len(right) :]
        else:
            out[-1].append(carry)
            first = follow.split(" ", 1)[0]
            fits = size + 1 + len(first) <= width - 1
            ended = bool(carry) and carry.rstrip(STRIP_END)[-1:] in tuple(".;:!?．。；：")
            new = told[k] if told else not wrapped or fits and (ended or not follow[:1].islower())
            carry = follow
        size = len(follow)
    return [[x for x in p if x] for p in out]


@dataclass
class Repair:
    """What one chunk's lines give: running lines and page numbers, words to check, broken words, the body's lines and
    what they and the headings are put together from."""

    rows: list[tuple[str, str, str]]
    words: dict[str, set[str]]
    broken: dict[str, set[tuple[str, str]]]
    paragraphs: list[str]
    headings: list[list[Piece]]
    text: list[list[Piece]]


def read_chunk(text: str, headings: list[str], repeats: list[int]) -> Repair:
    """Label the lines of a chunk and take it apart. Empty texts give nothing."""
    heads = [h for h in headings if h]
    n = heading_lines(text, heads)
    raw = text.split("\n")
    rows: list[tuple[str, str, str]] = []
    words: dict[str, set[str]] = {"text": set(), "headings": set()}
    broken: dict[str, set[tuple[str, str]]] = {"text": set(), "headings": set()}
    titles: list[list[Piece]] = []
    for h in heads:
        if running_heading(h):
            rows += [("headings", "header", h.strip())] + ([("text", "header", h.strip())] if n else [])
        else:
            rest, cut = joined_words(h.split("\n"))
            pieces = reassembled(h.split("\n"), True)
            titles.append([x for k, p in enumerate(pieces) for x in ([" ", *p] if k else p)])
            for field in ("headings", "text") if n else ("headings",):
                words[field] |= set(tokens(rest))
                broken[field] |= set(cut)
    lines = label([Line(x, r) for x, r in zip(raw[n:], repeats[n:])])
    kept, breaks = [], []
    for x in lines:
        if x.label in "HP" and x.text.strip():
            rows.append(("text", "header" if x.label == "H" else "page_number", x.text.strip()))
        elif x.label in "BK":
            kept.append(x.text)
            breaks.append(x.label == "K")
    rest, cut = joined_words(kept)
    words["text"] |= set(tokens(rest))
    broken["text"] |= set(cut)
    wrapped = evidence_of_wrapping([x for x in lines if x.label in "BKE"])
    return Repair(rows, words, broken, kept, titles, (titles if n else []) + reassembled(kept, wrapped, breaks))


def variants(word: str) -> list[str]:
    """Words the scanner may have had before it, with one or two misreadings undone; of words of three letters and less,
    of which two would leave too little, with one."""
    once: set[str] = set()
    for true, seen in MISREADINGS:
        at = word.find(seen)
        while at >= 0:
            once.add(word[:at] + true + word[at + len(seen) :])
            at = word.find(seen, at + 1)
    twice: set[str] = set()
    if len(word) > 3:
        for w in once:
            for true, seen in MISREADINGS:
                at = w.find(seen)
                while at >= 0:
                    twice.add(w[:at] + true + w[at + len(seen) :])
                    at = w.find(seen, at + 1)
    return [*(f"1{w}" for w in once - {word}), *(f"2{w}" for w in twice - once - {word})]


def whole_forms(left: str, right: str) -> tuple[str, str]:
    """The broken word closed up and with its hyphen, folded like other words."""
    clean = lambda w: w.strip(STRIP).lower()
    return clean(left + right), clean(f"{left}-{right}")


def recased(seen: str, right: str) -> str:
    """The right word, which is in lower case, in capitals where the seen one has them."""
    if seen.lower() == right:
        return seen
    out = []
    for op, a, b, c, d in SequenceMatcher(None, seen.lower(), right, autojunk=False).get_opcodes():
        part = right[c:d]
        if op == "equal" and len(seen.lower()) == len(seen):
            part = seen[a:b]
        elif seen.isupper() and sum(map(str.isalpha, seen)) > 1:
            part = part.upper()
        elif c == 0 and seen[:1].isupper():
            part = part[:1].upper() + part[1:]
        out.append(part)
    return "".join(out)


def put_right(pieces: list[Piece], right: dict[str, str], whole: dict[str, str]) -> str:
    """Pieces as text: misread words by ``right``, broken ones by ``whole`` (by their form with the hyphen), as they
    stand, closed up, where neither knows them."""
    out = []
    for piece in pieces:
        if isinstance(piece, str):
            words, known = re.split(r"(\s+)", piece), right
        else:
            form = whole_forms(*piece)[1]
            closed = "".join(piece)
            hyphened = (whole.get(form) or "").count("-") > closed.strip(STRIP).count("-")
            words = ["-".join(piece) if hyphened else closed]
            known = {words[0].strip(STRIP).lower(): whole.get(form)}
        for w in words:
            core = w.strip(STRIP)
            new = known.get(core.lower()) if core else None
            if new:
                at = w.index(core)
                w = w[:at] + recased(core, new) + w[at + len(core) :]
            out.append(w)
    return "".join(out)


def word_counts(chunks: DataFrame) -> DataFrame:
    """(word, n): how often words stand in texts that no scanner cut into lines."""
    spaced = F.split(F.translate(F.lower("text"), "\n\t\r\xa0", "    "), " ")  # one character: no regular expression
    forms = chunks.where(~is_cut(F.col("text"))).select(F.explode(spaced).alias("form")).groupBy("form").agg(F.count("*").alias("n"))
    word = F.regexp_replace("form", r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", "")
    return forms.select(word.alias("word"), "n").where(F.col("word").rlike(r"\p{L}")).groupBy("word").agg(F.sum("n").alias("n"))


def running_counts(cut: DataFrame) -> DataFrame:
    """(filename, chunk_id, repeats): of each chunk the lines, by position, that other chunks of the contract have, too,
    and how many have them. Chunks without such a line are left out. Lines are met by digests; blank ones don't count.
 Headings are left out, and so are
    lines that begin in lower case without any mark of composition, which :func:`emissions` makes body lines however
    often they recur.
    """
    n_heads = F.size(F.split(F.array_join("headings", "\n"), "\n"))
    lines = cut.select("filename", "chunk_id", n_heads.alias("h"), F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    able = (F.col("pos") >= F.col("h")) & F.col("line").rlike(r"^\s*[^\s\p{Ll}(;,]|\S\s{2,}\S|\s[-–|/]\s|[A-Z][-/]\d")
    keyed = lines.where(able).select("filename", "chunk_id", "pos", F.xxhash64(line_key(F.col("line"))).alias("key"))
    per_chunk = keyed.groupBy("filename", "key", "chunk_id").agg(F.collect_list("pos").alias("pos"))
    counts = per_chunk.groupBy("filename", "key").agg(F.count("*").cast("int").alias("n")).where(F.col("n") >= REPEATS)
    met = per_chunk.join(counts, ["filename", "key"]).select("filename", "chunk_id", F.explode("pos").alias("pos"), "n")
    return met.groupBy("filename", "chunk_id").agg(F.map_from_entries(F.collect_list(F.struct("pos", "n"))).alias("repeats"))


def take_apart(cut: DataFrame, layout: bool = False) -> DataFrame:
    """(filename, chunk_id, field, kind, word, a, b): running lines and page numbers as they are, words to check (kind
    ``word``) and broken words (kind ``broken``: closed form, left and right piece) of every chunk. With ``layout``, a
    row of kind ``layout`` per chunk, too, whose word is the JSON of the pieces that headings and text consist of."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for f, c, text, heads, repeats in batch.itertuples(index=False):
                found = dict(repeats) if repeats is not None else {}
                r = read_chunk(text, list(heads) if heads is not None else [], [found.get(i, 0) for i in range(text.count("\n") + 1)])
                out += [(f, c, field, kind, w, None, None) for field, kind, w in dict.fromkeys(r.rows)]
                if layout:
                    out.append((f, c, None, "layout", json.dumps([r.headings, r.text]), None, None))
                for field in ("text", "headings"):
                    out += [(f, c, field, "word", w, None, None) for w in r.words[field]]
                    for left, right in r.broken[field]:
                        out.append((f, c, field, "broken", *whole_forms(left, right), None))
            yield pd.DataFrame(out, columns=["filename", "chunk_id", "field", "kind", "word", "a", "b"])

    schema = "filename string, chunk_id int, field string, kind string, word string, a string, b string"
    return cut.select("filename", "chunk_id", "text", "headings", "repeats").mapInPandas(run, schema)


def known_words(asked: DataFrame, counts: DataFrame) -> DataFrame:
    """(word, right, n): for asked words the right one: itself if unscanned texts have it, else the most frequent word
    that misreadings could have turned into it. Words for which there is neither are left out.

    A name that only scanned contracts have is right if it is read so often that its misreadings are rare beside it.
    """
    seen = asked.groupBy("word").agg(F.count("*").alias("m"))
    sure = seen.join(counts, "word").select("word", F.col("word").alias("right"), "n")
    odd = seen.join(counts, "word", "left_anti")
    make = F.pandas_udf(lambda s: s.map(variants), T.ArrayType(T.StringType()))
    spark = asked.sparkSession
    tasks = max(spark.sparkContext.defaultParallelism * 4, int(spark.conf.get("spark.sql.shuffle.partitions")))
    tried = odd.repartition(tasks, "word").select("word", "m", F.explode(make("word")).alias("v"))
    tried = tried.select("word", "m", F.substring("v", 1, 1).cast("int").alias("steps"), F.expr("substring(v, 2)").alias("right"))
    pool = counts.withColumn("known", F.lit(1)).unionByName(odd.where("m >= 4").select("word", F.col("m").alias("n"), F.lit(0).alias("known")))
    met = tried.join(pool.withColumnRenamed("word", "right"), "right").where("known = 1 or n >= 4 * m")
    best = met.groupBy("word").agg(F.min_by(F.struct("right", "n"), F.struct("steps", -F.col("known"), -F.col("n"), "right")).alias("p"))
    return sure.unionByName(best.select("word", "p.right", "p.n"))


@dataclass
class Reading:
    """What both results of problem 2 need: chunks taken apart, misread words, broken words with their whole forms."""

    parts: DataFrame
    misread: DataFrame
    whole: DataFrame


def read_all(chunks: DataFrame, layout: bool = False) -> Reading:
    """One pass over the chunks; redelivered chunks count once. Null texts and null headings count as empty; texts with a
    line beyond the scanner's width need no repair, but their words are what misread ones are measured by."""
    from deedloom.session import cut_lineage

    rows = chunks.select("filename", "chunk_id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce("headings", F.array().cast("array<string>")).alias("headings"))
    counts = cut_lineage(word_counts(rows))
    cut = cut_lineage(rows.where(is_cut(F.col("text")) & (F.col("text") != "")).dropDuplicates(["filename", "chunk_id"]))
    parts = cut_lineage(take_apart(cut.join(running_counts(cut), ["filename", "chunk_id"], "left"), layout))
    words, broken = parts.where("kind = 'word'"), parts.where("kind = 'broken'")
    asked = words.select("word").unionByName(broken.select("word")).unionByName(broken.select(F.col("a").alias("word")))
    known = cut_lineage(known_words(asked, counts))
    wrong = known.where("word <> right")
    misread = words.join(wrong, "word").select("filename", "chunk_id", "field", "word", "right")
    closed = known.select("word", F.col("right").alias("right_c"), F.col("n").alias("n_c"))
    hyphened = known.select(F.col("word").alias("a"), F.col("right").alias("right_h"), F.col("n").alias("n_h"))
    both = broken.join(closed, "word", "left").join(hyphened, "a", "left")
    keeps = F.coalesce("n_h", F.lit(0)) > F.coalesce("n_c", F.lit(0))
    whole = F.when(keeps, F.col("right_h")).otherwise(F.coalesce("right_c", "word"))
    seen = F.when(keeps, F.col("a")).otherwise(F.col("word"))
    return Reading(parts, misread, both.select("filename", "chunk_id", "field", "a", whole.alias("word"), seen.alias("seen")))


def repairs(chunks: DataFrame) -> DataFrame:
    """(filename, chunk_id, field, kind, word): one row per repair in a chunk."""
    r = read_all(chunks)
    lines = r.parts.where("kind in ('header', 'page_number')").select("filename", "chunk_id", "field", "kind", "word")
    row = lambda df, kind, word: df.select("filename", "chunk_id", "field", F.lit(kind).alias("kind"), F.col(word).alias("word"))
    out = lines.unionByName(row(r.misread, "misread", "right")).unionByName(row(r.whole, "hyphen", "word"))
    return out.unionByName(row(r.whole.where("word <> seen"), "misread", "word")).distinct()


def repaired(chunks: DataFrame) -> DataFrame:
    """(filename, chunk_id, text, headings): every chunk with continuous paragraphs and whole headings, without running
    lines and page numbers, with the words that :func:`repairs` finds. Chunks that no scanner cut stay as they are.

    The words of a chunk are collected per chunk, which bounds them.
    """
    keys = ["filename", "chunk_id"]
    r = read_all(chunks, layout=True)
    pair = lambda df, a, b, broken: df.select(*keys, F.struct(F.lit(broken).alias("broken"), F.col(a).alias("seen"), F.col(b).alias("right")).alias("w"))
    found = pair(r.misread, "word", "right", False).unionByName(pair(r.whole, "a", "word", True))
    found = found.groupBy(*keys).agg(F.collect_set("w").alias("found"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for f, c, layout, found in batch.itertuples(index=False):
                known = ({}, {})
                for w in found if found is not None else []:
                    known[w["broken"]][w["seen"]] = w["right"]
                heads, text = ([put_right(p, *known) for p in x] for x in json.loads(layout))
                out.append((f, c, "\n".join(text), heads))
            yield pd.DataFrame(out, columns=["filename", "chunk_id", "text", "headings"])

    layout = r.parts.where("kind = 'layout'").select(*keys, F.col("word").alias("layout"))
    done = layout.join(found, keys, "left").mapInPandas(run, "filename string, chunk_id int, text string, headings array<string>")
    rest = chunks.select(*keys, "text", "headings").where(F.coalesce(~is_cut(F.col("text")) | (F.col("text") == ""), F.lit(True)) | F.col("filename").isNull() | F.col("chunk_id").isNull())
    return done.unionByName(rest.distinct().join(layout.select(*keys), keys, "left_anti"))
