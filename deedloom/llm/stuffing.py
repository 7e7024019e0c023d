"""Keyword-stuffed and link-list texts (problem 10): pointwise mutual information of neighbouring words from corpus
counts gives repeated collocations, incoherent word salad, and words that only keep the company of stuffing."""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words that a link counts for, the least a finding must have of stuffing words, and the share from which a text is one.
LINK_WORDS, LEAST_WORDS, MAJORITY = 3, 12, 0.55
#: A collocation is repeated from so many occurrences in a text on, with so much mutual information, if it is so many
#: times as frequent there as in the other texts.
REPEATED, COLLOCATION_PMI, BURST = 3, 1.0, 5.0
#: So many segments in a row, none a sentence and none longer than so many words, are strung-together items.
LIST_ITEMS, ITEM_WORDS = 6, 3
#: The mean share of stuffing in the other texts with a word: below, the word is an ordinary one; a text whose words
#: keep such company on average is stuffing too.
ORDINARY, COMPANY = 0.2, 0.23
#: Mutual information beyond chance needs words of so many other occurrences; what is added to both counts; so many
#: deviations below the corpus' middle a text is word salad.
KNOWN, SMOOTH, DEVIATIONS = 20, 0.02, 8.0
#: Length of the runs by which repeated sentences are told from repeated keywords: of mostly ordinary words, of any words.
PLAIN_RUN, RUN = 4, 6

_URL = re.compile(r"(?:https?://|www\.)[^\s)\]>\"|]+")
_WORD = re.compile(r"[^\W_]+(?:['’][^\W_]+)*")
_DIGITS = re.compile(r"\d+")
_CJK = re.compile(r"[぀-ヿ㐀-鿿]")
_RUNS = re.compile(r"[ァ-ヿ]+|[ぁ-ゟ]+|[㐀-鿿々〆]+|[^぀-ヿ㐀-鿿々〆]+")
_OVER = re.compile(r"(.{2,12}?)\1+")
_UNSPACED_ENDS = re.compile(r"[、，；：｜・「」『』【】（）]|(?<=[。！？])")
_CUTS = re.compile(r"[\n|;•·»]+|\s[/#]\s?|(?<=[.!?])\s+|,\s")
_ENDED = re.compile(r"[.!?…。！？؟।][\"'”’»)\]*_]*\s*$")
#: Hiragana words of three letters and more that are no keywords even if they stand alone.
ENDINGS = frozenset(
    """ください でした ました ません ありません あります います しました ありがとう ありがとうございます について こちら これは
    それは という けれど だから しかし そして でしょう""".split()
)
_CODE = re.compile(r"\[code\].*?(?:\[/code\]|\Z)|<(pre|code)\b.*?(?:</\1>|\Z)|```.*?(?:```|\Z)", re.S | re.I)


@dataclass
class Words:
    """A text's words: segments of folded words, which of them are ended like sentences, how many links there are, and
    words of code."""

    segments: list[list[str]] = field(default_factory=list)
    ended: list[bool] = field(default_factory=list)
    links: int = 0
    code: int = 0

    def __str__(self) -> str:
        """Words by blanks, segments by their ends."""
        return "".join(" ".join(s) + ("\r" if e else "\n") for s, e in zip(self.segments, self.ended))

    @classmethod
    def read(cls, folded: str, links: int, code: int) -> "Words":
        """Back from :meth:`__str__`."""
        parts = folded.replace("\r", "\r\n").split("\n")[:-1]
        return cls([p.rstrip("\r").split(" ") for p in parts], [p.endswith("\r") for p in parts], links, code)

    def stream(self) -> list[str]:
        return [w for s in self.segments for w in s]


def unspaced(word: str) -> list[str]:
    """Words of a stretch of Japanese: runs of one script, where a run says one thing over and over its parts, else long
    runs of Chinese characters by twos. Hiragana beside other scripts are particles and endings; a hiragana word by
    itself is a keyword like any other, folded to katakana."""
    out = []
    for run in _RUNS.findall(word):
        if "ぁ" <= run[0] <= "ゟ":
            alone = run == word and len(run) > 2 and run not in ENDINGS
            run = "".join(chr(ord(c) + 0x60) if "ぁ" <= c <= "ゖ" else c for c in run) if alone else run
            if not alone:
                out.append(run)
                continue
        again = _OVER.fullmatch(run) if len(run) > 3 and _CJK.match(run) else None
        if again:
            out += [again[1]] * (len(run) // len(again[1]))
        elif len(run) > 4 and "㐀" <= run[0] <= "鿿":
            out += [run[i : i + 2] for i in range(0, len(run), 2)]
        else:
            out.append(run)
    return out


def fold(text: str) -> Words:
    """Markup away, links counted and taken out, numbers alike, lower case; segments end with lines, sentences and list
    separators. Scripts without blanks are cut into words by :func:`unspaced`."""
    out = Words()
    t = html.unescape(html.unescape(text)) if "&" in text else text

    def code(m: re.Match) -> str:
        out.code += len(_WORD.findall(m[0]))
        return "\n"

    if "[" in t or "<" in t or "`" in t:
        t = _CODE.sub(code, t)
        t = re.sub(r"\[url=([^\]]*)\]", r" \1 ", t, flags=re.I)
        t = re.sub(r"<a\s[^>]*?href=[\"']?([^\"'>\s]*)[^>]*>", r" \1 ", t, flags=re.I)
        t = re.sub(r"</?[a-zA-Z][^>]*>", "\n", t)
        t = re.sub(r"\[/?[a-zA-Z]+(?:=[^\]]*)?\]", " ", t)
    t, out.links = _URL.subn("\n", t)
    cjk = not t.isascii() and _CJK.search(t)
    if cjk:
        t = _UNSPACED_ENDS.sub("\n", t)
    for s in _CUTS.split(t):
        found = _WORD.findall(s.replace("_", " "))
        if found:
            if cjk:
                found = [x for y in found for x in (unspaced(y) if _CJK.search(y) else (y,))]
            out.segments.append([_DIGITS.sub("#", w.lower()) for w in found])
            out.ended.append(bool(_ENDED.search(s)))
    return out


def pairs_of(words: Words) -> Counter:
    """Neighbouring words within segments, and from one segment to the next."""
    stream = words.stream()
    return Counter(zip(stream, stream[1:]))


def inside_of(words: Words) -> Counter:
    """Neighbouring words within segments."""
    inside: Counter = Counter()
    for s in words.segments:
        if len(s) > 1:
            inside.update(zip(s, s[1:]))
    return inside


def repeated_sentences(words: Words, ordinary: set[str]) -> list[list[bool]]:
    """Per segment the words that belong to sentences or parts of sentences that repeat: runs of different words that
    occur again, of four words of which three are ordinary, or of six in an ended segment that doesn't repeat itself;
    and whole ended segments of five words and more that occur again."""
    whole = Counter(tuple(s) for s, e in zip(words.segments, words.ended) if e and len(s) >= RUN - 1)
    runs: Counter = Counter()
    for s in words.segments:
        for size in (PLAIN_RUN, RUN):
            runs.update(tuple(s[i : i + size]) for i in range(len(s) - size + 1))
    out = []
    for s, e in zip(words.segments, words.ended):
        mark = [e and whole[tuple(s)] > 1] * len(s)
        once = e and len(s) >= RUN and max(Counter(zip(s, s[1:])).values()) == 1
        for size, able in ((PLAIN_RUN, bool(ordinary)), (RUN, once)):
            for i in range(len(s) - size + 1) if able else ():
                g = s[i : i + size]
                if runs[tuple(g)] > 1 and len(set(g)) == size and (size == RUN or sum(x in ordinary for x in g) >= size - 1):
                    mark[i : i + size] = [True] * size
        out.append(mark)
    return out


def list_segments(words: Words, ordinary: set[str]) -> list[bool]:
    """Which segments are items of a list: many short ones in a row, not mostly of ordinary words."""
    out = [False] * len(words.segments)
    start = 0
    for k in range(len(out) + 1):
        if k == len(out) or words.ended[k] or len(words.segments[k]) > ITEM_WORDS:
            if k - start >= LIST_ITEMS:
                w = [x for s in words.segments[start:k] for x in s]
                if 2 * sum(x in ordinary for x in w) < len(w):
                    out[start:k] = [True] * (k - start)
            start = k + 1
    return out


def stuffing_words(words: Words, strong: set[tuple[str, str]], ordinary: set[str] = frozenset()) -> int:
    """How many words belong to strong collocations, stand next to them, or are items of a list, but belong to no
    sentence that repeats."""
    items = list_segments(words, ordinary)
    if not strong:
        return sum(len(s) for s, x in zip(words.segments, items) if x)
    marked = 0
    for s, item, sentence in zip(words.segments, items, repeated_sentences(words, ordinary)):
        if item:
            marked += len(s)
            continue
        hit = [False] * len(s)
        for i, p in enumerate(zip(s, s[1:])):
            if p in strong:
                hit[i] = hit[i + 1] = True
        near = [h or (i > 0 and hit[i - 1]) or (i + 1 < len(s) and hit[i + 1]) for i, h in enumerate(hit)]
        marked += sum(h and not x for h, x in zip(near, sentence))
    return marked


def read_once(df: DataFrame, key: str, text: str) -> DataFrame:
    """(k, h, folded, links, code, n, w, wn, pair, a, b, m, i): texts folded once. ``w`` are digests of the text's
    distinct words and ``wn`` how often each occurs; ``pair`` are digests of its neighbouring words ``a`` and ``b``, ``m``
    how often they occur, ``i`` how often within segments. ``h`` is a digest of the text, by which copies are known.

    Digests have 64 bits; two words or pairs that share one by chance would share their counts. Null texts count as empty.
    """
    kind = dict(df.dtypes)[key]
    strings, numbers = pa.list_(pa.string()), pa.list_(pa.int32())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for t in batch.column(2).to_pylist():
                f = fold(t)
                one, two, inside = Counter(f.stream()), pairs_of(f), inside_of(f)
                rows.append(
                    (str(f), f.links, f.code, one.total(), list(one), list(one.values()), [x for x, _ in two], [y for _, y in two],
                     list(two.values()), [inside[p] for p in two])
                )
            c = list(zip(*rows)) if rows else [[]] * 10
            kinds = [pa.string(), pa.int32(), pa.int32(), pa.int64(), strings, numbers, strings, strings, numbers, numbers]
            made = [pa.array(x, t) for x, t in zip(c, kinds)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *made], names=["k", "h", *names])

    names = ["folded", "links", "code", "n", "w", "wn", "a", "b", "m", "i"]
    schema = f"k {kind}, h bigint, folded string, links int, code int, n bigint, w array<string>, wn array<int>, a array<string>, b array<string>, m array<int>, i array<int>"
    t = F.coalesce(F.col(text), F.lit(""))
    read = df.select(F.col(key).alias("k"), digest(text).alias("h"), t.alias("t")).mapInArrow(run, schema)
    digests = lambda c: F.transform(c, lambda x: F.xxhash64(x))
    read = read.select("k", "h", "folded", "links", "code", "n", digests("w").alias("w"), "wn", digests("a").alias("a"), digests("b").alias("b"), "m", "i")
    return read.withColumn("pair", F.zip_with("a", "b", lambda x, y: F.xxhash64(x, y)))


def digest(text: str) -> Column:
    """A text's digest, by which its copies are known; null counts as empty."""
    return F.xxhash64(F.coalesce(F.col(text), F.lit("")))


def with_copies(rows: DataFrame, df: DataFrame, text: str) -> DataFrame:
    """The rows with how many of them have the same text, counted in ``df`` itself lest texts are folded for it."""
    several = df.select(digest(text).alias("h")).groupBy("h").agg(F.count("*").alias("copies")).where("copies > 1")
    return rows.join(several, "h", "left").withColumn("copies", F.coalesce("copies", F.lit(1)))


def mutual_information(rows: DataFrame) -> tuple[DataFrame, int]:
    """(pair, n_ab, n_a, n_b): counts of neighbouring words and of each of them over all texts; and the sum of words."""
    one = rows.select(F.explode(F.arrays_zip("w", "wn")).alias("x")).groupBy(F.col("x.w").alias("w")).agg(F.sum("x.wn").alias("n"))
    two = rows.select(F.explode(F.arrays_zip("pair", "a", "b", "m")).alias("x"))
    two = two.groupBy("x.pair").agg(F.sum("x.m").alias("n_ab"), F.first("x.a").alias("a"), F.first("x.b").alias("b"))
    both = two.join(one.select(F.col("w").alias("a"), F.col("n").alias("n_a")), "a").join(one.select(F.col("w").alias("b"), F.col("n").alias("n_b")), "b")
    total = rows.agg(F.sum("n")).first()[0] or 1
    return both.select("pair", "n_ab", "n_a", "n_b"), total


def pair_measures(rows: DataFrame, counts: DataFrame, total: int) -> DataFrame:
    """(row, mean_pmi, coherence, n_known, strong): of every text the mean mutual information of its neighbouring words;
    the same beyond what the text and its copies add to the counts, over words that other texts have often enough; and
    which of its pairs are repeated collocations (positions in ``pair``)."""
    own = rows.select("row", "copies", "n", F.posexplode(F.arrays_zip("pair", "m", "i")).alias("pos", "x")).select("row", "copies", "n", "pos", "x.pair", "x.m", "x.i")
    met = own.join(counts, "pair")
    others = lambda c: F.greatest(F.col(c) - F.col("copies") * F.col("m"), F.lit(0))
    n = float(total)
    pmi = F.log(F.col("n_ab") * F.lit(n) / (F.col("n_a") * F.col("n_b")))
    chance = others("n_a") * others("n_b") / F.lit(n)
    known = (others("n_a") >= KNOWN) & (others("n_b") >= KNOWN)
    beyond = F.log((others("n_ab") + SMOOTH) / (chance + SMOOTH))
    elsewhere = F.greatest(F.lit(n) - F.col("copies") * F.col("n"), F.lit(1.0))
    burst = F.col("m") * elsewhere >= BURST * F.col("n") * others("n_ab")
    strong = (F.col("i") >= REPEATED) & (pmi >= COLLOCATION_PMI) & burst
    m_known = F.when(known, F.col("m")).otherwise(0)
    return met.groupBy("row").agg(
        (F.sum(pmi * F.col("m")) / F.sum("m")).alias("mean_pmi"),
        (F.sum(F.when(known, beyond * F.col("m"))) / F.sum(m_known)).alias("coherence"),
        F.sum(m_known).alias("n_known"),
        (F.sum(F.when(strong, F.col("m")).otherwise(0)) / F.sum("m")).alias("repeated"),
        F.collect_list(F.when(strong, F.col("pos"))).alias("strong"),
    )


def marked(rows: DataFrame) -> DataFrame:
    """(row, n_marked): stuffing words of texts, given their strong pairs and their ordinary words by position."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for folded, strong, ordinary in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3))):
                f = Words.read(folded, 0, 0)
                pairs = list(pairs_of(f)) if strong else []
                names = list(Counter(f.stream())) if ordinary else []
                out.append(stuffing_words(f, {pairs[p] for p in strong}, {names[p] for p in ordinary}))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.int32())], names=["row", "n_marked"])

    return rows.select("row", "folded", "strong", "ordinary").mapInArrow(run, "row bigint, n_marked int")


def word_company(rows: DataFrame) -> DataFrame:
    """(row, company, n_company, ordinary): of every text the mean, over its words that other texts have too, of those texts'
    mean share of stuffing; how many words these are; and which of its words are ordinary (positions in ``w``), where its own share asks for it."""
    own = rows.select("row", "copies", "share", F.posexplode(F.arrays_zip("w", "wn")).alias("pos", "x")).select("row", "copies", "share", "pos", "x.w", "x.wn")
    sums = own.groupBy("w").agg(F.sum("share").alias("shares"), F.count("*").alias("texts"))
    others = F.col("texts") - F.col("copies")
    c = F.greatest((F.col("shares") - F.col("copies") * F.col("share")) / others, F.lit(0.0))
    met = own.join(sums.where("texts > 1"), "w").where(others > 0).withColumn("c", c)
    plain = F.when((F.col("share") >= MAJORITY) & (F.col("c") < ORDINARY), F.col("pos"))
    return met.groupBy("row").agg((F.sum(F.col("c") * F.col("wn")) / F.sum("wn")).alias("company"), F.sum("wn").alias("n_company"), F.collect_list(plain).alias("ordinary"))


def share_of(n_marked: Column) -> Column:
    """The share of stuffing in a text: marked words and links."""
    return (n_marked + LINK_WORDS * F.col("links")) / F.greatest(F.col("n") + LINK_WORDS * F.col("links") + F.col("code"), F.lit(1))


def scores(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, n_words, n_stuffing, share, mean_pmi, coherence, n_known, repeated, company, n_company, salad): one row per text, empty
    and null ones too, with every measure from counts over all texts.

    Every pair and every word of a text meets its counts in an equality join, where adaptive execution splits hot ones;
    of a text at most its own pairs come together. Texts are folded once. A measure for which a text has nothing (no
    pair, no word known elsewhere) is null. Repeated keys are judged row by row.
    """
    from deedloom.session import cut_lineage

    rows = cut_lineage(with_copies(read_once(df, key, text).withColumn("row", F.monotonically_increasing_id()), df, text))
    counts, total = mutual_information(rows)
    empty = F.array().cast("array<int>")
    pairs = cut_lineage(pair_measures(rows, counts, total))
    both = rows.join(pairs, "row", "left").withColumn("strong", F.coalesce("strong", empty)).withColumn("ordinary", empty)
    first = both.select("row", "copies", "w", "wn", "folded", "strong", "ordinary", "links", "n", "code", "k")
    first = first.join(marked(both), "row").withColumn("share", share_of(F.col("n_marked")))
    first = cut_lineage(first)
    company = cut_lineage(word_company(first))
    again = marked(first.drop("ordinary").where(F.col("share") >= MAJORITY).join(company.select("row", "ordinary"), "row").where("size(ordinary) > 0"))
    middle = pairs.agg(F.percentile_approx("coherence", 0.5)).first()[0] or 0.0
    spread = pairs.agg(F.percentile_approx(F.abs(F.col("coherence") - middle), 0.5)).first()[0] or 0.0
    floor = middle - DEVIATIONS * 1.4826 * spread
    out = first.join(again.withColumnRenamed("n_marked", "n_left"), "row", "left").join(company.select("row", "company", "n_company"), "row", "left")
    out = out.join(pairs.drop("strong"), "row", "left").withColumn("n_stuffing", F.coalesce("n_left", "n_marked") + LINK_WORDS * F.col("links"))
    salad = F.coalesce((F.col("n_known") >= LEAST_WORDS) & (F.col("n_known") * 2 >= F.col("n")) & (F.col("coherence") < floor), F.lit(False))
    return out.select(
        F.col("k").alias(key), F.col("n").alias("n_words"), "n_stuffing", share_of(F.coalesce("n_left", "n_marked")).alias("share"),
        "mean_pmi", "coherence", "n_known", "repeated", "company", "n_company", salad.alias("salad"),
    )


def is_stuffed() -> Column:
    """What the measures of :func:`scores` say: most words are stuffing, or keep the company of stuffing, or hang
    together less than chance would have it."""
    by_company = (F.col("company") >= COMPANY) & (F.col("n_company") >= LEAST_WORDS) & (2 * F.col("n_company") >= F.col("n_words"))
    return (F.col("share") >= MAJORITY) & (F.col("n_stuffing") >= LEAST_WORDS) | F.coalesce(by_company, F.lit(False)) | F.col("salad")


def stuffed(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key): texts of which most words are repeated or strung-together keywords, place names, links or tags."""
    return scores(df, key, text).where(is_stuffed()).select(key).distinct()
