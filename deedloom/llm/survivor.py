"""One surviving record per group of duplicates (problem 4): grouping by term and meaning, then ranking per field."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from deedloom.llm.chars import plain
from deedloom.sources.tables import first_load

# What stands in for a definition, folded, and the words that introduce one.
PLACEHOLDERS = frozenset(
    """tbd|tba|tbc|see above|see below|n a|na|none|null|nil|unknown|pending|todo|ditto|as above|as below|as defined below|
    as defined above|as defined herein|same as above|to be defined|to be determined|to be confirmed|not available|not applicable|
    not defined|undefined|definition|missing|x|xx|xxx""".replace("\n", "").replace("    ", "").split("|")
)
DEFINES = r"means|shall mean|mean|includes|include|refers to|is defined as|shall be defined as|has the meaning"
SOURCE = re.compile(rf"^\s*[\"“«'](.+?)[\"”»']\s+(?:{DEFINES})\s+(.+)$", re.S)
#: Sub-groups into which a group's records are ranked first, so that no hot group is sorted by one task.
SALTS = 16


def fold_term(term: str | None) -> str:
    """A term without quotation, case, punctuation, article, bracketed abbreviation and blanks."""
    t = re.sub(r"\([^()]{1,12}\)", " ", plain(term or ""))
    w = re.findall(r"\w+", t.replace("_", " "))
    while len(w) > 1 and w[0] in ("the", "a", "an", "any", "each", "such"):
        w = w[1:]
    return "".join(w)


def fold_definition(definition: str | None) -> str:
    """A definition as its words in lower case; '' where it is absent or something stands in for it."""
    w = " ".join(re.findall(r"\w+", plain(definition or "").replace("_", " ")))
    return "" if w in PLACEHOLDERS or len(w.split()) < 2 else w


def distance(a: str, b: str, most: int) -> int:
    """Edit distance with transpositions, cut at ``most`` + 1."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    before: list[int] | None = None
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        new = [i + 1]
        for j, y in enumerate(b):
            d = min(row[j] + (x != y), row[j + 1] + 1, new[j] + 1)
            if before is not None and i and j and x == b[j - 1] and a[i - 1] == y:
                d = min(d, before[j - 1] + 1)
            new.append(d)
        if min(new) > most:
            return most + 1
        before, row = row, new
    return min(row[-1], most + 1)


def same_word(a: str, b: str) -> bool:
    """Equal up to a slip; numbers never slip."""
    if a == b:
        return True
    if any(c.isdigit() for c in a + b) or min(len(a), len(b)) < 3:
        return False
    return distance(a, b, 2) <= (1 if min(len(a), len(b)) < 6 else 2)


def same_meaning(short: str, full: str) -> bool:
    """``short`` is ``full`` up to slips, or a cut of it: word by word, the last word possibly cut too."""
    a, b = short.split(), full.split()
    if not a or abs(len(a) - len(b)) > 1 and len(a) > len(b):
        return False
    if distance_of_words(a, b[: len(a)]):
        return True
    return len(a) > 1 and len(a) <= len(b) and b[len(a) - 1].startswith(a[-1]) and distance_of_words(a[:-1], b[: len(a) - 1])


def distance_of_words(a: list[str], b: list[str]) -> bool:
    """Equally many words that are the same but for slips in at most one of four; blanks may have slipped as well."""
    if len(a) == len(b):
        return all(same_word(x, y) for x, y in zip(a, b)) and sum(x != y for x, y in zip(a, b)) <= max(1, len(a) // 4)
    return abs(len(a) - len(b)) == 1 and distance("".join(a), "".join(b), 2) <= 2 and re.sub(r"\D", "", "".join(a)) == re.sub(r"\D", "", "".join(b))


def deletions(word: str) -> list[str]:
    """The word and all words one letter shorter: two words one slip apart have one of these in common."""
    return list(dict.fromkeys([word, *(word[:i] + word[i + 1 :] for i in range(len(word)))]))


def keyed(records: DataFrame) -> DataFrame:
    """(term_id, filename, sure, tk, dk): folded term and definition of every record.

    Where the source sentence is there, it has the term and the definition in full, whatever became of the fields: such
    keys are sure. Otherwise the fields give them, with '' for a definition that is absent.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for i, f, term, definition, source in b.itertuples(index=False):
                m = SOURCE.match(source) if source else None
                tk, dk = (fold_term(m[1]), fold_definition(m[2])) if m else ("", "")
                sure = bool(tk and dk)
                if not sure:
                    tk, dk = fold_term(term), fold_definition(definition)
                out.append((i, f, sure, tk, dk))
            yield pd.DataFrame(out, columns=["term_id", "filename", "sure", "tk", "dk"])

    schema = "term_id bigint, filename string, sure boolean, tk string, dk string"
    return records.select("term_id", "filename", "term", "definition", "source_text").mapInPandas(run, schema)


#: Words up to which a definition is met by its single words: two of them say too little.
FEW_WORDS = 3


def full_keys(definition: str) -> list[str]:
    """Keys by which shorter forms of a definition find it: its pairs of words at even places, its first words, and its
    words with digits."""
    w = definition.split()
    return [*(f"{p} {w[p]} {w[p + 1]}" for p in range(0, len(w) - 1, 2)), *(f"{p} {x}" for p, x in enumerate(w) if p < FEW_WORDS or has_digit(x))]


def has_digit(w: str) -> bool:
    return any(c.isdigit() for c in w)


def short_keys(definition: str) -> list[tuple[int, int, str]]:
    """(family, needed, key): of each family of keys the ``needed`` rarest, at least, let a definition meet every one
    that :func:`same_meaning` finds it to be the same as or a cut of.

    Slips are in at most one of four words (or in one), so they spoil so many of the pairs of words, which have no word
    in common; one pair more must be whole. A blank that slipped moves the words behind it by one place: if these are
    half of the pairs or more, the families -1 and 1 have them, of which all keys count; if fewer, the whole ones before
    it are more than those, and a slip besides, can push aside. Numbers never slip, so where there are
    some, the rarest of them is enough, together with all of them in the families -1 and 1. Where there are three words or less to compare, any word
    may be the one that is right.
    """
    w = definition.split()
    sure = len(w) - 1  # the last word may be cut
    out = []
    if sure > FEW_WORDS:
        for move in (0, -1, 1):
            pairs = [f"{p + move} {w[p]} {w[p + 1]}" for p in range(sure - 1) if p + move >= 0 and (p + move) % 2 == 0]
            numbers = [f"{p + move} {x}" for p, x in enumerate(w[:sure]) if has_digit(x)]
            out += [(move, len(numbers) if move else 1, k) for k in numbers] or [(move, len(pairs) if move else len(w) // 4 + 3, k) for k in pairs]
    if sure <= FEW_WORDS + 1:
        out += [(9, 3 * FEW_WORDS, f"{p + move} {x}") for p, x in enumerate(w[: FEW_WORDS + 1]) for move in (0, -1, 1) if 0 <= p + move < FEW_WORDS]
    return list(dict.fromkeys(out))


def _chosen(loose: DataFrame, met: DataFrame, anchors: DataFrame) -> DataFrame:
    """(filename, tk, dk, gt, gd): of the anchors whose terms a loose key met (filename, tk, gt, gap, quiet), and with which it
    agrees, the nearest by term and then the fullest; A key without
    definition gets one only of the terms it met as ``quiet``, and only if the nearest has one meaning.

    Definitions meet by their rarest keys, so that a term with many definitions makes no pairs of them all; keys without
    definition meet the terms' number of meanings and fullest one.
    """

    agrees = F.pandas_udf(lambda a, b: pd.Series([same_meaning(x, y) for x, y in zip(a, b)], dtype=bool), T.BooleanType())
    full = F.pandas_udf(lambda s: s.map(full_keys), T.ArrayType(T.StringType()))
    short = F.pandas_udf(lambda s: s.map(short_keys), T.ArrayType(T.StructType([T.StructField("family", T.IntegerType()), T.StructField("need", T.IntegerType()), T.StructField("key", T.StringType())])))
    order = F.struct((-F.length("gd")).alias("l"), F.col("gt").alias("gt"), F.col("gd").alias("gd"))
    terms = met.select("filename", "gt").distinct()
    keyed_anchors = anchors.join(terms, ["filename", "gt"], "left_semi").select("filename", "gt", "gd", F.explode(full("gd")).alias("key"))
    counts = keyed_anchors.groupBy("filename", "gt", "key").agg(F.count("*").alias("n"))
    said = loose.where("dk <> ''")
    asked = said.select("filename", "tk", "dk", F.explode(short("dk")).alias("k")).select("filename", "tk", "dk", "k.*").join(met, ["filename", "tk"])
    rare = Window.partitionBy("filename", "tk", "dk", "gt", "family").orderBy("n", "key")
    asked = asked.join(counts, ["filename", "gt", "key"]).withColumn("r", F.row_number().over(rare)).where("r <= need")
    pairs = asked.join(keyed_anchors, ["filename", "gt", "key"]).select("filename", "tk", "dk", "gap", "gt", "gd").distinct()
    with_definition = pairs.where(agrees("dk", "gd")).groupBy("filename", "tk", "dk").agg(F.min_by(order, F.struct("gap", order)).alias("p"))
    meanings = anchors.groupBy("filename", "gt").agg(F.count("*").alias("n"), F.min(order).alias("p"))
    silent = loose.where("dk = ''").join(met.where("quiet"), ["filename", "tk"]).join(meanings, ["filename", "gt"])
    per_gap = silent.groupBy("filename", "tk", "dk", "gap").agg(F.sum("n").alias("n"), F.min("p").alias("p"))
    nearest = per_gap.groupBy("filename", "tk", "dk").agg(F.min_by(F.struct("n", "p"), "gap").alias("x")).where("x.n = 1")
    both = with_definition.unionByName(nearest.select("filename", "tk", "dk", F.col("x.p").alias("p")))
    return both.select("filename", "tk", "dk", F.col("p.gt").alias("gt"), F.col("p.gd").alias("gd"))


def _links(loose: DataFrame, anchors: DataFrame) -> DataFrame:
    """(filename, tk, dk, gt, gd): for loose keys the anchor (filename, gt, gd) each belongs to, where there is one.

    Keys meet anchors of the same term first. What is left meets terms one slip away through deletion neighbourhoods, of
    distinct terms in contracts that have something left, so neither copies nor hot contracts make pairs; definitions are
    compared for terms that met.
    """
    from deedloom.session import cut_lineage

    same = loose.select("filename", "tk").distinct().select("filename", "tk", F.col("tk").alias("gt"), F.lit(0).alias("gap"), F.lit(True).alias("quiet"))
    exact = cut_lineage(_chosen(loose, same, anchors))
    left = cut_lineage(loose.join(exact, ["filename", "tk", "dk"], "left_anti"))
    near_terms = F.pandas_udf(lambda s: s.map(deletions), T.ArrayType(T.StringType()))

    def terms(df: DataFrame, c: str) -> DataFrame:
        return df.select("filename", c).distinct().withColumn("v", F.explode(near_terms(c)))

    def gap(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([distance(x, y, 2) for x, y in zip(a, b)], dtype="int32")

    there = anchors.join(left.select("filename").distinct(), "filename", "left_semi")
    met = terms(left, "tk").join(terms(there, "gt"), ["filename", "v"]).select("filename", "tk", "gt").distinct()
    met = met.withColumn("gap", F.pandas_udf(gap, T.IntegerType())("tk", "gt"))
    met = met.where((F.col("gap") <= 1) | ((F.col("gap") <= 2) & (F.length("tk") >= 8)))
    # a term that is sure elsewhere is a term, not a slip of a similar one; only a definition can tell otherwise
    known = anchors.select(F.col("gt").alias("tk")).distinct().withColumn("known", F.lit(True))
    quiet = (F.col("gap") == 0) | (F.col("known").isNull() & (F.length("tk") >= 8))  # short terms slip only by their definition
    met = cut_lineage(met.join(known, "tk", "left").withColumn("quiet", quiet).drop("known"))
    return exact.unionByName(_chosen(left, met, there))


def closed(links: DataFrame) -> DataFrame:
    """Links followed to their ends, doubling the step until nothing moves. A link leads to a fuller definition of the
    same term, so there are no circles."""
    from deedloom.session import cut_lineage

    at = links.select("filename", F.col("tk").alias("gt"), F.col("dk").alias("gd"), F.col("gt").alias("ngt"), F.col("gd").alias("ngd"))
    moves = at.where((F.col("gt") != F.col("ngt")) | (F.col("gd") != F.col("ngd")))
    step = links.join(moves, ["filename", "gt", "gd"], "left")
    step = step.select("filename", "tk", "dk", F.coalesce("ngt", "gt").alias("gt"), F.coalesce("ngd", "gd").alias("gd"), F.col("ngt").isNotNull().alias("moved"))
    step = cut_lineage(step)
    return step.drop("moved") if step.where("moved").isEmpty() else closed(step.drop("moved"))


def grouped(records: DataFrame) -> DataFrame:
    """(term_id, filename, gt, gd): the group, by contract, term and meaning, of every record."""
    from deedloom.session import cut_lineage

    k = cut_lineage(keyed(records))
    anchors = k.where("sure").select("filename", F.col("tk").alias("gt"), F.col("dk").alias("gd")).distinct()
    loose = k.where("not sure").select("filename", "tk", "dk").distinct()
    first = cut_lineage(_links(loose, anchors))
    rest = cut_lineage(loose.join(first, ["filename", "tk", "dk"], "left_anti"))
    # what has no source sentence anywhere in its group: the fullest of these keys stand for the others
    own = rest.where("dk <> ''").select("filename", F.col("tk").alias("gt"), F.col("dk").alias("gd"))
    links = first.unionByName(closed(cut_lineage(_links(rest, own))))
    return (
        k.join(links.withColumn("sure", F.lit(False)), ["filename", "tk", "dk", "sure"], "left")
        .select("term_id", "filename", F.coalesce("gt", "tk").alias("gt"), F.coalesce("gd", "dk").alias("gd"))
    )


def top_ids(df: DataFrame, group: list[str], ident: str, orders: dict[str, tuple[Column, list[Column]]]) -> DataFrame:
    """Per group the ``ident`` of the best record for each field, by window ranking with a total order.

    ``orders`` has for each field which records qualify and their order. Groups are ranked in salted parts first; at
    most one record per part and field goes on. A field for which nothing qualifies is null.
    """

    def ranked(rows: DataFrame, keys: list[str]) -> DataFrame:
        for name, (fits, order) in orders.items():
            w = Window.partitionBy(*keys).orderBy(F.when(fits, 0).otherwise(1), *order, F.col(ident))
            rows = rows.withColumn(f"_r_{name}", (F.row_number().over(w) == 1) & fits)
        return rows

    any_top = " or ".join(f"_r_{n}" for n in orders)
    parts = ranked(df.withColumn("_salt", F.pmod(F.hash(ident), F.lit(SALTS))), [*group, "_salt"]).where(any_top)
    best = ranked(parts.drop("_salt", *[f"_r_{n}" for n in orders]), group).where(any_top)
    return best.groupBy(*group).agg(*[F.min(F.when(F.col(f"_r_{n}"), F.col(ident))).alias(n) for n in orders])


def survivors(terms: DataFrame, models: DataFrame) -> DataFrame:
    """(group_id, term_from, definition_from, chunk_from): one row per group of two or more records.

    Redelivered rows count once. The term comes from the most trusted record (models without rank last), the definition
    from the one with the most words, the chunk from the latest with a chunk id; ties go to trust, then recency, then
    the smallest id. Missing times rank last. Null filenames form groups of their
    own; records without any term belong to no group.
    """
    rows = first_load(terms.select("term_id", "filename", "term", "definition", "source_text", "source_chunk_id", "model", "extracted_at", "loaded_at"), "term_id")
    ranks = models.groupBy("model").agg(F.min("trust_rank").alias("trust_rank"))
    n_words = F.size(F.filter(F.split(F.coalesce("definition", F.lit("")), r"(?U)\s+"), lambda w: w != ""))
    facts = rows.join(ranks, "model", "left").select(
        "term_id", "trust_rank", "extracted_at", n_words.alias("n_words"), F.col("source_chunk_id").isNotNull().alias("has_chunk")
    )
    whole = grouped(rows).where("gt <> ''").join(facts, "term_id").withColumn("filename", F.coalesce("filename", F.lit("\0")))
    group = ["filename", "gt", "gd"]
    sizes = whole.groupBy(*group).agg(F.min("term_id").alias("group_id"), F.count("*").alias("n")).where("n > 1")
    trust, latest = F.asc_nulls_last("trust_rank"), F.desc_nulls_last("extracted_at")
    best = top_ids(
        whole,
        group,
        "term_id",
        {
            "term_from": (F.lit(True), [trust, latest]),
            "definition_from": (F.lit(True), [F.desc("n_words"), trust, latest]),
            "chunk_from": (F.col("has_chunk"), [latest, trust]),
        },
    )
    return sizes.join(best, group).select("group_id", "term_from", "definition_from", "chunk_from")


def surviving(terms: DataFrame, models: DataFrame) -> DataFrame:
    """(group_id, filename, term, definition, source_chunk_id): the record that :func:`survivors` leaves of each group."""
    best = survivors(terms, models)
    rows = first_load(terms.select("term_id", "filename", "term", "definition", "source_chunk_id", "loaded_at"), "term_id")
    for at, columns in (("term_from", ["filename", "term"]), ("definition_from", ["definition"]), ("chunk_from", ["source_chunk_id"])):
        best = best.join(rows.select(F.col("term_id").alias(at), *columns), at, "left")
    return best.select("group_id", "filename", "term", "definition", "source_chunk_id")
