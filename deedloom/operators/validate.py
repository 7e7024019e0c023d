"""Grounding checks: every candidate against the text of its chunk; the first failing check gives the reason."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from deedloom.functions.text import holds, is_blank
from deedloom.functions.unicode import evidence
from deedloom.operators.extract import FIELDS

# Reasons are compared literally by users of the report.
UNSUPPORTED = "source_text is not supported by the document chunk."
NO_NAME = "party name does not appear in the document chunk."
NO_DESIGNATION = (
    "Party was accepted, but its designation was not explicitly supported by source_text. Designation was removed."
)
NO_TERM = "defined term does not appear in the document chunk."
NO_PATTERN = (
    "source_text does not contain an explicit definition pattern such as 'means', 'shall mean', 'refers to', or "
    "'includes'."
)
NO_OBLIGED = "obligation has no responsible party."
NO_DUTY = "obligation has no action."
NO_HOLDER = "right has no receiving party."
NO_RIGHT = "right has no action."
NO_TARGET = "reference target does not appear in source_text."

# Definition verbs as they look once folded; compat joins the words of all but two of them.
VERBS_COMPAT = ("means", "includes", "shallmean", "refersto", "isdefinedas", "shallbedefinedas")
VERBS_FIXED = ("means", "includes", "shall mean", "refers to", "is defined as", "shall be defined as")

TYPE_ORDER = {k: i for i, k in enumerate(FIELDS)}


def supported(source_raw: Column, source: Column, chunk: Column) -> Column:
    """The folded source is in the folded chunk and the raw source isn't blank; punctuation alone is supported."""
    return ~is_blank(source_raw) & holds(chunk, source)


def mentions(haystack_raw: Column, needle_raw: Column, haystack: Column, needle: Column) -> Column:
    """Both raw texts are non-empty and the folded needle is in the folded haystack, at any character."""
    full = (F.coalesce(haystack_raw, F.lit("")) != "") & (F.coalesce(needle_raw, F.lit("")) != "")
    return full & holds(haystack, needle)


def defines(term: Column, source: Column, mode: str = "compat") -> Column:
    """The folded term is followed by a definition verb in the folded source. ``mode``: compat or fixed."""
    verbs = VERBS_COMPAT if mode == "compat" else VERBS_FIXED
    padded = F.concat(source, F.lit(" "))
    hits = [holds(padded, F.concat(term, F.lit(f" {v} "))) for v in verbs]
    return (F.coalesce(term, F.lit("")) != "") & reduce(lambda a, b: a | b, hits)


def _first(*checks: tuple[Column, str]) -> Column:
    out = F.when(checks[0][0], checks[0][1])
    for failed, reason in checks[1:]:
        out = out.when(failed, reason)
    return out


def check(candidates: DataFrame, chunks: DataFrame, mode: str = "compat") -> DataFrame:
    """Candidates in long form with ``status`` (accept, repair, reject) and ``reason``.

    Chunk texts are folded once per chunk and meet the candidates of all classes in one join. A candidate whose chunk
    doesn't exist is rejected as unsupported. Repeated candidates are kept apart by their ``item_index``; rows of other
    kinds than the five classes, such as errors, are left out.
    """
    chunk_texts = chunks.select("doc_id", "chunk_id", F.col("text").alias("_raw"), evidence(F.col("text")).alias("_chunk"))
    subject = F.coalesce("name", "term", "target")
    rows = (
        candidates.where(F.col("kind").isin(*FIELDS))
        .withColumns({"_src": evidence(F.col("source_text")), "_subject": subject})
        .withColumns({"_key": evidence(F.col("_subject")), "_alias": evidence(F.col("designation"))})
        .join(chunk_texts, ["doc_id", "chunk_id"], "left")
    )
    raw, chunk, src, named, key = (F.col(c) for c in ("_raw", "_chunk", "_src", "_subject", "_key"))
    ungrounded = ~supported(F.col("source_text"), src, chunk)
    absent = ~mentions(raw, named, chunk, key)
    no_party, no_action = is_blank(F.col("party")), is_blank(F.col("action"))
    alias = F.col("designation")
    by_kind = {
        "party": _first((ungrounded, UNSUPPORTED), (absent, NO_NAME)),
        "defined_term": _first((ungrounded, UNSUPPORTED), (absent, NO_TERM), (~defines(key, src, mode), NO_PATTERN)),
        "obligation": _first((no_party, NO_OBLIGED), (no_action, NO_DUTY), (ungrounded, UNSUPPORTED)),
        "right": _first((no_party, NO_HOLDER), (no_action, NO_RIGHT), (ungrounded, UNSUPPORTED)),
        "reference": _first((ungrounded, UNSUPPORTED), (~mentions(F.col("source_text"), named, src, key), NO_TARGET)),
    }
    reason = reduce(lambda w, k: w.when(F.col("kind") == k, by_kind[k]), by_kind, F.when(F.lit(False), F.lit(None).cast("string")))
    unsupported_alias = (F.coalesce(alias, F.lit("")) != "") & ~mentions(F.col("source_text"), alias, src, F.col("_alias"))
    out = rows.withColumn("_bad", reason).withColumn("_fix", F.col("_bad").isNull() & (F.col("kind") == "party") & unsupported_alias)
    return out.select(
        *candidates.columns,
        F.when(F.col("_bad").isNotNull(), "reject").when(F.col("_fix"), "repair").otherwise("accept").alias("status"),
        F.coalesce("_bad", F.when(F.col("_fix"), NO_DESIGNATION)).alias("reason"),
    )


def accepted(checked: DataFrame) -> DataFrame:
    """What passes, in long form with ``source_chunk_id``; an unsupported designation is taken away."""
    kept = checked.where("status <> 'reject'").withColumn("designation", F.when(F.col("status") == "accept", F.col("designation")))
    return kept.drop("status", "reason").withColumn("source_chunk_id", F.col("chunk_id"))


def as_json(*extra: Column) -> Column:
    """The fields of an item's class as JSON, null ones included."""
    out = None
    for kind, fields in FIELDS.items():
        row = F.to_json(F.struct(*fields, *extra), {"ignoreNullFields": "false"})
        out = F.when(F.col("kind") == kind, row) if out is None else out.when(F.col("kind") == kind, row)
    return out


def issues(checked: DataFrame) -> DataFrame:
    """One row per problem; ``item`` holds the candidate as it came, null fields included."""
    order = F.element_at(F.create_map(*[F.lit(x) for kv in TYPE_ORDER.items() for x in kv]), F.col("kind"))
    return checked.where("status <> 'accept'").select(
        "doc_id",
        "chunk_id",
        order.alias("type_ord"),
        F.when(F.col("status") == "repair", "party_designation").otherwise(F.col("kind")).alias("item_type"),
        "item_index",
        "reason",
        "source_text",
        as_json(F.lit(None).cast("int").alias("source_chunk_id")).alias("item"),
    )


def validate(candidates: DataFrame, chunks: DataFrame, mode: str = "compat") -> tuple[DataFrame, DataFrame]:
    """(what passes, the issues), both in long form over all classes."""
    checked = check(candidates, chunks, mode)
    return accepted(checked), issues(checked)


def report(chunks: DataFrame, found: DataFrame, validated: bool = True) -> DataFrame:
    """Per document: chunks validated (0 if validation was off) and the number of issues."""
    n = chunks.groupBy("doc_id").agg(F.countDistinct("chunk_id").alias("n"))
    i = found.groupBy("doc_id").agg(F.count("*").alias("i"))
    return n.join(i, "doc_id", "left").select(
        "doc_id",
        (F.col("n") if validated else F.lit(0)).cast("int").alias("chunks_validated"),
        F.coalesce("i", F.lit(0)).cast("int").alias("n_issues"),
    )
