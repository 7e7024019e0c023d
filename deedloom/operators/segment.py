"""Clause segmentation: the reading-order state machine over blocks as running sums and grouped aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from deedloom.functions.text import (
    MAX_CLAUSE_TITLE,
    collapse_ws,
    dots,
    letter_item,
    numbered_clause,
    section_line,
)
from deedloom.operators import ordered

#: Pages that are put in order by one task.
PAGE_RANGE = 64


def classify(blocks: DataFrame) -> DataFrame:
    """Non-blank text blocks with ``norm``, ``kind`` (S section, C clause, B body), ``number``, ``rest``, ``letter``."""
    norm = F.col("norm")
    return (
        blocks.where("block_type = 'text'")
        .withColumn("norm", collapse_ws(F.col("text")))
        .where("norm <> ''")
        .withColumn("c", numbered_clause(norm))
        .withColumn("s", F.when(F.col("c").isNull(), section_line(norm)))
        .select(
            "doc_id",
            "page_number",
            "block_index",
            "norm",
            F.when(F.col("c").isNotNull(), "C").when(F.col("s").isNotNull(), "S").otherwise("B").alias("kind"),
            F.coalesce("c.number", "s.number").alias("number"),
            F.coalesce("c.remainder", "s.title").alias("rest"),
            letter_item(norm).alias("letter"),
        )
    )


def marked(blocks: DataFrame) -> DataFrame:
    """Classified blocks with ``grp`` (which opener they follow) and ``sec``; rows before the first opener are gone.

    Running sums over page ranges, then within them: a document that holds much of the corpus is sorted range by range.
    A numbered clause that comes first in its document opens an implicit section, which shifts the others by one.
    """
    sums = {"grp": (F.col("kind") != "B").cast("int"), "sec": (F.col("kind") == "S").cast("int")}
    opener = {"_first": F.when(F.col("kind") != "B", F.col("kind"))}
    part = F.floor(F.col("page_number") / PAGE_RANGE)
    rows = ordered.running(classify(blocks), "doc_id", part, ["page_number", "block_index"], sums, opener).where("grp > 0")
    return rows.withColumn("sec", F.col("sec") + (F.col("_first") == "C").cast("int")).drop("_first")


def groups(blocks: DataFrame) -> DataFrame:
    """One row per opener with the text and pages of what follows it."""
    ord_ = F.struct("page_number", "block_index")
    return (
        marked(blocks)
        .groupBy("doc_id", "sec", "grp")
        .agg(
            F.min_by(F.struct("kind", "number", "rest", "page_number"), ord_).alias("o"),
            F.max("page_number").alias("last_page"),
            F.array_sort(F.collect_list(F.struct("page_number", "block_index", "norm"))).alias("t"),
        )
        .select(
            "doc_id",
            "sec",
            "grp",
            "o.kind",
            "o.number",
            "o.rest",
            F.col("o.page_number").alias("first_page"),
            "last_page",
            F.when(F.col("o.kind") == "C", F.array_join("t.norm", "\n")).alias("text"),
        )
    )


def node_id(*parts: str):
    """A deterministic identifier, so that retries and reruns agree."""
    return F.sha2(F.concat_ws(":", *[F.col(p).cast("string") for p in parts]), 256)


def clauses(blocks: DataFrame) -> DataFrame:
    """One row per numbered clause: its opener, the blocks up to the next opener, level, type and pages."""
    level = (dots(F.col("number")) + 1).cast("int")
    return (
        groups(blocks)
        .where("kind = 'C'")
        .select(
            node_id("doc_id", "grp").alias("clause_id"),
            "doc_id",
            (F.col("sec") - 1).cast("int").alias("section_ord"),
            (F.col("grp") - 1).cast("int").alias("clause_ord"),
            "number",
            F.when(F.length("rest") < MAX_CLAUSE_TITLE, F.col("rest")).alias("title"),
            "text",
            level.alias("level"),
            F.col("first_page").alias("page_start"),
            F.col("last_page").alias("page_end"),
            F.when(level > 2, "subclause").otherwise("clause").alias("clause_type"),
        )
    )


def sections(blocks: DataFrame) -> DataFrame:
    """One row per section, also those without clauses.

    Body lines inside a clause don't move the section's last page; openers and lines directly below the heading do.
    """
    implicit = F.substring_index("o.number", ".", 1)
    reach = F.when(F.col("kind") == "S", F.col("last_page")).otherwise(F.col("first_page"))
    return (
        groups(blocks)
        .groupBy("doc_id", "sec")
        .agg(
            F.min_by(F.struct("kind", "number", "rest", "first_page"), "grp").alias("o"),
            F.max(reach).alias("page_end"),
            F.count_if(F.col("kind") == "C").cast("int").alias("n_clauses"),
        )
        .select(
            node_id("doc_id", "sec").alias("section_id"),
            "doc_id",
            (F.col("sec") - 1).cast("int").alias("section_ord"),
            F.when(F.col("o.kind") == "S", F.col("o.number")).otherwise(implicit).alias("number"),
            F.when(F.col("o.kind") == "S", F.col("o.rest"))
            .otherwise(F.concat(F.lit("Section "), implicit))
            .alias("title"),
            F.lit(1).alias("level"),
            F.col("o.first_page").alias("page_start"),
            "page_end",
            "n_clauses",
        )
    )


def contract_structure(blocks: DataFrame) -> DataFrame:
    """The nested view: one row per document with its sections and their clauses in order."""
    clause = F.struct("clause_ord", "clause_id", "number", "title", "text", "level", "page_start", "page_end", "clause_type")
    nested = clauses(blocks).groupBy("doc_id", "section_ord").agg(F.array_sort(F.collect_list(clause)).alias("clauses"))
    section = F.struct("section_ord", "section_id", "number", "title", "level", "page_start", "page_end", "clauses")
    return (
        sections(blocks)
        .join(nested, ["doc_id", "section_ord"], "left")
        .groupBy("doc_id")
        .agg(F.array_sort(F.collect_list(section)).alias("sections"))
    )
