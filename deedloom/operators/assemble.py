"""First-wins deduplication, evidence lookup and the nested record per document."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from deedloom.functions.text import py_strip
from deedloom.operators.extract import FIELDS, of_kind, widen
from deedloom.operators.validate import as_json


def dedupe_parties(parties: DataFrame, doc: str = "doc_id", order: tuple[str, ...] = ("chunk_id", "item_index")) -> DataFrame:
    """One party per folded name: the first row wins, a missing designation is filled by the first later one."""
    at = F.struct(*order)
    return (
        parties.groupBy(doc, F.lower(py_strip(F.col("name"))).alias("party_key"))
        .agg(
            F.min_by(F.struct("name", "source_text", *order), at).alias("f"),
            F.min_by("designation", F.when(F.col("designation").isNotNull(), at)).alias("designation"),
        )
        .select(doc, "party_key", "f.name", "designation", "f.source_text", *[f"f.{c}" for c in order])
    )


def dedupe_terms(terms: DataFrame, doc: str = "doc_id", order: tuple[str, ...] = ("chunk_id", "item_index")) -> DataFrame:
    """One row per folded term and stripped definition: the first wins, other definitions of the term stay.

    ``row_number() = 1`` is limited before the shuffle too, so copies of a hot term don't travel.
    """
    w = Window.partitionBy(doc, "term_key", "definition_key").orderBy(*order)
    return (
        terms.withColumn("term_key", F.lower(py_strip(F.col("term"))))
        .withColumn("definition_key", py_strip(F.col("definition")))
        .withColumn("_n", F.row_number().over(w))
        .where("_n = 1")
        .drop("_n")
    )


def fact_union(accepted: DataFrame) -> DataFrame:
    """All accepted facts in one long table: class, position and the fields as JSON."""
    return accepted.select("doc_id", "chunk_id", F.col("kind").alias("item_type"), "item_index", "source_text", as_json().alias("item"))


def attach_chunk_id(items: Column, chunk_id: Column) -> Column:
    """An array of item structs, each with ``source_chunk_id``; null stays null."""
    return F.transform(items, lambda x: x.withField("source_chunk_id", chunk_id))


def evidence_lookup(facts: DataFrame, chunks: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Fact to chunk to provenance entries: one row per fact and entry of its source chunk."""
    prov = chunks.select(
        doc, F.col("chunk_id").alias("source_chunk_id"), F.posexplode("provenance").alias("prov_no", "p")
    ).select(doc, "source_chunk_id", "prov_no", "p.self_ref", "p.label", "p.page_no", "p.bbox")
    return facts.join(prov, [doc, "source_chunk_id"])


def counts(accepted: DataFrame) -> DataFrame:
    """Per chunk: how many facts of each class were accepted."""
    return accepted.groupBy("doc_id", "chunk_id", F.col("kind").alias("item_type")).agg(F.count("*").alias("n"))


def first_wins(accepted: DataFrame) -> DataFrame:
    """Accepted facts with parties and defined terms deduplicated; the other classes stay as they are."""
    parties = dedupe_parties(of_kind(accepted, "party")).withColumn("source_chunk_id", F.col("chunk_id"))
    terms = dedupe_terms(of_kind(accepted, "defined_term"))
    keep = [*accepted.columns]
    wide = [widen(k, d).withColumn("source_chunk_id", F.col("chunk_id")).select(*keep) for k, d in (("party", parties), ("defined_term", terms))]
    return reduce(DataFrame.unionByName, [accepted.where(~F.col("kind").isin("party", "defined_term")), *wide])


def _nested(df: DataFrame, name: str, order: list[str], fields: list[str]) -> DataFrame:
    row = F.struct(*order, F.struct(*fields).alias("v"))
    return df.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(row)), lambda x: x["v"]).alias(name))


# What the classes are called in the nested record.
PLURALS = {"party": "parties", "defined_term": "defined_terms", "obligation": "obligations", "right": "rights", "reference": "references"}


def representation(docs: DataFrame, chunks: DataFrame, sections: DataFrame, accepted: DataFrame, issues: DataFrame, report: DataFrame) -> DataFrame:
    """The nested record per document: structure, semantics and validation; classes without facts are empty lists.

    The facts of all classes are grouped in one pass. A document's record is bounded by the document.
    """
    per_kind = [
        F.transform(
            F.array_sort(
                F.collect_list(
                    F.when(F.col("kind") == k, F.struct("chunk_id", "item_index", F.struct(*FIELDS[k], "source_chunk_id").alias("v")))
                )
            ),
            lambda x: x["v"],
        ).alias(name)
        for k, name in PLURALS.items()
    ]
    pieces = [
        _nested(chunks, "chunks", ["chunk_id"], ["chunk_id", "text", "headings", "pages"]),
        _nested(sections, "sections", ["first_seen"], ["heading", "locator", "title", "level", "chunk_ids", "pages"]),
        _nested(issues, "issues", ["chunk_id", "type_ord", "item_index"], ["chunk_id", "item_type", "item_index", "reason", "source_text", "item"]),
        accepted.groupBy("doc_id").agg(*per_kind),
        report,
    ]
    out = docs.select("doc_id")
    for p in pieces:
        out = out.join(p, "doc_id", "left")
    empty = lambda c: F.coalesce(c, F.array()).alias(c)
    return out.select(
        "doc_id",
        F.struct(empty("sections"), empty("chunks")).alias("structure"),
        F.struct(*[empty(name) for name in PLURALS.values()]).alias("semantics"),
        F.struct(F.coalesce("chunks_validated", F.lit(0)).alias("chunks_validated"), empty("issues")).alias("validation"),
    )
