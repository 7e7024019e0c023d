"""The contract graph as vertex and edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from deedloom.operators.orphans import bare_locator, section_numbers

# Edge labels with their end types.
EDGES = (
    ("Obligation", "IMPOSES_ON", "Party"),
    ("Right", "GRANTED_TO", "Party"),
    ("Clause", "APPLIES_TO", "Party"),
    ("Clause", "DEFINES", "DefinedTerm"),
    ("Clause", "REFERENCES", "Clause"),
    ("Clause", "DEPENDS_ON", "Clause"),
    ("Clause", "MODIFIES", "Clause"),
    ("Clause", "EXCEPTION_TO", "Clause"),
    ("Contract", "HAS_PARTY", "Party"),
    ("Contract", "HAS_CLAUSE", "Clause"),
    ("Contract", "HAS_DEFINED_TERM", "DefinedTerm"),
)
LABELS = tuple(x[1] for x in EDGES)


def edge_metadata(label: str) -> dict[str, str]:
    """Column metadata that marks a field as an edge; unknown labels are an error."""
    if label not in LABELS:
        raise ValueError(f"unknown edge label {label!r}")
    return {"edge_label": label}


def vertices(accepted: DataFrame, clauses: DataFrame | None = None) -> DataFrame:
    """(doc_id, type, key): distinct contracts, parties, defined terms and clauses; null keys are left out.

    A contract is a vertex if it has a party or a defined term. All come from one pass over the facts.
    """
    vertex = lambda kind, key: F.struct(F.lit(kind).alias("type"), key.alias("key"))
    party = F.when(F.col("kind").isin("obligation", "right"), F.col("party")).otherwise(F.col("name"))
    contract = F.when(F.col("kind").isin("party", "defined_term"), F.col("doc_id").cast("string"))
    found = F.array(vertex("Party", party), vertex("DefinedTerm", F.col("term")), vertex("Contract", contract))
    out = accepted.select("doc_id", F.inline(found))
    if clauses is not None:
        out = out.unionByName(clauses.select("doc_id", F.lit("Clause").alias("type"), F.col("number").alias("key")))
    return out.where("key is not null").distinct()


def edges(accepted: DataFrame) -> DataFrame:
    """(doc_id, src_type, src, label, dst_type, dst): contract to parties and terms, duties and rights to parties."""
    fact = F.concat_ws(":", "kind", F.col("chunk_id").cast("string"), F.col("item_index").cast("string"))
    doc = F.col("doc_id").cast("string")
    of = lambda kind, src_type, src, label, dst_type, dst: (
        F.col("kind") == kind,
        F.struct(F.lit(src_type).alias("src_type"), src.alias("src"), F.lit(label).alias("label"), F.lit(dst_type).alias("dst_type"), F.col(dst).alias("dst")),
    )
    rules = [
        of("party", "Contract", doc, "HAS_PARTY", "Party", "name"),
        of("defined_term", "Contract", doc, "HAS_DEFINED_TERM", "DefinedTerm", "term"),
        of("obligation", "Obligation", fact, "IMPOSES_ON", "Party", "party"),
        of("right", "Right", fact, "GRANTED_TO", "Party", "party"),
    ]
    edge = F.coalesce(*[F.when(fits, value) for fits, value in rules])
    return accepted.select("doc_id", edge.alias("e")).select("doc_id", "e.*").where("dst is not null").distinct()


def clause_references(refs: DataFrame, sections: DataFrame) -> DataFrame:
    """(doc_id, src_type, src, label, dst_type, dst): REFERENCES edges between clauses of one document (an extension).

    ``refs`` (doc_id, chunk_id, target) name sections of their own document; the source is every section that has the
    reference's chunk, the destination the section with the number named. ``sections`` has (doc_id, locator, chunk_ids).
    References to sections that don't exist give no edge.
    """
    named = refs.select("doc_id", "chunk_id", F.explode(section_numbers(F.col("target"))).alias("dst")).distinct()
    own = sections.where("locator is not null").select("doc_id", bare_locator(F.col("locator")).alias("locator"), "chunk_ids")
    source = own.select("doc_id", F.col("locator").alias("src"), F.explode("chunk_ids").alias("chunk_id")).distinct()
    there = own.select("doc_id", F.col("locator").alias("dst")).distinct()
    met = named.join(source, ["doc_id", "chunk_id"]).select("doc_id", "src", "dst").distinct().join(there, ["doc_id", "dst"], "left_semi")
    clause = F.lit("Clause")
    return met.select("doc_id", clause.alias("src_type"), "src", F.lit("REFERENCES").alias("label"), clause.alias("dst_type"), "dst")
