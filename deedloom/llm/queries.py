"""The named queries of this subpackage, and SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from deedloom.llm import bpe, canon, chars, leaks, lookalike, pieces, scanned, stuffing, survivor
from deedloom.plans import oracle as sql
from deedloom.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    """Register a query, and its SQL where there is one."""

    def keep(f: Query) -> Query:
        QUERIES[name] = f
        if oracle:
            ORACLE[name] = oracle
        return f

    return keep


def _typed(spark, d):
    refs = table(spark, d, "contract_references", "ref_id", "reference_type")
    return canon.typed_references(refs, table(spark, d, "reference_types"), "ref_id", "reference_type")


@query("p1_found")
def p1_found(spark, d):
    return _typed(spark, d).select("ref_id", "type_id")


@query("p1_candidates")
def p1_candidates(spark, d):
    return canon.candidates(table(spark, d, "contract_references", "reference_type"), table(spark, d, "reference_types"), "reference_type")


@query("p1_unmatched")
def p1_unmatched(spark, d):
    return canon.unmatched_report(_typed(spark, d), "reference_type")


def _seen(x: str) -> str:
    """What a reader sees of a text, in SQL with tables of its own, as far as the given data need it: the characters that
    its texts have."""
    visible = f"translate({x}, '\u00ad\u200b\u200c\u200d\u2060\ufeff', '')"
    looks = ("ΑΒΕΖΗΙΚΜΝΟΡΤΥνοЅІЈАВЕКМНОРСТХаеорсухѕіј\u2010\u2011", "ABEZHIKMNOPTYvoSIJABEKMHOPCTXaeopcyxsij--")
    latin = f"translate({sql.compat(visible)}, '{looks[0]}', '{looks[1]}')"
    return f"trim(regexp_replace(nfc_normalize({latin}), '{sql.WS}+', ' ', 'g'))"


@query(
    "p3_found",
    f"""SELECT DISTINCT obligation_id, o.filename, o.source_chunk_id AS chunk_id FROM (
      SELECT *, {_seen("source_text")} AS s FROM obligations WHERE source_chunk_id IS NOT NULL) o
    JOIN (SELECT filename, chunk_id, text, {_seen("text")} AS t FROM chunks) c ON c.filename = o.filename AND c.chunk_id = o.source_chunk_id
    WHERE NOT contains(text, source_text) AND s <> '' AND contains(t, s)""",
)
def p3_found(spark, d):
    o = table(spark, d, "obligations", "obligation_id", "filename", F.col("source_chunk_id").alias("chunk_id"), "source_text")
    c = table(spark, d, "chunks", "filename", "chunk_id", "text")
    out = lookalike.lookalike_passages(o, c, ["filename", "chunk_id"], "source_text", "text")
    return out.select("obligation_id", "filename", "chunk_id")


def _texts(spark, d):
    """(field, filename, id, text) of both fields that problem 3 deals with, redelivered rows too."""
    passages = table(spark, d, "obligations", F.lit("source_text").alias("field"), "filename", F.col("obligation_id").cast("bigint").alias("id"), F.col("source_text").alias("text"))
    chunks = table(spark, d, "chunks", F.lit("text").alias("field"), "filename", F.col("chunk_id").cast("bigint").alias("id"), "text")
    return passages.unionByName(chunks)


@query("p3_forms")
def p3_forms(spark, d):
    return lookalike.skeleton_groups(_texts(spark, d), "text", ("field",), ("filename", "id"))


@query("p3_skeletons")
def p3_skeletons(spark, d):
    return _texts(spark, d).distinct().select("field", "filename", "id", lookalike.skeleton_of(F.col("text"), chars.confusables(spark)).alias("skeleton"))


def _oversized(spark, d):
    return pieces.oversized(table(spark, d, "dense_chunks", "dense_id", "filename", "chunk_id", "text", "resplit_of"))


@query(
    "p7_found",
    """SELECT DISTINCT dense_id FROM dense_chunks a WHERE length(text) > 2400 AND NOT EXISTS
    (SELECT 1 FROM dense_chunks b WHERE b.filename = a.filename AND b.resplit_of = a.chunk_id)""",
)
def p7_found(spark, d):
    return pieces.split(_oversized(spark, d), "dense_id").where("piece_no = 1").select("dense_id")


@query("p7_pieces")
def p7_pieces(spark, d):
    return pieces.split(_oversized(spark, d), "dense_id")


@query("p8_ids")
def p8_ids(spark, d):
    return bpe.encode(table(spark, d, "documents", "doc_id", "text"), "doc_id", "text")


@query("p4_found")
def p4_found(spark, d):
    return survivor.survivors(table(spark, d, "defined_terms"), table(spark, d, "extraction_models"))


@query("p4_records")
def p4_records(spark, d):
    return survivor.surviving(table(spark, d, "defined_terms"), table(spark, d, "extraction_models"))


@query("p2_found")
def p2_found(spark, d):
    return scanned.repairs(table(spark, d, "chunks", "filename", "chunk_id", "text", "headings"))


@query("p2_text")
def p2_text(spark, d):
    return scanned.repaired(table(spark, d, "chunks", "filename", "chunk_id", "text", "headings"))


def _documents(spark, d):
    return table(spark, d, "documents", "doc_id", "text")


@query("p9_found")
def p9_found(spark, d):
    found = leaks.leaks(_documents(spark, d), table(spark, d, "eval_items"), "doc_id", "text")
    return found.select("doc_id", "item_id").distinct()


@query("p9_paraphrases")
def p9_paraphrases(spark, d):
    found = leaks.leaks(_documents(spark, d), table(spark, d, "eval_items"), "doc_id", "text", paraphrases=True)
    return found.where("lcs is not null").distinct()


@query("p10_found")
def p10_found(spark, d):
    return stuffing.stuffed(_documents(spark, d), "doc_id", "text")


@query("p10_scores")
def p10_scores(spark, d):
    return stuffing.scores(_documents(spark, d), "doc_id", "text")
