"""Entry points over many documents at once, each from DataFrame to DataFrame."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from deedloom.operators import assemble, blocks, segment, structure
from deedloom.operators import validate as checks
from deedloom.operators.extract import CachedExtractor, Extractor, RuleExtractor, failures
from deedloom.session import Settings, cut_lineage
from deedloom.sources.files import guard_empty, parse_files, without_chunks

parse_blocks = blocks.canonical_blocks
build_sections = segment.contract_structure
get_chunks = structure.paragraph_chunks
build_document_structure = structure.doc_sections
validate = checks.validate


@dataclass
class Contracts:
    """What extraction over a set of documents gives; facts and issues in long form over all classes. ``errors`` has
    (doc_id, chunk_id, error): documents without chunks, with null for the chunk, and chunks whose extraction failed."""

    representation: DataFrame
    accepted: DataFrame
    issues: DataFrame
    errors: DataFrame


def health(spark: SparkSession) -> dict[str, str]:
    """Whether the session works, and in which environment."""
    ok = spark.range(1).count() == 1
    return {"status": "ok" if ok else "failed", "service": "deedloom", "environment": Settings.read(spark).environment}


def extract_chunk(chunks: DataFrame, chunk_index: int = 0, extractor: Extractor | None = None, validate: bool = False) -> DataFrame:
    """Facts of one chunk per document. The filter precedes extraction; without ``validate`` nothing is checked.

    An index below 0 is an error; documents that have no such chunk give no rows.
    """
    if chunk_index < 0:
        raise ValueError("chunk_index must not be negative")
    one = chunks.where(F.col("chunk_id") == chunk_index)
    found = (extractor or RuleExtractor()).extract(one)
    if validate:
        return checks.validate(found, one)[0]
    return found.where("kind <> 'error'").withColumn("source_chunk_id", F.col("chunk_id"))


def out_of_bounds(chunks: DataFrame, chunk_index: int) -> DataFrame:
    """(doc_id, error): documents for which ``chunk_index`` lies beyond the last chunk."""
    last = chunks.groupBy("doc_id").agg(F.max("chunk_id").alias("last")).where(F.col("last") < chunk_index)
    message = F.format_string(f"chunk_index {chunk_index} is out of range: the document has %d chunks.", F.col("last") + 1)
    return last.select("doc_id", message.alias("error"))


def extract_contract(
    docs: DataFrame,
    chunks: DataFrame,
    max_chunks: int | None = None,
    validate: bool = True,
    mode: str = "compat",
    extractor: Extractor | None = None,
    cache_path: str | None = None,
    force_refresh: bool = False,
) -> Contracts:
    """Structure, semantics and validation of documents (doc_id) given their chunks (doc_id, chunk_id, text, headings,
    pages). ``max_chunks`` limits semantics alone; structure keeps all chunks.

    With ``cache_path`` chunks that were read before come from the cache there; ``force_refresh`` reads these documents
    anew. A chunk whose extraction fails is an error row and isn't counted as validated; the rest goes on.
    The checked candidates are written once to the shared checkpoint folder, since facts, issues and the report all
    read them; extraction, the dearest step, runs once.
    """
    sections = structure.doc_sections(chunks)
    read = structure.first_chunks(chunks, max_chunks)
    reader = extractor or RuleExtractor()
    if cache_path:
        given = Settings.read(chunks.sparkSession)
        reader = CachedExtractor(reader, cache_path, given.extraction_model, given.extraction_version, force_refresh)
    candidates = reader.extract(read)
    failed = None
    if not isinstance(reader, RuleExtractor):  # rules never fail
        candidates = cut_lineage(candidates)
        failed = failures(candidates)
    candidates = candidates.where("kind <> 'error'")
    if validate:
        checked = checks.check(candidates, read, mode)
    else:
        checked = candidates.withColumn("status", F.lit("accept")).withColumn("reason", F.lit(None).cast("string"))
    checked = cut_lineage(checked)
    issues = checks.issues(checked)
    accepted = assemble.first_wins(checks.accepted(checked))
    errors = without_chunks(docs, chunks).select("doc_id", F.lit(None).cast("int").alias("chunk_id"), "error")
    if failed is not None:
        errors = errors.unionByName(failed)
        read = read.join(failed, ["doc_id", "chunk_id"], "left_anti")
    report = checks.report(read, issues, validate).select("doc_id", "chunks_validated")
    whole = assemble.representation(docs, chunks, sections, accepted, issues, report)
    return Contracts(whole, accepted, issues, errors)


def extract_files(
    uploads: DataFrame, make_parser: Callable[[], Callable[[bytes, str], list[dict]]], max_chars: int = structure.MAX_CHUNK, **options
) -> Contracts:
    """From files (doc_id, filename, content) to the contract result: parse, blocks in reading order, paragraphs, chunks
    below their headings, then :func:`extract_contract` with ``options``. Empty and unreadable files are error rows, too.
    """
    good, empty = guard_empty(uploads)
    pages, unreadable = parse_files(good, make_parser)
    chunks = cut_lineage(structure.heading_chunks(blocks.canonical_blocks(pages), max_chars))
    out = extract_contract(pages.select("doc_id").distinct(), chunks, **options)
    before = empty.unionByName(unreadable).select("doc_id", F.lit(None).cast("int").alias("chunk_id"), "error")
    return Contracts(out.representation, out.accepted, out.issues, out.errors.unionByName(before))
