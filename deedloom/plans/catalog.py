"""The named queries over one data folder, and for each the SQL that gives the same rows in another engine."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from deedloom.functions import text as tx
from deedloom.functions.unicode import evidence
from deedloom.operators import assemble, blocks, extract, graph, grounding, nested, orphans, segment, structure, validate
from deedloom.plans import oracle as sql
from deedloom.plans.api import extract_chunk, extract_contract, out_of_bounds
from deedloom.session import shared_folder
from deedloom.sources import cache, derived, files
from deedloom.sources.tables import first_load, table

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


def joined(c: str, sep: str = ",") -> F.Column:
    return F.array_join(F.col(c).cast("array<string>"), sep)


# --- sources, keys and caches -------------------------------------------------------------------------------------


@query("doc_cache_key", sql.DOC_CACHE_KEY)
def doc_cache_key(spark, d):
    docs = table(spark, d, "documents", "doc_id", "text", "source")
    suffix = F.coalesce(F.nullif(tx.file_suffix(F.col("source")), F.lit("")), F.lit(".PDF"))
    return docs.select("doc_id", cache.document_key(suffix, F.coalesce("text", F.lit(""))).alias("cache_key"))


@query("semantic_cache_key", sql.SEMANTIC_CACHE_KEY)
def semantic_cache_key(spark, d):
    o = table(spark, d, "obligations", "filename", "source_chunk_id", "model").distinct()
    model = F.coalesce("model", F.lit("none"))
    key = cache.semantic_key(F.col("filename"), F.coalesce("source_chunk_id", F.lit(-1)), model, F.lit("v1"))
    return o.select("filename", "source_chunk_id", "model", key.alias("semantic_key"))


def _chunk_keys(spark, d):
    wanted = table(spark, d, "chunks", "filename", "chunk_id").distinct()
    cached = table(spark, d, "obligations", "filename", F.col("source_chunk_id").alias("chunk_id")).distinct()
    return wanted, cached


@query("cache_hits", sql.CACHE_HITS)
def cache_hits(spark, d):
    return cache.hits(*_chunk_keys(spark, d), "filename", "chunk_id")


@query("cache_misses", sql.CACHE_MISSES)
def cache_misses(spark, d):
    return cache.misses(*_chunk_keys(spark, d), "filename", "chunk_id")


@query("cache_get_or_compute", sql.GET_OR_COMPUTE)
def cache_get_or_compute(spark, d):
    wanted, cached = _chunk_keys(spark, d)
    hit = cache.hits(wanted, cached, "filename", "chunk_id").withColumn("origin", F.lit("cache"))
    miss = cache.misses(wanted, cached, "filename", "chunk_id").withColumn("origin", F.lit("computed"))
    return hit.unionByName(miss).groupBy("filename", "origin").agg(F.count("*").alias("n"))


@query("cache_store", sql.CACHE_STORE)
def cache_store(spark, d):
    """The cache itself: half of the keys are computed and stored, then all are wanted, then even ones renewed."""
    import uuid

    rows = contract_chunks(spark, d, "text").withColumnRenamed("doc_id", "filename")
    schema = T.StructType([T.StructField("filename", T.StringType()), T.StructField("chunk_id", T.IntegerType()), T.StructField("n", T.IntegerType())])
    store = cache.ParquetCache(spark, f"{shared_folder(spark)}/cache-{uuid.uuid4().hex}", schema, ("filename", "chunk_id"), "v1")
    length = lambda sign: lambda df: df.select("filename", "chunk_id", (F.length("text") * sign).alias("n"))
    store.get_or_compute(rows.where("chunk_id % 3 = 0"), length(1))
    store.get_or_compute(rows, length(1))
    store.get_or_compute(rows.where("chunk_id % 2 = 0"), length(-1), force_refresh=True)
    return cache.hits(store.read(), rows, "filename", "chunk_id")


@query("client_errors", sql.CLIENT_ERRORS)
def client_errors(spark, d):
    """What becomes of chunks for which a model's client fails, in the contract result."""

    def make():
        def client(text):
            if text:
                raise RuntimeError("no answer")
            return {}

        return client

    chunks = contract_chunks(spark, d, "headings", "pages").withColumn("text", F.when(F.col("chunk_id") % 5 == 3, "x").otherwise(""))
    out = extract_contract(chunks.select("doc_id").distinct(), chunks.distinct(), extractor=extract.ClientExtractor(make, retries=0))
    return out.errors.where("chunk_id is not null")


@query("cache_payload_guard", sql.PAYLOAD_GUARD)
def cache_payload_guard(spark, d):
    raw = table(spark, d, "raw_chunks", "raw_id", "payload")
    entry = cache.parse_entries(F.col("payload"), "chunk_id bigint, text string")
    return raw.where("payload is not null and trim(payload) <> ''").select(
        "raw_id", F.col("payload").alias("p"), entry.alias("e")
    ).where("e.text is not null").select("raw_id", "e.chunk_id", F.length("e.text").alias("n_chars"))


@query("file_suffix_filter", sql.SUFFIX_FILTER)
def file_suffix_filter(spark, d):
    names = table(spark, d, "chunks", "filename").distinct()
    return files.of_media_type(names.withColumn("suffix", F.lower(tx.file_suffix(F.col("filename")))), "application/pdf")


@query("empty_input_guard", sql.EMPTY_GUARD)
def empty_input_guard(spark, d):
    docs = table(spark, d, "documents", "doc_id", F.col("text").alias("content"))
    good, bad = files.guard_empty(docs)
    return good.select("doc_id", F.lit(None).cast("string").alias("error")).unionByName(bad)


@query("no_chunks_guard", sql.NO_CHUNKS)
def no_chunks_guard(spark, d):
    return files.without_chunks(table(spark, d, "documents", "doc_id"), structure.paragraph_chunks(derived.document_lines(spark, d)))


@query("provenance_geometry", sql.GEOMETRY)
def provenance_geometry(spark, d):
    dense = table(spark, d, "dense_chunks", "dense_id", "item_geometry").distinct()
    return files.geometry(dense, "dense_id")


@query("json_sink", sql.JSON_SINK)
def json_sink(spark, d):
    s = table(spark, d, "document_sections", "filename", "section_ord", "locator", "level").distinct()
    row = F.to_json(F.struct("section_ord", "locator", "level"), {"ignoreNullFields": "false"})
    return s.select("filename", "section_ord", row.alias("json"))


# --- text and blocks ----------------------------------------------------------------------------------------------


@query("ws_normalize", sql.WS_NORMALIZE)
def ws_normalize(spark, d):
    norm = tx.collapse_ws(F.col("text"))
    return table(spark, d, "documents", "doc_id", "text").select("doc_id", F.md5(norm).alias("md5"), F.length(norm).alias("n"))


@query("evidence_normalize", sql.EVIDENCE)
def evidence_normalize(spark, d):
    folded = evidence(F.col("text"))
    return table(spark, d, "documents", "doc_id", "text").select("doc_id", F.md5(folded).alias("md5"), F.length(folded).alias("n"))


@query("derived_blocks", sql.BLOCKS)
def derived_blocks(spark, d):
    return derived.blocks(spark, d)


@query("block_scan", sql.BLOCK_SCAN)
def block_scan(spark, d):
    b = blocks.canonical_blocks(derived.raw_pages(spark, d))
    return b.select(
        "doc_id", "page_number", "block_index", "block_type", "text", F.size("spans").alias("n_spans"),
        *[F.col(f"bbox.{c}").cast("int").alias(c) for c in ("x0", "y0", "x1", "y1")],
    )


@query("span_flatten", sql.SPAN_FLATTEN)
def span_flatten(spark, d):
    b = blocks.canonical_blocks(derived.raw_pages(spark, d))
    s = b.select("doc_id", "page_number", "block_index", F.posexplode("spans").alias("k", "s"))
    return s.select("doc_id", "page_number", "block_index", "k", "s.text", (F.col("s.size") * 2).cast("int").alias("double_size"), "s.flags")


@query("reading_order", sql.READING_ORDER)
def reading_order(spark, d):
    b = blocks.reading_order(blocks.canonical_blocks(derived.raw_pages(spark, d)))
    return b.select("doc_id", "page_number", "block_index", F.col("bbox.y0").cast("int").alias("y0"), "block_type")


@query("page_dump", sql.PAGE_DUMP)
def page_dump(spark, d):
    return blocks.dump(blocks.canonical_blocks(derived.raw_pages(spark, d))).select("doc_id", "page_number", F.md5("text").alias("md5"))


@query("doc_metadata_map", sql.METADATA)
def doc_metadata_map(spark, d):
    docs = table(spark, d, "documents", "doc_id", "text", "lang", "source", "n_chars")
    raw = F.create_map(F.lit("lang"), F.col("lang"), F.lit("source"), F.col("source"), F.lit("n_chars"), F.col("n_chars").cast("string"))
    return docs.select("doc_id", F.explode(blocks.canonical_metadata(raw, F.coalesce("text", F.lit("")))).alias("key", "value"))


@query("detect_clause", sql.DETECT_CLAUSE)
def detect_clause(spark, d):
    b = derived.blocks(spark, d).withColumn("c", tx.numbered_clause(tx.collapse_ws(F.col("text"))))
    return b.where("c is not null").select("doc_id", "block_index", "c.number", "c.remainder")


@query("detect_letter", sql.DETECT_LETTER)
def detect_letter(spark, d):
    b = derived.blocks(spark, d).withColumn("letter", tx.letter_item(tx.collapse_ws(F.col("text"))))
    return b.where("letter is not null").select("doc_id", "block_index", "letter")


@query("section_match", sql.SECTION_MATCH)
def section_match(spark, d):
    norm = tx.collapse_ws(F.col("text"))
    b = derived.blocks(spark, d).withColumn("s", F.when(tx.numbered_clause(norm).isNull(), tx.section_line(norm)))
    return b.where("s is not null").select("doc_id", "block_index", "s.number", "s.title")


@query("is_section_heading", sql.IS_HEADING)
def is_section_heading(spark, d):
    return derived.blocks(spark, d).where(tx.is_section_heading(F.col("block_type"), F.col("text"))).select("doc_id", "block_index")


@query("parse_heading", sql.PARSE_HEADING)
def parse_heading(spark, d):
    s = table(spark, d, "document_sections", "filename", "section_ord", "heading").distinct()
    return s.withColumn("h", tx.parse_heading(F.col("heading"))).select("filename", "section_ord", "h.locator", "h.title", "h.level")


# --- segmentation -------------------------------------------------------------------------------------------------


@query("block_kinds", sql.BLOCK_KINDS)
def block_kinds(spark, d):
    k = segment.classify(derived.blocks(spark, d))
    return k.groupBy("doc_id", "kind").agg(F.count("*").alias("n"), F.count("letter").alias("n_lettered"))


@query("build_sections", sql.BUILD_SECTIONS)
def build_sections(spark, d):
    return segment.sections(derived.blocks(spark, d)).drop("section_id")


@query("build_clauses", sql.BUILD_CLAUSES)
def build_clauses(spark, d):
    return segment.clauses(derived.blocks(spark, d)).drop("clause_id")


@query("build_structure")
def build_structure(spark, d):
    s = segment.contract_structure(derived.blocks(spark, d))
    return s.select("doc_id", F.size("sections").alias("n_sections"), F.md5(F.to_json("sections")).alias("md5"))


# --- structure over chunks ----------------------------------------------------------------------------------------


def contract_chunks(spark, d, *columns: str) -> DataFrame:
    """(doc_id, chunk_id, ...) of contracts; redelivered rows repeat their values and are merged."""
    return table(spark, d, "chunks", F.col("filename").alias("doc_id"), "chunk_id", *columns).distinct()


@query("chunk_scan", sql.CHUNK_SCAN)
def chunk_scan(spark, d):
    return structure.paragraph_chunks(derived.document_lines(spark, d))


@query("contextualize", sql.CONTEXTUALIZE)
def contextualize(spark, d):
    c = contract_chunks(spark, d, "headings", "text")
    return c.select("doc_id", "chunk_id", F.md5(structure.contextualize(F.col("headings"), F.col("text"))).alias("md5"))


@query("chunk_provenance", sql.CHUNK_PROVENANCE)
def chunk_provenance(spark, d):
    c = contract_chunks(spark, d, "provenance").select("doc_id", "chunk_id", F.posexplode("provenance").alias("nth", "p"))
    return c.select("doc_id", "chunk_id", "nth", "p.self_ref", "p.label", "p.page_no", "p.bbox.coord_origin")


@query("chunk_pages", sql.CHUNK_PAGES)
def chunk_pages(spark, d):
    c = contract_chunks(spark, d, "provenance").withColumn("pages", structure.sorted_pages(F.col("provenance.page_no")))
    return c.select("doc_id", "chunk_id", joined("pages").alias("pages"))


@query("raw_chunk_structure", sql.RAW_STRUCTURE)
def raw_chunk_structure(spark, d):
    lines = derived.line_chunks(spark, d)
    item = F.transform("items", lambda i: F.struct(i["self_ref"].alias("self_ref"), i["label"].alias("label"), F.array(F.struct(i["page_no"].alias("page_no"), F.lit(None).cast("struct<l:double,t:double,r:double,b:double,coord_origin:string>").alias("bbox"))).alias("prov")))
    raw = lines.select("doc_id", "chunk_id", "text", F.struct("headings", item.alias("doc_items")).alias("metadata"))
    c = structure.structural_chunks(raw)
    return c.select(
        "doc_id", "chunk_id", joined("headings", "|").alias("headings"), joined("pages").alias("pages"),
        F.array_join(F.col("provenance.self_ref"), ",").alias("refs"), F.md5("text").alias("md5"),
    )


@query("doc_sections", sql.DOC_SECTIONS)
def doc_sections(spark, d):
    s = structure.doc_sections(table(spark, d, "chunks", F.col("filename").alias("doc_id"), "chunk_id", "headings", "pages"))
    return s.select(
        "doc_id", "heading", "locator", "title", "level", joined("chunk_ids").alias("chunk_ids"), joined("pages").alias("pages")
    )


@query("max_chunks_prefix", sql.MAX_CHUNKS)
def max_chunks_prefix(spark, d):
    return structure.first_chunks(contract_chunks(spark, d), 3)


@query("section_chunk_link", sql.SECTION_LINK)
def section_chunk_link(spark, d):
    s = table(spark, d, "document_sections", F.col("filename").alias("doc_id"), F.col("section_ord").alias("heading_key"), "chunk_ids")
    links = structure.section_chunk_links(s.distinct(), contract_chunks(spark, d))
    return links.select("doc_id", F.col("heading_key").alias("section_ord"), "chunk_id")


@query("extract_one_chunk", sql.EXTRACT_ONE)
def extract_one_chunk(spark, d):
    facts = extract_chunk(derived.sentence_chunks(spark, d), 1)
    return facts.select("doc_id", F.col("kind").alias("item_type"), "item_index", "source_text")


# --- extraction ---------------------------------------------------------------------------------------------------


def _extract(name: str, kind: str, oracle: str):
    @query(f"extract_{name}", oracle)
    def run(spark, d):
        found = extract.RuleExtractor().extract(derived.sentence_chunks(spark, d))
        return extract.of_kind(found, kind).drop("item_index", "object")

    return run


for _name, _kind, _oracle in (
    ("parties", "party", sql.X_PARTIES), ("defined_terms", "defined_term", sql.X_TERMS), ("obligations", "obligation", sql.X_OBLIGATIONS),
    ("rights", "right", sql.X_RIGHTS), ("references", "reference", sql.X_REFERENCES),
):
    _extract(_name, _kind, _oracle)


@query("extract_objects", sql.X_OBJECTS)
def extract_objects(spark, d):
    found = extract.RuleExtractor().extract(derived.sentence_chunks(spark, d))
    return extract.of_kind(found, "obligation").select("doc_id", "chunk_id", "object", "source_text")


@query("sentence_split", sql.SENTENCES)
def sentence_split(spark, d):
    return extract.split_sentences(derived.sentence_chunks(spark, d)).select("doc_id", "chunk_id", "sentence")


# --- grounding and validation -------------------------------------------------------------------------------------


@query("grounded_passages", sql.GROUNDED)
def grounded_passages(spark, d):
    docs = table(spark, d, "documents", F.col("doc_id").alias("text_id"), "text")
    items = table(spark, d, "eval_items", F.col("item_id").alias("passage_id"), F.col("text").alias("passage"))
    return grounding.grounded(docs, items).withColumnsRenamed({"text_id": "doc_id", "passage_id": "item_id"})


def candidates(spark, d) -> dict[str, DataFrame]:
    """Candidates from the templated sentences, perturbed by order number so that every reason occurs."""
    s = derived.sentences(spark, d)
    p = F.col("o") % 10
    lead = F.concat(F.lit("Elsewhere "), F.col("o").cast("string"), F.lit(" nobody said this."))
    source = F.when(p == 2, lead).when(p == 6, "  ").when(p == 7, "...").otherwise(F.col("sentence"))
    base = s.select(
        "doc_id", "chunk_id", F.col("pos").alias("item_index"), source.alias("source_text"), "o", "k", "name", p.alias("p")
    )
    o, name = F.col("o").cast("string"), F.col("name")
    blank = F.when(F.col("p") == 0, F.lit(" ")).otherwise(name)
    action = F.when(F.col("p") == 1, F.lit("")).otherwise(F.concat(F.lit("order "), o))
    null = F.lit(None).cast("string")
    alias = F.when(F.col("p") == 4, "Nobody").when(F.col("p") == 5, "").when(F.col("p") == 8, null).otherwise(F.concat(F.lit("Customer "), F.col("doc_id").cast("string")))
    key = ["doc_id", "chunk_id", "item_index"]
    row = lambda k, **c: base.where(F.col("k").isin(*k)).select(*key, *[v.alias(n) for n, v in c.items()], "source_text")
    return {
        "party": row((6,), name=F.when(F.col("p") == 3, "Unknown GmbH").otherwise(name), designation=alias),
        "defined_term": row((3, 4), term=F.when(F.col("p") == 3, "Other Order").otherwise(F.concat(F.lit("Order "), o)), definition=F.concat(F.lit("the order placed by "), name)),
        "obligation": row((0, 1), party=blank, action=action, object=null, condition=null, deadline=null),
        "right": row((2,), party=blank, action=action, condition=null, deadline=null),
        "reference": row((5,), target=F.when(F.col("p") == 5, "Schedule 9").otherwise("Exhibit A"), reference_type=F.lit("exhibit_reference")),
    }


def _validate(kind: str, name: str, oracle: str):
    @query(f"validate_{name}", oracle)
    def run(spark, d):
        out = validate.check(extract.widen(kind, candidates(spark, d)[kind]), derived.sentence_chunks(spark, d))
        return out.select("doc_id", "chunk_id", "item_index", "status", "reason")

    return run


for _kind, _name in (
    ("party", "parties"), ("defined_term", "terms"), ("obligation", "obligations"), ("right", "rights"), ("reference", "references"),
):
    _validate(_kind, _name, sql.VALIDATE[_kind])


@query("validate_terms_fixed", sql.VALIDATE_FIXED)
def validate_terms_fixed(spark, d):
    out = validate.check(extract.widen("defined_term", candidates(spark, d)["defined_term"]), derived.sentence_chunks(spark, d), "fixed")
    return out.select("doc_id", "chunk_id", "item_index", "status", "reason")


@query("validation_issues", sql.ISSUES)
def validation_issues(spark, d):
    _, found = validate.validate(extract.together(candidates(spark, d)), derived.sentence_chunks(spark, d))
    return found


@query("validation_report", sql.REPORT)
def validation_report(spark, d):
    chunks = derived.sentence_chunks(spark, d)
    _, found = validate.validate(extract.together(candidates(spark, d)), chunks)
    return validate.report(chunks, found)


@query("accepted_counts", sql.ACCEPTED)
def accepted_counts(spark, d):
    passed, _ = validate.validate(extract.together(candidates(spark, d)), derived.sentence_chunks(spark, d))
    return assemble.counts(passed)


@query("fact_union", sql.FACTS)
def fact_union(spark, d):
    passed, _ = validate.validate(extract.together(candidates(spark, d)), derived.sentence_chunks(spark, d))
    return assemble.fact_union(passed)


def _table_candidates(spark, d, name: str, key: str, *columns: str) -> DataFrame:
    rows = table(spark, d, name, F.col("filename").alias("doc_id"), F.col("source_chunk_id").alias("chunk_id"), F.col(key).alias("item_index"), *columns)
    return rows.distinct()


@query("validate_obligation_table", sql.CHECK_OBLIGATIONS)
def validate_obligation_table(spark, d):
    c = _table_candidates(spark, d, "obligations", "obligation_id", "party", "action", "source_text")
    out = validate.check(extract.widen("obligation", c), contract_chunks(spark, d, "text"))
    return out.select(F.col("item_index").alias("obligation_id"), "status", "reason")


@query("validate_reference_table", sql.CHECK_REFERENCES)
def validate_reference_table(spark, d):
    c = _table_candidates(spark, d, "contract_references", "ref_id", "target", "source_text")
    out = validate.check(extract.widen("reference", c), contract_chunks(spark, d, "text"))
    return out.groupBy("doc_id", "status", "reason").agg(F.count("*").alias("n"))


@query("validate_term_table", sql.CHECK_TERMS)
def validate_term_table(spark, d):
    c = _table_candidates(spark, d, "defined_terms", "term_id", "term", "source_text")
    out = validate.check(extract.widen("defined_term", c), contract_chunks(spark, d, "text"))
    return out.select(F.col("item_index").alias("term_id"), "status", "reason")


# --- deduplication, lookup, graph, assembly -----------------------------------------------------------------------


@query("dedupe_parties", sql.DEDUPE_PARTIES)
def dedupe_parties(spark, d):
    s = derived.sentences(spark, d)
    name = F.when(F.col("o") % 3 == 0, F.upper("name")).when(F.col("o") % 3 == 1, F.concat(F.lit("  "), "name", F.lit(" "))).otherwise(F.col("name"))
    named = s.select(
        F.floor(F.col("doc_id") / 10).cast("bigint").alias("doc_id"),
        F.col("doc_id").alias("chunk_id"),
        F.col("pos").alias("item_index"),
        name.alias("name"),
        F.when(F.col("pos") % 4 == 2, F.concat(F.lit("Alias "), F.col("o").cast("string"))).alias("designation"),
        F.col("sentence").alias("source_text"),
    )
    return assemble.dedupe_parties(named)


@query("dedupe_terms", sql.DEDUPE_TERMS)
def dedupe_terms(spark, d):
    t = table(spark, d, "defined_terms", F.col("filename").alias("doc_id"), "term_id", "term", "definition").distinct()
    return assemble.dedupe_terms(t, order=("term_id",)).select("doc_id", "term_key", "definition_key", "term_id", "term")


@query("evidence_lookup", sql.EVIDENCE_LOOKUP)
def evidence_lookup(spark, d):
    facts = table(spark, d, "obligations", F.col("filename").alias("doc_id"), "obligation_id", "source_chunk_id").distinct()
    out = assemble.evidence_lookup(facts, contract_chunks(spark, d, "provenance"))
    return out.select("doc_id", "obligation_id", "source_chunk_id", "prov_no", "self_ref", "label", "page_no", F.round("bbox.l", 3).alias("l"))


def _graph_facts(spark, d):
    passed, _ = validate.validate(extract.together(candidates(spark, d)), derived.sentence_chunks(spark, d))
    return passed


@query("graph_vertices", sql.VERTICES)
def graph_vertices(spark, d):
    return graph.vertices(_graph_facts(spark, d))


@query("graph_edges", sql.GRAPH_EDGES)
def graph_edges(spark, d):
    return graph.edges(_graph_facts(spark, d))


@query("clause_reference_edges", sql.CLAUSE_REFERENCES)
def clause_reference_edges(spark, d):
    refs = table(spark, d, "contract_references", F.col("filename").alias("doc_id"), F.col("source_chunk_id").alias("chunk_id"), "target")
    sections = table(spark, d, "document_sections", F.col("filename").alias("doc_id"), "locator", "chunk_ids")
    return graph.clause_references(refs, sections)


@query("chunk_bounds", sql.CHUNK_BOUNDS)
def chunk_bounds(spark, d):
    return out_of_bounds(contract_chunks(spark, d), 20)


@query("contract_representation", sql.REPRESENTATION)
def contract_representation(spark, d):
    lines = derived.sentence_chunks(spark, d)
    chunks = lines.select("doc_id", "chunk_id", "text", F.array().cast("array<string>").alias("headings"), F.array().cast("array<int>").alias("pages"))
    whole = extract_contract(chunks.select("doc_id").distinct(), chunks).representation
    return whole.select(
        "doc_id",
        F.size("structure.chunks").alias("n_chunks"),
        F.size("semantics.parties").alias("n_parties"),
        F.size("semantics.defined_terms").alias("n_terms"),
        F.size("semantics.obligations").alias("n_obligations"),
        F.size("semantics.rights").alias("n_rights"),
        F.size("semantics.references").alias("n_references"),
        "validation.chunks_validated",
        F.size("validation.issues").alias("n_issues"),
    )


@query("contract_records")
def contract_records(spark, d):
    """The pipeline over the contracts themselves: sizes and a digest of each part of the record."""
    chunks = contract_chunks(spark, d, "text", "headings", "pages")
    whole = extract_contract(chunks.select("doc_id").distinct(), chunks).representation
    digest = lambda c: F.md5(F.to_json(c, {"ignoreNullFields": "false"})).alias(f"{c}_md5")
    return whole.select(
        "doc_id",
        F.size("structure.sections").alias("n_sections"),
        F.size("structure.chunks").alias("n_chunks"),
        *[F.size(f"semantics.{name}").alias(f"n_{name}") for name in assemble.PLURALS.values()],
        "validation.chunks_validated",
        F.size("validation.issues").alias("n_issues"),
        *[digest(c) for c in ("structure", "semantics", "validation")],
    )


# --- nested records and orphan references -------------------------------------------------------------------------


@query("p5_found", sql.P5_FOUND)
def p5_found(spark, d):
    return nested.provenance_entries(table(spark, d, "raw_chunks", "raw_id", "payload"), "raw_id", "payload")


def _p5(name: str):
    @query(f"p5_{name}")
    def run(spark, d):
        return nested.tables(table(spark, d, "raw_chunks", "raw_id", "payload"), "raw_id", "payload")[name]

    return run


for _name in ("chunks", "items", "provenance", "boxes"):
    _p5(_name)


def _orphans(spark, d):
    return orphans.orphans(
        table(spark, d, "contract_references", "ref_id", "filename", "target", "source_chunk_id", "loaded_at"),
        table(spark, d, "chunks", "filename", "chunk_id", "loaded_at", "deleted_at"),
        table(spark, d, "document_sections", "filename", "locator", "loaded_at", "deleted_at"),
    )


@query("p6_found", sql.P6_FOUND)
def p6_found(spark, d):
    return _orphans(spark, d).drop("loaded_at")


@query("p6_counts", sql.P6_COUNTS)
def p6_counts(spark, d):
    return orphans.orphan_counts(_orphans(spark, d))
