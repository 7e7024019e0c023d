"""Structure over chunks: headings, pages and provenance per chunk, sections per document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from deedloom.functions.text import collapse_ws, is_section_heading, parse_heading, py_strip
from deedloom.operators import ordered

#: Lines and pages that are put in order by one task, and the characters of a chunk.
LINE_RANGE, PAGE_RANGE, MAX_CHUNK = 4096, 64, 2000


def clean_headings(headings: Column) -> Column:
    """Drop null and empty headings, then strip; white space alone survives as ''. A null list is empty."""
    return F.transform(F.filter(F.coalesce(headings, F.array()), lambda h: h.isNotNull() & (h != "")), py_strip)


def sorted_pages(pages: Column) -> Column:
    """Distinct pages in order without nulls; a null list is empty."""
    return F.array_sort(F.array_distinct(F.filter(F.coalesce(pages, F.array()), lambda p: p.isNotNull())))


def provenance_of(doc_items: Column) -> Column:
    """Flatten items x entries to one array of (self_ref, label, page_no, bbox), kept also where the page is null."""
    return F.flatten(
        F.transform(
            F.coalesce(doc_items, F.array()),
            lambda i: F.transform(
                F.coalesce(i["prov"], F.array()),
                lambda p: F.struct(
                    i["self_ref"].alias("self_ref"), i["label"].alias("label"),
                    p["page_no"].alias("page_no"), p["bbox"].alias("bbox"),
                ),
            ),
        )
    )


def structural_chunks(raw: DataFrame) -> DataFrame:
    """Raw chunk records (doc_id, chunk_id, text, metadata struct) to chunks with headings, pages and provenance."""
    meta = F.col("metadata")
    return raw.select(
        "doc_id",
        "chunk_id",
        "text",
        clean_headings(meta["headings"]).alias("headings"),
        provenance_of(meta["doc_items"]).alias("provenance"),
    ).withColumn("pages", sorted_pages(F.col("provenance.page_no")))


def doc_sections(chunks: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Sections by folded heading: heading, locator, title and level of the first occurrence, in first-seen order.

    ``chunk_ids`` and ``pages`` are distinct and ascending. Chunks without headings belong to no section; repeated
    chunk rows count once. The aggregation combines per partition, so a hot document shuffles only its distinct
    headings.
    """
    rows = chunks.select(
        doc, "chunk_id", sorted_pages(F.col("pages")).alias("pages"), F.posexplode(clean_headings(F.col("headings"))).alias("pos", "heading")
    )
    first = F.struct("chunk_id", "pos")
    grouped = rows.groupBy(doc, F.lower("heading").alias("heading_key")).agg(
        F.min_by("heading", first).alias("heading"),
        F.min(first).alias("first_seen"),
        F.array_sort(F.collect_set("chunk_id")).alias("chunk_ids"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("pages")))).alias("pages"),
    )
    parsed = parse_heading(F.col("heading"))
    return grouped.withColumn("h", parsed).select(
        doc, "heading_key", "heading", "h.locator", "h.title", "h.level", "chunk_ids", "pages", "first_seen"
    )


def section_chunk_links(sections: DataFrame, chunks: DataFrame, doc: str = "doc_id") -> DataFrame:
    """The many-to-many link of sections and chunks: one row per section and existing chunk."""
    links = sections.select(doc, "heading_key", F.explode("chunk_ids").alias("chunk_id"))
    return links.join(chunks.select(doc, "chunk_id").distinct(), [doc, "chunk_id"], "left_semi")


def first_chunks(chunks: DataFrame, n: int | None) -> DataFrame:
    """The first ``n`` chunks of every document; None keeps all, anything below 1 is an error."""
    if n is None:
        return chunks
    if n < 1:
        raise ValueError("max_chunks must be at least 1")
    return chunks.where(F.col("chunk_id") < n)


def paragraph_chunks(lines: DataFrame, budget: int = 800) -> DataFrame:
    """The built-in chunker: consecutive lines (doc_id, i, line) packed by running length into chunks numbered from 0.

    A line starts a new chunk when the running length passes the next multiple of ``budget``. Lengths are summed over
    ranges of lines first, and chunks numbered over ranges of chunks, so a hot document is no single task's.
    """
    sized = ordered.running(lines, "doc_id", F.floor(F.col("i") / LINE_RANGE), ["i"], {"upto": F.length("line") + 1})
    packed = (
        sized.withColumn("slot", F.floor((F.col("upto") - 1) / budget))
        .groupBy("doc_id", "slot")
        .agg(F.array_sort(F.collect_list(F.struct("i", "line"))).alias("t"))
        .select("doc_id", "slot", F.array_join("t.line", "\n").alias("text"))
    )
    return ordered.dense_number(packed, "doc_id", "slot", "chunk_id").select("doc_id", "chunk_id", "text")


def heading_chunks(blocks: DataFrame, budget: int = MAX_CHUNK) -> DataFrame:
    """(doc_id, chunk_id, text, headings, pages): blocks in reading order, packed below the heading they follow.

    A heading begins a chunk and a chunk never reaches beyond its heading's section; within a section, blocks are packed
    by running length, and a block starts a new chunk when that passes the next multiple of ``budget``. Blank blocks and
    blocks that are no text are left out.
    """
    order = ["page_number", "block_index"]
    part = F.floor(F.col("page_number") / PAGE_RANGE)
    text = collapse_ws(F.col("text"))
    rows = blocks.where("block_type = 'text'").select("doc_id", *order, text.alias("text"), is_section_heading(F.col("block_type"), F.col("text")).alias("head"))
    rows = ordered.running(rows.where("text <> ''"), "doc_id", part, order, {"sec": F.col("head").cast("int"), "upto": F.length("text") + 1})
    title = F.when(F.col("head"), F.col("text"))
    first = rows.groupBy("doc_id", "sec").agg(F.min("upto").alias("_from"), F.min_by(title, F.struct(*order)).alias("heading"))
    slot = F.struct("sec", F.floor((F.col("upto") - F.col("_from")) / budget).alias("n"))
    packed = (
        rows.join(first, ["doc_id", "sec"])
        .groupBy("doc_id", slot.alias("slot"))
        .agg(
            F.array_sort(F.collect_list(F.struct(*order, "text"))).alias("t"),
            F.first("heading").alias("heading"),
            F.sort_array(F.collect_set("page_number")).alias("pages"),
            F.min("upto").alias("at"),
        )
        .select("doc_id", "at", F.array_join("t.text", "\n").alias("text"), F.filter(F.array("heading"), lambda h: h.isNotNull()).alias("headings"), "pages")
    )
    numbered = ordered.dense_number(packed, "doc_id", "at", "chunk_id", budget * 4096)
    return numbered.select("doc_id", "chunk_id", "text", "headings", "pages")


def contextualize(headings: Column, text: Column) -> Column:
    """The chunk text below its headings, one per line."""
    return F.concat_ws("\n", F.array_join(F.coalesce(headings, F.array().cast("array<string>")), "\n"), text)
