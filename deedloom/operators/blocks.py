"""Parser output to canonical blocks: span flattening, block types, texts, boxes, page numbers, metadata."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from deedloom.functions.text import py_strip


def flat_spans(lines: Column) -> Column:
    """The spans of all lines in order; a missing text becomes '', sizes become doubles; null lines give []."""
    inner = F.flatten(F.transform(F.coalesce(lines, F.array()), lambda x: F.coalesce(x["spans"], F.array())))
    return F.transform(
        inner,
        lambda s: F.struct(
            F.coalesce(s["text"], F.lit("")).alias("text"),
            box(s["bbox"]).alias("bbox"),
            s["font"].alias("font"),
            s["size"].try_cast("double").alias("size"),
            s["flags"].alias("flags"),
        ),
    )


def box(values: Column) -> Column:
    """Struct(x0, y0, x1, y1) of a four-number array; missing numbers are 0."""
    at = lambda k: F.coalesce(F.get(values, F.lit(k)).cast("double"), F.lit(0.0))
    return F.struct(at(0).alias("x0"), at(1).alias("y0"), at(2).alias("x1"), at(3).alias("y1"))


def block_kind(code: Column) -> Column:
    """0 is text, 1 is image, anything else unknown."""
    return F.when(code == 0, "text").when(code == 1, "image").otherwise("unknown")


def canonical_blocks(raw_pages: DataFrame) -> DataFrame:
    """(doc_id, page_index, raw_blocks) to one row per block, pages counted from 1 and blocks from 0.

    The text is the concatenation of the spans without a separator, stripped; blocks that are no text have '' and no
    spans. A page without blocks gives no rows.
    """
    rows = raw_pages.select(
        "doc_id",
        (F.col("page_index") + 1).cast("int").alias("page_number"),
        F.posexplode("raw_blocks").alias("block_index", "b"),
    )
    kind = block_kind(F.col("b.type"))
    spans = F.when(kind == "text", flat_spans(F.col("b.lines"))).otherwise(flat_spans(F.lit(None).cast(
        "array<struct<spans:array<struct<text:string,bbox:array<double>,font:string,size:string,flags:int>>>>"
    )))
    return rows.select(
        "doc_id",
        "page_number",
        "block_index",
        kind.alias("block_type"),
        box(F.col("b.bbox")).alias("bbox"),
        spans.alias("spans"),
    ).withColumn("text", py_strip(F.array_join(F.col("spans.text"), "")))


def canonical_metadata(metadata: Column, content: Column) -> Column:
    """Metadata without its null values plus the content's ``sha256``; null metadata counts as empty."""
    kept = F.map_filter(
        F.coalesce(metadata, F.create_map().cast("map<string,string>")), lambda k, v: v.isNotNull() & (k != "sha256")
    )
    return F.map_concat(kept, F.create_map(F.lit("sha256"), F.sha2(content.cast("binary"), 256)))


def reading_order(blocks: DataFrame) -> DataFrame:
    """Blocks renumbered from 0 within their page from top to bottom, then left to right, for parsers that don't sort."""
    w = Window.partitionBy("doc_id", "page_number").orderBy("bbox.y0", "bbox.x0", "block_index")
    return blocks.withColumn("block_index", F.row_number().over(w) - 1)


def dump(blocks: DataFrame) -> DataFrame:
    """(doc_id, page_number, text, json): each page's text and its blocks as JSON, in order."""
    row = F.struct("block_index", "block_type", "bbox", "text")
    page = blocks.groupBy("doc_id", "page_number").agg(F.array_sort(F.collect_list(row)).alias("b"))
    lines = F.filter(F.col("b.text"), lambda t: t != "")
    return page.select("doc_id", "page_number", F.array_join(lines, "\n").alias("text"), F.to_json("b").alias("json"))
