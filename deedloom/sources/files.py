"""Files as input: binary scan, type filter, empty-input guard, and pluggable layout parsers and chunkers.

Layout parsing needs a library that is not part of this package; a provider is any callable ``(content, filename) ->
list of raw pages`` and is created once per partition.
"""

from __future__ import annotations

import os
import tempfile
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from deedloom.functions.text import file_suffix

# Suffixes by media type, and the name an upload without one gets.
SUFFIXES = {"application/pdf": (".pdf",), "application/vnd.openxmlformats-officedocument.wordprocessingml.document": (".docx",)}
DEFAULT_NAME = "document.pdf"

RAW_PAGES = (
    "page_index int, width double, height double, "
    "raw_blocks array<struct<i:int,type:int,bbox:array<double>,"
    "lines:array<struct<spans:array<struct<text:string,bbox:array<double>,font:string,size:string,flags:int>>>>>>"
)

PROVENANCE_ARTEFACT = (
    "version int, document string, resolution string, node_level boolean, "
    "chunks map<string,struct<chunk_id:int,batch_index:int,page_numbers:array<int>,doc_item_refs:array<string>,"
    "item_geometry:array<struct<ref:string,page_no:int,bbox:array<int>,page_width:int,page_height:int,"
    "dclg_location:array<int>>>,headings:array<string>,token_count:int,text_hash:string,char_length:int,text:string,"
    "resplit_of:int>>"
)


def files(spark: SparkSession, folder: str, media_type: str | None = None) -> DataFrame:
    """(doc_id, filename, suffix, content): every file below ``folder``; with ``media_type`` only its suffixes.

    Files of no length are left out by the scan itself; empty uploads from elsewhere are what ``guard_empty`` reports.
    """
    df = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    name = F.coalesce(F.nullif(F.element_at(F.split("path", "/"), -1), F.lit("")), F.lit(DEFAULT_NAME))
    out = df.select(
        F.sha2(F.concat(F.col("path").cast("binary")), 256).alias("doc_id"),
        name.alias("filename"),
        F.lower(file_suffix(name)).alias("suffix"),
        "content",
    )
    return of_media_type(out, media_type) if media_type else out


def of_media_type(df: DataFrame, media_type: str) -> DataFrame:
    """The rows whose ``suffix`` belongs to the media type; an unknown type has none."""
    return df.where(F.col("suffix").isin(*SUFFIXES.get(media_type, ("",))))


def guard_empty(df: DataFrame, content: str = "content") -> tuple[DataFrame, DataFrame]:
    """(usable rows, errors): null or empty content becomes a row (doc_id, error), so one bad file ends no batch."""
    empty = F.coalesce(F.length(content) == 0, F.lit(True))
    return df.where(~empty), df.where(empty).select("doc_id", F.lit("The uploaded file is empty.").alias("error"))


def without_chunks(docs: DataFrame, chunks: DataFrame) -> DataFrame:
    """(doc_id, error): documents that produced no chunk."""
    return docs.join(chunks, "doc_id", "left_anti").select("doc_id", F.lit("The document produced no chunks.").alias("error"))


def parse_files(df: DataFrame, make_parser: Callable[[], Callable[[bytes, str], list[dict]]]) -> tuple[DataFrame, DataFrame]:
    """(raw pages, errors) of files (doc_id, filename, content); an unreadable file is an error row.

    The parser runs once per file: its outcome is written to the shared checkpoint folder before the two results are
    split from it.
    """
    from deedloom.session import cut_lineage

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parse = make_parser()
        for b in batches:
            rows = []
            for doc, name, content in zip(b.doc_id, b.filename, b.content):
                try:
                    rows.append((doc, parse(bytes(content), name), None))
                except Exception as e:  # any parser failure concerns this file alone
                    rows.append((doc, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["doc_id", "pages", "error"])

    page = "array<struct<" + RAW_PAGES.replace(" int", ":int", 1).replace("width double", "width:double").replace(
        "height double", "height:double"
    ).replace("raw_blocks array", "raw_blocks:array") + ">>"
    out = cut_lineage(df.select("doc_id", "filename", "content").mapInPandas(run, f"doc_id string, pages {page}, error string"))
    pages = out.where("error is null").select("doc_id", F.inline("pages"))
    return pages, out.where("error is not null").select("doc_id", "error")


def with_temp_file(parse_path: Callable[[str], list[dict]], suffix: str = ".pdf") -> Callable[[bytes, str], list[dict]]:
    """A parser of contents made of one that reads paths; the file is removed whatever happens."""

    def parse(content: bytes, name: str) -> list[dict]:
        with tempfile.NamedTemporaryFile(suffix=os.path.splitext(name)[1] or suffix, delete=False) as f:
            f.write(content)
        try:
            return parse_path(f.name)
        finally:
            os.unlink(f.name)

    return parse


def provenance_artefact(spark: SparkSession, path: str) -> DataFrame:
    """One row per chunk of provenance JSON files."""
    df = spark.read.schema(PROVENANCE_ARTEFACT).option("multiLine", "true").json(path)
    return df.select("version", "document", F.explode(F.map_values("chunks")).alias("c")).select("version", "document", "c.*")


def geometry(dense: DataFrame, *key: str) -> DataFrame:
    """One row per item geometry: reference, page and the box as numbers; chunks without geometry give none."""
    return dense.select(*key, F.posexplode("item_geometry").alias("nth", "g")).select(
        *key, "nth", "g.ref", "g.page_no",
        *[F.get("g.bbox", F.lit(i)).alias(n) for i, n in enumerate(("x0", "y0", "x1", "y1"))],
        "g.page_width", "g.page_height",
    )
