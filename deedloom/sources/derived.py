"""Contract-shaped inputs derived from the driver's tables by fixed projections."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from deedloom.functions.text import collapse_ws
from deedloom.sources.tables import table


def document_lines(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, i, line): the lines of every document; null texts have none."""
    docs = table(spark, folder, "documents", "doc_id", "text").where("text is not null")
    return docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "line"))


def blocks(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, page_number, block_index, block_type, text): document lines dressed as numbered contract blocks."""
    i, line, doc = F.col("i"), F.col("line"), F.col("doc_id")
    sec = (F.floor(i / 12) + 1).cast("int").cast("string")
    sub = F.floor((i % 12) / 4).cast("int").cast("string")
    text = (
        F.when((doc % 5 == 0) & (i == 0), line)
        .when((doc % 7 == 0) & (i == 0), F.concat(F.lit("1.1 "), line))
        .when(i % 12 == 0, F.concat(sec, F.lit(". "), line))
        .when(i % 12 == 5, F.concat(sec, F.lit(".1.1 "), line))
        .when(i % 4 == 0, F.concat(sec, F.lit("."), sub, F.lit(" "), line))
        .when(i % 4 == 2, F.concat(F.lit("(a) "), line))
        .otherwise(line)
    )
    return document_lines(spark, folder).select(
        "doc_id",
        (F.floor(i / 10) + 1).cast("int").alias("page_number"),
        i.alias("block_index"),
        F.when(i % 17 == 16, "image").otherwise("text").alias("block_type"),
        text.alias("text"),
    )


def raw_pages(spark: SparkSession, folder: str) -> DataFrame:
    """Pages as a layout parser emits them: nested pages, raw blocks, lines and spans with one span per word."""
    i = F.col("block_index")
    words = F.split("text", " ")
    spans = F.transform(
        words,
        lambda w, k: F.struct(
            F.when(k % 7 != 6, w).alias("text"),
            F.array(k.cast("double"), i.cast("double"), (k + 1).cast("double"), (i + 1).cast("double")).alias("bbox"),
            F.lit("serif").alias("font"),
            F.lit("9.5").alias("size"),
            F.lit(4).alias("flags"),
        ),
    )
    block = F.struct(
        i.alias("i"),
        F.when(F.col("block_type") == "image", 1).when(i % 29 == 28, 7).otherwise(0).alias("type"),
        F.when(i % 11 != 10, F.array(F.lit(0.0), i.cast("double"), F.lit(90.0), (i + 1).cast("double"))).alias("bbox"),
        F.array(F.struct(spans.alias("spans"))).alias("lines"),
    )
    return (
        blocks(spark, folder)
        .groupBy("doc_id", (F.col("page_number") - 1).alias("page_index"))
        .agg(F.array_sort(F.collect_list(block)).alias("raw_blocks"))
    )


def sentences(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, chunk_id, pos, o, k, name, sentence): one templated contract sentence per order."""
    o, name, cust = F.col("o_orderkey"), F.col("c_name"), F.col("c_custkey")
    k = o % 7
    s = lambda *parts: F.concat(*[p if not isinstance(p, str) else F.lit(p) for p in parts])
    t = lambda c: c.cast("string")
    sentence = (
        F.when(k == 0, s(name, " shall deliver order ", t(o), " within ", t(o % 30 + 1), " days."))
        .when(k == 1, s(name, " may not assign order ", t(o), "."))
        .when(k == 2, s(name, " may cancel order ", t(o), " if the priority is ", F.col("o_orderpriority"), "."))
        .when(k == 3, s('"Order ', t(o), '" means the order placed by ', name, "."))
        .when(k == 4, s('"Order ', t(o), '" shall mean the order placed by ', name, "."))
        .when(k == 5, s(name, " is bound by Section ", t(o % 9 + 1), ".", t(o % 5 + 1), " and Exhibit A."))
        .otherwise(s("This Agreement is between ", name, ' ("Customer ', t(cust), '") and the Supplier.'))
    )
    orders = table(spark, folder, "orders", "o_orderkey", "o_custkey", "o_orderpriority")
    customer = table(spark, folder, "customer", "c_custkey", "c_name")
    pos = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")) - 1
    return (
        orders.join(customer, orders.o_custkey == customer.c_custkey)
        .withColumn("pos", pos)
        .select(
            F.col("o_custkey").alias("doc_id"),
            F.floor(F.col("pos") / 3).cast("int").alias("chunk_id"),
            "pos",
            o.alias("o"),
            k.alias("k"),
            name.alias("name"),
            sentence.alias("sentence"),
        )
    )


def sentence_chunks(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, chunk_id, text): three templated sentences per chunk, in order."""
    return (
        sentences(spark, folder)
        .groupBy("doc_id", "chunk_id")
        .agg(F.array_sort(F.collect_list(F.struct("pos", "sentence"))).alias("s"))
        .select("doc_id", "chunk_id", F.array_join("s.sentence", " ").alias("text"))
    )


def line_chunks(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, chunk_id, text, headings, pages, provenance): four blocks per chunk below the latest section line."""
    b = blocks(spark, folder)
    w = Window.partitionBy("doc_id").orderBy("block_index")
    title = F.when(F.col("block_index") % 12 == 0, collapse_ws("text"))
    item = F.struct(
        F.col("block_index").alias("ord"),
        F.concat(F.lit("#/texts/"), F.col("block_index").cast("string")).alias("self_ref"),
        F.col("block_type").alias("label"),
        F.when(F.col("block_index") % 13 != 12, F.col("page_number")).alias("page_no"),
    )
    return (
        b.withColumn("heading", F.last(title, ignorenulls=True).over(w))
        .withColumn("chunk_id", F.floor(F.col("block_index") / 4).cast("int"))
        .groupBy("doc_id", "chunk_id")
        .agg(
            F.array_sort(F.collect_list(F.struct("block_index", "text"))).alias("t"),
            F.min_by("heading", "block_index").alias("heading"),
            F.array_sort(F.collect_list(item)).alias("items"),
        )
        .select(
            "doc_id",
            "chunk_id",
            F.array_join("t.text", "\n").alias("text"),
            F.array("heading").alias("headings"),
            F.col("items").alias("items"),
        )
    )
