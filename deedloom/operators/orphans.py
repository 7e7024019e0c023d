"""References whose target record is missing, deleted or was loaded later.

Parent and child keys are united in one long table (tag, parent table, key), grouped by parent table and key with
map-side combining, and the groups kept in which some child has no parent in good order. Only those keys, far fewer
than the references, meet the child rows again; a hot key with a sound parent never does.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from deedloom.functions.text import SPACE, collapse_ws

# How a section of the same contract is named.
_NUMBER = r"[0-9]+(?:\.[0-9]+)*"
_BRACKETS = r"(?: ?\((?:[a-z]|[ivxlc]+)\))*"
_WORD = r"(?:(?:sub-?)?sections?|(?:sub-?)?clauses?|articles?|(?:sub-?)?paragraphs?|secs?\.?|arts?\.?|cls?\.?|paras?\.?|§+)"
SECTION_TARGET = (
    rf"(?i)^(?:{_WORD} ?)?({_NUMBER}){_BRACKETS}\.?"
    rf"(?: ?(?:and|or|&|,|/) ?(?:{_WORD} ?)?({_NUMBER}){_BRACKETS}\.?)?"
    r"(?: ?\([^()]*\))?"
    r"(?: (?:hereof|herein|above|below|of (?:this|the|the present) (?:agreement|contract)))?\.?$"
)


def section_numbers(target: Column) -> Column:
    """The one or two section numbers a target names in the same contract; [] for any other target and for null."""
    t = collapse_ws(target)
    one, two = F.regexp_extract(t, SECTION_TARGET, 1), F.regexp_extract(t, SECTION_TARGET, 2)
    found = F.array_distinct(F.filter(F.array(one, two), lambda x: x != ""))
    return F.when(F.coalesce(t.rlike(SECTION_TARGET), F.lit(False)), found).otherwise(F.array().cast("array<string>"))


def bare_locator(locator: Column) -> Column:
    """A locator without surrounding blanks and closing dot."""
    return F.regexp_replace(F.regexp_replace(locator, rf"^{SPACE}+|{SPACE}+$", ""), r"\.$", "")


def parent_keys(df: DataFrame, field: str, owner: str, key: Column) -> DataFrame:
    """Parents in long form: one row per stored row with a key; repeated and redelivered rows are merged later."""
    return df.select(
        F.lit(field).alias("field"), F.col(owner).alias("owner"), key.alias("key"),
        F.col("loaded_at").alias("parent_loaded"),
        F.col("deleted_at").isNull().alias("parent_live"),
        F.lit(None).cast("timestamp").alias("child_loaded"),
    ).where("key is not null")


def child_keys(refs: DataFrame) -> DataFrame:
    """(ref_id, field, owner, key, child_loaded): the keys every reference row holds, null keys none.

    Each reference has at most three keys, so the long form is bounded by the input.
    """
    chunk = F.when(
        F.col("source_chunk_id").isNotNull(),
        F.array(F.struct(F.lit("source_chunk_id").alias("field"), F.col("source_chunk_id").cast("string").alias("key"))),
    ).otherwise(F.array().cast("array<struct<field:string,key:string>>"))
    sections = F.transform(
        section_numbers(F.col("target")), lambda n: F.struct(F.lit("target").alias("field"), n.alias("key"))
    )
    return refs.select("ref_id", F.col("filename").alias("owner"), "loaded_at", F.inline(F.concat(chunk, sections))).select(
        "ref_id", "field", "owner", "key", F.col("loaded_at").alias("child_loaded")
    )


def suspect_keys(parents: DataFrame, children: DataFrame) -> DataFrame:
    """(field, owner, key, found, live, since): key groups that at least one child refers to in vain.

    Several rows of one parent count as one: it is live if any row is, and was loaded with its earliest row.
    """
    tagged = parents.unionByName(
        children.select(
            "field", "owner", "key", F.lit(None).cast("timestamp").alias("parent_loaded"),
            F.lit(None).cast("boolean").alias("parent_live"), "child_loaded",
        )
    )
    grouped = tagged.groupBy("field", "owner", "key").agg(
        F.count("parent_live").alias("n_parents"),
        F.max("parent_live").alias("live"),
        F.min("parent_loaded").alias("since"),
        F.min("child_loaded").alias("first_child"),
    )
    return grouped.where("first_child is not null and (n_parents = 0 or not live or since > first_child)").select(
        "field", "owner", "key", (F.col("n_parents") > 0).alias("found"), "live", "since"
    )


def orphans(refs: DataFrame, chunks: DataFrame, sections: DataFrame) -> DataFrame:
    """(ref_id, field, missing_key, status, loaded_at): one row per dangling key, load time the earliest delivery.

    ``refs`` (ref_id, filename, target, source_chunk_id, loaded_at) may hold redelivered rows; a redelivery never makes
    a reference less late, so the earliest decides. Null filenames match no parent.
    """
    parents = parent_keys(chunks, "source_chunk_id", "filename", F.col("chunk_id").cast("string")).unionByName(
        parent_keys(sections, "target", "filename", bare_locator(F.col("locator")))
    )
    children = child_keys(refs)
    bad = suspect_keys(parents, children).withColumnsRenamed({"field": "_f", "owner": "_o", "key": "_k"})
    met = children.join(
        bad, (F.col("field") == F.col("_f")) & F.col("owner").eqNullSafe(F.col("_o")) & (F.col("key") == F.col("_k"))
    )
    first = met.groupBy("ref_id", "field", "key").agg(
        F.min("child_loaded").alias("loaded_at"), F.min(F.struct("found", "live", "since")).alias("p")
    )
    status = (
        F.when(~F.col("p.found"), "missing")
        .when(~F.col("p.live"), "deleted")
        .when(F.col("p.since") > F.col("loaded_at"), "late")
    )
    return first.select("ref_id", "field", F.col("key").alias("missing_key"), status.alias("status"), "loaded_at").where(
        "status is not null"
    )


def orphan_counts(found: DataFrame) -> DataFrame:
    """(field, month, status, n): dangling keys per table and month of the reference's first load."""
    month = F.date_format("loaded_at", "yyyy-MM")
    return found.groupBy("field", month.alias("month"), "status").agg(F.count("*").alias("n"))
