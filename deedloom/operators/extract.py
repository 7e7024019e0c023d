"""Semantic extraction. The rule provider approximates what a language model is asked for; it reads sentences."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from deedloom.functions.text import py_strip
from deedloom.sources import cache

# Signal words of the five classes.
DUTY = r"(shall not|may not|shall|must|is required to|are required to|agrees to|will be responsible to|is responsible for)"
PERMISSION = r"(may|has the right to|is entitled to|grants the right to|is permitted to)"
DEFINES = r"(means|shall mean|refers to|includes)"
NUMBER = r"(?<![\w.,$€£%/-])(?<!(?:EUR|USD|GBP) )(?<![€$£] )[0-9]{1,2}(?:\.[0-9]{1,2}){1,3}(?![\w%/-]|[.,][0-9]| ?(?:%|percent|per cent|EUR|USD|GBP|euros?|dollars?|million|hours?|days?|weeks?|months?|years?)\b)"
REFERENCE = r"(Section [0-9]+(?:\.[0-9]+)*|Exhibit [A-Z]|Order Form(?: [0-9]+)?|Applicable Laws|[Tt]his Agreement|the foregoing|as described above|" + NUMBER + ")"


# The fields of each class in their order, and of all classes together.
FIELDS = {
    "party": ["name", "designation", "source_text"],
    "defined_term": ["term", "definition", "source_text"],
    "obligation": ["party", "action", "object", "condition", "deadline", "source_text"],
    "right": ["party", "action", "condition", "deadline", "source_text"],
    "reference": ["target", "reference_type", "source_text"],
}
ALL_FIELDS = [*dict.fromkeys(f for names in FIELDS.values() for f in names if f != "source_text"), "source_text"]


class Extractor(Protocol):
    """Anything that turns chunks (doc_id, chunk_id, text) into candidates in long form: (doc_id, chunk_id, kind,
    item_index, all fields), where ``item_index`` counts a class within its chunk from 0."""

    def extract(self, chunks: DataFrame) -> DataFrame: ...


def split_sentences(chunks: DataFrame) -> DataFrame:
    """(doc_id, chunk_id, pos, sentence): cut after . ! ? before an upper-case letter or a quote; blanks are dropped."""
    parts = F.split("text", r"(?<=[.!?])\s+(?=[\p{Lu}\"])|\n+")
    return (
        chunks.select("doc_id", "chunk_id", F.posexplode(parts).alias("pos", "sentence"))
        .withColumn("sentence", py_strip(F.col("sentence")))
        .where("sentence <> ''")
    )


DEADLINE = r" (within .+? days|within .+? hours|no later than .+?|at least .+? days before .+?|prior to .+?|on or before .+?)[.,]?$"
CONDITION = r",? ((?:if|unless|provided that|except|upon|subject to) .+?)\.?$"
PARTY = r'between (.+?) \("([^"]+)"\)'
DEFINITION = rf'^"([^"]+)" {DEFINES} (.+?)\.?$'


def party(s: Column) -> tuple[Column, dict[str, Column]]:
    """``between NAME ("Alias")``."""
    return s.rlike(PARTY), {"name": F.regexp_extract(s, PARTY, 1), "designation": F.regexp_extract(s, PARTY, 2)}


def defined_term(s: Column) -> tuple[Column, dict[str, Column]]:
    """``"X" means Y.``"""
    return s.rlike(DEFINITION), {"term": F.regexp_extract(s, DEFINITION, 1), "definition": F.regexp_extract(s, DEFINITION, 3)}


# What follows a verb without being its object.
NO_OBJECT = r"(?:to|by|with|for|in|on|at|from|of|upon|as|that|if|be|not|under|against|within|after|before|and|or|until)"
OBJECT = rf"^(?:not )?(?!be )(?:[a-z]+ly )?[a-z]+ ((?!{NO_OBJECT}\b).+)$"


def _deontic(s: Column, signal: str) -> tuple[Column, dict[str, Column]]:
    pattern = rf"^(.+?) {signal} (.+?)\.?$"
    body = F.regexp_extract(s, pattern, 3)
    short = F.regexp_replace(body, CONDITION, "")
    negative = F.when(F.regexp_extract(s, pattern, 2).isin("shall not", "may not"), "not")
    action = F.concat_ws(" ", negative, F.regexp_replace(short, DEADLINE, ""))
    return s.rlike(pattern), {
        "party": F.regexp_extract(s, pattern, 1),
        "action": action,
        "object": F.when(action.rlike(OBJECT), F.regexp_extract(action, OBJECT, 1)),
        "condition": F.when(body.rlike(CONDITION), F.regexp_extract(body, CONDITION, 1)),
        "deadline": F.when(short.rlike(DEADLINE), F.regexp_extract(short, DEADLINE, 1)),
    }


def obligation(s: Column) -> tuple[Column, dict[str, Column]]:
    """Duties and prohibitions; ``may not`` is a prohibition, a definition is none. The object is what follows the verb."""
    fits, fields = _deontic(s, DUTY)
    return fits & ~s.rlike(rf'^"[^"]+" {DEFINES} '), fields


def right(s: Column) -> tuple[Column, dict[str, Column]]:
    """Permissions; sentences with ``may not`` are none."""
    fits, fields = _deontic(s, PERMISSION)
    del fields["object"]
    return fits & ~s.contains("may not"), fields


def reference_kind(t: Column) -> Column:
    """The type of a mention of a section (also by its bare number), exhibit, order form, law or the agreement."""
    return (
        F.when(t.rlike(r"^(?:Section|[0-9])"), "section_reference")
        .when(t.startswith("Exhibit"), "exhibit_reference")
        .when(t.startswith("Order Form"), "order_form_reference")
        .when(F.lower(t) == "this agreement", "agreement_reference")
        .when(t == "Applicable Laws", "other_contract_reference")
        .otherwise("defined_term_reference")
    )


def items_of(s: Column) -> Column:
    """All items of a sentence as one array of (kind, nth, fields): every sentence is read once for all classes."""

    def item(kind: str, nth: Column, fields: dict[str, Column]) -> Column:
        null = F.lit(None).cast("string")
        return F.struct(F.lit(kind).alias("kind"), nth.alias("nth"), *[fields.get(f, null).alias(f) for f in ALL_FIELDS[:-1]])

    single = []
    for kind, rule in (("party", party), ("defined_term", defined_term), ("obligation", obligation), ("right", right)):
        fits, fields = rule(s)
        single.append(F.when(fits, item(kind, F.lit(0), fields)))
    mentions = F.transform(
        F.regexp_extract_all(s, F.lit(REFERENCE), F.lit(1)),
        lambda t, k: item("reference", k, {"target": t, "reference_type": reference_kind(t)}),
    )
    return F.concat(F.filter(F.array(*single), lambda x: x.isNotNull()), mentions)


class RuleExtractor:
    """The deterministic provider: built-in expressions only, an approximation of free extraction."""

    def extract(self, chunks: DataFrame) -> DataFrame:
        found = split_sentences(chunks).select(
            "doc_id", "chunk_id", "pos", F.col("sentence").alias("source_text"), F.inline(items_of(F.col("sentence")))
        )
        return numbered(found, "pos", "nth").drop("pos", "nth")


def numbered(items: DataFrame, *order: str) -> DataFrame:
    """Add ``item_index``: the item's position in its chunk and class, from 0, over all items whether valid or not."""
    w = Window.partitionBy("doc_id", "chunk_id", "kind").orderBy(*order)
    return items.withColumn("item_index", F.row_number().over(w) - 1)


def widen(kind: str, items: DataFrame) -> DataFrame:
    """Items of one class (doc_id, chunk_id, item_index, its fields) in long form."""
    own = set(items.columns)
    fields = [(F.col(f) if f in own else F.lit(None).cast("string")).alias(f) for f in ALL_FIELDS]
    return items.select("doc_id", "chunk_id", F.lit(kind).alias("kind"), "item_index", *fields)


def together(candidates: dict[str, DataFrame]) -> DataFrame:
    """Classes given one by one in one long table."""
    return reduce(DataFrame.unionByName, [widen(k, c) for k, c in candidates.items() if k in FIELDS])


def of_kind(items: DataFrame, kind: str) -> DataFrame:
    """One class of a long table with its own fields."""
    rest = [c for c in items.columns if c not in ALL_FIELDS and c != "kind"]
    return items.where(F.col("kind") == kind).select(*rest, *FIELDS[kind])


class ReplayExtractor:
    """Candidates that were extracted before, in long form."""

    def __init__(self, candidates: DataFrame):
        self.candidates = candidates

    def extract(self, chunks: DataFrame) -> DataFrame:
        return self.candidates.join(chunks.select("doc_id", "chunk_id"), ["doc_id", "chunk_id"], "left_semi")


class ClientExtractor:
    """A model behind a client: ``make_client()`` gives, once per partition, a callable text -> {class: [item, ...]}.

    Failed calls are repeated up to ``retries`` times, then the error travels as a row of kind ``error`` with its message
    as ``source_text``, so that one bad chunk doesn't end the job.
    """

    def __init__(self, make_client: Callable[[], Callable[[str], dict]], retries: int = 2):
        self.make_client, self.retries = make_client, retries

    def extract(self, chunks: DataFrame) -> DataFrame:
        make_client, retries = self.make_client, self.retries

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            client = make_client()
            for b in batches:
                out = []
                for doc, chunk, text in zip(b.doc_id, b.chunk_id, b.text):
                    for attempt in range(retries + 1):
                        try:
                            reply = client(text or "")
                            break
                        except Exception as e:  # the client's own errors are data here
                            reply = {"error": [{"source_text": str(e)}]}
                    for kind, items in reply.items():
                        out += [(doc, chunk, kind, i, *(x.get(f) for f in ALL_FIELDS)) for i, x in enumerate(items)]
                yield pd.DataFrame(out, columns=["doc_id", "chunk_id", "kind", "item_index", *ALL_FIELDS])

        key = dict(chunks.dtypes)
        fields = ", ".join(f"{f} string" for f in ALL_FIELDS)
        schema = f"doc_id {key['doc_id']}, chunk_id {key['chunk_id']}, kind string, item_index int, {fields}"
        return chunks.select("doc_id", "chunk_id", "text").mapInPandas(run, schema)


def failures(items: DataFrame) -> DataFrame:
    """(doc_id, chunk_id, error): chunks whose extraction failed."""
    return items.where("kind = 'error'").select("doc_id", "chunk_id", F.col("source_text").alias("error"))


#: What a cached extraction holds: the items of one chunk, under the key of its text, place, model and version.
CACHED = T.StructType(
    [
        T.StructField("semantic_key", T.StringType()),
        T.StructField("items", T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("item_index", T.IntegerType()), *[T.StructField(f, T.StringType()) for f in ALL_FIELDS]]))),
    ]
)


class CachedExtractor:
    """An extractor behind a cache below ``path``: chunks that were read before by the same model and version are not
    read again, unless ``force_refresh`` asks for it; then only the entries of these chunks are renewed.

    The key covers the chunk's own text (or the column ``document_key``, where chunks have one), its id, the model and
    the version; equal keys are read once. Chunks whose extraction fails aren't stored and come out as errors.
    """

    def __init__(self, inner: Extractor, path: str, model: str, version: str, force_refresh: bool = False):
        self.inner, self.path, self.model, self.version, self.force_refresh = inner, path, model, version, force_refresh

    def extract(self, chunks: DataFrame) -> DataFrame:
        from deedloom.session import cut_lineage

        store = cache.ParquetCache(chunks.sparkSession, self.path, CACHED, ("semantic_key",), self.version)
        document = F.col("document_key") if "document_key" in chunks.columns else F.sha2(F.coalesce("text", F.lit("")), 256)
        key = cache.semantic_key(document, F.coalesce("chunk_id", F.lit(-1)), F.lit(self.model), F.lit(self.version))
        keyed = chunks.select("doc_id", "chunk_id", "text", key.alias("semantic_key"))
        todo = cut_lineage(store.missing(keyed, self.force_refresh))
        found = cut_lineage(self.inner.extract(todo.select("doc_id", "chunk_id", "text")))
        failed = failures(found).join(todo.select("doc_id", "chunk_id", "semantic_key"), ["doc_id", "chunk_id"])
        item = F.struct("kind", F.col("item_index").cast("int").alias("item_index"), *ALL_FIELDS)
        per_chunk = found.where("kind <> 'error'").groupBy("doc_id", "chunk_id").agg(F.array_sort(F.collect_list(item)).alias("items"))
        read = todo.join(failed, "semantic_key", "left_anti").join(per_chunk, ["doc_id", "chunk_id"], "left")
        store.add(read.select("semantic_key", F.coalesce("items", F.array()).alias("items")))
        known = keyed.join(store.read(), "semantic_key").select("doc_id", "chunk_id", F.inline("items"))
        null = F.lit(None).cast("string")
        errors = keyed.join(failed.select("semantic_key", "error"), "semantic_key").select(
            "doc_id", "chunk_id", F.lit("error").alias("kind"), F.lit(0).alias("item_index"), *[null.alias(f) for f in ALL_FIELDS[:-1]], F.col("error").alias("source_text")
        )
        return known.unionByName(errors)
