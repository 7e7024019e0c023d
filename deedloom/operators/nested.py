"""Deeply nested records to flat tables by Dewey labels.

Every node gets an ordinal path identifier from the root (``d2.c0.c1.p0.b``: document item 2, child 0, child 1,
provenance entry 0, box). A node's parent is its label cut at the last dot, its table the label without ordinals. One
pass over the payloads writes all nodes; no node needs another, so nothing is shuffled.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Columns of the node table beside key and label; each table uses its own ones.
NODE_FIELDS = {
    "chunk_id": pa.int64(), "text": pa.string(), "headings": pa.list_(pa.string()), "self_ref": pa.string(),
    "label": pa.string(), "page_no": pa.int64(), "l": pa.float64(), "t": pa.float64(), "r": pa.float64(),
    "b": pa.float64(), "coord_origin": pa.string(),
}
_SQL = {pa.int64(): "bigint", pa.string(): "string", pa.float64(): "double", pa.list_(pa.string()): "array<string>"}


def load(payload: str | None):
    """The parsed payload; None if it is null, no JSON or nested beyond what the parser takes."""
    try:
        value = json.loads(payload)
        return json.loads(value) if isinstance(value, str) else value
    except (ValueError, TypeError, RecursionError):
        return None


def _members(value) -> list[tuple[int, object]]:
    """(position, member) of a list, of an object keyed by positions, or of a single object."""
    if isinstance(value, list):
        return list(enumerate(value))
    if isinstance(value, dict) and value:
        if all(isinstance(k, str) and k.isdecimal() for k in value):
            return sorted((int(k), v) for k, v in value.items())
        return [(0, value)]
    return []


def _entries(value) -> list[tuple[int, object]]:
    """Provenance entries: those of a list, or the one object that stands there without a list, even an empty one."""
    return [(0, value)] if isinstance(value, dict) else list(enumerate(value)) if isinstance(value, list) else []


def _text(v) -> str | None:
    if isinstance(v, dict):
        v = v.get("$ref")
    return None if v is None else v if isinstance(v, str) else json.dumps(v, ensure_ascii=False)


def _number(v, kind):
    try:
        return None if v is None or isinstance(v, bool) else kind(v)
    except (ValueError, TypeError, OverflowError):
        return None


def _box(v) -> dict | None:
    if isinstance(v, list):
        v = dict(zip("ltrb", v))
    if not isinstance(v, dict):
        return None
    return {**{k: _number(v.get(k), float) for k in "ltrb"}, "coord_origin": _text(v.get("coord_origin"))}


def walk(record: dict) -> Iterator[tuple[str, dict, int]]:
    """(label, fields, number of provenance entries) of every node below a parsed record, parents first."""
    meta = record.get("metadata")
    if isinstance(meta, str):
        meta = load(meta)
    meta = meta if isinstance(meta, dict) else {}
    heads = meta.get("headings")
    yield "", {
        "chunk_id": _number(record.get("chunk_id"), int), "text": _text(record.get("text")),
        "headings": [_text(h) for h in heads] if isinstance(heads, list) else None,
    }, 0
    todo = [(f"d{i}", x) for i, x in reversed(_members(meta.get("doc_items")))]
    while todo:
        label, item = todo.pop()
        if not isinstance(item, dict):
            continue
        prov = _entries(item.get("prov"))
        yield label, {"self_ref": _text(item.get("self_ref")), "label": _text(item.get("label"))}, len(prov)
        for k, e in prov:
            e = e if isinstance(e, dict) else {}
            yield f"{label}.p{k}", {"page_no": _number(e.get("page_no"), int)}, 0
            if (box := _box(e.get("bbox"))) is not None:
                yield f"{label}.p{k}.b", box, 0
        todo += [(f"{label}.c{i}", x) for i, x in reversed(_members(item.get("children")))]


def nodes(records: DataFrame, key: str, payload: str, with_fields: bool = True) -> DataFrame:
    """(key, dewey, n_prov, fields...): all nodes of all readable payloads, one pass, no shuffle.

    Null, unreadable and non-object payloads give no nodes. Missing parts are absent, parts of another shape are read
    as far as they make sense: an object keyed by positions counts as a list, a lone provenance object as entry 0,
    metadata given as JSON text is parsed. ``with_fields=False`` writes labels only.
    """
    fields = NODE_FIELDS if with_fields else {}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, labels, counts, values = [], [], [], {f: [] for f in fields}

            def flush() -> pa.RecordBatch:
                columns = [pa.array(ids, batch.schema.field(0).type), pa.array(labels, pa.string()), pa.array(counts, pa.int32())]
                columns += [pa.array(values[f], t) for f, t in fields.items()]
                out = pa.RecordBatch.from_arrays(columns, names=["_key", "dewey", "n_prov", *[f"f_{f}" for f in fields]])
                ids.clear(), labels.clear(), counts.clear(), [v.clear() for v in values.values()]
                return out

            for k, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                record = load(text)
                if not isinstance(record, dict):
                    continue
                for label, found, n in walk(record):
                    ids.append(k), labels.append(label), counts.append(n)
                    for f in fields:
                        values[f].append(found.get(f))
                if len(ids) > 20_000:
                    yield flush()
            yield flush()

    kind = dict(records.dtypes)[key]
    schema = f"_key {kind}, dewey string, n_prov int" + "".join(f", f_{f} {_SQL[t]}" for f, t in fields.items())
    out = records.select(F.col(key).alias("_k"), F.col(payload).alias("_p")).mapInArrow(run, schema)
    return out.withColumnsRenamed({"_key": key, **{f"f_{f}": f for f in fields}})


def parent(dewey: Column) -> Column:
    """The label of the parent: cut at the last dot; items of the top level have the root '', the root has null."""
    return F.when(dewey != "", F.regexp_replace(dewey, r"\.?[^.]*$", ""))


def schema_path(dewey: Column) -> Column:
    """The table of a node: its last step without the ordinal, '' for the root, with child items among the items."""
    return F.translate(F.regexp_extract(dewey, r"([a-z])[0-9]*$", 1), "c", "d")


def item_path(dewey: Column) -> Column:
    """``d2.c0.c1.p0`` as ``2/0/1``: the item a node is or belongs to."""
    return F.replace(F.regexp_replace(F.regexp_replace(dewey, r"\.p.*$", ""), "[dc]", ""), F.lit("."), F.lit("/"))


def tables(records: DataFrame, key: str, payload: str) -> dict[str, DataFrame]:
    """Tables chunks, items, provenance and boxes; every row has its label and its parent's."""
    all_nodes = nodes(records, key, payload).withColumn("parent", parent(F.col("dewey")))
    step = schema_path(F.col("dewey"))
    columns = {
        "chunks": ("", ["chunk_id", "text", "headings"]),
        "items": ("d", ["self_ref", "label", "n_prov"]),
        "provenance": ("p", ["page_no"]),
        "boxes": ("b", ["l", "t", "r", "b", "coord_origin"]),
    }
    return {n: all_nodes.where(step == s).select(key, "dewey", "parent", *c) for n, (s, c) in columns.items()}


def provenance_entries(records: DataFrame, key: str, payload: str) -> DataFrame:
    """(key, item_path, prov_no): one row per provenance entry of every item, -1 for an item without entries."""
    n = nodes(records, key, payload, with_fields=False)
    step, d = schema_path(F.col("dewey")), F.col("dewey")
    entry = F.when(step == "p", F.regexp_extract(d, r"p([0-9]+)$", 1).cast("int")).otherwise(-1)
    return n.where((step == "p") | ((step == "d") & (F.col("n_prov") == 0))).select(
        key, item_path(d).alias("item_path"), entry.alias("prov_no")
    )
