import json

from hypothesis import given, settings
from hypothesis import strategies as st

from deedloom.operators import nested

PAYLOADS = [
    (1, json.dumps({"chunk_id": 3, "text": "t", "metadata": {"headings": ["H"], "doc_items": [{"self_ref": "#/a", "label": "text", "prov": [{"page_no": "7", "bbox": {"l": "1.5", "t": 2}}], "children": [{"self_ref": {"$ref": "#/b"}, "prov": {"bbox": [1, 2, 3, 4]}}, {"prov": []}]}]}})),
    (2, json.dumps({"metadata": {"doc_items": {"0": {}, "10": {"prov": [{}, {}]}}}})),
    (3, json.dumps({"metadata": json.dumps({"doc_items": [{"prov": {}}]})})),
    (4, "{broken"), (5, None), (6, ""), (7, "[]"), (8, "null"), (9, json.dumps({"metadata": None})), (10, json.dumps({"metadata": {"doc_items": [None, 3, {"children": None}]}})),
    (11, json.dumps(json.dumps({"metadata": {"doc_items": [{}]}}))),
]


def frame(spark, rows=PAYLOADS):
    return spark.createDataFrame(rows, "raw_id bigint, payload string")


def test_entries(spark):
    got = {tuple(r) for r in nested.provenance_entries(frame(spark), "raw_id", "payload").collect()}
    assert got == {
        (1, "0", 0), (1, "0/0", 0), (1, "0/1", -1), (2, "0", -1), (2, "10", 0), (2, "10", 1), (3, "0", 0), (10, "2", -1), (11, "0", -1),
    }


def test_tables_are_linked(spark):
    t = {n: df.collect() for n, df in nested.tables(frame(spark), "raw_id", "payload").items()}
    keys = {n: {(r.raw_id, r.dewey) for r in rows} for n, rows in t.items()}
    assert {r.raw_id for r in t["chunks"]} == {1, 2, 3, 9, 10, 11} and all(r.parent is None for r in t["chunks"])
    assert all((r.raw_id, r.parent) in keys["chunks"] | keys["items"] for r in t["items"])
    assert all((r.raw_id, r.parent) in keys["items"] for r in t["provenance"]) and all((r.raw_id, r.parent) in keys["provenance"] for r in t["boxes"])
    first = next(r for r in t["boxes"] if r.dewey == "d0.p0.b")
    assert (first.l, first.t, first.r) == (1.5, 2.0, None) and next(r for r in t["provenance"] if r.raw_id == 1).page_no == 7
    assert next(r for r in t["items"] if r.dewey == "d0.c0").self_ref == "#/b"
    assert t["chunks"][0].headings == ["H"]


def test_clashing_and_empty(spark):
    df = frame(spark).withColumnsRenamed({"raw_id": "dewey", "payload": "n_prov"})
    assert nested.nodes(df.withColumnRenamed("dewey", "_key"), "_key", "n_prov", with_fields=False).count() > 0
    assert nested.provenance_entries(frame(spark, []), "raw_id", "payload").count() == 0


tree = st.recursive(st.just({}), lambda kids: st.fixed_dictionaries({"children": st.lists(kids, max_size=3), "prov": st.lists(st.just({}), max_size=2)}), max_leaves=12)


def brute(items, path=()):
    for i, x in enumerate(items):
        p = (*path, i)
        n = len(x.get("prov", []))
        yield from (("/".join(map(str, p)), k) for k in (range(n) if n else [-1]))
        yield from brute(x.get("children", []), p)


@settings(max_examples=15, deadline=None)
@given(st.lists(tree, max_size=4))
def test_any_tree(spark, items):
    df = frame(spark, [(1, json.dumps({"metadata": {"doc_items": items}}))])
    got = sorted((r.item_path, r.prov_no) for r in nested.provenance_entries(df, "raw_id", "payload").collect())
    assert got == sorted(brute(items))


def test_very_deep(spark):
    item = {}
    for _ in range(200):
        item = {"children": [item]}
    df = frame(spark, [(1, json.dumps({"metadata": {"doc_items": [item]}})), (2, "[" * 100_000)])
    assert nested.provenance_entries(df, "raw_id", "payload").count() == 201
