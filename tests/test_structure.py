import random

from pyspark.sql import functions as F

from deedloom.operators import blocks, segment, structure


def sequential(rows):
    """The state machine as a plain loop over (page, text) in reading order."""
    import re

    sections, clause = [], None
    for page, text in rows:
        t = " ".join(text.split())
        if not t:
            continue
        c = re.match(r"^(\d+(?:\.\d+)+)\.? (.+)$", t)
        c = c if c and len(c[2]) <= 500 else None
        s = None if c else re.match(r"^(\d+)\.? (.+)$", t)
        if s:
            sections.append({"number": s[1], "title": s[2], "start": page, "end": page, "clauses": []})
            clause = None
        elif c:
            if not sections:
                top = c[1].split(".")[0]
                sections.append({"number": top, "title": f"Section {top}", "start": page, "end": page, "clauses": []})
            clause = {"number": c[1], "text": t, "start": page, "end": page}
            sections[-1]["clauses"].append(clause)
            sections[-1]["end"] = page
        elif clause:
            clause["text"] += "\n" + t
            clause["end"] = page
        elif sections:
            sections[-1]["end"] = page
    return sections


LINES = ["1 Terms", "2. Fees", "1.1 One", "1.2. Two", "2.1.1 Deep", "(a) item", "body text", "", "3.4 " + "x" * 501, "9"]


def test_segmentation_against_a_loop(spark):
    rnd = random.Random(3)
    rows, want = [], {}
    for doc in range(60):
        seq = [(1 + i // 3, rnd.choice(LINES)) for i in range(rnd.randint(1, 14))]
        rows += [(doc, p, i, "text", t) for i, (p, t) in enumerate(seq)]
        want[doc] = sequential(seq)
    rnd.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id int, page_number int, block_index int, block_type string, text string").repartition(7)
    got = {d: [] for d in want}
    for r in segment.sections(df).orderBy("doc_id", "section_ord").collect():
        got[r.doc_id].append({"number": r.number, "title": r.title, "start": r.page_start, "end": r.page_end, "clauses": []})
    for r in segment.clauses(df).orderBy("doc_id", "section_ord", "clause_ord").collect():
        got[r.doc_id][r.section_ord]["clauses"].append({"number": r.number, "text": r.text, "start": r.page_start, "end": r.page_end})
    assert got == want


def test_segmentation_of_nothing(spark):
    empty = spark.createDataFrame([], "doc_id int, page_number int, block_index int, block_type string, text string")
    assert segment.clauses(empty).count() == 0 and segment.sections(empty).count() == 0


def test_windows_share_one_exchange(spark, small):
    from deedloom.sources import derived

    plan = segment.marked(derived.blocks(spark, small))._jdf.queryExecution().executedPlan().toString()
    # the rows travel once, to their page range; the other two exchanges carry a row per range
    windows = [x for x in plan.splitlines() if "Window [" in x]
    assert plan.count("Exchange hashpartitioning") == 3 and "CartesianProduct" not in plan and any("_part" in x for x in windows)


def test_canonical_blocks(spark):
    span = "array<struct<spans:array<struct<text:string,bbox:array<double>,font:string,size:string,flags:int>>>>"
    rows = [(1, 0, [(0, 0, [1.0, 2.0, 3.0, 4.0], [([("Hel", None, "f", "9", 1), (None, None, None, "x", None)],), ([("lo ", None, None, None, None)],)]), (1, 1, None, None), (2, 5, None, [])])]
    df = spark.createDataFrame(rows, f"doc_id int, page_index int, raw_blocks array<struct<i:int,type:int,bbox:array<double>,lines:{span}>>")
    a, b, c = blocks.canonical_blocks(df).orderBy("block_index").collect()
    assert (a.page_number, a.block_type, a.text, len(a.spans), a.bbox.x1) == (1, "text", "Hello", 3, 3.0)
    assert a.spans[1].text == "" and a.spans[1].size is None
    assert (b.block_type, b.text, b.spans, b.bbox.x0) == ("image", "", [], 0.0) and c.block_type == "unknown"


def test_metadata_drops_nulls(spark):
    df = spark.createDataFrame([({"a": "1", "b": None}, b"x"), (None, b"")], "m map<string,string>, c binary")
    one, two = [r[0] for r in df.select(blocks.canonical_metadata(F.col("m"), F.col("c"))).collect()]
    assert set(one) == {"a", "sha256"} and set(two) == {"sha256"}


CHUNK = "doc_id string, chunk_id int, headings array<string>, pages array<int>"


def test_sections_first_seen(spark):
    rows = [
        ("d", 1, ["1 A", " b "], [2, 1]), ("d", 1, ["1 A", " b "], [2, 1]), ("d", 0, ["B", "", None], [None, 3]), ("d", 2, None, None),
        ("d", 3, ["  "], []),
    ]
    got = structure.doc_sections(spark.createDataFrame(rows, CHUNK)).orderBy("first_seen").collect()
    assert [(r.heading, r.locator, r.level, r.chunk_ids, r.pages) for r in got] == [
        ("B", None, None, [0, 1], [1, 2, 3]), ("1 A", "1", 1, [1], [1, 2]), ("", None, None, [3], []),
    ]


def test_structural_chunks(spark):
    meta = "struct<headings:array<string>,doc_items:array<struct<self_ref:string,label:string,prov:array<struct<page_no:int,bbox:struct<l:double>>>>>>"
    rows = [("d", 0, "t", (["H", ""], [("r1", "text", [(2, None), (None, None)]), ("r2", None, None)])), ("d", 1, "u", None)]
    a, b = structure.structural_chunks(spark.createDataFrame(rows, f"doc_id string, chunk_id int, text string, metadata {meta}")).orderBy("chunk_id").collect()
    assert a.headings == ["H"] and a.pages == [2] and [p.page_no for p in a.provenance] == [2, None]
    assert (b.headings, b.pages, b.provenance) == ([], [], [])


def test_first_chunks(spark):
    import pytest

    df = spark.createDataFrame([("d", i, None, None) for i in range(4)], CHUNK)
    assert structure.first_chunks(df, 2).count() == 2 and structure.first_chunks(df, None).count() == 4
    with pytest.raises(ValueError):
        structure.first_chunks(df, 0)


def test_paragraph_chunks_keep_all_lines(spark):
    rows = [(1, i, "x" * (37 * i % 400)) for i in range(30)] + [(2, 0, "")]
    got = structure.paragraph_chunks(spark.createDataFrame(rows, "doc_id int, i int, line string")).orderBy("doc_id", "chunk_id").collect()
    one = [r for r in got if r.doc_id == 1]
    assert "\n".join(r.text for r in one) == "\n".join(x[2] for x in rows[:30]) and [r.chunk_id for r in one] == list(range(len(one)))
