from datetime import datetime

import pytest
from pyspark.sql import functions as F

from deedloom.operators import orphans


@pytest.mark.parametrize(
    ("target", "want"),
    [
        ("Section 2.3", ["2.3"]), ("§4", ["4"]), ("§ 1.2 (Fees)", ["1.2"]), ("Sections 1 and 2.2.1", ["1", "2.2.1"]), ("Clauses 3 & 3.5", ["3", "3.5"]),
        ("Section 7.6(b)", ["7.6"]), ("Section 1(a)(ii) above", ["1"]), (" Section 16.4. ", ["16.4"]), ("2.1", ["2.1"]), ("Art. 5 hereof", ["5"]),
        ("paragraph 2 of this Agreement", ["2"]), ("Section 3 of Schedule 4", []), ("Art. 7 of the Order Form", []), ("Section 5 of the Fair Act", []),
        ("Schedule 8", []), ("Order Form 72", []), ("Service Level 4", []), ("Amendment No. 3", []), ("this Agreement", []), ("", []), (None, []),
        ("Section 9", ["9"]), ("Sections 4 or 4", ["4"]),
    ],
)
def test_section_numbers(spark, target, want):
    assert spark.createDataFrame([(target,)], "t string").select(orphans.section_numbers(F.col("t"))).first()[0] == want


T = lambda d: datetime(2024, 1, d)
REFS = "ref_id int, filename string, target string, source_chunk_id int, loaded_at timestamp"
CHUNKS = "filename string, chunk_id int, loaded_at timestamp, deleted_at timestamp"
SECTIONS = "filename string, locator string, loaded_at timestamp, deleted_at timestamp"


def run(spark, refs, chunks, sections):
    return orphans.orphans(spark.createDataFrame(refs, REFS), spark.createDataFrame(chunks, CHUNKS), spark.createDataFrame(sections, SECTIONS))


def test_status(spark):
    refs = [
        (1, "f", "Section 1", 1, T(5)), (1, "f", "Section 1", 1, T(9)), (2, "f", "Section 2 and 3", 2, T(5)), (3, "g", "Section 1", 1, T(5)), (4, "f", "x", None, T(5)),
        (5, "f", None, 3, T(5)), (6, None, "Section 1", 1, T(5)), (7, "f", "4", 9, T(7)),
    ]
    chunks = [("f", 1, T(6), None), ("f", 2, T(1), T(3)), ("f", 3, T(9), None), ("f", 3, T(4), None)]
    sections = [("f", " 1. ", T(1), None), ("f", "2", T(8), T(9)), ("f", "3", T(5), None), ("f", None, T(1), None), ("f", "4 ", T(6), None), ("f", "4", T(8), None)]
    got = {(r.ref_id, r.field, r.missing_key, r.status) for r in run(spark, refs, chunks, sections).collect()}
    assert got == {
        (1, "source_chunk_id", "1", "late"), (2, "source_chunk_id", "2", "deleted"), (2, "target", "2", "deleted"), (3, "source_chunk_id", "1", "missing"),
        (3, "target", "1", "missing"), (6, "source_chunk_id", "1", "missing"), (6, "target", "1", "missing"), (7, "source_chunk_id", "9", "missing"),
    }


def test_counts_and_empty(spark):
    found = run(spark, [(1, "f", "Section 1", 1, T(5))], [], [])
    assert {tuple(r) for r in orphans.orphan_counts(found).collect()} == {("target", "2024-01", "missing", 1), ("source_chunk_id", "2024-01", "missing", 1)}
    assert run(spark, [], [], []).count() == 0


def test_hot_key_with_a_sound_parent_stays_out_of_the_join(spark):
    refs = [(i, "f", "x", 1 if i % 3 else i, T(5)) for i in range(300)]
    children = orphans.child_keys(spark.createDataFrame(refs, REFS))
    parents = orphans.parent_keys(spark.createDataFrame([("f", 1, T(1), None)], CHUNKS), "source_chunk_id", "filename", F.col("chunk_id").cast("string"))
    assert {r.key for r in orphans.suspect_keys(parents, children).collect()} == {str(i) for i in range(0, 300, 3) if i != 1}


def test_no_cross_join(spark):
    plan = run(spark, [(1, "f", "1", 1, T(5))], [("f", 1, T(1), None)], [("f", "1", T(1), None)])._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
