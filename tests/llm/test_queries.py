"""All queries of the subpackage run on the smallest tables with the columns they promise."""

import pytest

import __spark_entry__ as entry
from deedloom.llm import queries

COLUMNS = {
    "p1_found": ["ref_id", "type_id"], "p2_found": ["filename", "chunk_id", "field", "kind", "word"], "p3_found": ["obligation_id", "filename", "chunk_id"],
    "p4_found": ["group_id", "term_from", "definition_from", "chunk_from"], "p7_found": ["dense_id"], "p8_ids": ["doc_id", "ids"], "p9_found": ["doc_id", "item_id"],
    "p10_found": ["doc_id"],
}


@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_query(spark, small, name):
    df = entry.queries()[name](spark, small)
    rows = df.collect()
    if name in COLUMNS:
        assert df.columns == COLUMNS[name]
        assert name == "p8_ids" or len(set(rows)) == len(rows)
