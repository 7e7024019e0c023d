import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from deedloom.llm import pieces


def check(text, limit, overlap):
    found = pieces.spans(text, limit, overlap)
    parts = [text[a:b] for a, b in found]
    assert pieces.rebuild(parts, overlap) == text
    assert all(0 < len(p) <= limit for p in parts)
    assert all(b[0] == a[1] - overlap and b[1] > a[1] for a, b in zip(found, found[1:]))
    return found


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab .\n,;。́", max_size=400), st.integers(5, 60), st.integers(0, 4))
def test_any_text(text, limit, overlap):
    found = check(text, limit, overlap)
    marks = {p for p, _ in pieces.boundaries(text)}
    for start, end in found[:-1]:
        window = range(max(start + overlap + 1, 0), start + limit + 1)
        assert end in marks or not any(p in marks for p in window)


def test_boundaries_and_balance():
    text = "\n\n".join(" ".join([f"Sentence number {i} is here. It has two parts; and more."] * 8) for i in range(20))
    found = check(text, 2400, 200)
    assert len(found) == -(-(len(text) - 200) // 2200) and all(text[:e].rstrip().endswith(".") for _, e in found[:-1])


@pytest.mark.parametrize("text", ["x" * 10_001, "漢" * 5000, "漢字。" * 2000, "á" * 3000, "\n" * 5000, "<t>word</t>" * 900])
def test_without_blanks(text):
    found = check(text, 2400, 200)
    assert len(found) <= -(-(len(text) - 200) // 2200) + 2


def test_limits():
    assert pieces.spans("") == [] and pieces.spans("x" * 2400) == [(0, 2400)] and len(pieces.spans("x" * 2401)) == 2
    with pytest.raises(ValueError):
        pieces.spans("abc", 2, 2)


def test_operator(spark):
    long = "word " * 600
    rows = [(1, "f", 1, long, None), (1, "f", 1, long, None), (2, "f", 2, long, None), (3, "f", 3, "part", 2), (4, "g", 2, long, 9), (5, "f", 5, None, None), (6, "f", 6, "", None), (7, None, 7, long, None)]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "dense_id bigint, filename string, chunk_id int, text string, resplit_of int, piece_no string")
    out = pieces.split(pieces.oversized(df), "dense_id").collect()
    assert {r.dense_id for r in out} == {1, 4, 7}
    one = sorted((r for r in out if r.dense_id == 1), key=lambda r: r.piece_no)
    assert pieces.rebuild([r.text for r in one]) == long and [r.piece_no for r in one] == [0, 1]
    assert pieces.split(pieces.oversized(df.limit(0)), "dense_id").count() == 0
