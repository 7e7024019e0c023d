import unicodedata

import pytest
from hypothesis import given
from hypothesis import strategies as st

from deedloom.llm import chars, lookalike


@pytest.mark.parametrize(
    ("text", "part", "same"),
    [
        ("Åstrel shall pay", "Åstrel", True), ("Work Order 12", "Ｗｏｒｋ Ｏｒｄｅｒ １２", True), ("shall pay", "shаll pаy", True), ("shall pay", "sh​all pay", True),
        ("conﬁdential", "confidential", True), ("a  b", "a b", True), ("Hélvane Ltd", "Helvane Ltd", False), ("shall", "SHALL", False), ("Order 12", "Order 13", False),
        ("café", "cafe", False), ("cafe café", "cafe", True), (None, "a", False), ("a", None, False), ("a", "", False), ("a", " ​", False), ("", "a", False),
        ("point‑of‑contact", "point-of-contact", True),
    ],
)
def test_reads_in(text, part, same):
    assert lookalike.reads_in(text, part) is same


@given(st.text())
def test_skeleton_is_idempotent(x):
    assert chars.skeleton(chars.skeleton(x)) == chars.skeleton(x)


@given(st.text())
def test_composition_does_not_matter(x):
    assert chars.skeleton(unicodedata.normalize("NFD", x)) == chars.skeleton(unicodedata.normalize("NFC", x))


def test_table_is_a_map_to_latin():
    assert all(v.isascii() and len(v) == 1 for v in chars.LOOKALIKES.values()) and len(chars.LOOKALIKES) < 200
    assert not any(k.isascii() for k in chars.LOOKALIKES)


def test_operator(spark):
    passages = [(1, "f", 1, "shаll pay"), (1, "f", 1, "shаll pay"), (2, "f", 1, "shall pay"), (3, "f", 1, "may pay"), (4, "f", None, "shаll"), (5, None, 1, "shаll"), (6, "f", 1, None)]
    texts = [("f", 1, "He shall pay now", "x"), ("f", 1, "He shall pay now", "x"), ("g", 1, "He shall pay", "x"), ("f", 2, None, "x")]
    p = spark.createDataFrame(passages, "obligation_id bigint, filename string, chunk_id int, source_text string")
    t = spark.createDataFrame(texts, "filename string, chunk_id int, text string, obligation_id string")
    out = lookalike.lookalike_passages(p, t, ["filename", "chunk_id"], "source_text", "text")
    assert {(r.obligation_id, r.filename, r.chunk_id) for r in out.collect()} == {(1, "f", 1)} and out.count() == 1
    assert lookalike.lookalike_passages(p.limit(0), t, ["filename", "chunk_id"], "source_text", "text").count() == 0


def test_groups(spark):
    df = spark.createDataFrame([("Аcme",), ("Acme",), ("Acme",), ("Other",), (None,), ("",)], "v string")
    assert {tuple(r) for r in lookalike.skeleton_groups(df, "v").collect()} == {("Acme", "Аcme", 1, 2), ("Acme", "Acme", 2, 2)}


def test_groups_over_passages_and_chunks(spark, tmp_path):
    from deedloom.llm import queries

    o = [(1, "f", "Аcme pays"), (1, "f", "Аcme pays"), (2, "f", "Other"), (3, "f", None)]
    c = [("f", 1, "Acme pays"), ("f", 1, "Acme pays"), ("f", 2, "Ｎｏｔｉｃｅ"), ("g", 3, "Notice"), ("g", 4, "Other"), ("g", 5, None)]
    spark.createDataFrame(o, "obligation_id bigint, filename string, source_text string").write.parquet(str(tmp_path / "obligations.parquet"))
    spark.createDataFrame(c, "filename string, chunk_id int, text string").write.parquet(str(tmp_path / "chunks.parquet"))
    forms = {tuple(r) for r in queries.QUERIES["p3_forms"](spark, str(tmp_path)).collect()}
    assert forms == {
        ("source_text", "Acme pays", "Аcme pays", 1, 2), ("text", "Acme pays", "Acme pays", 1, 2), ("text", "Notice", "Ｎｏｔｉｃｅ", 1, 2), ("text", "Notice", "Notice", 1, 2),
    }
    rows = [tuple(r) for r in queries.QUERIES["p3_skeletons"](spark, str(tmp_path)).collect()]
    assert len(rows) == 8 and ("text", "f", 2, "Notice") in rows and ("source_text", "f", 1, "Acme pays") in rows and ("text", "g", 5, None) in rows


@pytest.fixture(scope="module")
def table(spark):
    return chars.confusables(spark)


@pytest.mark.parametrize(
    ("a", "b", "same"),
    [
        ("a`b", "a’b", True), ("a`b c", "a​´b c", True), ("x″y", 'x"y', True), ("x′y", "x'y", True), ("pɑy", "pay", True), ("ᎪᏢ", "AP", True), ("Ꮯontract", "Contract", True),
        ("սsed", "used", True), ("օrder", "order", True), ("ꓳrder", "Order", True), ("Ⲟrder", "Order", True), ("𝐚𝐦", "am", True), ("ⅿay", "may", True), ("Ⅰtem", "Item", True),
        ("𝟏𝟎", "10", True), ("１０", "10", True), ("lO", "10", False), ("Il", "lI", False), ("rn", "m", False), ("І", "I", True), ("І", "l", False), ("߀", "0", True), ("∣", "|", True),
        ("é", "e", False), ("Ä", "A", False), ("ѐ", "è", True), ("a∕b", "a/b", True), ("shall", "SHALL", False), ("²", "2", True), ("ﬁ", "fi", True),
    ],
)
def test_public_table(table, a, b, same):
    assert (chars.skeleton(a, table) == chars.skeleton(b, table)) is same


def test_public_table_is_large_and_leaves_ascii(table):
    assert 4_000 < len(table) < 0x110000 and [c for c in table if c < 0x80] == [ord("`")]


@given(st.text())
def test_skeletons_by_the_public_table(table, x):
    s = chars.skeleton(x, table)
    assert chars.skeleton(s, table) == s
    assert chars.skeleton(unicodedata.normalize("NFD", x), table) == chars.skeleton(unicodedata.normalize("NFC", x), table)


def test_passage_with_a_backtick(spark):
    p = spark.createDataFrame([(1, "f", 1, "the Buyer’s​ duty")], "obligation_id bigint, filename string, chunk_id int, source_text string")
    t = spark.createDataFrame([("f", 1, "It is the Buyer`s duty to pay")], "filename string, chunk_id int, text string")
    assert lookalike.lookalike_passages(p, t, ["filename", "chunk_id"], "source_text", "text").count() == 1
