import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from deedloom.functions import text as tx
from deedloom.functions.unicode import evidence, nfkc


def one(spark, value, expr, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(expr(F.col("x")).alias("y")).first()[0]


@pytest.mark.parametrize("value", ["  a b\t", " a\x1c", "\x85x　", "​x", "", " ", None, "a\n\n"])
def test_strip_is_pythons(spark, value):
    assert one(spark, value, tx.py_strip) == (None if value is None else value.strip())


@pytest.mark.parametrize("value", ["  a \n b\tc ", "", " ", "a\x1fb", None])
def test_collapse(spark, value):
    assert one(spark, value, tx.collapse_ws) == (None if value is None else " ".join(value.split()))


@pytest.mark.parametrize(
    ("line", "number", "rest"),
    [
        ("7.1 Fees are due", "7.1", "Fees are due"),
        ("7.1. Fees", "7.1", "Fees"),
        ("7 Fees", None, None),
        ("1.1 " + "x" * 500, "1.1", "x" * 500),
        ("1.1 " + "x" * 501, None, None),
        ("1.1", None, None),
    ],
)
def test_numbered_clause(spark, line, number, rest):
    got = one(spark, line, tx.numbered_clause)
    assert (got and got["number"]) == number and (got and got["remainder"]) == rest


@pytest.mark.parametrize(
    ("heading", "want"),
    [
        ("2.1 Fees", ("2.1", "Fees", 2)),
        ("1. Definitions.", (None, "1. Definitions.", None)),
        ("  Recitals ", (None, "Recitals", None)),
        ("3 A", ("3", "A", 1)),
    ],
)
def test_parse_heading(spark, heading, want):
    assert tuple(one(spark, heading, tx.parse_heading)) == want


@pytest.mark.parametrize(("name", "suffix"), [("a.PDF", ".PDF"), ("x/y.tar.gz", ".gz"), (".hidden", ""), ("end.", ""), ("none", "")])
def test_file_suffix(spark, name, suffix):
    from pathlib import PurePosixPath

    assert one(spark, name, tx.file_suffix) == suffix == PurePosixPath(name).suffix


def test_section_heading_limits(spark):
    rows = [("text", "1 " + "t" * 120, True), ("text", "1 " + "t" * 121, False), ("image", "1 T", False), ("text", " ", False), ("text", None, False)]
    df = spark.createDataFrame(rows, "k string, t string, want boolean")
    assert all(r.got == r.want for r in df.withColumn("got", tx.is_section_heading(F.col("k"), F.col("t"))).collect())


def test_letter_and_section(spark):
    assert one(spark, "(B) text", tx.letter_item) == "b"
    assert one(spark, "12. Title", tx.section_line)["title"] == "Title"
    assert one(spark, "2.1 x", tx.section_line) is None


@pytest.mark.parametrize(("value", "want"), [("™ ½ Ａ", "tm 1 2 a"), ("é x", "x"), ("", ""), ("…", ""), (None, None)])
def test_evidence(spark, value, want):
    assert one(spark, value, evidence) == want


@settings(max_examples=20, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(max_size=20)), min_size=1, max_size=20))
def test_evidence_is_idempotent(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "x string").select(evidence(F.col("x")).alias("x"))
    assert all(r.x == r.y for r in df.select("x", evidence(F.col("x")).alias("y")).collect())


def test_nfkc_skips_ascii(spark):
    assert one(spark, "plain", nfkc) == "plain" and one(spark, "ﬁ", nfkc) == "fi"


def test_holds(spark):
    df = spark.createDataFrame([("abc", "b"), ("abc", ""), (None, "a"), ("a", None)], "h string, n string")
    assert [r[0] for r in df.select(tx.holds(F.col("h"), F.col("n"))).collect()] == [True, True, False, False]
