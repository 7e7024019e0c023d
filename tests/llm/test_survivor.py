from datetime import datetime

import pytest
from pyspark.sql import functions as F

from deedloom.llm import survivor

TERMS = "term_id bigint, filename string, term string, definition string, source_text string, source_chunk_id int, model string, extracted_at timestamp, loaded_at timestamp"
D = "any records that either party keeps for 12 months after signature"
S = f'"Base Rate" means {D}.'
T = lambda d: datetime(2024, 1, d)


def run(spark, rows):
    models = spark.createDataFrame([("best", 1), ("good", 2)], "model string, trust_rank int")
    return {tuple(r) for r in survivor.survivors(spark.createDataFrame(rows, TERMS), models).collect()}


def row(i, term="Base Rate", definition=D, source=S, chunk=1, model="good", at=1, file="f"):
    return (i, file, term, definition, source, chunk, model, at and T(at), T(20))


def test_fields_come_from_the_best_records(spark):
    rows = [
        row(5, chunk=None, model="best", at=1), row(6, definition=D + " and so on", model=None, at=2), row(7, chunk=9, model="other", at=9),
        row(3, definition="tbd", chunk=None, at=10), row(7, chunk=9, model="other", at=9),
    ]
    assert run(spark, rows) == {(3, 5, 6, 7)}


def test_ties(spark):
    assert run(spark, [row(2), row(1), row(3)]) == {(1, 1, 1, 1)}
    assert run(spark, [row(2, chunk=None, at=None), row(1, chunk=None, at=None)]) == {(1, 1, 1, None)}
    assert run(spark, [row(2, at=None), row(9, at=3)]) == {(2, 9, 9, 9)}


def test_what_belongs_together(spark):
    rows = [
        row(1), row(2, "the Base Rate", None, None), row(3, '"Base  Rate" ("BR")', D[:40] + " [...]", None), row(4, "BASE RATE.", D.replace("records", "recrods"), None),
        row(5, "Base Rent", "see above", None), row(6, "Base Rate", "only goods that carry a valid backup copy of order 7", None),
        row(7, "Base Rate", D.replace("12", "21"), None), row(8, file="g"), row(9, file=None), row(10, file=None),
    ]
    groups = {r[0] for r in run(spark, rows)}
    assert groups == {1, 9}
    g = survivor.grouped(spark.createDataFrame(rows, TERMS)).groupBy("filename", "gt", "gd").agg(F.collect_set("term_id").alias("ids"))
    # record 2 has no definition and the term has several meanings only by records without source: the sure one takes it
    assert {frozenset(r.ids) for r in g.where("filename = 'f'").collect()} == {frozenset({1, 2, 3, 4}), frozenset({5}), frozenset({6}), frozenset({7})}


def test_without_any_source(spark):
    rows = [row(1, source=None), row(2, source=None, definition=D[:50]), row(3, source=None, definition="n/a"), row(4, source=None, term="Other Thing", definition="N/A")]
    assert run(spark, rows) == {(1, 1, 1, 1)}


def test_nulls_and_empty(spark):
    rows = [(1, None, None, None, None, None, None, None, None), (2, "f", "", "", "", None, None, None, None), (3, "f", "x" * 5000, "y " * 5000, None, 1, None, None, T(1))]
    assert run(spark, rows) == set() and run(spark, []) == set()


@pytest.mark.parametrize(
    ("a", "b", "same"),
    [(D, D, True), (D[:30], D, True), (D.replace("party", "pary"), D, True), (D.replace("12", "13"), D, False), ("any other words that say it", D, False), (D, D[:30], False), ("", D, False)],
)
def test_same_meaning(a, b, same):
    assert survivor.same_meaning(a, b) is same


def test_hot_group_is_ranked_in_parts(spark):
    rows = [row(i, model="best" if i == 77 else "good", at=1 + i % 20) for i in range(1, 400)]
    assert run(spark, rows) == {(1, 77, 77, 19)}


def test_short_terms_slip_by_their_definition(spark):
    s = S.replace("Base Rate", "Fees")
    rows = [row(1, "Fees", source=s), row(2, "Feess", source=None), row(3, "Feess", None, None), row(4, "Feet", "any boot that is sold in pairs", None), row(5, "Fee", D[:40], None, chunk=7, at=9)]
    assert run(spark, rows) == {(1, 5, 1, 5)}
    g = survivor.grouped(spark.createDataFrame(rows, TERMS)).groupBy("gt", "gd").agg(F.collect_set("term_id").alias("ids"))
    assert {frozenset(r.ids) for r in g.collect()} == {frozenset({1, 2, 5}), frozenset({3}), frozenset({4})}
    models = spark.createDataFrame([("good", 2)], "model string, trust_rank int")
    assert [tuple(r) for r in survivor.surviving(spark.createDataFrame(rows, TERMS), models).collect()] == [(1, "f", "Fee", D, 7)]


def slipped(rnd, text):
    """A definition cut, with slips in some of its words, or with a blank lost or typed."""
    w = text.split()
    kind = rnd.randrange(4)
    if kind == 0:
        return " ".join(w)[: rnd.randint(min(8, len(text)), len(text))].strip()
    if kind == 1:
        k = rnd.randrange(1, max(2, len(w)))
        if k >= len(w):
            return text
        return " ".join([*w[: k - 1], w[k - 1] + w[k], *w[k + 1 :]])
    if kind == 2:
        k = rnd.randrange(len(w))
        return " ".join([*w[:k], w[k][:2] + " " + w[k][2:], *w[k + 1 :]]) if len(w[k]) > 3 else text
    for k in rnd.sample(range(len(w)), rnd.randint(1, max(1, len(w) // 4))):
        if w[k].isalpha() and len(w[k]) > 3:
            w[k] = w[k][0] + w[k][2] + w[k][1] + w[k][3:]
    return " ".join(w)


def test_rarest_keys_lose_nothing():
    import random
    from collections import Counter

    rnd = random.Random(5)
    words = ["any", "order", "that", "either", "party", "keeps", "records", "signed", "goods", "carry", "valid", "backup", "copy", "months", "after", "signature", "7", "12"]
    full = list({" ".join(rnd.choice(words) for _ in range(rnd.randint(2, 16))) for _ in range(400)})
    counts = Counter(k for d in full for k in survivor.full_keys(d))
    n = 0
    for d in full:
        short = survivor.fold_definition(slipped(rnd, d))
        want = {x for x in full if short and survivor.same_meaning(short, x)}
        by_family = {}
        for family, need, key in survivor.short_keys(short) if short else []:
            by_family.setdefault(family, [need, []])[1].append(key)
        asked = {k for need, keys in by_family.values() for k in sorted((k for k in keys if counts[k]), key=lambda k: (counts[k], k))[:need]}
        assert want <= {x for x in full if asked & set(survivor.full_keys(x))}, (short, want)
        n += len(want)
    assert n > 200


def test_links_are_followed_to_their_end(spark):
    rows = [("f", "t", "a", "t", "b"), ("f", "t", "b", "t", "c"), ("f", "t", "c", "t", "d"), ("f", "t", "d", "t", "d"), ("f", "u", "", "t", "a")]
    got = survivor.closed(spark.createDataFrame(rows, "filename string, tk string, dk string, gt string, gd string"))
    assert {(r.tk, r.dk, r.gd) for r in got.collect()} == {("t", x, "d") for x in "abcd"} | {("u", "", "d")}


def test_one_term_with_many_meanings(spark):
    """40,000 records of one term: half of them have a source, each other one is a cut of one meaning."""
    import time

    n = 20_000
    text = F.concat(F.lit("any order that is placed under number "), F.col("id").cast("string"), F.lit(" of the seller and paid within ninety days"))
    rows = spark.range(n).select("id", text.alias("d"))
    null = lambda t: F.lit(None).cast(t)
    record = lambda ident, definition, source: rows.select(
        ident.alias("term_id"), F.lit("f").alias("filename"), F.lit("Order").alias("term"), definition.alias("definition"), source.alias("source_text"),
        F.lit(1).alias("source_chunk_id"), null("string").alias("model"), null("timestamp").alias("extracted_at"), null("timestamp").alias("loaded_at"),
    )
    sure = record(F.col("id"), F.col("d"), F.concat(F.lit('"Order" means '), "d", F.lit(".")))
    cut = record(F.col("id") + n, F.expr("left(d, length(d) - 12)"), null("string"))
    models = spark.createDataFrame([("good", 2)], "model string, trust_rank int")
    began = time.perf_counter()
    got = survivor.survivors(sure.unionByName(cut), models).agg(F.count("*").alias("n"), F.count_if(F.expr("group_id = definition_from")).alias("m")).first()
    assert (got.n, got.m) == (n, n) and time.perf_counter() - began < 120
