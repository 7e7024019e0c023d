import random

import pytest

from deedloom.llm import canon

ENTRIES = [(1, "section_reference", "Section"), (2, "defined_term_reference", "Defined term"), (9, "law_reference", "Law"), (13, "service_level_reference", "Service level")]


def plain_distance(a, b):
    """Restricted Damerau distance by the full table."""
    d = [[max(i, j) if not i or not j else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i][j] = min(d[i][j], d[i - 2][j - 2] + 1)
    return d[-1][-1]


def test_automaton_against_brute_force():
    rnd = random.Random(1)
    paths = ["".join(rnd.choice("abc") for _ in range(rnd.randint(1, 7))) for _ in range(60)]
    trie = canon.Trie()
    for i, p in enumerate(paths):
        trie.add(p, 0, i)
    for _ in range(200):
        w = "".join(rnd.choice("abcd") for _ in range(rnd.randint(1, 7)))
        k = rnd.randint(0, 3)
        want = sorted((plain_distance(w, p), 0, i) for i, p in enumerate(paths) if plain_distance(w, p) <= k)
        assert sorted(set(trie.within(w, k))) == want


@pytest.mark.parametrize(
    ("value", "want"),
    [
        ("Section", 1), ("§ reference", 1), ("sectionr eference", 1), ("s3cti0n_reference", 1), ("sеction_rеference", 1), ("SectionRef", 1),
        ("type=section", 1), ("section / section", 1), ("ARTÍCULO", 1), ("section_reference 5.4", 1), ("ref: defined term", 2), ("lwa reference", 9),
        ("S.L.A.", 13), ("unlawful", 0), ("laws of physics demo", 0), ("election results", 0), ("reference", 0), ("42", 0), ("???", 0), ("n/a", 0), ("", 0),
        ("x" * 10_000, 0),
    ],
)
def test_match(value, want):
    assert canon.Matcher(ENTRIES)(value) == want


def test_ties_are_deterministic():
    m = canon.Matcher([(7, "aaaab_x", "Aaaab"), (3, "aaaac_x", "Aaaac")], {})
    assert m("aaaad") == 3


ROWS = "ref_id bigint, reference_type string, type_id string"


def test_operator(spark):
    rows = [(1, "Clause", "?"), (1, "Clause", "?"), (2, None, "?"), (3, "   ", "?"), (4, "section_reference", "?"), (5, "logo", None), (6, " section_reference", None)]
    reference = spark.createDataFrame([(1, "section_reference", "Section", "d"), (None, None, None, None)], "type_id int, type_code string, label string, description string")
    out = canon.typed_references(spark.createDataFrame(rows, ROWS), reference.where("type_id is not null"), "ref_id", "reference_type")
    assert {tuple(r) for r in out.collect()} == {(1, "Clause", 1), (5, "logo", 0), (6, " section_reference", 1)}
    assert [tuple(r) for r in canon.unmatched_report(out, "reference_type").collect()] == [("logo", 1)]


def test_empty(spark):
    reference = spark.createDataFrame([], "type_id int, type_code string, label string")
    rows = spark.createDataFrame([(1, "Clause", "?")], ROWS)
    assert [r.type_id for r in canon.typed_references(rows, reference, "ref_id", "reference_type").collect()] == [0]
    assert canon.typed_references(rows.limit(0), reference, "ref_id", "reference_type").count() == 0


def frames(spark):
    reference = spark.createDataFrame([(i, f"kind_{w}", w) for i, w in enumerate(["alpha", "alphas", "bravo", "charlie", "delta"], 1)], "type_id int, type_code string, label string")
    rows = spark.createDataFrame([(i, v, None) for i, v in enumerate(["alpah", "alphass", "brvo", "charly", "nothing", "Załącznik", "delta", "delta"])], ROWS)
    return rows, reference


def test_all_entries_within_distance(spark):
    rows, reference = frames(spark)
    aliases = spark.createDataFrame([("kind_delta", "załącznik"), ("kind_unknown", "nothing"), (None, None)], "type_code string, alias string")
    got = {tuple(r) for r in canon.candidates(rows, reference, "reference_type", aliases).collect()}
    assert got == {("alpah", 1, 1), ("brvo", 3, 1), ("alphass", 1, 2), ("alphass", 2, 1), ("charly", 4, 2), ("Załącznik", 5, 0), ("delta", 5, 0)}
    best = {(r.ref_id, r.type_id) for r in canon.typed_references(rows, reference, "ref_id", "reference_type", aliases).collect()}
    assert best == {(0, 1), (1, 2), (2, 3), (3, 4), (4, 0), (5, 5), (6, 5), (7, 5)}


def test_a_long_list_is_matched_in_blocks(spark):
    rows, reference = frames(spark)
    one = {tuple(r) for r in canon.candidates(rows, reference, "reference_type").collect()}
    entries = canon.entry_table(reference, canon.alias_table(spark, {}))
    assert len(list(canon.entry_blocks(entries, 200))) > 1 and sum(map(len, canon.entry_blocks(entries, 200))) == 5
    assert {tuple(r) for r in canon.candidates(rows, reference, "reference_type", size=200).collect()} == one
    whole = lambda size: {tuple(r) for r in canon.typed_references(rows, reference, "ref_id", "reference_type", size=size).collect()}
    assert whole(200) == whole(canon.BLOCK_BYTES)


@pytest.mark.parametrize(("value", "want"), [("sezione", 1), ("hoofdstuk", 1), ("klauzula", 1), ("wetgeving", 9), ("x section", 1), ("section refere", 1), ("unlisted wording", 0)])
def test_other_wordings(value, want):
    assert canon.Matcher(ENTRIES)(value) == want
