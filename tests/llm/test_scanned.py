import pytest

from deedloom.llm import scanned

PLAIN = "Each sub-processor engaged by the supplier is bound by equivalent confidentiality undertakings. The service records are kept in a tamper-evident format and remain readable for 62 years. All notices are sent in writing."
PAGE = [
    "4 Confidcntiality",
    "Each sub-processor engaged by the supplier is bound by equiva-",
    "",
    "Draft 3 - Confidential    7",
    "- 7 -",
    "",
    "lent confidentiality undertakings. The scrvice records are kept in a tamper-",
    "evident format and remain readable for 62",
    "years.",
]


def chunks(spark, rows):
    return spark.createDataFrame(rows, "filename string, chunk_id int, text string, headings array<string>, field string")


def test_repairs(spark):
    rows = [("p", i, PLAIN, [], "x") for i in range(5)] + [("p", 9, PLAIN + " Confidentiality", None, "x")]
    rows += [("s", 1, "\n".join(PAGE), [PAGE[0]], "x")] * 2
    rows += [("s", 2, "5 Notices\nAll notices are sent in\nDraft 3 - Confidential\nwriting.", ["5 Notices"], "x")]
    rows += [("s", 3, "Draft 3 - Confidential\n6 Notices\nAll notices are sent in\nwriting.", ["Draft 3 - Confidential", "6 Notices"], None), ("s", 4, None, None, None), ("s", None, "", [], None)]
    got = {(r.chunk_id, r.field, r.kind, r.word) for r in scanned.repairs(chunks(spark, rows)).collect()}
    assert got == {
        (1, "text", "hyphen", "equivalent"), (1, "text", "hyphen", "tamper-evident"), (1, "text", "header", "Draft 3 - Confidential    7"), (1, "text", "page_number", "- 7 -"),
        (1, "text", "misread", "service"), (1, "text", "misread", "confidentiality"), (1, "headings", "misread", "confidentiality"), (2, "text", "header", "Draft 3 - Confidential"),
        (3, "text", "header", "Draft 3 - Confidential"), (3, "headings", "header", "Draft 3 - Confidential"),
    }


def test_empty(spark):
    assert scanned.repairs(chunks(spark, [])).count() == 0


def test_numbers_that_are_no_page_numbers():
    got = scanned.read_chunk("Number of licensed seats:\n602\nLocations:\n26\nThe parties agree.", [], [0] * 5)
    assert got.rows == [] and len(got.paragraphs) == 5


@pytest.mark.parametrize("line", ["12", "- 12 -", "[3]", "Page 3 of 9", "P a g e  4", "p. 4", "3 / 27", "xiv", "page 16"])
def test_page_number_patterns(line):
    assert scanned.PAGE_NUMBER.match(line)


@pytest.mark.parametrize("line", ["12.", "62 years", "Section 4", "22686.", "", "1,250."])
def test_no_page_numbers(line):
    assert not scanned.PAGE_NUMBER.match(line)


def test_joined_words():
    text, broken = scanned.joined_words(["the sub-", "processor is ter\xad", "minated and point-of-", "contact -", "(a) x"])
    assert broken == [("sub-"[:-1], "processor"), ("ter", "minated"), ("point-of", "contact")]
    assert scanned.whole_forms("point-of", "contact.") == ("point-ofcontact", "point-of-contact") and "terminated" not in text


def test_viterbi_is_the_best_path():
    from itertools import product

    texts = ["The parties agree that every", "Draft 3 - Confidential", "- 4 -", "", "notice is sent in writing."]
    lines = [scanned.Line(t, 3 if t.startswith("Draft") else 0) for t in texts]
    width = scanned.page_width([x.text for x in lines if not scanned.passing(x)])
    wrapped = scanned.evidence_of_wrapping(lines)
    before, after = scanned.neighbours(lines)
    score = [scanned.emissions(x, before[k], after[k], width, wrapped) for k, x in enumerate(lines)]
    total = lambda path: sum(score[k][s] for k, s in enumerate(path)) + sum(scanned.TRANSITIONS[p] for p in zip(path, path[1:]))
    best = max(product(scanned.LABELS, repeat=len(lines)), key=total)
    assert tuple(x.label for x in scanned.label(lines)) == best == ("B", "H", "P", "E", "B")


def test_variants():
    assert "1service" in scanned.variants("scrvice") and "2confidentiality" in scanned.variants("confidcntia1ity") and scanned.variants("") == []


def test_repaired(spark):
    rows = [("p", i, PLAIN, [], "x") for i in range(5)] + [("p", 9, PLAIN + " Confidentiality", None, "x")]
    rows += [("s", 1, "\n".join(PAGE), [PAGE[0]], "x")] * 2 + [("s", 4, None, None, None)]
    rows += [("s", 3, "Draft 3 - Confidential\n6 Not-\nices\nAll notices are sent in\nwriting.", ["Draft 3 - Confidential", "6 Not-\nices"], None)]
    got = {(r.filename, r.chunk_id): (r.text, r.headings) for r in scanned.repaired(chunks(spark, rows)).collect()}
    whole = "Each sub-processor engaged by the supplier is bound by equivalent confidentiality undertakings. The service records are kept in a tamper-evident format and remain readable for 62 years."
    assert got.pop(("s", 1)) == (f"4 Confidentiality\n{whole}", ["4 Confidentiality"])
    assert got.pop(("s", 3)) == ("6 Notices\nAll notices are sent in writing.", ["6 Notices"])
    assert got.pop(("s", 4)) == (None, None) and got.pop(("p", 9)) == (PLAIN + " Confidentiality", None)
    assert list(got.values()) == [(PLAIN, [])] * 5


def test_paragraphs():
    lines = ["The parties agree on the", "terms of the Annex.", "Notices to Nordal", "Systems AG are in writ-", "ing; (a) is point-of-", "contact."]
    said = lambda wrapped: [scanned.put_right(p, {}, {"point-of-contact": "point-of-contact"}) for p in scanned.reassembled(lines, wrapped)]
    assert said(True) == ["The parties agree on the terms of the Annex. Notices to Nordal Systems AG are in writing; (a) is point-of-contact."]
    assert scanned.reassembled(["Number of seats:", "602"], False) == [["Number of seats:"], ["602"]] and scanned.reassembled([], True) == []
    short = ["All notices are sent in", "writing.", "The law of the seat", "applies."]
    assert [scanned.put_right(p, {}, {}) for p in scanned.reassembled(short, True)] == ["All notices are sent in writing.", "The law of the seat applies."]


def test_case_of_words():
    assert [scanned.recased(*x) for x in (("Scrvice", "service"), ("SCRVICE", "service"), ("scrvice", "service"), ("Tran5ition", "transition"))] == ["Service", "SERVICE", "service", "Transition"]


LONG = "This copy was made for the archive of the supplier and shows the pages in the order in which they were received by it."


def test_a_long_line_keeps_no_chunk_from_repair(spark):
    rows = [("p", i, PLAIN, [], "x") for i in range(5)] + [("p", 9, PLAIN + " Confidentiality", None, "x")]
    rows += [("s", 1, "\n".join([*PAGE, LONG]), [PAGE[0]], "x"), ("s", 2, f"5 Notices\nAll notices are sent in\nDraft 3 - Confidential\nwriting.\n{LONG}", ["5 Notices"], "x")]
    assert len(LONG) > scanned.SHORT_LINE
    got = {(r.chunk_id, r.field, r.kind, r.word) for r in scanned.repairs(chunks(spark, rows)).collect()}
    assert got == {
        (1, "text", "hyphen", "equivalent"), (1, "text", "hyphen", "tamper-evident"), (1, "text", "header", "Draft 3 - Confidential    7"), (1, "text", "page_number", "- 7 -"),
        (1, "text", "misread", "service"), (1, "text", "misread", "confidentiality"), (1, "headings", "misread", "confidentiality"), (2, "text", "header", "Draft 3 - Confidential"),
    }
    text = {r.chunk_id: r.text for r in scanned.repaired(chunks(spark, rows)).collect() if r.filename == "s"}
    assert text[2] == f"5 Notices\nAll notices are sent in writing.\n{LONG}"


def test_running_line_that_ends_like_a_sentence(spark):
    foot = "Nordal Systems AG 2024. All rights reserved."
    rows = [("p", i, PLAIN, [], "x") for i in range(3)]
    rows += [("s", i, f"The service records are kept in a form that remains\n{foot}\nreadable for {i + 20} years.", [], "x") for i in range(6)]
    got = {(r.chunk_id, r.kind, r.word) for r in scanned.repairs(chunks(spark, rows)).collect()}
    assert got == {(i, "header", foot) for i in range(6)}


def test_labels_of_many_lines_take_linear_time():
    import time

    lines = lambda n: [scanned.Line("the records of the supplier are kept in", 0) for _ in range(n)]
    spent = []
    for n in (2_000, 16_000):
        began = time.perf_counter()
        scanned.label(lines(n))
        spent.append(time.perf_counter() - began)
    assert spent[1] < 24 * spent[0]


def test_breaks_are_labelled():
    lines = [scanned.Line(t, 0) for t in ["All notices are sent in", "writing.", "The law of the seat of the", "buyer applies to it."]]
    assert [x.label for x in scanned.label(lines)] == ["B", "K", "B", "B"]


def test_second_misreading_of_any_kind():
    assert "2noon" in scanned.variants("ncou") and not any(v.startswith("2") for v in scanned.variants("ncu"))
