import pytest
from pyspark.sql import functions as F

from deedloom.operators import assemble, extract, graph, grounding, validate
from deedloom.plans import api

TEXT = (
    'This Agreement is between Nordwind Ltd ("Nord") and the Supplier. "Users" includes all staff of Nordwind Ltd. '
    '"Order Form" shall mean a form signed by both sides. Nordwind Ltd shall pay the fee within 30 days. '
    "Nordwind Ltd may not assign Section 2.3. The Supplier may visit if invited."
)
CHUNKS = "doc_id string, chunk_id int, text string, headings array<string>, pages array<int>"


@pytest.fixture()
def chunks(spark):
    return spark.createDataFrame([("d", 0, TEXT, ["1 A"], [1]), ("d", 1, TEXT, ["1 A"], [2]), ("e", 0, "Nothing here.", None, None)], CHUNKS)


def test_rule_extraction(chunks):
    found = extract.RuleExtractor().extract(chunks.where("doc_id = 'd' and chunk_id = 0"))
    row = lambda k: [r.asDict() for r in extract.of_kind(found, k).orderBy("item_index").collect()]
    assert (row("party")[0]["name"], row("party")[0]["designation"]) == ("Nordwind Ltd", "Nord")
    assert [r["term"] for r in row("defined_term")] == ["Users", "Order Form"]
    assert [(r["action"], r["deadline"]) for r in row("obligation")] == [("pay the fee", "within 30 days"), ("not assign Section 2.3", None)]
    assert [(r["action"], r["condition"]) for r in row("right")] == [("visit", "if invited")]
    assert [r["target"] for r in row("reference")] == ["This Agreement", "Order Form", "Section 2.3"]


def test_definition_modes(spark, chunks):
    terms = extract.RuleExtractor().extract(chunks.where("doc_id = 'd' and chunk_id = 0")).where("kind = 'defined_term'")
    compat = {r.term: r.status for r in validate.check(terms, chunks).collect()}
    fixed = {r.term: r.status for r in validate.check(terms, chunks, "fixed").collect()}
    assert compat == {"Users": "accept", "Order Form": "reject"} and fixed == {"Users": "accept", "Order Form": "accept"}


PARTY = "doc_id string, chunk_id int, item_index int, name string, designation string, source_text string"


def test_party_checks(spark, chunks):
    src = 'between Nordwind Ltd ("Nord") and'
    rows = [
        ("d", 0, 0, "Nordwind Ltd", "Nord", src), ("d", 0, 1, "Nordwind Ltd", "Buyer", src), ("d", 0, 2, "Nobody", None, src),
        ("d", 0, 3, "Nordwind Ltd", "", src), ("d", 0, 4, "Nordwind Ltd", None, " "), ("d", 9, 5, "Nordwind Ltd", None, src),
        ("d", 0, 6, None, None, None), ("d", 0, 7, "Nordwind Ltd", None, "..."),
    ]
    checked = validate.check(extract.widen("party", spark.createDataFrame(rows, PARTY)), chunks)
    got = {r.item_index: (r.status, r.reason) for r in checked.collect()}
    assert got == {
        0: ("accept", None), 1: ("repair", validate.NO_DESIGNATION), 2: ("reject", validate.NO_NAME), 3: ("accept", None),
        4: ("reject", validate.UNSUPPORTED), 5: ("reject", validate.UNSUPPORTED), 6: ("reject", validate.UNSUPPORTED), 7: ("accept", None),
    }
    kept = {r.item_index: r.designation for r in validate.accepted(checked).collect()}
    assert kept == {0: "Nord", 1: None, 3: "", 7: None}
    issue = {r.item_index: r for r in validate.issues(checked).collect()}
    assert issue[1].item_type == "party_designation" and '"designation":"Buyer"' in issue[1].item and '"source_chunk_id":null' in issue[1].item


def test_blank_and_order_of_checks(spark, chunks):
    rows = [("d", 0, 0, " ", " ", None), ("d", 0, 1, "x", " ", None), ("d", 0, 2, "x", "y", "not there"), ("d", 0, 3, "x", "y", "pay the fee")]
    df = spark.createDataFrame(rows, "doc_id string, chunk_id int, item_index int, party string, action string, source_text string")
    reasons = {r.item_index: r.reason for r in validate.check(extract.widen("obligation", df), chunks).collect()}
    assert reasons == {0: validate.NO_OBLIGED, 1: validate.NO_DUTY, 2: validate.UNSUPPORTED, 3: None}


def test_other_kinds_are_left_out(spark, chunks):
    df = extract.widen("party", spark.createDataFrame([("d", 0, 0, "x", None, "y")], PARTY)).withColumn("kind", F.lit("error"))
    assert validate.check(df, chunks).count() == 0


def test_dedupe(spark):
    rows = [("d", 1, 0, " ACME ", None, "s1"), ("d", 0, 1, "acme", None, "s0"), ("d", 2, 0, "Acme", "Buyer", "s2"), ("d", 3, 0, "Acme", "Seller", "s3")]
    (r,) = assemble.dedupe_parties(spark.createDataFrame(rows, PARTY)).collect()
    assert (r.name, r.source_text, r.designation, r.chunk_id) == ("acme", "s0", "Buyer", 0)
    terms = [("d", 0, 0, "Fee", "x"), ("d", 0, 1, " fee", "x "), ("d", 0, 2, "Fee", "X"), ("e", 0, 0, "Fee", "x"), ("d", 1, 0, None, None)]
    got = assemble.dedupe_terms(spark.createDataFrame(terms, "doc_id string, chunk_id int, item_index int, term string, definition string"))
    assert sorted((r.doc_id, r.chunk_id, r.item_index) for r in got.collect()) == [("d", 0, 0), ("d", 0, 2), ("d", 1, 0), ("e", 0, 0)]


def test_contract(spark, chunks, failing):
    docs = chunks.select("doc_id").distinct()
    whole = api.extract_contract(docs, chunks, max_chunks=1)
    got = {r.doc_id: r for r in whole.representation.collect()}
    d = got["d"]
    assert len(d.structure.chunks) == 2 and len(d.structure.sections) == 1 and d.validation.chunks_validated == 1
    assert [p.name for p in d.semantics.parties] == ["Nordwind Ltd"] and [t.term for t in d.semantics.defined_terms] == ["Users"]
    assert [i.reason for i in d.validation.issues] == [validate.NO_PATTERN] and got["e"].semantics.parties == []
    loose = api.extract_contract(docs, chunks, validate=False)
    d = {r.doc_id: r for r in loose.representation.collect()}["d"]
    assert d.validation.chunks_validated == 0 and d.validation.issues == [] and [t.term for t in d.semantics.defined_terms] == ["Users", "Order Form"]


def test_extract_chunk(chunks):
    assert api.extract_chunk(chunks, 1).where("kind = 'party'").count() == 1 and api.extract_chunk(chunks, 7).count() == 0
    assert api.extract_chunk(chunks, 0, validate=True).where("kind = 'defined_term'").count() == 1
    with pytest.raises(ValueError):
        api.extract_chunk(chunks, -1)


def test_bounds_and_attached_ids(spark, chunks):
    assert {r.doc_id for r in api.out_of_bounds(chunks, 1).collect()} == {"e"}
    df = spark.createDataFrame([(7, [("a",)]), (8, None)], "c int, x array<struct<t:string>>")
    got = df.select(assemble.attach_chunk_id(F.col("x"), F.col("c"))).collect()
    assert got[0][0][0].source_chunk_id == 7 and got[1][0] is None


def test_clause_references(spark):
    refs = spark.createDataFrame([("d", 0, "Sections 2 and 9"), ("d", 5, "Section 2"), ("d", None, "2"), ("e", 0, "Section 2"), ("d", 0, None)], "doc_id string, chunk_id int, target string")
    sections = spark.createDataFrame([("d", "1.", [0, 1]), ("d", " 2", [2]), ("d", None, [5]), ("e", "1", None)], "doc_id string, locator string, chunk_ids array<int>")
    assert [(r.doc_id, r.src, r.dst) for r in graph.clause_references(refs, sections).collect()] == [("d", "1", "2")]


def test_client_extractor(spark, chunks):
    def make():
        calls = {}

        def client(text):
            calls[text] = calls.get(text, 0) + 1
            if text.startswith("Nothing"):
                raise RuntimeError("down")
            if calls[text] == 1:
                raise RuntimeError("again")
            return {"party": [{"name": "Nordwind Ltd", "designation": None, "source_text": "Nordwind Ltd"}]}

        return client

    found = extract.ClientExtractor(make).extract(chunks)
    assert sorted((r.kind, r.source_text) for r in found.collect()) == [("error", "down")] + [("party", "Nordwind Ltd")] * 2


def test_replay(chunks):
    found = extract.RuleExtractor().extract(chunks)
    again = extract.ReplayExtractor(found).extract(chunks.where("chunk_id = 1"))
    assert again.where("kind = 'party'").count() == 1


def test_graph(spark, chunks):
    accepted, _ = validate.validate(extract.RuleExtractor().extract(chunks), chunks)
    labels = {r.label for r in graph.edges(accepted).collect()}
    assert labels == {"HAS_PARTY", "HAS_DEFINED_TERM", "IMPOSES_ON", "GRANTED_TO"} <= set(graph.LABELS)
    assert ("d", "DefinedTerm", "Users") in {tuple(r) for r in graph.vertices(accepted).collect()}
    assert graph.edge_metadata("DEFINES") == {"edge_label": "DEFINES"}
    with pytest.raises(ValueError):
        graph.edge_metadata("KNOWS")


def test_grounding_against_brute_force(spark):
    import re

    base = "the quick brown fox jumps over the lazy dog near the old river bank today".split()
    texts = [(i, " ".join(base[i % 5 :]) + (" and more" if i % 2 else "")) for i in range(12)] + [(99, None), (98, "")]
    passages = [(1, "Brown fox jumps over the lazy DOG"), (2, "fox"), (3, "ox jumps over the lazy dog nea"), (4, None), (5, "..."), (6, "absent words in here for once only")]
    fold = lambda x: re.sub("[^a-z0-9]+", " ", x.lower()).strip()
    want = {(t, p) for t, x in texts for p, y in passages if x is not None and y is not None and fold(y) in fold(x)}
    got = grounding.grounded(spark.createDataFrame(texts, "text_id int, text string"), spark.createDataFrame(passages, "passage_id int, passage string"))
    assert {tuple(r) for r in got.collect()} == want


def test_accepted_and_rejected_partition(spark, small):
    from deedloom.plans import catalog
    from deedloom.sources import derived

    c, chunks = catalog.candidates(spark, small), derived.sentence_chunks(spark, small)
    checked = validate.check(extract.together(c), chunks)
    for kind, df in c.items():
        assert checked.where(F.col("kind") == kind).count() == df.count()


def test_health(spark):
    assert api.health(spark)["status"] == "ok"


def test_records_of_contracts(spark, tmp_path):
    from deedloom.plans import catalog

    def run(name, title, duty):
        rows = [("f", 0, f"1 {title}\nNordal Ltd shall {duty} within 3 days.", [f"1 {title}"], [1]), ("f", 1, "Nothing is said here.", [f"1 {title}"], [2]), ("g", 0, "Empty.", None, None)]
        folder = str(tmp_path / name)
        spark.createDataFrame(rows * 2, "filename string, chunk_id int, text string, headings array<string>, pages array<int>").write.parquet(f"{folder}/chunks.parquet")
        return {r.doc_id: r for r in catalog.QUERIES["contract_records"](spark, folder).collect()}

    a, b, c = run("a", "Scope", "pay"), run("b", "Terms", "pay"), run("c", "Scope", "pack")
    assert (a["f"].n_sections, a["f"].n_chunks, a["f"].n_obligations, a["f"].chunks_validated) == (1, 2, 1, 2) and (a["g"].n_sections, a["g"].n_chunks) == (0, 1)
    assert a["f"].structure_md5 != b["f"].structure_md5 and a["f"].semantics_md5 == b["f"].semantics_md5 != c["f"].semantics_md5 and a["g"] == c["g"]


@pytest.fixture()
def failing():
    """Makers of clients that fail on chunks with a text; local, so that workers needn't import this module."""

    def maker(text):
        def make():
            def client(t):
                if text in t:
                    raise ValueError("down")
                return {"party": [{"name": "Nordwind Ltd", "source_text": "between Nordwind Ltd"}]}

            return client

        return make

    return maker


def test_failed_chunks_are_errors_of_the_contract(spark, chunks, failing):
    docs = chunks.select("doc_id").distinct()
    out = api.extract_contract(docs, chunks, extractor=extract.ClientExtractor(failing("Nothing"), retries=1))
    assert [tuple(r) for r in out.errors.collect()] == [("e", 0, "down")]
    n = {r.doc_id: r.validation.chunks_validated for r in out.representation.collect()}
    assert n == {"d": 2, "e": 0}


def test_cached_extraction(spark, chunks, tmp_path, failing):
    docs = chunks.select("doc_id").distinct()
    path = str(tmp_path / "semantic")
    run = lambda make, **options: api.extract_contract(docs, chunks, extractor=extract.ClientExtractor(make, 0), cache_path=path, **options)
    facts = lambda out: sorted((r.doc_id, r.chunk_id, r.name) for r in out.accepted.collect())
    first = run(failing("Nothing"))
    assert [r.chunk_id for r in first.errors.collect()] == [0] and len(facts(first)) == 1
    second = run(failing("Agreement"))  # what failed is asked again, what was read isn't
    assert second.errors.count() == 0 and facts(second) == facts(first)
    third = run(failing("Agreement"), force_refresh=True)
    assert sorted(r.chunk_id for r in third.errors.collect()) == [0, 1]
    assert run(failing("Nothing")).errors.count() == 0


def test_objects_and_bare_numbers(spark):
    text = "The Supplier shall promptly deliver the goods. The Buyer shall pay on demand. See 1.4 and 2.3.1, not 1.5 percent, EUR 2.50 or 10.5%."
    found = extract.RuleExtractor().extract(spark.createDataFrame([("d", 0, text)], "doc_id string, chunk_id int, text string"))
    assert [r.object for r in found.where("kind = 'obligation'").orderBy("item_index").collect()] == ["the goods", None]
    assert [(r.target, r.reference_type) for r in found.where("kind = 'reference'").orderBy("item_index").collect()] == [("1.4", "section_reference"), ("2.3.1", "section_reference")]


def test_files_to_contracts(spark):
    uploads = spark.createDataFrame([("a", "a.pdf", b"good"), ("b", "b.pdf", b"bad"), ("c", "c.pdf", b"")], "doc_id string, filename string, content binary")

    def make():
        def parse(content, name):
            if content == b"bad":
                raise ValueError("unreadable")
            lines = ["Preamble", "1 Parties", TEXT, "2 Law", "x " * 600, "y " * 600]
            blocks = [{"i": k, "type": 0, "bbox": None, "lines": [{"spans": [{"text": t, "bbox": None, "font": None, "size": None, "flags": None}]}]} for k, t in enumerate(lines)]
            return [{"page_index": 0, "width": 1.0, "height": 1.0, "raw_blocks": blocks}]

        return parse

    out = api.extract_files(uploads, make)
    (r,) = out.representation.collect()
    assert [(c.chunk_id, c.headings, c.pages) for c in r.structure.chunks] == [(0, [], [1]), (1, ["1 Parties"], [1]), (2, ["2 Law"], [1]), (3, ["2 Law"], [1])]
    assert [s.locator for s in r.structure.sections] == ["1", "2"] and [p.name for p in r.semantics.parties] == ["Nordwind Ltd"]
    assert sorted((e.doc_id, e.error) for e in out.errors.collect()) == [("b", "ValueError: unreadable"), ("c", "The uploaded file is empty.")]
