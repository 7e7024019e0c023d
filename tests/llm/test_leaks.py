import numpy as np
import pytest

from deedloom.llm import leaks

A = "One gilded compass reached the harbour of Tellmarch in 1825 because the river was declared unsafe. Nobody repaired the smoked lantern like the salt merchant did."
B = "The peat cutter wrote twenty letters about a folding mould unless an angry swan lost its roof and the toll house changed hands again before winter."
ITEMS = "item_id bigint, prompt string, text string, question string, doc_id string"
DOCS = "doc_id bigint, text string, item_id string"
FILLER = "Has anyone tried to change the delivery window before sending it to the other side? Thanks for the reply."


def frames(spark, docs, items=((1, None, A, "Who repaired the lantern?", "x"), (2, "p", B, None, "x"), (3, None, None, None, "x"), (4, None, "", "", "x"))):
    return spark.createDataFrame([(i, t, "x") for i, t in docs], DOCS), spark.createDataFrame(list(items), ITEMS)


def halves():
    w = A.split()
    return " ".join(w[: len(w) // 2 + 1]), " ".join(w[:10])


def test_found(spark):
    more, less = halves()
    marked = "<p>" + A.upper().replace("RIVER", "<b>RI</b>VER").replace("a", "а") + "</p>"
    quoted = "> " + A.replace(" because", "\n> because").replace("compass", "cоmpаss​")
    docs = [(i, FILLER + f" {i}") for i in range(30)] + [
        (100, A), (101, FILLER + " " + more + " " + FILLER), (102, less), (103, marked), (104, quoted), (105, None), (106, ""), (107, A + " " + B),
        (108, "Who repaired the lantern?"), (109, " ".join(A.split()[::2])), (110, A.replace("harbour", "port").replace("salt", "tea")), (111, FILLER * 2000 + A),
    ]
    got = {(r.doc_id, r.item_id) for r in leaks.leaks(*frames(spark, docs), "doc_id", "text").collect()}
    assert got == {(100, 1), (101, 1), (103, 1), (104, 1), (107, 1), (107, 2), (110, 1), (111, 1)}


def test_paraphrase(spark):
    w = A.replace(".", "").split()
    loose = " ".join(x for i, x in enumerate(w) for x in ([x] if i % 4 else [x, "indeed"]))
    docs = [(i, FILLER) for i in range(5)] + [(1, loose), (2, A)]
    got = leaks.leaks(*frames(spark, docs), "doc_id", "text", paraphrases=True).where("lcs is not null").collect()
    assert [(r.doc_id, r.item_id) for r in got] == [(1, 1)] and got[0].lcs == 1.0


def test_empty(spark):
    docs, items = frames(spark, [(1, A)])
    assert leaks.leaks(docs.limit(0), items, "doc_id", "text").count() == 0
    assert leaks.leaks(docs, items.limit(0), "doc_id", "text").count() == 0
    assert leaks.leaks(docs, items.where("text is null"), "doc_id", "text").count() == 0


def test_item_table_is_checked(spark, monkeypatch):
    monkeypatch.setattr(leaks, "MAX_ITEMS", 1)
    with pytest.raises(ValueError):
        leaks.held_out(frames(spark, [(1, A)])[1])


def test_lcs_against_the_table():
    rnd = np.random.default_rng(1)
    for _ in range(50):
        a, b = rnd.integers(0, 4, rnd.integers(0, 20)).tolist(), rnd.integers(0, 4, rnd.integers(0, 20)).tolist()
        d = np.zeros((len(a) + 1, len(b) + 1), dtype=int)
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                d[i + 1, j + 1] = d[i, j] + 1 if x == y else max(d[i, j + 1], d[i + 1, j])
        assert leaks.lcs(a, b) == d[-1, -1]


def test_recall_of_retrieval_on_the_tables(spark, small):
    """Latent candidates lose nothing that the exact measure over all pairs finds."""
    docs, items = spark.read.parquet(f"{small}/documents.parquet"), spark.read.parquet(f"{small}/eval_items.parquet")
    known = leaks.held_out(items)
    every = set(range(len(known.ids)))
    want = {
        (r.doc_id, known.ids[n]) for r in docs.select("doc_id", "text").collect() for n, c in leaks.covered(known, known.encode(r.text), every).items() if c >= leaks.SHARE
    }
    assert {(r.doc_id, r.item_id) for r in leaks.leaks(docs, items, "doc_id", "text").collect()} == want


def test_latent_space_is_close_to_the_exact_one(spark):
    docs, items = frames(spark, [(i, A if i % 2 else B) for i in range(20)])
    known = leaks.held_out(items)
    space = leaks.latent_space(leaks.encoded(docs.selectExpr("doc_id as k", "text as t"), known), known)
    for n, t in enumerate(known.texts):
        assert n in space.candidates(t)
    assert np.allclose(np.linalg.norm(space.items, axis=1), 1)


def test_questions_are_asked_in_all_words_and_missing_ones_of_none(spark):
    rows = [(1, A, "Who saw the swan?"), (2, B, None)]
    there, back = leaks.Items.of(rows), leaks.Items.of(rows[::-1])
    names = lambda it, n: {w for w, i in it.vocabulary.items() if i in it.questions[n].tolist()}
    assert names(there, 0) == names(back, 1) == {"the", "swan"}
    w = B.replace(".", "").split()
    loose = " ".join(x for i, x in enumerate(w) for x in ([x] if i % 4 else [x, "indeed"]))
    got = leaks.leaks(*frames(spark, [(i, FILLER) for i in range(5)] + [(9, loose)]), "doc_id", "text", paraphrases=True).where("lcs is not null").collect()
    assert [(r.doc_id, r.item_id, r.answer) for r in got] == [(9, 2, None)]


def test_long_texts_take_the_memory_of_a_block():
    import tracemalloc

    rnd = np.random.default_rng(2)
    items = rnd.standard_normal((50, 96))
    space = leaks.Space(rnd.standard_normal((500, 96)), items / np.linalg.norm(items, axis=1, keepdims=True))
    short = rnd.integers(-1, 500, 40_000).astype(np.int32)
    vectors = np.vstack([np.zeros((1, 96)), np.where(short[:, None] >= 0, space.words[short], 0)])
    sums = np.cumsum(vectors, axis=0)
    starts = np.arange(0, len(short) - leaks.STEP, leaks.STEP)
    whole = np.vstack([sums[-1:], sums[np.minimum(starts + leaks.PASSAGE, len(short))] - sums[starts]])
    assert space.candidates(short) == set(np.flatnonzero(space.nearest(whole)).tolist())
    tracemalloc.start()
    space.candidates(rnd.integers(-1, 500, 1_000_000).astype(np.int32))
    assert tracemalloc.get_traced_memory()[1] < 200_000_000
    tracemalloc.stop()
