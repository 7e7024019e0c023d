import base64

import pytest
import regex
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from deedloom.llm import bpe


@pytest.fixture(scope="module")
def pair():
    raw = open(bpe.VOCABULARY, "rb").read()
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, raw.splitlines())}
    return bpe.Merger(raw), tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=ranks, special_tokens={}), ranks


SPLIT = regex.compile(bpe.PATTERN).findall


def ids(merger, texts):
    offsets, flat = merger.encode(texts, SPLIT)
    return [flat[a:b].tolist() for a, b in zip(offsets, offsets[1:])]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(max_size=80), st.text(alphabet="ab ", max_size=60)), max_size=6))
def test_against_the_library(pair, texts):
    merger, library, _ = pair
    assert ids(merger, texts) == [library.encode_ordinary(t) if t else [] for t in texts]


def test_hard_words(pair):
    merger, library, ranks = pair
    texts = ["a" * 5000, "日本語" * 500, " \n\t  x  ", "<|endoftext|>", "don't we'll", "🙂" * 100, "", None, "ab" * 999]
    got = ids(merger, texts)
    assert got == [library.encode_ordinary(t) if t else [] for t in texts]
    back = {v: k for k, v in ranks.items()}
    assert b"".join(back[i] for i in got[1]).decode() == texts[1]


def test_memo_is_bounded(pair, monkeypatch):
    merger, library, _ = pair
    monkeypatch.setattr(bpe, "MEMO", 3)
    texts = ["one two three four five", "six seven"]
    assert ids(merger, texts) == [library.encode_ordinary(t) for t in texts] and len(merger.memo) <= 3


def test_operator(spark, small, pair):
    rows = [(1, "hello world", "x"), (2, None, "x"), (3, "", "x"), (1, "hello world", "x")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, ids string")
    got = sorted((r.doc_id, r.ids) for r in bpe.encode(df, "doc_id", "text").collect())
    assert got == [(1, pair[1].encode_ordinary("hello world"))] * 2 + [(2, []), (3, [])]
    assert bpe.encode(df.limit(0), "doc_id", "text").count() == 0
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text")
    texts = dict(docs.collect())
    assert {r.doc_id: r.ids for r in bpe.encode(docs, "doc_id", "text").collect()} == {k: pair[1].encode_ordinary(t or "") for k, t in texts.items()}
