"""Evaluation passages in training texts (problem 9): latent semantic retrieval of candidates, then exact checks."""

from __future__ import annotations

import html
import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from deedloom.llm.chars import plain

#: Consecutive words that count as a stretch, and the share of an item's words in stretches that makes a leak.
STRETCH, SHARE = 5, 0.5
#: Words of a passage and how far the next one starts; rank of the latent space and the vectors drawn beyond it.
PASSAGE, STEP, RANK, BEYOND = 64, 32, 96, 16
#: Passages of a text that are compared with the items at once, which bounds the memory that a long text takes.
TOGETHER = 512
#: Cosine in the latent space from which an item is a candidate for a passage.
CANDIDATE = 0.2
#: A paraphrase has so much of the item as a common subsequence, and so much of the question's words.
PARAPHRASE_LCS, PARAPHRASE_ANSWER = 0.6, 0.75
#: The item table has to be this small: it and its words are sent to every worker.
MAX_ITEMS = 20_000

_INLINE = re.compile(r"</?(?:b|i|u|s|em|strong|span|a|font|small|sup|sub|mark|tt|q|cite|del|ins|abbr)\b[^<>]*>|\[/?(?:b|i|u|s|color|size|font|url|sup|sub)(?:=[^\]\[]*)?\]", re.I)
_BLOCK = re.compile(r"</?[a-zA-Z][^<>]*>|\[/?[a-zA-Z*]+(?:=[^\]\[]*)?\]")
_WORD = re.compile(r"[^\W_]+(?:'[^\W_]+)*")


def words(text: str | None) -> list[str]:
    """Words as a reader sees them: no markup, marks, case, accents or look-alikes. Null and blank texts have none."""
    if not text:
        return []
    t = html.unescape(html.unescape(text)) if "&" in text else text
    if "<" in t or "[" in t:
        t = _BLOCK.sub(" ", _INLINE.sub("", t))
    return [w.replace("'", "") if "'" in w else w for w in _WORD.findall(t.lower() if t.isascii() else plain(t))]


@dataclass
class Items:
    """The held-out items as word ids, with an index of their stretches."""

    ids: list[int]
    vocabulary: dict[str, int] = field(default_factory=dict)
    texts: list[np.ndarray] = field(default_factory=list)
    questions: list[np.ndarray] = field(default_factory=list)
    stretches: dict[tuple[int, ...], list[tuple[int, int]]] = field(default_factory=lambda: defaultdict(list))

    @classmethod
    def of(cls, rows: list[tuple[int, str | None, str | None]]) -> "Items":
        """Items without text are left out: they can't leak."""
        out = cls([])
        asked = []
        for ident, text, question in rows:
            w = [out.vocabulary.setdefault(x, len(out.vocabulary)) for x in words(text)]
            if not w:
                continue
            n = len(out.ids)
            out.ids.append(ident)
            out.texts.append(np.array(w, dtype=np.int64))
            for p in range(len(w) - STRETCH + 1):
                out.stretches[tuple(w[p : p + STRETCH])].append((n, p))
            asked.append(question)
        for question in asked:  # when the vocabulary has the words of all texts
            q = [out.vocabulary[x] for x in words(question) if x in out.vocabulary]
            out.questions.append(np.array(sorted(set(q)), dtype=np.int64))
        out.stretches = dict(out.stretches)
        return out

    def encode(self, text: str | None) -> np.ndarray:
        get = self.vocabulary.get
        return np.array([get(w, -1) for w in words(text)], dtype=np.int64)


def covered(items: Items, doc: np.ndarray, candidates: set[int]) -> dict[int, float]:
    """Per candidate item the share of its words that stand in the text in stretches of five or more words."""
    marks: dict[int, np.ndarray] = {}
    seq = doc.tolist()
    for p in range(len(seq) - STRETCH + 1):
        if seq[p] < 0:
            continue
        for n, at in items.stretches.get(tuple(seq[p : p + STRETCH]), ()):
            if n in candidates:
                if n not in marks:
                    marks[n] = np.zeros(len(items.texts[n]), dtype=bool)
                marks[n][at : at + STRETCH] = True
    return {n: float(m.mean()) for n, m in marks.items()}


def lcs(a: list[int], b: list[int]) -> int:
    """Length of the longest common subsequence, by bit-parallel rows."""
    where: dict[int, int] = defaultdict(int)
    for i, x in enumerate(a):
        where[x] |= 1 << i
    full = (1 << len(a)) - 1
    row = full
    for y in b:
        u = row & where.get(y, 0)
        row = ((row + u) | (row - u)) & full
    return len(a) - bin(row).count("1")


@dataclass
class Space:
    """The latent space: each word's weighted latent vector, and the items as unit vectors."""

    words: np.ndarray
    items: np.ndarray

    def candidates(self, doc: np.ndarray) -> set[int]:
        """Items whose cosine with the text or one of its passages reaches the threshold. Passages are taken in blocks, so
        a text of any length takes the memory of one block."""
        if not (doc >= 0).any():
            return set()
        near = np.zeros(len(self.items), dtype=bool)
        whole = np.zeros((1, self.words.shape[1]))
        starts = np.arange(0, max(1, len(doc) - STEP), STEP)
        for k in range(0, len(starts), TOGETHER):
            s = starts[k : k + TOGETHER]
            part = doc[s[0] : s[-1] + PASSAGE]
            vectors = np.zeros((len(part) + 1, self.words.shape[1]))
            vectors[1:][part >= 0] = self.words[part[part >= 0]]
            sums = np.cumsum(vectors, axis=0)
            s = s - s[0]
            near |= self.nearest(sums[np.minimum(s + PASSAGE, len(part))] - sums[s])
            last = len(part) if k + TOGETHER >= len(starts) else TOGETHER * STEP
            whole += sums[last]
        near |= self.nearest(whole)
        return set(np.flatnonzero(near).tolist())

    def nearest(self, passages: np.ndarray) -> np.ndarray:
        """Which items reach the threshold with any of the passages."""
        norms = np.linalg.norm(passages, axis=1, keepdims=True)
        cosine = (passages / np.maximum(norms, 1e-12)) @ self.items.T
        return (cosine >= CANDIDATE).any(axis=0)


def held_out(items: DataFrame) -> Items:
    """The item table on the driver, its size checked."""
    rows = items.select("item_id", "text", "question").limit(MAX_ITEMS + 1).collect()
    if len(rows) > MAX_ITEMS:
        raise ValueError(f"more than {MAX_ITEMS} items: retrieve them in blocks")
    return Items.of(sorted(((r[0], r[1], r[2]) for r in rows), key=lambda r: r[0]))


def encoded(docs: DataFrame, items: Items) -> DataFrame:
    """(k, ids): every text (k, t) as the ids of its words in the items' vocabulary, -1 for others, four bytes each.

    Texts are tokenised once and the ids written to the shared checkpoint folder; the three steps that follow read them.
    Texts without any word of the items can hold none and are left out after being counted (a row without ids has their number).
    """
    from deedloom.session import cut_lineage

    shared = docs.sparkSession.sparkContext.broadcast(items)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        it, without = shared.value, 0
        for batch in batches:
            ids = [it.encode(t).astype(np.int32) for t in batch.column(1).to_pylist()]
            keep = np.array([bool((x >= 0).any()) for x in ids], dtype=bool)
            without += int((~keep).sum())
            data = [x.tobytes() for x, k in zip(ids, keep) if k]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).filter(pa.array(keep)), pa.array(data, pa.binary()), pa.array([0] * len(data), pa.int64())], names=["k", "ids", "without"]
            )
        yield pa.RecordBatch.from_arrays([pa.nulls(1, key), pa.array([b""], pa.binary()), pa.array([without], pa.int64())], names=["k", "ids", "without"])

    kind = dict(docs.dtypes)["k"]
    key = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[kind]
    return cut_lineage(docs.select("k", "t").mapInArrow(run, f"k {kind}, ids binary, without bigint"))


def document_frequencies(ids: DataFrame, items: Items) -> tuple[np.ndarray, int]:
    """In how many of all texts each word of the items stands, and the number of texts. One row per word and partition
    is shuffled, whatever the number of texts."""
    size = len(items.vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros(size, dtype=np.int64), 0
        for batch in batches:
            for raw, without in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                doc = np.frombuffer(raw, dtype=np.int32)
                df[np.unique(doc[doc >= 0])] += 1
                n += without + (len(doc) > 0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, size), pa.int64()), pa.array(np.r_[n, df], pa.int64())], names=["term", "n"])

    found = ids.mapInArrow(run, "term bigint, n bigint").groupBy("term").agg(F.sum("n").alias("n")).collect()
    df, n = np.zeros(size), 0
    for term, k in found:
        if term < 0:
            n = k
        else:
            df[term] = k
    return df, n


def latent_space(ids: DataFrame, items: Items, seed: int = 7) -> Space:
    """Randomised SVD of the TF-IDF passages of all texts, over the words of the items.

    Each partition multiplies its passages with a random matrix and back; the sums (words x vectors, bounded by the
    items' vocabulary) give the leading right singular vectors. The items' own passages are added with a weight, lest a
    large corpus drown them.
    """
    df, n = document_frequencies(ids, items)
    idf = np.log((n + 1.0) / (df + 1.0)) + 0.05
    v = len(idf)
    width = min(RANK + BEYOND, v)
    omega = np.random.default_rng(seed).standard_normal((v, width))
    shared = ids.sparkSession.sparkContext.broadcast((idf, omega))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight, random = shared.value
        y = np.zeros_like(random)
        n = 0
        for batch in batches:
            for raw in batch.column(1).to_pylist():
                doc = np.frombuffer(raw, dtype=np.int32)
                for s in range(0, len(doc), PASSAGE):
                    p = doc[s : s + PASSAGE]
                    n += add_passage(y, p[p >= 0], weight, random)
        columns = [pa.array(np.arange(-1, len(y)), pa.int64())]
        columns += [pa.array(np.r_[n if j == 0 else 0, y[:, j]], pa.float64()) for j in range(y.shape[1])]
        yield pa.RecordBatch.from_arrays(columns, names=["term", *[f"y{j}" for j in range(y.shape[1])]])

    schema = "term bigint" + "".join(f", y{j} double" for j in range(width))
    sums = ids.mapInArrow(run, schema).groupBy("term").agg(*[F.sum(f"y{j}").alias(f"y{j}") for j in range(width)]).collect()
    y, passages = np.zeros((v, width)), 0
    for row in sums:
        if row[0] < 0:
            passages = row[1]
        else:
            y[row[0]] = row[1:]
    own = np.zeros_like(y)
    for t in items.texts:
        for s in range(0, len(t), PASSAGE):
            add_passage(own, t[s : s + PASSAGE], idf, omega)
    y += own * max(1.0, passages / max(1, len(items.texts)))
    core = omega.T @ y
    values, vectors = np.linalg.eigh((core + core.T) / 2)
    keep = values > values.max(initial=0.0) * 1e-10
    half = y @ (vectors[:, keep] / np.sqrt(values[keep]))
    basis = np.linalg.svd(half, full_matrices=False)[0][:, :RANK]
    word_vectors = idf[:, None] * basis
    latent = np.array([word_vectors[t].sum(axis=0) for t in items.texts]).reshape(len(items.texts), -1)
    return Space(word_vectors, latent / np.maximum(np.linalg.norm(latent, axis=1, keepdims=True), 1e-12))


def add_passage(y: np.ndarray, p: np.ndarray, weight: np.ndarray, random: np.ndarray) -> int:
    """Add a passage's outer product, times the random matrix, to the sums; 1 if it had any known word."""
    if not len(p):
        return 0
    term, tf = np.unique(p, return_counts=True)
    a = tf * weight[term]
    a /= max(np.linalg.norm(a), 1e-12)
    y[term] += np.outer(a, a @ random[term])
    return 1


def leaks(docs: DataFrame, items: DataFrame, key: str, text: str, paraphrases: bool = False) -> DataFrame:
    """(key, item_id, coverage, lcs, answer): texts that hold an item, by latent retrieval and exact check.

    Texts are tokenised once and never shuffled: word frequencies, singular vectors, and retrieval with check follow from
    their word ids. With ``paraphrases`` also candidates that have most of the item only as a common subsequence, along
    with the words of its question; without, those two columns are null. An item whose question has none of the items'
    words is judged by the subsequence alone, and its answer is null. Null texts hold nothing; an item shorter than a
    stretch can't be found. Repeated keys give repeated rows.
    """
    known = held_out(items)
    kind = dict(docs.dtypes)[key]
    schema = f"k {kind}, item_id bigint, coverage double, lcs double, answer double"
    if not known.ids:
        return docs.sparkSession.createDataFrame([], schema).withColumnRenamed("k", key)
    ids = encoded(docs.select(F.col(key).alias("k"), F.col(text).alias("t")), known)
    space = latent_space(ids, known)
    shared = docs.sparkSession.sparkContext.broadcast((known, space))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        it, lsi = shared.value
        for b in batches:
            out = []
            for k, raw in zip(b.k, b.ids):
                doc = np.frombuffer(raw, dtype=np.int32)
                near = lsi.candidates(doc)
                if not near:
                    continue
                found = covered(it, doc, near)
                hits = {n: c for n, c in found.items() if c >= SHARE}
                out += [(k, it.ids[n], c, None, None) for n, c in hits.items()]
                if paraphrases:
                    seq, have = doc[doc >= 0].tolist(), set(doc.tolist())
                    for n in near - set(hits):
                        common = lcs(it.texts[n].tolist(), seq) / len(it.texts[n])
                        asked = it.questions[n].tolist()
                        answer = sum(x in have for x in asked) / len(asked) if asked else None
                        if common >= PARAPHRASE_LCS and (answer is None or answer >= PARAPHRASE_ANSWER):
                            out.append((k, it.ids[n], found.get(n, 0.0), common, answer))
            yield pd.DataFrame(out, columns=["k", "item_id", "coverage", "lcs", "answer"]).astype({"item_id": "int64", "coverage": float, "lcs": float, "answer": float})

    return ids.where("length(ids) > 0").select("k", "ids").mapInPandas(run, schema).withColumnRenamed("k", key)
