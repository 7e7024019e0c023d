"""Encoding of a corpus by a public byte-level BPE vocabulary (problem 8): batched merge rounds in numpy."""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: how the vocabulary's makers cut a text into words.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Words whose ids a worker keeps; the memo is emptied when full.
MEMO = 400_000


class Merger:
    """Ranks of a vocabulary as sorted arrays: ids of single bytes, and for every mergeable pair its id, which is also
    its rank."""

    def __init__(self, raw: bytes):
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, raw.splitlines()) if a}
        self.bytes = np.array([ranks[bytes([i])] for i in range(256)], dtype=np.int64)
        keys, ids = [], []
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                a, b = ranks.get(token[:cut]), ranks.get(token[cut:])
                if a is not None and b is not None:
                    keys.append(a << 32 | b)
                    ids.append(rank)
        order = np.argsort(np.array(keys, dtype=np.int64), kind="stable")
        self.keys, self.ids = np.array(keys, dtype=np.int64)[order], np.array(ids, dtype=np.int64)[order]
        self.memo: dict[str, np.ndarray] = {}

    def pair_rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of each pair by binary search over the sorted keys; a huge number for pairs that don't merge."""
        key = a << 32 | b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ids[at], np.int64(1) << 60)

    def encode_words(self, words: list[str]) -> list[np.ndarray]:
        """The ids of each word. All words lie in one flat array; a round merges, in every word, the occurrences of its
        lowest-ranked pair from the left; words without a mergeable pair are finished."""
        data = [w.encode("utf-8", "replace") for w in words]
        sizes = np.fromiter(map(len, data), dtype=np.int64, count=len(data))
        symbols = self.bytes[np.frombuffer(b"".join(data), dtype=np.uint8)]
        owner = np.repeat(np.arange(len(data)), sizes)
        out: list[np.ndarray | None] = [None] * len(data)
        for i in np.flatnonzero(sizes == 0):
            out[i] = symbols[:0]
        none = np.int64(1) << 60
        while len(symbols):
            rank = np.full(len(symbols), none)
            if len(symbols) > 1:
                same = owner[:-1] == owner[1:]
                rank[:-1][same] = self.pair_rank(symbols[:-1][same], symbols[1:][same])
            starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            lengths = np.diff(np.r_[starts, len(symbols)])
            lowest = np.minimum.reduceat(rank, starts)
            finished = lowest == none
            if finished.any():
                for s, n in zip(starts[finished], lengths[finished]):
                    out[owner[s]] = symbols[s : s + n]
                keep = np.repeat(~finished, lengths)
                symbols, owner, rank = symbols[keep], owner[keep], rank[keep]
                lowest, lengths = lowest[~finished], lengths[~finished]
                if not len(symbols):
                    break
            hit = rank == np.repeat(lowest, lengths)
            # occurrences that overlap, as in a run of one letter, are taken from the left: every second of a chain
            at = np.flatnonzero(hit)
            chain = np.r_[True, np.diff(at) != 1]
            first = np.maximum.accumulate(np.where(chain, np.arange(len(at)), 0))
            at = at[(np.arange(len(at)) - first) % 2 == 0]
            symbols = symbols.copy()
            symbols[at] = rank[at]
            keep = np.ones(len(symbols), dtype=bool)
            keep[at + 1] = False
            symbols, owner = symbols[keep], owner[keep]
        return out

    def encode(self, texts: list[str | None], split) -> tuple[np.ndarray, np.ndarray]:
        """(offsets, ids) of a batch of texts; null and empty texts have no ids."""
        index: dict[str, int] = {}
        flat: list[int] = []
        counts = np.zeros(len(texts), dtype=np.int64)
        for i, t in enumerate(texts):
            if t:
                found = split(t)
                counts[i] = len(found)
                flat += [index.setdefault(w, len(index)) for w in found]
        words = list(index)
        new = [w for w in words if w not in self.memo]
        fresh = dict(zip(new, self.encode_words(new))) if new else {}
        pieces = [self.memo[w] if w in self.memo else fresh[w] for w in words]
        if len(self.memo) + len(new) > MEMO:
            self.memo.clear()
        if len(new) <= MEMO:
            self.memo.update((w, a.copy()) for w, a in fresh.items() if len(w) <= 64)
        if not flat:
            return np.zeros(len(texts) + 1, dtype=np.int32), np.zeros(0, dtype=np.int32)
        sizes = np.array([len(p) for p in pieces], dtype=np.int64)
        used = np.array(flat, dtype=np.int64)
        starts = np.r_[0, np.cumsum(sizes)]
        pool = np.concatenate(pieces).astype(np.int32)
        n = sizes[used]
        ends = np.cumsum(n)
        ids = pool[np.arange(ends[-1]) - np.repeat(ends - n - starts[used], n)]
        per_word = np.r_[0, ends]
        return per_word[np.r_[0, np.cumsum(counts)]].astype(np.int32), ids


_MERGERS: dict[int, Merger] = {}


def encode(df: DataFrame, key: str, text: str, vocabulary: str = VOCABULARY, rows: int = 2_000) -> DataFrame:
    """(key, ids): the ids of every text without special tokens, [] for empty and null texts. No shuffle.

    ``vocabulary`` is a rank file that the driver reads; its bytes (under a megabyte) are broadcast, so workers need no
    such path. Strings of special tokens in a text are ordinary text. Repeated keys give repeated rows.
    """
    with open(vocabulary, "rb") as f:
        shared = df.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw = shared.value
        merger = _MERGERS.get(hash(raw)) or _MERGERS.setdefault(hash(raw), Merger(raw))
        split = regex.compile(PATTERN).findall
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                part = batch.slice(at, rows)
                offsets, ids = merger.encode(part.column(1).to_pylist(), split)
                lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column(0), lists], names=["k", "ids"])

    kind = dict(df.dtypes)[key]
    out = df.select(F.col(key).alias("k"), F.col(text).alias("t")).mapInArrow(run, f"k {kind}, ids array<int>")
    return out.withColumnRenamed("k", key)
