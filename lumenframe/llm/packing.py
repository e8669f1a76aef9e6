"""Packing of documents into sequences of ``WINDOW`` tokens by lexical retrieval.

Documents are dealt over partitions by a hash of the row; each partition, ordered by doc_id, is cut into shards
of about ``shard_tokens`` tokens, and each shard gets a BM25 inverted index over its token ids. Whole
windows of long documents are sequences of their own. What is left of each document waits in the
index: the longest waiting piece seeds a window, and the waiting pieces that score best for it fill
the window one after another, in order of score. The last is cut where the window ends, and its rest waits on;
pieces that share no term with the seed come last, by doc_id. What can't fill a window any more
passes into the next shard, so only the last sequence of a partition has padding; partitions have
``PART_BYTES`` of text or more, some 200 sequences, so that is a fraction of a percent.

A task holds one shard at a time, of ``shard_tokens`` tokens or one document, whichever is more. Null
texts are empty documents (the end id alone). Rows that repeat a doc_id are documents of their own, and
however many they are, they are dealt over tasks. A null doc_id is kept. Further columns are ignored. An
empty table has no pieces.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenframe.llm import storage, tokens

WINDOW = 2048
K1, B = 1.2, 0.75
#: Text of a partition, at least, where the session asks for more partitions than that leaves: its last sequence pads half a window.
PART_BYTES = 2 << 20
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids array<int>"


class Index:
    """BM25 over the token ids of some pieces."""

    def __init__(self, pieces: list[np.ndarray]):
        found = [np.unique(p, return_counts=True) for p in pieces]
        self.terms, self.counts = [f[0] for f in found], [f[1] for f in found]
        every = np.concatenate(self.terms)
        self.known, term = np.unique(every, return_inverse=True)
        self.piece = np.repeat(np.arange(len(pieces)), [len(t) for t in self.terms])
        times = np.concatenate(self.counts).astype(np.float64)
        size = np.array([len(p) for p in pieces], np.float64)
        order = np.argsort(term, kind="stable")
        self.posting = self.piece[order]
        df = np.bincount(term, minlength=len(self.known))
        self.first = np.concatenate([[0], np.cumsum(df)])
        idf = np.log1p((len(pieces) - df + 0.5) / (df + 0.5))
        weight = idf[term] * times * (K1 + 1) / (times + K1 * (1 - B + B * size[self.piece] / size.mean()))
        self.weight = weight[order]
        self.numbers = np.split(term, np.cumsum([len(t) for t in self.terms])[:-1])
        self.n = len(pieces)

    def scores(self, piece: int) -> np.ndarray:
        """Every piece's score for the terms of one."""
        terms = self.numbers[piece]
        a, n = self.first[terms], self.first[terms + 1] - self.first[terms]
        at = np.repeat(a - np.cumsum(n) + n, n) + np.arange(int(n.sum()))
        return np.bincount(self.posting[at], self.weight[at], self.n)


def _best(pieces: np.ndarray, score: np.ndarray, n: int) -> np.ndarray:
    """The first ``n`` of some ascending pieces by falling score, ties in order; no more fit, as each has a token."""
    if len(pieces) > n:
        least = -np.partition(-score, n - 1)[n - 1]
        above, equal = np.flatnonzero(score > least), np.flatnonzero(score == least)
        some = np.concatenate([above, equal[: n - len(above)]])
        pieces, score = pieces[some], score[some]
    return pieces[np.lexsort((pieces, -score))]


class _Packer:
    """The sequences of one partition, shard after shard."""

    def __init__(self, first_id: int):
        self.sequence, self.rows = first_id, []
        self.waiting: list[tuple] = []  # (doc_id, start, ids, doc_tokens)

    def _put(self, pieces: list[tuple]) -> None:
        offset = 0
        for doc, start, ids, total in pieces:
            self.rows.append((doc, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), total, self.sequence, offset, ids))
            offset += len(ids)
        self.sequence += 1

    def add(self, doc, ids: np.ndarray) -> None:
        whole = len(ids) - len(ids) % WINDOW
        for a in range(0, whole, WINDOW):
            self._put([(doc, a, ids[a : a + WINDOW], len(ids))])
        if whole < len(ids):
            self.waiting.append((doc, whole, ids[whole:], len(ids)))

    def pack(self, last: bool) -> None:
        """Fill windows from what waits; at the end of the partition the last may stay short."""
        if not self.waiting:
            return
        index = Index([w[2] for w in self.waiting])
        left = np.array([len(w[2]) for w in self.waiting])
        rest, total = list(self.waiting), int(left.sum())
        order = np.argsort(-left, kind="stable")
        seed_at = 0
        while total >= WINDOW or last and total:
            while not left[order[seed_at]]:
                seed_at += 1
            seed, room, chosen = int(order[seed_at]), WINDOW, []
            score = index.scores(seed)
            open_ = np.flatnonzero(left)
            open_ = open_[open_ != seed]
            ranked = _best(open_, score[open_], WINDOW - int(left[seed]))
            for k in [seed, *ranked.tolist()]:
                doc, start, ids, n = rest[k]
                take = min(room, len(ids))
                chosen.append((doc, start, ids[:take], n))
                rest[k] = (doc, start + take, ids[take:], n)
                left[k] -= take
                room -= take
                total -= take
                if not room:
                    break
            self._put(chosen)
        self.waiting = [rest[k] for k in np.flatnonzero(left)]

    def flush(self) -> pa.RecordBatch:
        rows, self.rows = self.rows, []
        columns = list(zip(*rows, strict=True)) or [()] * 8
        flat = np.concatenate(columns[7]) if rows else np.zeros(0, np.int32)
        bounds = np.concatenate([[0], np.cumsum(columns[2])]).astype(np.int32)
        ids = pa.ListArray.from_arrays(pa.array(bounds), pa.array(flat.astype(np.int32)))
        return pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in columns[:7]), ids], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"])


def pack(docs: DataFrame, tokenizer_path: str | None = None, shard_tokens: int = 1_000_000) -> DataFrame:
    """A row per piece: its document, where it starts there, its ids, its sequence and offset in it."""
    path = tokenizer_path or tokens.default_path()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, held = tokens.tokenizer(path), 0
        packer = _Packer(TaskContext.get().partitionId() << 40)
        for batch in batches:
            for part in storage.by_size(batch, "text", 1_000_000):
                ids, n = encoder.encode(part.column("text").to_pylist())
                for doc, some in zip(part.column("doc_id").to_pylist(), np.split(ids, np.cumsum(n)[:-1]), strict=True):
                    packer.add(doc, some)
                held += len(ids)
                if held >= shard_tokens:
                    packer.pack(False)
                    held = 0
                yield packer.flush()
        packer.pack(True)
        yield packer.flush()

    dealt = storage.numbered(docs).repartition(storage.parts_for(docs, least_bytes=PART_BYTES), F.xxhash64("doc_id", "row_no"))
    ordered = dealt.sortWithinPartitions("doc_id", "text_hash", "row_no").select("doc_id", "text")
    return storage.in_small_batches(ordered).mapInArrow(work, PIECES)


def digest(pieces: DataFrame) -> DataFrame:
    return pieces.drop("ids")
