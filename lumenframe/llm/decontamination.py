"""Benchmark decontamination by a prefix-filtered set join of item windows with documents.

A window is ``window`` consecutive words of an item (an item of fewer words, but not none, is one
window). The join asks for containment 1, so of the words of a window, ordered by rarity in the
corpus, a prefix of one is necessary: a document that holds the window holds its rarest word. The
steps:

1. count, in one pass over all documents, how often the benchmark's words occur (their rarity), in a
   table of ``2**BITS`` places by a hash of the word; words that share a place share a count, which
   changes the order of words and no result, and bounds the table whatever the vocabulary;
2. index each distinct window under its rarest word, with that word's offset in it (the positional
   bound: the window can start only so many words before) and its number of words (the length
   bound: it must end inside the document);
3. join document positions with the prefix words, and compare all words of the stretch that the
   offset gives with the window, exactly.

The index is cut into blocks of benchmark items, each of about ``block_chars`` characters of item
text (100 MB of memory), which tasks build and write to the shared folder; no item passes through
the driver. A worker keeps ``keep`` blocks. If there are more, it takes ``buffer_words`` words of
documents at a time through all blocks, so that a block is loaded once for each such buffer.
Nothing that grows with the documents is shipped.

Null texts have no words. A very long text is a slice or buffer of its own. Items without an id or without words are ignored; rows with equal
``item_id`` are one item. Documents are taken row by row, so repeated rows each get their result,
and further columns of either table are ignored. An empty benchmark hits nothing.
"""

from __future__ import annotations

import pickle
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenframe.llm import storage

#: Bytes of UTF-8 text after lower-casing A-Z: 0-9, a-z and everything past ASCII are parts of words.
WORD_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
BITS = 20
HITS = "doc_id long, n_words long, spans array<struct<start:long,stop:long>>, items array<string>"


def words(text: str | None) -> list[bytes]:
    return text.encode().translate(WORD_BYTES).split() if text else []


def place_of(word: bytes) -> int:
    return zlib.crc32(word) & ((1 << BITS) - 1)


class WindowIndex:
    """Distinct windows of some items, grouped by (number of words, offset of the rarest word)."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int, rarity: np.ndarray):
        self.vocabulary: dict[bytes, int] = {}
        for _, found in items:
            for w in found:
                self.vocabulary.setdefault(w, len(self.vocabulary))
        often = [int(rarity[place_of(w)]) for w in self.vocabulary]
        owners: dict[tuple[int, ...], set[str]] = {}
        for item, found in items:
            ids = [self.vocabulary[w] for w in found]
            for a in range(max(1, len(ids) - window + 1)):
                owners.setdefault(tuple(ids[a : a + window]), set()).add(item)
        self.owners: list[list[str]] = []
        groups: dict[tuple[int, int], list] = {}
        for seq in sorted(owners):
            at = min(range(len(seq)), key=lambda k: (often[seq[k]], seq[k], k))
            groups.setdefault((len(seq), at), []).append((seq, len(self.owners)))
            self.owners.append(sorted(owners[seq]))
        #: (words, offset) -> which words are prefixes; sorted codes of the windows, the windows, their numbers
        self.groups = []
        rng = np.random.default_rng(7)
        for (n, at), rows in sorted(groups.items()):
            seqs = np.array([r[0] for r in rows], np.int64)
            weights = rng.integers(1, 1 << 62, n, dtype=np.int64) | 1
            codes = (seqs * weights).sum(axis=1)
            order = np.argsort(codes, kind="stable")
            prefix = np.zeros(len(self.vocabulary) + 1, bool)
            prefix[seqs[:, at]] = True
            self.groups.append((n, at, prefix, weights, codes[order], seqs[order], np.array([r[1] for r in rows])[order]))

    def find(self, ids: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, words, window) of every occurrence in ``ids``; ``left``/``right``: bounds of each position's text."""
        out = []
        any_prefix = np.zeros(len(self.vocabulary) + 1, bool)
        for g in self.groups:
            any_prefix |= g[2]
        near = np.flatnonzero(any_prefix[ids])
        for n, at, prefix, weights, codes, seqs, numbers in self.groups:
            start = near[prefix[ids[near]]] - at
            start = start[(start >= left[start + at]) & (start + n <= right[start + at])]
            if not len(start):
                continue
            code = np.zeros(len(start), np.int64)
            for k in range(n):
                code += ids[start + k] * weights[k]
            first, last = np.searchsorted(codes, code), np.searchsorted(codes, code, "right")
            while len(start := start[keep := first < last]):  # as long as windows of the same code are left
                first, last = first[keep], last[keep]
                same = (seqs[first] == ids[start[:, None] + np.arange(n)]).all(axis=1)
                out.append((start[same], np.full(int(same.sum()), n), numbers[first[same]]))
                first = first + 1
        if not out:
            return tuple(np.zeros(0, np.int64) for _ in range(3))
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def places(items: DataFrame) -> np.ndarray:
    """Which places the words of ``items`` (item_text) have; at most ``2**BITS`` rows reach the driver."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            known = {place_of(w) for t in batch.column(0).to_pylist() for w in words(t)}
            yield pa.RecordBatch.from_arrays([pa.array(sorted(known), pa.int64())], names=["place"])

    found = items.select("item_text").mapInArrow(work, "place long").distinct().toArrow()
    out = np.zeros(1 << BITS, bool)
    out[found.column("place").to_numpy()] = True
    return out


def rarity(docs: DataFrame, wanted: np.ndarray) -> np.ndarray:
    """How often words of the ``wanted`` places occur in all of ``docs``, by place; tasks send a row for each place they met."""
    shipped = docs.sparkSession.sparkContext.broadcast(wanted)  # 1 MB

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, wanted = np.zeros(1 << BITS, np.int64), shipped.value
        for batch in batches:
            for part in storage.by_size(batch, "text"):
                counts = Counter(w for t in part.column("text").to_pylist() for w in words(t))
                np.add.at(total, [place_of(w) for w in counts], list(counts.values()))
        some = np.flatnonzero(total * wanted)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["place", "n"])

    sums = storage.in_small_batches(docs.select("text")).mapInArrow(work, "place long, n long").groupBy("place").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(1 << BITS, np.int64)
    out[sums.column("place").to_numpy()] = sums.column("n").to_numpy()
    return out


_loaded: dict[str, WindowIndex] = {}


def _index(uri: str, keep: int) -> WindowIndex:
    """An index block from the shared folder; a worker keeps the last few."""
    if uri not in _loaded:
        while len(_loaded) >= keep:
            _loaded.pop(next(iter(_loaded)))
        store, path = storage.open_store(uri)
        with store.open_input_stream(path, compression=None) as source:
            _loaded[uri] = pickle.loads(source.read())
    return _loaded[uri]


def _results(batch: pa.RecordBatch, blocks: list[str], keep: int) -> pa.RecordBatch:
    found = [words(t) for t in batch.column("text").to_pylist()]
    n = np.array([len(f) for f in found], np.int64)
    every = [w for f in found for w in f]
    ends = np.cumsum(n)
    left, right = np.repeat(ends - n, n), np.repeat(ends, n)
    change = np.zeros(len(every) + 1, np.int64)
    items: dict[int, set[str]] = {}
    for uri in blocks:
        index = _index(uri, keep)
        unknown, get = len(index.vocabulary), index.vocabulary.get
        ids = np.fromiter((get(w, unknown) for w in every), np.int64, len(every))
        start, size, window = index.find(ids, left, right)
        np.add.at(change, start, 1)
        np.add.at(change, start + size, -1)
        pairs = np.unique(np.stack([np.searchsorted(ends, start, "right"), window]), axis=1) if len(start) else np.zeros((2, 0), np.int64)
        for row, w in zip(*pairs.tolist(), strict=True):
            items.setdefault(row, set()).update(index.owners[w])
    hit = np.cumsum(change)[:-1] > 0
    edge = np.zeros(len(hit) + 1, bool)
    if len(hit):
        edge[0], edge[-1] = hit[0], hit[-1]
        edge[1:-1] = (hit[1:] != hit[:-1]) | (hit[1:] & (left[1:] != left[:-1]))
    spans: list[list] = [[] for _ in found]
    marks = np.flatnonzero(edge).tolist()
    for a, b in zip(marks, marks[1:], strict=False):
        if hit[a]:
            row = int(np.searchsorted(ends, a, "right"))
            first = int(ends[row] - n[row])
            spans[row].append({"start": a - first, "stop": b - first})
    kind = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
    return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n), pa.array(spans, kind), pa.array([sorted(items.get(k, ())) for k in range(len(found))], pa.list_(pa.string()))], names=["doc_id", "n_words", "spans", "items"])


def _write_index(docs: DataFrame, benchmark: DataFrame, window: int, block_chars: int) -> list[str]:
    """The blocks' files. Items are dealt to blocks by a hash; a task gathers and writes one block."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item"), F.col("text").alias("item_text")).where("item is not null and item_text is not null")
    total = items.agg(F.sum(F.length("item_text"))).first()[0] or 0
    n = -(-total // block_chars)
    if not n:
        return []
    folder, often = storage.new_folder(docs.sparkSession, "windows"), rarity(docs, places(items))
    shipped = docs.sparkSession.sparkContext.broadcast(often)  # 8 MB

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: list[tuple[str, list[bytes]]] = []
        for batch in batches:
            own += [(i, w) for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) if (w := words(t))]
        if own:
            uri = f"{folder}/{TaskContext.get().partitionId()}.pickle"
            storage.put(uri, pickle.dumps(WindowIndex(sorted(own), window, shipped.value)))
            yield pa.RecordBatch.from_arrays([pa.array([uri])], names=["path"])

    made = items.repartition(n, "item").mapInArrow(build, "path string").collect()
    return sorted(r["path"] for r in made)


def _parts(batches: Iterator[pa.RecordBatch], blocks: list[str], keep: int, buffer_words: int) -> Iterator[pa.RecordBatch]:
    """Slices of a task's rows: small ones while the worker holds all blocks, else as large as ``buffer_words`` allows."""
    if len(blocks) <= keep:
        for batch in batches:
            yield from storage.by_size(batch, "text")
        return
    held, size = [], 0
    for batch in batches:
        for part in storage.by_size(batch, "text"):
            held.append(part)
            size += pc.sum(pc.binary_length(part.column("text"))).as_py() or 0
            if size >= 6 * buffer_words:
                yield pa.concat_batches(held)
                held, size = [], 0
    if held:
        yield pa.concat_batches(held)


def hits(docs: DataFrame, benchmark: DataFrame, window: int = 10, block_chars: int = 8_000_000, keep: int = 2, buffer_words: int = 2_000_000) -> DataFrame:
    """For each document row: doc_id, n_words, the spans of words that windows cover, and the items that occur.

    ``spans`` are disjoint word ranges (start included, stop not) in order; ``items`` are ids as
    strings, sorted.
    """
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    blocks = _write_index(source, benchmark, window, block_chars)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _parts(batches, blocks, keep, buffer_words):
            yield _results(part, blocks, keep)

    return storage.in_small_batches(source).mapInArrow(work, HITS)


def digest(found: DataFrame) -> DataFrame:
    """The contract's columns from ``hits``."""
    covered = F.aggregate("spans", F.lit(0).cast("long"), lambda s, x: s + x["stop"] - x["start"])
    return found.select("doc_id", "n_words", covered.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (covered > 0).alias("contaminated"))


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = 10, block_chars: int = 8_000_000, keep: int = 2, buffer_words: int = 2_000_000) -> DataFrame:
    """The rows of ``docs`` in which no window occurs, all columns kept; rows don't leave their partition."""
    blocks = _write_index(docs.select("doc_id", "text"), benchmark, window, block_chars)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _parts(batches, blocks, keep, buffer_words):
            clean = [not s for s in _results(part, blocks, keep).column("spans").to_pylist()]
            yield part.filter(pa.array(clean, pa.bool_()))

    return storage.with_safe_names(docs, ["doc_id", "text"], lambda d: storage.in_small_batches(d).mapInArrow(work, d.schema))


#: The same as ``digest(hits(documents, benchmark))`` by comparing all windows as texts; one row a doc_id and item_id.
SQL = r"""
WITH words AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), items AS (
    SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL
), starts AS (
    SELECT item, w, least(len(w), 10) AS n, unnest(generate_series(1, greatest(1, len(w) - 9))) AS a FROM items WHERE len(w) > 0
), windows AS (
    SELECT DISTINCT item, n, array_to_string(w[a : a + n - 1], ' ') AS s FROM starts
), stretches AS (
    SELECT doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS a FROM words, (SELECT DISTINCT n FROM windows) WHERE len(w) >= n
), found AS (
    SELECT doc_id, a, t.n, item FROM (SELECT doc_id, a, n, array_to_string(w[a : a + n - 1], ' ') AS s FROM stretches) t JOIN windows USING (n, s)
), covered AS (
    SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(generate_series(a, a + n - 1)) AS p FROM found) GROUP BY doc_id
), named AS (
    SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS ids FROM found GROUP BY doc_id
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM words LEFT JOIN covered USING (doc_id) LEFT JOIN named USING (doc_id)
"""
