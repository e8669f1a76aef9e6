"""Byte strings of ``LENGTH`` bytes that stand in several documents, found by threshold-bounded interval expansion.

A byte goes if a string of ``LENGTH`` bytes covers it that also starts in a document of a smaller
doc_id. Strings that are equal must meet in one task, so each start of a string (a window) is dealt by
the least hash of the ``GRAM``-byte grams in it; windows in a row that share it are one piece of text.

1. Texts are stored once, in chunks of some MB, bucketed by chunk.
2. Each chunk sends 32 bits of the least hashes of its pieces, once each, to the tasks that count them
   and get back a bit for each: whether the hash is found in another document too. Equal bits of
   different hashes only cost work.
3. Pieces with such hashes, alike ones of a chunk once, go to tasks by hash. There, different pieces are
   joined into some hundred kB of text, of which the Burrows-Wheeler transform is made, and a breadth
   first expansion of its intervals (``bwt``) derives common prefixes by increasing length up to
   ``LENGTH``. Suffixes that share that much are one class, whose smallest doc_id is what each window of
   each piece is answered.
4. Chunks mark the windows whose answer is smaller than their own doc_id.

Copies of a document cost one piece a chunk, not a pair. A hash that more than ``common`` chunks hold
has its windows dealt one by one, by a hash of all their bytes, so a frequent gram in ever different
surroundings isn't one task's; what stays in one task is at most a row a chunk for one string. A chunk is
one text or ``CHUNK`` bytes, whichever is more, with some 20 bytes of memory a byte.

Null texts are empty. A null doc_id comes after all others. Rows of equal doc_id don't count as earlier
than each other. Each row has a result of its own; further columns are ignored; an empty table gives no
rows.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenframe.llm import bwt, storage

LENGTH, GRAM = 50, 24
#: Grams of a window, and the most windows of a piece.
GRAMS, WINDOWS = LENGTH - GRAM + 1, 32
CHUNK, SLICE, GROUP = 4 << 20, 1 << 18, 1 << 20
LAST = 9223372036854775807
CHUNKS = "chunk long, ids array<long>, sizes array<long>, bytes binary"
SPANS = "array<struct<start: long, length: long>>"
#: Odd factors of the hashes, fixed.
FACTORS = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * FACTORS[3]
    return x ^ (x >> np.uint64(29))


def _words(x: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as a number."""
    return np.ndarray(max(0, len(x) - 7), "<u8", buffer=x, strides=(1,))


def _least(x: np.ndarray, n: int) -> np.ndarray:
    """The least of each ``n`` values in a row."""
    width = 1
    while 2 * width <= n:
        x = np.minimum(x[:-width], x[width:])
        width *= 2
    return x if width == n else np.minimum(x[: width - n], x[n - width :])


def pieces(text: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First window, windows and hash of each piece of some texts that end at ``ends``, in order."""
    out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64))]
    edges = np.unique(np.concatenate([[0], ends, ends - LENGTH + 1]).clip(0))
    for a in range(0, len(text) - LENGTH + 1, SLICE):
        part = np.ascontiguousarray(text[a : a + SLICE + LENGTH - 1])
        word = _words(part).astype(np.uint64)
        y = word[8:-8] * FACTORS[1]
        gram = word[:-16] * FACTORS[0] + (y ^ (y >> np.uint64(31)))
        gram ^= gram >> np.uint64(32)
        gram = _mixed(gram * FACTORS[2] + word[16:])
        least = _least(gram, GRAMS)
        opens = np.ones(len(least), bool)
        opens[1:] = least[1:] != least[:-1]
        opens[edges[np.searchsorted(edges, a) : np.searchsorted(edges, a + len(least))] - a] = True
        first = np.flatnonzero(opens)
        n = np.diff(np.append(first, len(least)))
        start = first + a
        whole = ends[np.searchsorted(ends, start, "right").clip(max=len(ends) - 1)] - start >= LENGTH
        first, start, n = first[whole], start[whole], n[whole]
        cut = -(-n // WINDOWS)
        which = np.repeat(np.arange(len(n)), cut)
        at = (np.arange(len(which)) - np.repeat(np.cumsum(cut) - cut, cut)) * WINDOWS
        out.append((start[which] + at, np.minimum(n[which] - at, WINDOWS), _mixed(least[first][which] * FACTORS[0])))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def _bytes_at(text: np.ndarray, start: np.ndarray, size: np.ndarray) -> pa.Array:
    """Stretches of a text as binary values."""
    ends = np.cumsum(size)
    flat = text[np.repeat(start - ends + size, size) + np.arange(int(size.sum()))]
    return binary(flat, ends)


def binary(flat: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Binary values that stand one after another in ``flat`` and end at ``ends``."""
    return pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(np.concatenate([[0], ends]).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(flat))])


def _flat(values: pa.Array, kind: str) -> np.ndarray:
    """All binary values, one after another, as numbers."""
    whole = values.combine_chunks() if isinstance(values, pa.ChunkedArray) else values
    whole = pa.concat_arrays(whole.chunks) if isinstance(whole, pa.ChunkedArray) else whole
    offsets = np.frombuffer(whole.buffers()[1], np.int32)[whole.offset : whole.offset + len(whole) + 1]
    data = np.frombuffer(whole.buffers()[2] or b"", np.uint8)
    return data[offsets[0] : offsets[-1]].view(kind) if len(whole) else np.zeros(0, kind)


class Chunk:
    """A row of the chunks' table."""

    def __init__(self, row: pa.Table):
        self.number = row.column("chunk")[0].as_py()
        ids = row.column("ids").combine_chunks().flatten()
        self.null = ids.is_null().to_numpy(zero_copy_only=False)
        self.ids = pc.fill_null(ids, LAST).to_numpy()
        self.sizes = row.column("sizes").combine_chunks().flatten().to_numpy()
        self.ends = np.cumsum(self.sizes)
        self.text = np.frombuffer(row.column("bytes")[0].as_buffer(), np.uint8)
        self.full = self.ends[self.sizes > 0]  # texts without bytes hold no place
        self.row = np.flatnonzero(self.sizes > 0)

    def doc(self, place: np.ndarray) -> np.ndarray:
        """The number, in this chunk, of the row that holds each place."""
        return self.row[np.searchsorted(self.full, place, "right")] if len(self.row) else place

    def hashes(self, buckets: int) -> tuple[tuple[np.ndarray, ...], np.ndarray, np.ndarray, np.ndarray]:
        """The pieces; their different bucketed hashes, in order; which of them each piece has; and which stand under two doc_ids."""
        found = pieces(self.text, self.full)
        key = (((found[2] >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32) << np.uint64(32)) | (found[2] & np.uint64(0xFFFFFFFF))
        known, which = np.unique(key, return_inverse=True)
        ids = self.ids[self.doc(found[0])]
        low, high = np.full(len(known), LAST), np.full(len(known), -LAST - 1)
        np.minimum.at(low, which, ids)
        np.maximum.at(high, which, ids)
        return found, known, which, low != high


def chunked(docs: DataFrame, parts: int) -> DataFrame:
    """The texts as a stored table of ``CHUNKS``, bucketed by chunk."""
    spark = docs.sparkSession

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held, size = TaskContext.get().partitionId() << 32, [], 0

        def row() -> pa.RecordBatch:
            nonlocal number
            number += 1
            ids = pa.concat_arrays([h[0] for h in held])
            sizes = np.concatenate([h[1] for h in held])
            whole = b"".join(x for h in held for x in h[2])
            return pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), *(pa.ListArray.from_arrays([0, len(sizes)], x) for x in (ids, pa.array(sizes, pa.int64()))), pa.array([whole], pa.binary())], names=["chunk", "ids", "sizes", "bytes"])

        for batch in batches:
            for part in storage.by_size(batch, "text"):
                texts = [t or b"" for t in part.column("text").cast(pa.binary()).to_pylist()]
                held.append((part.column("doc_id"), np.array([len(t) for t in texts], np.int64), texts))
                size += sum(map(len, texts))
                if size >= CHUNK:
                    yield row()
                    held, size = [], 0
        if held:
            yield row()

    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    name = f"chunks_{uuid.uuid4().hex}"
    rows = storage.in_small_batches(plain).mapInArrow(work, CHUNKS)
    rows.write.bucketBy(parts, "chunk").option("path", storage.new_folder(spark, "chunks")).option("compression", "zstd").saveAsTable(name)
    return spark.table(name)


def repeated_hashes(chunks: DataFrame, buckets: int, common: int) -> DataFrame:
    """(chunk, bucket, repeated, common): a bit for each hash of the chunk in the bucket, in order."""

    def sent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                chunk = Chunk(pa.Table.from_batches([batch.slice(k, 1)]))
                _, known, _, twice = chunk.hashes(buckets)
                bounds = np.searchsorted(known, np.arange(buckets + 1, dtype=np.uint64) << np.uint64(32))
                used = np.flatnonzero(np.diff(bounds))
                low = (known & np.uint64(0xFFFFFFFF)).astype(np.uint32)
                rows = [(low[bounds[b] : bounds[b + 1]].tobytes(), np.packbits(twice[bounds[b] : bounds[b + 1]]).tobytes()) for b in used]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(used), chunk.number)), pa.array(used.astype(np.int64)), *(pa.array([r[i] for r in rows], pa.binary()) for i in (0, 1))], names=["chunk", "bucket", "hashes", "twice"])
                storage.give_back()

    def counted(rows: pa.Table) -> pa.Table:
        sizes = pc.binary_length(rows.column("hashes")).to_numpy() // 4
        every = _flat(rows.column("hashes"), "<u4")
        twice = np.concatenate([np.unpackbits(np.frombuffer(t.as_buffer(), np.uint8), count=n) for t, n in zip(rows.column("twice").combine_chunks(), sizes.tolist(), strict=True)])
        order = np.argsort(every)
        value = every[order]
        first = np.flatnonzero(np.concatenate([[True], value[1:] != value[:-1]]))
        times = np.diff(np.append(first, len(value)))
        several = (times > 1) | (np.add.reduceat(twice[order], first) > 0)
        bits = np.empty((2, len(every)), bool)
        bits[:, order] = np.repeat(np.stack([several, times > common]), times, axis=1)
        cuts = np.cumsum(sizes)[:-1]
        return pa.table({"chunk": rows.column("chunk"), "bucket": rows.column("bucket"), "n": pa.array(sizes.astype(np.int64)), **{name: pa.array([np.packbits(p).tobytes() if p.any() else b"" for p in np.split(b, cuts)], pa.binary()) for name, b in zip(("repeated", "common"), bits, strict=True)}, "found": pa.array([int(p.sum()) for p in np.split(bits[0], cuts)], pa.int64())})

    rows = chunks.mapInArrow(sent, "chunk long, bucket long, hashes binary, twice binary")
    return storage.written(rows.groupBy("bucket").applyInArrow(counted, "chunk long, bucket long, n long, repeated binary, common binary, found long"))


def _one_by_one(text: np.ndarray, start: np.ndarray, n: np.ndarray, key: np.ndarray, common: np.ndarray) -> tuple[np.ndarray, ...]:
    """The pieces, those of common hashes cut into windows that have hashes of their own."""
    if not common.any():
        return start, n, key
    where, many = start[common], n[common]
    at = np.repeat(where - np.cumsum(many) + many, many) + np.arange(int(many.sum()))
    words, code = _words(text), np.zeros(len(at), np.uint64)
    for k in (*range(0, LENGTH - 8, 8), LENGTH - 8):
        code = _mixed(code * FACTORS[1] + words[at + k])
    return np.concatenate([start[~common], at]), np.concatenate([n[~common], np.ones(len(at), np.int64)]), np.concatenate([key[~common], code])


def repeated_pieces(chunks: DataFrame, hashes: DataFrame, buckets: int) -> DataFrame:
    """(key, piece, chunk, places, low, high): a row per chunk and different piece that has a repeated hash; where it stands, and its smallest and largest doc_id there."""

    def bits(rows: pa.Table, column: str) -> np.ndarray:
        out = [np.unpackbits(np.frombuffer(b, np.uint8), count=n) if b else np.zeros(n, np.uint8) for b, n in zip(rows.column(column).to_pylist(), rows.column("n").to_pylist(), strict=True)]
        return np.concatenate(out) > 0

    schema = pa.schema([("key", pa.int64()), ("piece", pa.binary()), ("chunk", pa.int64()), ("places", pa.binary()), ("low", pa.int64()), ("high", pa.int64())])

    def work(rows: pa.Table, replies: pa.Table) -> pa.Table:
        if not rows.num_rows or not replies.num_rows:
            return schema.empty_table()
        chunk, replies = Chunk(rows), replies.sort_by("bucket")
        (start, n, key), _, which, _ = chunk.hashes(buckets)
        again = bits(replies, "repeated")[which]
        start, n, key = _one_by_one(chunk.text, start[again], n[again], key[again], bits(replies, "common")[which[again]])
        out = []
        for a in range(0, len(start), 500_000):
            s, m, k = start[a : a + 500_000], n[a : a + 500_000], key[a : a + 500_000]
            coded = _bytes_at(chunk.text, s, m + LENGTH - 1).dictionary_encode()
            code = coded.indices.to_numpy()
            order = np.argsort(code, kind="stable")
            first = np.flatnonzero(np.diff(code[order], prepend=-1))
            ids = chunk.ids[chunk.doc(s)][order]
            places = binary(s[order].astype("<i4").view(np.uint8), np.append(first[1:], len(order)) * 4)
            out.append(pa.Table.from_arrays([pa.array(k[order[first]].view(np.int64)), coded.dictionary, pa.array(np.full(len(first), chunk.number)), places, pa.array(np.minimum.reduceat(ids, first)), pa.array(np.maximum.reduceat(ids, first))], schema=schema))
        storage.give_back()
        return pa.concat_tables(out) if out else schema.empty_table()

    return chunks.groupBy("chunk").cogroup(hashes.groupBy("chunk")).applyInArrow(work, "key long, piece binary, chunk long, places binary, low long, high long")


def earliest(rows: pa.Table) -> pa.Table:
    """(chunk, n, places, docs): for the n windows of each piece that stands later somewhere, the smallest doc_id that holds each, or one number where all are the same."""
    coded = pa.concat_arrays(rows.column("piece").chunks).dictionary_encode()
    code = coded.indices.to_numpy()
    known = coded.dictionary
    low = np.full(len(known), LAST)
    np.minimum.at(low, code, rows.column("low").to_numpy())
    size = pc.binary_length(known).to_numpy().astype(np.int64)
    ends = np.cumsum(size)
    offset, first = bwt.classes(_flat(known, "u1").tobytes(), ends, LENGTH)
    real = offset >= 0
    docs = np.where(real, low[np.searchsorted(ends, offset, "right").clip(max=len(low) - 1)], LAST)
    smallest = np.repeat(np.minimum.reduceat(docs, first), np.diff(np.append(first, len(docs))))
    at = np.empty(int(ends[-1]), np.int64)
    at[offset[real]] = smallest[real]
    n = size - LENGTH + 1
    begin = ends - size
    window = np.repeat(begin - np.cumsum(n) + n, n) + np.arange(int(n.sum()))
    answers, cuts = at[window], np.cumsum(n) - n
    least = np.minimum.reduceat(answers, cuts)
    same = least == np.maximum.reduceat(answers, cuts)
    sent = np.where(same, 1, n)
    taken = np.repeat(cuts - np.cumsum(sent) + sent, sent) + np.arange(int(sent.sum()))
    values = binary(answers[taken].view(np.uint8), np.cumsum(sent) * 8)
    later = np.flatnonzero(least[code] < rows.column("high").to_numpy())
    piece = pa.array(code[later])
    return pa.table({"chunk": rows.column("chunk").take(pa.array(later)), "n": pa.array(n[code[later]]), "places": rows.column("places").take(pa.array(later)), "docs": values.take(piece)})


def answered(found: DataFrame, parts: int) -> DataFrame:
    """The answers of ``earliest``, over whole keys of some ``GROUP`` bytes of pieces at a time."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            key = batch.column("key").to_numpy()
            bytes_ = np.cumsum(pc.binary_length(batch.column("piece")).to_numpy())
            opens = np.flatnonzero(np.diff(key)) + 1  # a key's rows stay together
            if held and key[0] != held[-1].column("key")[-1].as_py():
                opens = np.append(0, opens)
            a = 0
            for z in opens.tolist():
                so_far = size + int(bytes_[z - 1] if z else 0) - int(bytes_[a - 1] if a else 0)
                if so_far >= GROUP:
                    held.append(batch.slice(a, z - a))
                    yield from earliest(pa.Table.from_batches([h for h in held if h.num_rows])).to_batches()
                    held, size, a = [], 0, z
            held.append(batch.slice(a))
            size += int(bytes_[-1]) - int(bytes_[a - 1] if a else 0)
        held = [h for h in held if h.num_rows]
        if held:
            yield from earliest(pa.Table.from_batches(held)).to_batches()

    dealt = found.repartition(parts, "key").sortWithinPartitions("key")
    return dealt.mapInArrow(work, "chunk long, n long, places binary, docs binary")


def covered(chunk: Chunk, answers: pa.Table) -> np.ndarray:
    """Which bytes of a chunk a window covers that stands in an earlier document."""
    edges = np.zeros(len(chunk.text) + 1, np.int64)

    def mark(first: np.ndarray, n: np.ndarray, doc: np.ndarray) -> None:
        later = chunk.ids[chunk.doc(first)] > doc
        edges[:] += np.bincount(first[later], minlength=len(edges))
        edges[:] -= np.bincount((first + n + LENGTH - 1)[later], minlength=len(edges))

    if answers.num_rows:
        n, times = answers.column("n").to_numpy(), pc.binary_length(answers.column("places")).to_numpy() // 4
        sent = pc.binary_length(answers.column("docs")).to_numpy() // 8
        places, docs = _flat(answers.column("places"), "<i4").astype(np.int64), _flat(answers.column("docs"), "<i8")
        row, begin = np.repeat(np.arange(len(n)), times), np.cumsum(sent) - sent
        one = sent[row] == 1
        mark(places[one], n[row[one]], docs[begin[row[one]]])
        row, places = row[~one], places[~one]
        if len(row):
            m = n[row]
            step = np.arange(int(m.sum())) - np.repeat(np.cumsum(m) - m, m)
            mark(np.repeat(places, m) + step, np.ones(len(step), np.int64), docs[np.repeat(begin[row], m) + step])
    return np.cumsum(edges[:-1]) > 0


def find(docs: DataFrame, common: int = 1000) -> DataFrame:
    """A row per row of ``docs``: doc_id, n_bytes, removed (the spans that go, by start) and kept (the other bytes)."""
    total = int(docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0])
    least = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    chunks = chunked(docs, max(least, total >> 26))
    buckets = max(least, total // 10 >> 21)  # some two million hashes each
    hashes = repeated_hashes(chunks, buckets, common)
    pieces_found = hashes.agg(F.coalesce(F.sum("found"), F.lit(0))).first()[0]
    answers = answered(repeated_pieces(chunks, hashes, buckets), max(least, int(pieces_found) * 100 >> 25))

    def work(rows: pa.Table, replies: pa.Table) -> pa.Table:
        if not rows.num_rows:
            return empty
        chunk = Chunk(rows)
        gone = covered(chunk, replies)
        starts = np.zeros(len(gone), bool)
        starts[(chunk.full - chunk.sizes[chunk.row])] = True
        before = np.concatenate([[False], gone[:-1]])
        first = np.flatnonzero(gone & (starts | ~before))
        last = np.flatnonzero(np.append(gone & np.append(starts[1:] | ~gone[1:], True), False)) if len(gone) else first
        doc = chunk.doc(first)
        per_row = np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=len(chunk.ids)))]).astype(np.int32)
        begin = chunk.ends - chunk.sizes
        spans = pa.StructArray.from_arrays([pa.array(first - begin[doc]), pa.array(last - first + 1)], names=["start", "length"])
        left = np.concatenate([[0], np.cumsum(~gone)])[chunk.ends]
        ids = pa.array(chunk.ids, mask=chunk.null)
        return pa.Table.from_arrays([ids, pa.array(chunk.sizes), pa.ListArray.from_arrays(per_row, spans), binary(chunk.text[~gone], left)], names=empty.column_names)

    empty = pa.table({"doc_id": pa.array([], pa.int64()), "n_bytes": pa.array([], pa.int64()), "removed": pa.array([], pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())]))), "kept": pa.array([], pa.binary())})
    return chunks.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(work, f"doc_id long, n_bytes long, removed {SPANS}, kept binary")


def digest(found: DataFrame) -> DataFrame:
    removed = F.aggregate("removed", F.lit(0).cast("long"), lambda s, r: s + r["length"])
    return found.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
