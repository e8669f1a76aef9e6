"""Token ids of a corpus as binary files of directly addressable codes (``dac.py``).

``write`` tokenizes in Spark tasks, one range of ``doc_id`` each, and returns a manifest; ``read``
opens the files in tasks. Null texts are empty documents (the end id alone). A null ``doc_id`` sorts
first. Rows with equal ``doc_id`` follow one another, ordered by a hash of their text; however many
they are, they are dealt over tasks. Further columns are ignored. An empty table makes no files. A
very long text is tokenized as one; its ids are one stretch of a file, which no limit cuts.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from lumenframe.llm import dac, storage, tokens

MANIFEST = "path string, part int, file int, n_docs long, n_tokens long"
READ = "doc_id long, start long, n_tokens long, ids_crc32 long"


def write(docs: DataFrame, folder: str, tokenizer_path: str | None = None, tokens_per_file: int = 4_000_000) -> list[dict]:
    """Write ``docs`` (doc_id, text) below ``folder`` in ascending ``doc_id``; a row per file, in order.

    Files are named by range and number, and put in place by a rename, so a task that runs again
    leaves the same ones. Only the manifest reaches the driver: a row for each ``tokens_per_file``.
    """
    path = tokenizer_path or tokens.default_path()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, made = TaskContext.get().partitionId(), 0
        names: list = []
        ids, lengths = [], []

        def flush():
            nonlocal made, names, ids, lengths
            uri = f"{folder}/ids-{part:06d}-{made:06d}.dac"
            every, ends = np.concatenate(ids), np.cumsum(np.concatenate(lengths))
            ids, lengths = [], []
            storage.put(uri, dac.pack(names, ends, every))
            row = pa.RecordBatch.from_pylist([{"path": uri, "part": part, "file": made, "n_docs": len(names), "n_tokens": len(every)}], SCHEMA)
            made, names = made + 1, []
            del every
            storage.give_back()
            return row

        encoder, held = tokens.tokenizer(path), 0
        for batch in batches:
            keys, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for a, b in tokens.slices(texts):
                some, n = encoder.encode(texts[a:b])
                names += keys[a:b]
                ids.append(some)
                lengths.append(n)
                held += len(some)
                if held >= tokens_per_file:
                    yield flush()
                    held = 0
        if names:
            yield flush()

    SCHEMA = pa.schema([("path", pa.string()), ("part", pa.int32()), ("file", pa.int32()), ("n_docs", pa.int64()), ("n_tokens", pa.int64())])
    key = ["doc_id", "text_hash", "row_no"]
    ordered = storage.numbered(docs).repartitionByRange(storage.parts_for(docs), *key).sortWithinPartitions(*key).select("doc_id", "text")
    rows = storage.in_small_batches(ordered).mapInArrow(work, MANIFEST).collect()
    return [r.asDict() for r in sorted(rows, key=lambda r: (r["part"], r["file"]))]


def read(spark: SparkSession, manifest: list[dict]) -> DataFrame:
    """A row per document of the files: where it starts among all ids, its length, and the crc32 of its ids."""
    at, rows = 0, []
    for m in manifest:
        rows.append((m["path"], at))
        at += m["n_tokens"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri, first in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                store, path = storage.open_store(uri)
                with store.open_input_file(path) as source:
                    reader = dac.Reader(source)
                    names, ends = reader.documents()
                    data = memoryview(reader.all()).cast("B")
                starts = np.concatenate([[0], ends[:-1]])
                crc = [zlib.crc32(data[4 * a : 4 * b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(first + starts), pa.array(ends - starts), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])
                del data
                storage.give_back()

    files = spark.createDataFrame(rows, "path string, start long")
    return files.repartition(max(1, len(rows))).mapInArrow(work, READ)
