"""Where models plug in: vectors of texts and pictures, faces and objects, as Arrow-batched functions.

A model is built by a function without arguments, once in each worker process. The default text
model hashes words into a fixed number of signed buckets; it needs no weights.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

TextModel = Callable[[list[str]], np.ndarray]
ImageModel = Callable[[list[bytes]], np.ndarray]
FACES = "array<struct<x:double,y:double,w:double,h:double,confidence:double,embedding:array<float>,gender:string,age:int>>"


def hashing_text_model(size: int = 256) -> TextModel:
    """Unit vectors of word hashes; a text without words is the zero vector."""
    import xxhash

    def encode(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), size), np.float32)
        for row, text in zip(out, texts, strict=True):
            for word in (text or "").lower().split():
                h = xxhash.xxh64_intdigest(word)
                row[h % size] += 1 if h >> 63 else -1
        lengths = np.linalg.norm(out, axis=1, keepdims=True)
        return np.divide(out, lengths, out=out, where=lengths > 0)

    return encode


def _iterated(build: Callable, kind: str, apply: Callable):
    @F.pandas_udf(kind)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = build()
        for batch in batches:
            yield apply(model, batch)

    return run


def text_vectors(text: Column, build: Callable[[], TextModel] = hashing_text_model) -> Column:
    return _iterated(build, "array<float>", lambda m, b: pd.Series(list(m(b.fillna("").tolist()))))(text)


def embedded(rows: DataFrame, build: Callable[[], TextModel] = hashing_text_model, size: int = 1_000_000) -> DataFrame:
    """(id, vector) of (id, text): as ``text_vectors``, each text once, whatever reads the vectors, and some ``size`` bytes of texts at a time.

    The session's Arrow batches are set to at most 1,000 rows from here on, so that a worker holds some MB of texts.
    """
    conf = rows.sparkSession.conf
    if not 0 < int(conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= 1000:
        conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = build()
        for batch in batches:
            ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False))
            at = 0
            while at < batch.num_rows:
                end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + size, "right")))
                part = batch.slice(at, end - at)
                vectors = model(["" if t is None else t for t in part.column("text").to_pylist()])
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(list(np.asarray(vectors, np.float32)), pa.list_(pa.float32()))], names=["id", "vector"])
                at = end

    return rows.select(F.col("id").cast("long").alias("id"), "text").mapInArrow(work, "id long, vector array<float>")


def image_vectors(content: Column, build: Callable[[], ImageModel]) -> Column:
    return _iterated(build, "array<float>", lambda m, b: pd.Series([np.asarray(v, np.float32) for v in m(b.tolist())]))(content)


def detected_labels(content: Column, build: Callable[[], Callable[[list[bytes]], list[list[str]]]]) -> Column:
    return _iterated(build, "array<string>", lambda m, b: pd.Series([sorted(set(x)) for x in m(b.tolist())]))(content)


def detected_faces(media: DataFrame, build: Callable[[], Callable[[bytes], list[dict]]]) -> DataFrame:
    """A row per face of (media_id, content): media_id, face_id, box, confidence, embedding, gender, age."""
    kind = T._parse_datatype_string(FACES)
    fields = [f.name for f in kind.elementType.fields]

    @F.pandas_udf(kind)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = build()
        for batch in batches:
            yield pd.Series([[tuple(face.get(f) for f in fields) for face in model(content)] for content in batch])

    rows = media.select("media_id", F.posexplode(run("content")).alias("k", "f"))
    return rows.select("media_id", F.concat(F.col("media_id").cast("string"), F.lit(":f"), F.col("k").cast("string")).alias("face_id"), "f.*")


def detected_shots(media: DataFrame, build: Callable[[], Callable[[bytes], list[tuple[float, float]]]]) -> DataFrame:
    """A row per shot of (media_id, content): video_id, shot_index, t_start, t_end. Spans that don't last are left out."""

    @F.pandas_udf("array<struct<t_start:double,t_end:double>>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = build()
        for batch in batches:
            yield pd.Series([sorted((float(a), float(b)) for a, b in model(content) if b > a) for content in batch])

    return media.select(F.col("media_id").alias("video_id"), F.posexplode(run("content")).alias("shot_index", "s")).select("video_id", "shot_index", "s.t_start", "s.t_end")


def stored_vector(blob: Column) -> Column:
    """A float32 vector from its little-endian bytes."""

    @F.pandas_udf("array<float>")
    def run(batch: pd.Series) -> pd.Series:
        return batch.map(lambda b: None if b is None else np.frombuffer(b, "<f4"))

    return run(blob)
