"""The folder that driver and executors share, and small file helpers for tasks."""

from __future__ import annotations

import ctypes
import os
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from urllib.parse import urlsplit

import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``. Where none is set, a temporary folder on a local master; on a cluster that raises."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="lumenframe-")
        spark.sparkContext.setCheckpointDir(found)
        spark.conf.set("spark.checkpoint.dir", found)
    elif spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def new_folder(spark: SparkSession, kind: str) -> str:
    """A fresh folder name below the shared folder."""
    return f"{shared_dir(spark)}/{kind}-{uuid.uuid4().hex}"


def delete(spark: SparkSession, folder: str) -> None:
    """Removes a folder of the shared store, of whatever scheme Spark knows."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def hashed(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, text): with the id, the hash names a row's text where the text itself isn't carried along."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text")


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """What is computed here removes its shuffle files when it is done; otherwise they stay until the driver happens to collect its garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept in the shared folder, its lineage cut."""
    shared_dir(df.sparkSession)
    with shuffles_removed(df.sparkSession):
        return df.select("*").checkpoint(eager=True)


def open_store(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system behind ``uri`` (file:, hdfs:, s3: or Spark's s3a: and the like) and the path in it."""
    if re.match(r"file:/+", uri):
        return pafs.LocalFileSystem(), "/" + urlsplit(uri).path.lstrip("/")
    if uri.startswith("/"):
        return pafs.LocalFileSystem(), uri
    return pafs.FileSystem.from_uri(re.sub("^s3[an]:", "s3:", uri))


def put(uri: str, data) -> None:
    """Write ``data`` under ``uri`` in one step: a task that is repeated leaves the same file."""
    store, path = open_store(uri)
    store.create_dir(os.path.dirname(path), recursive=True)
    part = f"{path}.{uuid.uuid4().hex}.tmp"
    with store.open_output_stream(part, compression=None) as out:
        for piece in [data] if isinstance(data, (bytes, bytearray, memoryview)) else data:
            out.write(piece)
    store.move(part, path)


def parts_for(docs: DataFrame, most_bytes: int = 256 << 20, least_bytes: int = 0) -> int:
    """Partitions for a shuffle of ``docs``, from the bytes of their texts as counted: as many as the session asks for,
    more where those would hold over ``most_bytes``, fewer where they would hold under ``least_bytes``."""
    wanted = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    size = int(docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0])
    parts = max(wanted, -(-size // most_bytes))
    return max(1, min(parts, size // least_bytes)) if least_bytes else parts


def quoted(name: str) -> str:
    """A column's name as Spark takes it whole, dots and all."""
    return "`" + name.replace("`", "``") + "`"


def with_safe_names(docs: DataFrame, needed: list[str], work: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``work`` on ``docs`` whose columns but ``needed`` are numbered meanwhile, so that no name of theirs clashes with
    one of an operator's or has to be quoted; in its result they have their own names again."""
    numbered_ = {c: f"__lf_c{k}" for k, c in enumerate(docs.columns) if c not in needed}
    own = {v: c for c, v in numbered_.items()}
    done = work(docs.select(*(F.col(quoted(c)).alias(numbered_.get(c, c)) for c in docs.columns)))
    return done.select(*(F.col(c).alias(own.get(c, c)) for c in done.columns))


def numbered(docs: DataFrame) -> DataFrame:
    """(doc_id, text, text_hash, row_no): what deals rows out evenly, however many share an id or a text."""
    return hashed(docs).withColumn("row_no", F.monotonically_increasing_id())


def give_back() -> None:
    """Returns freed memory of a Python worker to the system, where the C library can."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def in_small_batches(df: DataFrame, rows: int = 1000) -> DataFrame:
    """``df``, for a function over Arrow batches. The session's batches are set to at most ``rows`` rows from here on, so
    that a Python worker holds some MB of texts at a time; results don't depend on it."""
    conf = df.sparkSession.conf
    if not 0 < int(conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= rows:
        conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    return df


def by_size(batch: pa.RecordBatch, column: str, size: int = 500_000) -> Iterator[pa.RecordBatch]:
    """Slices of ``batch`` of about ``size`` bytes in ``column``, which bounds what a task holds as Python objects."""
    at = total = 0
    for k, n in enumerate(pc.binary_length(batch.column(column)).to_pylist()):
        total += n or 0
        if total >= size:
            yield batch.slice(at, k + 1 - at)
            at, total = k + 1, 0
    if at < batch.num_rows:
        yield batch.slice(at)
    give_back()


def written(df: DataFrame) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, for what is wide or read more than once."""
    folder = new_folder(df.sparkSession, "table")
    with shuffles_removed(df.sparkSession):
        df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)
