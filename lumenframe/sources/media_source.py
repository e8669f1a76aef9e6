"""Media files below some folders as a Spark data source, with every folder and file that can't be read as a row.

``scan`` walks folders in the tasks: the driver only lists until there are enough folders to deal out.
``hashed`` reads the files block by block, evenly dealt, so a file of any size takes one block of memory.
"""

from __future__ import annotations

import hashlib
import json
import os
import posixpath
import re
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import unquote, urlsplit

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from lumenframe.functions.media import IMAGE_FILES, VIDEO_FILES

FILES = "source_name string, path string, rel_path string, size_bytes long, mtime_ns long, kind string, error string"
SCHEMA = pa.schema([("source_name", pa.string()), ("path", pa.string()), ("rel_path", pa.string()), ("size_bytes", pa.int64()), ("mtime_ns", pa.int64()), ("kind", pa.string()), ("error", pa.string())])
BLOCK = 1 << 20
ROWS = 10_000


def opened(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system behind a path or address, and the path in it."""
    if re.match(r"file:/+", uri):
        return pafs.LocalFileSystem(), "/" + unquote(urlsplit(uri).path).lstrip("/")
    if uri.startswith("/"):
        return pafs.LocalFileSystem(), uri
    return pafs.FileSystem.from_uri(re.sub("^s3[an]:", "s3:", uri))


def said(error: Exception) -> str:
    return f"{type(error).__name__}: {error}"[:500]


@dataclass
class Folder(InputPartition):
    """A folder of a source to walk: whole, or its own files only."""

    source_name: str
    root: str
    path: str
    deep: bool


def listed(store: pafs.FileSystem, path: str) -> tuple[list[pafs.FileInfo], list[pafs.FileInfo]]:
    """Folders and files in a folder, without hidden ones."""
    found = [f for f in store.get_file_info(pafs.FileSelector(path)) if not f.base_name.startswith(".")]
    return [f for f in found if f.type == pafs.FileType.Directory], [f for f in found if f.type == pafs.FileType.File]


class MediaFiles(DataSource):
    """Options: ``sources`` (JSON of name and folder), ``kind`` (image or video), ``parts`` (folders to deal out, about)."""

    @classmethod
    def name(cls) -> str:
        return "media_files"

    def schema(self) -> str:
        return FILES

    def reader(self, schema) -> DataSourceReader:
        return Walk(dict(self.options))


class Walk(DataSourceReader):
    def __init__(self, options: dict):
        self.sources, self.kind, self.parts = json.loads(options["sources"]), options.get("kind") or None, int(options.get("parts", 64))

    def partitions(self) -> list[Folder]:
        todo = [Folder(name, root, opened(root)[1], True) for name, root in self.sources.items()]
        done: list[Folder] = []
        while todo and len(todo) + len(done) < self.parts:  # by level, until there are enough
            level, todo = todo, []
            for f in level:
                try:
                    below, _ = listed(opened(f.root)[0], f.path)
                except (OSError, pa.ArrowException):
                    done.append(f)  # its task meets the same error and tells it
                    continue
                done.append(Folder(f.source_name, f.root, f.path, False))
                todo += [Folder(f.source_name, f.root, d.path, True) for d in below]
        return done + todo or [Folder("", "", "", False)]

    def read(self, part: Folder) -> Iterator[pa.RecordBatch]:
        if not part.root:
            return
        store, root = opened(part.root)
        kinds = {x: k for k, names in (("image", IMAGE_FILES), ("video", VIDEO_FILES)) for x in names if self.kind in (None, k)}
        rows, todo = [], [part.path]
        while todo:
            folder = todo.pop()
            try:
                below, files = listed(store, folder)
            except (OSError, pa.ArrowException) as error:
                rows.append((part.source_name, folder, posixpath.relpath(folder, root), None, None, None, said(error)))
                below, files = [], []
            todo += [d.path for d in below] if part.deep else []
            for f in files:
                kind = kinds.get(f.extension.lower())
                if kind:
                    rows.append((part.source_name, f.path, posixpath.relpath(f.path, root), f.size, f.mtime_ns, kind, None))
            if len(rows) >= ROWS:
                yield _batch(rows)
                rows = []
        if rows:
            yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), SCHEMA, strict=True)], schema=SCHEMA)


def scan(spark: SparkSession, sources: dict[str, str], kind: str | None = None, parts: int = 64) -> DataFrame:
    """``FILES``: a row per media file below the sources' folders, without hidden ones, and one with ``error`` for each folder that can't be listed; a missing folder is one."""
    spark.dataSource.register(MediaFiles)
    return spark.read.format("media_files").option("sources", json.dumps(sources)).option("kind", kind or "").option("parts", str(parts)).load()


def digest_of(path: str, root: str = "/", block: int = BLOCK) -> str:
    """SHA-256 of a file, read in blocks."""
    store, _ = opened(root)
    whole = hashlib.sha256()
    with store.open_input_stream(path, compression=None, buffer_size=0) as source:
        while data := source.read(block):
            whole.update(data)
    return whole.hexdigest()


def hashed(files: DataFrame, root: str = "/", parts: int | None = None, block: int = BLOCK) -> DataFrame:
    """``files`` (``FILES``) with media_id, the content's SHA-256; files that can't be read get their ``error`` instead.

    Files are dealt over tasks by a hash of their path, as one folder may hold most of them. ``root``:
    an address of the file system that the paths are in.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, errors = [], []
            for path, error in zip(batch.column("path").to_pylist(), batch.column("error").to_pylist(), strict=True):
                found = None
                if error is None:
                    try:
                        found = digest_of(path, root, block)
                    except (OSError, pa.ArrowException) as e:
                        error = said(e)
                ids.append(found)
                errors.append(error)
            columns = {n: c for n, c in zip(batch.schema.names, batch.columns, strict=True)} | {"error": pa.array(errors, pa.string()), "media_id": pa.array(ids, pa.string())}
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    n = parts or int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return files.repartition(n, F.xxhash64("source_name", "path")).mapInArrow(work, FILES + ", media_id string")


def error_counts(files: DataFrame, sources: dict[str, str]) -> DataFrame:
    """source_name, n_files, n_errors of every source, those without any row too."""
    names = files.sparkSession.createDataFrame([(s,) for s in sources], "source_name string")
    counts = files.groupBy("source_name").agg(F.count_if(F.col("error").isNull()).alias("n_files"), F.count_if(F.col("error").isNotNull()).alias("n_errors"))
    return names.join(counts, "source_name", "left").fillna(0, ["n_files", "n_errors"])


def sound_sources(counts: DataFrame) -> DataFrame:
    """The sources (source_name) whose files a sweep may miss: those whose walk and reading met no error."""
    return counts.where("n_errors = 0").select("source_name")


def snapshot(files: DataFrame) -> DataFrame:
    """What ``ingest.classify`` takes of a hashed scan."""
    return files.where("error is null").select("source_name", "rel_path", "size_bytes", "mtime_ns", "media_id")


def changed_content(media: DataFrame, roots: dict[str, str], parts: int | None = None) -> DataFrame:
    """Live media whose canonical file (source_name, rel_path) can't be read any more or holds other content: media_id, found_id, error.

    The files themselves are read, whatever their prints say.
    """
    spark = media.sparkSession
    tops = spark.createDataFrame([(s, opened(r)[1].rstrip("/")) for s, r in roots.items()], "source_name string, top string")
    live = media.where("deleted = 0").join(F.broadcast(tops), "source_name")
    missing = F.lit(None)
    files = live.select("source_name", F.concat_ws("/", "top", "rel_path").alias("path"), F.col("media_id").alias("rel_path"), missing.cast("long").alias("size_bytes"), missing.cast("long").alias("mtime_ns"), missing.cast("string").alias("kind"), missing.cast("string").alias("error"))
    read = hashed(files, parts=parts).select(F.col("rel_path").alias("media_id"), F.col("media_id").alias("found_id"), "error")
    return read.where(~F.col("found_id").eqNullSafe(F.col("media_id")))


def write_files(rows: DataFrame, root: str) -> int:
    """Writes ``rows`` (rel_path, content) as files below ``root``, from the tasks; how many."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, top = opened(root)
        for batch in batches:
            for rel, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                path = posixpath.join(top, rel)
                store.create_dir(os.path.dirname(path), recursive=True)
                with store.open_output_stream(path, compression=None) as out:
                    out.write(content or b"")
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], names=["n"])

    return rows.select("rel_path", F.col("content").cast("binary")).mapInArrow(work, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
