"""Keyed tables that outlive a session: buckets of files by a hash of the key, and a manifest a version.

A change reads and rewrites only the buckets its keys fall in; the files of the others are taken over by
name. A version is one small file (its number, the schema, a folder for each bucket, and marks such as how
far an export has come), written last and renamed into place without overwriting, so a version is there
whole or not at all. A writer that finds its next version taken has lost against another and raises
``Conflict``; ``change`` then tries again on what the other left. Folders of failed writers belong to no
version and stay until ``vacuum``.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenframe.operators import tables
from lumenframe.sources import store

BUCKET = "__bucket"


class Conflict(Exception):
    """Somebody else has made the next version."""


@dataclass(frozen=True)
class Version:
    """What a version's file says."""

    number: int
    schema: str
    keys: list[str]
    buckets: int
    folders: dict[str, str]
    marks: dict = field(default_factory=dict)


class KeyedTable:
    """The table in a folder, at one version; changes return the table at the next one."""

    def __init__(self, spark: SparkSession, folder: str, version: Version):
        self.spark, self.folder, self.version = spark, folder, version

    @staticmethod
    def open(spark: SparkSession, folder: str, number: int | None = None) -> KeyedTable:
        """The last version, or one by number."""
        known = [n for n in store.names(spark, f"{folder}/versions") if n.endswith(".json") and not n.startswith(".")]
        if not known:
            raise FileNotFoundError(folder)
        name = known[-1] if number is None else f"{number:012d}.json"
        return KeyedTable(spark, folder, Version(**json.loads(store.get_text(spark, f"{folder}/versions/{name}"))))

    @staticmethod
    def ensure(spark: SparkSession, folder: str, schema: T.StructType | str, keys: list[str], buckets: int = 64) -> tuple[KeyedTable, bool]:
        """The table, and whether it was created: where there is none, or one of another schema or key, which gives way to an empty one."""
        schema = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
        plain = T.StructType([T.StructField(f.name, f.dataType) for f in schema]).json()
        try:
            table = KeyedTable.open(spark, folder)
        except FileNotFoundError:
            table = None
        if table is not None and (table.version.schema, table.version.keys) == (plain, keys):
            return table, False
        number = table.version.number + 1 if table else 1
        return KeyedTable(spark, folder, Version(number - 1, plain, keys, buckets, {}))._commit({}, {}, fresh=True), True

    def read(self, buckets: list[int] | None = None) -> DataFrame:
        """All rows, or those of some buckets."""
        v = self.version
        schema = T.StructType.fromJson(json.loads(v.schema))
        paths = [f"{self.folder}/data/{p}" for b, p in sorted(v.folders.items()) if buckets is None or int(b) in buckets]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    @property
    def marks(self) -> dict:
        return self.version.marks

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*(F.col(f"`{k}`") for k in self.version.keys)), F.lit(self.version.buckets)).cast("int")

    def _touched(self, keys: DataFrame) -> list[int]:
        return sorted(r[0] for r in keys.select(self.bucket()).distinct().collect())  # one number a bucket at most

    def _rewritten(self, rows: DataFrame, buckets: list[int], marks: dict) -> KeyedTable:
        """Commits ``rows`` as the new content of some buckets."""
        name = uuid.uuid4().hex
        placed = rows.withColumn(BUCKET, self.bucket())
        placed.repartition(max(1, len(buckets)), BUCKET).write.partitionBy(BUCKET).parquet(f"{self.folder}/data/{name}")
        there = {n.split("=")[1] for n in store.names(self.spark, f"{self.folder}/data/{name}") if n.startswith(f"{BUCKET}=")}
        return self._commit({str(b): f"{name}/{BUCKET}={b}" if str(b) in there else None for b in buckets}, marks)

    def _commit(self, folders: dict[str, str | None], marks: dict, fresh: bool = False) -> KeyedTable:
        v = self.version
        merged = {} if fresh else {**v.folders, **folders}
        new = Version(v.number + 1, v.schema, v.keys, v.buckets, {b: p for b, p in merged.items() if p}, {} if fresh else {**v.marks, **marks})
        text = json.dumps(new.__dict__, sort_keys=True)
        if not store.put_new(self.spark, f"{self.folder}/versions/{new.number:012d}.json", text):
            raise Conflict(f"version {new.number} of {self.folder} is taken")
        return KeyedTable(self.spark, self.folder, new)

    def upsert(self, rows: DataFrame, update: list[str] | None = None, stamp: tuple[str, int] | None = None, marks: dict | None = None) -> KeyedTable:
        """``tables.upsert`` by the table's keys, in the buckets of ``rows`` only; one row a key in ``rows``.

        ``stamp`` (column, value): what rows that are new or differ afterwards have there; rows that are
        given as they are keep theirs.
        """
        buckets = self._touched(rows)
        old, keys = self.read(buckets), self.version.keys
        new = tables.upsert(old, rows, keys, update)
        if stamp:
            column, value = stamp
            others = [c for c in old.columns if c != column]
            before = old.select(*keys, F.struct(*others).alias("__before"))
            same = F.coalesce(F.col("__before").eqNullSafe(F.struct(*others)), F.lit(False))
            new = new.join(before, keys, "left").withColumn(column, F.when(same, F.col(column)).otherwise(F.lit(value))).select(*old.columns)
        return self._rewritten(new, buckets, marks or {})

    def update(self, rows: DataFrame, marks: dict | None = None) -> KeyedTable:
        """Takes over ``rows``' other columns where the key is known."""
        buckets = self._touched(rows)
        return self._rewritten(tables.update_fields(self.read(buckets), rows, self.version.keys), buckets, marks or {})

    def delete(self, keys: DataFrame, marks: dict | None = None) -> KeyedTable:
        buckets = self._touched(keys)
        return self._rewritten(tables.delete(self.read(buckets), keys.select(*self.version.keys).distinct()), buckets, marks or {})

    def overwrite(self, rows: DataFrame, marks: dict | None = None) -> KeyedTable:
        """All buckets with new content."""
        return self._rewritten(rows.select(*T.StructType.fromJson(json.loads(self.version.schema)).names), list(range(self.version.buckets)), marks or {})

    def mark(self, **marks) -> KeyedTable:
        """A version that differs in its marks."""
        return self._commit({}, marks)

    def vacuum(self, keep: int = 1) -> int:
        """Deletes older versions than the last ``keep`` and the folders that none of those names; how many folders went. No writer may be at work."""
        names = [n for n in store.names(self.spark, f"{self.folder}/versions") if not n.startswith(".")]
        kept = [Version(**json.loads(store.get_text(self.spark, f"{self.folder}/versions/{n}"))) for n in names[-keep:]]
        used = {p.split("/")[0] for v in kept for p in v.folders.values()}
        gone = [n for n in store.names(self.spark, f"{self.folder}/data") if n not in used]
        for n in gone:
            store.delete(self.spark, f"{self.folder}/data/{n}")
        for n in names[:-keep]:
            store.delete(self.spark, f"{self.folder}/versions/{n}")
        return len(gone)


def change(spark: SparkSession, folder: str, step: Callable[[KeyedTable], KeyedTable], tries: int = 5) -> KeyedTable:
    """``step`` on the last version, again on a newer one where another writer was first."""
    for k in range(tries):
        try:
            return step(KeyedTable.open(spark, folder))
        except Conflict:
            if k == tries - 1:
                raise
    raise ValueError("tries must be positive")


def export_into(target: KeyedTable, points: DataFrame, gone: DataFrame, watermark: int) -> KeyedTable:
    """Points put in and taken out of an exported collection, and how far the export has come, in one version: a crash leaves neither or both."""
    keys = target.version.keys
    buckets = sorted({*target._touched(points), *target._touched(gone)})
    left = tables.delete(target.read(buckets), gone.select(*keys).distinct())
    new = tables.upsert(left, points.join(gone.select(*keys), keys, "left_anti"), keys)
    return target._rewritten(new, buckets, {"exported": watermark})
