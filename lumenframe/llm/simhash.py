"""Near duplicates by 64-bit SimHash fingerprints and multi-index hashing.

Fingerprints are indexed by each of their two 32-bit segments. Two that differ in at most 2 bits
differ in at most 1 bit of the first segment or in none of the second, so each fingerprint looks up
the Hamming ball of radius 1 around its first segment, and its second segment as it is; complete
distances are then checked.

Only distinct fingerprints are indexed. A segment value of more than ``BUCKET`` fingerprints is a
large bucket, whose members are not compared with each other: they are indexed again inside it, by
the ball of radius 1 around the other segment. Two fingerprints differ in at most 2 bits exactly if
such balls meet, and the point where they meet (a 64-bit value) stands as a node between them, so a
bucket gives 33 rows a member however large it is, and loses no link.

Null and empty texts have fingerprint zero and are linked like any other. A null doc_id gets its
fingerprint and component too; a component of such rows only has a null name. Repeated rows each get
their result; further columns are ignored. An empty table gives no rows. A very long text is a slice
of its own, of some 80 bytes a word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenframe.llm import storage
from lumenframe.llm.components import components, small

SHINGLE = 3
SEED = 42
BUCKET = 32
RADIUS = 2


def fingerprints_of(texts: list[bytes | None]) -> np.ndarray:
    """Signed 64-bit fingerprints of UTF-8 texts: the majority of each bit among the shingles' XXH64."""
    from xxhash import xxh64_intdigest

    hashes: list[int] = []
    counts = np.zeros(len(texts), np.int64)
    for k, text in enumerate(texts):
        words = text.lower().split() if text else []  # of bytes: A-Z only, ASCII white space only
        if not words:
            continue
        joined = b" ".join(words)
        gaps = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
        if len(words) <= SHINGLE:
            hashes.append(xxh64_intdigest(joined, SEED))
            counts[k] = 1
            continue
        starts = [0, *(gaps[: len(words) - SHINGLE] + 1).tolist()]
        ends = [*gaps[SHINGLE - 1 :].tolist(), len(joined)]
        hashes += [xxh64_intdigest(joined[a:b], SEED) for a, b in zip(starts, ends, strict=True)]
        counts[k] = len(starts)
    out = np.zeros(len(texts), np.int64)
    some = np.flatnonzero(counts)
    if len(some):
        bits = np.unpackbits(np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones = np.add.reduceat(bits, np.cumsum(counts[some]) - counts[some], axis=0, dtype=np.int32)
        out[some] = np.packbits(2 * ones > counts[some, None], axis=1, bitorder="little").view("<i8")[:, 0]
    return out


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, fp) of each row, from whole texts."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in storage.by_size(batch, "text", 1_000_000):
                found = fingerprints_of(part.column("text").cast(pa.binary()).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("text_hash"), pa.array(found)], names=["doc_id", "text_hash", "fp"])

    return storage.in_small_batches(storage.hashed(docs)).mapInArrow(work, "doc_id long, text_hash long, fp long")


def links(distinct: DataFrame) -> DataFrame:
    """Edges (u, v) that connect distinct fingerprints ``fp`` as their links do; see above. ``distinct`` is stored."""
    edges, points = linked(distinct)
    return edges if points is None else edges.unionByName(points.select(F.col("fp").alias("u"), F.col("point").alias("v")))


def linked(distinct: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """Pairs (u, v) of linked fingerprints; where buckets are large, also their members (fp, point) at each point where balls meet, or None."""
    halves = distinct.select("fp", F.expr("shiftrightunsigned(fp, 32)").alias("high"), F.expr("fp & 4294967295").alias("low"))
    own = halves.select("fp", F.expr("inline(array(struct(0 AS seg, high AS value), struct(1 AS seg, low AS value)))"))
    # a pair that differs in a bit is found by the one that has 0 there
    near = "filter(transform(sequence(0, 31), i -> high | shiftleft(1L, i)), x -> x != high)"
    probes = own.unionByName(halves.select("fp", F.lit(0).alias("seg"), F.expr(f"explode({near})").alias("value")))
    large = storage.cut(own.groupBy("seg", "value").count().where(F.col("count") > BUCKET).select("seg", "value"))
    if large.isEmpty():
        members, inside = own, None
    else:
        large = small(large)
        members, inside = own.join(large, ["seg", "value"], "left_anti"), probes.join(large, ["seg", "value"])
    found = probes.join(members.withColumnRenamed("fp", "other"), ["seg", "value"])
    pairs = found.where((F.col("fp") != F.col("other")) & (F.bit_count(F.col("fp").bitwiseXOR(F.col("other"))) <= RADIUS))
    edges = pairs.select(F.col("fp").alias("u"), F.col("other").alias("v"))
    if inside is None:
        return edges, None
    # members (own value) give the ball around the other segment, those one bit off the bucket's value only their own
    member = "CASE WHEN seg = 0 THEN shiftrightunsigned(fp, 32) ELSE fp & 4294967295 END = value"
    shift = "CASE WHEN seg = 0 THEN 0 ELSE 32 END"
    moved = f"transform(sequence(0, 31), i -> fp ^ shiftleft(1L, i + {shift}))"
    here = "CASE WHEN seg = 0 THEN shiftleft(value, 32) | (fp & 4294967295) ELSE fp END"
    points = inside.select("fp", F.expr(f"explode(CASE WHEN {member} THEN concat(array(fp), {moved}) ELSE array({here}) END)").alias("point")).distinct()
    met = points.groupBy("point").agg(F.min("fp").alias("a"), F.max("fp").alias("b")).where("a != b").select("point")
    return edges, points.join(storage.cut(met), "point")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, fp, component, component_id) of each row.

    component is the lowest fingerprint reachable over links of at most 2 bits, component_id the smallest doc_id that has
    one of those fingerprints.
    """
    prints = storage.cut(fingerprints(docs))
    groups = storage.cut(prints.groupBy("fp").agg(F.min("doc_id").alias("first")))
    found = components(links(groups.select("fp"))).withColumnRenamed("node", "fp")
    joined = groups.join(found, "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    joined = storage.cut(joined)
    first = storage.cut(joined.groupBy("component").agg(F.min("first").alias("component_id")))
    names = storage.cut(joined.join(first, "component").select("fp", "component", "component_id"))
    return prints.join(names, "fp").select("doc_id", "text_hash", "fp", "component", "component_id")


def digest(found: DataFrame) -> DataFrame:
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_first(docs: DataFrame, found: DataFrame | None = None) -> DataFrame:
    """``docs`` with one row of each group of near duplicates: that of the smallest doc_id, of several such texts the one of lowest hash.

    ``found``: the groups (doc_id, text_hash, component), if other than by fingerprints. Rows without a doc_id stay. Rows
    that share a doc_id but are of different groups are documents of their own; of rows that repeat the one to keep, one
    stays, that of the lowest hash of its columns.
    """
    found = near_duplicates(docs) if found is None else found
    rows = storage.cut(found.where("doc_id is not null").groupBy("component", "doc_id", "text_hash").agg(F.count("*").alias("n")))
    first = storage.cut(rows.groupBy("component").agg(F.min(F.struct("doc_id", "text_hash")).alias("first"), F.sum("n").alias("n")).where("n > 1").select("component", "first"))
    named = storage.cut(rows.join(first, "component").select(F.col("doc_id").alias("__lf_id"), F.col("text_hash").alias("__lf_hash"), "n", (F.struct("doc_id", "text_hash") == F.col("first")).alias("stays")))
    gone, twice = (storage.cut(named.where(x).select("__lf_id", "__lf_hash")) for x in ("not stays", "stays and n > 1"))
    whole = docs.select(F.col("doc_id").cast("long").alias("__lf_doc"), F.xxhash64("text").alias("__lf_text"), F.struct(*(F.col(storage.quoted(c)) for c in docs.columns)).alias("__lf_row"))
    same = (F.col("__lf_doc") == F.col("__lf_id")) & (F.col("__lf_text") == F.col("__lf_hash"))
    kept = whole.join(small(gone), same, "left_anti")
    if not twice.isEmpty():
        plain = [f"__lf_row.{storage.quoted(f.name)}" for f in docs.schema if f.dataType.typeName() not in ("map", "variant")]
        one = kept.join(small(twice), same, "left_semi").groupBy("__lf_doc", "__lf_text").agg(F.min_by("__lf_row", F.xxhash64(*plain)).alias("__lf_row"))
        kept = kept.join(small(twice), same, "left_anti").select("__lf_row").unionByName(one.select("__lf_row"))
    return kept.select(*(F.col("__lf_row")[c].alias(c) for c in docs.columns))
