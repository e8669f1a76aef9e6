"""All pairs of one collection's vectors above a similarity, as products of tiles.

Vectors near the same pivot lie in the same tiles, and a tile knows the least and greatest angle of its
vectors to every pivot. Angles obey the triangle inequality, so two tiles whose intervals to some pivot lie
further apart than the angle asked for hold no pair, and their product isn't computed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumenframe.operators import running
from lumenframe.operators.knn import _unit
from lumenframe.sources import store

TILE_ROWS, PIVOTS = 1024, 32
#: Tiles that a task compares with each other when pairs of tiles are chosen.
DEALT = 256
#: Tiles of a block. A tile is sent once to each pair of blocks in which it meets another, not to each tile that it meets.
SHARED = 32
#: An angle that rounding can't reach.
SLACK = 1e-6
PLACED = "size int, pivot int, near double, id long, unit binary, angles array<double>"
PAIRS = "a long, b long, score double"


def _placed(vectors: DataFrame, pivots: int) -> DataFrame:
    """Unit vectors with their angles to the pivots of their length, vectors of least hash, and the nearest of these."""
    rows = vectors.where(F.col("id").isNotNull() & (F.size("vector") > 0) & ~F.exists("vector", F.isnull)).select(F.col("id").cast("long").alias("id"), F.col("vector").cast("array<double>").alias("vector"))
    sample: dict[int, list] = {}
    for r in rows.orderBy(F.xxhash64("id"), "id").limit(pivots).collect():
        sample.setdefault(len(r["vector"]), []).append(r["vector"])
    known = {size: _unit(np.array(some)) for size, some in sample.items()}

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("vector")
            sizes = np.diff(column.offsets.to_numpy())
            for size in np.unique(sizes):
                part = batch.filter(pa.array(sizes == size))
                unit = _unit(part.column("vector").flatten().to_numpy(zero_copy_only=False).reshape(-1, size))
                angles = np.arccos(np.clip(unit @ known.get(size, np.eye(1, size)).T, -1.0, 1.0))
                own = angles.argmin(axis=1)
                columns = [np.full(len(unit), size, np.int32), own.astype(np.int32), angles.min(axis=1)]
                binary = pa.array([u.tobytes() for u in unit], pa.binary())
                yield pa.RecordBatch.from_arrays([*map(pa.array, columns), part.column("id"), binary, pa.array(list(angles))], names=["size", "pivot", "near", "id", "unit", "angles"])

    return rows.mapInArrow(place, PLACED)


def tiles(vectors: DataFrame, tile_rows: int = TILE_ROWS, pivots: int = PIVOTS) -> DataFrame:
    """A stored table of tiles: no, size, low and high (angles to each pivot), ids and units as bytes."""
    spark = vectors.sparkSession
    cut = running.in_pieces(_placed(vectors, pivots), ["size", "pivot"], ["near", "id"], tile_rows)

    def pack(table: pa.Table) -> pa.Table:
        angles = np.array(table.column("angles").to_pylist())
        row = {"size": table.column("size")[0].as_py(), "pivot": table.column("pivot")[0].as_py(), "piece": table.column(running.PIECE)[0].as_py(), "low": angles.min(axis=0).tolist(), "high": angles.max(axis=0).tolist(), "ids": table.column("id").to_numpy().tobytes(), "units": b"".join(table.column("unit").to_pylist())}
        return pa.Table.from_pylist([row], pa.schema([("size", pa.int32()), ("pivot", pa.int32()), ("piece", pa.int64()), ("low", pa.list_(pa.float64())), ("high", pa.list_(pa.float64())), ("ids", pa.binary()), ("units", pa.binary())]))

    packed = cut.groupBy("size", "pivot", running.PIECE).applyInArrow(pack, "size int, pivot int, piece long, low array<double>, high array<double>, ids binary, units binary")
    folder = store.shared_folder(spark, "tiles")
    packed.select(F.struct("size", "pivot", "piece").alias("no"), "size", "low", "high", "ids", "units").write.parquet(folder)
    return spark.read.schema("no struct<size: int, pivot: int, piece: bigint>, size int, low array<double>, high array<double>, ids binary, units binary").parquet(folder)


def tile_pairs(tiled: DataFrame, min_score: float, digits: int = 6) -> DataFrame:
    """a, b, kept of every two tiles of one length (a tile with itself, too): whether they can hold a pair of at least ``min_score``."""
    widest = float(np.arccos(np.clip(min_score - 0.51 * 10.0**-digits, -1.0, 1.0))) + SLACK
    parts = max(1, -(-tiled.count() // DEALT))
    facts = tiled.select("no", "size", "low", "high")
    left = facts.select("size", F.pmod(F.xxhash64("no"), F.lit(parts)).alias("part"), F.col("no").alias("a"), F.col("low").alias("la"), F.col("high").alias("ha"))
    right = facts.select("size", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))).alias("part"), F.col("no").alias("b"), F.col("low").alias("lb"), F.col("high").alias("hb"))
    both = left.join(right.hint("shuffle_hash"), ["size", "part"]).where("a <= b")
    apart = F.exists(F.arrays_zip("la", "ha", "lb", "hb"), lambda x: (x["la"] - x["hb"] > widest) | (x["lb"] - x["ha"] > widest))
    return both.select("a", "b", (~apart).alias("kept"))


def similar_pairs(vectors: DataFrame, min_score: float, digits: int = 6, tile_rows: int = TILE_ROWS, pivots: int = PIVOTS) -> DataFrame:
    """a, b (a < b), score of every two vectors whose cosine, rounded to ``digits``, is at least ``min_score``.

    ``vectors``: id, vector. Only vectors of one length are compared; those that are null, empty or hold a
    null, or have no id, are left out, and a zero vector's score is 0. Repeated ids count once a row, and aren't
    paired with each other. Neither side goes through the driver, which gets ``pivots`` vectors.
    """
    tiled = tiles(vectors, tile_rows, pivots)
    kept = tile_pairs(tiled, min_score, digits).where("kept").select("a", "b")
    own = Window.partitionBy("no.size", "no.pivot").orderBy("no.piece")
    block = F.struct("no.size", "no.pivot", F.floor((F.row_number().over(own) - 1) / SHARED).alias("part"))
    named = tiled.select("no", block.alias("block"))
    # a cell is two blocks; each tile of its right block comes once, and after these each of its left block with those it meets
    cells = kept.join(named.select(F.col("no").alias("a"), F.col("block").alias("left")), "a").join(named.select(F.col("no").alias("b"), F.col("block").alias("right")), "b")
    cells = store.written(cells.select(F.struct("left", "right").alias("cell"), "a", "b"))
    right = cells.select("cell", F.col("b").alias("no")).distinct().withColumn("others", F.lit(None).cast("array<string>"))
    left = cells.groupBy("cell", F.col("a").alias("no")).agg(F.collect_list(F.to_json("b")).alias("others"))
    sides = right.unionByName(left).join(tiled.select("no", "size", "ids", "units"), "no")
    dealt = sides.select("size", F.to_json("cell").alias("cell"), F.to_json("no").alias("no"), "others", "ids", "units").repartition("cell").sortWithinPartitions("cell", F.col("others").isNotNull())

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, {}
        for batch in batches:
            for k in range(batch.num_rows):
                size, cell, a_no, others, own, units = (batch.column(c)[k].as_py() for c in range(6))
                if cell != now:
                    now, held = cell, {}
                a, unit_a = np.frombuffer(own, np.int64), np.frombuffer(units).reshape(-1, size)
                if others is None:
                    held[a_no] = a, unit_a
                    continue
                for b_no in others:
                    b, unit_b = held[b_no]
                    score = np.round(unit_a @ unit_b.T, digits)
                    near = score >= min_score
                    x, y = np.nonzero(np.triu(near, 1) if a_no == b_no else near)
                    x, y, found = a[x], b[y], score[x, y]
                    other = x != y
                    low, high, found = np.minimum(x, y)[other], np.maximum(x, y)[other], found[other]
                    for at in range(0, len(low), 65536):
                        cut = slice(at, at + 65536)
                        yield pa.RecordBatch.from_arrays([pa.array(low[cut]), pa.array(high[cut]), pa.array(found[cut])], names=["a", "b", "score"])

    return dealt.mapInArrow(multiply, PAIRS)
