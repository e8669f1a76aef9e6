"""A compressed index over vectors: inverted lists of product-quantised residuals, with a bitmap a tag.

Every vector belongs to the list of its nearest centre. What is left of it there is cut into parts, and
each part is stored as the number of the nearest of up to 256 code words, so a block of a list holds a few
bytes a vector. A block also has a bitmap of its rows for every tag. Blocks and whole vectors lie in
tables partitioned by list: a search reads the blocks of the lists near its queries, scores their rows
by their code words, leaves out rows without the wanted tags by the bitmaps, and
fetches the whole vectors of its best rows to score them exactly.

Centres and code words are learned from a bounded sample (a parameter); every comparable row is indexed.
How many lists a query reads, and how many rows by their codes it scores exactly, is measured on the same
sample: as many as give ``RECALL`` and ``KEPT`` of its true neighbours. ``VectorIndex.search`` then counts, from stored counts by list and tag, how many rows these
lists offer, takes more lists until they are enough, and scans all rows exactly where that reads less.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenframe.operators import knn
from lumenframe.sources.store import shared_folder

BLOCK_ROWS = 4096
LIST_ROWS = 1_000_000  # of one list in a task
BLOCKS = "list int, n int, ids array<long>, codes binary, tags map<string,binary>"
FEW = 200_000
RECALL, NEIGHBOURS, MEASURED = 0.96, 10, 500
KEPT = 0.98
#: Queries that a task looks up at a time, whose best rows it holds.
GROUP = 512


def lists_needed(points: np.ndarray, centres: np.ndarray, own: np.ndarray) -> int:
    """In how many of the lists nearest to a vector ``RECALL`` of its nearest others lie, on average over ``MEASURED`` of the points."""
    asked = np.linspace(0, len(points) - 1, min(MEASURED, len(points))).astype(int)
    if len(points) < 2:
        return 1
    score = points[asked] @ points.T
    score[np.arange(len(asked)), asked] = -np.inf
    k = min(NEIGHBOURS, len(points) - 1)
    best = np.argpartition(-score, k - 1, axis=1)[:, :k]
    order = np.argsort(-(points[asked] @ centres.T), axis=1, kind="stable")
    place = np.empty_like(order)
    np.put_along_axis(place, order, np.arange(len(centres))[None, :], 1)
    reached = np.take_along_axis(place, own[best], 1)
    return int(np.argmax([(reached < p).mean() >= RECALL for p in range(1, len(centres) + 1)])) + 1


def rows_needed(points: np.ndarray, centres: np.ndarray, own: np.ndarray, books: np.ndarray, n: int) -> int:
    """How many times ``k`` rows by their codes a search must score exactly, so that ``KEPT`` of the true neighbours are among them.

    The codes' order is measured on the sample. There stand for the ``NEIGHBOURS`` of ``n`` rows as many fewer, and
    for a place in the codes' order as many more rows, as the sample is smaller. Never under 10.
    """
    asked = np.linspace(0, len(points) - 1, min(MEASURED, len(points))).astype(int)
    if len(points) < 2:
        return 10
    parts, _, size = books.shape
    rest = points - centres[own]
    coded = centres[own] + np.concatenate([books[p][nearest(rest[:, p * size : (p + 1) * size], books[p])] for p in range(parts)], axis=1)
    scale = max(1.0, n / len(points))
    k = min(max(1, round(NEIGHBOURS / scale)), len(points) - 1)
    places = []
    for a in range(0, len(asked), 100):
        q = asked[a : a + 100]
        score, again = points[q] @ points.T, points[q] @ coded.T
        for m in (score, again):
            m[np.arange(len(q)), q] = -np.inf
        for best in np.argpartition(-score, k - 1, axis=1)[:, :k].T:
            places.append((again > np.take_along_axis(again, best[:, None], 1)).sum(axis=1) + 1)
    return max(10, int(np.ceil(np.quantile(np.concatenate(places), KEPT) * scale / NEIGHBOURS)))


def code_words(residuals: np.ndarray, parts: int, words: int = 256, rounds: int = 8) -> np.ndarray:
    """(parts, words, size of a part): k-means in each part of the residuals."""
    size = residuals.shape[1] // parts
    words = max(1, min(words, len(residuals)))
    out = np.zeros((parts, words, size))
    for p in range(parts):
        x = residuals[:, p * size : (p + 1) * size]
        book = x[np.linspace(0, len(x) - 1, words).astype(int)].copy()
        for _ in range(rounds):
            own = nearest(x, book)
            sums = np.zeros_like(book)
            np.add.at(sums, own, x)
            n = np.bincount(own, minlength=words)
            book[n > 0] = sums[n > 0] / n[n > 0, None]
        out[p] = book
    return out


def nearest(x: np.ndarray, book: np.ndarray) -> np.ndarray:
    return ((book**2).sum(axis=1) - 2 * x @ book.T).argmin(axis=1)


@dataclass
class VectorIndex:
    """An index in a folder; ``centres`` (lists, size) and ``books`` are small and bounded by the parameters of ``build``."""

    spark: SparkSession
    folder: str
    centres: np.ndarray
    books: np.ndarray
    probes: int = 1
    refine: int = 10

    @staticmethod
    def build(collection: DataFrame, folder: str | None = None, lists: int = 64, parts: int = 16, sample: int = 20_000) -> VectorIndex:
        """Indexes ``collection`` (id, vector and, if there are, tags), one row an id; vectors that aren't of the commonest length or hold a null aren't comparable and stay out."""
        spark = collection.sparkSession
        folder = folder or shared_folder(spark, "index")
        sizes = collection.where("vector is not null").groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), "n").first()
        size = sizes["n"] if sizes else 0
        rows = collection.where((F.size("vector") == size) & ~F.exists("vector", F.isnull) & F.col("id").isNotNull())
        tags = F.coalesce("tags", F.array()) if "tags" in collection.columns else F.array()
        plain = rows.select(F.col("id").cast("long").alias("id"), F.col("vector").cast("array<float>").alias("vector"), tags.cast("array<string>").alias("tags"))
        centres = knn.fit_lists(plain, lists, sample) if size else np.zeros((0, 0))
        parts = next((p for p in range(min(parts, size), 0, -1) if size % p == 0), 1)
        drawn = knn.lowest(plain.select("vector", F.xxhash64("id").alias("h")), sample).collect()
        points = knn._unit([r["vector"] for r in drawn]) if drawn else np.zeros((0, size))
        own = (points @ centres.T).argmax(axis=1) if len(points) else np.zeros(0, int)
        books = code_words(points - centres[own], parts) if len(points) else np.zeros((1, 1, max(1, size)))
        probes = lists_needed(points, centres, own)
        refine = rows_needed(points, centres, own, books, plain.count()) if len(points) else 10
        model = [("probes", probes, 0, []), ("refine", refine, 0, []), *(("centre", k, 0, c.tolist()) for k, c in enumerate(centres)), *(("word", w, p, books[p, w].tolist()) for p in range(books.shape[0]) for w in range(books.shape[1]))]
        spark.createDataFrame(model, "kind string, no int, part int, vector array<double>").coalesce(1).write.parquet(f"{folder}/model")
        index = VectorIndex(spark, folder, centres, books, probes, refine)
        index._write(plain)
        return index

    @staticmethod
    def open(spark: SparkSession, folder: str) -> VectorIndex:
        rows = spark.read.parquet(f"{folder}/model").orderBy("kind", "part", "no").collect()
        centres = np.array([r["vector"] for r in rows if r["kind"] == "centre"])
        words = [r for r in rows if r["kind"] == "word"]
        parts = max(r["part"] for r in words) + 1
        return VectorIndex(spark, folder, centres.reshape(len(centres), -1), np.array([r["vector"] for r in words]).reshape(parts, len(words) // parts, -1), *(next((r["no"] for r in rows if r["kind"] == kind), least) for kind, least in (("probes", 1), ("refine", 10))))

    def _write(self, plain: DataFrame) -> None:
        centres, books = self.centres, self.books

        def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                unit = knn._unit(batch.column("vector").flatten().to_numpy().reshape(-1, centres.shape[1]))
                own = (unit @ centres.T).argmax(axis=1).astype(np.int32)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(own)], names=[*batch.schema.names, "list"])

        def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                lists = batch.column("list").to_numpy()
                edges = np.flatnonzero(np.diff(lists, prepend=lists[0] - 1)) if len(lists) else []
                for a, z in zip(edges, [*edges[1:], len(lists)], strict=True):
                    for at in range(a, z, BLOCK_ROWS):
                        part = batch.slice(at, min(BLOCK_ROWS, z - at))
                        rest = knn._unit(part.column("vector").flatten().to_numpy().reshape(-1, centres.shape[1])) - centres[lists[at]]
                        size = books.shape[2]
                        codes = np.stack([nearest(rest[:, p * size : (p + 1) * size], books[p]) for p in range(len(books))], axis=1).astype(np.uint8)
                        bits: dict[str, np.ndarray] = {}
                        for row, tags in enumerate(part.column("tags").to_pylist()):
                            for t in tags:
                                if t is not None:
                                    bits.setdefault(t, np.zeros(part.num_rows, bool))[row] = True
                        packed = [(t, np.packbits(b).tobytes()) for t, b in sorted(bits.items())]
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([lists[at]], pa.int32()), pa.array([part.num_rows], pa.int32()), pa.array([part.column("id").to_pylist()], pa.list_(pa.int64())), pa.array([codes.tobytes()], pa.binary()), pa.array([packed], pa.map_(pa.string(), pa.binary()))],
                            names=["list", "n", "ids", "codes", "tags"],
                        )

        own = f"{self.folder}/vectors"
        if not len(centres):
            self.spark.createDataFrame([], "list int, tag string, n long").write.parquet(f"{self.folder}/counts")
            return
        placed = plain.mapInArrow(place, "id long, vector array<float>, tags array<string>, list int")
        placed.write.parquet(f"{self.folder}/placed")
        placed = self.spark.read.parquet(f"{self.folder}/placed")
        tag = F.explode(F.concat(F.array(F.lit(None).cast("string")), F.array_distinct("tags")))
        placed.select("list", tag.alias("tag")).groupBy("list", "tag").agg(F.count("*").alias("n")).write.parquet(f"{self.folder}/counts")
        large = {r["list"]: -(-r["n"] // LIST_ROWS) for r in self._counts(None).collect()}
        salts = F.create_map(*(F.lit(x) for pair in large.items() for x in pair))
        dealt = placed.withColumn("__salt", F.pmod(F.xxhash64("id"), salts[F.col("list")].cast("long"))).repartition("list", "__salt").sortWithinPartitions("list", "id").drop("__salt")
        dealt.write.partitionBy("list").parquet(own)
        dealt.mapInArrow(blocks, BLOCKS).write.partitionBy("list").parquet(f"{self.folder}/blocks")

    def _counts(self, tags: list[str] | None) -> DataFrame:
        """Rows by list (list, n); of those with any of the tags, at most."""
        counts = self.spark.read.schema("list int, tag string, n long").parquet(f"{self.folder}/counts")
        every = counts.where("tag is null").select("list", "n")
        if not tags:
            return every
        some = counts.where(F.col("tag").isin(tags)).groupBy("list").agg(F.sum("n").alias("s"))
        return every.join(some, "list").select("list", F.least("n", "s").alias("n"))

    def vectors(self) -> DataFrame:
        """id, vector, tags, list of every indexed row."""
        columns = "id long, vector array<float>, tags array<string>, list int"
        return self.spark.read.schema(columns).parquet(f"{self.folder}/vectors") if len(self.centres) else self.spark.createDataFrame([], columns)

    def blocks(self) -> DataFrame:
        return self.spark.read.schema("n int, ids array<long>, codes binary, tags map<string,binary>, list int").parquet(f"{self.folder}/blocks")

    def planned(self, matrix: np.ndarray, k: int, tags: list[str] | None = None, probes: int | None = None, refine: int | None = None, depth: int = 8, always: bool = False) -> np.ndarray | None:
        """Which lists each query reads (queries, lists); None where an exact scan reads fewer bytes.

        At least ``probes`` lists (default: those measured), and on until they are expected to hold
        ``depth * k`` rows with the tags. ``always``: lists whatever they cost.
        """
        refine = refine or self.refine
        n, every = np.zeros(len(self.centres)), np.zeros(len(self.centres))
        for counts, rows in ((n, self._counts(tags)), (every, self._counts(None))):
            for r in rows.collect():  # a row a list
                counts[r["list"]] = r["n"]
        order = np.argsort(-(matrix @ self.centres.T), axis=1, kind="stable")
        offered = np.cumsum(n[order], axis=1)
        take = np.maximum(probes or self.probes, (offered < depth * k).sum(axis=1) + 1)
        reads = np.zeros((len(matrix), len(n)), bool)
        np.put_along_axis(reads, order, np.arange(len(n))[None, :] < take[:, None], 1)
        rows = every[reads.any(axis=0)].sum()
        whole = 4 * self.centres.shape[1]
        cost = rows * (len(self.books) + 8) + min(len(matrix) * refine * k, rows) * whole
        return None if cost >= every.sum() * whole and not always else reads

    def search(self, queries: DataFrame | list, k: int, tags: list[str] | None = None, probes: int | None = None, refine: int | None = None, digits: int = 6, always: bool = False) -> DataFrame:
        """query_id, id, score, rank as ``knn.search``; only rows with any of the ``tags``, if some are given."""
        wanted, refine = [t for t in tags or []], refine or self.refine
        hits = None
        for ids, matrix in queries if isinstance(queries, list) else knn.shipments(queries):
            reads = self.planned(matrix, k, wanted, probes, refine, always=always) if matrix.shape[1] == self.centres.shape[1] else np.zeros((len(matrix), 0), bool)
            if reads is None:
                rows = self.vectors()
                rows = rows.where(F.arrays_overlap("tags", F.array(*(F.lit(t) for t in wanted)))) if wanted else rows
                found = knn.search(rows.select("id", "vector"), [(ids, matrix)], k, digits).drop("rank")
            elif reads.any():
                found = self._through_lists(ids, matrix, reads, k, wanted, refine, digits)
            else:
                continue
            hits = found if hits is None else hits.unionByName(found)
        return knn._ranked(self.spark.createDataFrame([], knn.HITS) if hits is None else hits, k)

    def _through_lists(self, ids: np.ndarray, matrix: np.ndarray, reads: np.ndarray, k: int, tags: list[str], refine: int, digits: int) -> DataFrame:
        shipped = self.spark.sparkContext.broadcast((ids, matrix, reads, self.centres, self.books))
        lists = np.flatnonzero(reads.any(axis=0)).tolist()
        most = refine * k

        def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, matrix, reads, centres, books = shipped.value
            parts, words, size = books.shape
            group, held = -1, {}

            def flush() -> pa.RecordBatch:
                sizes = [len(h[0]) for h in held.values()]
                return pa.RecordBatch.from_arrays([pa.array(np.repeat(ids[list(held)], sizes)), *(pa.array(np.concatenate([h[c] for h in held.values()])) for c in (1, 0, 2))], names=["query_id", "id", "score", "list"])

            for batch in batches:
                for n, row, codes, bits, own, g in zip(*(batch.column(c).to_pylist() for c in ("n", "ids", "codes", "tags", "list", "g")), strict=True):
                    if g != group:
                        if held:
                            yield flush()
                        group, held = g, {}
                    some = np.arange(n)
                    if tags:
                        maps = [np.frombuffer(b, np.uint8) for t, b in bits if t in tags]
                        if not maps:
                            continue
                        some = np.flatnonzero(np.unpackbits(np.bitwise_or.reduce(maps), count=n))
                    code = np.frombuffer(codes, np.uint8).reshape(n, parts)[some]
                    coded = centres[own] + np.concatenate([books[p][code[:, p]] for p in range(parts)], axis=1)
                    here, who = np.array(row)[some], g * GROUP + np.flatnonzero(reads[g * GROUP : (g + 1) * GROUP, own])
                    if not len(who):
                        continue
                    score = matrix[who] @ coded.T
                    top, found = knn._best(score, np.broadcast_to(here, score.shape), most)
                    for w, s, i in zip(who.tolist(), top, found, strict=True):
                        old = held.get(w, (np.zeros(0), np.zeros(0, np.int64), np.zeros(0, np.int32)))
                        scores, known, of = np.concatenate([old[0], s]), np.concatenate([old[1], i]), np.concatenate([old[2], np.full(len(i), own, np.int32)])
                        order = np.lexsort((known, -scores))[:most]
                        held[w] = scores[order], known[order], of[order]
            if held:
                yield flush()

        def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, matrix = shipped.value[:2]
            order = np.argsort(ids)
            for batch in batches:
                if batch.num_rows:
                    at = order[np.searchsorted(ids[order], batch.column("query_id").to_numpy())]
                    unit = knn._unit(batch.column("vector").flatten().to_numpy().reshape(batch.num_rows, -1))
                    yield pa.RecordBatch.from_arrays([batch.column("query_id"), batch.column("id"), pa.array(np.round((matrix[at] * unit).sum(axis=1), digits))], names=["query_id", "id", "score"])

        blocks = self.blocks().where(F.col("list").isin(lists))
        if tags:  # blocks without any of them aren't sent to Python
            blocks = blocks.where(F.exists(F.array(*(F.lit(t) for t in tags)), lambda t: F.map_contains_key(F.col("tags"), t)))
        groups = -(-len(ids) // GROUP)
        blocks = blocks.select("n", "ids", "codes", "tags", "list", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("g"))
        if groups > 1:  # a task has all blocks of some groups, one after the other, and sends on a query's best rows only once
            blocks = blocks.repartition(groups, "g").sortWithinPartitions("g")
        close = blocks.mapInArrow(near, knn.HITS + ", list int")
        close = knn._ranked(close, most).select("query_id", "id", "list")
        rows = self.vectors().where(F.col("list").isin(lists)).select("list", "id", "vector")
        joined = rows.join(F.broadcast(close) if len(ids) * most <= FEW else close, ["list", "id"])
        return joined.select("query_id", "id", "vector").mapInArrow(exact, knn.HITS)
