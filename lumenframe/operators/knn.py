"""Nearest neighbours by cosine, for a batch of query vectors: exact, or through an index.

Queries are few next to the collection: they go to the tasks as one matrix, in one scan of the
collection for each ``SHIPPED`` bytes of them; each task multiplies its rows with them block by block
and passes on only its best ``k`` of each query, so that a query moves ``k`` rows a task and the
collection itself isn't shuffled. An index spares the products with rows that are far off.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 512  # queries that are multiplied at a time, so that a product and what picks from it take some 50 MB
ROWS = 2000  # and rows of the collection
SHIPPED = 256 << 20  # bytes of queries that tasks hold
HITS = "query_id long, id long, score double"


def _unit(rows) -> np.ndarray:
    m = np.asarray(rows, np.float64)
    n = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, n, out=np.zeros_like(m), where=n > 0)


def _matrix(part: pa.RecordBatch, size: int) -> np.ndarray:
    return part.column("vector").flatten().to_numpy(zero_copy_only=False).reshape(-1, size)


def _best(score: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``k`` of each row by falling score, then id; ``ids`` of the same shape."""
    if score.shape[1] > 2 * k:
        least = np.partition(score, score.shape[1] - k, axis=1)[:, -k][:, None]
        width = int((score >= least).sum(axis=1).max())  # ties of the last place stay until ids decide
        some = np.argpartition(-score, width - 1, axis=1)[:, :width]
        score, ids = np.take_along_axis(score, some, 1), np.take_along_axis(ids, some, 1)
    order = np.lexsort((ids, -score), axis=1)[:, :k]
    return np.take_along_axis(score, order, 1), np.take_along_axis(ids, order, 1)


def search(collection: DataFrame, queries: DataFrame | list, k: int, digits: int = 6, min_score: float | None = None) -> DataFrame:
    """query_id, id, score, rank of each query's ``k`` best; ``collection`` and ``queries`` have (id, vector), or ``queries`` are ``shipments``.

    Scores are rounded to ``digits``, ties go to the lower id. Null vectors and vectors of another
    length than the queries' take no part, zero vectors score 0. An empty side gives no rows.
    """

    def best(ids: np.ndarray, matrix: np.ndarray, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = [slice(a, a + BLOCK) for a in range(0, len(ids), BLOCK)]
        held = [(np.full((len(ids[b]), 0), -np.inf), np.zeros((len(ids[b]), 0), np.int64)) for b in blocks]
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                rows, own = _unit(_matrix(part, matrix.shape[1])).T, part.column("id").to_numpy()
                for n, b in enumerate(blocks):
                    score = np.round(matrix[b] @ rows, digits)
                    both = np.concatenate([held[n][0], score], axis=1), np.concatenate([held[n][1], np.broadcast_to(own, score.shape)], axis=1)
                    held[n] = _best(*both, k)
        for b, (score, found) in zip(blocks, held, strict=True):
            if found.shape[1]:
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids[b], found.shape[1])), pa.array(found.ravel()), pa.array(score.ravel())], names=["query_id", "id", "score"])

    hits = _scans(collection, queries, best)
    if min_score is not None:
        hits = hits.where(F.col("score") >= min_score)
    return _ranked(hits, k)


def _ranked(hits: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return hits.withColumn("rank", rank).where(F.col("rank") <= k)


def within(collection: DataFrame, queries: DataFrame, min_score: float, digits: int = 6) -> DataFrame:
    """query_id, id, score of every vector whose score for a query is at least ``min_score``; vectors as for ``search``."""

    def near(ids: np.ndarray, matrix: np.ndarray, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                rows, own = _unit(_matrix(part, matrix.shape[1])).T, part.column("id").to_numpy()
                for a in range(0, len(ids), BLOCK):
                    score = np.round(matrix[a : a + BLOCK] @ rows, digits)
                    q, r = np.nonzero(score >= min_score)
                    yield pa.RecordBatch.from_arrays([pa.array(ids[a + q]), pa.array(own[r]), pa.array(score[q, r])], names=["query_id", "id", "score"])

    return _scans(collection, queries, near)


def _scans(collection: DataFrame, queries: DataFrame | list, work: Callable) -> DataFrame:
    """``work`` (ids, unit vectors, batches) over the collection, once for each ``SHIPPED`` bytes of queries."""
    hits = None
    for ids, matrix in queries if isinstance(queries, list) else shipments(queries):
        shipped = collection.sparkSession.sparkContext.broadcast((ids, matrix))

        def run(batches: Iterator[pa.RecordBatch], shipped=shipped) -> Iterator[pa.RecordBatch]:
            yield from work(*shipped.value, batches)

        found = _comparable(collection, matrix.shape[1]).mapInArrow(run, HITS)
        hits = found if hits is None else hits.unionByName(found)
    return collection.sparkSession.createDataFrame([], HITS) if hits is None else hits


def _comparable(collection: DataFrame, size: int) -> DataFrame:
    return collection.where(F.col("id").isNotNull() & (F.size("vector") == size) & ~F.exists("vector", F.isnull)).select(F.col("id").cast("long").alias("id"), "vector")


def shipments(queries: DataFrame) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Ids and unit vectors of the queries, ``SHIPPED`` bytes at a time. Queries of one length only, that of the most queries."""
    asked = queries.where("id is not null and vector is not null").select(F.col("id").cast("long").alias("id"), "vector")
    sizes = asked.groupBy(F.size("vector").alias("size")).count().where("size > 0").collect()
    if not sizes:
        return
    size, n = max((r["size"], r["count"]) for r in sizes if r["count"] == max(x["count"] for x in sizes))
    asked = asked.where(F.size("vector") == size)
    parts = -(-n * size * 8 // SHIPPED)
    for k in range(parts):
        some = asked if parts == 1 else asked.where(F.pmod(F.xxhash64("id"), F.lit(parts)) == k)
        table = some.toArrow()
        if table.num_rows:
            vectors = table.column("vector").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, size)
            yield table.column("id").to_numpy(), _unit(vectors)


def lowest(rows: DataFrame, sample: int) -> DataFrame:
    """The ``sample`` rows of lowest ``h``, a hash of 64 bits; rows above a bound that leaves a few more aren't sent to be ordered."""
    n = rows.count()
    share = (sample + 6 * sample**0.5 + 20) / max(n, 1)
    few = rows if share >= 1 else rows.where(F.col("h") <= int(share * 2.0**64) - (1 << 63))
    return few.orderBy("h").limit(sample)


def fit_lists(collection: DataFrame, lists: int = 64, sample: int = 20_000, rounds: int = 10) -> np.ndarray:
    """Unit centres of an index's lists: spherical k-means over the ``sample`` vectors of lowest hash, which bounds the driver's part."""
    rows = collection.where("id is not null and vector is not null").select("vector", F.xxhash64("id").alias("h"))
    size = rows.select(F.size("vector").alias("n")).first()
    if size is None:
        return np.zeros((0, 0))
    points = _unit([r["vector"] for r in lowest(rows.where(F.size("vector") == size["n"]), sample).collect()])
    centres = points[np.linspace(0, len(points) - 1, min(lists, len(points))).astype(int)]
    for _ in range(rounds):
        own = (points @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, points)
        full = np.bincount(own, minlength=len(centres)) > 0
        centres[full] = _unit(sums[full])
    return centres


def indexed(collection: DataFrame, centres: np.ndarray) -> DataFrame:
    """Every comparable row of ``collection`` with the list it belongs to: id, vector, list. Write it partitioned by list to read few lists."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = (_unit(_matrix(batch, centres.shape[1])) @ centres.T).argmax(axis=1)
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("vector"), pa.array(own.astype(np.int32))], names=["id", "vector", "list"])

    kind = collection.schema["vector"].dataType.simpleString()
    return _comparable(collection, centres.shape[1]).mapInArrow(place, f"id long, vector {kind}, list int")


def search_index(index: DataFrame, centres: np.ndarray, queries: DataFrame, k: int, probes: int = 16, digits: int = 6) -> DataFrame:
    """As ``search``, from each query's ``probes`` nearest lists only; rows of an index table of other lists aren't read."""

    def best(ids: np.ndarray, matrix: np.ndarray, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = np.zeros((len(ids), len(centres)), bool)
        np.put_along_axis(asked, np.argsort(-(matrix @ centres.T), axis=1)[:, :probes], True, 1)
        held = [(np.zeros(0), np.zeros(0, np.int64))] * len(ids)  # scores and ids of each query's best
        for batch in batches:
            rows, own, lists = _unit(_matrix(batch, matrix.shape[1])), batch.column("id").to_numpy(), batch.column("list").to_numpy()
            for n in np.unique(lists):
                here, who = np.flatnonzero(lists == n), np.flatnonzero(asked[:, n])
                for a in range(0, len(who), BLOCK):
                    score = np.round(matrix[who[a : a + BLOCK]] @ rows[here].T, digits)
                    top, found = _best(score, np.broadcast_to(own[here], score.shape), k)
                    for q, s, i in zip(who[a : a + BLOCK].tolist(), top, found, strict=True):
                        scores, known = np.concatenate([held[q][0], s]), np.concatenate([held[q][1], i])
                        order = np.lexsort((known, -scores))[:k]
                        held[q] = scores[order], known[order]
        sizes = [len(x) for x, _ in held]
        if sum(sizes):
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, sizes)), pa.array(np.concatenate([i for _, i in held])), pa.array(np.concatenate([x for x, _ in held]))], names=["query_id", "id", "score"])

    hits = None
    for ids, matrix in shipments(queries):
        shipped = index.sparkSession.sparkContext.broadcast((ids, matrix))
        wanted = np.unique(np.argsort(-(matrix @ centres.T), axis=1)[:, :probes]).tolist()

        def run(batches: Iterator[pa.RecordBatch], shipped=shipped) -> Iterator[pa.RecordBatch]:
            yield from best(*shipped.value, batches)

        found = index.where(F.col("list").isin(wanted)).select("id", "vector", "list").mapInArrow(run, HITS)
        hits = found if hits is None else hits.unionByName(found)
    return _ranked(index.sparkSession.createDataFrame([], HITS) if hits is None else hits, k)


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """The share of ``exact``'s (query_id, id) that ``found`` has: recall."""
    hit = exact.select("query_id", "id").join(found.select("query_id", "id", F.lit(1).alias("hit")), ["query_id", "id"], "left")
    return hit.agg((F.count("hit") / F.count("*")).alias("recall"))


def retrieved(points: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    """Points by id, each once however often it is asked for; unknown ids give none."""
    return points.join(ids.select(key).distinct(), key, "left_semi")


def counted(points: DataFrame, equal: dict | None = None) -> DataFrame:
    """How many points there are, all or those whose payload fields are ``equal``: n."""
    return matching(points, equal or {}).agg(F.count("*").alias("n"))


def matching(points: DataFrame, equal: dict) -> DataFrame:
    for field, value in equal.items():
        points = points.where(F.col(f"payload.{field}").eqNullSafe(F.lit(value)))
    return points


def scrolled(points: DataFrame, equal: dict, after=None, limit: int = 100, key: str = "id") -> DataFrame:
    """A page of the points whose payload fields are ``equal``, by id, from the one after ``after`` on."""
    rows = matching(points, equal)
    rows = rows if after is None else rows.where(F.col(key) > F.lit(after))
    return rows.orderBy(key).limit(limit)


def missing_queries(ids: DataFrame, collection: DataFrame) -> DataFrame:
    """Asked ids (id) that the collection has no vector for."""
    return ids.join(collection.where("vector is not null").select("id"), "id", "left_anti")


def principal_components(collection: DataFrame, k: int = 2) -> DataFrame:
    """(id, components): projections on the first ``k`` principal components."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    rows = collection.where("vector is not null").select("id", array_to_vector(F.col("vector").cast("array<double>")).alias("features"))
    model = PCA(k=k, inputCol="features", outputCol="reduced").fit(rows)
    return model.transform(rows).select("id", vector_to_array("reduced").alias("components"))


def suggestions(hits: DataFrame, people: DataFrame, top: int = 5, digits: int = 6) -> DataFrame:
    """People of a query's neighbours, by number of neighbours, then mean similarity.

    ``hits``: query_id, score, person_id (null: nobody); ``people``: person_id, name.
    """
    millionths = F.sum(F.round(F.col("score") * 1000000).cast("long"))  # whole numbers add up alike in any order
    groups = hits.where("person_id is not null").groupBy("query_id", "person_id").agg(F.count("*").alias("n"), F.round(millionths / F.count("*") / 1000000, digits).alias("mean_score"))
    ranked = groups.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("n"), F.desc("mean_score"), "person_id")))
    return ranked.where(F.col("rank") <= top).join(people, "person_id", "left")
