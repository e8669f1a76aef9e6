import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenframe.operators import similarity_join as join
from lumenframe.operators.knn import _unit


def clustered(n, seed, size=16):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, size))
    own = np.where(rng.random(n) < 0.4, 0, rng.integers(0, 12, n))  # one cluster holds two fifths
    return centres[own] + 0.15 * rng.normal(size=(n, size))


@pytest.mark.parametrize(("least", "tile"), [(0.9, 20), (0.3, 50), (0.95, 1000), (-1.0, 100), (1.0, 30)])
def test_equals_all_products(spark, least, tile):
    matrix = clustered(400, 3)
    matrix[7], matrix[9] = matrix[5], 0.0
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(matrix)], "id long, vector array<double>").repartition(3)
    got = {(r["a"], r["b"]): r["score"] for r in join.similar_pairs(df, least, tile_rows=tile, pivots=8).collect()}
    score = np.round(_unit(matrix) @ _unit(matrix).T, 6)
    want = {(a, b) for a, b in zip(*np.nonzero(np.triu(score >= least, 1)), strict=True)}
    assert set(got) == want and all(abs(got[p] - score[p]) <= 1e-6 for p in want)
    if least == 1.0:
        assert (5, 7) in want


def test_tiles_that_lie_apart_are_skipped(spark):
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(clustered(1500, 5))], "id long, vector array<double>")
    tiled = join.tiles(df, 40)
    pairs = join.tile_pairs(tiled, 0.9).groupBy("kept").count().collect()
    n = {r["kept"]: r["count"] for r in pairs}
    assert n[False] > n[True] and tiled.select(F.max(F.length("ids"))).first()[0] < 8 * 400


def test_odd_rows(spark):
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (2, [3.0, 0.0]), (3, None), (4, []), (5, [1.0, None]), (None, [1.0, 0.0]), (6, [1.0, 0.0, 0.0]), (7, [4.0, 0.0, 0.0]), (8, [0.0, 0.0])]
    df = spark.createDataFrame(rows, "id long, vector array<double>")
    assert sorted(map(tuple, join.similar_pairs(df, 0.9, tile_rows=1).collect())) == [(1, 2, 1.0), (1, 2, 1.0), (6, 7, 1.0)]
    assert join.similar_pairs(df.limit(0), 0.9).count() == 0


def test_a_tile_is_not_sent_to_each_other_tile(spark):
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(clustered(400, 6))], "id long, vector array<double>")
    found = join.similar_pairs(df, -1.0, tile_rows=8, pivots=2)
    assert found.count() == 400 * 399 // 2
    sent = found._jdf.queryExecution().optimizedPlan()
    while "MapInArrow" in sent.nodeName():
        sent = sent.children().head()
    rows = spark._jvm.org.apache.spark.sql.classic.Dataset.ofRows(spark._jsparkSession, sent).count()
    assert rows < 50 * 50 / 4  # 50 tiles or more, all of which meet
