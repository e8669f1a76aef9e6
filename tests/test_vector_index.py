import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenframe.operators import knn
from lumenframe.operators import vector_index as V
from lumenframe.plans import search as plan


def clustered(n, size=16, centres=24, seed=1):
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(centres, size))
    return middle[rng.integers(0, centres, n)] + 0.25 * rng.normal(size=(n, size))


@pytest.fixture(scope="module")
def library(spark, tmp_path_factory):
    rows = [(i, [float(x) for x in v], [f"t{i % 3}", "all"] if i % 7 else None) for i, v in enumerate(clustered(5000))]
    odd = [(9001, [1.0, 2.0], ["t1"]), (9002, None, ["t1"]), (9003, [0.0] * 16, []), (9004, [None] * 16, ["t1"])]
    v = spark.createDataFrame(rows + odd, "id long, vector array<float>, tags array<string>").cache()
    folder = f"file://{tmp_path_factory.mktemp('index')}/v"
    return v, V.VectorIndex.build(v, folder, lists=32, parts=4, sample=3000)


@pytest.mark.parametrize("tags", [None, ["t1"], ["t0", "t2"], ["none"]])
def test_recall_with_and_without_tags(library, tags):
    v, index = library
    asked = v.where("id % 50 = 0")
    rows = v.where(F.arrays_overlap("tags", F.array(*(F.lit(t) for t in tags)))) if tags else v
    exact = knn.search(rows, asked, 10).cache()
    found = index.search(asked, 10, tags, always=True).cache()
    if tags == ["none"]:
        assert found.count() == exact.count() == 0
        return
    assert knn.recall(found, exact).first()[0] >= 0.9
    scores = found.join(exact.select("query_id", "id", F.col("score").alias("s")), ["query_id", "id"])
    assert scores.where("abs(score - s) > 2e-6").count() == 0
    assert found.join(rows.select("id"), "id", "left_anti").count() == 0
    assert index.search(asked, 10, tags, probes=32, refine=600, always=True).select("query_id", "rank", "id").subtract(exact.select("query_id", "rank", "id")).count() == 0


def test_other_lists_are_not_read(library):
    v, index = library
    one = v.where("id = 77")
    ids, matrix = next(knn.shipments(one))
    lists = np.flatnonzero(index.planned(matrix, 10)[0]).tolist()
    assert 0 < len(lists) < 32
    read = index.blocks().where(F.col("list").isin(lists))
    plan_text = index.search(one, 10)._jdf.queryExecution().toString()
    assert plan_text.count("PartitionFilters: [list") >= 2  # of blocks and of vectors
    files = {r["f"] for r in read.select(F.input_file_name().alias("f")).collect()}
    every = {r["f"] for r in index.blocks().select(F.input_file_name().alias("f")).collect()}
    assert len(files) < len(every)


def test_planner(library):
    v, index = library
    _, matrix = next(knn.shipments(v.where("id = 77")))
    assert index.planned(matrix, 10) is not None
    assert index.planned(matrix, 100_000) is None  # all of it: the exact scan reads less
    few = index.planned(matrix, 10, ["t1"])
    assert few.sum() >= index.planned(matrix, 10).sum()


def test_opened_again(spark, library):
    v, index = library
    again = V.VectorIndex.open(spark, index.folder)
    assert np.allclose(again.centres, index.centres) and np.allclose(again.books, index.books) and again.probes == index.probes
    asked = v.where("id in (1, 2)")
    rows = lambda x: sorted(map(tuple, x.search(asked, 5).collect()))
    assert rows(again) == rows(index)


def test_every_comparable_row_is_indexed(library):
    v, index = library
    assert index.vectors().count() == 5001  # the zero vector too
    assert index.blocks().agg(F.sum("n")).first()[0] == 5001


def test_empty_and_other_sizes(spark, library):
    none = V.VectorIndex.build(spark.createDataFrame([], "id long, vector array<float>"))
    assert none.search(library[0].where("id = 1"), 5).count() == 0
    short = spark.createDataFrame([(1, [1.0, 2.0])], "id long, vector array<float>")
    assert library[1].search(short, 5).count() == 0


def test_a_list_in_several_tasks(spark, monkeypatch):
    monkeypatch.setattr(V, "LIST_ROWS", 100)
    v = spark.createDataFrame([(i, [float(x) for x in row]) for i, row in enumerate(clustered(900, 8, 2))], "id long, vector array<float>")
    index = V.VectorIndex.build(v, lists=2, parts=4)
    assert index.vectors().count() == 900
    exact = knn.search(v, v.where("id < 20"), 5)
    assert knn.recall(index.search(v.where("id < 20"), 5, always=True), exact).first()[0] >= 0.9


def test_search_plan_uses_it(spark, library):
    v, index = library
    points = v.where("tags is not null").withColumn("media_id", F.col("id"))
    asked = v.where("id in (10, 20)").select("id", "vector")
    request = plan.Request(retrieve=10, tags=["t1"])
    exact, _ = plan.retrieve({"image": points}, asked, request)
    through, _ = plan.retrieve({"image": (points, index)}, asked, request)
    found = through.select("query_id", "id").join(exact.select("query_id", "id"), ["query_id", "id"]).count()
    assert found >= 0.9 * exact.count() > 0
    assert through.columns == exact.columns


def test_recall_of_coarse_codes(spark):
    rows = [(i, v.tolist()) for i, v in enumerate(np.random.default_rng(3).normal(size=(6000, 16)))]
    v = spark.createDataFrame(rows, "id long, vector array<float>")
    index = V.VectorIndex.build(v, lists=8, parts=2, sample=1500)
    asked = v.where("id % 10 = 0")  # more than a group of queries
    assert index.refine > 10 and V.VectorIndex.open(spark, index.folder).refine == index.refine
    exact = knn.search(v, asked, 10)
    assert knn.recall(index.search(asked, 10, always=True), exact).first()[0] >= 0.9


def test_sample_is_that_of_lowest_hash(spark):
    rows = spark.range(20_000).select("id", F.xxhash64("id").alias("h"))
    assert {r["id"] for r in knn.lowest(rows, 500).collect()} == {r["id"] for r in rows.orderBy("h").limit(500).collect()}
    bound = [x for x in knn.lowest(rows, 500)._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Filter" in x]
    assert bound and knn.lowest(rows.limit(30), 500).count() == 30
