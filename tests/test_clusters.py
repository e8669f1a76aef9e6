import random

import pytest
from pyspark.sql import functions as F

from lumenframe.operators import ranking


def fold(rows, window):
    """Sorted rows (timestamp, score, id) of one path, one after the other."""
    kept, last = [], None
    low = lambda s: float("-inf") if s is None else s
    for t, s, i in sorted(rows, key=lambda r: (r[0] or 0.0, r[1] is not None, -low(r[1]) if r[1] is not None else 0, r[2])):
        t = t or 0.0
        if last is None or not abs(t - last[0]) <= window:
            kept += [last] if last else []
            last = (t, s, i)
        elif s is not None and last[1] is not None and s > last[1]:
            last = (t, s, i)
    return sorted(k[2] for k in [*kept, last] if k)


def made(kind, n, rng):
    if kind == "even":
        return [(float(k), 0.5, k) for k in range(n)]
    if kind == "rising":
        return [(k * 0.5, k / n, k) for k in range(n)]
    if kind == "tenths":
        return [(k * 0.1, rng.randint(0, 9) / 10, k) for k in range(n)]
    if kind == "one time":
        return [(1.0, rng.random(), k) for k in range(n)]
    return [(rng.choice([None, rng.random() * n / 3, float(rng.randint(0, n // 3))]), rng.choice([None, rng.random(), 0.5]), k) for k in range(n)]


@pytest.mark.parametrize("kind", ["even", "rising", "tenths", "one time", "mixed"])
@pytest.mark.parametrize("piece", [1, 7, 100])
def test_pieces_fold_as_one(spark, kind, piece):
    rng = random.Random(f"{kind}{piece}")
    paths = {"hot": made(kind, 700, rng), None: made(kind, 150, rng), "b": made(kind, 5, rng)}
    rows = [(p, t, s, i, f"{p}/{i}") for p, some in paths.items() for t, s, i in some]
    frames = spark.createDataFrame(rows, "`a.path` string, timestamp double, score double, id long, shown string").repartition(3)
    got = ranking.cluster_in_time(frames, 1.1, ["a.path"], ["shown"], piece).collect()
    for p, some in paths.items():
        mine = [r for r in got if r["a.path"] == p]
        assert sorted(r["id"] for r in mine) == fold(some, 1.1), p
        assert all(r["shown"] == f"{p}/{r['id']}" for r in mine)
        assert {(r["id"], r["timestamp"], r["score"]) for r in mine} <= {(i, t or 0.0, s) for t, s, i in some}


def test_empty(spark):
    none = spark.createDataFrame([], "path string, timestamp double, score double, id long")
    assert ranking.cluster_in_time(none, 5.0, piece_rows=1).count() == 0


def test_one_long_path_is_many_tasks_work(spark):
    """Equal scores: folds from different frames never meet, so every entry counts."""
    n = 400_000
    frames = spark.range(n).select(F.lit("p").alias("path"), F.col("id").cast("double").alias("timestamp"), F.lit(0.5).alias("score"), "id")
    got = ranking.cluster_in_time(frames, 6.0, piece_rows=50_000)
    assert got.agg(F.count("*"), F.max(F.col("id") % 7)).first() == ((n + 6) // 7, 0)
