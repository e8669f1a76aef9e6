import random

import pytest
from pyspark.sql import functions as F

from lumenframe.operators import ingest, reports, running, tables


def made(seed, n=3000):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        g = rng.choice(["hot"] * 8 + ["b", "c", None])
        rows.append((g, rng.choice([1, 5, rng.randint(0, 10**9)]), i, rng.choice([None, rng.randint(-50, 50)]), 7))
    return rows


@pytest.mark.parametrize("piece", [1, 37, 500, 10**6])
def test_running_sums_and_rows_before(spark, piece):
    rows = made(piece)
    df = spark.createDataFrame(rows, "g string, t long, id long, `v.x` long, __n int").repartition(5)
    got = running.running(df, ["g"], ["t", "id"], {"s": F.col("`v.x`"), "k": F.lit(1)}, piece)
    got = running.previous(got, ["g"], ["t", "id"], "v.x", "before", piece)
    found = {r["id"]: (r["s"], r["k"], r["before"]) for r in got.collect()}
    want = {}
    for g in {r[0] for r in rows}:
        s, k, before = 0, 0, None
        for _, _, i, v, _ in sorted((r for r in rows if r[0] == g), key=lambda r: r[1:3]):
            s, k = s + (v or 0), k + 1
            want[i] = (s, k, before)
            before = v
    assert found == want


def test_pieces_are_bounded(spark):
    df = spark.range(50_000).select(F.lit("one").alias("g"), "id")
    sizes = [r["n"] for r in running.in_pieces(df, ["g"], ["id"], 1000).groupBy(running.KEY, running.PIECE).agg(F.count("*").alias("n")).collect()]
    assert sum(sizes) == 50_000 and len(sizes) >= 40 and max(sizes) <= 4000


def test_no_piece_has_more_rows_than_asked_for(spark):
    df = spark.range(50_000).select(F.lit("one").alias("g"), "id")
    cut = running.in_pieces(df.repartition(7), ["g"], ["id"], 700)
    pieces = cut.groupBy(running.PIECE).agg(F.count("*").alias("n"), F.min("id").alias("a"), F.max("id").alias("z")).orderBy("a").collect()
    assert max(r["n"] for r in pieces) <= 700 and [r[running.PIECE] for r in pieces] == sorted(r[running.PIECE] for r in pieces)
    assert all(x["z"] < y["a"] for x, y in zip(pieces, pieces[1:], strict=False))


def test_only_pieces_with_a_place_are_read_again(spark):
    df = spark.range(2000).select(F.lit("one").alias("g"), "id")
    found = running.at_places(df, ["g"], "id", {"p": F.floor(F.col("n") / 2)}, 10)
    joins = [x for x in found._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join Inner" in x]
    assert joins and all(running.PIECE in x for x in joins) and found.first()["p"] == 1000


@pytest.mark.parametrize("piece", [1, 20, 10**6])
def test_places(spark, monkeypatch, piece):
    monkeypatch.setattr(running, "PIECE_ROWS", piece)
    rng = random.Random(piece)
    rows = [(rng.choice("ab"), rng.choice([3.0, 3.0, rng.random() * 100, None])) for _ in range(900)] + [("a", 1e12), ("c", 5.0), (None, 2.0), ("d", None)]
    got = {r["g"]: (r["n"], r["p50"], r["p95"], r["longest"]) for r in reports.latency(spark.createDataFrame(rows, "g string, v double"), ["g"], "v").collect()}
    want = {}
    for g in {r[0] for r in rows}:
        v = sorted(x for h, x in rows if h == g and x is not None)
        if v:
            want[g] = (len(v), v[len(v) // 2], v[min(len(v) - 1, len(v) * 95 // 100)], v[-1])
    assert got == want


def test_operators_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(running, "PIECE_ROWS", 50)
    files = spark.range(1000).select(F.lit("s").alias("source_name"), F.format_string("p%05d", "id").alias("rel_path"), "id")
    assert all(r["batch"] == r["id"] // 30 for r in ingest.commit_groups(files, 30).collect())
    shown = spark.range(500).select(F.lit(1).alias("search_id"), F.col("id").alias("media_id"), F.when(F.col("id") % 9 != 0, F.col("id") % 40).alias("score"))
    order = sorted(range(500), key=lambda i: (-(i % 40) if i % 9 else float("inf"), i))
    assert {r["media_id"]: r["position"] for r in tables.ledger_positions(shown).collect()} == {i: k for k, i in enumerate(order)}
    times = spark.range(300).select(F.lit(1).alias("g"), (F.col("id") * F.col("id")).cast("double").alias("t"))
    assert sorted(r["gap"] for r in reports.gaps(times, ["g"], "t").where("gap is not null").collect()) == [2.0 * i + 1 for i in range(299)]


def test_empty(spark):
    none = spark.createDataFrame([], "g string, t long, v long")
    assert running.running(none, ["g"], ["t"], {"s": "v"}).count() == 0
    assert running.previous(none, [], ["t"], "v", "b").count() == 0
    assert reports.latency(none, ["g"], "v").count() == 0
