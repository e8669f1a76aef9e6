import json

import pytest
from pyspark.sql import functions as F

from lumenframe.operators import versioned as V
from lumenframe.plans.api import Library
from lumenframe.sources import store

SCHEMA = "k long, name string, n int"


@pytest.fixture()
def table(spark, tmp_path):
    made, created = V.KeyedTable.ensure(spark, f"file://{tmp_path}/t", SCHEMA, ["k"], 8)
    assert created
    return made.upsert(spark.createDataFrame([(i, f"n{i}", i) for i in range(100)], SCHEMA))


def rows(t):
    return {r["k"]: (r["name"], r["n"]) for r in t.read().collect()}


def test_one_key_rewrites_one_bucket(spark, table):
    later = table.upsert(spark.createDataFrame([(5, "five")], "k long, name string"))
    differs = {b for b, p in later.version.folders.items() if table.version.folders.get(b) != p}
    assert len(differs) == 1 and len(later.version.folders) == 8
    assert rows(later) == rows(table) | {5: ("five", 5)}  # n isn't given and stays
    assert rows(V.KeyedTable.open(spark, table.folder, table.version.number)) == rows(table)


def test_upsert_against_a_dict(spark, table):
    want, t = rows(table), table
    for step in range(4):
        new = {k: (f"s{step}", k * step) for k in range(step, 140, 7 + step)}
        t = t.upsert(spark.createDataFrame([(k, *v) for k, v in new.items()], SCHEMA))
        want |= new
        gone = list(range(step, 140, 11))
        t = t.delete(spark.createDataFrame([(k,) for k in gone], "k long"))
        want = {k: v for k, v in want.items() if k not in gone}
        assert rows(t) == rows(V.KeyedTable.open(spark, t.folder)) == want


def test_update_columns_and_stamps(spark, table):
    given = spark.createDataFrame([(1, "n1", 1), (2, "two", 2), (900, "new", 9)], SCHEMA)
    stamped, _ = V.KeyedTable.ensure(spark, table.folder + "s", "k long, name string, n int, seq long", ["k"], 4)
    stamped = stamped.upsert(table.read(), stamp=("seq", 1))
    again = stamped.upsert(given, stamp=("seq", 2))
    assert {r["k"]: r["seq"] for r in again.read().where("k in (1, 2, 3, 900)").collect()} == {1: 1, 2: 2, 3: 1, 900: 2}
    kept = table.upsert(spark.createDataFrame([(1, "x", 77), (901, "y", 78)], SCHEMA), update=["n"])
    assert rows(kept)[1] == ("n1", 77) and rows(kept)[901] == ("y", 78)
    known = kept.update(spark.createDataFrame([(1, 5), (902, 6)], "k long, n int"))
    assert rows(known)[1] == ("n1", 5) and rows(known)[901] == ("y", 78) and 902 not in rows(known)


def test_natural_keys(spark, tmp_path):
    t, _ = V.KeyedTable.ensure(spark, f"file://{tmp_path}/n", "source string, path string, n int", ["source", "path"], 4)
    t = t.upsert(spark.createDataFrame([("a", "x", 1), ("b", "x", 2), ("a", None, 3)], "source string, path string, n int").where("path is not null"))
    t = t.upsert(spark.createDataFrame([("a", "x", 9)], "source string, path string, n int"))
    assert sorted(map(tuple, t.read().collect())) == [("a", "x", 9), ("b", "x", 2)]


def test_crash_before_the_manifest(spark, table, monkeypatch):
    before = rows(table)

    def crash(*a):
        raise RuntimeError("power cut")

    monkeypatch.setattr(store, "put_new", crash)
    with pytest.raises(RuntimeError):
        table.upsert(spark.createDataFrame([(1, "lost", 0)], SCHEMA), marks={"exported": 9})
    monkeypatch.undo()
    again = V.KeyedTable.open(spark, table.folder)
    assert again.version == table.version and rows(again) == before and again.marks == {}
    assert again.vacuum() == 1 and rows(V.KeyedTable.open(spark, table.folder)) == before


def test_two_writers(spark, table):
    first = table.upsert(spark.createDataFrame([(1, "first", 0)], SCHEMA))
    with pytest.raises(V.Conflict):
        table.upsert(spark.createDataFrame([(1, "second", 0)], SCHEMA))
    assert rows(V.KeyedTable.open(spark, table.folder)) == rows(first)
    tried = []

    def step(t):
        tried.append(t.version.number)
        if len(tried) == 1:  # another writer is first
            t.mark(seen=1)
        return t.upsert(spark.createDataFrame([(2, "third", 0)], SCHEMA))

    done = V.change(spark, table.folder, step)
    assert len(tried) == 2 and rows(done) == rows(first) | {2: ("third", 0)} and done.marks == {"seen": 1}


def test_created_and_recreated(spark, table):
    same, created = V.KeyedTable.ensure(spark, table.folder, SCHEMA, ["k"])
    assert not created and rows(same) == rows(table)
    other, created = V.KeyedTable.ensure(spark, table.folder, SCHEMA + ", more string", ["k"])
    assert created and other.read().count() == 0 and other.version.number == table.version.number + 1


def test_export_with_its_watermark(spark, tmp_path, monkeypatch):
    points, _ = V.KeyedTable.ensure(spark, f"file://{tmp_path}/p", "point_id long, v string", ["point_id"], 4)
    make = lambda some: spark.createDataFrame(some, "point_id long, v string")
    none = make([]).select("point_id")
    points = V.export_into(points, make([(i, "a") for i in range(20)]), none, 3)
    monkeypatch.setattr(store, "put_new", lambda *a: (_ for _ in ()).throw(RuntimeError("power cut")))
    with pytest.raises(RuntimeError):
        V.export_into(points, make([(1, "b")]), none, 4)
    monkeypatch.undo()
    points = V.KeyedTable.open(spark, points.folder)
    assert points.marks == {"exported": 3}
    points = V.export_into(points, make([(1, "b"), (2, "b")]), make([(2, ""), (3, "")]).select("point_id"), 4)
    assert points.marks == {"exported": 4}
    assert {r["point_id"]: r["v"] for r in points.read().collect()} == {i: "b" if i == 1 else "a" for i in range(20) if i not in (2, 3)}


def test_empty_changes(spark, table):
    none = spark.createDataFrame([], SCHEMA)
    same = table.upsert(none).delete(none)
    assert rows(same) == rows(table)
    empty = same.delete(table.read().select("k"))
    assert rows(empty) == {} and empty.version.folders == {}
    assert json.loads(store.get_text(spark, f"{table.folder}/versions/{empty.version.number:012d}.json"))["number"] == empty.version.number


def test_many_labels_keep_the_plan_short(spark, tmp_path):
    faces = spark.createDataFrame([(f"f{i}", i % 5, None) for i in range(30)], "face_id string, media_id long, person_id long")
    people = spark.createDataFrame([(1, "A")], "person_id long, name string")
    stored, _ = V.KeyedTable.ensure(spark, f"file://{tmp_path}/faces", faces.schema, ["face_id"], 4)
    library = Library({"media": people, "faces": faces, "people": people, "media_tags": people}, stored={"faces": stored.overwrite(faces)})
    for k in range(12):
        changed = library.label(spark.createDataFrame([(f"f{k}", 1)], "face_id string, person_id long"))
        assert changed.count() == 1
    assert "Join" not in library.t["faces"]._jdf.queryExecution().optimizedPlan().toString()
    assert library.t["faces"].where("person_id = 1").count() == 12
    assert V.KeyedTable.open(spark, stored.folder).read().where(F.col("person_id") == 1).count() == 12
