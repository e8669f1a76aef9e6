"""Operators on hand-written rows."""

import time
from datetime import date

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenframe.functions import ids, media, models, query_text, vector
from lumenframe.operators import browse, cdc, filters, ingest, knn, ranking, reports, tables, tracks


def one(spark, **columns):
    row = spark.range(1).select(*(c.alias(n) for n, c in columns.items())).first()
    return row.asDict()


# --- functions ---


def test_point_ids_keep_63_bits(spark):
    r = one(spark, a=ids.image_point_id(F.lit("abcdefghij")), b=ids.image_point_id(F.lit("é" * 8)), k=ids.keyframe_point_id(F.lit("abcdefgh"), F.lit(258), F.lit(3)), f=ids.face_point_id(F.lit("x")))
    assert r["a"] == int.from_bytes(b"abcdefgh", "big") & (2**63 - 1)
    assert r["k"] == ((int.from_bytes(b"abcdef", "big") << 16) | (2 << 8) | 3) & (2**63 - 1)
    assert all(0 <= v < 2**63 for v in r.values())


def test_paths(spark):
    r = one(spark, rel=ids.relative_path(F.lit("/a/b"), F.lit("/a/b/c/d.jpg")), out=ids.relative_path(F.lit("/a/b"), F.lit("/a/bc/d.jpg")), show=ids.display_path(F.lit("/mnt/d/x/y")), back=ids.mounted_path(F.lit("D:\\x\\y")), same=ids.display_path(F.lit("/home/x")))
    assert list(r.values()) == ["c/d.jpg", "d.jpg", "D:\\x\\y", "/mnt/d/x/y", "/home/x"]


def test_media_values(spark):
    r = one(spark, exif=media.exif_time(F.lit("2023:06:15 10:00:00")), bad=media.exif_time(F.lit("soon")), gps=media.gps_time(F.lit("2026:02:27 01:17:13.200")), dms=media.decimal_degrees(F.lit(10.0), F.lit(30.0), F.lit(0.0), F.lit("s")), ms=media.duration_seconds(F.lit("350ms")), no=media.duration_seconds(F.lit("fast")), short=media.short_id(F.lit("abcdefgh")), cam=media.is_action_camera(F.lit("/v/GX010001.MP4")), labels=media.labels_of(F.array(F.lit("tvmonitor"), F.lit("cat"), F.lit("tv"))), size=media.size_text(F.lit(2048)), thumb=media.thumbnail_size(F.lit(1024), F.lit(768)), box=media.crop_box(F.lit(0.0), F.lit(0.5), F.lit(0.5), F.lit(0.5), F.lit(100), F.lit(200)))
    assert (r["exif"], r["bad"], r["gps"], r["dms"], r["ms"], r["no"], r["short"], r["cam"], r["labels"], r["size"]) == ("2023-06-15T10:00:00", None, "2026-02-27T01:17:13.200Z", -10.5, 0.35, None, "ab..gh", True, ["cat", "tv"], "2.0 KB")
    assert tuple(r["thumb"]) == (512, 384) and tuple(r["box"]) == (0, 80, 60, 200)


@pytest.mark.parametrize(
    ("text", "visual", "first"),
    [("beach photos from 2016", "beach photos from", "2016-01-01"), ("Rajeev in Hawaii last year", "Rajeev in Hawaii", "2025-01-01"), ("trip 10 years ago", "trip", "2016-01-01"), ("2015 or 2016", "2015 or 2016", None), (None, "", None)],
)
def test_date_intent(spark, text, visual, first):
    got = one(spark, d=query_text.date_intent(F.lit(text).cast("string"), date(2026, 3, 30)))["d"]
    assert (got["visual_query"], got["date_from"]) == (visual, first)


@pytest.mark.parametrize(
    ("text", "names", "people", "visual"),
    [("walking on beach with John", ["John"], ["John"], "walking beach"), ("John Smith in Hawaii", ["John", "John Smith"], ["John Smith"], "hawaii"), ("Rajeev", ["Rajeev", " "], ["Rajeev"], "Rajeev"), ("a.b (c)", ["a.b"], ["a.b"], "c")],
)
def test_decompose(spark, text, names, people, visual):
    got = one(spark, d=query_text.decompose(F.lit(text), F.array(*(F.lit(n) for n in names))))["d"]
    assert (got["people"], got["visual_query"]) == (people, visual)


def test_face_names_and_vectors(spark):
    zero, a = F.array(F.lit(0.0), F.lit(0.0)), F.array(F.lit(3.0), F.lit(4.0))
    r = one(spark, n=query_text.face_names(F.lit("Kumar (0.95), John,, ")), z=vector.cosine(zero, a), s=vector.cosine(a, a), m=vector.same_face(zero, a), u=vector.normalised(a))
    assert r["n"] == ["kumar", "john"] and r["z"] is None and r["s"] == pytest.approx(1) and tuple(r["m"]) == (0.0, False)
    assert r["u"] == pytest.approx([0.6, 0.8])


# --- retrieval and ranking ---


def test_knn_ties_nulls_and_zero_vectors(spark):
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [0.0, 0.0]), (4, None), (5, [-1.0, 0.0]), (6, [1.0]), (None, [1.0, 1.0])]
    v = spark.createDataFrame(rows, "id long, vector array<double>")
    q = v.where("id in (1, 4)")
    got = [tuple(r) for r in knn.search(v, q, 3).orderBy("rank").select("query_id", "id", "score").collect()]
    assert got == [(1, 1, 1.0), (1, 2, 1.0), (1, 3, 0.0)]
    assert sorted(map(tuple, knn.within(v, q, 0.0).collect())) == [(1, 1, 1.0), (1, 2, 1.0), (1, 3, 0.0)]
    assert knn.search(v, q.limit(0), 3).count() == 0 and knn.search(v.limit(0), q, 3).count() == 0
    assert [r["id"] for r in knn.missing_queries(spark.createDataFrame([(1,), (4,), (9,)], "id long"), v).orderBy("id").collect()] == [4, 9]


def test_suggestions_count_before_mean(spark):
    hits = spark.createDataFrame([(0, 0.9, 1), (0, 0.8, 1), (0, 0.95, 2), (0, 0.99, None)], "query_id long, score double, person_id long")
    got = knn.suggestions(hits, spark.createDataFrame([(1, "a"), (2, "b")], "person_id long, name string")).orderBy("rank").collect()
    assert [(r["person_id"], r["n"], r["mean_score"]) for r in got] == [(1, 2, 0.85), (2, 1, 0.95)]


def test_merge_keeps_evidence(spark):
    rows = [(1, "image", 0, 0.31, 1), (1, "caption", 2, 0.22, 1), (2, "speech", 3, 0.40, 1), (3, "video", 1, 0.2, 1), (3, "image", 0, 0.2, 2), (3, "video", 1, 0.1, 3)]
    got = {r["id"]: r for r in ranking.merge(spark.createDataFrame(rows, "id long, source string, source_order int, score double, rank int")).collect()}
    assert got[1]["source_scores"] == {"image": 0.31, "caption": 0.22} and (got[1]["score"], got[1]["source"]) == (0.31, "image")
    assert got[3]["source"] == "image" and got[3]["source_scores"] == {"image": 0.2, "video": 0.2}


def test_people_lift_scores(spark):
    rows = [(1, 0.75, "x", "image"), (2, 0.72, "Rajeev (0.98)", "image"), (3, 0.5, None, "person_expand"), (4, 0.0, None, "person_expand"), (5, -0.4, "rajeev", "image")]
    c = spark.createDataFrame(rows, "id long, score double, faces string, source string").withColumn("source_scores", F.create_map(F.col("source"), F.col("score")))
    got = ranking.ranked(c, ["Rajeev "], 10).collect()
    assert [(r["id"], r["total_score"]) for r in got] == [(2, 0.9), (1, 0.75), (3, 0.75), (4, 0.0), (5, -0.5)]


FRAMES = [("a", 10.0, 0.80, 1), ("a", 12.0, 0.85, 2), ("a", 25.5, 0.70, 3), ("b", 11.0, 0.60, 4), ("c", 0.0, 0.1, 5), ("c", 4.0, 0.2, 6), ("c", 8.0, 0.3, 7), ("d", 0.0, 0.3, 8), ("d", 4.0, 0.2, 9), ("d", 8.0, 0.1, 10), ("e", None, 0.1, 11), ("e", None, 0.2, 12)]


@pytest.mark.parametrize("chunk", [256, 1, 2])
def test_clusters_move_with_their_frame(spark, monkeypatch, chunk):
    monkeypatch.setattr(ranking, "CHUNK", chunk)
    frames = spark.createDataFrame([*FRAMES, (None, 1.0, 0.5, 13), (None, 2.0, 0.6, 14)], "path string, timestamp double, score double, id long")
    assert sorted(r["id"] for r in ranking.cluster_in_time(frames, 5.0).collect()) == [2, 3, 4, 7, 8, 10, 12, 14]


def test_long_paths_and_tracks_take_time_in_proportion(spark):
    """100,000 rows of one path, and of one track, without a gap; quadratic plans took minutes."""
    began = time.perf_counter()
    rows = spark.range(100_000).select(F.lit("p").alias("path"), (F.col("id") * 1.0).alias("timestamp"), (F.xxhash64("id") % 1000 / 1000.0).alias("score"), "id")
    last, want = None, 0
    for t, s in rows.orderBy("timestamp").select("timestamp", "score").collect():
        if last and abs(t - last[0]) <= 5.0:
            last = (t, s) if s > last[1] else last
        else:
            last, want = (t, s), want + 1
    assert ranking.cluster_in_time(rows, 5.0).count() == want
    samples = spark.range(100_000).select(F.lit("t").alias("track"), (F.col("id") * 2.0).alias("t"), (F.col("id") * 2.0).alias("gps_lat"), F.lit(0.0).alias("gps_lon"), F.lit(None).cast("double").alias("gps_alt"), F.lit("").alias("gps_datetime_utc"), F.lit(3).alias("gps_fix"))
    targets = spark.range(50_000).select(F.lit("t").alias("track"), F.col("id").alias("target_id"), (F.col("id") * 4.0 + 1).alias("t"))
    assert tracks.sample_at(targets, samples, 1.0, 2.0).where("abs(gps_lat - t) > 1e-6 or gps_source != 'interpolated'").count() == 0
    assert time.perf_counter() - began < 120


@pytest.mark.parametrize(("model", "order"), [(lambda r: r["f"], [2, 3, 1]), (lambda r: r["f"] * np.nan, [1, 2, 3]), (lambda r: r["f"][:1], [1, 2, 3]), (lambda r: 1 / 0, [1, 2, 3])])
def test_rerank_falls_back(spark, model, order):
    rows = spark.createDataFrame([(0, 1, 1, 0.9, 0.1), (0, 2, 2, 0.8, 0.9), (0, 3, 3, 0.7, 0.5)], "query_id long, id long, rank int, total_score double, f double")
    got = ranking.learned_rerank(rows, model, ["f"]).orderBy("rank").collect()
    assert [r["id"] for r in got] == order and {r["id"]: r["heuristic_score"] for r in got} == {1: 0.9, 2: 0.8, 3: 0.7}


# --- filters ---


def test_filters(spark):
    d = F.lit("2016-12-31T10:00:00")
    none = F.lit(None).cast("string")
    r = one(spark, late=filters.within_dates(d, None, "2016-12-31"), null_last=filters.within_dates(none, None, "2016"), null_first=filters.within_dates(none, "2016", None), any_case=filters.any_of(F.array(F.lit("Beach")), ["beach"]), no_wish=filters.any_of(none.cast("array<string>"), []), place=filters.in_place([none, F.lit("Hawaii")], ["waii"]), kind=filters.kind_by_name(F.lit("/x.WEBP"), "image"), odd=filters.kind_by_name(F.lit("/x.webm"), "video"), nul=filters.kind_by_name(none, "image"), image=filters.video_only(F.lit("image"), F.lit(None).cast("double"), F.lit(0.0), F.lit(0.0), (0, 1), 5), video=filters.video_only(F.lit("video"), F.lit(3.0), F.lit(0.0), F.lit(9.0), None, 0, 8))
    assert list(r.values()) == [False, True, False, True, True, True, True, False, False, True, False]


def test_unknown_ids_stay(spark):
    c = spark.createDataFrame([("a",), ("b",), ("z",)], "id string")
    m = spark.createDataFrame([("a", 1), ("b", 0)], "media_id string, deleted int")
    assert sorted(r["id"] for r in filters.without_deleted(c, m).collect()) == ["b", "z"]


# --- browse ---


def test_people_modes(spark):
    m = spark.createDataFrame([(k,) for k in (1, 2, 3, 4)], "media_id int")
    f = spark.createDataFrame([("f1", 1, 1), ("f2", 2, 1), ("f3", 2, 2), ("f4", 4, 2), ("f5", 4, 3), ("f6", 3, None)], "face_id string, media_id int, person_id int")
    p = spark.createDataFrame([(1, "Alice"), (2, "Bob"), (3, "Carol")], "person_id int, name string")
    ask = lambda names, mode: sorted(r[0] for r in browse.with_people(m, f, p, names, mode).select("media_id").collect())
    assert ask(["Alice"], "any") == [1, 2] and ask(["Alice", "Bob"], "all") == [2] and ask(["Alice"], "only") == [1] and ask(["Alice", "Bob"], "what") == [1, 2, 4]


def test_unique_faces_across_sections(spark):
    m = spark.createDataFrame([(1, 0), (2, 1)], "media_id int, deleted int")
    f = spark.createDataFrame([("f1", 1, 1, 0.9), ("f2", 1, 1, 0.95), ("f3", 1, 2, 0.8), ("u1", 1, None, 0.7), ("u2", 1, None, 0.75), ("g", 2, None, 0.99)], "face_id string, media_id int, person_id int, confidence double")
    p = spark.createDataFrame([(1, "zoe"), (2, "Adam"), (3, "none")], "person_id int, name string")
    u = browse.unique_faces(f, p, m)
    assert [r["face_id"] for r in browse.unique_faces_page(u, 2, 1).orderBy("rank").collect()] == ["f2", "u2"]
    assert browse.unique_faces_count(u).first()[0] == 4
    assert {r["name"]: (r["face_count"], r["face_id"]) for r in browse.people_list(p, f, m).collect()} == {"zoe": (2, "f2"), "Adam": (1, "f3"), "none": (0, None)}


# --- tracks ---


@pytest.mark.parametrize(
    ("samples", "t", "lat", "source"),
    [([(0, 10), (10, 20)], 5.0, 15.0, "interpolated"), ([(1, 1), (2, 3)], 0.5, 1.0, "nearest"), ([(1, 1), (2, 3)], 2.5, 3.0, "nearest"), ([(1, 1), (2, 3)], 9.0, None, None), ([(5, 1), (5, 3)], 5.0, 1.0, "nearest"), ([(0, 0), (2.5, 5)], 2.0, 5.0, "nearest"), ([], 1.0, None, None)],
)
def test_position_at(spark, samples, t, lat, source):
    rows = [("v", float(a), float(b), 0.0, None, "", 3) for a, b in samples]
    s = spark.createDataFrame(rows, "track string, t double, gps_lat double, gps_lon double, gps_alt double, gps_datetime_utc string, gps_fix int")
    got = tracks.sample_at(spark.createDataFrame([("v", 1, t)], "track string, target_id int, t double"), s, 1.0, 10.0 if t == 5.0 and samples and samples[0][0] == 0 else 2.0).first()
    assert (got["gps_lat"], got["gps_source"]) == (lat, source)


def test_nearest_place(spark):
    rng = np.random.default_rng(3)
    where = lambda n: np.column_stack([np.degrees(np.arcsin(rng.uniform(-1, 1, n))), rng.uniform(-180, 180, n)]).round(3)
    gazetteer = [*where(150).tolist(), [89.9, 10.0], [-89.5, 170.0], [10.5, -179.9], [0.0, 0.0], [0.0, 0.0]] + (where(40) / 50 + [45, 7]).round(3).tolist()
    points = [*where(300).tolist(), [90.0, 0.0], [-90.0, 5.0], [10.4, 179.99], [0.0, 180.0], [89.95, -170.0], [None, 1.0]]
    g = spark.createDataFrame([(f"p{k:03}", "a", "X", a, o) for k, (a, o) in enumerate(gazetteer)], "name string, admin1 string, cc string, lat double, lon double")
    p = spark.createDataFrame([(k, a, o) for k, (a, o) in enumerate(points)], "id int, lat double, lon double")
    got = {r["id"]: r["place"] for r in tracks.nearest_place(p, g).collect()}

    def km(a, o, b, q):
        x = np.sin(np.radians(b - a) / 2) ** 2 + np.cos(np.radians(a)) * np.cos(np.radians(b)) * np.sin(np.radians(q - o) / 2) ** 2
        return round(2 * 6371.0 * np.arcsin(np.sqrt(min(1.0, x))), 6)

    want = {k: None if a is None else min((km(a, o, b, q), f"p{n:03}, a, X") for n, (b, q) in enumerate(gazetteer))[1] for k, (a, o) in enumerate(points)}
    assert got == want
    assert {r["place"] for r in tracks.nearest_place(p, g.limit(0)).collect()} == {None}


def test_index_recalls_what_is_near(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(40, 16))
    rows = [(k, (centres[k % 40] + 0.4 * rng.normal(size=16)).tolist()) for k in range(4000)]
    v = spark.createDataFrame([*rows, (9000, None), (9001, [1.0])], "id long, vector array<double>")
    lists = knn.fit_lists(v, 32, 1000)
    index = knn.indexed(v, lists)
    assert index.count() == 4000
    asked = v.where("id % 20 = 0 and size(vector) = 16")
    exact = knn.search(v, asked, 10)
    assert knn.recall(knn.search_index(index, lists, asked, 10, 8), exact).first()[0] >= 0.9
    assert knn.recall(knn.search_index(index, lists, asked, 10, 32), exact).first()[0] == 1.0


def test_one_answer_whatever_the_blocks(spark, monkeypatch):
    rows = [(k, [float(k % 7), float(k % 5), 1.0]) for k in range(300)]
    v = spark.createDataFrame(rows, "id long, vector array<double>")
    want = sorted(map(tuple, knn.search(v, v.where("id < 40"), 4).collect()))
    near = sorted(map(tuple, knn.within(v, v.where("id < 40"), 0.99).collect()))
    monkeypatch.setattr(knn, "BLOCK", 7)
    monkeypatch.setattr(knn, "ROWS", 11)
    monkeypatch.setattr(knn, "SHIPPED", 400)
    assert sorted(map(tuple, knn.search(v, v.where("id < 40"), 4).collect())) == want and len(want) == 160
    assert sorted(map(tuple, knn.within(v, v.where("id < 40"), 0.99).collect())) == near


def test_principal_components(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(200, 5)) @ rng.normal(size=(5, 5))
    got = np.array([r["components"] for r in knn.principal_components(spark.createDataFrame([(k, r.tolist()) for k, r in enumerate(x)], "id long, vector array<double>"), 2).orderBy("id").collect()])
    _, vectors = np.linalg.eigh(np.cov(x.T))
    want = x @ vectors[:, ::-1][:, :2]
    assert np.allclose(np.abs(got), np.abs(want), atol=1e-6)


def test_shots_and_export_of_videos_by_name(spark):
    rows = spark.createDataFrame([("v", b"ab"), ("w", b"")], "media_id string, content binary")
    got = models.detected_shots(rows, lambda: lambda content: [(2.0, 5.0), (0.0, 2.0), (5.0, 5.0)] if content else []).collect()
    assert [tuple(r) for r in got] == [("v", 0, 0.0, 2.0), ("v", 1, 2.0, 5.0)]
    media_rows = spark.createDataFrame([("aaaaaaaa", "/x.MP4", None, 0), ("bbbbbbbb", "/x", None, 0), ("cccccccc", "/y.jpg", "image/jpeg", 1), ("dddddddd", "/z.jpg", "image/jpeg", 0)], "media_id string, path string, mime string, deleted int").selectExpr("*", "'p' place", "cast(null as string) ts_utc", "'t' added_at")
    vectors = media_rows.selectExpr("media_id", "array(1f) embedding", "5L updated_seq")
    tags = spark.createDataFrame([("dddddddd", "b"), ("dddddddd", "a")], "media_id string, tag string")
    assert sorted((r["media_id"], tuple(r["payload"]["tags"])) for r in cdc.image_points(media_rows, vectors, tags).collect()) == [("bbbbbbbb", ()), ("dddddddd", ("a", "b"))]


# --- tables, ingest, export ---


def test_upsert_touches_given_columns_only(spark):
    t = spark.createDataFrame([(1, "a", 1.0), (2, "b", 2.0)], "k int, name string, v double")
    n = spark.createDataFrame([(2, None), (3, "c")], "k int, name string")
    assert sorted(map(tuple, tables.upsert(t, n, ["k"]).collect())) == [(1, "a", 1.0), (2, None, 2.0), (3, "c", None)]
    both = spark.createDataFrame([(1, "z", 9.0), (4, "d", 4.0)], "k int, name string, v double")
    assert sorted(map(tuple, tables.upsert(t, both, ["k"], ["v"]).collect())) == [(1, "a", 9.0), (2, "b", 2.0), (4, "d", 4.0)]
    assert sorted(map(tuple, tables.update_fields(t, n, ["k"]).collect()), key=str) == [(1, "a", 1.0), (2, None, 2.0)]


def test_people_changes(spark):
    p = spark.createDataFrame([(1, "Ann"), (2, "Bob")], "person_id int, name string")
    f = spark.createDataFrame([("x", 1), ("y", 2), ("z", None)], "face_id string, person_id int")
    assert sorted(r["name"] for r in tables.create_people(p, spark.createDataFrame([(3, "Bob"), (5, "Cid"), (4, "Cid"), (6, " ")], "person_id int, name string")).collect()) == ["Ann", "Bob", "Cid"]
    with pytest.raises(ValueError):
        tables.rename_person(p, 1, "Bob")
    with pytest.raises(ValueError):
        tables.merge_people(p, f, 1, 1)
    people, faces = tables.merge_people(p, f, 2, 1)
    assert [r["person_id"] for r in people.collect()] == [1] and sorted(map(tuple, faces.collect())) == [("x", 1), ("y", 1), ("z", None)]
    faces, changed = tables.label_faces(f, spark.createDataFrame([("x", None), ("z", 2), ("y", 2), ("q", 1)], "face_id string, person_id int"))
    assert sorted(map(tuple, faces.collect())) == [("x", None), ("y", 2), ("z", 2)] and sorted(r["face_id"] for r in changed.collect()) == ["x", "z"]


SNAP = "source_name string, rel_path string, size_bytes long, mtime_ns long, media_id string"
STATE = SNAP + ", last_seen_scan_id long, missing_since_scan_id long"
MEDIA = "media_id string, source_name string, rel_path string, deleted int, missing_since_scan_id long"


def test_scan_decisions(spark):
    state = spark.createDataFrame([("s", p, 1, 1, m, 1, None) for p, m in [("hit", "A"), ("touch", "B"), ("repl", "C"), ("old", "D"), ("swap1", "E"), ("swap2", "F")]], STATE)
    media = spark.createDataFrame([(m, "s", p, d, miss) for m, p, d, miss in [("A", "hit", 0, None), ("B", "touch", 0, None), ("C", "repl", 0, None), ("D", "old", 0, 1), ("E", "swap1", 0, None), ("F", "swap2", 0, None), ("G", "gone", 1, None)]], MEDIA)
    snap = spark.createDataFrame([("s", "hit", 1, 1, "A"), ("s", "touch", 1, 2, "B"), ("s", "repl", 2, 2, "N"), ("s", "new place", 1, 1, "D"), ("s", "copy", 1, 1, "A"), ("s", "fresh", 1, 1, "M"), ("s", "back", 1, 1, "G"), ("s", "swap1", 2, 2, "F"), ("s", "swap2", 2, 2, "E")], SNAP)
    got = {r["rel_path"]: r for r in ingest.classify(snap, state, media).collect()}
    assert {p: r["decision"] for p, r in got.items()} == {"hit": "hit", "touch": "refreshed", "repl": "new", "new place": "move", "copy": "copy", "fresh": "new", "back": "resurrected", "swap1": "move", "swap2": "move"}
    assert got["repl"]["replaced"] and got["repl"]["old_id"] == "C" and got["new place"]["grace_cleared"] and not got["fresh"]["replaced"]
    decisions = ingest.classify(snap, state, media)
    assert [r[0] for r in ingest.superseded(decisions, media).collect()] == ["C"]
    assert ingest.counters(decisions).first()["hashed"] == 8
    assert ingest.needs_hash(snap, state).where("known_id is null").count() == 8


def test_two_scans_to_delete(spark):
    state = spark.createDataFrame([("s", "seen", 1, 1, "A", 5, None), ("s", "miss", 1, 1, "B", 4, None), ("s", "gone", 1, 1, "C", 3, 4), ("s", "gone2", 1, 1, "D", 3, 4), ("s", "kept2", 1, 1, "D", 5, None), ("t", "err", 1, 1, "E", 3, 4)], STATE)
    media = spark.createDataFrame([(m, "s", "p", 0, None) for m in "ABCDE"], MEDIA)
    swept = ingest.swept(state, 5, spark.createDataFrame([("s",)], "source_name string"))
    assert {r["rel_path"]: r["action"] for r in swept.collect()} == {"seen": "keep", "miss": "grace", "gone": "delete", "gone2": "delete", "kept2": "keep", "err": "keep"}
    assert [r[0] for r in ingest.tombstoned(swept, media).collect()] == ["C"]
    assert not ingest.may_sweep(True, True, False) and ingest.may_sweep(True, False, False)


def test_stamps_and_export(spark):
    e = spark.createDataFrame([("a", 3), ("b", 9)], "face_id string, updated_seq long")
    assert sorted(map(tuple, cdc.stamp(e, spark.createDataFrame([("a",), ("b",)], "face_id string"), "face_id", 7).collect())) == [("a", 7), ("b", 9)]
    assert cdc.highest_stamp(e, e.limit(0)).first()[0] == 9 and cdc.is_dirty(8, e) and not cdc.is_dirty(9, e)
    assert [cdc.export_mode(*a) for a in [(False, False, False, 3, 1, False), (False, True, False, 3, 1, False), (False, True, False, 0, 1, False), (True, False, False, 3, 1, False), (False, False, False, None, 1, False), (False, False, True, 3, 1, True)]] == ["none", "delta", "full", "full", "full", "full"]
    done = []
    got = cdc.export({"images": lambda: done.append(1), "videos": lambda: 1 / 0, "faces": lambda: done.append(2)}, lambda: done.append("w"))
    assert isinstance(got["videos"], ZeroDivisionError) and done == [1, 2]
    assert cdc.export({"images": lambda: 7}, lambda: done.append("w")) == {"images": 7} and done[-1] == "w"


def test_percentiles_by_index(spark):
    v = spark.createDataFrame([("g", float(k)) for k in range(10)] + [("h", 4.0), ("h", None)], "g string, v double")
    got = {r["g"]: (r["n"], r["p50"], r["p95"], r["longest"]) for r in reports.latency(v, ["g"], "v").collect()}
    assert got == {"g": (10, 5.0, 9.0, 9.0), "h": (1, 4.0, 4.0, 4.0)}


def test_many_queries_are_multiplied_in_small_blocks(spark):
    assert knn.BLOCK * knn.ROWS * 8 <= 16 << 20  # bytes of a block's products, of which a task holds some copies
    x = np.random.default_rng(4).normal(size=(knn.BLOCK + 300, 4))
    v = spark.createDataFrame([(k, r.tolist()) for k, r in enumerate(x)], "id long, vector array<double>")
    got = {(r["query_id"], r["rank"]): r["id"] for r in knn.search(v, v, 2).collect()}
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    order = np.lexsort((np.broadcast_to(np.arange(len(x)), (len(x), len(x))), -np.round(unit @ unit.T, 6)), axis=1)[:, :2]
    assert got == {(q, k + 1): order[q, k] for q in range(len(x)) for k in range(2)}
