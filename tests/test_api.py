"""The catalogue's calls, model boundaries and metadata on hand-written tables."""

from datetime import date

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenframe.functions import models
from lumenframe.plans.api import Library
from lumenframe.plans.search import Request
from lumenframe.sources import metadata


@pytest.fixture(scope="module")
def library(spark):
    media = spark.createDataFrame(
        [(1, "/a/1.jpg", "image/jpeg", "2023-06-15T10:00:00", "San Diego", 0), (2, "/a/2.jpg", "image/jpeg", "2023-07-20T14:00:00", "Yosemite", 0), (3, "/a/3.mp4", "video/mp4", "2016-08-05T18:00:00", None, 0), (4, "/a/4.jpg", "image/jpeg", "2022-12-01T09:00:00", "New York", 1)],
        "media_id long, path string, mime string, ts_utc string, place string, deleted int",
    )
    faces = spark.createDataFrame([(1, 1, 1, 0.9), (2, 2, 1, 0.8), (3, 2, 2, 0.7), (4, 4, 2, 0.6), (5, 1, None, 0.5)], "face_id long, media_id long, person_id long, confidence double")
    people = spark.createDataFrame([(1, "Alice"), (2, "Bob"), (3, " ")], "person_id long, name string")
    tags = spark.createDataFrame([(1, "Beach"), (1, "apple"), (2, "beach"), (4, "city")], "media_id long, tag string")
    texts = spark.createDataFrame([(1, "beach sunset"), (2, "forest walk"), (3, "beach party"), (4, "beach sunset")], "id long, t string")
    image = texts.select("id", models.text_vectors(F.col("t")).alias("vector"), F.col("id").alias("media_id"), F.array(F.lit("x")).alias("tags"))
    face = spark.createDataFrame([(1, [1.0, 0.0], 1), (2, [0.9, 0.1], 1), (3, [0.0, 1.0], 2), (5, [1.0, 0.05], None)], "id long, vector array<double>, person_id long")
    return Library({"media": media, "faces": faces, "people": people, "media_tags": tags}, {"image": image.where("id != 3"), "video": image.where("id = 3"), "face": face})


def test_understanding(library):
    words, asked = library.understand("walking on the beach with alice last year", date(2024, 5, 1), Request(people=["Bob"], date_to="2023-01-01"))
    assert words == "walking beach" and asked.people == ["Alice", "Bob"] and (asked.date_from, asked.date_to) == ("2023-01-01", "2023-01-01")
    assert library.understand("", date(2024, 5, 1))[0] == ""


def test_search(library):
    got = library.search("beach sunset", date(2024, 5, 1)).collect()
    assert [r["id"] for r in got][:2] == [1, 3] and all(r["id"] != 4 for r in got) and got[0]["why"] == "similarity 1.000"
    assert [r["id"] for r in library.search("beach from 2016", date(2024, 5, 1)).collect()] == [3]
    named = {r["id"]: r["total_score"] for r in library.search("forest with Bob", date(2024, 5, 1)).collect()}
    assert named[2] == max(named.values())
    assert library.visible(library.search("beach sunset", date(2024, 5, 1))).count() == 2


def test_browse(library):
    page, total = library.media(limit=2)
    assert [(r["media_id"], r["tags"]) for r in page.orderBy(F.desc("ts_utc")).collect()] == [(2, ["beach"]), (1, ["apple", "Beach"])] and total.first()[0] == 3
    assert library.media(people=["Alice", "Bob"], people_mode="all")[1].first()[0] == 1
    assert library.media(tags=["Beach"])[1].first()[0] == 1 and library.media(place="DIEGO", kind="image")[1].first()[0] == 1
    assert [r["face_id"] for r in library.media_faces(1).orderBy("rank").collect()] == [1, 5]
    assert [(r["name"], r["face_count"]) for r in library.people().collect()] == [(" ", 0), ("Alice", 2), ("Bob", 1)]
    assert {r["tag"]: r["n"] for r in library.tags().collect()} == {"apple": 1, "Beach": 1, "beach": 1, "city": 1}
    assert [r["face_id"] for r in library.faces(labelled=False).collect()] == [5] and library.media_info(4).first()["tags"] == ["city"]


def test_suggestions_and_labels(library):
    found, missing = library.suggestions([5, 4], top=1)
    assert [(r["query_id"], r["person_id"]) for r in found.collect()] == [(5, 1)] and [r["id"] for r in missing.collect()] == [4]
    changed = library.label(library.t["faces"].sparkSession.createDataFrame([(5, 1), (1, 1)], "face_id long, person_id long"))
    assert [tuple(r) for r in changed.collect()] == [(5, 1)]
    library.merge(2, 1)
    assert library.t["faces"].where("person_id = 2").count() == 0


def test_model_boundaries(spark):
    rows = spark.createDataFrame([(1, b"ab"), (2, b"")], "media_id long, content binary")
    vectors = rows.select(models.image_vectors(F.col("content"), lambda: lambda pictures: np.array([[len(p), 1] for p in pictures])).alias("v")).collect()
    assert [r["v"] for r in vectors] == [[2.0, 1.0], [0.0, 1.0]]
    labels = rows.select(models.detected_labels(F.col("content"), lambda: lambda pictures: [["b", "a", "b"] if p else [] for p in pictures]).alias("l")).collect()
    assert [r["l"] for r in labels] == [["a", "b"], []]
    face = {"x": 0.1, "y": 0.2, "w": 0.3, "h": 0.4, "confidence": 0.9, "embedding": [1.0]}
    got = models.detected_faces(rows, lambda: lambda content: [face] * len(content)).collect()
    assert [(r["face_id"], r["confidence"], r["age"]) for r in got] == [("1:f0", 0.9, None), ("1:f1", 0.9, None)]
    blob = spark.createDataFrame([(np.array([1.5, -2], "<f4").tobytes(),), (None,)], "b binary").select(models.stored_vector(F.col("b")).alias("v")).collect()
    assert [r["v"] for r in blob] == [[1.5, -2.0], None]


def test_metadata(spark):
    tags = {"DateTimeOriginal": "2023:06:15 10:00:00", "Model": "X100 ", "LensModel": " ", "ImageWidth": "4000", "GPSLatitude": "10 30 0", "GPSLatitudeRef": "S", "GPSLongitude": "20.5"}
    got = metadata.image_facts(spark.createDataFrame([("a", tags), ("b", {"DateTime": "bad", "GPSLatitude": "95", "GPSLongitude": "1"})], "media_id string, tags map<string,string>")).orderBy("media_id").collect()
    assert tuple(got[0]) == ("a", "2023-06-15T10:00:00", "X100", None, 4000, None, -10.5, 20.5) and tuple(got[1]) == ("b", *[None] * 7)
    video = spark.createDataFrame([("v", {"duration": "x"}, {"duration": "12.5", "location": "+10.5-020.25/"})], "media_id string, one map<string,string>, two map<string,string>")
    assert tuple(metadata.video_facts(video, ["one", "two"]).first()) == ("v", 12.5, None, None, 10.5, -20.25)
    entries = spark.createDataFrame([("b", False), ("Z", True), ("a", False), ("c", False)], "name string, is_folder boolean")
    assert [r["name"] for r in metadata.folder_listing(entries, 2).collect()] == ["Z", "a", "b"]


def test_texts_are_embedded_once_and_some_at_a_time(spark):
    def strict():
        encode = models.hashing_text_model(16)

        def some(texts):
            assert len(texts) == 1 or sum(map(len, texts)) <= 50_000
            return encode(texts)

        return some

    rows = spark.createDataFrame([(k, None if k == 7 else f"w{k} x{k % 5} " * (1 + 40 * k)) for k in range(200)], "id long, text string").coalesce(1)
    want = {r["id"]: r["vector"] for r in rows.select("id", models.text_vectors(F.col("text"), lambda: models.hashing_text_model(16)).alias("vector")).collect()}
    found = models.embedded(rows, strict, size=50_000)
    assert {r["id"]: r["vector"] for r in found.collect()} == want
    plan = found.where((F.size("vector") == 16) & ~F.exists("vector", F.isnull))._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" not in plan and plan.count("MapInArrow") == 1


def test_text_search_embeds_each_document_once(spark):
    from lumenframe.plans.queries import QUERIES

    found = QUERIES["text_search"](spark, "/root/testdata/sf0.001")
    assert "ArrowEvalPython" not in found._jdf.queryExecution().executedPlan().toString()
    assert found.count() == 10
