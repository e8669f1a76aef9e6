"""The catalogue's calls, each a DataFrame or a few, over tables by name."""

from __future__ import annotations

from dataclasses import replace
from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenframe.functions import query_text
from lumenframe.functions.models import text_vectors
from lumenframe.operators import browse, filters, knn, ranking, tables
from lumenframe.operators.versioned import KeyedTable
from lumenframe.plans import search as plan


class Library:
    """Tables: media, faces (face_id, media_id, person_id, confidence), people (person_id, name), media_tags (media_id, tag).

    ``stored``: tables of these names that outlive the session; changes are then committed to them, and
    the next call reads files instead of a plan that grows with every change.
    """

    def __init__(self, tables_: dict[str, DataFrame], collections: dict[str, DataFrame] | None = None, stored: dict[str, KeyedTable] | None = None):
        self.t, self.collections, self.stored = dict(tables_), collections or {}, dict(stored or {})
        for name, table in self.stored.items():
            self.t[name] = table.read()

    def _changed(self, name: str, rows: DataFrame, whole: DataFrame) -> None:
        """A table after a change: ``rows`` of it are new, which makes it ``whole``."""
        if name not in self.stored:
            self.t[name] = whole
            return
        self.stored[name] = self.stored[name].upsert(rows)
        self.t[name] = self.stored[name].read()

    def known_people(self) -> DataFrame:
        """Names that aren't blank, in order of any case."""
        return self.t["people"].where(F.trim("name") != "").select("name").distinct().orderBy(F.lower("name"), "name")

    def understand(self, text: str, today: date, given: plan.Request | None = None) -> tuple[str, plan.Request]:
        """The words to look for, and the request: what the caller gave goes before what the text says.

        Names are looked for in the tasks; only those that the text holds reach the driver.
        """
        spark = self.t["media"].sparkSession
        asked = spark.createDataFrame([(text,)], "q string").select(query_text.date_intent(F.col("q"), today).alias("d")).select("d", F.col("d.visual_query").alias("q"))
        row = asked.first()
        held = self.t["people"].where(F.trim("name") != "").select("name").distinct().where(F.regexp_like(F.lit(row["q"]), F.concat(F.lit(r"(?i)\b\Q"), F.trim("name"), F.lit(r"\E\b"))))
        names = F.array(*(F.lit(r["name"]) for r in held.orderBy(F.lower("name"), "name").collect())).cast("array<string>")
        parts = asked.select(query_text.decompose(F.col("q"), names).alias("p")).first()["p"]
        given = given or plan.Request()
        people = parts["people"] + [n for n in given.people if n not in parts["people"]]
        found = plan.with_defaults(given, date_from=row["d"]["date_from"], date_to=row["d"]["date_to"])
        return parts["visual_query"] or row["q"] or text, replace(found, people=people)

    def search(self, text: str, today: date, given: plan.Request | None = None) -> DataFrame:
        """The ranked media for a text, positions, places and dates filled in from the catalogue."""
        words, asked = self.understand(text, today, given)
        vector = self.t["media"].sparkSession.createDataFrame([(0, words)], "id long, q string").select("id", text_vectors(F.col("q")).alias("vector"))
        more = None
        if asked.people:
            more = ranking.expand_people(self.t["media"], self.t["faces"], self.t["people"], asked.people, asked.date_from, asked.date_to, max(2 * asked.keep, 50)).withColumn("query_id", F.lit(0).cast("long"))
        found = plan.search(self.collections, vector, self.t["media"], self.t["faces"], self.t["people"], asked, more)
        return plan.backfilled(found.drop("query_id"), self.t["media"], asked.keep).orderBy("rank")

    def media(self, kind: str | None = None, date_from: str | None = None, date_to: str | None = None, place: str | None = None, people: list[str] = (), people_mode: str = "any", tags: list[str] = (), sort_by: str = "date", order: str = "desc", limit: int = 48, offset: int = 0) -> tuple[DataFrame, DataFrame]:
        """A page with its tags, and the total."""
        found = browse.select_media(self.t["media"], kind, date_from, date_to, place)
        if people:
            found = browse.with_people(found, self.t["faces"], self.t["people"], list(people), people_mode)
        if tags:
            found = browse.with_tags(found, self.t["media_tags"], list(tags))
        return browse.tag_lists(browse.page(found, sort_by, order, limit, offset), self.t["media_tags"], self.t.get("frame_tags")), browse.total(found)

    def media_info(self, media_id) -> DataFrame:
        return browse.tag_lists(self.t["media"].where(F.col("media_id") == media_id), self.t["media_tags"], self.t.get("frame_tags"))

    def media_faces(self, media_id) -> DataFrame:
        return browse.media_faces(self.t["faces"], self.t["people"], media_id)

    def faces(self, labelled: bool | None = None, limit: int = 100, offset: int = 0) -> DataFrame:
        unique = browse.unique_faces(self.t["faces"], self.t["people"], self.t["media"])
        if labelled is not None:
            unique = unique.where(F.col("person_id").isNotNull() == labelled)
        return browse.unique_faces_page(unique, limit, offset)

    def people(self) -> DataFrame:
        return browse.people_list(self.t["people"], self.t["faces"], self.t["media"]).orderBy(F.lower("name"), "person_id")

    def tags(self) -> DataFrame:
        return browse.tag_counts(self.t["media_tags"]).orderBy(F.lower("tag"), "tag")

    def similar_faces(self, face_ids: list, k: int = 20) -> tuple[DataFrame, DataFrame]:
        """Nearest faces of each (itself included), and the ids without a vector."""
        faces = self.collections["face"]
        ids = faces.sparkSession.createDataFrame([(i,) for i in face_ids], "id long")
        return knn.search(faces, faces.join(ids, "id", "left_semi"), k), knn.missing_queries(ids, faces)

    def suggestions(self, face_ids: list, top: int = 5, k: int | None = None) -> tuple[DataFrame, DataFrame]:
        """People for faces; ``k`` neighbours: 50 for one face, ten times ``top`` (10 at least) for several."""
        hits, missing = self.similar_faces(face_ids, k or (50 if len(face_ids) == 1 else max(10, 10 * top)))
        return knn.suggestions(hits.join(self.collections["face"].select("id", "person_id"), "id"), self.t["people"], top), missing

    def label(self, labels: DataFrame) -> DataFrame:
        """Takes over labels (face_id, person_id); the faces that changed."""
        whole, changed = tables.label_faces(self.t["faces"], labels)
        self._changed("faces", changed, whole)
        return changed

    def unlabel(self, face_ids: DataFrame) -> DataFrame:
        """Clears the labels of faces (face_id); those that changed."""
        kind = self.t["faces"].schema["person_id"].dataType
        return self.label(face_ids.select("face_id", F.lit(None).cast(kind).alias("person_id")))

    def create_people(self, new: DataFrame) -> None:
        whole = tables.create_people(self.t["people"], new)
        self._changed("people", whole.join(self.t["people"].select("person_id"), "person_id", "left_anti"), whole)

    def rename(self, person_id, name: str) -> None:
        whole = tables.rename_person(self.t["people"], person_id, name)
        self._changed("people", whole.where(F.col("person_id") == person_id), whole)

    def points(self, collection: str, ids: DataFrame) -> DataFrame:
        """A collection's points by id (id)."""
        return knn.retrieved(self.collections[collection], ids)

    def merge(self, source, target) -> None:
        people, faces = tables.merge_people(self.t["people"], self.t["faces"], source, target)
        moved = self.t["faces"].where(F.col("person_id") == source).withColumn("person_id", F.lit(target).cast(faces.schema["person_id"].dataType))
        self._changed("faces", moved, faces)
        if "people" in self.stored:
            gone = self.t["people"].where(F.col("person_id") == source).select(*self.stored["people"].version.keys)
            self.stored["people"] = self.stored["people"].delete(gone)
            people = self.stored["people"].read()
        self.t["people"] = people

    def visible(self, results: DataFrame, least_percent: float = 15.0) -> DataFrame:
        return filters.shown(results, least_percent)
