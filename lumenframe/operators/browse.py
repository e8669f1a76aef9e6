"""Faceted browsing of media, faces and people."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenframe.operators.filters import kind_by_mime, live


def with_people(media: DataFrame, faces: DataFrame, people: DataFrame, names: list[str], mode: str = "any") -> DataFrame:
    """Media by the people on them: any or all of ``names``, or only (all of them and no other named person)."""
    names = list(dict.fromkeys(names))
    named = faces.join(people.where("name is not null"), "person_id").groupBy("media_id")
    counts = named.agg(F.count_distinct(F.when(F.col("name").isin(names), F.col("name"))).alias("hit"), F.count_distinct("name").alias("every"))
    k = len(names)
    keep = {"all": F.col("hit") == k, "only": (F.col("hit") == k) & (F.col("every") == k)}.get(mode, F.col("hit") >= 1)
    return media.join(counts.where(keep).select("media_id"), "media_id", "left_semi")


def with_tags(media: DataFrame, tags: DataFrame, names: list[str]) -> DataFrame:
    return media.join(tags.where(F.col("tag").isin(names)).select("media_id"), "media_id", "left_semi")


def select_media(media: DataFrame, kind: str | None = None, first: str | None = None, last: str | None = None, place: str | None = None) -> DataFrame:
    """Live media by kind, by date as text (missing dates fall out), and by a part of the place."""
    found = live(media).where(kind_by_mime(F.col("mime"), kind))
    if first:
        found = found.where(F.col("ts_utc") >= first)
    if last:
        found = found.where(F.col("ts_utc") <= last)
    return found.where(F.col("place").ilike(f"%{place}%")) if place else found


def page(media: DataFrame, sort_by: str = "date", order: str = "desc", limit: int = 48, offset: int = 0) -> DataFrame:
    """A page in order of date or path, then id. Other sorts mean path, other orders descending."""
    key = F.col("ts_utc") if sort_by == "date" else F.col("path")
    down = order.lower() != "asc"
    return media.orderBy(key.desc() if down else key.asc(), F.desc("media_id") if down else F.asc("media_id")).offset(offset).limit(limit)


def total(media: DataFrame) -> DataFrame:
    return media.agg(F.count_distinct("media_id").alias("n"))


def tag_lists(media: DataFrame, tags: DataFrame, frame_tags: DataFrame | None = None) -> DataFrame:
    """Each medium's distinct tags in order, any case; where it has none, those of its frames. Join after paging."""
    listed = lambda rows: rows.join(media.select("media_id"), "media_id", "left_semi").groupBy("media_id").agg(F.transform(F.array_sort(F.collect_set(F.struct(F.lower("tag").alias("k"), F.col("tag").alias("t")))), lambda s: s["t"]).alias("tags"))
    out = media.join(listed(tags), "media_id", "left")
    if frame_tags is not None:
        out = out.join(listed(frame_tags).withColumnRenamed("tags", "of_frames"), "media_id", "left").withColumn("tags", F.coalesce("tags", "of_frames")).drop("of_frames")
    return out.withColumn("tags", F.coalesce("tags", F.array().cast("array<string>")))


def tag_counts(tags: DataFrame) -> DataFrame:
    return tags.groupBy("tag").agg(F.count_distinct("media_id").alias("n"))


def shots_nested(shots: DataFrame, frames: DataFrame) -> DataFrame:
    """Each shot with its frames in order. ``shots``: video_id, shot_index, t_start, t_end; ``frames``: video_id, shot_index, kf_index, timestamp."""
    nested = frames.groupBy("video_id", "shot_index").agg(F.array_sort(F.collect_list(F.struct("kf_index", "timestamp"))).alias("frames"))
    return shots.withColumn("duration", F.col("t_end") - F.col("t_start")).join(nested, ["video_id", "shot_index"], "left").withColumn("frames", F.coalesce("frames", F.array().cast("array<struct<kf_index:int,timestamp:double>>")))


def media_faces(faces: DataFrame, people: DataFrame, media_id=None, labeled_first: bool = False) -> DataFrame:
    """A medium's faces (every medium's, if none is named), the surest first, or those with a person before; deleted media have theirs too."""
    own = faces if media_id is None else faces.where(F.col("media_id") == media_id)
    order = [F.col("person_id").isNull()] if labeled_first else []
    return own.join(people, "person_id", "left").withColumn("rank", F.row_number().over(Window.partitionBy("media_id").orderBy(*order, F.desc("confidence"), "face_id")))


def best_faces(faces: DataFrame, keys: list[str]) -> DataFrame:
    """The surest face of each group; ties go to the lowest id."""
    best = F.min_by(F.struct("face_id", "confidence"), F.struct((-F.col("confidence")).alias("c"), "face_id"))
    return faces.groupBy(*keys).agg(best.alias("best")).select(*keys, "best.face_id", "best.confidence")


def people_list(people: DataFrame, faces: DataFrame, media: DataFrame) -> DataFrame:
    """Everybody with the number of faces on live media and the surest of them; 0 and null if there is none."""
    own = faces.where("person_id is not null").join(live(media).select("media_id"), "media_id", "left_semi")
    best = F.min_by("face_id", F.struct((-F.col("confidence")).alias("c"), "face_id"))
    counts = own.groupBy("person_id").agg(F.count("*").alias("face_count"), best.alias("face_id"))
    return people.join(counts, "person_id", "left").withColumn("face_count", F.coalesce("face_count", F.lit(0)).cast("long"))


def unique_faces(faces: DataFrame, people: DataFrame, media: DataFrame) -> DataFrame:
    """The surest face of each labelled person, then every unlabelled face; live media only. With the order to page by."""
    own = faces.join(live(media).select("media_id"), "media_id", "left_semi")
    labelled = best_faces(own.where("person_id is not null"), ["person_id"]).join(people, "person_id").withColumn("section", F.lit(0))
    rest = own.where("person_id is null").select("person_id", "face_id", "confidence", F.lit(None).cast("string").alias("name"), F.lit(1).alias("section"))
    return labelled.select(*rest.columns).unionByName(rest)


def unique_faces_page(unique: DataFrame, limit: int, offset: int = 0) -> DataFrame:
    """A page: labelled ones by name, then unlabelled ones by falling confidence. ``rank`` counts from 1 over all.

    Only ``offset + limit`` rows are ever ranked together.
    """
    key: list[Column] = [F.col("section"), F.lower("name"), F.desc("confidence"), F.col("face_id")]
    top = unique.orderBy(*key).limit(offset + limit)
    return top.withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*key)).cast("long")).where(F.col("rank") > offset)


def unique_faces_count(unique: DataFrame) -> DataFrame:
    return unique.agg(F.count("*").alias("n"))
