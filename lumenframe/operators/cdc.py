"""Change stamps on embeddings, and what an export of the search index takes from them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenframe.functions.ids import face_point_id, image_point_id, keyframe_point_id
from lumenframe.functions.media import VIDEO_FILES, extension


def stamp(embeddings: DataFrame, changed: DataFrame, key: str, seq: int) -> DataFrame:
    """Embeddings with updated_seq raised to ``seq`` where ``key`` is among the changed."""
    touched = changed.select(key).distinct().withColumn("__touched", F.lit(True))
    joined = embeddings.join(touched, key, "left")
    return joined.withColumn("updated_seq", F.when(F.col("__touched"), F.greatest("updated_seq", F.lit(seq))).otherwise(F.col("updated_seq"))).drop("__touched")


def stamped_keys(rule: str, changed: DataFrame, faces: DataFrame, frames: DataFrame) -> dict[str, DataFrame]:
    """Which embeddings a change touches, by kind: media (media_id), frame (keyframe_id), face (face_id).

    Rules: media (all of a medium), frames (those keyframes), faces (those faces and their media's
    frames), label (the same, after a new person), person (every face of a person and the frames of
    their media). ``changed`` has the key of its rule.
    """
    none = faces.select("face_id").where("false")
    of_media = lambda ids: frames.join(ids.select(F.col("media_id").alias("video_id")).distinct(), "video_id", "left_semi").select("keyframe_id")
    if rule == "media":
        ids = changed.select("media_id").distinct()
        return {"media": ids, "frame": of_media(ids), "face": faces.join(ids, "media_id", "left_semi").select("face_id")}
    if rule == "frames":
        return {"media": faces.select("media_id").where("false"), "frame": changed.select("keyframe_id").distinct(), "face": none}
    if rule in ("faces", "label", "person"):
        key = "person_id" if rule == "person" else "face_id"
        hit = faces.join(changed.select(key).distinct(), key, "left_semi")
        return {"media": faces.select("media_id").where("false"), "frame": of_media(hit), "face": hit.select("face_id").distinct()}
    raise ValueError(rule)


def highest_stamp(*tables: DataFrame) -> DataFrame:
    """The highest updated_seq of some tables, 0 if there is none: n."""
    every = tables[0].select(F.max("updated_seq").alias("n"))
    for t in tables[1:]:
        every = every.unionByName(t.select(F.max("updated_seq").alias("n")))
    return every.agg(F.coalesce(F.max("n"), F.lit(0)).alias("n"))


def changed_since(rows: DataFrame, watermark: int) -> DataFrame:
    return rows.where(F.col("updated_seq") > watermark)


def is_dirty(watermark: int, *tables: DataFrame) -> bool:
    return any(not changed_since(t, watermark).limit(1).isEmpty() for t in tables)


def image_points(media: DataFrame, embeddings: DataFrame, media_tags: DataFrame, since: int | None = None) -> DataFrame:
    """Points of live images with their tags, all or those stamped after ``since``. A file without a kind counts unless it is a video by name."""
    rows = embeddings if since is None else changed_since(embeddings, since)
    video = F.coalesce(extension(F.col("path")).isin(VIDEO_FILES), F.lit(False))
    images = media.where("deleted = 0 and (mime is null or mime like 'image/%')").where(~video)
    tags = media_tags.groupBy("media_id").agg(F.array_sort(F.collect_set("tag")).alias("tags"))
    joined = rows.join(images, "media_id").join(tags, "media_id", "left")
    payload = F.struct("path", "place", F.coalesce("ts_utc", "added_at").alias("timestamp"), F.coalesce("tags", F.array().cast("array<string>")).alias("tags"))
    return joined.select(image_point_id(F.col("media_id").cast("string")).alias("point_id"), "media_id", "embedding", payload.alias("payload"))


def frame_points(media: DataFrame, frames: DataFrame, embeddings: DataFrame, media_tags: DataFrame, named_faces: DataFrame, since: int | None = None) -> DataFrame:
    """Points of live videos' keyframes; tags and place fall back on the medium's, people are distinct names in order."""
    rows = embeddings if since is None else changed_since(embeddings, since)
    own = F.from_json("tags", "array<string>")
    of_media = media_tags.groupBy("media_id").agg(F.array_sort(F.collect_set("tag")).alias("media_tags"))
    names = named_faces.groupBy("media_id").agg(F.array_sort(F.collect_set("name")).alias("people"))
    videos = media.where("deleted = 0").select("media_id", "path", F.col("place").alias("media_place"))
    joined = rows.join(frames, "keyframe_id").withColumnRenamed("video_id", "media_id").join(videos, "media_id").join(of_media, "media_id", "left").join(names, "media_id", "left")
    tags = F.when(F.size(own) > 0, own).otherwise(F.coalesce("media_tags", F.array().cast("array<string>")))
    payload = F.struct("path", F.col("timestamp"), "shot_index", "shot_start", "shot_end", tags.alias("tags"), F.coalesce(F.nullif("place", F.lit("")), "media_place").alias("place"), F.coalesce("people", F.array().cast("array<string>")).alias("people"))
    return joined.select(keyframe_point_id(F.col("media_id"), F.col("shot_index"), F.col("kf_index")).alias("point_id"), "media_id", "keyframe_id", "embedding", payload.alias("payload"))


def face_points(media: DataFrame, faces: DataFrame, people: DataFrame, embeddings: DataFrame, since: int | None = None) -> DataFrame:
    rows = embeddings if since is None else changed_since(embeddings, since)
    joined = rows.join(faces, "face_id").join(media.where("deleted = 0").select("media_id", "path", "ts_utc"), "media_id").join(people, "person_id", "left")
    return joined.select(face_point_id(F.col("face_id")).alias("point_id"), "face_id", "embedding", F.struct("media_id", "path", "confidence", "person_id", F.col("name").alias("person_name"), F.col("ts_utc").alias("date")).alias("payload"))


def upsert_points(collection: DataFrame, points: DataFrame) -> DataFrame:
    """The collection with points put in by id; the collection's own give way."""
    return collection.join(points.select("point_id"), "point_id", "left_anti").unionByName(points)


def remove_points(collection: DataFrame, gone: DataFrame) -> DataFrame:
    return collection.join(gone.select("point_id").distinct(), "point_id", "left_anti")


def tombstoned_points(media: DataFrame, faces: DataFrame, frames: DataFrame, since: int) -> DataFrame:
    """Point ids of media deleted after ``since``: collection, point_id."""
    gone = media.where((F.col("deleted") == 1) & (F.col("deleted_seq") > since)).select("media_id")
    images = gone.select(F.lit("image").alias("collection"), image_point_id(F.col("media_id").cast("string")).alias("point_id"))
    frame = frames.join(gone, frames["video_id"] == gone["media_id"], "left_semi").select(F.lit("video").alias("collection"), keyframe_point_id(F.col("video_id"), F.col("shot_index"), F.col("kf_index")).alias("point_id"))
    face = faces.join(gone, "media_id", "left_semi").select(F.lit("face").alias("collection"), face_point_id(F.col("face_id")).alias("point_id"))
    return images.unionByName(frame).unionByName(face)


def pending(t: dict[str, DataFrame], since: int | None = None) -> dict[str, DataFrame]:
    """What an export puts into each collection, and ``gone``, the points it takes out; all of it, or what changed after ``since``.

    ``t``: media, media_tags, faces, people, frames, and image_vectors, frame_vectors, face_vectors with their stamps.
    """
    named = t["faces"].join(t["people"], "person_id").select("media_id", "name")
    out = {
        "image": image_points(t["media"], t["image_vectors"], t["media_tags"], since),
        "video": frame_points(t["media"], t["frames"], t["frame_vectors"], t["media_tags"], named, since),
        "face": face_points(t["media"], t["faces"], t["people"], t["face_vectors"], since),
    }
    return out | {"gone": tombstoned_points(t["media"], t["faces"], t["frames"], -1 if since is None else since)}


def exported(collections: dict[str, DataFrame], changes: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The collections after an export: points put in by id, deleted ones taken out."""
    gone = lambda name: changes["gone"].where(F.col("collection") == name).select("point_id")
    return {name: remove_points(upsert_points(points, changes[name].select(*points.columns)), gone(name)) for name, points in collections.items()}


def dry_run(changes: dict[str, DataFrame]) -> DataFrame:
    """How many points an export would write to or delete from each collection: collection, action, n."""
    out = changes["gone"].groupBy("collection").agg(F.lit("delete").alias("action"), F.count("*").alias("n"))
    for name, rows in changes.items():
        if name != "gone":
            out = out.unionByName(rows.agg(F.lit(name).alias("collection"), F.lit("write").alias("action"), F.count("*").alias("n")))
    return out


def export_mode(forced: bool, changed: bool, dirty: bool, exported: int | None, migrated: int, created: bool) -> str:
    """none, full or delta: a delta needs an earlier export that isn't older than the last migration, into collections that were there."""
    if not (forced or changed or dirty or exported is None):
        return "none"
    return "delta" if exported is not None and exported >= migrated and not created and not forced else "full"


def export(steps: dict[str, Callable[[], int]], advance: Callable[[], None]) -> dict[str, int | Exception]:
    """All steps (images, videos, faces, deletions) in order: what each returned or raised. The watermark advances only if none raised."""
    found: dict[str, int | Exception] = {}
    for name, step in steps.items():
        try:
            found[name] = step()
        except Exception as error:  # the others still run; the watermark stays
            found[name] = error
    if not any(isinstance(x, Exception) for x in found.values()):
        advance()
    return found
