"""What a scan means for the catalogue: which files are known, new, moved, replaced or gone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenframe.operators import running

PLACE = ["source_name", "rel_path"]


def needs_hash(snapshot: DataFrame, state: DataFrame, verify: bool = False) -> DataFrame:
    """Snapshot files (PLACE, size_bytes, mtime_ns) with ``known_id`` where size and time match the stored print, else null."""
    old = state.select(*PLACE, F.col("size_bytes").alias("old_size"), F.col("mtime_ns").alias("old_mtime"), F.col("media_id").alias("old_id"))
    same = (F.col("size_bytes") == F.col("old_size")) & (F.col("mtime_ns") == F.col("old_mtime")) & F.lit(not verify)
    return snapshot.join(old, PLACE, "left").withColumn("known_id", F.when(same, F.col("old_id"))).drop("old_size", "old_mtime")


def _beside_prints(snapshot: DataFrame, state: DataFrame, verify: bool = False) -> DataFrame:
    """Snapshot files beside the stored prints of their places.

    ``media_id``: of the stored print where it matches, else of the content (``content_id``);
    ``print``: hit, refreshed or null; ``replaced`` and ``old_id`` as in ``classify``.
    """
    old = state.select(*PLACE, F.col("size_bytes").alias("old_size"), F.col("mtime_ns").alias("old_mtime"), F.col("media_id").alias("stored_id"))
    same = (F.col("size_bytes") == F.col("old_size")) & (F.col("mtime_ns") == F.col("old_mtime")) & (F.lit(not verify) | (F.col("stored_id") == F.col("media_id")))
    replaced = F.col("stored_id").isNotNull() & ~F.coalesce(same, F.lit(False)) & (F.col("stored_id") != F.col("media_id"))
    kind = F.when(same, "hit").when(F.col("stored_id") == F.col("media_id"), "refreshed")
    left = F.when(same, F.col("stored_id")).otherwise(F.col("media_id"))
    return snapshot.join(old, PLACE, "left").select(*PLACE, "size_bytes", "mtime_ns", left.alias("media_id"), F.col("media_id").alias("content_id"), kind.alias("print"), replaced.alias("replaced"), F.when(replaced, F.col("stored_id")).alias("old_id"))


def classify(snapshot: DataFrame, state: DataFrame, media: DataFrame, verify: bool = False) -> DataFrame:
    """A decision for each file of a scan.

    ``snapshot``: PLACE, size_bytes, mtime_ns, media_id (of its content now); ``state``: the stored
    prints; ``media``: media_id, PLACE of the canonical copy, deleted, missing_since_scan_id.

    decision: hit (print matches, no hash needed), refreshed (same content, other size or time),
    new, resurrected (its content was deleted), move (the canonical place no longer holds the
    content in this scan), or copy. ``replaced`` says that the place held other content before, and
    ``old_id`` which; ``grace_cleared`` that the content had been missed.
    """
    canon = media.select(F.col("media_id").alias("content_id"), F.col("source_name").alias("canon_source"), F.col("rel_path").alias("canon_path"), "deleted", "missing_since_scan_id")
    holds = snapshot.select(F.col("source_name").alias("canon_source"), F.col("rel_path").alias("canon_path"), F.col("media_id").alias("canon_id"))
    # one row a medium meets its place, not one a file: no place of a much copied medium is one task's
    known_media = canon.join(holds, ["canon_source", "canon_path"], "left").select("content_id", "deleted", "missing_since_scan_id", F.col("canon_id").eqNullSafe(F.col("content_id")).alias("held"))
    joined = _beside_prints(snapshot, state, verify).join(known_media, "content_id", "left")
    known = F.col("deleted").isNotNull()
    decision = (
        F.when(F.col("print").isNotNull(), F.col("print"))
        .when(~known, "new")
        .when(F.col("deleted") == 1, "resurrected")
        .when(F.col("held"), "copy")
        .otherwise("move")
    )
    cleared = known & (F.col("deleted") == 0) & F.col("missing_since_scan_id").isNotNull() & ~decision.isin("hit", "refreshed")
    return joined.select(*PLACE, "size_bytes", "mtime_ns", "media_id", decision.alias("decision"), "replaced", "old_id", cleared.alias("grace_cleared"))


def superseded(decisions: DataFrame, media: DataFrame) -> DataFrame:
    """Live media all of whose places were replaced: media_id. ``decisions``: from ``classify``, over every live place."""
    # both ids in one reading; of distinct pairs, joins that only add a decision are left out by Spark
    pairs = decisions.select(F.col("media_id").alias("held"), F.when(F.col("replaced"), F.col("old_id")).alias("lost")).distinct()
    ids = pairs.unpivot([], ["held", "lost"], "role", "media_id").where("media_id is not null")
    lost = ids.groupBy("media_id").agg(F.bool_and(F.col("role") == "lost").alias("lost")).where("lost").select("media_id")
    return lost.join(media.where("deleted = 0").select("media_id"), "media_id", "left_semi")


def promoted(media: DataFrame, prints: DataFrame) -> DataFrame:
    """Live media whose canonical place holds them no longer, with the first place (by source, path) that does."""
    held = media.where("deleted = 0").select("media_id", *PLACE).join(prints.select("media_id", *PLACE), ["media_id", *PLACE], "left_anti").select("media_id")
    first = prints.groupBy("media_id").agg(F.min(F.struct(*PLACE)).alias("place"))
    return held.join(first, "media_id").select("media_id", "place.*")


def swept(state: DataFrame, scan_id: int | Column, sources: DataFrame | None = None) -> DataFrame:
    """Stored prints with what a completed scan does to them: keep, grace (missed for the first time) or delete (again).

    ``sources``: (source_name) of those whose walk met no error; others keep everything. A scan that
    was stopped or took in one kind of file only must not be swept at all.
    """
    scan = F.lit(scan_id) if isinstance(scan_id, int) else scan_id
    stale = F.col("last_seen_scan_id") < scan
    rows = state
    if sources is not None:
        rows = state.join(sources.select("source_name", F.lit(True).alias("__ok")), "source_name", "left")
        stale = stale & F.coalesce("__ok", F.lit(False))
    action = F.when(~F.coalesce(stale, F.lit(False)), "keep").when(F.col("missing_since_scan_id").isNull(), "grace").otherwise("delete")
    return rows.withColumn("action", action).drop("__ok")


def tombstoned(swept_state: DataFrame, media: DataFrame) -> DataFrame:
    """Live media whose last place a sweep deletes: media_id."""
    by = swept_state.groupBy("media_id").agg(F.max((F.col("action") == "delete").cast("int")).alias("lost"), F.max((F.col("action") != "delete").cast("int")).alias("left"))
    return by.where("lost = 1 and left = 0").select("media_id").join(media.where("deleted = 0").select("media_id"), "media_id", "left_semi")


def legacy_orphans(media: DataFrame, state: DataFrame, scan_id: int) -> DataFrame:
    """Live media without any print: media_id and grace (first scan) or tombstone (missed in an earlier scan)."""
    none = media.where("deleted = 0").join(state.select("media_id").distinct(), "media_id", "left_anti")
    action = F.when(F.col("missing_since_scan_id").isNull(), "grace").when(F.col("missing_since_scan_id") != scan_id, "tombstone").otherwise("keep")
    return none.select("media_id", action.alias("action"))


def may_sweep(enabled: bool, stopped: bool, filtered: bool) -> bool:
    return enabled and not stopped and not filtered


def processing_flags(media: DataFrame, image_vectors: DataFrame, shots: DataFrame, frames: DataFrame, frame_vectors: DataFrame) -> DataFrame:
    """Live media with what is stored of them: has_embedding, has_shots, n_frames, n_frame_vectors.

    ``image_vectors``: media_id; ``shots``: video_id; ``frames``: keyframe_id, video_id; ``frame_vectors``: keyframe_id.
    """
    there = lambda rows, key, flag: rows.select(F.col(key).alias("media_id"), F.lit(True).alias(flag)).distinct()
    done = frames.join(frame_vectors.select("keyframe_id", F.lit(1).alias("done")).distinct(), "keyframe_id", "left")
    counts = done.groupBy(F.col("video_id").alias("media_id")).agg(F.count("*").alias("n_frames"), F.count("done").alias("n_frame_vectors"))
    rows = media.where("coalesce(deleted, 0) = 0").join(there(image_vectors, "media_id", "has_embedding"), "media_id", "left").join(there(shots, "video_id", "has_shots"), "media_id", "left").join(counts, "media_id", "left")
    return rows.fillna(False, ["has_embedding", "has_shots"]).fillna(0, ["n_frames", "n_frame_vectors"])


def work_needed(media: DataFrame, model_version: str) -> DataFrame:
    """Which steps each live medium still needs. ``media`` has the flags and the counts of what is stored.

    Images: embedding, faces, objects; videos: shots and, while a keyframe lacks its vector, frames.
    """
    image = F.col("mime").startswith("image/")
    return media.where("deleted = 0").withColumns(
        {
            "needs_embedding": image & (~F.coalesce("has_embedding", F.lit(False)) | ~F.coalesce(F.col("embeddings_version") == model_version, F.lit(False))),
            "needs_faces": F.coalesce("face_detection_done", F.lit(0)) == 0,
            "needs_objects": F.coalesce("object_detection_done", F.lit(0)) == 0,
            "needs_frames": ~image & ((F.coalesce("n_frames", F.lit(0)) == 0) | (F.coalesce("n_frame_vectors", F.lit(0)) < F.coalesce("n_frames", F.lit(0)))),
        }
    )


def free_skips(files: DataFrame, needs: DataFrame) -> DataFrame:
    """Files of a scan whose print matches (``known_id`` of ``needs_hash``) and whose live medium needs no step: they cost nothing."""
    idle = needs.where("not (needs_embedding or needs_faces or needs_objects or needs_frames)").select(F.col("media_id").alias("known_id"))
    return files.where("known_id is not null").join(idle, "known_id", "left_semi")


def counters(decisions: DataFrame, superseded_media: DataFrame | None = None, tombstoned_media: DataFrame | None = None) -> DataFrame:
    """One row: how many files fell under each decision, and how many media were superseded and tombstoned where those are given."""
    kinds = ["hit", "refreshed", "new", "copy", "move", "resurrected"]
    row = decisions.agg(*(F.count_if(F.col("decision") == k).alias(k) for k in kinds), F.count_if(F.col("decision") != "hit").alias("hashed"), F.count_if("replaced").alias("changed"))
    for name, rows in (("superseded", superseded_media), ("tombstoned", tombstoned_media)):
        if rows is not None:
            row = row.join(rows.agg(F.count("*").alias(name)))
    return row


def apply_scan(snapshot: DataFrame, state: DataFrame, media: DataFrame, scan_id: int, sources: DataFrame | None = None, verify: bool = False, sweep: bool = True) -> dict[str, DataFrame]:
    """The tables after a completed scan: decisions, state (prints), media and counters; the inputs are those of ``classify``.

    Prints that the scan saw are refreshed; unseen ones fall into grace, and out at the second scan
    (of ``sources`` only, if given; none without ``sweep``). A medium that the scan saw is live, at its
    place if a print there holds it still, else at its first one; one that no print holds is deleted.
    """
    decisions = classify(snapshot, state, media, verify)

    def marked(files: DataFrame) -> DataFrame:
        now = files.select(*PLACE, F.struct("size_bytes", "mtime_ns", "media_id").alias("now"))
        joined = state.join(now, PLACE, "full")
        seen = F.col("now").isNotNull()
        fields = [F.coalesce(F.col("now")[c], F.col(c)).alias(c) for c in ("size_bytes", "mtime_ns", "media_id")]
        prints = joined.select(*PLACE, *fields, F.when(seen, F.lit(scan_id)).otherwise(F.col("last_seen_scan_id")).cast("long").alias("last_seen_scan_id"), F.when(~seen, F.col("missing_since_scan_id")).alias("missing_since_scan_id"))
        return swept(prints, scan_id, sources) if sweep else prints.withColumn("action", F.lit("keep"))

    after = marked(decisions).where("action != 'delete'").withColumn("missing_since_scan_id", F.when(F.col("action") == "grace", F.lit(scan_id)).otherwise(F.col("missing_since_scan_id")).cast("long")).drop("action")
    place = F.struct(*PLACE)
    held = after.groupBy("media_id").agg(F.min(place).alias("first"), F.max((F.col("last_seen_scan_id") == scan_id).cast("int")).alias("seen"))
    still = after.select("media_id", *PLACE, F.lit(1).alias("still"))
    known = media.withColumn("known", F.lit(True)).join(still, ["media_id", *PLACE], "left").join(held, "media_id", "full")
    at = F.when(F.col("known").isNull() | (F.col("still").isNull() & F.col("first").isNotNull()), F.col("first")).otherwise(place)
    deleted = F.when(F.col("first").isNull(), 1).when(F.col("seen") == 1, 0).otherwise(F.coalesce("deleted", F.lit(0)))
    changed = known.select("media_id", at.alias("at"), deleted.alias("deleted"), F.when(F.col("first").isNotNull() & (F.col("seen") == 0), F.coalesce("missing_since_scan_id", F.lit(scan_id))).cast("long").alias("missing_since_scan_id"))
    result = changed.select("media_id", "at.source_name", "at.rel_path", "deleted", "missing_since_scan_id")
    files = _beside_prints(snapshot, state, verify)  # what is superseded and tombstoned hangs on no decision
    return {"decisions": decisions, "state": after, "media": result, "counters": counters(decisions, superseded(files, media), tombstoned(marked(files), media))}


def scan_run(scan_id: int, started_at: str, completed_at: str | None, found: DataFrame) -> DataFrame:
    """A ledger row of a scan with its counters; one without an end was stopped."""
    return found.select(F.lit(scan_id).cast("long").alias("scan_id"), F.lit(started_at).alias("started_at"), F.lit(completed_at).alias("completed_at"), F.to_json(F.struct("*")).alias("counters_json"))


def commit_groups(files: DataFrame, every: int = 200) -> DataFrame:
    """Files of a source in groups of ``every``, by path, for batched commits; a source's paths differ."""
    counted = running.running(files, ["source_name"], ["rel_path"], {"__n": F.lit(1)})
    return counted.withColumn("batch", F.floor((F.col("__n") - 1) / every).cast("long")).drop("__n")
