"""The catalogue's tables."""

from __future__ import annotations

#: DDL by table, as Spark reads it. Times that filters compare are ISO texts.
TABLES = {
    "media": "media_id string, path string, source_name string, rel_path string, size_bytes long, mime string, ts_utc string, gps_lat double, gps_lon double, place string, camera string, lens string, width int, height int, duration double, added_at string, model_version string, deleted int, face_detection_done int, object_detection_done int, gps_processed int, gps_data_mode string, embeddings_version string, missing_since_scan_id long, deleted_seq long",
    "tag": "tag_id long, name string",
    "media_tag": "media_id string, tag_id long",
    "person": "person_id string, name string, is_labeled int, created_at string",
    "face": "face_id string, media_id string, x double, y double, w double, h double, confidence double, person_id string, gender string, age int, shot_index int, kf_index int, created_at string",
    "image_embedding": "media_id string, embedding array<float>, model string, updated_seq long",
    "face_embedding": "face_id string, embedding array<float>, model string, updated_seq long",
    "keyframe_embedding": "keyframe_id long, embedding array<float>, model string, updated_seq long",
    "shots": "video_id string, shot_index int, t_start double, t_end double, keyframe_count int, is_synthetic int",
    "video_keyframes": "keyframe_id long, video_id string, shot_index int, kf_index int, timestamp double, shot_start double, shot_end double, tags string, gps_lat double, gps_lon double, gps_alt double, gps_datetime_utc string, gps_fix int, gps_source string, place string",
    "index_state": "index_version_seq long, index_version_ts string, s3_migration_seq long, face_recreate_required int",
    "scan_run": "scan_id long, started_at string, completed_at string, sources_json string",
    "file_fingerprint": "source_name string, rel_path string, size_bytes long, mtime_ns long, media_id string, last_seen_scan_id long, missing_since_scan_id long",
}
