"""The operators over the driver's tables, each with the same in DuckDB SQL."""

from __future__ import annotations

import struct
from datetime import date, datetime, timedelta

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumenframe.functions import ids, numbers, query_text
from lumenframe.functions.media import duration_seconds, exif_time, extension, file_kind, iso6709, size_text
from lumenframe.functions.vector import dot
from lumenframe.operators import browse, cdc, filters, ingest, knn, names, ranking, reports, running, shots, similarity_join, tables, tracks, versioned
from lumenframe.operators.vector_index import VectorIndex
from lumenframe.plans import search as search_plan
from lumenframe.sources import media_bytes, media_source, metadata, store
from lumenframe.sources.adapters import Catalogue, with_roles

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function of a Catalogue under its name."""

    def add(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Catalogue(spark, sf_dir))
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# --- browse -------------------------------------------------------------------------------------

NAMED = "named AS (SELECT media_id, name FROM faces JOIN people USING (person_id))"


def _two(c: Catalogue) -> list[str]:
    return [r["name"] for r in c.people().where(F.col("person_id").isin(1, 2)).orderBy("person_id").collect()]


def _as_files(c: Catalogue) -> str:
    """The documents as files of their sources' folders; every seventh isn't a picture by name."""
    root = store.shared_folder(c.spark, "media")
    docs = c.table("documents").select("source", "doc_id", "text")
    name = F.concat(F.col("doc_id").cast("string"), F.when(F.col("doc_id") % 7 == 0, ".txt").when(F.col("doc_id") % 2 == 0, ".JPG").otherwise(".mp4"))
    media_source.write_files(docs.where("source is not null").select(F.concat_ws("/", "source", F.concat(F.lit("d"), F.col("doc_id") % 3), name).alias("rel_path"), F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("content")), root)
    return root


@query("""SELECT source AS source_name, 'd' || (doc_id % 3) || '/' || doc_id || CASE WHEN doc_id % 2 = 0 THEN '.JPG' ELSE '.mp4' END AS rel_path, CAST(strlen(coalesce(text, '')) AS BIGINT) AS size_bytes, CASE WHEN doc_id % 2 = 0 THEN 'image' ELSE 'video' END AS kind, sha256(coalesce(text, '')) AS media_id, CAST(NULL AS VARCHAR) AS error
FROM documents WHERE source IS NOT NULL AND doc_id % 7 <> 0""")
def scan_files(c: Catalogue) -> DataFrame:
    """Every document as a file, walked as a source a folder and hashed block by block."""
    root = _as_files(c)
    names = [r["source"] for r in c.table("documents").where("source is not null").select("source").distinct().collect()]
    files = media_source.hashed(media_source.scan(c.spark, {n: f"{root}/{n}" for n in names}), block=4096)
    return files.select("source_name", "rel_path", "size_bytes", "kind", "media_id", "error")


def _picture(key: int, nation: int, segment: str) -> bytes:
    taken = (datetime(2020, 1, 1) + timedelta(hours=key)).strftime("%Y:%m:%d %H:%M:%S").encode() + b"\0"
    gps = {1: (2, b"S\0" if key % 2 else b"N\0"), 2: (5, [key % 90, 1, key % 60, 1, nation * 10, 10]), 3: (2, b"W\0" if key % 3 else b"E\0"), 4: (5, [key % 180, 1, 0, 1, 0, 1])}
    block = media_bytes.made_directory({0x0110: (2, segment.encode() + b"\0")}, "<" if key % 4 < 2 else ">", {0x9003: (2, taken), 0xA434: (2, f"L{nation}\0".encode())}, gps)
    return media_bytes.made_jpeg(block, 100 + key % 900, 50 + nation)


def _film(key: int, nation: int) -> bytes:
    """Ten seconds with a position a half second, moving north."""
    scale = (10**7, 10**7, 1000, 1000, 100)
    samples = []
    for second in range(10):
        rows = b"".join(struct.pack(">5i", round((key % 80 + (second + half) * 0.01) * scale[0]), nation * scale[1], 1000 * key, 0, 0) for half in (0, 0.5))
        strm = media_bytes.made_values(b"GPSF", "L", 4, struct.pack(">I", 3)) + media_bytes.made_values(b"SCAL", "l", 4, struct.pack(">5i", *scale)) + media_bytes.made_values(b"GPS5", "l", 20, rows)
        samples.append(media_bytes.made_values(b"DEVC", "", 0, media_bytes.made_values(b"STRM", "", 0, strm)))
    return media_bytes.made_video(10.0 + key, 640 + nation, 480, f"{key % 80:+.4f}{nation:+.4f}/", samples)


def _made_files(c: Catalogue, rows: DataFrame, make, suffix: str) -> DataFrame:
    """(media_id, path) of a file for each of ``rows``, whose first column names it, with the bytes that ``make`` gives."""

    def work(batches):
        for batch in batches:
            given = [col.to_pylist() for col in batch.columns]
            yield pa.RecordBatch.from_arrays([pa.array([f"{r[0] % 50}/{r[0]}{suffix}" for r in zip(*given, strict=True)]), pa.array([make(*r) for r in zip(*given, strict=True)], pa.binary())], names=["rel_path", "content"])

    root = store.shared_folder(c.spark, "made")
    media_source.write_files(rows.mapInArrow(work, "rel_path string, content binary"), root)
    files = media_source.scan(c.spark, {"made": root})
    return files.select(F.regexp_extract("path", r"(\d+)\.\w+$", 1).cast("long").alias("media_id"), "path")


@query("""SELECT c_custkey AS media_id, strftime(TIMESTAMP '2020-01-01 00:00:00' + to_hours(CAST(c_custkey AS INTEGER)), '%Y-%m-%dT%H:%M:%S') AS ts_utc, c_mktsegment AS camera, 'L' || c_nationkey AS lens, CAST(100 + c_custkey % 900 AS INTEGER) AS width, CAST(50 + c_nationkey AS INTEGER) AS height,
round(CASE WHEN c_custkey % 2 = 1 THEN -1 ELSE 1 END * (c_custkey % 90 + (c_custkey % 60) / 60.0 + c_nationkey / 3600.0), 6) + 0.0 AS gps_lat, CASE WHEN c_custkey % 3 <> 0 THEN -1.0 ELSE 1.0 END * (c_custkey % 180) + 0.0 AS gps_lon FROM customer""")
def picture_facts(c: Catalogue) -> DataFrame:
    """A picture file for every customer, of both byte orders, walked, read by segments and directories, and its facts as columns."""
    files = _made_files(c, c.table("customer").select("c_custkey", "c_nationkey", "c_mktsegment"), _picture, ".jpg")
    facts = metadata.image_facts(media_bytes.read_picture_tags(files))
    return facts.withColumns({"gps_lat": F.round("gps_lat", 6) + 0.0, "gps_lon": F.col("gps_lon") + 0.0})


@query("SELECT s_suppkey AS media_id, 10.0::DOUBLE + s_suppkey AS duration, CAST(640 + s_nationkey AS INTEGER) AS width, 480 AS height, CAST(s_suppkey % 80 AS DOUBLE) AS gps_lat, CAST(s_nationkey AS DOUBLE) AS gps_lon, 20 AS n_samples, round(s_suppkey % 80 + 0.0325, 6) AS lat_at, s_suppkey * 1.0 AS alt_at, 'interpolated' AS gps_source FROM supplier")
def video_facts(c: Catalogue) -> DataFrame:
    """A video file for every supplier: its boxes as columns, and its telemetry interpolated at 3.25 seconds."""
    films = _made_files(c, c.table("supplier").select("s_suppkey", "s_nationkey"), _film, ".mp4")
    facts = metadata.video_facts(media_bytes.read_video_tags(films), ["tags"])
    track = media_bytes.read_telemetry(films).select(F.col("video_id").alias("track"), F.col("t_offset_sec").alias("t"), "gps_lat", "gps_lon", "gps_alt", F.col("gps_datetime").alias("gps_datetime_utc"), "gps_fix")
    at = tracks.sample_at(films.select(F.col("media_id").alias("track"), F.lit(1).alias("target_id"), F.lit(3.25).alias("t")), track)
    counted = track.groupBy(F.col("track").alias("media_id")).agg(F.count("*").cast("int").alias("n_samples"))
    there = at.select(F.col("track").alias("media_id"), F.round("gps_lat", 6).alias("lat_at"), F.round("gps_alt", 6).alias("alt_at"), "gps_source")
    return facts.withColumns({"gps_lat": F.col("gps_lat"), "gps_lon": F.col("gps_lon")}).join(counted, "media_id").join(there, "media_id")


@query("SELECT source AS source_name, count(*) FILTER (doc_id % 7 <> 0) AS n_files, 0 AS n_errors, true AS sound FROM documents WHERE source IS NOT NULL GROUP BY source UNION ALL SELECT 'absent', 0, 1, false")
def scan_errors(c: Catalogue) -> DataFrame:
    """Files and errors by source, one of which isn't there, and which of them a sweep may take from."""
    root = _as_files(c)
    sources = {r["source"]: f"{root}/{r['source']}" for r in c.table("documents").where("source is not null").select("source").distinct().collect()} | {"absent": f"{root}/absent"}
    counts = media_source.error_counts(media_source.hashed(media_source.scan(c.spark, sources)), sources)
    sound = media_source.sound_sources(counts).withColumn("sound", F.lit(True))
    return counts.join(sound, "source_name", "left").fillna(False, ["sound"]).withColumns({"n_errors": F.col("n_errors").cast("int")})


@query(with_roles("media") + " SELECT media_id, path, ts_utc, row_number() OVER (ORDER BY ts_utc DESC, media_id DESC) AS rank FROM (SELECT * FROM media WHERE deleted = 0 ORDER BY ts_utc DESC, media_id DESC LIMIT 48 OFFSET 96) ORDER BY rank")
def browse_page_date_desc(c: Catalogue) -> DataFrame:
    page = browse.page(browse.select_media(c.media()), "date", "desc", 48, 96).select("media_id", "path", "ts_utc")
    return page.withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("ts_utc"), F.desc("media_id"))).cast("long"))


@query(with_roles("media") + " SELECT media_id, path, row_number() OVER (ORDER BY path, media_id) AS rank FROM (SELECT * FROM media WHERE deleted = 0 AND mime ILIKE 'video/%' ORDER BY path, media_id LIMIT 48) ORDER BY rank")
def browse_page_path_asc(c: Catalogue) -> DataFrame:
    page = browse.page(browse.select_media(c.media(), "video"), "path", "asc", 48).select("media_id", "path")
    return page.withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("path", "media_id")).cast("long"))


@query(with_roles("media") + " SELECT count(DISTINCT media_id) AS n FROM media WHERE deleted = 0 AND mime ILIKE 'image/%'")
def browse_count_distinct(c: Catalogue) -> DataFrame:
    return browse.total(browse.select_media(c.media(), "image"))


@query(with_roles("media") + " SELECT media_id, ts_utc FROM media WHERE deleted = 0 AND ts_utc >= '1995-03-10' AND ts_utc <= '1995-04-10'")
def browse_date_lexicographic(c: Catalogue) -> DataFrame:
    return browse.select_media(c.media(), first="1995-03-10", last="1995-04-10").select("media_id", "ts_utc")


@query(with_roles("media") + " SELECT media_id, place FROM media WHERE deleted = 0 AND place ILIKE '%asia%'")
def browse_place_ilike(c: Catalogue) -> DataFrame:
    return browse.select_media(c.media(), place="asia").select("media_id", "place")


PEOPLE_SQL = with_roles("media", "faces", "people") + ", " + NAMED + """, wanted AS (SELECT name FROM people WHERE person_id IN (1, 2)),
counts AS (SELECT media_id, count(DISTINCT CASE WHEN name IN (SELECT name FROM wanted) THEN name END) AS hit, count(DISTINCT name) AS every FROM named GROUP BY media_id)
SELECT media_id FROM media WHERE deleted = 0 AND media_id IN (SELECT media_id FROM counts WHERE """


@query(PEOPLE_SQL + "hit >= 1)")
def browse_people_any(c: Catalogue) -> DataFrame:
    return browse.with_people(filters.live(c.media()), c.faces(), c.people(), _two(c), "any").select("media_id")


@query(PEOPLE_SQL + "hit = 2)")
def browse_people_all(c: Catalogue) -> DataFrame:
    return browse.with_people(filters.live(c.media()), c.faces(), c.people(), _two(c), "all").select("media_id")


@query(PEOPLE_SQL.replace("IN (1, 2)", "IN (1)") + "hit = 1 AND every = 1)")
def browse_people_only(c: Catalogue) -> DataFrame:
    return browse.with_people(filters.live(c.media()), c.faces(), c.people(), _two(c)[:1], "only").select("media_id")


@query(with_roles("media", "media_tags") + " SELECT media_id FROM media m WHERE deleted = 0 AND EXISTS (SELECT 1 FROM media_tags t WHERE t.media_id = m.media_id AND tag IN (SELECT DISTINCT p_type FROM part ORDER BY p_type LIMIT 2))")
def browse_tags_any(c: Catalogue) -> DataFrame:
    two = [r[0] for r in c.table("part").select("p_type").distinct().orderBy("p_type").limit(2).collect()]
    return browse.with_tags(filters.live(c.media()), c.media_tags(), two).select("media_id")


@query(with_roles("media_tags") + " SELECT o_orderkey AS media_id, coalesce((SELECT string_agg(tag, '|' ORDER BY lower(tag), tag) FROM media_tags t WHERE t.media_id = o_orderkey), '') AS tags FROM orders")
def media_tags_sorted(c: Catalogue) -> DataFrame:
    media = c.table("orders").select(F.col("o_orderkey").alias("media_id"))
    return browse.tag_lists(media, c.media_tags()).select("media_id", F.array_join("tags", "|").alias("tags"))


@query("""WITH own AS (SELECT DISTINCT user_id AS media_id, event_type AS tag FROM events WHERE event_type = 'purchase' AND user_id % 2 = 0),
frame AS (SELECT DISTINCT user_id AS media_id, 'k' || (props ->> 'k') AS tag FROM events), m AS (SELECT DISTINCT user_id AS media_id FROM events)
SELECT media_id, coalesce((SELECT string_agg(tag, '|' ORDER BY lower(tag), tag) FROM own o WHERE o.media_id = m.media_id), (SELECT string_agg(tag, '|' ORDER BY lower(tag), tag) FROM frame f WHERE f.media_id = m.media_id), '') AS tags FROM m""")
def media_tags_fallback(c: Catalogue) -> DataFrame:
    e = c.table("events")
    own = e.where("event_type = 'purchase' and user_id % 2 = 0").select(F.col("user_id").alias("media_id"), F.col("event_type").alias("tag")).distinct()
    frame = e.select(F.col("user_id").alias("media_id"), F.concat(F.lit("k"), F.get_json_object("props", "$.k")).alias("tag")).distinct()
    media = e.select(F.col("user_id").alias("media_id")).distinct()
    return browse.tag_lists(media, own, frame).select("media_id", F.array_join("tags", "|").alias("tags"))


@query(with_roles("media_tags") + " SELECT tag, count(DISTINCT media_id) AS n FROM media_tags GROUP BY tag")
def tag_counts(c: Catalogue) -> DataFrame:
    return browse.tag_counts(c.media_tags())


@query("""WITH f AS (SELECT user_id AS video_id, CAST(ts AS DATE) AS day, epoch_us(ts) / 1000000.0 - 1704067200.0 AS t FROM events),
n AS (SELECT *, row_number() OVER (PARTITION BY video_id, day ORDER BY t) - 1 AS k FROM f), s AS (SELECT video_id, day, min(t) AS t_start, max(t) AS t_end, count(*) AS n_frames FROM f GROUP BY video_id, day)
SELECT s.video_id, CAST(date_diff('day', DATE '2024-01-01', s.day) AS INTEGER) AS shot_index, CAST(round((t_end - t_start) * 1000000) AS BIGINT) AS micros, n_frames, string_agg(CAST(k AS VARCHAR), ',' ORDER BY k) AS frames
FROM s JOIN n ON s.video_id = n.video_id AND s.day = n.day GROUP BY ALL""")
def shots_nested(c: Catalogue) -> DataFrame:
    rows = c.table("events").select(F.col("user_id").alias("video_id"), F.expr("date_diff(CAST(ts AS DATE), DATE'2024-01-01')").alias("shot_index"), F.expr("CAST(timestampdiff(MICROSECOND, TIMESTAMP_NTZ'2024-01-01 00:00:00', ts) AS DOUBLE) / 1000000.0").alias("timestamp"))
    frames = rows.withColumn("kf_index", F.row_number().over(Window.partitionBy("video_id", "shot_index").orderBy("timestamp")) - 1)
    shots = rows.groupBy("video_id", "shot_index").agg(F.min("timestamp").alias("t_start"), F.max("timestamp").alias("t_end"))
    nested = browse.shots_nested(shots, frames)
    return nested.select("video_id", "shot_index", F.round(F.col("duration") * 1000000).cast("long").alias("micros"), F.size("frames").cast("long").alias("n_frames"), F.array_join(F.transform("frames", lambda x: x["kf_index"].cast("string")), ",").alias("frames"))


# --- faces and people ---------------------------------------------------------------------------

UNIQUE = with_roles("media", "faces", "people") + """, own AS (SELECT f.* FROM faces f JOIN media m USING (media_id) WHERE deleted = 0),
best AS (SELECT person_id, face_id, confidence FROM (SELECT *, row_number() OVER (PARTITION BY person_id ORDER BY confidence DESC, face_id) AS k FROM own WHERE person_id IS NOT NULL) WHERE k = 1),
u AS (SELECT b.person_id, face_id, confidence, name, 0 AS section FROM best b JOIN people USING (person_id) UNION ALL SELECT NULL, face_id, confidence, NULL, 1 FROM own WHERE person_id IS NULL) """


@query(UNIQUE + "SELECT face_id, name, rank FROM (SELECT *, row_number() OVER (ORDER BY section, lower(name) NULLS FIRST, confidence DESC, face_id) AS rank FROM u) WHERE rank > 5 AND rank <= 55")
def faces_unique_page(c: Catalogue) -> DataFrame:
    return browse.unique_faces_page(browse.unique_faces(c.faces(), c.people(), c.media()), 50, 5).select("face_id", "name", "rank")


@query(UNIQUE + "SELECT count(*) AS n FROM u")
def faces_unique_count(c: Catalogue) -> DataFrame:
    return browse.unique_faces_count(browse.unique_faces(c.faces(), c.people(), c.media()))


@query(with_roles("media", "faces", "people") + """, own AS (SELECT f.* FROM faces f JOIN media m USING (media_id) WHERE deleted = 0 AND person_id IS NOT NULL),
r AS (SELECT person_id, face_id, row_number() OVER (PARTITION BY person_id ORDER BY confidence DESC, face_id) AS k, count(*) OVER (PARTITION BY person_id) AS n FROM own)
SELECT p.person_id, name, coalesce(n, 0) AS face_count, face_id FROM people p LEFT JOIN r ON p.person_id = r.person_id AND k = 1""")
def people_list(c: Catalogue) -> DataFrame:
    return browse.people_list(c.people(), c.faces(), c.media()).select("person_id", "name", "face_count", "face_id")


@query(with_roles("faces", "people") + " SELECT face_id, name, row_number() OVER (ORDER BY confidence DESC, face_id) AS rank FROM faces LEFT JOIN people USING (person_id) WHERE media_id = (SELECT min(o_orderkey) FROM orders)")
def media_faces_ranked(c: Catalogue) -> DataFrame:
    first = c.table("orders").agg(F.min("o_orderkey")).first()[0]
    return browse.media_faces(c.faces(), c.people(), first).select("face_id", "name", F.col("rank").cast("long").alias("rank"))


@query(with_roles("faces") + " SELECT media_id, person_id, face_id FROM (SELECT *, row_number() OVER (PARTITION BY media_id, person_id ORDER BY confidence DESC, face_id) AS k FROM faces WHERE person_id IS NOT NULL) WHERE k = 1")
def face_per_person_and_media(c: Catalogue) -> DataFrame:
    return browse.best_faces(c.faces().where("person_id is not null"), ["media_id", "person_id"]).select("media_id", "person_id", "face_id")


@query(with_roles("faces") + " SELECT coalesce(person_id, 7) AS person_id, count(*) AS n FROM faces GROUP BY ALL")
def label_faces(c: Catalogue) -> DataFrame:
    labels = c.faces().where("person_id is null").select("face_id", F.lit(7).cast("long").alias("person_id"))
    labelled, _ = tables.label_faces(c.faces(), labels)
    return labelled.groupBy("person_id").agg(F.count("*").alias("n"))


@query(with_roles("faces", "people") + " SELECT p.person_id, count(f.face_id) AS n FROM people p LEFT JOIN (SELECT CASE WHEN person_id = 2 THEN 1 ELSE person_id END AS person_id, face_id FROM faces) f USING (person_id) WHERE p.person_id <> 2 GROUP BY p.person_id")
def merge_people(c: Catalogue) -> DataFrame:
    people, faces = tables.merge_people(c.people(), c.faces(), 2, 1)
    return people.join(faces.groupBy("person_id").agg(F.count("*").alias("n")), "person_id", "left").select("person_id", F.coalesce("n", F.lit(0)).alias("n"))


# --- vectors ------------------------------------------------------------------------------------

HITS = with_roles("vectors") + """, hits AS (SELECT q.id AS query_id, v.id, v.person_id, round(list_cosine_similarity(q.vector, v.vector), 6) AS score FROM vectors q, vectors v WHERE q.id % 20 = 0),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM hits) """


@query(HITS + "SELECT query_id, id, score, rank FROM ranked WHERE rank <= 10")
def knn_batch_top10(c: Catalogue) -> DataFrame:
    v = c.vectors()
    return knn.search(v, v.where("id % 20 = 0"), 10).select("query_id", "id", "score", F.col("rank").cast("long").alias("rank"))


@query(HITS + "SELECT id, score, rank FROM ranked WHERE query_id = 0 AND rank <= 20")
def knn_top20(c: Catalogue) -> DataFrame:
    v = c.vectors()
    return knn.search(v, v.where("id = 0"), 20).select("id", "score", F.col("rank").cast("long").alias("rank"))


SUGGEST = """, groups AS (SELECT query_id, person_id, count(*) AS n, round(CAST(sum(CAST(round(score * 1000000) AS BIGINT)) AS DOUBLE) / count(*) / 1000000, 4) AS mean_score FROM ranked WHERE rank <= 50 AND person_id IS NOT NULL GROUP BY ALL)
SELECT query_id, person_id, n, mean_score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY n DESC, mean_score DESC, person_id) AS rank FROM groups) WHERE rank <= 5"""


@query(HITS + SUGGEST)
def face_suggestions_batch(c: Catalogue) -> DataFrame:
    v = c.vectors()
    hits = knn.search(v, v.where("id % 20 = 0"), 50).join(v.select("id", "person_id"), "id")
    people = v.select("person_id").where("person_id is not null").distinct()
    return knn.suggestions(hits, people, 5, 4).select("query_id", "person_id", "n", "mean_score", F.col("rank").cast("long").alias("rank"))


@query(HITS + "SELECT query_id, id, CASE WHEN person_id IS NOT NULL AND score >= 0.65 THEN 'known' WHEN score >= 0.65 THEN 'unknown' ELSE 'maybe' END AS band FROM ranked WHERE rank <= 30 AND query_id <> id AND (score >= 0.65 OR person_id IS NULL AND score >= 0.2)")
def similarity_bands(c: Catalogue) -> DataFrame:
    v = c.vectors()
    hits = knn.search(v, v.where("id % 20 = 0"), 30).join(v.select("id", "person_id"), "id").where("query_id != id")
    return hits.withColumn("band", filters.similarity_band(F.col("score"), F.col("person_id").isNotNull())).where("band is not null").select("query_id", "id", "band")


@query(with_roles("vectors") + " SELECT id, round(list_dot_product(vector, vector), 6) AS squared FROM vectors")
def vector_norms(c: Catalogue) -> DataFrame:
    return c.vectors().select("id", F.round(dot(F.col("vector"), F.col("vector")), 6).alias("squared"))


# --- search -------------------------------------------------------------------------------------

POINTS = with_roles("vectors") + """, q AS (SELECT id AS query_id, vector FROM vectors WHERE id % 20 = 0),
pts AS (SELECT id, id // 8 AS media_id, id % 2 AS o, CASE WHEN id % 2 = 1 THEN 'video' END AS kind, CASE WHEN id % 2 = 1 THEN CAST(id * 7 % 40 AS DOUBLE) END AS timestamp, 't' || (id % 3) AS tag, vector FROM vectors),
"""
HIT_ROWS = """hits AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, o ORDER BY score DESC, id) AS rank FROM scored) WHERE rank <= 100) """
SCORED = "scored AS (SELECT query_id, p.* EXCLUDE (vector), round(list_cosine_similarity(q.vector, p.vector), 6) AS score FROM pts p, q), "


def _collections(c: Catalogue) -> dict[str, DataFrame]:
    """Images and frames of videos, eight to a medium."""
    video = F.col("id") % 2 == 1
    v = c.vectors().select("id", "vector", F.expr("id div 8").alias("media_id"), F.when(video, "video").alias("kind"), F.when(video, (F.col("id") * 7 % 40).cast("double")).alias("timestamp"), F.array(F.concat(F.lit("t"), (F.col("id") % 3).cast("string"))).alias("tags"))
    return {"image": v.where("id % 2 = 0"), "video": v.where("id % 2 = 1")}


def _asked(c: Catalogue) -> DataFrame:
    return c.vectors().where("id % 20 = 0").select("id", "vector")


@query(POINTS + SCORED + HIT_ROWS + """SELECT query_id, media_id AS id, max(score) AS score, CASE WHEN max(CASE WHEN o = 0 THEN score END) >= coalesce(max(CASE WHEN o = 1 THEN score END), -2) THEN 'image' ELSE 'video' END AS source,
max(CASE WHEN o = 0 THEN score END) AS image_score, max(CASE WHEN o = 1 THEN score END) AS video_score FROM hits GROUP BY ALL""")
def merge_sources(c: Catalogue) -> DataFrame:
    merged = ranking.merge(search_plan.retrieve(_collections(c), _asked(c), search_plan.Request(retrieve=100))[0], partition=["query_id"])
    by = lambda s: F.try_element_at("source_scores", F.lit(s)).alias(f"{s}_score")
    return merged.select("query_id", "id", "score", "source", by("image"), by("video"))


SEARCHED = POINTS + SCORED.replace("FROM pts p, q", "FROM pts p, q WHERE id % 3 < 2") + HIT_ROWS + ", " + with_roles("media", "faces", "people").removeprefix("WITH ") + """, m AS (SELECT query_id, media_id AS id, max(score) AS score, arg_min(o, (-score, o, rank)) AS o, arg_min(kind, (o, rank)) FILTER (kind IS NOT NULL) AS kind, arg_min(timestamp, (o, rank)) FILTER (timestamp IS NOT NULL) AS timestamp, arg_min(tag, (o, rank)) AS tag FROM hits GROUP BY query_id, media_id),
names AS (SELECT DISTINCT media_id AS id, name FROM faces JOIN people USING (person_id)), asked AS (SELECT name FROM people WHERE person_id IN (1, 2)),
r AS (SELECT m.*, '/v/' || (id // 3) || '.mp4' AS path, place, ts_utc AS date, (SELECT count(*) FROM names n WHERE n.id = m.id AND n.name IN (SELECT name FROM asked)) AS hit,
    coalesce((SELECT string_agg(name, '|' ORDER BY name) FROM names n WHERE n.id = m.id), '') AS people FROM m JOIN media ON media_id = id WHERE deleted = 0 AND ts_utc >= '1992-06-01' AND (contains(lower(place), 'asia') OR contains(lower(place), 'america'))),
f AS (SELECT *, round(score * (1 + 0.25 * hit), 6) AS total_score FROM r WHERE id IN (SELECT id FROM names JOIN people USING (name) WHERE person_id <= 70)),
top AS (SELECT *, CASE WHEN kind = 'video' THEN path ELSE '=' || id END AS p, coalesce(timestamp, 0) AS t FROM f QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY total_score DESC, id) <= 50),
n AS (SELECT *, row_number() OVER (PARTITION BY query_id, p ORDER BY t, total_score DESC, id) AS k FROM top),
walk AS (
    WITH RECURSIVE w AS (
        SELECT query_id, p, k, id AS best, t, total_score AS s, 1 AS cluster FROM n WHERE k = 1
        UNION ALL
        SELECT n.query_id, n.p, n.k, CASE WHEN abs(n.t - w.t) <= 5 AND n.total_score <= w.s THEN w.best ELSE n.id END, CASE WHEN abs(n.t - w.t) <= 5 AND n.total_score <= w.s THEN w.t ELSE n.t END,
            CASE WHEN abs(n.t - w.t) <= 5 AND n.total_score <= w.s THEN w.s ELSE n.total_score END, CASE WHEN abs(n.t - w.t) <= 5 THEN w.cluster ELSE w.cluster + 1 END
        FROM w JOIN n ON n.query_id = w.query_id AND n.p = w.p AND n.k = w.k + 1)
    SELECT * FROM w),
best AS (SELECT query_id, arg_max(best, k) AS id FROM walk GROUP BY query_id, p, cluster)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY total_score DESC, id) AS rank, id, CASE o WHEN 0 THEN 'image' ELSE 'video' END AS source, score, total_score, round(score * 0.25 * hit, 6) + 0.0 AS person_boost, path, place, date, timestamp, tag AS tags, people, 'similarity ' || printf('%.3f', score) AS why
FROM best JOIN top USING (query_id, id)"""


def _search(c: Catalogue, asked: DataFrame) -> DataFrame:
    media = c.media().withColumn("path", F.concat(F.lit("/v/"), F.floor(F.col("media_id") / 3).cast("string"), F.lit(".mp4")))
    known = c.people().where("person_id <= 70").orderBy("person_id").collect()
    request = search_plan.Request(people=[r["name"] for r in known if r["person_id"] in (1, 2)], only_people=[r["name"] for r in known], tags=["t0", "t1"], places=["Asia", "america"], date_from="1992-06-01", retrieve=100)
    found = search_plan.search(_collections(c), asked, media, c.faces(), c.people(), request)
    return found.select("query_id", F.col("rank").cast("long").alias("rank"), "id", "source", "score", "total_score", numbers.rounded(F.col("person_boost"), 6).alias("person_boost"), "path", "place", "date", "timestamp", F.array_join("tags", "|").alias("tags"), F.array_join("people", "|").alias("people"), "why")


@query(SEARCHED)
def search_end_to_end(c: Catalogue) -> DataFrame:
    """Every vector whose id is divisible by 20 against all: tags, people, dates and places as filters, people as a boost, frames of a video in clusters."""
    return _search(c, _asked(c))


@query(SEARCHED.replace("WHERE id % 20 = 0", "WHERE id = 3"))
def search_one(c: Catalogue) -> DataFrame:
    """The same for one vector, as a user's search has it."""
    return _search(c, c.vectors().where("id = 3").select("id", "vector"))


@query(POINTS + """p AS (SELECT *, CASE WHEN id % 4 = 0 THEN id END AS m FROM pts)
SELECT CAST(id AS BIGINT) AS id, CAST(coalesce(m, id) AS VARCHAR) AS hit_id, CASE WHEN kind = 'video' THEN timestamp END AS timestamp, CASE WHEN kind IS NULL THEN '2024-01-' || lpad(CAST(id % 28 + 1 AS VARCHAR), 2, '0') END AS date,
CASE WHEN id % 5 = 0 THEN 'f' ELSE 'p' END AS faces FROM p""")
def hit_facts(c: Catalogue) -> DataFrame:
    points = c.vectors().select("id", F.when(F.col("id") % 4 == 0, F.col("id")).alias("media_id"), F.when(F.col("id") % 2 == 1, "video").alias("kind"), F.when(F.col("id") % 2 == 1, (F.col("id") * 7 % 40).cast("string")).otherwise(F.concat(F.lit("2024-01-"), F.lpad((F.col("id") % 28 + 1).cast("string"), 2, "0"))).alias("timestamp"), F.when(F.col("id") % 5 == 0, F.array(F.lit("f"))).alias("faces"), F.array(F.lit("p")).alias("people"))
    return search_plan.hit_facts(points).select("id", "hit_id", "timestamp", "date", F.array_join("faces", "|").alias("faces"))


@query(with_roles("media") + " SELECT event_id AS id, CASE WHEN event_id % 2 = 0 THEN 'known' ELSE m.place END AS place, coalesce(CASE WHEN event_id % 3 = 0 THEN 'early' END, ts_utc) AS date FROM events LEFT JOIN media m ON media_id = event_id")
def results_backfilled(c: Catalogue) -> DataFrame:
    results = c.table("events").select(F.col("event_id").alias("id"), F.when(F.col("event_id") % 2 == 0, "known").alias("place"), F.when(F.col("event_id") % 3 == 0, "early").otherwise("").alias("date"))
    return search_plan.backfilled(results, c.media(), 10**9)


@query("SELECT CAST(vec_id AS BIGINT) AS id FROM embeddings WHERE label = 1 AND vec_id > 40 ORDER BY vec_id LIMIT 25")
def points_scrolled(c: Catalogue) -> DataFrame:
    points = c.table("embeddings").select(F.col("vec_id").cast("long").alias("id"), F.struct("label").alias("payload"))
    return knn.scrolled(points, {"label": 1}, 40, 25).select("id")


@query("SELECT 'retrieved' AS what, count(DISTINCT vec_id) AS n FROM embeddings WHERE vec_id IN (SELECT o_orderkey FROM orders) UNION ALL SELECT 'counted', count(*) FROM embeddings WHERE label = 1 UNION ALL SELECT 'missing', count(*) FROM orders WHERE o_orderkey NOT IN (SELECT vec_id FROM embeddings)")
def points_by_id(c: Catalogue) -> DataFrame:
    points = c.table("embeddings").select(F.col("vec_id").cast("long").alias("id"), F.col("embedding").alias("vector"), F.struct("label").alias("payload"))
    ids = c.table("orders").select(F.col("o_orderkey").alias("id"))
    named = lambda what, rows: rows.select(F.lit(what).alias("what"), "n")
    return named("retrieved", knn.counted(knn.retrieved(points, ids.unionByName(ids)))).unionByName(named("counted", knn.counted(points, {"label": 1}))).unionByName(named("missing", knn.missing_queries(ids, points).agg(F.count("*").alias("n"))))


@query("""SELECT l_orderkey AS id, l_linenumber AS n, l_suppkey AS s, l_partkey AS p, round(l_discount * (1 + 0.25 * (CASE WHEN l_returnflag = 'A' THEN 1 ELSE 0 END)), 6) AS boosted,
round(l_discount * (1 + 0.25 * (CASE WHEN l_returnflag = 'A' THEN 1 ELSE 0 END)) * (CASE WHEN l_linestatus = 'O' AND l_discount > 0 THEN 1.5 ELSE 1 END), 6) AS total_score FROM lineitem""")
def score_breakdown(c: Catalogue) -> DataFrame:
    faces = query_text.face_names(F.concat(F.col("l_returnflag"), F.lit(" (0.98), x")))
    parts = ranking.score_breakdown(F.col("l_discount"), faces, F.array(F.lit("a")), F.col("l_linestatus") == "O")
    rows = c.table("lineitem").withColumn("b", parts)
    return rows.select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("n"), F.col("l_suppkey").alias("s"), F.col("l_partkey").alias("p"), F.round(F.col("b.similarity_score") + F.col("b.person_boost"), 6).alias("boosted"), F.round("b.total_score", 6).alias("total_score"))


@query(with_roles("frames") + """, n AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY timestamp, score DESC, id) AS k FROM frames),
walk AS (
    WITH RECURSIVE w AS (
        SELECT path, k, id AS best, timestamp AS t, score AS s, 1 AS cluster FROM n WHERE k = 1
        UNION ALL
        SELECT n.path, n.k, CASE WHEN abs(n.timestamp - w.t) <= 21600 AND n.score <= w.s THEN w.best ELSE n.id END, CASE WHEN abs(n.timestamp - w.t) <= 21600 AND n.score <= w.s THEN w.t ELSE n.timestamp END,
            CASE WHEN abs(n.timestamp - w.t) <= 21600 AND n.score <= w.s THEN w.s ELSE n.score END, CASE WHEN abs(n.timestamp - w.t) <= 21600 THEN w.cluster ELSE w.cluster + 1 END
        FROM w JOIN n ON n.path = w.path AND n.k = w.k + 1)
    SELECT * FROM w)
SELECT path, arg_max(best, k) AS id FROM walk GROUP BY path, cluster""")
def temporal_dedup(c: Catalogue) -> DataFrame:
    return ranking.cluster_in_time(c.frames(), 21600.0).select("path", "id")


@query(with_roles("media", "faces", "people") + """, ids AS (SELECT DISTINCT media_id FROM faces WHERE person_id IN (SELECT person_id FROM people WHERE person_id IN (1, 2)))
SELECT media_id AS id, ts_utc, (SELECT string_agg(DISTINCT name, '|' ORDER BY name) FROM faces f JOIN people USING (person_id) WHERE f.media_id = m.media_id) AS people FROM media m WHERE deleted = 0 AND media_id IN (SELECT media_id FROM ids) ORDER BY ts_utc DESC, updated_seq DESC, media_id LIMIT 100""")
def person_expansion(c: Catalogue) -> DataFrame:
    media = c.media().withColumn("added_at", F.col("updated_seq"))
    return ranking.expand_people(media, c.faces(), c.people(), [n.upper() for n in _two(c)]).select("id", "ts_utc", F.array_join("people", "|").alias("people"))


@query(with_roles("media", "faces", "people") + """, n AS (SELECT media_id, count(DISTINCT name) FILTER (person_id < 20) AS hit FROM faces JOIN people USING (person_id) GROUP BY media_id)
SELECT media_id AS id, round(0.1 * (media_id % 7), 6) AS f_total, round(coalesce(hit, 0) / 20, 6) AS f_people, CASE WHEN ts_utc >= '1995-01-01' AND ts_utc <= '1996-12-31' THEN 1.0::DOUBLE ELSE 0.0 END AS f_in_dates,
CASE WHEN contains(lower(place), 'asia') THEN 1.0::DOUBLE ELSE 0.0 END AS f_in_place, round(date_diff('day', CAST(substr(ts_utc, 1, 10) AS DATE), DATE '2000-01-01') / 365.25, 4) AS f_age FROM media LEFT JOIN n USING (media_id)""")
def rerank_features(c: Catalogue) -> DataFrame:
    people = c.faces().join(c.people(), "person_id").groupBy("media_id").agg(F.collect_set("name").alias("people"))
    wanted = [r["name"] for r in c.people().where("person_id < 20").collect()]
    rows = c.media().join(people, "media_id", "left").select(F.col("media_id").alias("id"), (F.col("media_id") % 7 * 0.1).alias("total_score"), F.lit(0.0).alias("similarity_score"), "people", F.array().cast("array<string>").alias("tags"), F.col("ts_utc").alias("date"), "place")
    found = ranking.features(rows, wanted + [f"nobody {k}" for k in range(20 - len(wanted))], [], "1995-01-01", "1996-12-31", "ASIA", "2000-01-01")
    return found.select("id", *(F.round(x, 6).alias(x) for x in ("f_total", "f_people")), "f_in_dates", "f_in_place", F.round("f_age", 4).alias("f_age"))


ASKED = """t AS (SELECT 'c' AS kind, conv_id AS id, turn, text FROM conversations UNION ALL SELECT 'd', doc_id, 0, text FROM documents),
asked AS (SELECT kind, id, turn, trim(coalesce(text, '') || CASE (id + turn) % 6 WHEN 0 THEN ' from 2016' WHEN 1 THEN ' Last Year' WHEN 2 THEN ' 7  years ago with x' WHEN 3 THEN ' 2015 or 2016' WHEN 4 THEN ' in 1999 and 20161' ELSE '' END) AS s FROM t)"""


def _dated(c: Catalogue) -> DataFrame:
    """Every turn and every document as a query; five of six name a time."""
    turns = c.table("conversations").select(F.lit("c").alias("kind"), F.col("conv_id").alias("id"), "turn", "text")
    rows = turns.unionByName(c.table("documents").select(F.lit("d").alias("kind"), F.col("doc_id").alias("id"), F.lit(0).cast("long").alias("turn"), "text"))
    said = [" from 2016", " Last Year", " 7  years ago with x", " 2015 or 2016", " in 1999 and 20161", ""]
    return rows.select("kind", "id", "turn", F.concat(F.coalesce("text", F.lit("")), F.array(*(F.lit(x) for x in said))[((F.col("id") + F.col("turn")) % 6).cast("int")]).alias("q"))


@query("WITH " + ASKED + r""", y AS (SELECT *, regexp_extract(s, '(?i)\b(\d{1,2})\s+years\s+ago\b', 1) AS ago, regexp_extract_all(s, '\b(?:19|20)\d{2}\b') AS years FROM asked),
z AS (SELECT *, CASE WHEN regexp_matches(s, '(?i)\blast year\b') THEN 2025 WHEN ago <> '' THEN 2026 - CAST(ago AS INTEGER) WHEN len(years) = 1 THEN CAST(years[1] AS INTEGER) END AS year,
CASE WHEN regexp_matches(s, '(?i)\blast year\b') THEN regexp_replace(s, '(?i)\blast year\b', ' ', 'g') WHEN ago <> '' THEN regexp_replace(s, '(?i)\b\d{1,2}\s+years\s+ago\b', ' ', 'g') WHEN len(years) = 1 THEN regexp_replace(s, '\b(?:19|20)\d{2}\b', ' ', 'g') ELSE s END AS rest FROM y)
SELECT kind, id, turn, trim(regexp_replace(rest, '\s+', ' ', 'g')) AS visual_query, year || '-01-01' AS date_from, year || '-12-31' AS date_to FROM z""")
def date_intent(c: Catalogue) -> DataFrame:
    found = query_text.date_intent(F.col("q"), date(2026, 3, 30))
    return _dated(c).select("kind", "id", "turn", found.alias("d")).select("kind", "id", "turn", "d.visual_query", "d.date_from", "d.date_to")


@query(r"""WITH t AS (SELECT conv_id, turn, trim(coalesce(text, '') || coalesce(' with ' || upper(s_name) || ', ' || s_name || '.', '') || ' near ' || n_name || ' or Supplier#900000000') AS s, s_name, n_name
FROM conversations LEFT JOIN supplier ON s_suppkey = (conv_id * 7 + turn) % 20 JOIN nation ON n_nationkey = turn % 25),
w AS (SELECT *, list_filter(regexp_extract_all(lower(regexp_replace(s, '(?i)\b(Supplier#0\d{8}|Supplier|NATION_\d+)\b', ' ', 'g')), '[a-z0-9'']+'), lambda x: x NOT IN ('a', 'an', 'and', 'at', 'by', 'for', 'from', 'in', 'near', 'of', 'on', 'the', 'to', 'with')) AS words FROM t)
SELECT conv_id, turn, array_to_string(words, ' ') AS visual_query, concat_ws(', ', s_name, CASE WHEN length(n_name) > 8 THEN n_name || ', Supplier' ELSE concat_ws(', ', n_name, 'Supplier') END) AS people FROM w""")
def query_decompose(c: Catalogue) -> DataFrame:
    """Every turn with names that it mentions, against all suppliers, nations and regions, and the word that all suppliers' names begin with."""
    suppliers, nations = c.table("supplier"), c.table("nation")
    known = [suppliers.select(F.col("s_name").alias("name")), nations.select(F.col("n_name").alias("name")), c.table("region").select(F.col("r_name").alias("name")), suppliers.select(F.regexp_extract("s_name", "^([A-Za-z]+)", 1).alias("name"))]
    turns = c.table("conversations").join(suppliers.select("s_suppkey", "s_name"), F.col("s_suppkey") == (F.col("conv_id") * 7 + F.col("turn")) % 20, "left").join(nations.select("n_nationkey", "n_name"), F.col("n_nationkey") == F.col("turn") % 25)
    mention = F.coalesce(F.concat(F.lit(" with "), F.upper("s_name"), F.lit(", "), "s_name", F.lit(".")), F.lit(""))
    asked = turns.select("conv_id", "turn", F.concat(F.coalesce("text", F.lit("")), mention, F.lit(" near "), "n_name", F.lit(" or Supplier#900000000")).alias("q"))
    return names.decomposed(asked, known[0].unionByName(known[1]).unionByName(known[2]).unionByName(known[3])).select("conv_id", "turn", "visual_query", F.array_join("people", ", ").alias("people"))


@query(r"SELECT doc_id, len(regexp_extract_all(lower(text), '[a-z0-9'']+')) AS n_tokens, len(list_filter(regexp_extract_all(lower(text), '[a-z0-9'']+'), lambda x: x NOT IN ('a', 'an', 'and', 'at', 'by', 'for', 'from', 'in', 'near', 'of', 'on', 'the', 'to', 'with'))) AS n_visual FROM documents WHERE text IS NOT NULL")
def stopword_tokens(c: Catalogue) -> DataFrame:
    t = F.col("text")
    return c.table("documents").where(t.isNotNull()).select("doc_id", F.size(query_text.tokens(t)).cast("long").alias("n_tokens"), F.size(query_text.visual_tokens(t)).cast("long").alias("n_visual"))


@query("SELECT e.event_id AS id FROM events e WHERE event_id NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P')")
def tombstone_anti(c: Catalogue) -> DataFrame:
    return filters.without_deleted(c.table("events").select(F.col("event_id").alias("id")), c.media()).select("id")


# --- tracks -------------------------------------------------------------------------------------


@query(with_roles("frames") + """, s AS (SELECT path, timestamp AS t, score AS v FROM frames WHERE event_type = 'purchase'), g AS (SELECT path, id, timestamp AS t FROM frames WHERE event_type = 'click'),
p AS (SELECT g.*, s.t AS pt, s.v AS pv FROM g ASOF LEFT JOIN s ON g.path = s.path AND g.t > s.t), j AS (SELECT p.*, s.t AS nt, s.v AS nv FROM p ASOF LEFT JOIN s ON p.path = s.path AND p.t <= s.t)
SELECT path AS track, id AS target_id, round(CASE WHEN pt IS NULL THEN CASE WHEN nt - t <= 21600 THEN nv END WHEN nt IS NULL THEN CASE WHEN t - pt <= 21600 THEN pv END
WHEN nt - pt <= 86400 THEN pv + (t - pt) / (nt - pt) * (nv - pv) WHEN t - pt <= nt - t THEN CASE WHEN t - pt <= 21600 THEN pv END WHEN nt - t <= 21600 THEN nv END, 6) AS lat FROM j""")
def gps_asof_interpolate(c: Catalogue) -> DataFrame:
    f = c.frames()
    samples = f.where("event_type = 'purchase'").select(F.col("path").alias("track"), F.col("timestamp").alias("t"), F.col("score").alias("gps_lat"), F.lit(0.0).alias("gps_lon"), F.lit(None).cast("double").alias("gps_alt"), F.lit("").alias("gps_datetime_utc"), F.lit(3).alias("gps_fix"))
    targets = f.where("event_type = 'click'").select(F.col("path").alias("track"), F.col("id").alias("target_id"), F.col("timestamp").alias("t"))
    return tracks.sample_at(targets, samples, 21600.0, 86400.0).select("track", "target_id", F.round("gps_lat", 6).alias("lat"))


@query("""WITH s AS (SELECT o_orderkey AS video_id, 0.0 AS a, o_totalprice / 1000 AS b FROM orders WHERE o_orderstatus = 'O')
SELECT video_id, k AS kf_index, round(CASE k WHEN 0 THEN a WHEN 1 THEN (a + b) / 2 ELSE b END, 6) AS t FROM s, (VALUES (0), (1), (2)) v(k) WHERE b > a""")
def keyframe_sample_times(c: Catalogue) -> DataFrame:
    shots = c.table("orders").where("o_orderstatus = 'O'").select(F.col("o_orderkey").alias("video_id"), F.lit(0.0).alias("t_start"), (F.col("o_totalprice") / 1000).alias("t_end"))
    return tracks.shot_frames(shots, 3).select("video_id", "kf_index", F.round("timestamp", 6).alias("t"))


@query("WITH v AS (SELECT p_partkey AS video_id, p_size AS frames, least(8, p_size) AS n FROM part) SELECT video_id, i * frames // n AS frame FROM v, range(8) r(i) WHERE i < n")
def uniform_frame_index(c: Catalogue) -> DataFrame:
    return tracks.spread_frames(c.table("part").select(F.col("p_partkey").alias("video_id"), F.col("p_size").alias("frame_count")), 8).select("video_id", "frame")


@query("SELECT o_orderkey AS video_id, CAST(CASE WHEN o_orderkey % 3 = 0 THEN 0 ELSE 1 END AS INTEGER) AS is_synthetic, round(o_totalprice / 100, 4) AS t_end FROM orders WHERE o_orderstatus = 'O'")
def synthetic_shots(c: Catalogue) -> DataFrame:
    videos = c.table("orders").where("o_orderstatus = 'O'").select(F.col("o_orderkey").alias("video_id"), (F.col("o_totalprice") / 100).alias("duration"))
    shots = videos.where("video_id % 3 = 0").select("video_id", F.lit(0).alias("shot_index"), F.lit(0.0).alias("t_start"), F.col("duration").alias("t_end"))
    return tracks.with_whole_shot(videos, shots).select("video_id", "is_synthetic", F.round("t_end", 4).alias("t_end"))


# --- ingest and export --------------------------------------------------------------------------


@query(with_roles("files") + " SELECT media_id, count(*) AS n, min(source_name || '/' || rel_path) AS first FROM files GROUP BY media_id HAVING count(*) > 1")
def content_copies(c: Catalogue) -> DataFrame:
    files = c.files().withColumn("source_name", F.coalesce("source_name", F.lit("")))
    return reports.copies(files).select("media_id", "n", F.concat_ws("/", "source_name", "rel_path").alias("first"))


def _scan(c: Catalogue) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A scan after one day: some files touched, some replaced, some gone, some new."""
    f = c.files().where("rel_path is not null and source_name is not null")
    state = f.where("doc_id % 7 != 0").select("source_name", "rel_path", "size_bytes", F.lit(1).cast("long").alias("mtime_ns"), "media_id", F.lit(1).cast("long").alias("last_seen_scan_id"), F.when(F.col("doc_id") % 13 == 0, 1).cast("long").alias("missing_since_scan_id"))
    changed = F.when(F.col("doc_id") % 5 == 0, F.sha2(F.concat("media_id", F.lit("x")), 256)).otherwise(F.col("media_id"))
    snapshot = f.where("doc_id % 11 != 0").select("source_name", "rel_path", "size_bytes", F.when((F.col("doc_id") % 3 == 0) | (F.col("doc_id") % 5 == 0), 2).otherwise(1).cast("long").alias("mtime_ns"), changed.alias("media_id"))
    media = state.groupBy("media_id").agg(F.min(F.struct("source_name", "rel_path")).alias("p"), F.min("missing_since_scan_id").alias("missing_since_scan_id"))
    media = media.select("media_id", "p.source_name", "p.rel_path", F.when(F.substring("media_id", 1, 1) == "0", 1).otherwise(0).alias("deleted"), "missing_since_scan_id")
    return snapshot, state, media


SCAN = with_roles("files") + """, f AS (SELECT * FROM files WHERE source_name IS NOT NULL AND rel_path IS NOT NULL),
state AS (SELECT source_name, rel_path, size_bytes, 1 AS mtime_ns, media_id, 1 AS last_seen, CASE WHEN doc_id % 13 = 0 THEN 1 END AS missing FROM f WHERE doc_id % 7 <> 0),
snapshot AS (SELECT source_name, rel_path, size_bytes, CASE WHEN doc_id % 3 = 0 OR doc_id % 5 = 0 THEN 2 ELSE 1 END AS mtime_ns, CASE WHEN doc_id % 5 = 0 THEN sha256(media_id || 'x') ELSE media_id END AS media_id FROM f WHERE doc_id % 11 <> 0),
med AS (SELECT media_id, min({'s': source_name, 'r': rel_path}) AS p, CASE WHEN media_id[1] = '0' THEN 1 ELSE 0 END AS deleted, min(missing) AS missing FROM state GROUP BY media_id) """


@query(SCAN + """SELECT s.rel_path, CASE WHEN o.size_bytes = s.size_bytes AND o.mtime_ns = s.mtime_ns THEN 'hit' WHEN o.media_id = s.media_id THEN 'refreshed' WHEN m.media_id IS NULL THEN 'new' WHEN m.deleted = 1 THEN 'resurrected'
WHEN h.media_id = s.media_id THEN 'copy' ELSE 'move' END AS decision, coalesce(o.media_id <> s.media_id AND NOT (o.size_bytes = s.size_bytes AND o.mtime_ns = s.mtime_ns), false) AS replaced
FROM snapshot s LEFT JOIN state o USING (source_name, rel_path) LEFT JOIN med m ON m.media_id = s.media_id LEFT JOIN snapshot h ON h.source_name = m.p.s AND h.rel_path = m.p.r""")
def fingerprint_classify(c: Catalogue) -> DataFrame:
    return ingest.classify(*_scan(c)).select("rel_path", "decision", F.coalesce("replaced", F.lit(False)).alias("replaced"))


@query(SCAN + """, seen AS (SELECT st.*, CASE WHEN sn.rel_path IS NOT NULL THEN 2 ELSE 1 END AS now FROM state st LEFT JOIN snapshot sn USING (source_name, rel_path))
SELECT rel_path, CASE WHEN now = 2 THEN 'keep' WHEN missing IS NULL THEN 'grace' ELSE 'delete' END AS action FROM seen""")
def deletion_sweep(c: Catalogue) -> DataFrame:
    snapshot, state, _ = _scan(c)
    return ingest.swept(_seen(snapshot, state), 2).select("rel_path", "action")


def _seen(snapshot: DataFrame, state: DataFrame) -> DataFrame:
    now = snapshot.select(*ingest.PLACE, F.lit(True).alias("now"))
    return state.join(now, ingest.PLACE, "left").withColumn("last_seen_scan_id", F.when(F.col("now"), F.lit(2)).otherwise(F.col("last_seen_scan_id"))).drop("now")


@query(SCAN + """, seen AS (SELECT st.media_id, CASE WHEN sn.rel_path IS NULL AND missing IS NOT NULL THEN 1 ELSE 0 END AS gone FROM state st LEFT JOIN snapshot sn USING (source_name, rel_path))
SELECT media_id FROM seen JOIN med m USING (media_id) WHERE deleted = 0 GROUP BY media_id HAVING min(gone) = 1""")
def tombstoned_media(c: Catalogue) -> DataFrame:
    snapshot, state, media = _scan(c)
    return ingest.tombstoned(ingest.swept(_seen(snapshot, state), 2), media)


@query(SCAN + ", held AS (SELECT m.media_id FROM med m WHERE deleted = 0 AND NOT EXISTS (SELECT 1 FROM snapshot s WHERE s.media_id = m.media_id AND s.source_name = m.p.s AND s.rel_path = m.p.r)) SELECT media_id, min({'s': source_name, 'r': rel_path}).r AS rel_path FROM snapshot JOIN held USING (media_id) GROUP BY media_id")
def promoted_paths(c: Catalogue) -> DataFrame:
    snapshot, _, media = _scan(c)
    return ingest.promoted(media, snapshot).select("media_id", "rel_path")


@query(SCAN + ", orphans AS (SELECT * FROM med m WHERE deleted = 0 AND NOT EXISTS (SELECT 1 FROM snapshot s WHERE s.media_id = m.media_id)) SELECT media_id, CASE WHEN missing IS NULL THEN 'grace' WHEN missing <> 2 THEN 'tombstone' ELSE 'keep' END AS action FROM orphans")
def legacy_orphans(c: Catalogue) -> DataFrame:
    snapshot, _, media = _scan(c)
    return ingest.legacy_orphans(media, snapshot, 2)


EXPORTED = with_roles("media", "media_tags") + " SELECT media_id, path, coalesce((SELECT string_agg(tag, '|' ORDER BY tag) FROM media_tags t WHERE t.media_id = m.media_id), '') AS tags FROM media m WHERE deleted = 0 AND (media_id % 11 = 0 OR mime LIKE 'image/%') AND NOT ends_with(path, '.mp4')"


def _image_points(c: Catalogue, since: int | None) -> DataFrame:
    """Points of the images, where every eleventh medium's kind is unknown."""
    media = c.media().withColumns({"mime": F.when(F.col("media_id") % 11 != 0, F.col("mime")), "added_at": F.lit("")})
    vectors = media.select("media_id", F.array().cast("array<float>").alias("embedding"), "updated_seq")
    return cdc.image_points(media.drop("updated_seq"), vectors, c.media_tags(), since).select("media_id", "payload.path", F.array_join("payload.tags", "|").alias("tags"))


@query(EXPORTED + " AND updated_seq > 30")
def delta_export_rows(c: Catalogue) -> DataFrame:
    return _image_points(c, 30)


@query(EXPORTED)
def image_export_rows(c: Catalogue) -> DataFrame:
    return _image_points(c, None)


@query(with_roles("media") + ", e AS (SELECT media_id, updated_seq FROM media), f AS (SELECT l_orderkey + l_linenumber AS updated_seq FROM lineitem) SELECT greatest((SELECT max(updated_seq) FROM e), (SELECT max(updated_seq) FROM f)) AS n")
def max_stamp(c: Catalogue) -> DataFrame:
    return cdc.highest_stamp(c.media(), c.table("lineitem").select((F.col("l_orderkey") + F.col("l_linenumber")).alias("updated_seq")))


@query(with_roles("faces") + " SELECT DISTINCT face_id, media_id FROM faces WHERE person_id = 1")
def stamp_propagation(c: Catalogue) -> DataFrame:
    faces = c.faces()
    frames = c.table("orders").select(F.col("o_orderkey").alias("video_id"), F.col("o_orderkey").alias("keyframe_id"))
    keys = cdc.stamped_keys("person", c.people().where("person_id = 1"), faces, frames)
    return keys["face"].join(faces.select("face_id", "media_id"), "face_id").join(keys["frame"], F.col("media_id") == F.col("keyframe_id"), "left_semi")


@query(with_roles("faces") + " SELECT 'media' AS rule, 'face' AS kind, count(*) AS n FROM faces WHERE media_id % 9 = 0 UNION ALL SELECT 'media', 'frame', count(*) FROM orders WHERE o_orderkey % 9 = 0 UNION ALL SELECT 'media', 'media', count(*) FROM orders WHERE o_orderkey % 9 = 0 UNION ALL SELECT 'frames', 'frame', count(*) FROM orders WHERE o_orderkey % 4 = 0 UNION ALL SELECT 'faces', 'face', count(DISTINCT face_id) FROM faces WHERE media_id % 5 = 0 UNION ALL SELECT 'faces', 'frame', count(DISTINCT media_id) FROM faces WHERE media_id % 5 = 0")
def stamp_rules(c: Catalogue) -> DataFrame:
    faces = c.faces()
    frames = c.table("orders").select(F.col("o_orderkey").alias("video_id"), F.col("o_orderkey").alias("keyframe_id"))
    changed = {"media": c.media().where("media_id % 9 = 0").select("media_id"), "frames": frames.where("keyframe_id % 4 = 0").select("keyframe_id"), "faces": faces.where("media_id % 5 = 0").select("face_id")}
    out = None
    for rule, kinds in (("media", ["face", "frame", "media"]), ("frames", ["frame"]), ("faces", ["face", "frame"])):
        keys = cdc.stamped_keys(rule, changed[rule], faces, frames)
        for kind in kinds:
            row = keys[kind].agg(F.lit(rule).alias("rule"), F.lit(kind).alias("kind"), F.count("*").alias("n"))
            out = row if out is None else out.unionByName(row)
    return out


@query("SELECT vec_id AS id, CASE WHEN vec_id % 3 = 0 THEN greatest(vec_id % 40, 25) ELSE vec_id % 40 END AS updated_seq FROM embeddings")
def stamps_raised(c: Catalogue) -> DataFrame:
    rows = c.table("embeddings").select(F.col("vec_id").alias("id"), (F.col("vec_id") % 40).alias("updated_seq"))
    return cdc.stamp(rows, rows.where("id % 3 = 0"), "id", 25)


@query("SELECT doc_id, CAST(('0x' || substr(sha256(CAST(doc_id AS VARCHAR)), 1, 16))::UBIGINT % 9223372036854775808::UBIGINT AS BIGINT) AS point_id FROM documents")
def face_point_ids(c: Catalogue) -> DataFrame:
    return c.table("documents").select("doc_id", ids.face_point_id(F.col("doc_id")).alias("point_id"))


@query("SELECT doc_id, CAST(('0x' || hex(substr(sha256(text), 1, 8)))::UBIGINT % 9223372036854775808::UBIGINT AS BIGINT) AS point_id FROM documents WHERE text IS NOT NULL")
def image_point_ids(c: Catalogue) -> DataFrame:
    return c.table("documents").where("text is not null").select("doc_id", ids.image_point_id(ids.content_id(F.col("text"))).alias("point_id"))


@query("SELECT doc_id, CAST((('0x' || hex(substr(sha256(text), 1, 6)))::UBIGINT * 65536 + (doc_id % 256) * 256 + (doc_id * 7) % 256) % 9223372036854775808::UBIGINT AS BIGINT) AS point_id FROM documents WHERE text IS NOT NULL")
def keyframe_point_ids(c: Catalogue) -> DataFrame:
    return c.table("documents").where("text is not null").select("doc_id", ids.keyframe_point_id(ids.content_id(F.col("text")), F.col("doc_id"), F.col("doc_id") * 7).alias("point_id"))


def _export_tables(c: Catalogue) -> dict[str, DataFrame]:
    media = c.media().withColumns({"added_at": F.lit(""), "deleted_seq": F.col("updated_seq")})
    faces = c.faces().dropDuplicates(["face_id"])
    frames = c.table("lineitem").select(F.concat_ws("-", "l_orderkey", "l_linenumber").alias("keyframe_id"), F.col("l_orderkey").alias("video_id"), F.lit(0).alias("shot_index"), F.col("l_linenumber").alias("kf_index")).distinct()
    frames = frames.withColumns({"timestamp": F.lit(0.0), "shot_start": F.lit(0.0), "shot_end": F.lit(1.0), "tags": F.lit("[]"), "place": F.lit("")})
    vector, stamp = F.array().cast("array<float>").alias("embedding"), lambda key: (F.col(key) % 50).alias("updated_seq")
    vectors = {"image_vectors": media.select("media_id", vector, "updated_seq"), "frame_vectors": frames.select("keyframe_id", vector, stamp("video_id")), "face_vectors": faces.select("face_id", vector, stamp("media_id"))}
    return {"media": media.drop("updated_seq"), "media_tags": c.media_tags(), "faces": faces, "people": c.people(), "frames": frames} | vectors


@query(with_roles("media", "faces") + """, k AS (SELECT DISTINCT l_orderkey AS media_id, l_linenumber FROM lineitem)
SELECT 'image' AS collection, 'write' AS action, count(*) AS n FROM media WHERE deleted = 0 AND mime LIKE 'image/%' AND updated_seq > 30 UNION ALL SELECT 'video', 'write', count(*) FROM k JOIN media USING (media_id) WHERE deleted = 0 AND updated_seq > 30
UNION ALL SELECT 'face', 'write', count(DISTINCT face_id) FROM faces JOIN media USING (media_id) WHERE deleted = 0 AND updated_seq > 30 UNION ALL SELECT 'image', 'delete', count(*) FROM media WHERE deleted = 1 AND updated_seq > 30
UNION ALL SELECT 'video', 'delete', count(*) FROM k JOIN media USING (media_id) WHERE deleted = 1 AND updated_seq > 30 UNION ALL SELECT 'face', 'delete', count(DISTINCT face_id) FROM faces JOIN media USING (media_id) WHERE deleted = 1 AND updated_seq > 30""")
def export_dry_run(c: Catalogue) -> DataFrame:
    return cdc.dry_run(cdc.pending(_export_tables(c), 30))


@query(with_roles("media") + " SELECT o_orderkey AS media_id, CASE WHEN deleted = 0 AND mime LIKE 'image/%' AND updated_seq > 30 THEN path ELSE 'old' END AS path FROM orders JOIN media ON media_id = o_orderkey WHERE NOT (deleted = 1 AND updated_seq > 30)")
def export_round(c: Catalogue) -> DataFrame:
    """The image collection, one old point for every medium, after a delta export."""
    old = c.media().select(ids.image_point_id(F.col("media_id").cast("string")).alias("point_id"), "media_id", F.lit("old").alias("path"))
    changes = cdc.pending(_export_tables(c), 30)
    changes["image"] = changes["image"].select("point_id", "media_id", F.col("payload.path").alias("path"))
    return cdc.exported({"image": old}, changes)["image"].select("media_id", "path")


# --- reports ------------------------------------------------------------------------------------


@query(with_roles("media", "faces", "people") + """ SELECT (SELECT count(*) FROM media WHERE deleted = 0 AND mime LIKE 'image/%') AS images, (SELECT count(*) FROM media WHERE deleted = 0 AND mime LIKE 'video/%') AS videos,
(SELECT round(sum(duration), 2) FROM media WHERE deleted = 0 AND mime LIKE 'video/%') AS video_seconds, (SELECT max(ts_utc) FROM media WHERE deleted = 0) AS latest, (SELECT count(*) FROM faces) AS faces,
(SELECT count(DISTINCT person_id) FROM faces) AS labelled, (SELECT count(*) FROM people) AS people""")
def index_stats(c: Catalogue) -> DataFrame:
    return reports.index_stats(c.media(), c.faces(), c.people())


@query(with_roles("media") + """, k AS (SELECT *, mime LIKE 'image/%' AS i FROM media)
SELECT CASE WHEN i THEN 'image' ELSE 'video' END AS kind, CASE WHEN i THEN CASE WHEN size_bytes < 1048576 THEN 'small' WHEN size_bytes < 10485760 THEN 'medium' WHEN size_bytes < 104857600 THEN 'large' ELSE 'xlarge' END
ELSE CASE WHEN size_bytes < 10485760 THEN 'small' WHEN size_bytes < 104857600 THEN 'medium' WHEN size_bytes < 1073741824 THEN 'large' ELSE 'xlarge' END END AS band, count(*) AS n, CAST(sum(size_bytes) AS BIGINT) AS bytes FROM k GROUP BY ALL""")
def dryrun_size_histogram(c: Catalogue) -> DataFrame:
    return reports.size_histogram(c.media())


@query(with_roles("media") + " SELECT CASE WHEN duration < 60 THEN 'small' WHEN duration < 300 THEN 'medium' WHEN duration < 1800 THEN 'large' ELSE 'xlarge' END AS band, count(*) AS n FROM media WHERE mime LIKE 'video/%' AND duration > 0 GROUP BY band")
def dryrun_duration_histogram(c: Catalogue) -> DataFrame:
    return reports.duration_histogram(c.media())


@query("SELECT o_orderpriority AS source, count(*) AS n, list_sort(list(o_totalprice))[count(*) // 2 + 1] AS p50, list_sort(list(o_totalprice))[least(count(*) - 1, count(*) * 95 // 100) + 1] AS p95, max(o_totalprice) AS longest FROM orders GROUP BY o_orderpriority")
def commit_percentiles(c: Catalogue) -> DataFrame:
    return reports.latency(c.table("orders").select(F.col("o_orderpriority").alias("source"), F.col("o_totalprice").alias("v")), ["source"], "v")


@query(with_roles("frames") + " SELECT * FROM (SELECT id, CAST(round((timestamp - lag(timestamp) OVER (PARTITION BY path ORDER BY timestamp)) * 1000000) AS BIGINT) AS micros FROM frames) WHERE micros IS NOT NULL")
def commit_gaps(c: Catalogue) -> DataFrame:
    return reports.gaps(c.frames(), ["path"], "timestamp").select("id", F.round(F.col("gap") * 1000000).cast("long").alias("micros")).where("micros is not null")


@query("SELECT doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def missing_embeddings(c: Catalogue) -> DataFrame:
    return reports.missing_vectors(c.table("documents").select("doc_id"), c.table("labels"), "doc_id")


@query("""WITH i AS (SELECT source AS search_id, doc_id AS media_id, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) - 1 AS position FROM documents WHERE source IS NOT NULL),
o AS (SELECT DISTINCT doc_id FROM labels WHERE quality = 1) SELECT search_id, media_id, position, CAST(CASE WHEN o.doc_id IS NULL THEN 0 ELSE 1 END AS INTEGER) AS was_opened FROM i LEFT JOIN o ON media_id = doc_id""")
def ledger_join(c: Catalogue) -> DataFrame:
    shown = tables.ledger_positions(c.table("documents").where("source is not null").select(F.col("source").alias("search_id"), F.col("doc_id").alias("media_id"), F.col("n_chars").alias("score")))
    opens = c.table("labels").where("quality = 1").join(c.table("documents").select("doc_id", "source"), "doc_id").select(F.col("source").alias("search_id"), F.col("doc_id").alias("media_id"), F.lit("2024-01-01T00:00:00").alias("opened_at"))
    return tables.opened(shown, opens).select("search_id", "media_id", "position", "was_opened")


@query("SELECT coalesce(s.s_suppkey, n.k) AS person_id, CASE WHEN n.k IS NOT NULL THEN n.name ELSE s.s_name END AS name, s.s_acctbal AS balance FROM supplier s FULL JOIN (SELECT c_custkey AS k, c_name AS name FROM customer) n ON s.s_suppkey = n.k")
def keyed_upsert(c: Catalogue) -> DataFrame:
    table = c.table("supplier").select(F.col("s_suppkey").alias("person_id"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance"))
    rows = c.table("customer").select(F.col("c_custkey").alias("person_id"), F.col("c_name").alias("name"))
    return tables.upsert(table, rows, ["person_id"])


def _stored(c: Catalogue, kind: str, rows: DataFrame, keys: list[str], buckets: int = 16) -> versioned.KeyedTable:
    table, _ = versioned.KeyedTable.ensure(c.spark, store.shared_folder(c.spark, kind), rows.schema, keys, buckets)
    return table.upsert(rows)


@query("SELECT coalesce(s.s_suppkey, n.k) AS person_id, CASE WHEN n.k IS NOT NULL THEN n.name ELSE s.s_name END AS name, s.s_acctbal AS balance FROM supplier s FULL JOIN (SELECT c_custkey AS k, c_name AS name FROM customer WHERE c_custkey % 3 <> 0) n ON s.s_suppkey = n.k WHERE coalesce(s.s_suppkey, n.k) % 5 <> 0")
def stored_upsert(c: Catalogue) -> DataFrame:
    """Suppliers stored, customers put in, some keys deleted, and read back from the last version's files."""
    table = _stored(c, "people", c.table("supplier").select(F.col("s_suppkey").alias("person_id"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance")), ["person_id"])
    table = table.upsert(c.table("customer").where("c_custkey % 3 != 0").select(F.col("c_custkey").alias("person_id"), F.col("c_name").alias("name")))
    table = table.delete(table.read().where("person_id % 5 = 0").select("person_id"))
    return versioned.KeyedTable.open(c.spark, table.folder).read()


@query("SELECT 1 AS rewritten, true AS older_version_stays, true AS lost_writer_told, true AS created, false AS created_again, count(*) AS n FROM orders")
def stored_one_bucket(c: Catalogue) -> DataFrame:
    """How many buckets the change of one order rewrites, and what becomes of other versions and writers."""
    orders = c.table("orders").select(F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("status"))
    folder = store.shared_folder(c.spark, "orders")
    first, created = versioned.KeyedTable.ensure(c.spark, folder, orders.schema, ["k"], 32)
    first = first.upsert(orders)
    _, again = versioned.KeyedTable.ensure(c.spark, folder, orders.schema, ["k"], 32)
    one = orders.orderBy("k").limit(1).withColumn("status", F.lit("!"))
    later = first.upsert(one)
    rewritten = sum(first.version.folders.get(b) != p for b, p in later.version.folders.items())
    older = versioned.KeyedTable.open(c.spark, folder, first.version.number).read().where("status = '!'").isEmpty()
    try:
        first.upsert(one)
        told = False
    except versioned.Conflict:
        told = True
    return later.read().agg(F.lit(rewritten).alias("rewritten"), F.lit(older).alias("older_version_stays"), F.lit(told).alias("lost_writer_told"), F.lit(created).alias("created"), F.lit(again).alias("created_again"), F.count("*").alias("n"))


@query("SELECT 49 AS exported, 30 AS exported_before, count(*) AS n, count(*) FILTER (vec_id % 50 > 30) AS rewritten FROM embeddings WHERE vec_id % 50 < 45 OR vec_id % 50 > 47")
def stored_export(c: Catalogue) -> DataFrame:
    """Points exported up to a stamp, then those of later stamps with deletions and the watermark in one version; a writer that dies in between leaves the first."""
    points = c.table("embeddings").select(F.col("vec_id").cast("long").alias("point_id"), (F.col("vec_id") % 50).cast("long").alias("stamp"), F.lit(1).alias("round"))
    target, _ = versioned.KeyedTable.ensure(c.spark, store.shared_folder(c.spark, "points"), points.schema, ["point_id"], 16)
    first = versioned.export_into(target, points, points.where("false"), 30)
    points.withColumn("round", F.lit(9)).write.parquet(f"{target.folder}/data/never-committed")
    opened = versioned.KeyedTable.open(c.spark, target.folder)
    versioned.export_into(opened, cdc.changed_since(points.withColumnRenamed("stamp", "updated_seq"), 30).withColumnRenamed("updated_seq", "stamp").withColumn("round", F.lit(2)), points.where("stamp between 45 and 47"), 49)
    last = versioned.KeyedTable.open(c.spark, target.folder)
    return last.read().agg(F.lit(last.marks["exported"]).alias("exported"), F.lit(opened.marks["exported"]).alias("exported_before"), F.count("*").alias("n"), F.count_if(F.col("round") == 2).alias("rewritten"))


LETTERS = "aeioutns"


@query("WITH f AS (SELECT source AS video_id, doc_id AS frame, doc_id * 0.04::DOUBLE AS t, ["
+ ", ".join(f"CAST(length(text) - length(replace(text, '{x}', '')) AS DOUBLE)" for x in LETTERS)
+ """] AS h FROM documents WHERE source IS NOT NULL),
p AS (SELECT *, lag(h) OVER (PARTITION BY video_id ORDER BY frame) AS h0 FROM f),
d AS (SELECT video_id, frame, t, CASE WHEN list_sum(h) > 0 AND list_sum(h0) > 0 THEN CAST(round(list_sum(list_transform(range(1, len(h) + 1), lambda k: abs(h[k] / list_sum(h) - h0[k] / list_sum(h0)))) / 2 * 1000000) AS BIGINT) END AS difference FROM p),
n AS (SELECT *, sum(difference) OVER w - difference AS others, count(difference) OVER w - 1 AS n FROM d WINDOW w AS (PARTITION BY video_id ORDER BY frame RANGE BETWEEN 8 PRECEDING AND 8 FOLLOWING)),
a AS (SELECT *, CASE WHEN difference >= 100000 AND difference * n >= 1.5::DOUBLE * others THEN difference END AS able FROM n),
c AS (SELECT * FROM a x WHERE able IS NOT NULL AND NOT EXISTS (SELECT 1 FROM a y WHERE y.video_id = x.video_id AND y.frame BETWEEN x.frame - 11 AND x.frame + 11 AND (y.able > x.able OR y.able = x.able AND y.frame < x.frame))),
e AS (SELECT video_id, min(frame) AS a, max(frame) AS z FROM f GROUP BY video_id),
s AS (SELECT video_id, frame, t FROM c JOIN e USING (video_id) WHERE frame - a >= 12 AND z + 1 - frame >= 12 UNION ALL SELECT f.video_id, f.frame, f.t FROM f JOIN e ON e.video_id = f.video_id AND frame = a)
SELECT s.video_id, row_number() OVER v - 1 AS shot_index, s.frame AS first_frame, t AS t_start, coalesce(lead(t) OVER v, z * 0.04::DOUBLE) AS t_end FROM s JOIN e USING (video_id) WINDOW v AS (PARTITION BY video_id ORDER BY frame)""")
def histogram_shots(c: Catalogue) -> DataFrame:
    """Shots of the documents of a source as one video's frames; a text's counts of letters are its histogram."""
    counts = F.array(*(F.length("text") - F.length(F.replace("text", F.lit(x), F.lit(""))) for x in LETTERS))
    frames = c.table("documents").select(F.col("source").alias("video_id"), F.col("doc_id").alias("frame"), (F.col("doc_id") * F.lit(0.04)).alias("t"), counts.alias("histogram"))
    return shots.shots(frames, 1.5, 0.1, 8, 12)


@query(r"""WITH o AS (SELECT o_orderkey AS id, o_orderkey % 7 AS k, o_custkey AS c, CAST(o_orderdate AS TIMESTAMP) AS d FROM orders),
v AS (SELECT *, CASE k WHEN 0 THEN 'photo' || c || '.JPG' WHEN 1 THEN 'a.b' || c || '.webm' WHEN 2 THEN strftime(d, '%Y:%m:%d') || ' 10:00:00' WHEN 3 THEN c || 'ms' WHEN 4 THEN (c % 90) || '.5s/min' WHEN 5 THEN '+' || lpad(CAST(c % 90 AS VARCHAR), 2, '0') || '.25-' || lpad(CAST(c % 180 AS VARCHAR), 3, '0') || '.5/' ELSE c || 'm' END AS s FROM o)
SELECT id, s, lower(regexp_extract(s, '\.([^./\\]+)$', 1)) AS ext, CASE k WHEN 0 THEN 'image' WHEN 1 THEN 'video' END AS kind, CASE WHEN k = 2 THEN strftime(d, '%Y-%m-%d') || 'T10:00:00' END AS taken,
CASE k WHEN 3 THEN round(c / 1000.0::DOUBLE, 6) WHEN 4 THEN c % 90 + 0.5::DOUBLE WHEN 6 THEN c * 60.0::DOUBLE END AS seconds, CASE WHEN k = 5 THEN c % 90 + 0.25::DOUBLE END AS lat, CASE WHEN k = 5 THEN -(c % 180 + 0.5::DOUBLE) END AS lon FROM v""")
def scalar_parsers(c: Catalogue) -> DataFrame:
    """File names, times, durations and positions made of every order."""
    k, s, who = F.col("o_orderkey") % 7, F.col("s"), F.col("o_custkey")
    digits = lambda n, of: F.lpad((who % of).cast("string"), n, "0")
    made = [F.concat(F.lit("photo"), who, F.lit(".JPG")), F.concat(F.lit("a.b"), who, F.lit(".webm")), F.concat(F.date_format("o_orderdate", "yyyy:MM:dd"), F.lit(" 10:00:00")), F.concat(who, F.lit("ms")), F.concat(who % 90, F.lit(".5s/min")), F.concat(F.lit("+"), digits(2, 90), F.lit(".25-"), digits(3, 180), F.lit(".5/")), F.concat(who, F.lit("m"))]
    rows = c.table("orders").select(F.col("o_orderkey").alias("id"), F.array(*made)[k.cast("int")].alias("s"))
    return rows.select("id", "s", extension(s).alias("ext"), file_kind(s).alias("kind"), exif_time(s).alias("taken"), F.round(duration_seconds(s), 6).alias("seconds"), iso6709(s)["lat"].alias("lat"), iso6709(s)["lon"].alias("lon"))


@query(with_roles("media") + """, b AS (SELECT media_id AS id, CASE WHEN media_id % 3 = 0 THEN size_bytes // 100000 WHEN media_id % 3 = 1 THEN size_bytes ELSE size_bytes * 100 END AS b FROM media),
t AS (SELECT *, CASE WHEN b < 1048576 THEN 1024 WHEN b < 1073741824 THEN 1048576 ELSE 1073741824 END AS u FROM b)
SELECT id, CASE WHEN b < 1024 THEN b || ' B' ELSE (b * 10 + u // 2) // u // 10 || '.' || (b * 10 + u // 2) // u % 10 || CASE u WHEN 1024 THEN ' KB' WHEN 1048576 THEN ' MB' ELSE ' GB' END END AS size FROM t""")
def size_texts(c: Catalogue) -> DataFrame:
    size = F.col("size_bytes")
    size = F.when(F.col("media_id") % 3 == 0, F.floor(size / 100000)).when(F.col("media_id") % 3 == 1, size).otherwise(size * 100)
    return c.media().select(F.col("media_id").alias("id"), size_text(size).alias("size"))


# --- more of tables, ingest and export ------------------------------------------------------------


@query(with_roles("media_tags") + " SELECT tag, count(*) AS n FROM (SELECT media_id, tag FROM media_tags UNION SELECT o_orderkey, 'NEW ' || o_orderstatus FROM orders) GROUP BY tag")
def tags_added(c: Catalogue) -> DataFrame:
    pairs = c.media_tags().withColumnRenamed("tag", "name")
    new = c.table("orders").select(F.col("o_orderkey").alias("media_id"), F.concat(F.lit("NEW "), "o_orderstatus").alias("name"))
    _, bridge = tables.add_tags(pairs.select("name").distinct(), pairs, new.unionByName(new))
    return bridge.groupBy(F.col("name").alias("tag")).agg(F.count("*").alias("n"))


@query("SELECT l_orderkey AS video_id, CAST(CASE WHEN l_orderkey % 10 = 0 THEN 1 ELSE count(*) END AS BIGINT) AS n FROM lineitem GROUP BY l_orderkey")
def shots_replaced(c: Catalogue) -> DataFrame:
    old = c.table("lineitem").select(F.col("l_orderkey").alias("video_id"), F.col("l_linenumber").alias("shot_index"))
    new = old.where("video_id % 10 = 0").select("video_id", F.lit(0).alias("shot_index")).distinct()
    return tables.replace_groups(old, new, ["video_id"]).groupBy("video_id").agg(F.count("*").alias("n"))


@query(with_roles("faces") + " SELECT 'faces' AS name, count(*) AS n FROM faces WHERE media_id % 7 <> 0 UNION ALL SELECT 'tags', count(*) FROM (SELECT DISTINCT l_orderkey, p_type FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_orderkey % 7 <> 0)")
def cascade_delete(c: Catalogue) -> DataFrame:
    gone = c.media().where("media_id % 7 = 0").select("media_id")
    left = tables.cascade({"faces": c.faces(), "tags": c.media_tags()}, gone, "media_id")
    return left["faces"].agg(F.lit("faces").alias("name"), F.count("*").alias("n")).unionByName(left["tags"].agg(F.lit("tags").alias("name"), F.count("*").alias("n")))


@query("SELECT s_suppkey AS point_id, CASE WHEN c_custkey IS NOT NULL THEN c_name ELSE s_name END AS name, s_acctbal AS balance FROM supplier LEFT JOIN (SELECT * FROM customer WHERE c_custkey % 3 = 0) ON s_suppkey = c_custkey")
def payload_patch(c: Catalogue) -> DataFrame:
    points = c.table("supplier").select(F.col("s_suppkey").alias("point_id"), F.struct(F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance")).alias("payload"))
    patch = c.table("customer").where("c_custkey % 3 = 0").select(F.col("c_custkey").alias("point_id"), F.col("c_name").alias("name"))
    return tables.patch_payload(points, patch).select("point_id", "payload.name", "payload.balance")


@query("SELECT CAST(vec_id AS BIGINT) AS point_id, CASE WHEN vec_id % 4 = 0 THEN 'new' ELSE 'old' END AS version FROM embeddings WHERE vec_id % 9 <> 0 OR vec_id % 4 = 0")
def index_upsert_and_delete(c: Catalogue) -> DataFrame:
    points = c.table("embeddings").select(F.col("vec_id").cast("long").alias("point_id"), F.lit("old").alias("version"))
    left = cdc.remove_points(points, points.where("point_id % 9 = 0"))
    return cdc.upsert_points(left, points.where("point_id % 4 = 0").withColumn("version", F.lit("new")))


@query(with_roles("media", "faces", "people") + " SELECT face_id, m.path, name AS person_name, ts_utc AS date FROM faces f JOIN media m USING (media_id) LEFT JOIN people p ON p.person_id = f.person_id WHERE deleted = 0 AND f.media_id % 10 > 4")
def face_export_rows(c: Catalogue) -> DataFrame:
    vectors = c.faces().select("face_id", F.array().cast("array<float>").alias("embedding"), (F.col("media_id") % 10).alias("updated_seq"))
    points = cdc.face_points(c.media(), c.faces(), c.people(), vectors, 4)
    return points.select("face_id", "payload.path", "payload.person_name", "payload.date")


@query(with_roles("media", "faces", "people", "media_tags") + """, f AS (SELECT l_orderkey AS media_id, l_linenumber, min(l_partkey) AS keyframe_id, min(l_suppkey) AS s FROM lineitem GROUP BY ALL)
SELECT f.media_id, f.l_linenumber AS kf, CASE WHEN s % 2 = 0 THEN 'own' ELSE (SELECT string_agg(tag, '|' ORDER BY tag) FROM media_tags t WHERE t.media_id = f.media_id) END AS tags, m.place,
coalesce((SELECT string_agg(DISTINCT name, '|' ORDER BY name) FROM faces a JOIN people USING (person_id) WHERE a.media_id = f.media_id), '') AS people FROM f JOIN media m USING (media_id) WHERE deleted = 0""")
def frame_export_rows(c: Catalogue) -> DataFrame:
    rows = c.table("lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_suppkey").alias("s"))
    key = F.concat_ws("-", "l_orderkey", "l_linenumber")
    frames = rows.select(key.alias("keyframe_id"), F.col("l_orderkey").alias("video_id"), F.lit(0).alias("shot_index"), F.col("l_linenumber").alias("kf_index"), F.lit(0.0).alias("timestamp"), F.lit(0.0).alias("shot_start"), F.lit(1.0).alias("shot_end"), F.when(F.col("s") % 2 == 0, '["own"]').otherwise("[]").alias("tags"), F.lit("").alias("place"))
    vectors = frames.select("keyframe_id", F.array().cast("array<float>").alias("embedding"), F.lit(1).alias("updated_seq"))
    named = c.faces().join(c.people(), "person_id").select("media_id", "name")
    points = cdc.frame_points(c.media(), frames, vectors, c.media_tags(), named)
    return points.select("media_id", F.split("keyframe_id", "-")[1].cast("int").alias("kf"), F.array_join("payload.tags", "|").alias("tags"), "payload.place", F.array_join("payload.people", "|").alias("people"))


@query(with_roles("media", "faces") + """, gone AS (SELECT media_id FROM media WHERE deleted = 1 AND updated_seq > 40)
SELECT 'image' AS collection, count(*) AS n FROM gone UNION ALL SELECT 'face', count(*) FROM faces WHERE media_id IN (SELECT media_id FROM gone) UNION ALL SELECT 'video', count(*) FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey IN (SELECT media_id FROM gone))""")
def delta_tombstones(c: Catalogue) -> DataFrame:
    media = c.media().withColumn("deleted_seq", F.col("updated_seq"))
    frames = c.table("lineitem").select(F.col("l_orderkey").alias("video_id"), F.lit(0).alias("shot_index"), F.col("l_linenumber").alias("kf_index")).distinct()
    return cdc.tombstoned_points(media, c.faces(), frames, 40).groupBy("collection").agg(F.count("*").alias("n"))


DECIDED = SCAN + """, d AS (SELECT s.*, o.media_id AS old, o.size_bytes = s.size_bytes AND o.mtime_ns = s.mtime_ns AS same, CASE WHEN o.size_bytes = s.size_bytes AND o.mtime_ns = s.mtime_ns THEN 'hit' WHEN o.media_id = s.media_id THEN 'refreshed' WHEN m.media_id IS NULL THEN 'new' WHEN m.deleted = 1 THEN 'resurrected'
WHEN h.media_id = s.media_id THEN 'copy' ELSE 'move' END AS decision FROM snapshot s LEFT JOIN state o USING (source_name, rel_path) LEFT JOIN med m ON m.media_id = s.media_id LEFT JOIN snapshot h ON h.source_name = m.p.s AND h.rel_path = m.p.r),
after AS (SELECT source_name, rel_path, CASE WHEN same THEN old ELSE media_id END AS media_id, 1 AS seen FROM d UNION ALL SELECT source_name, rel_path, media_id, 0 FROM state WHERE missing IS NULL AND (source_name, rel_path) NOT IN (SELECT (source_name, rel_path) FROM snapshot))"""


@query(DECIDED + """, lost AS (SELECT DISTINCT old FROM d WHERE NOT coalesce(same, false) AND old <> media_id)
SELECT count(*) FILTER (decision = 'hit') AS hit, count(*) FILTER (decision = 'refreshed') AS refreshed, count(*) FILTER (decision = 'new') AS new, count(*) FILTER (decision = 'copy') AS copy, count(*) FILTER (decision = 'move') AS move, count(*) FILTER (decision = 'resurrected') AS resurrected,
count(*) FILTER (decision <> 'hit') AS hashed, count(*) FILTER (NOT coalesce(same, false) AND old <> media_id) AS changed,
(SELECT count(*) FROM lost JOIN med ON media_id = old WHERE deleted = 0 AND old NOT IN (SELECT media_id FROM after WHERE seen = 1)) AS superseded,
(SELECT count(*) FROM med WHERE deleted = 0 AND media_id IN (SELECT media_id FROM state WHERE missing IS NOT NULL AND (source_name, rel_path) NOT IN (SELECT (source_name, rel_path) FROM snapshot)) AND media_id NOT IN (SELECT media_id FROM after)) AS tombstoned FROM d""")
def scan_counters(c: Catalogue) -> DataFrame:
    return ingest.apply_scan(*_scan(c), 2)["counters"]


@query(DECIDED + """, held AS (SELECT media_id, min({'s': source_name, 'r': rel_path}).r AS first, max(seen) AS seen FROM after GROUP BY media_id),
still AS (SELECT DISTINCT m.media_id FROM med m JOIN after a ON a.media_id = m.media_id AND a.source_name = m.p.s AND a.rel_path = m.p.r)
SELECT coalesce(m.media_id, h.media_id) AS media_id, CASE WHEN m.media_id IS NULL OR h.media_id IS NOT NULL AND m.media_id NOT IN (SELECT media_id FROM still) THEN h.first ELSE m.p.r END AS rel_path,
CASE WHEN h.media_id IS NULL THEN 1 WHEN h.seen = 1 THEN 0 ELSE m.deleted END AS deleted FROM med m FULL JOIN held h ON h.media_id = m.media_id""")
def scan_applied(c: Catalogue) -> DataFrame:
    return ingest.apply_scan(*_scan(c), 2)["media"].select("media_id", "rel_path", "deleted")


@query(DECIDED + " SELECT rel_path, media_id, seen FROM after")
def scan_prints(c: Catalogue) -> DataFrame:
    return ingest.apply_scan(*_scan(c), 2)["state"].select("rel_path", "media_id", (F.col("last_seen_scan_id") == 2).cast("int").alias("seen"))


@query("""WITH k AS (SELECT DISTINCT l_orderkey AS media_id, l_linenumber AS k FROM lineitem WHERE l_orderkey % 4 <> 1) SELECT o_orderkey AS media_id, o_orderkey % 3 = 0 AS has_embedding, o_orderkey % 4 <> 1 AND EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey) AS has_shots,
(SELECT count(*) FROM k WHERE media_id = o_orderkey) AS n_frames, (SELECT count(*) FROM k WHERE media_id = o_orderkey AND k.k % 2 = 1) AS n_frame_vectors FROM orders WHERE o_orderstatus <> 'P'""")
def processing_flags(c: Catalogue) -> DataFrame:
    frames = c.table("lineitem").where("l_orderkey % 4 != 1").select(F.concat_ws("-", "l_orderkey", "l_linenumber").alias("keyframe_id"), F.col("l_orderkey").alias("video_id"), "l_linenumber").distinct()
    vectors = frames.where("l_linenumber % 2 = 1").select("keyframe_id")
    found = ingest.processing_flags(c.media(), c.media().where("media_id % 3 = 0").select("media_id"), frames.select("video_id"), frames.select("keyframe_id", "video_id"), vectors)
    return found.select("media_id", "has_embedding", "has_shots", "n_frames", "n_frame_vectors")


@query(SCAN + """SELECT s.rel_path FROM snapshot s JOIN state o USING (source_name, rel_path) JOIN med m ON m.media_id = o.media_id WHERE o.size_bytes = s.size_bytes AND o.mtime_ns = s.mtime_ns AND deleted = 0 AND ascii(m.media_id[2]) % 2 = 0""")
def free_skips(c: Catalogue) -> DataFrame:
    snapshot, state, media = _scan(c)
    done = (F.ascii(F.substring("media_id", 2, 1)) % 2 == 0).cast("int")
    flags = media.withColumns({"mime": F.lit("image/jpeg"), "has_embedding": F.lit(True), "embeddings_version": F.lit("v2"), "face_detection_done": done, "object_detection_done": F.lit(1), "n_frames": F.lit(0), "n_frame_vectors": F.lit(0)})
    return ingest.free_skips(ingest.needs_hash(snapshot.drop("media_id"), state), ingest.work_needed(flags, "v2")).select("rel_path")


@query(SCAN + ", lost AS (SELECT DISTINCT o.media_id FROM snapshot s JOIN state o USING (source_name, rel_path) WHERE o.media_id <> s.media_id AND NOT (o.size_bytes = s.size_bytes AND o.mtime_ns = s.mtime_ns)) SELECT media_id FROM lost JOIN med USING (media_id) WHERE deleted = 0 AND media_id NOT IN (SELECT CASE WHEN o.size_bytes = s.size_bytes AND o.mtime_ns = s.mtime_ns THEN o.media_id ELSE s.media_id END FROM snapshot s LEFT JOIN state o USING (source_name, rel_path))")
def superseded_media(c: Catalogue) -> DataFrame:
    snapshot, state, media = _scan(c)
    return ingest.superseded(ingest.classify(snapshot, state, media), media)


@query(with_roles("media") + """ SELECT media_id, CAST(mime LIKE 'image/%' AND (media_id % 3 = 0 OR media_id % 4 <> 0) AS BOOLEAN) AS needs_embedding, media_id % 5 = 0 AS needs_faces, mime NOT LIKE 'image/%' AND (media_id % 4 = 0 OR media_id % 3 < media_id % 4) AS needs_frames FROM media WHERE deleted = 0""")
def work_needed(c: Catalogue) -> DataFrame:
    k = F.col("media_id")
    flags = {"has_embedding": k % 3 != 0, "embeddings_version": F.when(k % 4 == 0, "v2").otherwise("v1"), "face_detection_done": (k % 5 != 0).cast("int"), "object_detection_done": F.lit(1), "n_frames": (k % 4).cast("int"), "n_frame_vectors": (k % 3).cast("int")}
    return ingest.work_needed(c.media().withColumns(flags), "v2").select("media_id", "needs_embedding", "needs_faces", "needs_frames")


@query(with_roles("files") + " SELECT rel_path, (row_number() OVER (PARTITION BY source_name ORDER BY rel_path) - 1) // 20 AS batch FROM files WHERE source_name IS NOT NULL")
def commit_groups(c: Catalogue) -> DataFrame:
    return ingest.commit_groups(c.files().where("source_name is not null"), 20).select("rel_path", "batch")


@query("""WITH g AS (SELECT n_name AS name, (n_nationkey * 7) % 178 - 89 + 0.37 AS plat, (n_nationkey * 29) % 360 - 180 + 0.53 AS plon FROM nation), p AS (SELECT c_custkey AS id, (c_custkey * 13) % 180 - 90 + 0.11 AS lat, (c_custkey * 31) % 360 - 180 + 0.29 AS lon FROM customer)
SELECT id, arg_min(name || ', x, yy', (round(2 * 6371.0 * asin(sqrt(power(sin(radians(plat - lat) / 2), 2) + cos(radians(lat)) * cos(radians(plat)) * power(sin(radians(plon - lon) / 2), 2))), 6), name)) AS place FROM p, g GROUP BY id""")
def nearest_place(c: Catalogue) -> DataFrame:
    at = lambda k, a, b, o, d: ((F.col(k) * a) % b - o + d).cast("double")
    gazetteer = c.table("nation").select(F.col("n_name").alias("name"), F.lit("x").alias("admin1"), F.lit("yy").alias("cc"), at("n_nationkey", 7, 178, 89, 0.37).alias("lat"), at("n_nationkey", 29, 360, 180, 0.53).alias("lon"))
    points = c.table("customer").select(F.col("c_custkey").alias("id"), at("c_custkey", 13, 180, 90, 0.11).alias("lat"), at("c_custkey", 31, 360, 180, 0.29).alias("lon"))
    return tracks.nearest_place(points, gazetteer).select("id", "place")


@query("SELECT o_orderkey AS id, CAST(floor(CAST(sum(c) OVER w AS DOUBLE) / count(*) OVER w * (1000000 - count(*) OVER w)) AS BIGINT) AS eta FROM (SELECT *, CAST(round(o_totalprice) AS BIGINT) AS c FROM orders) WINDOW w AS (PARTITION BY o_orderpriority ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)")
def running_eta(c: Catalogue) -> DataFrame:
    steps = c.table("orders").select(F.col("o_orderkey").alias("id"), "o_orderpriority", F.round("o_totalprice").cast("long").alias("seconds"), F.lit(1000000).alias("total"))
    return reports.running_eta(steps, ["o_orderpriority"], "id", "seconds", "total").select("id", F.floor("eta").alias("eta"))


@query("""WITH l AS (SELECT DISTINCT l_orderkey * 8 + l_linenumber AS id, l_orderkey AS o, CAST(round(l_extendedprice) AS BIGINT) AS seconds FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_extendedprice, l_partkey, l_suppkey) = 1)
SELECT id, CAST(floor(CAST(sum(seconds) OVER w AS DOUBLE) / count(*) OVER w * (10000000 - count(*) OVER w)) AS BIGINT) AS eta, o - lag(o) OVER w AS gap, (row_number() OVER w - 1) // 200 AS batch FROM l WINDOW w AS (ORDER BY id)""")
def running_one_group(c: Catalogue) -> DataFrame:
    """All lines of orders as one group: remaining time, gaps and commit groups in pieces of 5,000 rows."""
    first = c.table("lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min(F.struct("l_extendedprice", "l_partkey", "l_suppkey")).alias("l"))
    steps = first.select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("id"), F.col("l_orderkey").alias("o"), F.round("l.l_extendedprice").cast("long").alias("seconds"))
    before = running.along(steps, [], ["id"], {"done": F.lit(1), "took": F.col("seconds")}, {"last": "o"}, 5000)
    return before.select("id", F.floor(F.col("took") / F.col("done") * (10000000 - F.col("done"))).alias("eta"), (F.col("o") - F.col("last")).alias("gap"), F.floor((F.col("done") - 1) / 200).cast("long").alias("batch"))


@query("""WITH v AS (SELECT l_returnflag AS g, l_extendedprice AS v FROM lineitem UNION ALL SELECT 'N', 1e12::DOUBLE UNION ALL SELECT 'N', 7.0::DOUBLE FROM lineitem),
r AS (SELECT g, v, row_number() OVER (PARTITION BY g ORDER BY v) - 1 AS k, count(*) OVER (PARTITION BY g) AS n FROM v)
SELECT g, max(n) AS n, max(v) FILTER (k = n // 2) AS p50, max(v) FILTER (k = least(n - 1, n * 95 // 100)) AS p95, max(v) AS longest FROM r GROUP BY g""")
def percentiles_with_outlier(c: Catalogue) -> DataFrame:
    """Percentiles of prices, one of them far off and one value on half of the rows."""
    prices = c.table("lineitem").select(F.col("l_returnflag").alias("g"), F.col("l_extendedprice").alias("v"))
    odd = c.table("region").limit(1).select(F.lit("N").alias("g"), F.lit(1e12).alias("v"))
    often = c.table("lineitem").select(F.lit("N").alias("g"), F.lit(7.0).alias("v"))
    return reports.latency(prices.unionByName(odd).unionByName(often), ["g"], "v")


@query("SELECT 'missing' AS kind, count(*) AS n, (SELECT string_agg(k, '|' ORDER BY k) FROM (SELECT CAST(doc_id AS VARCHAR) AS k FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) ORDER BY k LIMIT 10)) AS samples FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) UNION ALL SELECT 'orphan', count(*), '' FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)")
def vector_gaps(c: Catalogue) -> DataFrame:
    found = reports.vector_gaps(c.table("documents").select("doc_id"), c.table("labels").select("doc_id"), "doc_id")
    return found.select("kind", "n", F.array_join("samples", "|").alias("samples"))


@query(with_roles("faces", "people") + " SELECT media_id, face_id, row_number() OVER (PARTITION BY media_id ORDER BY person_id IS NULL, confidence DESC, face_id) AS rank FROM faces")
def media_faces_labelled_first(c: Catalogue) -> DataFrame:
    return browse.media_faces(c.faces(), c.people(), labeled_first=True).select("media_id", "face_id", F.col("rank").cast("long").alias("rank"))


@query(with_roles("media") + " SELECT media_id FROM media WHERE deleted = 0 AND media_id % 3 = 0 AND media_id % 7 <> 0 AND media_id % 5 <> 0")
def needs_place(c: Catalogue) -> DataFrame:
    k = F.col("media_id")
    return filters.needs_place(c.media().withColumns({"gps_lat": F.when(k % 3 == 0, 1.0), "gps_lon": F.when(k % 7 != 0, 2.0), "place": F.when(k % 5 == 0, "here").when(k % 2 == 0, "")})).select("media_id")


@query(with_roles("faces") + " SELECT face_id FROM faces WHERE confidence >= 20000 AND length(face_id) % 9 >= 3 AND length(face_id) % 7 >= 3")
def usable_faces(c: Catalogue) -> DataFrame:
    n = F.length("face_id")
    return filters.usable_faces(c.faces().withColumns({"w": n % 9, "h": n % 7}), 20000.0, 3).select("face_id")


@query("SELECT round(sum(l_tax) / sum(l_quantity), 6) AS per_image, round(sum(l_discount) / sum(l_linenumber), 6) AS per_video, round(sum(l_discount) / sum(l_quantity), 6) AS per_minute, round(sum(l_suppkey) / sum(l_linenumber), 6) AS shots_per_video FROM lineitem")
def run_averages(c: Catalogue) -> DataFrame:
    runs = c.table("lineitem").select(F.col("l_tax").alias("image_seconds"), F.col("l_quantity").alias("images"), F.col("l_discount").alias("video_seconds"), F.col("l_linenumber").alias("videos"), F.col("l_quantity").alias("video_minutes"), F.col("l_suppkey").alias("shots"))
    return reports.averages(runs).select(*(F.round(x, 6).alias(x) for x in ("per_image", "per_video", "per_minute", "shots_per_video")))


@query("SELECT vec_id AS id FROM embeddings WHERE label * 4 >= 15")
def results_shown(c: Catalogue) -> DataFrame:
    return filters.shown(c.table("embeddings").select(F.col("vec_id").alias("id"), (F.col("label") / 25).alias("score")), 15.0).select("id")


@query("SELECT event_id AS id FROM events WHERE event_type <> 'click' OR event_id % 50 BETWEEN 10 AND 30 AND (event_id % 4 = 0 OR event_id % 9 BETWEEN 2 AND 5)")
def video_limits(c: Catalogue) -> DataFrame:
    k = F.col("event_id")
    ok = filters.video_only(F.when(F.col("event_type") == "click", "video"), (k % 50).cast("double"), F.when(k % 4 != 0, 0.0), (k % 9).cast("double"), (10.0, 30.0), 2.0, 5.0)
    return c.table("events").where(ok).select(k.alias("id"))


@query(with_roles("media", "media_tags") + " SELECT media_id FROM media m WHERE EXISTS (SELECT 1 FROM media_tags t WHERE t.media_id = m.media_id AND lower(tag) IN (SELECT lower(p_type) FROM part WHERE p_partkey <= 3)) AND (ends_with(path, '.mp4'))")
def filters_any_case(c: Catalogue) -> DataFrame:
    some = [r[0].lower() for r in c.table("part").where("p_partkey <= 3").select("p_type").distinct().collect()]
    rows = browse.tag_lists(c.media(), c.media_tags())
    return rows.where(filters.any_of(F.col("tags"), some) & filters.kind_by_name(F.col("path"), "video")).select("media_id")


@query(with_roles("media") + " SELECT count(*) FILTER (mime LIKE 'image/%') AS images, count(*) FILTER (mime LIKE 'video/%') AS videos, round(count(*) FILTER (mime LIKE 'image/%') + greatest(count(*) FILTER (mime LIKE 'video/%') * 30.0, sum(duration) FILTER (mime LIKE 'video/%') / 60 * 5.0), 2) AS seconds FROM media")
def dryrun_estimate(c: Catalogue) -> DataFrame:
    return reports.time_estimate(c.media())


@query(with_roles("vectors") + """, pairs AS (SELECT a.id AS a, b.id AS b, round(list_cosine_similarity(a.vector, b.vector), 6) AS s FROM vectors a, vectors b WHERE a.id % 20 = 0 AND a.id <> b.id)
SELECT a AS query_id, b AS id, s AS score FROM pairs WHERE s >= 0.3""")
def similarity_pairs_over_threshold(c: Catalogue) -> DataFrame:
    v = c.vectors()
    return knn.within(v, v.where("id % 20 = 0"), 0.3).where("query_id != id")


@query(with_roles("vectors") + " SELECT * FROM (SELECT a.id AS a, b.id AS b, round(list_cosine_similarity(a.vector, b.vector), 6) AS score FROM vectors a JOIN vectors b ON a.id < b.id) WHERE score >= 0.3")
def similar_pairs(c: Catalogue) -> DataFrame:
    """All pairs of the collection over a similarity, by products of tiles."""
    return similarity_join.similar_pairs(c.vectors(), 0.3)


INDEXES: dict = {}


def _index(c: Catalogue) -> VectorIndex:
    """The index of a folder's vectors, built once a session."""
    key = (c.sf_dir, c.spark.sparkContext.applicationId)
    if key not in INDEXES:
        tags = F.array(F.concat(F.lit("t"), (F.col("id") % 3).cast("string")))
        INDEXES[key] = VectorIndex.build(c.vectors().select("id", "vector", tags.alias("tags")), lists=32)
    return INDEXES[key]


@query()
def knn_index_top10(c: Catalogue) -> DataFrame:
    """Neighbours through the index; no SQL, its lists are learned. ``knn_index_recall`` says how many are found."""
    return _index(c).search(c.vectors().where("id % 20 = 0"), 10, always=True)


@query("SELECT filter, true AS enough, true AS exact_scores, true AS lists_spared FROM (VALUES ('none'), ('t1'), ('t0 or t2')) v(filter) WHERE EXISTS (SELECT 1 FROM embeddings WHERE vec_id % 20 = 0)")
def knn_index_recall(c: Catalogue) -> DataFrame:
    """Whether the index finds 0.9 of the true neighbours or more, with and without tags, whether its scores are theirs, and whether a query reads some lists only."""
    index, v = _index(c), c.vectors().withColumn("tags", F.array(F.concat(F.lit("t"), (F.col("id") % 3).cast("string"))))
    asked, out = v.where("id % 20 = 0"), None
    for name, tags in (("none", []), ("t1", ["t1"]), ("t0 or t2", ["t0", "t2"])):
        rows = v.where(F.arrays_overlap("tags", F.array(*(F.lit(t) for t in tags)))) if tags else v
        found, exact = index.search(asked, 10, tags, always=True), knn.search(rows, asked, 10)
        both = exact.join(found.select("query_id", "id", F.col("score").alias("again")), ["query_id", "id"], "left")
        part = both.agg((F.count("again") / F.count("*") >= 0.9).alias("enough"), F.coalesce(F.max(F.abs(F.col("again") - F.col("score"))) < 2e-6, F.lit(False)).alias("exact_scores"))
        ids, matrix = next(knn.shipments(asked))
        reads = index.planned(matrix, 10, tags, always=True)
        out_row = part.select(F.lit(name).alias("filter"), "enough", "exact_scores", F.lit(bool((~reads).any(axis=1).all())).alias("lists_spared"))
        out = out_row if out is None else out.unionByName(out_row)
    return out


@query()
def learned_rerank(c: Catalogue) -> DataFrame:
    """A model's order of each query's neighbours; no SQL, the model is a Python function."""
    v = c.vectors()
    hits = knn.search(v, v.where("id % 20 = 0"), 10).withColumnRenamed("score", "total_score").withColumn("closeness", F.col("total_score"))
    return ranking.learned_rerank(hits, lambda rows: -rows["closeness"].to_numpy(), ["closeness"])


@query()
def vector_components(c: Catalogue) -> DataFrame:
    """Projections on two principal components; no SQL, an eigenproblem."""
    return knn.principal_components(c.vectors(), 2)


@query()
def text_search(c: Catalogue) -> DataFrame:
    """Documents nearest to a text by the default text model; no SQL, the model is a Python function."""
    from lumenframe.functions.models import embedded, text_vectors

    docs = embedded(c.table("documents").where("text is not null").select(F.col("doc_id").alias("id"), "text"))
    asked = c.spark.createDataFrame([(0, "licensed under the apache license")], "id long, q string").select("id", text_vectors(F.col("q")).alias("vector"))
    return knn.search(docs, asked, 10)
