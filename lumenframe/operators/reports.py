"""Counts, histograms and audits of a catalogue."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenframe.functions.media import duration_band, size_band
from lumenframe.operators import running
from lumenframe.operators.filters import live


def index_stats(media: DataFrame, faces: DataFrame, people: DataFrame) -> DataFrame:
    """One row: images, videos, seconds of video, faces (of deleted media too), labelled people, latest time."""
    m = live(media).agg(F.count_if(F.col("mime").ilike("image/%")).alias("images"), F.count_if(F.col("mime").ilike("video/%")).alias("videos"), F.coalesce(F.round(F.sum(F.when(F.col("mime").ilike("video/%"), F.col("duration"))), 2), F.lit(0.0)).alias("video_seconds"), F.max("ts_utc").alias("latest"))
    f = faces.agg(F.count("*").alias("faces"), F.count_distinct("person_id").alias("labelled"))
    p = people.agg(F.count("*").alias("people"))
    return m.select(F.lit(1).alias("k"), "*").join(f.select(F.lit(1).alias("k"), "*"), "k").join(p.select(F.lit(1).alias("k"), "*"), "k").drop("k")


def size_histogram(media: DataFrame) -> DataFrame:
    """kind, band, n, bytes over images and videos."""
    kind = F.when(F.col("mime").ilike("image/%"), "image").when(F.col("mime").ilike("video/%"), "video")
    rows = media.select(kind.alias("kind"), size_band(kind, F.col("size_bytes")).alias("band"), "size_bytes").where("kind is not null")
    return rows.groupBy("kind", "band").agg(F.count("*").alias("n"), F.sum("size_bytes").alias("bytes"))


def duration_histogram(media: DataFrame) -> DataFrame:
    videos = media.where(F.col("mime").ilike("video/%") & (F.coalesce("duration", F.lit(0.0)) > 0))
    return videos.groupBy(duration_band(F.col("duration")).alias("band")).agg(F.count("*").alias("n"))


def time_estimate(media: DataFrame, per_image: float = 1.0, per_video: float = 30.0, per_minute: float = 5.0) -> DataFrame:
    """Seconds an ingest would take: images by number, videos by number or by minutes, whichever is more."""
    images, videos = F.count_if(F.col("mime").ilike("image/%")), F.count_if(F.col("mime").ilike("video/%"))
    minutes = F.coalesce(F.sum(F.when(F.col("mime").ilike("video/%"), F.col("duration"))), F.lit(0.0)) / 60
    return media.agg(images.alias("images"), videos.alias("videos"), F.round(images * per_image + F.greatest(videos * per_video, minutes * per_minute), 2).alias("seconds"))


def latency(values: DataFrame, groups: list[str], value: str) -> DataFrame:
    """n, p50 (element n div 2), p95 (element floor(0.95 n), at most the last) and max, from 0 in ascending order; exact.

    Places are found among running counts of different values, in pieces (``running.at_places``), so
    neither a large group nor an outlier nor a frequent value is one task's.
    """
    places = {"p50": F.floor(F.col("n") / 2), "p95": F.least(F.col("n") - 1, F.floor(F.col("n") * 95 / 100))}
    found = running.at_places(values, groups, value, places)
    return found.select(*groups, "n", "p50", "p95", F.col("high").alias("longest"))


def gaps(events: DataFrame, groups: list[str], t: str, tie: list[str] = ()) -> DataFrame:
    """Events with their distance from the one before in ``t``; ``tie``: what tells events of one time apart."""
    return running.previous(events, groups, [t, *tie], t, "__before").withColumn("gap", F.col(t) - F.col("__before")).drop("__before")


def running_eta(steps: DataFrame, groups: list[str], order: str, seconds: str, total: str) -> DataFrame:
    """After each step: mean seconds so far times the steps still to come."""
    summed = running.running(steps, groups, [order], {"__done": F.lit(1), "__took": F.col(seconds)})
    return summed.withColumn("eta", F.col("__took") / F.col("__done") * (F.col(total) - F.col("__done"))).drop("__done", "__took")


def missing_vectors(rows: DataFrame, embeddings: DataFrame, key: str) -> DataFrame:
    return rows.join(embeddings.select(key), key, "left_anti")


def vector_gaps(rows: DataFrame, embeddings: DataFrame, key: str, samples: int = 10) -> DataFrame:
    """missing (rows without a vector) and orphan (vectors without a row): kind, n, and the first ``samples`` keys."""
    out = None
    for kind, gap in (("missing", missing_vectors(rows, embeddings, key)), ("orphan", missing_vectors(embeddings, rows, key))):
        first = gap.select(F.col(key).cast("string").alias("k")).orderBy("k").limit(samples).agg(F.array_sort(F.collect_list("k")).alias("samples"))
        row = gap.agg(F.lit(kind).alias("kind"), F.count("*").alias("n")).join(first)
        out = row if out is None else out.unionByName(row)
    return out


def copies(files: DataFrame) -> DataFrame:
    """Content that lies in more than one place: media_id, n, first place."""
    by = files.groupBy("media_id").agg(F.count("*").alias("n"), F.min(F.struct("source_name", "rel_path")).alias("first"))
    return by.where("n > 1").select("media_id", "n", F.col("first.source_name").alias("source_name"), F.col("first.rel_path").alias("rel_path"))


def averages(runs: DataFrame) -> DataFrame:
    """Mean seconds of a run's images, videos and video minutes; null where there were none."""
    ratio = lambda a, b: F.try_divide(F.sum(a), F.sum(b))
    return runs.agg(ratio("image_seconds", "images").alias("per_image"), ratio("video_seconds", "videos").alias("per_video"), ratio("video_seconds", "video_minutes").alias("per_minute"), ratio("shots", "videos").alias("shots_per_video"))
