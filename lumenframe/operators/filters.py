"""Predicates of search and browse."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenframe.functions.media import IMAGE_FILES, SEARCH_VIDEO_FILES, extension


def any_of(values: Column, wanted: list[str]) -> Column:
    """Whether ``values`` holds one of ``wanted``, in any case; no wish is met by all."""
    if not wanted:
        return F.lit(True)
    terms = F.array(*(F.lit(w.lower()) for w in wanted))
    return F.coalesce(F.arrays_overlap(F.transform(values, F.lower), terms), F.lit(False))


def kind_by_name(path: Column, kind: str | None) -> Column:
    if kind is None:
        return F.lit(True)
    return F.coalesce(extension(path).isin(SEARCH_VIDEO_FILES if kind == "video" else IMAGE_FILES), F.lit(False))


def kind_by_mime(mime: Column, kind: str | None) -> Column:
    return F.lit(True) if kind is None else mime.ilike(f"{kind}/%")


def within_dates(when: Column, first: str | None, last: str | None) -> Column:
    """Bounds compared as texts; a missing date is the empty text, which only a last bound lets in."""
    when, ok = F.coalesce(when, F.lit("")), F.lit(True)
    if first:
        ok = ok & (when >= first)
    return ok & (when <= last) if last else ok


def in_place(columns: list[Column], terms: list[str]) -> Column:
    """Whether one of the texts contains one of ``terms``, in any case."""
    if not terms:
        return F.lit(True)
    texts = F.transform(F.array(*columns), lambda t: F.lower(F.coalesce(t, F.lit(""))))
    return F.exists(texts, lambda t: F.exists(F.array(*(F.lit(x.lower()) for x in terms)), lambda x: F.contains(t, x)))


def video_only(kind: Column, timestamp: Column, start: Column, end: Column, span: tuple[float, float] | None = None, shortest: float | None = None, longest: float | None = None) -> Column:
    """Time span and shot length, asked of videos only, and of those that know theirs; a limit of 0 is none."""
    ok, length = F.lit(True), end - start
    if span:
        ok = ok & F.coalesce(timestamp.between(*span), F.lit(True))
    if shortest:
        ok = ok & F.coalesce(length >= shortest, F.lit(True))
    if longest:
        ok = ok & F.coalesce(length <= longest, F.lit(True))
    return (F.coalesce(kind, F.lit("")) != "video") | ok


def without_deleted(candidates: DataFrame, media: DataFrame, key: str = "id") -> DataFrame:
    """Drops what is known to be deleted; unknown ids stay."""
    gone = media.where("deleted = 1").select(F.col("media_id").alias("__gone"))
    return candidates.join(gone, F.col(key) == F.col("__gone"), "left_anti")


def live(media: DataFrame) -> DataFrame:
    return media.where(F.coalesce("deleted", F.lit(0)) == 0)


def needs_place(media: DataFrame) -> DataFrame:
    """Live media with a position and no place yet."""
    return live(media).where("gps_lat is not null and gps_lon is not null and coalesce(place, '') = ''")


def similarity_band(score: Column, known: Column, threshold: float = 0.65) -> Column:
    """known, unknown or maybe, by a threshold kept between 0.20 and 0.99; null below 0.20."""
    t = min(0.99, max(0.20, threshold))
    return F.when(known & (score >= t), "known").when(~known & (score >= t), "unknown").when(~known & (score >= 0.2), "maybe")


def usable_faces(faces: DataFrame, least_confidence: float, least_size: float) -> DataFrame:
    return faces.where((F.col("confidence") >= least_confidence) & (F.col("w") >= least_size) & (F.col("h") >= least_size))


def shown(results: DataFrame, least_percent: float = 15.0) -> DataFrame:
    return results.where(F.col("score") * 100 >= least_percent)
