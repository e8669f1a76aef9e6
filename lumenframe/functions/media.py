"""Kinds of media, and values as text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# File extensions by purpose.
IMAGE_FILES = ["jpg", "jpeg", "png", "heic", "tif", "tiff", "webp"]
VIDEO_FILES = ["mp4", "mov", "m4v", "avi", "mkv", "wmv", "flv", "webm"]
SEARCH_VIDEO_FILES = ["mp4", "mov", "m4v", "avi", "mkv"]


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./\\]+)$", 1))


def file_kind(path: Column) -> Column:
    """image, video or null, by what a scan takes in."""
    ext = extension(path)
    return F.when(ext.isin(IMAGE_FILES), "image").when(ext.isin(VIDEO_FILES), "video")


def is_action_camera(path: Column) -> Column:
    """An .mp4 whose name looks like an action camera's."""
    name = F.lower(F.element_at(F.split(path, "/"), -1))
    return F.endswith(name, F.lit(".mp4")) & (name.rlike("^(gx|gh|gopr)") | F.contains(name, F.lit("gopro")))


def short_id(value: Column) -> Column:
    text = value.cast("string")
    return F.when(F.length(text) <= 6, text).otherwise(F.concat(F.left(text, F.lit(2)), F.lit(".."), F.right(text, F.lit(2))))


def size_text(size: Column) -> Column:
    """Bytes as B, or with one decimal, rounded half up, as KB, MB or GB."""
    size = size.cast("long")
    out = F.concat(size.cast("string"), F.lit(" B"))
    for power, unit in ((1024, "KB"), (1024**2, "MB"), (1024**3, "GB")):
        tenths = F.floor((size * 10 + power // 2) / F.lit(power)).cast("long")
        text = F.concat(F.floor(tenths / 10).cast("string"), F.lit("."), (tenths % 10).cast("string"), F.lit(f" {unit}"))
        out = F.when(size >= power, text).otherwise(out)
    return out


def duration_text(seconds: Column) -> Column:
    return F.when(seconds < 60, F.format_string("%.1fs", seconds.cast("double"))).when(seconds < 3600, F.format_string("%.1fm", seconds / 60)).otherwise(F.format_string("%.1fh", seconds / 3600))


def duration_seconds(token: Column) -> Column:
    """Seconds of 350ms, 2.5s, 3m or 1h, with or without /min; null otherwise."""
    token = F.regexp_replace(F.lower(F.trim(token)), "/min$", "")
    value = F.regexp_extract(token, r"^([0-9]+(?:\.[0-9]+)?)(ms|s|m|h)$", 1).try_cast("double")
    unit = F.regexp_extract(token, r"(ms|s|m|h)$", 1)
    return F.when(unit == "ms", value / 1000).when(unit == "s", value).when(unit == "m", value * 60).otherwise(value * 3600)


def size_band(kind: Column, size: Column) -> Column:
    """Histogram band of a file's size: images cut at 1, 10, 100 MB, videos at 10, 100, 1024 MB."""
    mb = 1024 * 1024
    image = F.when(size < mb, "small").when(size < 10 * mb, "medium").when(size < 100 * mb, "large").otherwise("xlarge")
    video = F.when(size < 10 * mb, "small").when(size < 100 * mb, "medium").when(size < 1024 * mb, "large").otherwise("xlarge")
    return F.when(kind == "image", image).when(kind == "video", video)


def duration_band(seconds: Column) -> Column:
    """Histogram band of a video's duration, cut at 1, 5 and 30 minutes; null for no or zero duration."""
    return F.when(seconds < 60, "small").when(seconds < 300, "medium").when(seconds < 1800, "large").when(seconds.isNotNull(), "xlarge")


def exif_time(text: Column) -> Column:
    """2023:06:15 10:00:00 as 2023-06-15T10:00:00; null if it isn't such a time."""
    return F.date_format(F.try_to_timestamp(text, F.lit("yyyy:MM:dd HH:mm:ss")), "yyyy-MM-dd'T'HH:mm:ss")


def gps_time(text: Column) -> Column:
    """A GPS date and time, with or without fractions, as ...T...sssZ."""
    parsed = F.coalesce(F.try_to_timestamp(text, F.lit("yyyy:MM:dd HH:mm:ss.SSS")), F.try_to_timestamp(text, F.lit("yyyy:MM:dd HH:mm:ss")))
    return F.date_format(parsed, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def decimal_degrees(degrees: Column, minutes: Column, seconds: Column, hemisphere: Column) -> Column:
    size = degrees + minutes / 60 + seconds / 3600
    return F.when(F.upper(hemisphere).isin("S", "W"), -size).otherwise(size)


def iso6709(text: Column) -> Column:
    """struct(lat, lon) of ±lat±lon, null if it isn't one."""
    pattern = r"^([+-][0-9]+(?:\.[0-9]+)?)([+-][0-9]+(?:\.[0-9]+)?)"
    lat, lon = (F.regexp_extract(text, pattern, k).try_cast("double") for k in (1, 2))
    return F.when(lat.isNotNull(), F.struct(lat.alias("lat"), lon.alias("lon")))


# Detector labels and the names they are stored under.
LABELS = {"tvmonitor": "tv", "pottedplant": "potted plant"}


def labels_of(detected: Column) -> Column:
    """Sorted distinct labels, by the names they are stored under."""
    known = F.create_map(*(F.lit(x) for pair in LABELS.items() for x in pair))
    return F.array_sort(F.array_distinct(F.transform(detected, lambda x: F.coalesce(F.try_element_at(known, x), x))))


def crop_box(x: Column, y: Column, w: Column, h: Column, width: Column, height: Column, pad: float = 0.2) -> Column:
    """Pixel box of a face with a margin, kept inside the picture; x, y, w, h in parts of it."""
    left, top = (x - w * pad) * width, (y - h * pad) * height
    right, bottom = (x + w + w * pad) * width, (y + h + h * pad) * height
    inside = lambda v, most: F.greatest(F.lit(0), F.least(most.cast("int"), v.cast("int")))
    return F.struct(inside(left, width).alias("left"), inside(top, height).alias("top"), inside(right, width).alias("right"), inside(bottom, height).alias("bottom"))


def thumbnail_size(width: Column, height: Column, most: int = 512) -> Column:
    scale = F.least(F.lit(1.0), F.lit(most) / F.greatest(width, height))
    return F.struct(F.greatest(F.lit(1), F.round(width * scale).cast("int")).alias("width"), F.greatest(F.lit(1), F.round(height * scale).cast("int")).alias("height"))
