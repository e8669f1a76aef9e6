"""Facts about media files from the tags that extraction tools give as maps of texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenframe.functions.media import decimal_degrees, exif_time, iso6709


def _of(tags: Column, *names: str) -> Column:
    """The first of some tags that isn't blank."""
    return F.coalesce(*(F.nullif(F.trim(F.try_element_at(tags, F.lit(n))), F.lit("")) for n in names))


def _degrees(tags: Column, axis: str) -> Column:
    """Decimal degrees of a GPS tag as 'd m s' or as a number, and its hemisphere tag."""
    text, side = _of(tags, f"GPS{axis}"), _of(tags, f"GPS{axis}Ref")
    part = lambda k: F.regexp_extract(text, r"^\s*([0-9.]+)[\s,]+([0-9.]+)[\s,]+([0-9.]+)\s*$", k).try_cast("double")
    return F.coalesce(decimal_degrees(part(1), part(2), part(3), side), F.when(side.isin("S", "W"), -F.abs(text.try_cast("double"))).otherwise(text.try_cast("double")))


def image_facts(files: DataFrame) -> DataFrame:
    """(media_id, tags map) to ts_utc, camera, lens, width, height, gps_lat, gps_lon; what is missing or odd is null."""
    t = F.col("tags")
    lat, lon = _degrees(t, "Latitude"), _degrees(t, "Longitude")
    both = lat.isNotNull() & lon.isNotNull() & (F.abs(lat) <= 90) & (F.abs(lon) <= 180)
    return files.select("media_id", F.coalesce(exif_time(_of(t, "DateTimeOriginal")), exif_time(_of(t, "DateTime"))).alias("ts_utc"), _of(t, "Model").alias("camera"), _of(t, "LensModel").alias("lens"), _of(t, "ImageWidth", "ExifImageWidth").try_cast("int").alias("width"), _of(t, "ImageHeight", "ExifImageHeight").try_cast("int").alias("height"), F.when(both, lat).alias("gps_lat"), F.when(both, lon).alias("gps_lon"))


def video_facts(files: DataFrame, tools: list[str]) -> DataFrame:
    """Duration, width, height and position from several tools' tag maps (columns ``tools``), the first that knows."""
    first = lambda name, kind: F.coalesce(*(_of(F.col(t), name).try_cast(kind) for t in tools))
    place = F.coalesce(*(iso6709(_of(F.col(t), "location")) for t in tools))
    return files.select("media_id", first("duration", "double").alias("duration"), first("width", "int").alias("width"), first("height", "int").alias("height"), place["lat"].alias("gps_lat"), place["lon"].alias("gps_lon"))


def folder_listing(entries: DataFrame, most: int = 50) -> DataFrame:
    """Folders first, then up to ``most`` files, by name: entries (name, is_folder)."""
    folders = entries.where("is_folder")
    return folders.unionByName(entries.where("not is_folder").orderBy(F.lower("name"), "name").limit(most)).orderBy(F.desc("is_folder"), F.lower("name"), "name")
