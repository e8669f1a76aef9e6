"""Scans of media files, logs and telemetry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenframe.functions.ids import content_id, relative_path
from lumenframe.functions.media import IMAGE_FILES, VIDEO_FILES, duration_seconds, file_kind

ANSI_CODES = "\x1b\\[[0-9;?]*[ -/]*[@-~]"


def scan_media(spark: SparkSession, root: str, kind: str | None = None, with_content: bool = False) -> DataFrame:
    """Media files below ``root``, without dot files and folders: path, rel_path, size_bytes, mtime, kind (, media_id).

    ``kind``: image or video only. With ``with_content`` the bytes are read and hashed in the tasks.
    """
    suffixes = {"image": IMAGE_FILES, "video": VIDEO_FILES}.get(kind, IMAGE_FILES + VIDEO_FILES)
    any_case = ["".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in s) for s in suffixes]
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{" + ",".join(any_case) + "}").load(root)
    place = F.regexp_replace("path", "^file:/+", "/")
    below = relative_path(F.lit(root.removeprefix("file://")), place)
    columns: list[Column] = [place.alias("path"), below.alias("rel_path"), F.col("length").alias("size_bytes"), F.col("modificationTime").alias("mtime"), file_kind(place).alias("kind")]
    if with_content:
        columns.append(content_id(F.col("content")).alias("media_id"))
    return files.select(*columns).where(~F.concat(F.lit("/"), F.col("rel_path")).rlike(r"/\."))


def log_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line_no, line) of a log file, colour codes taken out; line numbers rise with the file's order."""
    lines = spark.read.text(path).select(F.monotonically_increasing_id().alias("line_no"), F.regexp_replace("value", ANSI_CODES, "").alias("line"))
    return lines


def log_tail(lines: DataFrame, n: int) -> DataFrame:
    return lines.orderBy(F.desc("line_no")).limit(n).orderBy("line_no")


def last_summary(lines: DataFrame, marker: str = "INDEXER_SUMMARY") -> DataFrame:
    """The last valid JSON object that follows ``marker`` in a line, as text."""
    text = F.regexp_extract("line", marker + r"\s+(\{.*\})", 1)
    valid = lines.select("line_no", text.alias("summary")).where((F.col("summary") != "") & F.try_parse_json("summary").isNotNull())
    return valid.agg(F.max_by("summary", "line_no").alias("summary"))


def performance(lines: DataFrame) -> DataFrame:
    """The last 'Performance | key=value ...' line's durations: name, seconds."""
    last = lines.where(F.contains("line", F.lit("Performance |"))).agg(F.max_by("line", "line_no").alias("line"))
    pairs = last.select(F.explode(F.regexp_extract_all("line", F.lit(r"(\w+=[0-9.]+(?:ms|s|m|h)(?:/min)?)"), F.lit(1))).alias("pair"))
    return pairs.select(F.split("pair", "=")[0].alias("name"), duration_seconds(F.split("pair", "=")[1]).alias("seconds")).where("seconds is not null")


def telemetry_samples(telemetry: DataFrame) -> DataFrame:
    """Rows of a track from grouped keys: ``telemetry`` has video_id and fields map<string,string>.

    Keys are Doc<n>[-<m>]:<field>; a sample per group with latitude and longitude, in order of
    time. Groups without a time are a tenth of a second apart.
    """
    entries = telemetry.select("video_id", F.explode("fields").alias("key", "value"))
    group = F.regexp_extract("key", r"^(Doc\d+(?:-\d+)?):", 1)
    rows = entries.select("video_id", group.alias("group"), F.regexp_extract("key", r":(\w+)$", 1).alias("field"), "value").where("group != ''")
    wide = rows.groupBy("video_id", "group").pivot("field", ["SampleTime", "GPSLatitude", "GPSLongitude", "GPSAltitude", "GPSDateTime", "GPSMeasureMode"]).agg(F.first("value"))
    number = lambda c: F.col(c).try_cast("double")
    order = F.struct(*(F.regexp_extract("group", r"^Doc(\d+)(?:-(\d+))?$", k).try_cast("int").alias(f"k{k}") for k in (1, 2)))
    ranked = wide.where(number("GPSLatitude").isNotNull() & number("GPSLongitude").isNotNull()).groupBy("video_id").agg(
        F.array_sort(F.collect_list(F.struct(order.alias("k"), number("SampleTime").alias("t"), number("GPSLatitude").alias("gps_lat"), number("GPSLongitude").alias("gps_lon"), number("GPSAltitude").alias("gps_alt"), F.col("GPSDateTime").alias("gps_datetime"), F.col("GPSMeasureMode").try_cast("int").alias("gps_fix")))).alias("s")
    )
    rows = ranked.select("video_id", F.posexplode("s").alias("n", "s"))
    return rows.select("video_id", F.coalesce("s.t", F.col("n") * 0.1).alias("t_offset_sec"), "s.gps_lat", "s.gps_lon", "s.gps_alt", "s.gps_datetime", "s.gps_fix")
