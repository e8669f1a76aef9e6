"""Identity functions of media, faces and index points."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MODULUS = "9223372036854775808BD"  # 2 to the 63rd


def _masked(hex_text: Column) -> Column:
    """Up to 16 hex digits as an unsigned number, its low 63 bits."""
    wide = F.conv(hex_text, 16, 10).cast("decimal(20,0)")
    return (wide % F.expr(MODULUS)).cast("long")


def content_id(content: Column) -> Column:
    """A medium's id: SHA-256 of its bytes, lower-case hex."""
    return F.sha2(content, 256)


def image_point_id(media_id: Column) -> Column:
    """The first 8 bytes of the id, big-endian, low 63 bits."""
    return _masked(F.hex(F.substring(media_id.cast("string").cast("binary"), 1, 8)))


def keyframe_point_id(media_id: Column, shot: Column, frame: Column) -> Column:
    """The first 6 bytes of the id, then a byte each of shot and frame number; low 63 bits."""
    head = F.conv(F.hex(F.substring(media_id.cast("string").cast("binary"), 1, 6)), 16, 10).cast("long")
    tail = F.shiftleft(shot.cast("long").bitwiseAND(F.lit(255)), 8).bitwiseOR(frame.cast("long").bitwiseAND(F.lit(255)))
    return F.shiftleft(head, 16).bitwiseOR(tail).bitwiseAND(F.lit(9223372036854775807))


def face_point_id(face_id: Column) -> Column:
    """The first 16 hex digits of the id's SHA-256, low 63 bits."""
    return _masked(F.substring(F.sha2(face_id.cast("string"), 256), 1, 16))


def image_face_id(media_id: Column, k: Column) -> Column:
    return F.concat(media_id, F.lit(":f"), k.cast("string"))


def video_face_id(media_id: Column, shot: Column, frame: Column, k: Column) -> Column:
    return F.concat(F.lit("vf:"), media_id, F.lit(":"), shot.cast("string"), F.lit(":"), frame.cast("string"), F.lit(":f"), k.cast("string"))


def relative_path(root: Column, path: Column) -> Column:
    """``path`` below ``root``, with forward slashes; its last part if it isn't below."""
    path, root = F.replace(path, F.lit("\\"), F.lit("/")), F.rtrim(F.replace(root, F.lit("\\"), F.lit("/")), F.lit("/"))
    return F.when(F.startswith(path, F.concat(root, F.lit("/"))), F.substring(path, F.length(root) + 2, F.length(path))).otherwise(F.element_at(F.split(path, "/"), -1))


def display_path(path: Column) -> Column:
    """A Windows path seen from Linux (/mnt/d/x) as D:\\x; other paths as they are."""
    drive = F.upper(F.regexp_extract(path, r"^/mnt/([A-Za-z])(?:/|$)", 1))
    rest = F.translate(F.regexp_extract(path, r"^/mnt/[A-Za-z]/(.*)$", 1), "/", "\\")
    return F.when(drive != "", F.concat(drive, F.lit(":\\"), rest)).otherwise(path)


def mounted_path(path: Column) -> Column:
    """The inverse of ``display_path``."""
    drive = F.lower(F.regexp_extract(path, r"^([A-Za-z]):\\", 1))
    rest = F.translate(F.regexp_extract(path, r"^[A-Za-z]:\\(.*)$", 1), "\\", "/")
    return F.when(drive != "", F.concat(F.lit("/mnt/"), drive, F.lit("/"), rest)).otherwise(path)
