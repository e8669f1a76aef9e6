"""Facts from the bytes of pictures and videos: TIFF directories, nested boxes, and timed telemetry.

Only heads are read: a picture's segments up to its image data, a video's movie box and the samples of
its telemetry track, at their offsets. Whatever is cut off, loops or points outside gives no value; it
never fails a task. A file that can't be opened has an empty map.
"""

from __future__ import annotations

import io
import struct
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenframe.sources.media_source import opened

# Tags of TIFF and Exif directories, and the sizes of their types.
PICTURE_TAGS = {0x0100: "ImageWidth", 0x0101: "ImageHeight", 0x0110: "Model", 0x0132: "DateTime"}
EXIF_TAGS = {0x9003: "DateTimeOriginal", 0xA002: "ExifImageWidth", 0xA003: "ExifImageHeight", 0xA434: "LensModel"}
GPS_TAGS = {1: "GPSLatitudeRef", 2: "GPSLatitude", 3: "GPSLongitudeRef", 4: "GPSLongitude"}
BELOW = {0x8769: EXIF_TAGS, 0x8825: GPS_TAGS}
TYPES = {1: "B", 2: "s", 3: "H", 4: "I", 5: "II", 7: "s", 9: "i", 10: "ii"}
CONTAINERS = {b"moov", b"trak", b"mdia", b"minf", b"stbl", b"udta"}
MOST_MOVIE_BYTES = 64 << 20


def directory_tags(data: bytes) -> dict[str, str]:
    """Tags of a TIFF block, its Exif and its GPS directory, as texts; several numbers are set apart by blanks."""
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    out: dict[str, str] = {}
    if order is None or len(data) < 8 or struct.unpack(order + "H", data[2:4])[0] != 42:
        return out
    todo, seen = [(struct.unpack(order + "I", data[4:8])[0], PICTURE_TAGS)], set()
    while todo:
        at, names = todo.pop()
        if at in seen or at + 2 > len(data):
            continue
        seen.add(at)
        (n,) = struct.unpack_from(order + "H", data, at)
        for k in range(n):
            entry = at + 2 + 12 * k
            if entry + 12 > len(data):
                break
            tag, kind, count = struct.unpack_from(order + "HHI", data, entry)
            if tag in BELOW and names is PICTURE_TAGS:
                todo.append((struct.unpack_from(order + "I", data, entry + 8)[0], BELOW[tag]))
            elif tag in names and kind in TYPES and names[tag] not in out:
                size = struct.calcsize("=" + TYPES[kind]) * count
                start = entry + 8 if size <= 4 else struct.unpack_from(order + "I", data, entry + 8)[0]
                if 0 < size and start + size <= len(data):
                    text = _value(order, kind, count, data[start : start + size])
                    if text is not None:
                        out[names[tag]] = text
    return out


def _value(order: str, kind: int, count: int, raw: bytes) -> str | None:
    if TYPES[kind] == "s":
        return raw.split(b"\0")[0].decode("utf-8", "replace").strip()
    numbers = struct.unpack(order + TYPES[kind] * count, raw)
    if kind in (5, 10):
        pairs = list(zip(numbers[::2], numbers[1::2], strict=True))
        if any(d == 0 for _, d in pairs):
            return None
        return " ".join(f"{n / d:.10g}" for n, d in pairs)
    return " ".join(map(str, numbers))


def picture_tags(source) -> dict[str, str]:
    """Tags of an open JPEG, PNG or TIFF file; the frame's own size goes before that of the tags."""
    head = source.read(8)
    if head[:2] == b"\xff\xd8":
        return _jpeg(source)
    if head == b"\x89PNG\r\n\x1a\n":
        return _png(source)
    if head[:4] in (b"II*\0", b"MM\0*"):
        source.seek(0)
        return directory_tags(source.read(1 << 20))
    return {}


def _jpeg(source) -> dict[str, str]:
    out, size, at = {}, {}, 2
    while True:
        source.seek(at)
        mark = source.read(4)
        if len(mark) < 2 or mark[0] != 0xFF:
            break
        code = mark[1]
        if code == 0xFF:  # fill
            at += 1
            continue
        if code == 0x01 or 0xD0 <= code <= 0xD8:
            at += 2
            continue
        if code in (0xD9, 0xDA) or len(mark) < 4:
            break
        length = struct.unpack(">H", mark[2:])[0]
        if length < 2:
            break
        if code == 0xE1:
            body = source.read(length - 2)
            if body[:6] == b"Exif\0\0":
                out = directory_tags(body[6:]) | out
        elif 0xC0 <= code <= 0xCF and code not in (0xC4, 0xC8, 0xCC):
            body = source.read(5)
            if len(body) == 5:
                height, width = struct.unpack(">HH", body[1:])
                size = {"ImageWidth": str(width), "ImageHeight": str(height)}
        at += 2 + length
    return out | size


def _png(source) -> dict[str, str]:
    out, at = {}, 8
    while True:
        source.seek(at)
        head = source.read(8)
        if len(head) < 8 or head[4:] in (b"IDAT", b"IEND"):
            return out
        length = struct.unpack(">I", head[:4])[0]
        if head[4:] == b"IHDR":
            body = source.read(8)
            if len(body) == 8:
                out |= {k: str(v) for k, v in zip(("ImageWidth", "ImageHeight"), struct.unpack(">II", body), strict=True)}
        elif head[4:] == b"eXIf":
            out = directory_tags(source.read(min(length, 1 << 20))) | out
        at += 12 + length


def boxes(data: bytes, start: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    """(type, start, end) of the boxes in a stretch of bytes; one that reaches beyond it ends the walk."""
    while start + 8 <= end:
        size, kind = struct.unpack_from(">I4s", data, start)
        body = start + 8
        if size == 1:
            if start + 16 > end:
                return
            size, body = struct.unpack_from(">Q", data, start + 8)[0], start + 16
        stop = end if size == 0 else start + size
        if stop > end or stop < body:
            return
        yield kind, body, stop
        start = stop


def movie(source) -> bytes:
    """The bytes of a file's movie box; the boxes before it are skipped by their sizes."""
    at = 0
    while True:
        source.seek(at)
        head = source.read(16)
        if len(head) < 8:
            return b""
        size, kind = struct.unpack(">I4s", head[:8])
        skip = 8
        if size == 1:
            if len(head) < 16:
                return b""
            size, skip = struct.unpack(">Q", head[8:])[0], 16
        if kind == b"moov":
            source.seek(at + skip)
            return source.read(MOST_MOVIE_BYTES if size == 0 else min(max(0, size - skip), MOST_MOVIE_BYTES))
        if size < skip:
            return b""
        at += size


def _below(data: bytes, start: int, end: int, path: tuple = ()) -> Iterator[tuple[tuple, int, int]]:
    for kind, a, z in boxes(data, start, end):
        yield (*path, kind), a, z
        if kind in CONTAINERS and len(path) < 8:
            yield from _below(data, a, z, (*path, kind))


def _timescale(data: bytes, at: int, end: int) -> tuple[int, int] | None:
    """Units a second and length of a movie's or medium's header."""
    form = (">II", 12) if data[at] == 0 else (">IQ", 20)
    return struct.unpack_from(form[0], data, at + form[1]) if at + form[1] + struct.calcsize(form[0]) <= end else None


def video_tags(source) -> dict[str, str]:
    """duration, width, height and location of an open MP4 or MOV file."""
    data, out = movie(source), {}
    for path, a, z in _below(data, 0, len(data)):
        if path[-1] == b"mvhd" and z > a:
            told = _timescale(data, a, z)
            if told and told[0]:
                out["duration"] = f"{told[1] / told[0]:.10g}"
        elif path[-1] == b"tkhd" and "width" not in out and z - a >= 8:
            width, height = (x >> 16 for x in struct.unpack_from(">II", data, z - 8))
            if width and height:
                out |= {"width": str(width), "height": str(height)}
        elif path[-1] == b"\xa9xyz" and z - a > 4:
            n = struct.unpack_from(">H", data, a)[0]
            out.setdefault("location", data[a + 4 : min(z, a + 4 + n)].decode("ascii", "replace").strip("/ \0"))
    return out


def _table(data: bytes, a: int, z: int, form: str, skip: int = 4) -> list[tuple]:
    """The rows of a sample table: a count, then rows."""
    if a + skip + 4 > z:
        return []
    (n,) = struct.unpack_from(">I", data, a + skip)
    size = struct.calcsize(form)
    n = min(n, (z - a - skip - 4) // size)
    return [struct.unpack_from(form, data, a + skip + 4 + size * k) for k in range(n)]


def telemetry_pieces(data: bytes) -> list[tuple[int, int, float, float]]:
    """(offset, size, start, seconds) of the samples of a movie's telemetry track."""
    for kind, a, z in boxes(data, 0, len(data)):
        if kind != b"trak":
            continue
        found = {p[-1]: (x, y) for p, x, y in _below(data, a, z)}
        if not {b"stsd", b"stsz", b"stsc", b"stts", b"mdhd"} <= found.keys() or data[found[b"stsd"][0] + 12 : found[b"stsd"][0] + 16] != b"gpmd":
            continue
        scale = (_timescale(data, *found[b"mdhd"]) or (0, 0))[0] or 1
        x, y = found[b"stsz"]
        same = struct.unpack_from(">I", data, x + 4)[0] if x + 8 <= y else 0
        sizes = [s for (s,) in _table(data, x, y, ">I", 8)] if not same else [same] * struct.unpack_from(">I", data, x + 8)[0]
        offsets = [o for (o,) in (_table(data, *found[b"co64"], ">Q") if b"co64" in found else _table(data, *found[b"stco"], ">I") if b"stco" in found else [])]
        runs, times = _table(data, *found[b"stsc"], ">III"), [d for n, d in _table(data, *found[b"stts"], ">II") for _ in range(min(n, len(sizes)))]
        out, k, now = [], 0, 0
        for c, offset in enumerate(offsets, 1):
            per = next((n for first, n, _ in reversed(runs) if first <= c), 0)
            for _ in range(per):
                if k >= min(len(sizes), len(times)):
                    return out
                out.append((offset, sizes[k], now / scale, times[k] / scale))
                offset, now, k = offset + sizes[k], now + times[k], k + 1
        return out
    return []


def keyed_values(data: bytes, depth: int = 0) -> Iterator[tuple[bytes, str, int, int, bytes]]:
    """(key, type, size, repeat, bytes) of key-length-value telemetry, those of nested keys in place."""
    at = 0
    while at + 8 <= len(data):
        key, kind, size, repeat = struct.unpack_from(">4sBBH", data, at)
        length = size * repeat
        body = data[at + 8 : at + 8 + length]
        if len(body) < length:
            return
        if kind == 0:
            yield key, "", 0, 0, b""
            if depth < 8:
                yield from keyed_values(body, depth + 1)
        else:
            yield key, chr(kind), size, repeat, body
        at += 8 + (length + 3) // 4 * 4


def positions(data: bytes, start: float, seconds: float) -> list[dict]:
    """The positions in one telemetry sample, evenly spread over its time; scales and fix hold until told anew."""
    scales, fix, when, out = [], None, None, []
    numbers = {"l": "i", "s": "h", "L": "I", "S": "H"}
    for key, kind, size, repeat, body in keyed_values(data):
        if key == b"STRM":
            scales, fix, when = [], None, None
        elif key == b"SCAL" and kind in numbers:
            scales = list(struct.unpack(">" + numbers[kind] * (len(body) // struct.calcsize(numbers[kind])), body))
        elif key == b"GPSF" and len(body) >= 4:
            fix = struct.unpack(">I", body[:4])[0]
        elif key == b"GPSU" and len(body) >= 12:
            t = body.decode("ascii", "replace").strip("\0 ")
            when = f"20{t[0:2]}:{t[2:4]}:{t[4:6]} {t[6:8]}:{t[8:10]}:{t[10:]}"
        elif key == b"GPS5" and kind == "l" and size >= 12 and len(scales) in (1, size // 4) and all(scales):
            each = scales * (size // 4) if len(scales) == 1 else scales
            for k in range(repeat):
                values = [v / s for v, s in zip(struct.unpack_from(">" + "i" * (size // 4), body, k * size), each, strict=True)]
                out.append({"t_offset_sec": start + seconds * k / repeat, "gps_lat": values[0], "gps_lon": values[1], "gps_alt": values[2], "gps_datetime": when, "gps_fix": fix})
    return out


def telemetry(source) -> list[dict]:
    """All timed positions of an open video, in order."""
    out = []
    for offset, size, start, seconds in telemetry_pieces(movie(source)):
        source.seek(offset)
        out += positions(source.read(min(size, 1 << 24)), start, seconds)
    return out


def _over_files(files: DataFrame, read: Callable, root: str, kind: pa.DataType, name: str, ddl: str) -> DataFrame:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = opened(root)
        for batch in batches:
            found = []
            for path in batch.column("path").to_pylist():
                try:
                    with store.open_input_file(path) as source:
                        found.append(read(io.BufferedReader(_Raw(source), 1 << 16)))
                except (OSError, pa.ArrowException, struct.error, IndexError):
                    found.append(None)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([list(x.items()) if isinstance(x, dict) else x for x in found], kind)], names=[*batch.schema.names, name])

    n = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = files.select("media_id", "path").repartition(n, F.xxhash64("path"))
    return rows.mapInArrow(work, f"{rows.schema.simpleString()[7:-1].replace(':', ' ').replace(',', ', ')}, {name} {ddl}")


class _Raw(io.RawIOBase):
    """An open Arrow file for Python's buffered reader."""

    def __init__(self, source):
        self.source = source

    def readable(self) -> bool:
        return True

    def seekable(self) -> bool:
        return True

    def seek(self, at: int, whence: int = 0) -> int:
        return self.source.seek(min(at, self.source.size()) if whence == 0 else at, whence)

    def readinto(self, room) -> int:
        got = self.source.read(len(room))
        room[: len(got)] = got
        return len(got)


TAGS = pa.map_(pa.string(), pa.string())
SAMPLES = pa.list_(pa.struct([("t_offset_sec", pa.float64()), ("gps_lat", pa.float64()), ("gps_lon", pa.float64()), ("gps_alt", pa.float64()), ("gps_datetime", pa.string()), ("gps_fix", pa.int32())]))


def read_picture_tags(files: DataFrame, root: str = "/") -> DataFrame:
    """``files`` (media_id, path) with tags, for ``metadata.image_facts``."""
    found = _over_files(files, picture_tags, root, TAGS, "tags", "map<string,string>")
    return found.withColumn("tags", F.coalesce("tags", F.create_map().cast("map<string,string>")))


def read_video_tags(files: DataFrame, root: str = "/") -> DataFrame:
    """``files`` (media_id, path) with tags, for ``metadata.video_facts``."""
    found = _over_files(files, video_tags, root, TAGS, "tags", "map<string,string>")
    return found.withColumn("tags", F.coalesce("tags", F.create_map().cast("map<string,string>")))


def read_telemetry(files: DataFrame, root: str = "/") -> DataFrame:
    """A row per timed position: video_id and its values, for ``tracks.sample_at``."""
    ddl = "array<struct<t_offset_sec: double, gps_lat: double, gps_lon: double, gps_alt: double, gps_datetime: string, gps_fix: int>>"
    found = _over_files(files, telemetry, root, SAMPLES, "s", ddl)
    return found.select(F.col("media_id").alias("video_id"), F.explode("s").alias("s")).select("video_id", "s.*")


def made_directory(tags: dict[int, tuple[int, list | bytes]], order: str = "<", exif: dict | None = None, gps: dict | None = None) -> bytes:
    """A TIFF block with the given entries (tag: type, values), for files made of a table's rows."""
    head = (b"II" if order == "<" else b"MM") + struct.pack(order + "HI", 42, 8)
    parts, at = [head], 8
    below = [(0x8769, exif), (0x8825, gps)]
    first = dict(tags) | {tag: (4, [0]) for tag, d in below if d}

    def packed(entries: dict, start: int, pointers: dict) -> bytes:
        rows, extra, free = [], b"", start + 2 + 12 * len(entries) + 4
        for tag, (kind, values) in sorted(entries.items()):
            values = [pointers[tag]] if tag in pointers else values
            raw = values if isinstance(values, bytes) else struct.pack(order + TYPES[kind] * (len(values) // len(TYPES[kind])), *values)
            count = len(raw) // struct.calcsize("=" + TYPES[kind])
            if len(raw) <= 4:
                place = raw.ljust(4, b"\0")
            else:
                place = struct.pack(order + "I", free + len(extra))
                extra += raw
            rows.append(struct.pack(order + "HHI", tag, kind, count) + place)
        return struct.pack(order + "H", len(rows)) + b"".join(rows) + struct.pack(order + "I", 0) + extra

    size, pointers = len(packed(first, at, {})), {}
    later, place = [], at + size
    for tag, d in below:
        if d:
            pointers[tag] = place
            later.append(packed(d, place, {}))
            place += len(later[-1])
    return b"".join([*parts, packed(first, at, pointers), *later])


def made_jpeg(block: bytes, width: int, height: int) -> bytes:
    """A JPEG's segments up to its image data, which is missing."""
    frame = struct.pack(">BHHB", 8, height, width, 1) + b"\x01\x11\x00"
    segment = lambda code, body: bytes([0xFF, code]) + struct.pack(">H", len(body) + 2) + body
    return b"\xff\xd8" + segment(0xE0, b"JFIF\0\1\1\0\0\1\0\1\0\0") + segment(0xE1, b"Exif\0\0" + block) + segment(0xC0, frame) + segment(0xDA, b"\0" * 6) + b"\0" * 64


def made_box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    return struct.pack(">I4s", 8 + len(body), kind) + body


def made_values(key: bytes, kind: str, size: int, body: bytes) -> bytes:
    """One key of telemetry; ``kind`` empty: nested."""
    repeat = len(body) if not kind else len(body) // size
    return struct.pack(">4sBBH", key, ord(kind) if kind else 0, size if kind else 1, repeat) + body + b"\0" * (-len(body) % 4)


def made_video(seconds: float, width: int, height: int, location: str, samples: list[bytes], each: float = 1.0) -> bytes:
    """A video without pictures: sizes, place and a telemetry track whose samples lie before the movie box."""
    start, offsets, at = made_box(b"ftyp", b"isom\0\0\0\0"), [], 0
    data = b"".join(samples)
    at = len(start) + 8
    for s in samples:
        offsets.append(at)
        at += len(s)
    table = lambda kind, *rows: made_box(kind, b"\0" * 4, struct.pack(">I", len(rows)), *rows)
    tkhd = made_box(b"tkhd", b"\0" * 76, struct.pack(">II", width << 16, height << 16))
    mdhd = made_box(b"mdhd", struct.pack(">IIIIII", 0, 0, 0, 1000, int(1000 * each * len(samples)), 0))
    stbl = made_box(
        b"stbl",
        made_box(b"stsd", struct.pack(">II", 0, 1), made_box(b"gpmd", b"\0" * 8)),
        table(b"stts", struct.pack(">II", len(samples), int(1000 * each))),
        made_box(b"stsz", struct.pack(">III", 0, 0, len(samples)), *(struct.pack(">I", len(s)) for s in samples)),
        table(b"stsc", struct.pack(">III", 1, 1, 1)),
        table(b"stco", *(struct.pack(">I", o) for o in offsets)),
    )
    xyz = location.encode()
    moov = made_box(
        b"moov",
        made_box(b"mvhd", struct.pack(">IIIII", 0, 0, 0, 600, round(600 * seconds))),
        made_box(b"trak", tkhd),
        made_box(b"trak", made_box(b"mdia", mdhd, made_box(b"minf", stbl))),
        made_box(b"udta", made_box(b"\xa9xyz", struct.pack(">HH", len(xyz), 0), xyz)),
    )
    return start + made_box(b"mdat", data) + moov
