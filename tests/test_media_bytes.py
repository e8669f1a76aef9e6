import io
import random
import struct

import pytest

from lumenframe.sources import media_bytes as B
from lumenframe.sources import metadata


def block(order, model=b"Cam One\0"):
    gps = {1: (2, b"S\0"), 2: (5, [35, 1, 30, 1, 1800, 100]), 3: (2, b"E\0"), 4: (5, [117, 1, 15, 1, 0, 1])}
    exif = {0x9003: (2, b"2023:06:15 10:00:00\0"), 0xA434: (2, b"Lens\0"), 0xA002: (4, [9]), 0xA003: (4, [8])}
    return B.made_directory({0x0110: (2, model), 0x0132: (2, b"2024:01:01 00:00:00\0"), 0x0100: (3, [7]), 0x0101: (3, [6])}, order, exif, gps)


WANT = {"Model": "Cam One", "DateTime": "2024:01:01 00:00:00", "ImageWidth": "7", "ImageHeight": "6", "DateTimeOriginal": "2023:06:15 10:00:00", "LensModel": "Lens", "ExifImageWidth": "9", "ExifImageHeight": "8", "GPSLatitudeRef": "S", "GPSLatitude": "35 30 18", "GPSLongitudeRef": "E", "GPSLongitude": "117 15 0"}


@pytest.mark.parametrize("order", ["<", ">"])
def test_directories_of_both_orders(order):
    assert B.directory_tags(block(order)) == WANT
    jpeg = B.made_jpeg(block(order), 640, 480)
    assert B.picture_tags(io.BytesIO(jpeg)) == WANT | {"ImageWidth": "640", "ImageHeight": "480"}
    assert B.picture_tags(io.BytesIO(block(order))) == WANT
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + b"crc!"
    png = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">II", 3, 2) + b"\0" * 5) + chunk(b"eXIf", block(order)) + chunk(b"IDAT", b"x")
    assert B.picture_tags(io.BytesIO(png)) == WANT | {"ImageWidth": "3", "ImageHeight": "2"}


@pytest.mark.parametrize("order", ["<", ">"])
def test_cut_off_and_damaged_pictures(order):
    jpeg, rng = B.made_jpeg(block(order), 640, 480), random.Random(1)
    for n in range(len(jpeg)):
        got = B.picture_tags(io.BytesIO(jpeg[:n]))
        assert all(got[k] == (WANT | {"ImageWidth": "640", "ImageHeight": "480"})[k] or k.startswith("Image") for k in got)
    for _ in range(500):
        wrong = bytearray(jpeg)
        for _ in range(rng.randint(1, 8)):
            wrong[rng.randrange(len(wrong))] = rng.randrange(256)
        assert isinstance(B.picture_tags(io.BytesIO(bytes(wrong))), dict)


def test_a_directory_that_points_at_itself():
    data = (b"II" + struct.pack("<HI", 42, 8)) + struct.pack("<H", 2) + struct.pack("<HHII", 0x8769, 4, 1, 8) + struct.pack("<HHII", 0x8825, 4, 1, 8) + b"\0" * 4
    assert B.directory_tags(data) == {}
    assert B.directory_tags(b"II" + struct.pack("<HI", 42, 1 << 31)) == {}
    assert B.directory_tags(b"XX") == {} and B.picture_tags(io.BytesIO(b"")) == {}


def sample(points, scale=(10**7, 10**7, 1000, 1000, 100), fix=3, when="230615100000.500"):
    rows = b"".join(struct.pack(">5i", round(a * scale[0]), round(o * scale[1]), round(z * scale[2]), 0, 0) for a, o, z in points)
    strm = B.made_values(b"GPSF", "L", 4, struct.pack(">I", fix)) + B.made_values(b"GPSU", "U", 16, when.encode()) + B.made_values(b"SCAL", "l", 4, struct.pack(">5i", *scale)) + B.made_values(b"GPS5", "l", 20, rows)
    other = B.made_values(b"SCAL", "s", 2, struct.pack(">h", 418)) + B.made_values(b"ACCL", "s", 6, struct.pack(">3h", 1, 2, 3))
    return B.made_values(b"DEVC", "", 0, B.made_values(b"STRM", "", 0, other) + B.made_values(b"STRM", "", 0, strm))


class Watched(io.BytesIO):
    """Counts what is read."""

    total = 0

    def read(self, n=-1):
        got = super().read(n)
        self.total += len(got)
        return got


def test_video_facts_and_telemetry():
    film = B.made_video(12.5, 1920, 1080, "+37.7749-122.4194/", [sample([(10, 20, 100), (11, 22, 110)]), sample([(12, 24, 120)], fix=2)])
    assert B.video_tags(io.BytesIO(film)) == {"duration": "12.5", "width": "1920", "height": "1080", "location": "+37.7749-122.4194"}
    got = B.telemetry(io.BytesIO(film))
    assert [(s["t_offset_sec"], s["gps_lat"], s["gps_lon"], s["gps_alt"], s["gps_fix"]) for s in got] == [(0.0, 10, 20, 100, 3), (0.5, 11, 22, 110, 3), (1.0, 12, 24, 120, 2)]
    assert got[0]["gps_datetime"] == "2023:06:15 10:00:00.500"


def test_payload_is_not_read():
    film = B.made_video(1, 10, 10, "", [b"\0" * 5_000_000])
    source = Watched(film)
    assert B.video_tags(source)["width"] == "10" and source.total < 10_000
    wide = struct.pack(">I4sQ", 1, b"mdat", 16 + 1000) + b"\0" * 1000
    assert B.video_tags(io.BytesIO(wide + B.made_box(b"moov", B.made_box(b"mvhd", b"\1\0\0\0" + struct.pack(">QQIQ", 0, 0, 10, 55)))))["duration"] == "5.5"


def test_cut_off_and_damaged_videos():
    film, rng = B.made_video(12.5, 1920, 1080, "+1-2/", [sample([(10, 20, 100)])] * 3), random.Random(2)
    for n in range(0, len(film), 3):
        B.video_tags(io.BytesIO(film[:n]))
    for _ in range(500):
        wrong = bytearray(film)
        for _ in range(rng.randint(1, 8)):
            wrong[rng.randrange(len(wrong))] = rng.randrange(256)
        for read in (B.video_tags, B.telemetry):
            try:
                read(io.BytesIO(bytes(wrong)))
            except (struct.error, IndexError):
                pass  # what a task takes as no value


def test_files_to_columns(spark, tmp_path):
    (tmp_path / "a.jpg").write_bytes(B.made_jpeg(block("<"), 640, 480))
    (tmp_path / "b.jpg").write_bytes(b"nothing")
    (tmp_path / "v.mp4").write_bytes(B.made_video(12.5, 1920, 1080, "+37.7749-122.4194/", [sample([(10, 20, 100), (11, 22, 110)])]))
    files = spark.createDataFrame([(n, f"{tmp_path}/{n}") for n in ("a.jpg", "b.jpg", "v.mp4", "gone.jpg")], "media_id string, path string")
    facts = {r["media_id"]: r.asDict() for r in metadata.image_facts(B.read_picture_tags(files)).collect()}
    a = facts["a.jpg"]
    assert (a["ts_utc"], a["camera"], a["lens"], a["width"], a["height"]) == ("2023-06-15T10:00:00", "Cam One", "Lens", 640, 480)
    assert a["gps_lat"] == pytest.approx(-35.505) and a["gps_lon"] == pytest.approx(117.25)
    assert all(v is None for k, v in facts["gone.jpg"].items() if k != "media_id") and facts["b.jpg"]["width"] is None
    video = {r["media_id"]: r for r in metadata.video_facts(B.read_video_tags(files), ["tags"]).collect()}["v.mp4"]
    assert (video["duration"], video["width"], video["gps_lat"], video["gps_lon"]) == (12.5, 1920, 37.7749, -122.4194)
    track = B.read_telemetry(files)
    assert track.count() == 2 and set(track.columns) >= {"video_id", "t_offset_sec", "gps_lat", "gps_lon"}
