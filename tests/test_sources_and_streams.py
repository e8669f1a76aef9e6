"""Readers of files and logs, and the streaming forms."""

import hashlib
import json

import pandas as pd

from lumenframe.sources import files, schemas
from lumenframe.streaming import incremental


def test_scan(spark, tmp_path):
    for name in ("a/one.JPG", "a/b/two.mp4", "a/.hidden/three.jpg", ".four.png", "five.txt"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(name.encode())
    got = {r["rel_path"]: (r["kind"], r["size_bytes"], r["media_id"]) for r in files.scan_media(spark, str(tmp_path), with_content=True).collect()}
    assert got == {"a/one.JPG": ("image", 9, hashlib.sha256(b"a/one.JPG").hexdigest()), "a/b/two.mp4": ("video", 11, hashlib.sha256(b"a/b/two.mp4").hexdigest())}
    assert [r["rel_path"] for r in files.scan_media(spark, str(tmp_path), "video").collect()] == ["a/b/two.mp4"]


def test_logs(spark, tmp_path):
    log = tmp_path / "run.log"
    log.write_text("x\nINDEXER_SUMMARY {\"n\": 1}\n\x1b[32mgreen\x1b[0m\nINDEXER_SUMMARY {\"n\": 2}\nINDEXER_SUMMARY {bad\nPerformance | image=350ms video=2.5s/min\n")
    lines = files.log_lines(spark, str(log))
    assert json.loads(files.last_summary(lines).first()[0]) == {"n": 2}
    assert {r["name"]: r["seconds"] for r in files.performance(lines).collect()} == {"image": 0.35, "video": 2.5}
    assert [r["line"] for r in files.log_tail(lines, 4).collect()][0] == "green"


def test_telemetry(spark):
    fields = {"Doc1:GPSLatitude": "1.5", "Doc1:GPSLongitude": "2", "Doc1-1:GPSLatitude": "1.6", "Doc1-1:GPSLongitude": "2", "Doc2:GPSLatitude": "x", "Other": "1"}
    got = files.telemetry_samples(spark.createDataFrame([("v", fields)], "video_id string, fields map<string,string>")).orderBy("t_offset_sec").collect()
    assert [(r["t_offset_sec"], r["gps_lat"]) for r in got] == [(0.0, 1.5), (0.1, 1.6)]


def test_schemas_parse(spark):
    assert len(schemas.TABLES) == 13 and all(spark.createDataFrame([], ddl).columns for ddl in schemas.TABLES.values())


def test_ledger_stream_appends_once(spark, tmp_path):
    source, out, mark = (str(tmp_path / n) for n in ("in", "out", "mark"))
    spark.createDataFrame([("s", "m", 0)], "search_id string, media_id string, position int").write.parquet(source)
    for _ in range(2):
        stream = spark.readStream.schema("search_id string, media_id string, position int").parquet(source)
        incremental.append_ledger(stream, out, mark).awaitTermination()
    assert spark.read.parquet(out).count() == 1


def test_failed_export_batch_comes_again(spark, tmp_path):
    source, mark = str(tmp_path / "in"), str(tmp_path / "mark")
    spark.range(3).write.parquet(source)
    seen = []

    def run(write):
        query = incremental.export_batches(spark.readStream.schema("id long").parquet(source), write, mark)
        try:
            query.awaitTermination()
        except Exception:
            return False
        return True

    assert not run(lambda rows, batch: 1 / 0)
    assert run(lambda rows, batch: seen.append((batch, rows.count()))) and seen == [(0, 3)]


def test_windowed_activity(spark, tmp_path):
    source = str(tmp_path / "in")
    spark.createDataFrame([("2024-01-01 00:10:00", "click", 1.0), ("2024-01-01 00:50:00", "click", 2.0), ("2024-01-01 09:00:00", "open", 1.0)], "ts string, event_type string, value double").selectExpr("cast(ts as timestamp) ts", "event_type", "value").write.parquet(source)
    rows = incremental.activity(spark.readStream.schema("ts timestamp, event_type string, value double").parquet(source))
    rows.writeStream.format("memory").queryName("activity").outputMode("append").option("checkpointLocation", str(tmp_path / "mark")).trigger(availableNow=True).start().awaitTermination()
    assert [(r["event_type"], r["n"], r["total"]) for r in spark.table("activity").collect()] == [("click", 2, 3.0)]


class Handle:
    class Value:
        value = None

        def exists(self):
            return self.value is not None

        def get(self):
            return self.value

        def update(self, v):
            self.value = v

        def clear(self):
            self.value = None

    def getValueState(self, *_):
        return self.Value()


def test_sweep_state():
    sweep = incremental.DeletionSweep()
    sweep.init(Handle())
    feed = lambda *rows: [tuple(r[2:]) for out in sweep.handleInputRows(("s", "p"), iter([pd.DataFrame(rows, columns=["scan_id", "seen"])]), None) for r in out.itertuples(index=False, name=None)]
    assert feed((1, True)) == []
    assert feed((2, False)) == [(2, "grace")]
    assert feed((3, False)) == [(3, "delete")]
    assert feed((4, False)) == [] and feed((5, True)) == [(5, "return")]
    assert feed((6, False), (7, True), (8, False), (9, False)) == [(6, "grace"), (7, "return"), (8, "grace"), (9, "delete")]
