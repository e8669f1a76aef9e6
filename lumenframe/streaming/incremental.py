"""Structured Streaming forms: ingest in micro-batches, deletions by state, exports, ledger."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

OUTPUT = "source_name string, rel_path string, scan_id long, action string"


def file_stream(spark: SparkSession, root: str, files_per_batch: int = 200) -> DataFrame:
    """New files below ``root`` as they come, at most ``files_per_batch`` in a micro-batch."""
    return spark.readStream.format("binaryFile").option("recursiveFileLookup", "true").option("maxFilesPerTrigger", files_per_batch).load(root)


def first_seen(files: DataFrame, late: str = "1 day") -> DataFrame:
    """Each content once within the watermark: files with (media_id, seen_at)."""
    return files.withWatermark("seen_at", late).dropDuplicatesWithinWatermark(["media_id"])


class DeletionSweep(StatefulProcessor):
    """A place's state over scans: missed once it is in grace, missed twice it is gone, seen again it is back.

    Input rows: scan_id and seen (whether this completed scan saw the place). Output: a row when the
    action of a place changes to grace, delete or return.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.place = handle.getValueState("place", "missing_since long, gone boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        found = pd.concat(list(rows)).sort_values("scan_id")
        missing, gone = self.place.get() if self.place.exists() else (None, False)
        out = []
        for scan, seen in zip(found["scan_id"], found["seen"], strict=True):
            action = None
            if seen:
                action = "return" if gone or missing is not None else None
                missing, gone = None, False
            elif missing is None and not gone:
                missing, action = int(scan), "grace"
            elif not gone and missing is not None and scan > missing:
                gone, action = True, "delete"
            if action:
                out.append((key[0], key[1], int(scan), action))
        if missing is None and not gone:
            self.place.clear()  # as if it had never been missed: only missed places have state
        else:
            self.place.update((missing, gone))
        yield pd.DataFrame(out, columns=["source_name", "rel_path", "scan_id", "action"])

    def close(self) -> None:
        pass


def sweep(observations: DataFrame) -> DataFrame:
    """Actions on places from a stream of (source_name, rel_path, scan_id, seen)."""
    return observations.groupBy("source_name", "rel_path").transformWithStateInPandas(statefulProcessor=DeletionSweep(), outputStructType=OUTPUT, outputMode="Append", timeMode="None")


def activity(events: DataFrame, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Events (ts, event_type, value) by type and window of time, late ones up to ``late``."""
    rows = events.withWatermark("ts", late).groupBy(F.window("ts", window), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return rows.select(F.col("window.start").alias("start"), "event_type", "n", "total")


def append_ledger(events: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Search, shown and open events into an append-only table, exactly once."""
    return events.writeStream.format("parquet").option("path", folder).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def export_batches(changes: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Every micro-batch to ``write`` (rows, batch id). A batch that raises isn't committed and comes again; writes go by batch id."""
    return changes.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
