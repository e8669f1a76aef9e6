"""Shots of videos from their frames' histograms.

A cut is a frame that differs from the one before much more than the frames around it do. Everything looks a
bounded number of frames around: a video is cut into buckets of frames with the frames at their edges carried over,
and running values come from pieces, so no video is one task's.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenframe.operators import running
from lumenframe.sources import store

BUCKET = 65_536
#: Differences are counted in millionths, so that sums of them are exact.
UNIT = 1_000_000


def _stored(rows: DataFrame) -> DataFrame:
    """``rows`` written to the shared folder and read back, as several steps use them."""
    folder = store.shared_folder(rows.sparkSession, "shots")
    rows.write.parquet(folder)
    return rows.sparkSession.read.schema(rows.schema).parquet(folder)


def _difference(a: Column, b: Column) -> Column:
    """Half the sum of differences of two histograms' shares, in millionths; null if they can't be compared."""
    total = lambda h: F.aggregate(h, F.lit(0.0), lambda s, x: s + x)
    share = lambda h: F.transform(h, lambda x: x / total(h))
    apart = F.aggregate(F.zip_with(share(a), share(b), lambda x, y: F.abs(x - y)), F.lit(0.0), lambda s, x: s + x) / 2
    usable = (F.size(a) == F.size(b)) & (total(a) > 0) & (total(b) > 0)
    return F.when(usable, F.round(apart * UNIT).cast("long"))


def differences(frames: DataFrame, piece_rows: int | None = None) -> DataFrame:
    """video_id, frame, t, difference (millionths, 0 to 1,000,000) from the frame before; null for a video's first and for unusable histograms.

    ``frames``: video_id, frame (its number), t, histogram. Of frames of one number that with the least t
    counts; rows without a video or a number are left out.
    """
    whole = frames.where(F.col("video_id").isNotNull() & F.col("frame").isNotNull())
    one = whole.groupBy("video_id", F.col("frame").cast("long").alias("frame")).agg(F.min(F.struct(F.col("t").cast("double").alias("t"), F.col("histogram").cast("array<double>").alias("h"))).alias("v"))
    rows = one.select("video_id", "frame", "v.t", "v.h")
    before = running.previous(rows, ["video_id"], ["frame"], "h", "h0", piece_rows)
    return before.select("video_id", "frame", "t", _difference(F.col("h"), F.col("h0")).alias("difference"))


def cuts(differing: DataFrame, ratio: float = 3.0, floor: float = 0.15, around: int = 2, least: int = 15, bucket: int = BUCKET) -> DataFrame:
    """video_id, frame, t of the first frames of all shots but each video's first.

    A frame can be a cut if it differs by at least ``floor`` and ``ratio`` times as much as the frames within
    ``around`` of it do on average. Of such frames closer than ``least`` only the greatest (of equal ones the first)
    can be, and none that is closer than that to its video's first frame or end.
    """
    reach = around + least
    ends = differing.groupBy("video_id").agg(F.min("frame").alias("first"), F.max("frame").alias("last"))
    homes = F.sequence(F.floor((F.col("frame") - reach) / bucket), F.floor((F.col("frame") + reach) / bucket))
    dealt = differing.select("video_id", "frame", "t", "difference", F.floor(F.col("frame") / bucket).alias("home"), F.explode(homes).alias("bucket"))
    within = lambda n: Window.partitionBy("video_id", "bucket").orderBy("frame").rangeBetween(-n, n)
    others = F.sum("difference").over(within(around)) - F.col("difference")
    n = F.count("difference").over(within(around)) - 1
    able = (F.col("difference") >= round(floor * UNIT)) & (F.col("difference") * n >= F.lit(float(ratio)) * others)
    marked = dealt.withColumn("able", F.when(able, F.struct("difference", (-F.col("frame")).alias("minus"))))
    best = marked.withColumn("best", F.max("able").over(within(least - 1))).where("home = bucket and able is not null and able = best")
    return best.join(ends, "video_id").where((F.col("frame") - F.col("first") >= least) & (F.col("last") + 1 - F.col("frame") >= least)).select("video_id", "frame", "t")


def shots(frames: DataFrame, ratio: float = 3.0, floor: float = 0.15, around: int = 2, least: int = 15, piece_rows: int | None = None, bucket: int = BUCKET) -> DataFrame:
    """video_id, shot_index, first_frame, t_start, t_end of every shot; a video without a cut is one. The last shot ends with its video's last frame."""
    differing = _stored(differences(frames, piece_rows))
    ends = differing.groupBy("video_id").agg(F.min_by(F.struct("frame", "t"), "frame").alias("first"), F.max_by("t", "frame").alias("last"))
    starts = _stored(cuts(differing, ratio, floor, around, least, bucket).unionByName(ends.select("video_id", "first.frame", "first.t")))
    numbered = running.running(starts, ["video_id"], ["frame"], {"place": F.lit(1)}, piece_rows).withColumns({"minus": -F.col("frame"), "at": F.struct("t")})
    numbered = _stored(numbered)
    following = running.previous(numbered, ["video_id"], ["minus"], "at", "after", piece_rows)
    joined = following.join(ends.select("video_id", F.col("last").alias("t_last")), "video_id")
    end = F.when(F.col("after").isNull(), F.col("t_last")).otherwise(F.col("after.t"))
    return joined.select("video_id", (F.col("place") - 1).alias("shot_index"), F.col("frame").alias("first_frame"), F.col("t").alias("t_start"), end.alias("t_end"))
