"""Positions along a track at given times."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

VALUES = ["gps_lat", "gps_lon", "gps_alt", "gps_datetime_utc", "gps_fix"]


def sample_at(targets: DataFrame, samples: DataFrame, nearest: float = 1.0, between: float = 2.0, piece: float = 3600.0) -> DataFrame:
    """Targets (track, target_id, t) with the position there, from samples (track, t, VALUES).

    Between two samples at most ``between`` apart the position is interpolated (altitude if both
    have one, the time of the nearer, the fix if both agree). Otherwise the nearer sample counts if
    it is within ``nearest``, as does the first or last one for targets outside the track. A target
    on a sample lies at the end of the stretch before it. gps_source says which way; null: none.

    Tracks are cut into pieces of ``piece`` seconds, each sorted once each way; the last sample
    before a piece and the first after it are carried over from a row a piece, so a long track isn't
    one task's, and no pair of samples and targets is made.
    """
    empty = [F.lit(None).cast(samples.schema[c].dataType).alias(c) for c in VALUES]
    both = samples.select("track", F.lit(None).cast(targets.schema["target_id"].dataType).alias("target_id"), "t", F.lit(1).alias("is_sample"), *VALUES)
    both = both.unionByName(targets.select("track", "target_id", "t", F.lit(0).alias("is_sample"), *empty)).withColumn("piece", F.floor(F.col("t") / piece))
    point = F.when(F.col("is_sample") == 1, F.struct("t", *VALUES))
    pieces = both.groupBy("track", "piece").agg(F.min(point).alias("low"), F.max(point).alias("high"))
    past = Window.partitionBy("track").rowsBetween(Window.unboundedPreceding, -1)
    ends = pieces.select("track", "piece", F.last("high", ignorenulls=True).over(past.orderBy("piece")).alias("earlier"), F.last("low", ignorenulls=True).over(past.orderBy(F.desc("piece"))).alias("later"))
    line = Window.partitionBy("track", "piece").rowsBetween(Window.unboundedPreceding, -1)
    order = ["t", "is_sample", "target_id", *VALUES]
    near = both.withColumns({"p": F.last(point, ignorenulls=True).over(line.orderBy(*order)), "n": F.last(point, ignorenulls=True).over(line.orderBy(*(F.desc(c) for c in order)))}).where("is_sample = 0")
    near = near.join(ends, ["track", "piece"]).select("track", "target_id", "t", F.coalesce("p", "earlier").alias("p"), F.coalesce("n", "later").alias("n"))
    to_p, to_n, gap = F.abs(F.col("t") - F.col("p.t")), F.abs(F.col("n.t") - F.col("t")), F.col("n.t") - F.col("p.t")
    inside = F.col("p").isNotNull() & F.col("n").isNotNull()
    smooth = inside & (gap > 0) & (gap <= between)
    only = F.when(F.col("p").isNull(), F.when(to_n <= nearest, F.col("n"))).when(F.col("n").isNull() | (gap <= 0), F.when(to_p <= nearest, F.col("p")))
    only = F.when(inside & (gap > between), F.when(to_p <= to_n, F.when(to_p <= nearest, F.col("p"))).otherwise(F.when(to_n <= nearest, F.col("n")))).otherwise(only)
    share = (F.col("t") - F.col("p.t")) / F.when(gap > 0, gap)
    mixed = lambda c: F.col(f"p.{c}") + share * (F.col(f"n.{c}") - F.col(f"p.{c}"))
    out = near.withColumns({"only": only, "smooth": F.coalesce(smooth, F.lit(False))})
    return out.select(
        "track",
        "target_id",
        "t",
        *(F.when(F.col("smooth"), mixed(c)).otherwise(F.col(f"only.{c}")).alias(c) for c in VALUES[:3]),
        F.when(F.col("smooth"), F.when(share < 0.5, F.col("p.gps_datetime_utc")).otherwise(F.col("n.gps_datetime_utc"))).otherwise(F.col("only.gps_datetime_utc")).alias("gps_datetime_utc"),
        F.when(F.col("smooth"), F.when(F.col("p.gps_fix") == F.col("n.gps_fix"), F.col("p.gps_fix"))).otherwise(F.col("only.gps_fix")).alias("gps_fix"),
        F.when(F.col("smooth"), "interpolated").when(F.col("only").isNotNull(), "nearest").alias("gps_source"),
    )


LEVELS = 12  # grids around the unit sphere; cells of 4 at level 0, half as wide at each further one


def _on_sphere(lat: Column, lon: Column) -> Column:
    a, o = F.radians(lat), F.radians(lon)
    return F.array(F.cos(a) * F.cos(o), F.cos(a) * F.sin(o), F.sin(a))


def _cell(point: Column, level: Column) -> Column:
    return F.struct(*(F.floor((point[k] + 1) * F.pow(F.lit(2.0), level) / 4).alias(f"c{k}") for k in range(3)))


def nearest_place(points: DataFrame, gazetteer: DataFrame) -> DataFrame:
    """Points (id, lat, lon) with the nearest place (name, admin1, cc, lat, lon) as 'name, admin1, cc', however far; ties by that text.

    Points that agree to 3 decimals are looked up once. Each looks for the finest grid on which its
    own cell holds a place; that one is within a cell's diagonal, so the 27 cells around the point on
    the next coarser grid hold the nearest. Grids are cut in the space around the sphere, so poles
    and the date line are like any other place. Points without a position have no place.
    """
    lat, lon = F.round("lat", 3), F.round("lon", 3)
    levels = F.explode(F.sequence(F.lit(0), F.lit(LEVELS - 1)))
    spots = points.where("lat is not null and lon is not null").select(lat.alias("a"), lon.alias("o")).distinct().withColumn("at", _on_sphere(F.col("a"), F.col("o")))
    places = gazetteer.where("lat is not null and lon is not null").select(F.concat_ws(", ", "name", "admin1", "cc").alias("place"), F.col("lat").alias("plat"), F.col("lon").alias("plon"), _on_sphere(F.col("lat"), F.col("lon")).alias("at"))
    placed = places.select("place", "plat", "plon", "at", levels.alias("level")).withColumn("cell", _cell(F.col("at"), F.col("level"))).drop("at")
    own = spots.select("a", "o", "at", levels.alias("level")).withColumn("cell", _cell(F.col("at"), F.col("level")))
    held = own.join(placed.select("level", "cell").distinct(), ["level", "cell"], "left_semi").groupBy("a", "o").agg(F.max("level").alias("finest"), F.first("at").alias("at"))
    found = held.withColumn("level", F.greatest(F.lit(0), F.col("finest") - 1)).withColumn("cell", _cell(F.col("at"), F.col("level")))
    near = "flatten(flatten(transform(sequence(-1, 1), i -> transform(sequence(-1, 1), j -> transform(sequence(-1, 1), k -> named_struct('c0', cell.c0 + i, 'c1', cell.c1 + j, 'c2', cell.c2 + k))))))"
    probes = found.select("a", "o", "level", F.explode(F.expr(near)).alias("cell"))
    angle = F.pow(F.sin(F.radians(F.col("plat") - F.col("a")) / 2), 2) + F.cos(F.radians("a")) * F.cos(F.radians("plat")) * F.pow(F.sin(F.radians(F.col("plon") - F.col("o")) / 2), 2)
    km = F.round(2 * 6371.0 * F.asin(F.sqrt(F.least(F.lit(1.0), angle))), 6)
    named = probes.join(placed, ["level", "cell"]).groupBy("a", "o").agg(F.min_by("place", F.struct(km.alias("km"), "place")).alias("place"))
    return points.join(named, (lat == F.col("a")) & (lon == F.col("o")), "left").drop("a", "o")


def shot_frames(shots: DataFrame, per_shot: int = 3) -> DataFrame:
    """Times to take frames at, for shots with t_start and t_end: the middle; both ends; or ends and middle, by ``per_shot``."""
    a, b = F.col("t_start"), F.col("t_end")
    times = F.array((a + b) / 2) if per_shot <= 1 else F.array(a, b) if per_shot == 2 else F.array(a, (a + b) / 2, b)
    return shots.where("t_end > t_start").select("*", F.posexplode(times).alias("kf_index", "timestamp"))


def with_whole_shot(videos: DataFrame, shots: DataFrame) -> DataFrame:
    """Detected shots, and one synthetic shot over each video (video_id, duration) that has none and lasts."""
    none = videos.where("duration > 0").join(shots.select("video_id"), "video_id", "left_anti")
    whole = none.select("video_id", F.lit(0).alias("shot_index"), F.lit(0.0).alias("t_start"), F.col("duration").alias("t_end"), F.lit(1).alias("is_synthetic"))
    return shots.select("video_id", "shot_index", "t_start", "t_end", F.lit(0).alias("is_synthetic")).unionByName(whole)


def spread_frames(videos: DataFrame, most: int) -> DataFrame:
    """Indices of up to ``most`` frames spread evenly over each video's frame_count."""
    n = F.least(F.lit(most), F.col("frame_count"))
    picked = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.floor(i * F.col("frame_count") / n).cast("long"))
    return videos.where("frame_count > 0").select("*", F.explode(picked).alias("frame"))
