import random

import pytest
from pyspark.sql import functions as F

from lumenframe.operators import shots


def plain(frames, ratio, floor, around, least):
    """Shots of one video's (frame, t, histogram), by a loop."""
    rows = sorted(frames)
    diff = [None]
    for (_, _, a), (_, _, b) in zip(rows, rows[1:], strict=False):
        ok = a is not None and b is not None and len(a) == len(b) and sum(a) > 0 and sum(b) > 0
        diff.append(round(sum(abs(x / sum(a) - y / sum(b)) for x, y in zip(a, b, strict=True)) / 2 * 1e6) if ok else None)
    able = {}
    for k, (f, _, _) in enumerate(rows):
        near = [d for j, d in enumerate(diff) if j != k and d is not None and abs(rows[j][0] - f) <= around]
        if diff[k] is not None and diff[k] >= floor * 1e6 and diff[k] * len(near) >= ratio * sum(near):
            able[f] = diff[k]
    first, last = rows[0][0], rows[-1][0]
    chosen = [f for f, d in able.items() if not any(g != f and abs(g - f) < least and (e > d or e == d and g < f) for g, e in able.items())]
    starts = [first] + sorted(f for f in chosen if f - first >= least and last + 1 - f >= least)
    times = {f: t for f, t, _ in rows}
    return [(k, f, times[f], times[starts[k + 1]] if k + 1 < len(starts) else times[last]) for k, f in enumerate(starts)]


def video(rng, n):
    out, base = [], [1, 2, 3]
    for k in range(n):
        if rng.random() < 0.08:
            base = [rng.randint(1, 50) for _ in range(3)]
        histogram = rng.choice([None, [0.0, 0.0, 0.0], [1.0, 2.0]]) if rng.random() < 0.03 else [float(x * 20 + rng.randint(0, 9)) for x in base]
        out.append((k * rng.choice([1, 1, 1, 1]) + (k // 50) * 7, k / 25, histogram))
    return out


@pytest.mark.parametrize(("piece", "bucket", "least"), [(None, 65_536, 10), (100, 5, 4), (150, 50, 1)])
def test_equal_to_a_loop(spark, piece, bucket, least):
    rng = random.Random(least)
    videos = {"hot": video(rng, 600), "b": video(rng, 40), "one": [(5, 0.2, [1.0])]}
    rows = [(v, f, t, h) for v, some in videos.items() for f, t, h in some]
    frames = spark.createDataFrame(rows, "video_id string, frame long, t double, histogram array<double>")
    got = shots.shots(frames.unionByName(frames), 2.5, 0.12, 3, least, piece, bucket).collect()
    for v, some in videos.items():
        mine = sorted((r["shot_index"], r["first_frame"], r["t_start"], r["t_end"]) for r in got if r["video_id"] == v)
        assert mine == plain(some, 2.5, 0.12, 3, least), v
    if least == 4:
        assert sum(r["video_id"] == "hot" for r in got) > 10


def test_odd_rows(spark):
    frames = spark.createDataFrame([(None, 1, 0.0, [1.0]), ("v", None, 0.0, [1.0]), ("w", 3, 1.0, None), ("w", -2, 0.5, [1.0])], "video_id string, frame long, t double, histogram array<double>")
    assert [tuple(r) for r in shots.shots(frames.withColumn("difference", F.lit(1))).collect()] == [("w", 0, -2, 0.5, 1.0)]
    assert shots.shots(frames.limit(0)).count() == 0
