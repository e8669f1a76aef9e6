"""From retrieved hits to a ranked list: merge, expansion, scores, clusters in time, reranking."""

from __future__ import annotations

from collections.abc import Callable
from itertools import groupby

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenframe.functions import numbers
from lumenframe.functions.query_text import face_names
from lumenframe.operators import running


def merge(hits: DataFrame, fill: list[str] = (), partition: list[str] = ()) -> DataFrame:
    """One candidate for each id: best score and its source, and the best score of each source.

    ``hits``: id, source, source_order, score, rank and the ``fill`` columns, which take the first
    value by (source_order, rank) that isn't null. Ties of the best score go to the earlier source.
    """
    by_source = hits.groupBy(*partition, "id", "source").agg(F.max("score").alias("score"), F.min("source_order").alias("source_order"), F.min("rank").alias("rank"), *(F.min_by(F.struct(c), F.when(F.col(c).isNotNull(), F.struct("source_order", "rank"))).alias(c) for c in fill))
    first = F.struct((-F.col("score")).alias("s"), "source_order", "rank")
    place = F.struct("source_order", "rank")
    merged = by_source.groupBy(*partition, "id").agg(
        F.max("score").alias("score"),
        F.min_by("source", first).alias("source"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("source", "score")))).alias("source_scores"),
        *(F.min_by(f"{c}.{c}", F.when(F.col(c).isNotNull(), place)).alias(c) for c in fill),
    )
    return merged.withColumn("raw_similarity_score", F.col("score"))


def append_missing(candidates: DataFrame, extra: DataFrame, key: str | list[str] = "id") -> DataFrame:
    """``extra`` rows whose key no candidate has, below the candidates; columns that one side lacks are null."""
    keys = [key] if isinstance(key, str) else key
    new = extra.join(candidates.select(*keys).distinct(), keys, "left_anti")
    return candidates.unionByName(new, allowMissingColumns=True)


def expand_people(media: DataFrame, faces: DataFrame, people: DataFrame, names: list[str], first: str | None = None, last: str | None = None, limit: int = 100) -> DataFrame:
    """Live media that show one of ``names`` (any case), the latest first, then the last added: id, ts_utc, people; score 0."""
    wanted = people.where(F.lower("name").isin([n.lower() for n in names])).select("person_id")
    shown = faces.join(wanted, "person_id", "left_semi").select("media_id").distinct()
    rows = media.where("deleted = 0").join(shown, "media_id", "left_semi")
    if first:
        rows = rows.where(F.col("ts_utc") >= first)
    if last:
        rows = rows.where(F.col("ts_utc") <= last)
    added = [F.desc("added_at")] if "added_at" in media.columns else []
    page = rows.orderBy(F.desc("ts_utc"), *added, "media_id").limit(limit)
    named = faces.join(page.select("media_id"), "media_id", "left_semi").join(people, "person_id").groupBy("media_id").agg(F.array_sort(F.collect_set("name")).alias("people"))
    return page.join(named, "media_id", "left").select(F.col("media_id").alias("id"), "ts_utc", "people", F.lit(0.0).alias("score"), F.lit("person_expand").alias("source"))


def score_breakdown(raw: Column, faces: Column, asked: Column, expanded: Column) -> Column:
    """struct of the score's parts: a quarter more for each person asked for, half more for expanded rows of some similarity.

    ``faces``: the row's lower-case names, ``asked``: those of the query.
    """
    hits = F.size(F.array_intersect(F.coalesce(faces, F.array().cast("array<string>")), asked))
    person = 1.0 + 0.25 * hits
    expansion = F.when((raw > 0) & expanded, 1.5).otherwise(1.0)
    return F.struct(
        raw.alias("raw_similarity_score"),
        F.lit(0.0).alias("expansion_base_score"),
        raw.alias("similarity_score"),
        (raw * (person - 1.0)).alias("person_boost"),
        person.alias("person_multiplier"),
        (raw * person * (expansion - 1.0)).alias("expansion_boost"),
        expansion.alias("expansion_multiplier"),
        (raw * person * expansion).alias("total_score"),
    )


PARTS = ["raw_similarity_score", "expansion_base_score", "similarity_score", "person_boost", "person_multiplier", "expansion_boost", "expansion_multiplier", "total_score"]


def ranked(candidates: DataFrame, asked: list[str], limit: int = 50, digits: int = 6, partition: list[str] = ()) -> DataFrame:
    """The ``limit`` best by total score, of each query if ``partition`` names one; ties by id. ``candidates``: id, score, source_scores, people (names), source."""
    names = F.array(*(F.lit(a.strip().lower()) for a in asked)).cast("array<string>")
    expanded = (F.col("source") == "person_expand") | F.coalesce(F.map_contains_key("source_scores", "person_expand"), F.lit(False))
    on = F.transform(F.coalesce("people", F.array().cast("array<string>")), lambda x: F.lower(F.trim(x))) if "people" in candidates.columns else face_names(F.col("faces"))
    parts = score_breakdown(F.col("score"), on, names, expanded)
    scored = candidates.withColumn("parts", parts).withColumn("total_score", numbers.rounded(F.col("parts.total_score"), digits))
    if not partition:
        return scored.orderBy(F.desc("total_score"), "id").limit(limit)
    place = F.row_number().over(Window.partitionBy(*partition).orderBy(F.desc("total_score"), "id"))
    return scored.withColumn("__place", place).where(F.col("__place") <= limit).drop("__place")


def cluster_in_time(frames: DataFrame, window: float = 5.0, keys: list[str] = ("path",), carry: list[str] = (), piece_rows: int | None = None) -> DataFrame:
    """The best frame of each greedy cluster of one path: ``keys``, timestamp, score, id and the ``carry`` columns.

    In order of time (then score, the best first, then id), a frame joins the latest cluster if it is
    within ``window`` of its frame, and takes its place if it scores strictly more (so the cluster moves
    with it), else opens another. A missing time counts as 0; a missing score is no more than any, and
    nothing is more than it; a null path is one path.

    What comes after a cluster's frame depends on that frame only. So a path of more than ``piece_rows``
    frames is cut into pieces (``running.in_pieces``) that fold apart, from every frame in one pass
    backwards: as folds from neighbouring frames soon meet, a few rows say with which frame a piece is left,
    given the one it is entered with. These are followed from piece to piece, and each piece folds once more.
    """
    keys, carry = list(keys), list(carry)
    clean = frames.select(*(F.col(f"`{k}`").alias(f"k{n}") for n, k in enumerate(keys)), F.coalesce("timestamp", F.lit(0.0)).cast("double").alias("t"), (-F.col("score")).cast("double").alias("m"), F.col("id").alias("i"), *(F.col(f"`{c}`").alias(f"c{n}") for n, c in enumerate(carry)))
    group, most = [f"k{n}" for n in range(len(keys))], piece_rows or running.PIECE_ROWS
    keyed = clean.withColumn("path", F.struct(*group, F.lit(0).alias("g")))
    large = keyed.groupBy("path").agg(F.count("*").alias("n")).where(F.col("n") > most).select("path")
    short = keyed.join(large, "path", "left_anti")
    plain = short.select(*group, F.col("t").alias("timestamp"), (-F.col("m")).alias("score"), F.col("i").alias("id"), *(f"c{n}" for n in range(len(carry))))
    done = cluster_bounded(plain, window, group, [f"c{n}" for n in range(len(carry))])
    whole = done.unionByName(_by_pieces(keyed.join(large, "path", "left_semi").drop("path"), window, group, most))
    return whole.select(*(F.col(f"k{n}").alias(k) for n, k in enumerate(keys)), "timestamp", "score", "id", *(F.col(f"c{n}").alias(c) for n, c in enumerate(carry)))


def _by_pieces(clean: DataFrame, window: float, group: list[str], most: int) -> DataFrame:
    """The clusters' frames of paths of any length."""
    frame = [c for c in clean.columns if c not in group]
    cut = running.in_pieces(clean, group, ["t", "m", "i"], most)
    packed = cut.select(F.col(running.KEY).alias("path"), F.col(running.PIECE).alias("piece"), "t", "m", "i", F.struct(*frame).alias("frame"))
    field = packed.schema.fields
    named = {f.name: T.StructField(f.name, f.dataType) for f in field}
    summed = packed.groupBy("path", "piece").applyInArrow(lambda table: _piece_summary(table, window), T.StructType([named["path"], named["piece"], T.StructField("no", T.LongType()), T.StructField("t", T.DoubleType()), T.StructField("best", T.DoubleType()), named["frame"]]))
    carried = summed.groupBy("path").applyInArrow(lambda table: _carried(table, window), T.StructType([named["path"], named["piece"], named["frame"]]))
    both = packed.withColumn("held", F.lit(False)).unionByName(carried.withColumn("held", F.lit(True)), allowMissingColumns=True)
    kept = both.groupBy("path", "piece").applyInArrow(lambda table: _piece_kept(table, window), T.StructType([named["path"], named["frame"]]))
    carry = [c for c in frame if c not in ("t", "m", "i")]
    return kept.select(*(F.col("path")[f"g{n}"].alias(g) for n, g in enumerate(group)), F.col("frame.t").alias("timestamp"), (-F.col("frame.m")).alias("score"), F.col("frame.i").alias("id"), *(F.col("frame")[c].alias(c) for c in carry))


def _levels(minus: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Scores downwards as challengers and as those challenged: a missing one beats none and isn't beaten, one that isn't a number beats none."""
    none = np.asarray(minus.is_null())
    plain = np.asarray(minus.to_numpy(zero_copy_only=False), float) if isinstance(minus, pa.Array) else np.asarray(minus.to_numpy(), float)
    new = np.where(np.isnan(plain), np.inf, plain)
    return new, np.where(none, -np.inf, new)


def _sorted_frames(table: pa.Table) -> tuple[pa.Table, np.ndarray, np.ndarray, np.ndarray]:
    """A piece's frames in their order, their times, and their levels."""
    minus = table.column("m").combine_chunks()
    by_id = pc.rank(table.column("i"), sort_keys="ascending", null_placement="at_start", tiebreaker="min").to_numpy()
    table = table.take(pa.array(np.lexsort((by_id, minus.to_numpy(zero_copy_only=False), np.asarray(minus.is_valid()), table.column("t").to_numpy()))))
    return table, table.column("t").to_numpy(), *_levels(table.column("m").combine_chunks())


def _follow(t: np.ndarray, new: np.ndarray, held: np.ndarray, window: float) -> tuple[np.ndarray, np.ndarray]:
    """For each frame the next that takes its place or opens a cluster (their number if none does), and whether it opens one."""
    n = len(t)
    times, first, which = np.unique(t, return_index=True, return_inverse=True)
    sure = np.isfinite(times)
    at = np.searchsorted(times, times + window, side="right")
    with np.errstate(invalid="ignore"):
        while (late := sure & (at > 0) & ~(times[np.maximum(at - 1, 0)] - times <= window)).any():
            at[late] -= 1
        while (early := sure & (at < len(times)) & (times[np.minimum(at, len(times) - 1)] - times <= window)).any():
            at[early] += 1
    at[~sure] = 0
    opens = np.maximum(np.append(first, n)[at][which], np.arange(n) + 1)
    better = np.full(n, n)
    stack: list[int] = []
    for k in range(n):  # those that wait have ever higher levels, so the last is beaten first
        while stack and new[k] < held[stack[-1]]:
            better[stack.pop()] = k
        if held[k] > -np.inf:
            stack.append(k)
    return np.minimum(opens, better), opens <= better


def _ends(follow: np.ndarray) -> np.ndarray:
    """The frame that each frame's fold leaves the piece with."""
    end, after = list(range(len(follow))), follow.tolist()
    for k in range(len(end) - 1, -1, -1):
        if after[k] < len(end):
            end[k] = end[after[k]]
    return np.array(end)


def _piece_summary(table: pa.Table, window: float) -> pa.Table:
    """A row for each stretch of frames from which a piece is left with the same one, with the last time and the best level before it; the last row for a frame held all through."""
    table, t, new, held = _sorted_frames(table)
    end = _ends(_follow(t, new, held, window)[0])
    first = np.flatnonzero(np.diff(end, prepend=-1))
    best = np.minimum.accumulate(new)
    before = lambda x: pa.array([None if k == 0 else float(x[k - 1]) for k in first] + [float(x[-1])], pa.float64())
    same = pa.array([0] * (len(first) + 1))
    frame = table.column("frame").take(pa.array([*end[first].tolist(), None], pa.int64()))
    return pa.table({"path": table.column("path").take(same), "piece": table.column("piece").take(same), "no": pa.array(range(len(same)), pa.int64()), "t": before(t), "best": before(best), "frame": frame})


def _carried(table: pa.Table, window: float) -> pa.Table:
    """The frame that each piece is entered with, null for a path's first; piece -1 is entered with the path's last."""
    table = table.sort_by([("piece", "ascending"), ("no", "ascending")])
    piece, t, best = (table.column(c).to_pylist() for c in ("piece", "t", "best"))
    frames = table.column("frame").combine_chunks()
    through = np.asarray(frames.is_null())
    times, held = pc.struct_field(frames, "t").to_numpy(zero_copy_only=False), _levels(pc.struct_field(frames, "m"))[1]
    at, pieces, taken = None, [], []
    for p, rows in groupby(range(len(piece)), key=piece.__getitem__):
        pieces.append(p)
        taken.append(at)
        into = next(rows)
        for r in rows:  # a stretch is entered if no frame before it ends or beats the held one
            if at is not None and t[r] - times[at] <= window and not best[r] < held[at]:
                into = r
        at = at if through[into] else into
    path = table.column("path").take(pa.array([0] * (len(pieces) + 1)))
    return pa.table({"path": path, "piece": pa.array([*pieces, -1], table.schema.field("piece").type), "frame": frames.take(pa.array([*taken, at], pa.int64()))})


def _piece_kept(table: pa.Table, window: float) -> pa.Table:
    """The frames whose cluster ends in a piece as another opens there; all of piece -1."""
    carried, own = table.filter(table.column("held")).select(["path", "frame"]), table.filter(pc.invert(table.column("held")))
    if not own.num_rows:
        return carried
    own, t, new, held = _sorted_frames(own)
    follow, opens = _follow(t, new, held, window)
    kept, at, out = [], 0, []
    if carried.column("frame").null_count == 0:
        frame = pa.array(carried.column("frame").to_pylist(), carried.schema.field("frame").type)
        with np.errstate(invalid="ignore"):
            late, more = np.flatnonzero(~(t - frame[0].as_py()["t"] <= window)), np.flatnonzero(new < _levels(pc.struct_field(frame, "m"))[1][0])
        opened, beaten = (int(x[0]) if len(x) else len(t) for x in (late, more))
        at = min(opened, beaten)
        if opened <= beaten and opened < len(t):
            out.append(carried)
    while at < len(t):
        if opens[at] and follow[at] < len(t):
            kept.append(at)
        at = int(follow[at])
    return pa.concat_tables([own.take(pa.array(kept, pa.int64())).select(["path", "frame"]), *out])


def cluster_bounded(frames: DataFrame, window: float = 5.0, keys: list[str] = ("path",), carry: list[str] = ()) -> DataFrame:
    """``cluster_in_time`` where a path has a bounded number of frames, as among the hits of a search.

    Where two successive frames lie more than ``window`` apart no cluster goes on, so each such stretch
    folds on its own, as one array, in chunks of ``CHUNK`` frames: a fold's cost is in proportion to its frames.
    """
    keys = list(keys)
    clean = frames.select(*keys, F.coalesce("timestamp", F.lit(0.0)).alias("timestamp"), (-F.col("score")).alias("minus"), "id", *carry)
    order = Window.partitionBy(*keys).orderBy("timestamp", "minus", "id")
    opens = F.coalesce((F.col("timestamp") - F.lag("timestamp").over(order) > window).cast("int"), F.lit(0))
    stretches = clean.withColumn("opens", opens).withColumn("stretch", F.sum("opens").over(order))
    rows = stretches.groupBy(*keys, "stretch").agg(F.array_sort(F.collect_list(F.struct("timestamp", "minus", "id", *carry))).alias("rows"))
    kind = rows.schema["rows"].dataType.elementType
    kept = rows.select(*keys, F.explode(_folded(F.col("rows"), window, kind)).alias("r"))
    return kept.select(*keys, "r.timestamp", (-F.col("r.minus")).alias("score"), "r.id", *(f"r.{c}" for c in carry))


CHUNK = 256


def _folded(rows: Column, window: float, kind: T.DataType) -> Column:
    """The clusters' frames of sorted ``rows`` (timestamp, minus, id, ...) of type ``kind``."""
    none, empty = F.lit(None).cast(kind), F.array().cast(T.ArrayType(kind))

    def step(state: Column, row: Column) -> Column:
        last = state["last"]
        joins = F.abs(row["timestamp"] - last["timestamp"]) <= window
        new = F.struct(row.alias("last"), F.when(last.isNull(), state["kept"]).otherwise(F.concat(state["kept"], F.array(last))).alias("kept"))
        return F.when(joins, F.struct(F.when(row["minus"] < last["minus"], row).otherwise(last).alias("last"), state["kept"].alias("kept"))).otherwise(new)

    def chunk(state: Column, some: Column) -> Column:
        return F.aggregate(some, F.struct(state["last"].alias("last"), empty.alias("kept")), step, lambda s: F.struct(s["last"].alias("last"), F.concat(state["kept"], s["kept"]).alias("kept")))

    chunks = F.transform(F.sequence(F.lit(0), F.floor((F.size(rows) - 1) / CHUNK).cast("int")), lambda k: F.slice(rows, k * CHUNK + 1, F.lit(CHUNK)))
    return F.aggregate(chunks, F.struct(none.alias("last"), empty.alias("kept")), chunk, lambda s: F.concat(s["kept"], F.array(s["last"])))


def features(results: DataFrame, people: list[str] = (), tokens: list[str] = (), first: str | None = None, last: str | None = None, place: str | None = None, today: str | None = None) -> DataFrame:
    """Results with a reranker's features, f_<name>: the scores, how far people, tags, date and place meet the query, and age in years.

    What the query doesn't ask for, or the result doesn't know, is 0.
    """
    lower = lambda xs: F.transform(F.coalesce(xs, F.array().cast("array<string>")), F.lower)
    share = lambda xs, wanted: F.size(F.array_intersect(lower(xs), F.array(*(F.lit(w.lower()) for w in wanted)))) / len(wanted) if wanted else F.lit(0.0)
    inside = F.coalesce((F.col("date") >= (first or "")) & (F.col("date") <= (last or "9999")), F.lit(False)) if first or last else F.lit(False)
    near = F.coalesce(F.contains(F.lower("place"), F.lit(place.lower())), F.lit(False)) if place else F.lit(False)
    age = F.datediff(F.lit(today), F.substring("date", 1, 10).try_cast("date")) / 365.25 if today else F.lit(0.0)
    new = {"similarity": F.col("similarity_score"), "total": F.col("total_score"), "people": share(F.col("people"), people), "tags": share(F.col("tags"), tokens), "in_dates": inside.cast("double"), "in_place": near.cast("double"), "age": F.coalesce(age, F.lit(0.0))}
    return results.withColumns({f"f_{name}": c.cast("double") for name, c in new.items()})


def learned_rerank(candidates: DataFrame, model: Callable[[pd.DataFrame], np.ndarray], features: list[str], context: list[str] = ()) -> DataFrame:
    """Candidates of each query in the model's order, or as they were if it gives no usable scores.

    ``candidates``: query_id, rank, total_score and ``features``. A model that raises, gives another
    number of scores or one that isn't finite, or a feature that is missing, leaves its query's
    order as it is; heuristic_score keeps the first score either way.
    """
    schema = T.StructType([*candidates.schema, T.StructField("heuristic_score", T.DoubleType()), T.StructField("model_score", T.DoubleType())])

    def work(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("rank", kind="stable").reset_index(drop=True)
        rows["heuristic_score"], rows["model_score"] = rows["total_score"].astype(float), np.nan
        given = rows[features].apply(pd.to_numeric, errors="coerce")
        try:
            scores = np.asarray(model(rows[[*features, *context]]), dtype=float)
        except Exception:  # whatever the model does, the list stays
            return rows
        if given.isna().any().any() or scores.shape != (len(rows),) or not np.isfinite(scores).all():
            return rows
        rows["model_score"] = scores
        order = np.argsort(-scores, kind="stable")
        rows = rows.iloc[order].reset_index(drop=True)
        rows["rank"] = np.arange(1, len(rows) + 1)
        return rows

    return candidates.groupBy("query_id").applyInPandas(work, schema)


def positions(results: DataFrame, order: list[Column], partition: list[str]) -> DataFrame:
    """With 0-based impression positions."""
    return results.withColumn("position", (F.row_number().over(Window.partitionBy(*partition).orderBy(*order)) - 1).cast("long"))
