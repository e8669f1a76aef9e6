"""Text search over several vector collections, as one plan for a batch of queries."""

from __future__ import annotations

import warnings
from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumenframe.functions import numbers
from lumenframe.operators import filters, knn, ranking

SOURCES = ["image", "video", "caption", "speech"]  # ties of scores go to the earlier one
#: What a hit's point may say of it, and its type.
PAYLOAD = {"kind": "string", "timestamp": "double", "shot_start": "double", "shot_end": "double", "tags": "array<string>", "country": "string", "state": "string"}
#: Rows up to which a table of candidates is sent to all tasks, when its bound is known to be no larger.
FEW = 200_000


@dataclass
class Request:
    """What a search asks for. ``people`` raise a score (those named in the query); the other fields filter."""

    people: list[str] = field(default_factory=list)
    only_people: list[str] = field(default_factory=list)
    date_from: str | None = None
    date_to: str | None = None
    places: list[str] = field(default_factory=list)
    tags: list[str] = field(default_factory=list)
    kind: str | None = None
    span: tuple[float, float] | None = None
    shortest: float | None = None
    longest: float | None = None
    retrieve: int = 200
    keep: int = 50
    window: float = 5.0
    model: Callable | None = None
    features: list[str] = field(default_factory=list)


def hit_facts(points: DataFrame) -> DataFrame:
    """Points with the names that hits go by: id is media_id, else id, else point_id; faces, else people; ``PAYLOAD``, null where they lack it.

    A video's timestamp is a place in it, and it has no date; an image's timestamp is its date.
    """
    have = set(points.columns)
    first = lambda *names: F.coalesce(*(F.col(n).cast("string") for n in names if n in have))
    names = [F.col(n) for n in ("faces", "people") if n in have]
    out = points.withColumn("hit_id", first("media_id", "id", "point_id"))
    for name, kind in PAYLOAD.items():
        if name not in have or name == "timestamp":
            continue
        out = out.withColumn(name, F.col(name).cast(kind))
    missing = {n: F.lit(None).cast(k) for n, k in PAYLOAD.items() if n not in have}
    video = F.coalesce(F.col("kind") == "video", F.lit(False)) if "kind" in have else F.lit(False)
    time = F.col("timestamp").cast("string") if "timestamp" in have else F.lit(None).cast("string")
    out = out.withColumns(missing | {"date": F.when(~video, time)})
    return out.withColumns({"timestamp": F.when(video, time.try_cast("double")), "faces": F.coalesce(*names) if names else F.lit(None).cast("array<string>")})


def _bounded(rows: DataFrame, bound: int) -> DataFrame:
    """``rows``, of which there are at most ``bound``, for all tasks if those are few."""
    return F.broadcast(rows) if bound <= FEW else rows


def retrieve(collections: dict[str, DataFrame | Callable[[], DataFrame] | tuple], queries: DataFrame, request: Request) -> tuple[DataFrame, int]:
    """Hits of all collections there are: query_id, id, source, source_order, score, rank and ``PAYLOAD``.

    ``collections``: name -> (id, vector, media_id and what there is of ``PAYLOAD``), or a function
    that opens it, or either with its ``VectorIndex``, which is then searched instead; ``queries``: (id, vector). Tags are asked for in their own case before the search.
    A collection that is missing or can't be opened gives no hits; the latter warns. Also: how many
    rows that are at most.
    """
    asked = list(knn.shipments(queries))
    n = sum(len(ids) for ids, _ in asked)
    hits = None
    for order, name in enumerate(SOURCES):
        if name not in collections:
            continue
        try:
            points, index = collections[name], None
            if isinstance(points, tuple):
                points, index = points
            points = points if isinstance(points, DataFrame) else points()
            if index is not None:
                found = index.search(asked, request.retrieve, request.tags)
            else:
                if request.tags:
                    points = points.where(F.arrays_overlap("tags", F.array(*(F.lit(t) for t in request.tags))))
                found = knn.search(points.select("id", "vector"), asked, request.retrieve)
        except PySparkException as error:
            warnings.warn(f"collection {name} is left out of the search: {error}", stacklevel=2)
            continue
        facts = points.select("id", "media_id", *(F.col(c).cast(k) if c in points.columns else F.lit(None).cast(k).alias(c) for c, k in PAYLOAD.items()))
        named = facts.join(_bounded(found, n * request.retrieve), "id").select("query_id", F.col("media_id").alias("id"), F.lit(name).alias("source"), F.lit(order).alias("source_order"), "score", "rank", *PAYLOAD)
        hits = named if hits is None else hits.unionByName(named)
    return hits, n * request.retrieve * len(collections)


def search(collections: dict, queries: DataFrame, media: DataFrame, faces: DataFrame, people: DataFrame, request: Request, expansion: DataFrame | None = None) -> DataFrame:
    """The ranked media of each query, ``rank`` from 1: scores and their parts, path, place, position, date, tags, people, why.

    ``media``: media_id, path, place, ts_utc, deleted and, where there are, gps_lat, gps_lon; ``faces``: media_id,
    person_id; ``people``: person_id, name; ``expansion``: further candidates (query_id, id, source) of score 0.

    Hits become one candidate a query and medium, with what the catalogue knows of it; deleted media
    go, filters apply, scores rank, the best stay; frames of one video within ``window`` seconds give
    way to the best of them; a model, if there is one, orders the rest. Media, faces and names are
    read for the candidates only.
    """
    hits, bound = retrieve(collections, queries, request)
    merged = ranking.merge(hits, list(PAYLOAD), ["query_id"])
    if expansion is not None:
        bound += expansion.count()
        merged = ranking.append_missing(merged, expansion.select("query_id", "id", F.lit(0.0).alias("score"), "source"), ["query_id", "id"])
    ids = _bounded(merged.select(F.col("id").alias("media_id")).distinct(), bound)
    extra = [c if c in media.columns else F.lit(None).cast("double").alias(c) for c in ("gps_lat", "gps_lon")]
    facts = media.join(ids, "media_id", "left_semi").select(F.col("media_id").alias("id"), "path", "place", F.col("ts_utc").alias("date"), "deleted", *extra)
    named = faces.join(ids, "media_id", "left_semi").join(people.where("name is not null"), "person_id").groupBy(F.col("media_id").alias("id")).agg(F.array_sort(F.collect_set("name")).alias("people"))
    rich = merged.join(_bounded(facts, bound), "id", "left").join(_bounded(named, bound), "id", "left").where("coalesce(deleted, 0) = 0")
    kept = rich.where(
        filters.any_of(F.col("people"), request.only_people)
        & filters.in_place([F.col("place"), F.col("country"), F.col("state")], request.places)
        & filters.any_of(F.col("tags"), request.tags)
        & filters.kind_by_name(F.col("path"), request.kind)
        & filters.within_dates(F.col("date"), request.date_from, request.date_to)
        & filters.video_only(F.col("kind"), F.col("timestamp"), F.col("shot_start"), F.col("shot_end"), request.span, request.shortest, request.longest)
    )
    top = ranking.ranked(kept, request.people, request.keep, partition=["query_id"])
    # frames of a video cluster; any other candidate is alone
    alone = F.when(F.col("kind") == "video", F.coalesce("path", F.lit(""))).otherwise(F.concat(F.lit("="), F.col("id").cast("string")))
    shown = ["source", "parts", "path", "place", "date", "kind", "timestamp", "gps_lat", "gps_lon", "tags", "people"]
    frames = top.select("query_id", alone.alias("__path"), F.coalesce("timestamp", F.lit(0.0)).alias("timestamp"), F.col("total_score").alias("score"), "id", F.struct(*shown).alias("shown"))
    best = ranking.cluster_bounded(frames, request.window, ["query_id", "__path"], ["shown"])
    order = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    result = best.withColumn("rank", order).select("query_id", "rank", "id", F.col("score").alias("total_score"), *(F.col("shown")[c].alias(c) for c in shown))
    why = F.concat(F.lit("similarity "), numbers.fixed(F.col("parts.similarity_score"), 3))
    result = result.select("query_id", "rank", "id", "source", F.col("parts.similarity_score").alias("score"), "total_score", *(F.col("parts")[p].alias(p) for p in ranking.PARTS if p != "total_score"), "path", "place", "gps_lat", "gps_lon", "date", "kind", "timestamp", F.coalesce("tags", F.array().cast("array<string>")).alias("tags"), F.coalesce("people", F.array().cast("array<string>")).alias("people"), why.alias("why"))
    if request.model is None:
        return result.withColumns({"heuristic_score": F.col("total_score"), "model_score": F.lit(None).cast("double")})
    return ranking.learned_rerank(result, request.model, request.features)


def backfilled(results: DataFrame, media: DataFrame, n_results: int) -> DataFrame:
    """Results with the catalogue's position, place and date where they have none; at most ``n_results`` rows."""
    known = media.join(_bounded(results.select(F.col("id").alias("media_id")).distinct(), n_results), "media_id", "left_semi")
    fill = {"gps_lat": "gps_lat", "gps_lon": "gps_lon", "place": "place", "date": "ts_utc"}
    own = known.select(F.col("media_id").alias("id"), F.struct(*(F.col(c).alias(k) for k, c in fill.items() if c in media.columns)).alias("__own"))
    joined = results.join(_bounded(own, n_results), "id", "left")
    blank = lambda c: F.nullif(F.col(c), F.lit("")) if c in ("place", "date") else F.col(c)
    return joined.withColumns({k: F.coalesce(blank(k), F.col("__own")[k]) for k, c in fill.items() if c in media.columns and k in results.columns}).drop("__own")


def with_defaults(given: Request | None, **inferred) -> Request:
    """The caller's request, with what the text says where the caller said nothing."""
    given = given or Request()
    return replace(given, **{k: getattr(given, k) or v for k, v in inferred.items()})
