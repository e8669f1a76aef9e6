"""Changes to keyed tables, as new DataFrames: upserts, replacements, cascades, labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenframe.operators import running


def upsert(table: DataFrame, rows: DataFrame, keys: list[str], update: list[str] | None = None) -> DataFrame:
    """``table`` with ``rows`` inserted by ``keys``, or their ``update`` columns (default: all they have) taken over.

    Columns that ``rows`` lacks keep their value, or are null in a new row. One row a key in ``rows``.
    """
    given = [c for c in rows.columns if c not in keys]
    changed = given if update is None else update
    new = rows.select(*keys, F.struct(*given, F.lit(True).alias("__there")).alias("__new"))
    joined = table.withColumn("__old", F.lit(True)).join(new, keys, "full")
    known, there = F.col("__old").isNotNull(), F.col("__new").isNotNull()

    def value(c: str) -> Column:
        if c not in given:
            return F.col(c)
        take = there if c in changed else there & ~known
        return F.when(take, F.col(f"__new.{c}")).otherwise(F.col(c)).alias(c)

    return joined.select(*(c if c in keys else value(c) for c in table.columns))


def update_fields(table: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """``rows``' other columns taken over where the key is known; unknown keys are ignored."""
    return upsert(table, rows.join(table.select(*keys), keys, "left_semi"), keys)


def replace_groups(table: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """All rows of the groups that ``rows`` names give way to those of ``rows``."""
    return table.join(rows.select(*keys).distinct(), keys, "left_anti").unionByName(rows)


def delete(table: DataFrame, keys: DataFrame) -> DataFrame:
    return table.join(keys, keys.columns, "left_anti")


def cascade(tables: dict[str, DataFrame], gone: DataFrame, key: str) -> dict[str, DataFrame]:
    """Rows that hang on deleted keys go from every table."""
    return {name: delete(t, gone.select(key).distinct()) for name, t in tables.items()}


def add_tags(tags: DataFrame, bridge: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Tag names and (media_id, name) pairs with ``new`` pairs added, none twice."""
    names = tags.unionByName(new.select("name").distinct().join(tags, "name", "left_anti"))
    pairs = bridge.unionByName(new.select("media_id", "name")).distinct()
    return names, pairs


def label_faces(faces: DataFrame, labels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Faces with person_id taken over from ``labels`` (face_id, person_id; null clears), and those that changed."""
    named = labels.groupBy("face_id").agg(F.max(F.struct("person_id")).alias("l"))
    joined = faces.join(named, "face_id", "left")
    differs = F.col("l").isNotNull() & ~F.col("l.person_id").eqNullSafe(F.col("person_id"))
    changed = joined.where(differs).select("face_id", F.col("l.person_id").alias("person_id"))
    return joined.withColumn("person_id", F.when(F.col("l").isNotNull(), F.col("l.person_id")).otherwise(F.col("person_id"))).select(*faces.columns), changed


def create_people(people: DataFrame, new: DataFrame) -> DataFrame:
    """``people`` and those of ``new`` (person_id, name) whose name is free; of equal new names the lowest id's."""
    first = new.where(F.trim("name") != "").groupBy("name").agg(F.min("person_id").alias("person_id"))
    return people.unionByName(first.join(people.select("name"), "name", "left_anti").select(*people.columns))


def rename_person(people: DataFrame, person_id, name: str) -> DataFrame:
    """The new name, unless somebody else has it."""
    if not people.where((F.col("name") == name) & (F.col("person_id") != person_id)).isEmpty():
        raise ValueError(f"somebody else is called {name}")
    return people.withColumn("name", F.when(F.col("person_id") == person_id, F.lit(name)).otherwise(F.col("name")))


def merge_people(people: DataFrame, faces: DataFrame, source, target) -> tuple[DataFrame, DataFrame]:
    """``source``'s faces go to ``target``, and ``source`` goes."""
    if source == target:
        raise ValueError("a person can't be merged with itself")
    moved = faces.withColumn("person_id", F.when(F.col("person_id") == source, F.lit(target)).otherwise(F.col("person_id")))
    return people.where(F.col("person_id") != source), moved


def patch_payload(points: DataFrame, patch: DataFrame, key: str = "point_id") -> DataFrame:
    """Points whose ``payload`` struct takes over the fields of ``patch`` (key and fields)."""
    fields = [c for c in patch.columns if c != key]
    joined = points.join(patch.select(key, F.struct(*fields).alias("__patch")), key, "left")
    payload = F.col("payload")
    for f in fields:
        payload = payload.withField(f, F.when(F.col("__patch").isNotNull(), F.col(f"__patch.{f}")).otherwise(F.col(f"payload.{f}")))
    return joined.withColumn("payload", payload).drop("__patch")


def ledger_positions(results: DataFrame) -> DataFrame:
    """Impressions: results (search_id, media_id, score) with their 0-based position."""
    ordered = running.running(results.withColumn("__falling", F.coalesce(-F.col("score").cast("double"), F.lit(float("inf")))), ["search_id"], ["__falling", "media_id"], {"__n": F.lit(1)})
    return ordered.withColumn("position", (F.col("__n") - 1).cast("long")).drop("__n", "__falling")


def opened(impressions: DataFrame, opens: DataFrame) -> DataFrame:
    """Impressions with whether, and first when, they were opened."""
    first = opens.groupBy("search_id", "media_id").agg(F.min("opened_at").alias("opened_at"))
    return impressions.join(first, ["search_id", "media_id"], "left").withColumn("was_opened", F.col("opened_at").isNotNull().cast("int"))
