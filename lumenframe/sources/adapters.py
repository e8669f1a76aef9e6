"""The catalogue's roles over the driver's star-schema tables.

Each adapter gives a role's DataFrame; ``SQL`` has the same as DuckDB common table expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ISO = "yyyy-MM-dd'T'HH:mm:ss"


class Catalogue:
    """Tables of one folder, in their roles."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir, self._schemas = spark, sf_dir, {}

    def table(self, name: str) -> DataFrame:
        """A table, whose file footers are read for its schema once."""
        path = f"{self.sf_dir}/{name}.parquet"
        if name not in self._schemas:
            self._schemas[name] = self.spark.read.parquet(path).schema
        return self.spark.read.schema(self._schemas[name]).parquet(path)

    def media(self) -> DataFrame:
        places = self.table("customer").join(self.table("nation").join(self.table("region"), F.col("n_regionkey") == F.col("r_regionkey")), F.col("c_nationkey") == F.col("n_nationkey"))
        places = places.select("c_custkey", F.concat_ws(", ", "n_name", "r_name").alias("place"))
        video = F.col("o_orderstatus") == "O"
        media = self.table("orders").select(
            F.col("o_orderkey").alias("media_id"),
            F.concat(F.lit("/"), "o_orderpriority", F.lit("/"), F.col("o_orderkey").cast("string"), F.when(video, ".mp4").otherwise(".jpg")).alias("path"),
            F.col("o_orderpriority").alias("source_name"),
            F.when(video, "video/mp4").otherwise("image/jpeg").alias("mime"),
            F.date_format("o_orderdate", ISO).alias("ts_utc"),
            F.when(video, F.col("o_totalprice") / 100).alias("duration"),
            (F.col("o_totalprice") * 1000).cast("long").alias("size_bytes"),
            (F.col("o_orderstatus") == "P").cast("int").alias("deleted"),
            (F.col("o_orderkey") % 50).alias("updated_seq"),
            "o_custkey",
        )
        return media.join(places, media["o_custkey"] == places["c_custkey"], "left").drop("o_custkey", "c_custkey")

    def faces(self) -> DataFrame:
        return self.table("lineitem").select(
            F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("face_id"),
            F.col("l_orderkey").alias("media_id"),
            F.col("l_extendedprice").alias("confidence"),
            F.when(F.col("l_returnflag") != "R", F.col("l_suppkey")).alias("person_id"),
        )

    def people(self) -> DataFrame:
        return self.table("supplier").select(F.col("s_suppkey").alias("person_id"), F.col("s_name").alias("name"))

    def media_tags(self) -> DataFrame:
        return self.table("lineitem").join(self.table("part"), F.col("l_partkey") == F.col("p_partkey")).select(F.col("l_orderkey").alias("media_id"), F.col("p_type").alias("tag")).distinct()

    def vectors(self) -> DataFrame:
        """Every vector as a face: person_id is its label, null for label 0."""
        return self.table("embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), F.when(F.col("label") != 0, F.col("label")).cast("long").alias("person_id"))

    def frames(self) -> DataFrame:
        """Frames of videos: the events of each user."""
        return self.table("events").select(F.col("event_id").alias("id"), F.col("user_id").alias("path"), seconds("ts").alias("timestamp"), F.col("value").alias("score"), "event_type", "props")

    def files(self) -> DataFrame:
        text = F.coalesce("text", F.lit(""))
        return self.table("documents").select(F.col("source").alias("source_name"), F.concat_ws("/", "source", "doc_id").alias("rel_path"), F.col("n_chars").alias("size_bytes"), F.sha2(text, 256).alias("media_id"), "doc_id")


def seconds(ts: str) -> Column:
    """Seconds since 2024-01-01 of a timestamp without time zone, in any session zone."""
    return F.expr(f"CAST(timestampdiff(MICROSECOND, TIMESTAMP_NTZ'2024-01-01 00:00:00', {ts}) AS DOUBLE) / 1000000.0")


SQL = {
    "media": """media AS (
        SELECT o_orderkey AS media_id, '/' || o_orderpriority || '/' || o_orderkey || CASE WHEN o_orderstatus = 'O' THEN '.mp4' ELSE '.jpg' END AS path,
            o_orderpriority AS source_name, CASE WHEN o_orderstatus = 'O' THEN 'video/mp4' ELSE 'image/jpeg' END AS mime,
            strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') AS ts_utc, CASE WHEN o_orderstatus = 'O' THEN o_totalprice / 100 END AS duration,
            CAST(trunc(o_totalprice * 1000) AS BIGINT) AS size_bytes, CASE WHEN o_orderstatus = 'P' THEN 1 ELSE 0 END AS deleted, o_orderkey % 50 AS updated_seq,
            n_name || ', ' || r_name AS place
        FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey)""",
    "faces": """faces AS (
        SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS face_id, l_orderkey AS media_id, l_extendedprice AS confidence,
            CASE WHEN l_returnflag <> 'R' THEN l_suppkey END AS person_id FROM lineitem)""",
    "people": "people AS (SELECT s_suppkey AS person_id, s_name AS name FROM supplier)",
    "media_tags": "media_tags AS (SELECT DISTINCT l_orderkey AS media_id, p_type AS tag FROM lineitem JOIN part ON l_partkey = p_partkey)",
    "vectors": "vectors AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS vector, CASE WHEN label <> 0 THEN CAST(label AS BIGINT) END AS person_id FROM embeddings)",
    "frames": "frames AS (SELECT event_id AS id, user_id AS path, epoch_us(ts) / 1000000.0 - 1704067200.0 AS timestamp, value AS score, event_type, props FROM events)",
    "files": "files AS (SELECT source AS source_name, source || '/' || doc_id AS rel_path, n_chars AS size_bytes, sha256(coalesce(text, '')) AS media_id, doc_id FROM documents)",
}


def with_roles(*roles: str) -> str:
    """WITH and the common table expressions of some roles."""
    return "WITH " + ",\n".join(SQL[r] for r in roles)
