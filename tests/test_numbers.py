"""Doubles rounded and written as DuckDB and Python have them, alone and in a search."""

import math
import os
import random
import shutil

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from lumenframe.functions import numbers
from lumenframe.plans.queries import QUERIES, SQL

SF_DIR = "/root/testdata/sf0.001"
#: Ties of the third digit that lie below or above their decimal or on it, and scores whose 1.25-fold or quarter is close to a tie of the sixth.
TIES = [0.3685, 0.3565, 0.4325, 0.0005, 0.0015, 0.0625, 0.1875, 0.382426, 0.406706, 0.32259, 0.419382, 0.523878]


def beside(x: float) -> list[float]:
    return [x, math.nextafter(x, 0), math.nextafter(x, 9), -x]


def test_rounded_and_fixed(spark):
    some = random.Random(0)
    xs = [y for x in TIES + [(k + 0.5) / 1000 for k in range(1000)] for y in beside(x)] + [some.uniform(-2, 2) for _ in range(1000)] + [0.0, -0.0, 0.9995, 999999.9995, 12345678.0625, 1e-300]
    rows = spark.createDataFrame([(x,) for x in xs], "x double").select("x", numbers.fixed(F.col("x"), 3).alias("three"), numbers.fixed(F.col("x"), 6).alias("six"), *(numbers.rounded(F.col("x") * m, 6).alias(f"r{n}") for n, m in enumerate((1.25, 1.5, 0.25)))).toPandas()
    duck = duckdb.connect()
    duck.register("rows", rows)
    assert rows["three"].tolist() == [f"{x:.3f}" for x in xs] and rows["six"].tolist() == [f"{x:.6f}" for x in xs]
    assert duck.sql("SELECT count(*) FROM rows WHERE three <> printf('%.3f', x) OR r0 <> round(x * 1.25, 6) OR r1 <> round(x * 1.5, 6) OR r2 <> round(x * 0.25, 6)").fetchall() == [(0,)]
    odd = spark.range(1).select(*(numbers.fixed(F.lit(x).cast("double"), 3).alias(n) for n, x in (("none", None), ("nan", math.nan), ("large", 1e12)))).first()
    assert tuple(odd) == (None, "NaN", "1000000000000.000")


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="the driver's tables")
def test_search_equals_its_sql_on_ties_of_digits(spark, tmp_path):
    """Vectors whose similarity to every query is one of ``TIES``, eight to a medium of another score."""
    for name in "nation region customer supplier part orders lineitem".split():
        shutil.copy(f"{SF_DIR}/{name}.parquet", tmp_path)
    scores = [1.0 if k % 20 == 0 else TIES[k // 8 % len(TIES)] for k in range(800)]
    vectors = [[s, math.sqrt(1 - s * s)] for s in scores]
    pq.write_table(pa.table({"vec_id": pa.array(range(800), pa.int64()), "embedding": pa.array(vectors, pa.list_(pa.float64())), "label": pa.array([k % 10 for k in range(800)], pa.int32())}), tmp_path / "embeddings.parquet")
    duck = duckdb.connect()
    for path in tmp_path.iterdir():
        duck.sql(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{path}')")
    for name in ("search_end_to_end", "search_one"):
        ours = QUERIES[name](spark, str(tmp_path)).toPandas()
        theirs = duck.sql(SQL[name]).df()[list(ours.columns)]
        rows = lambda frame: sorted((tuple(None if x != x else x for x in row) for row in frame.astype(object).itertuples(index=False)), key=str)
        assert len(ours) and rows(ours) == rows(theirs)
