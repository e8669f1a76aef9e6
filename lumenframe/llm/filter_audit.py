"""What each quality filter removes, alone, after others, and on average over all orders of the filters.

Every document gets five failure flags (``CONDITIONS`` and E, a text that a smaller doc_id has too). The
documents are counted by part and flags first, so what follows is at most 32 rows a part. An SQL CUBE
over the five flags and the part then sums those counts over every selection of flags: the rows whose
selected flags are all false hold the survivors of that subset of filters. Each step of an order is a
pair of subsets, before it and after it, and a join of the pairs gives what the step removes.

Two texts are the same if their SHA-256 is. The class of equal texts is found by an aggregation, and its
first document by a join on class and id, so a text that a third of all rows share puts no more into one
task than any other. Nothing is broadcast but the 600 steps and 80 pairs.

Null texts count as empty and a null part as the empty string. A null doc_id comes after all others and
has no label. Rows that repeat a doc_id are documents of their own; of equal texts under the smallest id
none fails E. Of several labels of one doc_id the highest counts. Further columns are ignored. An empty
table gives no rows; a text of any length is one row of its task.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenframe.llm import storage

SPACE = r"[\x20\x09-\x0D]+"
#: Failure of a filter, over n_words, n_distinct, n_upper, n_chars and symbols.
CONDITIONS = {"A": "n_words < 50", "B": "100 * n_distinct < 65 * n_words", "C": "100 * n_upper > 5 * n_chars", "D": "symbols"}
#: The filters by letter; a subset of them has the bit ``1 << k`` for the k-th.
FILTERS = "ABCDE"
NONE, ALL = 0, (1 << len(FILTERS)) - 1
LAST = 9223372036854775807


def flagged(docs: DataFrame, part: str = "source") -> DataFrame:
    """(doc_id, part, A to E) of every row of ``docs``; texts are read once and go no further."""
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("doc_id"), F.coalesce(F.col(f"`{part}`").cast("string"), F.lit("")).alias("part"), F.coalesce("text", F.lit("")).alias("text"))
    split = rows.withColumn("words", F.array_remove(F.split("text", SPACE, -1), ""))
    counts = [F.size("words").cast("long").alias("n_words"), F.size(F.array_distinct("words")).cast("long").alias("n_distinct"), F.regexp_count("text", F.lit("[A-Z]")).cast("long").alias("n_upper"), F.length("text").cast("long").alias("n_chars"), F.col("text").rlike("[#$%&*|]").alias("symbols")]
    measured = split.select("doc_id", "part", F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("class"), *counts)
    plain = storage.written(measured.select("doc_id", "part", "class", *(F.expr(c).alias(letter) for letter, c in CONDITIONS.items())))
    first = plain.groupBy("class").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
    return plain.join(first, ["class", "doc_id"], "left").select("doc_id", "part", *CONDITIONS, F.col("first").isNull().alias("E"))


def survivors(flags: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, subset, docs, good, toxic): the documents that pass all filters of a subset; zeros included."""
    known = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.coalesce(F.max("quality") == 1, F.lit(False)).cast("long").alias("good"), F.coalesce(F.max("toxic") == 1, F.lit(False)).cast("long").alias("toxic"))
    cells = flags.join(known, "doc_id", "left").groupBy("part", *FILTERS).agg(F.count("*").alias("docs"), F.coalesce(F.sum("good"), F.lit(0)).alias("good"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("toxic"))
    sums = [F.sum(c).alias(c) for c in ("docs", "good", "toxic")]
    selected = [(F.lit(1) - F.grouping(f).cast("int")) * (1 << k) for k, f in enumerate(FILTERS)]
    cube = cells.cube(*FILTERS, "part").agg(*sums, F.grouping("part").alias("all_parts"), sum(selected, F.lit(NONE)).alias("subset"))
    passed = cube.where(F.expr("all_parts = 0 AND " + " AND ".join(f"coalesce({f}, false) = false" for f in FILTERS))).select("part", "subset", "docs", "good", "toxic")
    passed = storage.cut(passed)
    every = passed.where(F.col("subset") == NONE).select("part", F.explode(F.sequence(F.lit(NONE), F.lit(ALL))).alias("subset"))
    return every.join(passed, ["part", "subset"], "left").select("part", "subset", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("docs", "good", "toxic")))


def audit(docs: DataFrame, labels: DataFrame, part: str = "source") -> DataFrame:
    """A row per part, order of the five filters and step.

    kept, removed: documents left after the step and taken by it. redundant: fail its filter, but went
    before. unique_fails: fail its filter only. good_lost, toxic_lost: removed here with quality or toxic
    1. shapley: what its filter removes, summed over all orders.
    """
    spark = docs.sparkSession
    by_subset = storage.cut(survivors(flagged(docs, part), labels))
    n = len(FILTERS)
    pairs = [(before, f, before | 1 << k, factorial(before.bit_count()) * factorial(n - 1 - before.bit_count())) for before in range(ALL + 1) for k, f in enumerate(FILTERS) if not before >> k & 1]
    steps, bit = [], {f: 1 << k for k, f in enumerate(FILTERS)}
    for order in map("".join, permutations(FILTERS)):
        steps += [(order, i + 1, f, sum(bit[x] for x in order[:i])) for i, f in enumerate(order)]
    pairs = F.broadcast(spark.createDataFrame(pairs, "before int, filter string, after int, orders long"))
    steps = F.broadcast(spark.createDataFrame(steps, "filter_order string, step int, filter string, before int"))

    def named(side: str) -> DataFrame:
        return by_subset.select("part", F.col("subset").alias(side), *(F.col(c).alias(f"{c}_{side}") for c in ("docs", "good", "toxic")))

    gone = named("before").join(pairs, "before").join(named("after"), ["part", "after"])
    lost = gone.select("part", "filter", "before", "orders", F.col("docs_after").alias("kept"), *((F.col(f"{c}_before") - F.col(f"{c}_after")).alias(name) for c, name in (("docs", "removed"), ("good", "good_lost"), ("toxic", "toxic_lost"))))
    lost = storage.cut(lost)
    own = sum((F.when(F.col("filter") == f, ALL & ~bit[f]).otherwise(0) for f in FILTERS), F.lit(0))
    of_filter = lost.groupBy("part", "filter").agg(F.sum(F.col("orders") * F.col("removed")).alias("shapley"), F.max(F.when(F.col("before") == NONE, F.col("removed"))).alias("fails"), F.max(F.when(F.col("before") == own, F.col("removed"))).alias("unique_fails"))
    found = lost.join(of_filter, ["part", "filter"]).join(steps, ["filter", "before"])
    return found.select("part", "filter_order", "step", "kept", "removed", (F.col("fails") - F.col("removed")).alias("redundant"), "unique_fails", "good_lost", "toxic_lost", "shapley")


#: Each order applied to each document; the first filter that it fails removes it.
SQL = r"""
WITH marked AS (
    SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), known AS (
    SELECT doc_id, max(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY doc_id
), flags AS (
    SELECT part, CASE WHEN k.quality = 1 THEN 1 ELSE 0 END AS good, CASE WHEN k.toxic = 1 THEN 1 ELSE 0 END AS bad, [len(w) < 50, 100 * len(list_distinct(w)) < 65 * len(w), 100 * len(regexp_extract_all(t, '[A-Z]')) > 5 * length(t),
        regexp_matches(t, '[#$%&*|]'), min(m.doc_id) OVER (PARTITION BY t) < m.doc_id] AS fails
    FROM marked m LEFT JOIN known k ON k.doc_id = m.doc_id
), kinds AS (
    SELECT part, fails, count(*) AS n, sum(good) AS good, sum(bad) AS bad FROM flags GROUP BY ALL
), letters AS (
    SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f
), orders AS (
    SELECT a.f || b.f || c.f || d.f || e.f AS filter_order FROM letters a, letters b, letters c, letters d, letters e
    WHERE len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5
), steps AS (
    SELECT filter_order, step, filter_order[step] AS f, strpos('ABCDE', filter_order[step]) AS k FROM orders, (SELECT unnest(range(1, 6)) AS step)
), ends AS (
    SELECT kinds.*, filter_order, coalesce(list_min([strpos(filter_order, substr('ABCDE', i, 1)) FOR i IN range(1, 6) IF fails[i]]), 9) AS goes FROM kinds, orders
), counted AS (
    SELECT part, filter_order, step, f, sum(CASE WHEN goes > step THEN n ELSE 0 END) AS kept, sum(CASE WHEN goes = step THEN n ELSE 0 END) AS removed, sum(CASE WHEN fails[k] AND goes < step THEN n ELSE 0 END) AS redundant,
        sum(CASE WHEN fails[k] AND len(list_filter(fails, lambda x: x)) = 1 THEN n ELSE 0 END) AS unique_fails, sum(CASE WHEN goes = step THEN good ELSE 0 END) AS good_lost, sum(CASE WHEN goes = step THEN bad ELSE 0 END) AS toxic_lost
    FROM ends JOIN steps USING (filter_order) GROUP BY part, filter_order, step, f
)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
    CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, f) AS BIGINT) AS shapley FROM counted
"""
