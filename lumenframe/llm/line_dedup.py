"""Repeated runs of lines, found by winnowing over line hashes; DataFrame functions only.

A window is a run of consecutive lines of at least ``min_words`` words, as short as that allows from
where it starts, or back from where it ends; lines without words belong to no window. Winnowing
selects the lowest line hash of each window as its fingerprint, so two texts that share a run of
``min_words`` words in whole lines share a fingerprint, and only the positions of selected lines, most
of which occur once, are counted over the corpus. The positions of a fingerprint that occurs again are
joined by what stands around them, the windows that selected them (128 bits of their lines' hashes):
a fingerprint's positions may be of several passages, so comparing each with the first only would lose
runs, and with all others grows with the square. Matches extend both ways: a line of a repeated run
lies in a window of one of the two kinds inside the run, and equal contents have equal windows, so the
windows that stood before, by (doc_id, line), cover each repeated run up to both of its ends. The
lines of all but the first occurrence are deleted.

Stored is a row for each selected line, with the windows that selected it. A large group of copies of a
passage costs a row per window and copy: each is compared with the first only, and the joins' right
sides are stored, so that Spark can split a large key. The fingerprints that repeat are broadcast while
they are few (``components.FEW``), else joined by shuffle; texts are shuffled once. Occurrences may
overlap. Null texts stay null, texts without a long enough run stay as they are, and a text may become
empty, but no row goes; an empty table stays empty. Rows without a doc_id come last in the order. Rows
with equal doc_id and text are one document and get the same result. ``n_chars``, where there is one,
follows the new text; all other columns stay, whatever they are named. A very long text is one row, and
its lines are one window's partition, which Spark spills.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from lumenframe.llm import storage
from lumenframe.llm.components import small

MIN_WORDS = 50
WORD = r"[^\x20\x09-\x0D]+"


def _keyed(docs: DataFrame) -> DataFrame:
    last = F.lit(9223372036854775807)
    return docs.withColumns({"__lf_id": F.coalesce(F.col("doc_id").cast("long"), last), "__lf_text": F.xxhash64("text")})


def windows(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """A row per complete window: id, text_hash, first and last line, fingerprint and its line, content (two hashes)."""
    lines = _keyed(docs.select("doc_id", "text")).select("__lf_id", "__lf_text", F.posexplode(F.split("text", "\n", -1)).alias("line", "words"))
    # lines of repeated rows fall together here, where the windows need them
    coded = lines.select("__lf_id", "__lf_text", "line", F.xxhash64("words").alias("h"), F.xxhash64(F.lit(1), "words").alias("g"), F.regexp_count("words", F.lit(WORD)).cast("long").alias("n"))
    coded = coded.where("n > 0").repartition("__lf_id", "__lf_text").groupBy("__lf_id", "__lf_text", "line").agg(F.first("h").alias("h"), F.first("g").alias("g"), F.first("n").alias("n"))
    own = Window.partitionBy("__lf_id", "__lf_text")
    placed = coded.withColumn("before", F.sum("n").over(own.orderBy("line").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n"))
    ahead = own.orderBy("before").rangeBetween(0, min_words - 1)
    line = F.col("line")

    def over(span: WindowSpec, first: Column, last: Column) -> list[Column]:
        low = F.min(F.struct("h", "line")).over(span)
        codes = [F.xxhash64(F.collect_list(c).over(span)).alias(w) for c, w in (("h", "w1"), ("g", "w2"))]
        return [first.alias("first"), last.alias("last"), F.sum("n").over(span).alias("words"), low.alias("low"), *codes]

    behind = own.orderBy("upto").rangeBetween(1 - min_words, 0)
    both = placed.withColumn("upto", F.col("before") + F.col("n")).select("__lf_id", "__lf_text", "n", F.struct(*over(ahead, line, F.max("line").over(ahead))).alias("fore"), F.struct(*over(behind, F.min("line").over(behind), line)).alias("back"))
    # a window back that has enough words without its last line is the window of its first line
    other = F.when(F.col("back.words") - F.col("n") >= min_words, F.col("back"))
    found = both.select("__lf_id", "__lf_text", F.explode(F.array("fore", other)).alias("w")).where("w is not null").select("__lf_id", "__lf_text", "w.*")
    return found.where(F.col("words") >= min_words).select("__lf_id", "__lf_text", "first", "last", F.col("low.h").alias("fingerprint"), F.col("low.line").alias("at"), "w1", "w2")


def positions(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """A row per selected line: id, text_hash, fingerprint, its line (at), and the windows that selected it."""
    window = F.struct("first", "last", "w1", "w2")
    return windows(docs, min_words).groupBy("__lf_id", "__lf_text", "fingerprint", "at").agg(F.collect_list(window).alias("windows"))


def repeated_runs(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(__lf_id, __lf_text, __lf_runs): the line ranges of each document that repeat an earlier run; disjoint, in order."""
    every = storage.written(positions(docs, min_words))
    place = F.struct("__lf_id", "__lf_text", "at")
    again = storage.cut(every.groupBy("fingerprint").agg(F.min(place).alias("a"), F.max(place).alias("b")).where("a != b").select("fingerprint"))
    near = every.join(small(again), "fingerprint", "left_semi").select("__lf_id", "__lf_text", F.explode("windows").alias("w")).select("__lf_id", "__lf_text", "w.*")
    spot = F.struct("__lf_id", "__lf_text", "first")
    firsts = near.groupBy("w1", "w2").agg(F.min(spot).alias("a"), F.max(spot).alias("b")).where("a != b").select("w1", "w2", "a")
    later = near.join(storage.cut(firsts), ["w1", "w2"]).where(spot != F.col("a"))
    own = Window.partitionBy("__lf_id", "__lf_text").orderBy("first")
    reach = F.max("last").over(own.rowsBetween(Window.unboundedPreceding, -1))
    marked = later.select("__lf_id", "__lf_text", "first", "last", F.coalesce((F.col("first") > reach).cast("int"), F.lit(0)).alias("opens"))
    runs = marked.withColumn("run", F.sum("opens").over(own)).groupBy("__lf_id", "__lf_text", "run").agg(F.min("first").alias("first"), F.max("last").alias("last"))
    return runs.groupBy("__lf_id", "__lf_text").agg(F.array_sort(F.collect_list(F.struct("first", "last"))).alias("__lf_runs"))


def remove_repeated(docs: DataFrame, min_words: int = MIN_WORDS, count_column: str | None = None) -> DataFrame:
    """``docs`` with repeated runs deleted from ``text``; ``count_column``: also say how many lines went."""
    runs = storage.cut(repeated_runs(docs, min_words))
    packed = _keyed(docs.select("doc_id", "text", F.struct(*(F.col(storage.quoted(c)) for c in docs.columns if c != "text")).alias("__lf_row")))
    joined = packed.drop("doc_id").join(runs, ["__lf_id", "__lf_text"], "left")
    none = F.col("__lf_runs").isNull()
    kept = F.expr("array_join(filter(split(text, '\\n', -1), (x, i) -> NOT exists(__lf_runs, r -> i BETWEEN r.first AND r.last)), '\\n')")
    columns = {c: F.col("__lf_row")[c] for c in docs.columns if c != "text"} | {"text": F.when(none, F.col("text")).otherwise(kept)}
    if "n_chars" in columns:
        columns["n_chars"] = F.when(none, columns["n_chars"]).otherwise(F.length(columns["text"])).cast(docs.schema["n_chars"].dataType)
    went = F.coalesce(F.aggregate("__lf_runs", F.lit(0).cast("long"), lambda s, r: s + r["last"] - r["first"] + 1), F.lit(0))
    return joined.select(*(columns[c].alias(c) for c in docs.columns), *([went.alias(count_column)] if count_column else []))


def sql(min_words: int = MIN_WORDS) -> str:
    """The same result by comparing all windows as texts; one row a doc_id."""
    return SQL.replace("50", str(min_words)).replace("49", str(min_words - 1))


SQL = r"""
WITH lines AS (
    SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents
), worded AS (
    SELECT *, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS n FROM lines
), placed AS (
    SELECT *, sum(n) OVER (PARTITION BY doc_id ORDER BY pos) - n AS before FROM worded WHERE n > 0
), fore AS (
    SELECT doc_id, pos AS a, max(pos) OVER w AS b, sum(n) OVER w AS words, list(line) OVER w AS content FROM placed
    WINDOW w AS (PARTITION BY doc_id ORDER BY before RANGE BETWEEN CURRENT ROW AND 49 FOLLOWING)
), back AS (
    SELECT doc_id, min(pos) OVER w AS a, pos AS b, sum(n) OVER w AS words, list(line) OVER w AS content FROM (SELECT *, before + n AS upto FROM placed)
    WINDOW w AS (PARTITION BY doc_id ORDER BY upto RANGE BETWEEN 49 PRECEDING AND CURRENT ROW)
), runs AS (
    SELECT * FROM fore WHERE words >= 50 UNION SELECT * FROM back WHERE words >= 50
), later AS (
    SELECT doc_id, a, b FROM (SELECT *, row_number() OVER (PARTITION BY content ORDER BY doc_id, a) AS k FROM runs) WHERE k > 1
), gone AS (
    SELECT DISTINCT doc_id, unnest(generate_series(a, b)) AS pos FROM later
), new AS (
    SELECT l.doc_id, string_agg(l.line, chr(10) ORDER BY l.pos) AS text FROM lines l LEFT JOIN gone g ON l.doc_id = g.doc_id AND l.pos = g.pos WHERE g.pos IS NULL GROUP BY l.doc_id
), went AS (
    SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id
)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(new.text, '') END AS text, coalesce(went.n, 0) AS n_lines_removed
FROM documents d LEFT JOIN new ON d.doc_id = new.doc_id LEFT JOIN went ON d.doc_id = went.doc_id
"""
