"""Columns of any name through every operator that keeps them, many labels, and partitions by measured sizes."""

import pytest
from pyspark.sql import functions as F

from lumenframe.llm import decontamination, language_id, line_dedup, near_copies, packing, quality_rules, simhash, storage, url_filter

ODD = ["a.b", "__lf_host", "__lf_url", "__lf_row", "__lf_id", "n_words", "kept", "q`x", "host_rate", "spans", "key", "value"]


def texts(n=30):
    return [" ".join(f"w{(i * 7 + j) % 200}" for j in range(60)) + ("\n" + "same line of words " * 20 if i % 3 else "") for i in range(n)]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, f"s{i % 3}", *[f"{c}{i}" for c in ODD]) for i, t in enumerate(texts())]
    return spark.createDataFrame(rows, ["doc_id", "text", "source", *ODD])


def stays(got, docs):
    assert got.columns == docs.columns
    mine = [storage.quoted(c) for c in docs.columns if c not in ("text",)]
    assert got.select(*mine).subtract(docs.select(*mine)).count() == 0


def test_names_stay(spark, docs):
    stays(quality_rules.kept_rows(docs), docs)
    stays(line_dedup.remove_repeated(docs), docs)
    stays(simhash.keep_first(docs), docs)
    stays(simhash.keep_first(docs.unionByName(docs), near_copies.near_copies(docs)), docs)
    items = spark.createDataFrame([(1, texts()[0][:200])], "item_id long, text string")
    clean = decontamination.remove_contaminated(docs, items)
    stays(clean, docs)
    assert clean.count() < docs.count()
    assert packing.pack(docs).count() > 0


def test_judged_columns_go_before_own(docs):
    judged = quality_rules.judge(docs)
    assert len(judged.columns) == len(set(judged.columns))
    assert dict(judged.dtypes)["n_words"] == "bigint" and dict(judged.dtypes)["a.b"] == "string"
    assert judged.count() == docs.count()
    by = quality_rules.judge(docs, host="a.b", with_text=False)
    assert "a.b" in by.columns and by.where("kept").count() >= 0


def test_pages_with_odd_names(spark):
    pages = spark.createDataFrame([(1, "http://a.net/x", "", "u", "v", "w"), (2, "http://b.org/", "", "u", "v", "w")], ["page_id", "url", "html", "__lf_url", "a.b", "rule"])
    got = url_filter.judge(pages, redirects=spark.createDataFrame([("http://b.org/", "http://a.net/x")], "url string, target string"))
    assert {r["page_id"]: (r["verdict"], r["__lf_url"], r["a.b"]) for r in got.collect()} == {1: ("block", "u", "v"), 2: ("block", "u", "v")}


def test_many_labels(spark):
    rows = [(i, ("abc de " if i % 2 else "xyz uv ") * 9, "even" if i % 2 else "odd") for i in range(400)] + [(1000 + i, f"noise {i}", f"label{i}") for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r["doc_id"]: r["lang_pred"] for r in language_id.identify(docs, most_languages=20).where("doc_id < 400").collect()}
    assert all(p == ("even" if i % 2 else "odd") for i, p in got.items()) and len(got) == 400


def test_partitions_are_measured(spark):
    docs = spark.createDataFrame([(i, "x" * 1000) for i in range(1000)], "doc_id long, text string")
    joined = docs.join(docs.select("doc_id", F.col("text").alias("t")), "doc_id")
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert storage.parts_for(joined) == least
    assert storage.parts_for(joined, most_bytes=100_000) == 10
    assert storage.parts_for(joined, least_bytes=500_000) == 2
    assert storage.parts_for(joined.limit(0), least_bytes=500_000) == 1


def test_little_padding_at_any_number_of_partitions(spark):
    docs = spark.createDataFrame([(i, " ".join(f"word{(i * j) % 977}" for j in range(400))) for i in range(1200)], "doc_id long, text string")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "200")
    try:
        sums = packing.pack(docs).groupBy("sequence_id").agg(F.sum("length").alias("n")).agg(F.sum("n").alias("n"), F.count("*").alias("k")).first()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert 1 - sums["n"] / (sums["k"] * packing.WINDOW) < 0.01
