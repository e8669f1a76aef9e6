"""One text of a megabyte, ten thousand times a usual line, through every operator, beside short ones."""

import pytest
from lumenframe.llm import decontamination, language_id, line_dedup, near_copies, packing, quality_classifier, quality_rules, simhash, storage, token_files, url_filter, warc

WORDS = 150_000  # 1 MB


@pytest.fixture(scope="module")
def docs(spark):
    line = " ".join(f"w{k:05}" for k in range(100))
    return spark.createDataFrame([(1, "\n".join(f"{line} {k}" for k in range(WORDS // 101)), "en", "s"), (2, f"{line} 7", "en", "s"), (3, "other short words here", "en", "s")], "doc_id long, text string, lang string, source string").cache()


def test_a_long_text_is_one_document(spark, docs):
    n = WORDS // 101 * 101
    hit = {r["doc_id"]: r for r in decontamination.digest(decontamination.hits(docs, spark.createDataFrame([(1, "w00098 w00099 7")], "item_id long, text string"))).collect()}
    assert (hit[1]["n_words"], hit[1]["n_hit"], hit[2]["n_hit"], hit[3]["n_hit"]) == (n, 3, 3, 0)
    assert {r["doc_id"] for r in simhash.near_duplicates(docs).collect()} == {1, 2, 3} == {r["doc_id"] for r in near_copies.near_copies(docs).collect()}
    judged = {r["doc_id"]: r["n_words"] for r in quality_rules.judge(docs, with_text=False).collect()}
    assert judged == {1: n, 2: 101, 3: 4}
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, 0)], "doc_id long, quality int")
    assert quality_classifier.score(docs, labels).count() == language_id.identify(docs).count() == 3
    removed = {r["doc_id"]: r["n"] for r in line_dedup.remove_repeated(docs, count_column="n").collect()}
    assert removed == {1: 0, 2: 1, 3: 0}


def test_a_long_text_is_written_whole(spark, docs):
    read = {r["doc_id"]: r["n_tokens"] for r in token_files.read(spark, token_files.write(docs, storage.new_folder(spark, "t"))).collect()}
    packed = {r["doc_id"]: r["n"] for r in packing.pack(docs).groupBy("doc_id").agg({"length": "sum"}).withColumnRenamed("sum(length)", "n").collect()}
    assert packed == read and read[1] > WORDS
    pages = docs.selectExpr("doc_id page_id", "concat('http://h.net/', doc_id) url", "text html")
    got = {r["page_id"]: r["payload_bytes"] for r in warc.read(spark, warc.write(pages, storage.new_folder(spark, "w")), payloads=False).collect()}
    assert got == {r["doc_id"]: r["n"] for r in docs.selectExpr("doc_id", "length(text) n").collect()}
    assert url_filter.judge(pages).where("verdict = 'block'").count() == 3
