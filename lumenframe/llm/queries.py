"""The operators' queries for ``__spark_entry__.py``: thin digests of what the operators return."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenframe.llm import decontamination, filter_audit, language_id, line_dedup, packing, periodic_runs, quality_classifier, quality_rules, simhash, storage, suffix_dedup, token_files, url_filter, warc


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.digest(decontamination.hits(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = token_files.write(table(spark, sf_dir, "documents"), storage.new_folder(spark, "tokens"))
    return token_files.read(spark, manifest)


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(table(spark, sf_dir, "documents"))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = warc.write(table(spark, sf_dir, "pages"), storage.new_folder(spark, "warc"))
    return warc.read(spark, files, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def op5_redirects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chains of redirects, each page but every fifth to the next one by id, over which blocks spread."""
    pages = table(spark, sf_dir, "pages")
    numbered = pages.select("page_id", "url").where("page_id % 5 != 4").withColumn("next", F.col("page_id") + 1)
    moved = numbered.join(pages.select(F.col("page_id").alias("next"), F.col("url").alias("target")), "next").select("url", "target")
    return url_filter.judge(pages, redirects=moved).select("page_id", "host", "path", "rule", "verdict")


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.digest(simhash.near_duplicates(table(spark, sf_dir, "documents")))


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return quality_rules.judge(docs, with_text=False).select("doc_id", *quality_rules.MEASURES, "base_failed", "kept", "source", F.round("host_rate", 6).alias("host_rate"), "host_rejected")


def op8_host_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hosts of which some fall: the short texts of a language are a host of their own."""
    host = F.concat(F.coalesce("lang", F.lit("")), F.when(F.col("n_chars") < 160, "/short").otherwise("/long"))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", host.alias("source"))
    return quality_rules.host_verdicts(quality_rules.measure(docs, with_text=False)).withColumn("host_rate", F.round("host_rate", 6)).drop("host_rule")


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.remove_repeated(table(spark, sf_dir, "documents"), count_column="n_lines_removed").select("doc_id", "text", "n_lines_removed")


def op9_short_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With shorter runs: 30 words."""
    return line_dedup.remove_repeated(table(spark, sf_dir, "documents"), 30, "n_lines_removed").select("doc_id", "text", "n_lines_removed")


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.digest(packing.pack(table(spark, sf_dir, "documents")))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def planted(docs: DataFrame) -> DataFrame:
    """(doc_id, text) in which a tenth of the documents, by a hash of their ids, repeat a stretch of their words from some word on."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.crc32(F.col("doc_id").cast("string").cast("binary")).alias("h"))
    split = rows.withColumn("w", F.when(F.col("h") % 10 == 0, F.array_remove(F.split("text", r"[\x20\x09-\x0D]+", -1), "")))
    drawn = split.withColumn("n", F.coalesce(F.size("w"), F.lit(0)).cast("long")).withColumn("g", F.expr("h div 10")).withColumn("a", F.expr("CASE WHEN n > 0 THEN g % n END")).withColumn("p", F.expr("1 + (n - a) div (3 + g % 8)"))
    repeated = F.array_join(F.expr("transform(sequence(0L, n - 1), i -> w[CAST(CASE WHEN i < a THEN i ELSE a + (i - a) % p END AS int)])"), " ")
    return drawn.select("doc_id", F.when(F.col("n") > 0, repeated).otherwise(F.col("text")).alias("text"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs.digest(periodic_runs.find(planted(table(spark, sf_dir, "documents"))))


def op13_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.digest(suffix_dedup.find(table(spark, sf_dir, "documents")))


def queries() -> dict:
    return {
        "op1_decontamination": op1_decontamination,
        "op2_token_files": op2_token_files,
        "op3_language_id": op3_language_id,
        "op4_warc": op4_warc,
        "op5_url_filter": op5_url_filter,
        "op5_redirects": op5_redirects,
        "op6_simhash": op6_simhash,
        "op7_quality_classifier": op7_quality_classifier,
        "op8_quality_rules": op8_quality_rules,
        "op8_host_verdicts": op8_host_verdicts,
        "op9_line_dedup": op9_line_dedup,
        "op9_short_runs": op9_short_runs,
        "op10_packing": op10_packing,
        "op11_filter_audit": op11_filter_audit,
        "op12_periodic_runs": op12_periodic_runs,
        "op13_suffix_dedup": op13_suffix_dedup,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_decontamination": decontamination.SQL, "op4_warc": warc.SQL, "op5_url_filter": url_filter.SQL, "op5_redirects": url_filter.SQL_REDIRECTS, "op8_quality_rules": quality_rules.SQL_DOCUMENTS, "op8_host_verdicts": quality_rules.SQL_HOSTS, "op9_line_dedup": line_dedup.sql(), "op9_short_runs": line_dedup.sql(30), "op11_filter_audit": filter_audit.SQL}
