"""The operators' queries over whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegauge.llm import decontaminate, langid, license_scan, packing, quality, shards, simhash, token_counts, toxicity, warc
from tidegauge.llm.common import scratch, table


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.license_scan(table(spark, sf_dir, "documents"), license_scan.license_table(spark))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    trusted = table(spark, sf_dir, "labels").where("quality = 1")
    return quality.quality_rules(table(spark, sf_dir, "documents"), trusted)


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_components(table(spark, sf_dir, "documents"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc.warc_round_trip(table(spark, sf_dir, "pages"))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.best_fit_pack(table(spark, sf_dir, "documents"))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = shards.shard_table(table(spark, sf_dir, "documents"), scratch(spark, "shards"))
    return store.read().select("doc_id", F.sha2("text", 256).alias("text_sha256"), "lang", "source", "n_chars")


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.train(docs.where(~langid.held_out()))
    out = langid.language_id(docs, model)
    return out.select("doc_id", F.coalesce(langid.held_out(), F.lit(False)).alias("held_out"), "lang_pred", "score", "lang_mix")


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def _lexicon(docs: DataFrame, labels: DataFrame) -> toxicity.Lexicon:
    return toxicity.train(docs.where(~toxicity.held_out()), labels)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = toxicity.toxicity(docs, _lexicon(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", F.coalesce(toxicity.held_out(), F.lit(False)).alias("held_out"), "score", "predicted")


QUERIES = {f.__name__: f for f in (op1_license_scan, op2_quality_rules, op3_token_counts, op4_simhash, op5_warc, op6_best_fit_packing, op7_sharding, op8_language_id, op9_decontamination, op10_toxicity)}

ORACLE_SQL = {
    "op1_license_scan": license_scan.oracle(),
    "op5_warc": warc.ORACLE,
    "op7_sharding": "SELECT doc_id, sha256(text) AS text_sha256, lang, source, n_chars FROM documents",
    "op9_decontamination": decontaminate.ORACLE,
}
