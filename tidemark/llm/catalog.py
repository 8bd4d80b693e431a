"""One named query per operator over the test tables, with reference SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import audit, decontaminate, langid, licences, neardup, negatives, packing, pii, quality, repeats, secrets, simhash, urls
from .tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``fn(spark, folder)`` under ``name``."""
    def register(fn: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return register


@query("op10_quality_rules")
def op10_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return quality.score(docs, quality.train(docs, table(spark, folder, "labels")))


@query("op3_minhash_near_dedup", neardup.ORACLE_SQL)
def op3_minhash_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, folder, "documents"))


@query("op5_benchmark_decontamination")
def op5_benchmark_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


@query("op1_pii_weak_supervision")
def op1_pii_weak_supervision(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return pii.find(docs, pii.train(docs))


@query("op6_best_fit_packing")
def op6_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(table(spark, folder, "documents"))


@query("op7_language_id")
def op7_language_id(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return langid.predict(docs, langid.train(docs))


@query("op8_secret_scan")
def op8_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return secrets.find(docs, secrets.calibrate(docs))


@query("op9_url_filters")
def op9_url_filters(spark: SparkSession, folder: str) -> DataFrame:
    model = urls.train(spark.createDataFrame(list(urls.LABELLED), "url string, label int"))
    return urls.judge(table(spark, folder, "pages"), model)


@query("op2_licence_scan", licences.ORACLE_SQL)
def op2_licence_scan(spark: SparkSession, folder: str) -> DataFrame:
    return licences.scan(licences.document_paths(table(spark, folder, "documents")), key="doc_id")


@query("op4_suffix_dedup")
def op4_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return repeats.remove_repeats(table(spark, folder, "documents")).drop("kept")


@query("op13_simhash_near_dedup")
def op13_simhash_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, folder, "documents"))


@query("op12_hard_negative_mining", negatives.ORACLE_SQL)
def op12_hard_negative_mining(spark: SparkSession, folder: str) -> DataFrame:
    return negatives.mine(table(spark, folder, "embeddings"))


@query("op11_filter_interaction_audit", audit.ORACLE_SQL)
def op11_filter_interaction_audit(spark: SparkSession, folder: str) -> DataFrame:
    return audit.audit(table(spark, folder, "documents"), table(spark, folder, "labels"))
