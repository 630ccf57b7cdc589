"""The queries opN_<name> over the driver's tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, fim, fm, id_files, imatch, licenses, maxent, mixing, packing, periodic, quality_rules, secrets, simhash, suffix_dedup, tokens


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(common.documents(spark, sf_dir), tokens.tokenizer_path())


def op1_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(common.documents(spark, sf_dir))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality_rules.quality_rules(common.documents(spark, sf_dir))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "distance")


def op3_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digests(common.documents(spark, sf_dir))


def op4_imatch_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return imatch.fingerprints(common.documents(spark, sf_dir))


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir)
    held_out = common.crc_fold(F.col("doc_id"), 5) == 0
    model = fm.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), held_out)
    return fm.score(docs, model).select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op6_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = simhash.near_duplicates(common.documents(spark, sf_dir))
    return rows.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op8_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = mixing.mix(common.documents(spark, sf_dir))
    return rows.select("doc_id", F.coalesce("source", F.lit("")).alias("source"), F.col("mix_slot").alias("slot"), F.col("mix_block").alias("block"), "mix_order")


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maxent.score(common.documents(spark, sf_dir))


def op10_token_id_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return id_files.write_and_read(common.documents(spark, sf_dir), tokens.tokenizer_path())


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fim.transform(common.documents(spark, sf_dir))
    back = fim.restored(F.col("output"), F.col("form"))
    return rows.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(back, 256).alias("restored_sha256"))


def op12_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.summary(licenses.scan(common.documents(spark, sf_dir)))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = periodic.collapse(periodic.planted(common.documents(spark, sf_dir)))
    top = rows.withColumn("top", periodic.greatest(F.col("runs")))
    exponent = F.floor(1000 * F.col("top.length") / F.col("top.period")).alias("exponent_milli")
    return top.select("doc_id", F.size("runs").cast("long").alias("n_runs"), "top.start", "top.length", "top.period", exponent, periodic.digest(F.col("runs")).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k.startswith("op")}


def oracle_sql() -> dict[str, str]:
    return {"op8_source_mixing": mixing.ORACLE, "op11_fill_in_middle": fim.ORACLE, "op12_license_scans": licenses.ORACLE}
