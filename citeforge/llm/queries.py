"""Registry of the training-data queries: each applies its operator to the whole table with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citeforge.llm import ann, bpe, langid, licenses, neardup, packing, quality, sharding, substring, toxicity
from citeforge.llm.common import documents


def _bounded_batches(spark: SparkSession) -> None:
    """Rows of an Arrow batch; texts may be long."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    _bounded_batches(spark)
    s = F.col(substring.SPANS)
    out = substring.deduplicate(documents(spark, sf_dir).select("doc_id", "text"))
    ids = F.array_sort(F.array_distinct(F.flatten(F.transform(s["spans"], lambda x: x["first_doc_ids"]))))
    return out.select("doc_id", F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("n_chars"), s["removed_chars"].alias("removed_chars"), F.size(s["spans"]).cast("long").alias("n_repeats"), (s["removed_chars"] > 0).alias("changed"), ids.alias("repeats_of"), s["spans"].alias("spans"), s["text"].alias("text"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    _bounded_batches(spark)
    return quality.assess(documents(spark, sf_dir)).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    _bounded_batches(spark)
    return langid.identify(documents(spark, sf_dir))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    _bounded_batches(spark)
    return packing.pack(documents(spark, sf_dir))


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    _bounded_batches(spark)
    return bpe.round_trip(documents(spark, sf_dir))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(documents(spark, sf_dir)).drop("stratum")


def op7_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    _bounded_batches(spark)
    return ann.nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    _bounded_batches(spark)
    return toxicity.detect(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op9_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    _bounded_batches(spark)
    return neardup.link(documents(spark, sf_dir), width=3, percent=85)


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(documents(spark, sf_dir))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (op1_substring_dedup, op2_quality_rules, op3_language_id, op4_packing, op5_bpe, op6_sharding, op7_ann, op8_toxicity, op9_minhash, op10_license_scan, pipeline)}
