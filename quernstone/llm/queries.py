"""The operators as the driver's queries: production parameters, whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bitplanes, iblt, lm, mixing, near_dup, packing, quality, secrets, topk, urls
from .common import docs


def tokenizer_path(name: str) -> str:
    """Where an installed vocabulary file lies; the same on all machines of a cluster."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(docs(spark, sf_dir), tokenizer_path("word_bpe_49k.json"), with_ids=False)


def op2_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.classes(docs(spark, sf_dir))


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.scan(docs(spark, sf_dir)))


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bitplanes.read_ids(bitplanes.write_ids(docs(spark, sf_dir), tokenizer_path("byte_bpe_50k.json")), with_ids=False)


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(docs(spark, sf_dir))


def op6_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return topk.top_k(rows, rows.where(F.col("vec_id") % 20 == 0))


def op7_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = docs(spark, sf_dir)
    out = lm.held_out(F.col("doc_id"))
    model = lm.train(rows.where(~out))
    scored = lm.score(rows, model)
    return scored.select("doc_id", out.alias("held_out"), "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score")


def op8_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return iblt.fingerprints(docs(spark, sf_dir))


def quality_model(spark: SparkSession, sf_dir: str) -> quality.RuleModel:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.fit(docs(spark, sf_dir), labels.where(~quality.held_out(F.col("doc_id"))))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = quality.score(docs(spark, sf_dir), quality_model(spark, sf_dir))
    return scored.select("doc_id", quality.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


QUERIES = {f.__name__: f for f in (op1_packing, op2_near_dup, op3_secrets, op4_token_files, op5_mixing, op6_top_k, op7_lm_score, op8_url_rules, op9_fingerprints, op10_quality)}
ORACLE_SQL = {"op5_mixing": mixing.ORACLE_SQL, "op8_url_rules": urls.ORACLE_SQL}
