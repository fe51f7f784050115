"""The operators with production parameters over the whole tables of the testbed."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import importance, jpeg, packing, perplexity, pii, quality, rowmatch, secrets, setjoin, spm, tokencount, vafile, warc
from .support import load

TOKENIZER = "byte_bpe_50k.json"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_vafile_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vafile.topk(load(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


def op2_pii_weak_supervision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(load(spark, sf_dir, "documents"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.count(load(spark, sf_dir, "documents"), tokenizer_path(), limit=1024)


def op4_jpeg_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jpeg.features(jpeg.to_media(load(spark, sf_dir, "documents")))


def op5_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return setjoin.join(load(spark, sf_dir, "documents"), setjoin.Rule(width=3, num=90, den=100))


def op6_mixture_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(load(spark, sf_dir, "documents"), tokenizer_path(), sequence=1024)


def op7_nbsvm_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"), threshold=0.7)


def op8_streaming_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spm.digest(load(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


def op9_markov_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(load(spark, sf_dir, "documents"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive(load(spark, sf_dir, "pages"), least_bytes=0).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resample(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"), share=(5, 100), least_words=20, buckets=10_000, seed=42)


def op12_kneser_ney_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return perplexity.judge(load(spark, sf_dir, "documents"))


def op13_row_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = rowmatch.match(load(spark, sf_dir, "clicks"), "A D+ U+ P", gap_seconds=300)
    return found.select("client_id", "match_no", "first_id", "last_id", "n_rows", "sum_cents", F.sha2("labels", 256).alias("labels_sha256"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_vafile_topk, op2_pii_weak_supervision, op3_token_counts, op4_jpeg_media, op5_ngram_jaccard_join, op6_mixture_packing, op7_nbsvm_quality, op8_streaming_sentencepiece, op9_markov_secrets, op10_warc, op11_importance_resampling, op12_kneser_ney_rules, op13_row_patterns)}
