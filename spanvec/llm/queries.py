"""The registered queries: each operator over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.workspace import work_path
from . import bpe, license_scan, lm_score, minhash, mixing, quality_classifier, quality_rules, secrets, simhash, token_counts
from ._common import documents
from .oracles import ORACLES

TOKENIZERS = "/opt/tokenizers"


def tokenizer(name: str) -> str:
    """Place of a public vocabulary file."""
    try:
        import public_tokenizers
    except ModuleNotFoundError:
        return f"{TOKENIZERS}/{name}"
    return public_tokenizers.path(name)


def id_remainder(n: int):
    """crc32 of the id's text, modulo n; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % n


def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Its contract links at 4 differing bits and nothing else."""
    return simhash.near_duplicates(documents(spark, sf_dir), similarity=None)


def op2_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip_digests(documents(spark, sf_dir), tokenizer("byte_bpe_50k.json"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Starts from an empty cache, so that every distinct text is encoded."""
    docs = documents(spark, sf_dir)
    return token_counts.token_counts(docs, tokenizer("word_bpe_49k.json"), work_path(spark, "token-counts"))


def op4_minhash_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.with_edited(documents(spark, sf_dir))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_kept_words", "base_failed", "kept")
    return quality_rules.clean(documents(spark, sf_dir)).select(*names)


def op6_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir))


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_scan.scan(documents(spark, sf_dir))
    span = lambda m: F.concat_ws(":", m["template"], m["s"].cast("string"), m["e"].cast("string"))
    return found.select(
        "doc_id", F.size("matches").cast("long").alias("n_matches"), F.coalesce(F.array_max(F.transform(F.concat("matches", "partial"), lambda m: m["coverage"])), F.lit(0.0)).alias("coverage"),
        F.array_join(F.transform("matches", span), ",").alias("spans"), F.array_join(F.transform("partial", span), ",").alias("partial_spans"),
    )


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = F.sha2(secrets.spelled(F.col("base")).cast("binary"), 256)
    return secrets.scan(documents(spark, sf_dir)).select("doc_id", "n_assign", "n_access", "n_hex", base.alias("base_sha256"), secrets.spelled(F.col("all_spans")).alias("spans"))


def op9_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.lm_scores(documents(spark, sf_dir), tokenizer("piece_bpe_32k.model"), id_remainder(10) == 0)


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    held_out = id_remainder(4) == 2
    scores = quality_classifier.classify(docs, labels, held_out)
    return scores.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_simhash_near_dedup, op2_bpe_round_trip, op3_token_counts, op4_minhash_fingerprints, op5_quality_rules,
        op6_mix_sources, op7_license_scan, op8_secret_scan, op9_lm_scores, op10_quality_classifier,
    )
}

__all__ = ["ORACLES", "QUERIES"]
