"""A corpus pipeline over ``documents``: classify, deduplicate, redact, mix, encode.

Each stage takes (spark, docs, sf_dir) and works on all that the one before kept.
All columns pass, whatever their names; an empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from spanvec.llm import bpe, mixing, quality_classifier, secrets, simhash
from spanvec.llm._common import documents, session_ready
from spanvec.llm.queries import id_remainder, tokenizer
from spanvec.sources.workspace import hadoop_fs, work_path

KEEP = 0.7


def classify_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below KEEP go, each row judged by its own text.

    A null text counts as empty.  A null id is judged too, but not learned
    from; repeated rows stay or go together.
    """
    session_ready(spark)
    return quality_classifier.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), KEEP, id_remainder(4) == 2)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: that with the smallest id, one without an id only if none has one.

    Different texts of one id are different documents.  Repeated rows are near
    duplicates, and so are all null and empty texts.
    """
    session_ready(spark)
    return simhash.drop_near_duplicates(docs)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked in the texts. Null texts stay null; null ids and repeated rows stay."""
    session_ready(spark)
    return secrets.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document stays as often as the mix takes it, or goes.

    A null source is one of its own.  Texts without words, null ones too, are
    not taken.  Null ids are mixed like others; rows that share id, source and
    size are taken alike.
    """
    session_ready(spark)
    return mixing.apply_mix(docs)


def encode_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, source, n_tokens, ids): the training rows. Repeated rows of a document are encoded each; a null text has no ids."""
    session_ready(spark)
    return bpe.encode_rows(docs, tokenizer("byte_bpe_50k.json"), ["doc_id", "source"])


STAGES = [
    ("quality_classifier", classify_quality),
    ("simhash_near_dedup", drop_near_duplicates),
    ("secret_scan", redact_secrets),
    ("mix_sources", mix_sources),
    ("bpe_encode", encode_texts),
]

#: No stage but the redaction could be put in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet into the shared folder and read again by the next; a stage's folder goes when the next one is written."""
    docs, before = documents(spark, sf_dir), None
    for name, stage in STAGES[:-1]:
        path = work_path(spark, name)
        stage(spark, docs, sf_dir).write.mode("append").parquet(path)
        docs = spark.read.parquet(path)
        if before:
            fs, at = hadoop_fs(spark, before)
            fs.delete(at, True)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
