"""Token counts by a digest cache.

The cache is a Parquet table (content_digest, n_tokens), partitioned by tokenizer_digest.
Texts are normalised (runs of white space become one space, none at the ends;
the tokenizer does so too, so the count stays), digested, and looked up.  Each
digest that is missing is encoded once, wherever its copies are, and appended.

Digests of copies are pre-aggregated before any shuffle, and only one text of
each missing digest reaches the encoder.  While few digests are missing, only
their texts move.  Digests that hold more than one row in HOT_SHARE, of which
there are fewer than that, get their counts by a broadcast.
"""

from __future__ import annotations

import hashlib
import re
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException
from tokenizers import Tokenizer

from ._common import HOT_SHARE, NULL_KEY, per_batch, session_ready, written
from .bpe import SETTLED, SPACES, Seen, byte_chars

CACHE_SCHEMA = "content_digest binary, tokenizer_digest string, n_tokens long"


#: Missing digests that are sent to every task (32 bytes each).
FEW = 100_000
#: The pattern of what the pre-tokenizer keeps.
KEPT = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+").findall


class FragmentCounter:
    """Counts for a tokenizer that drops white space: a text has the tokens of its runs of other characters.

    Normal form, lower case and classes of settled characters are taken from
    Python; a fragment with any other character goes through the library.
    """

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenize = self.tokenizer.model.tokenize
        self.to_chars = {b: c for c, b in byte_chars().items()}
        self.fragments = re.compile(f"[^{SPACES}]+").findall
        self.seen = Seen(self.count_fragment)

    def count_fragment(self, fragment: str) -> int:
        if max(fragment) < SETTLED and "<|" not in fragment:
            tokenize, chars = self.tokenize, self.to_chars
            return sum([len(tokenize(x.encode().decode("latin-1").translate(chars))) for x in KEPT(fragment.lower())])
        return len(self.tokenizer.encode(fragment, add_special_tokens=False).ids)

    def count(self, text: str) -> int:
        seen = self.seen
        return sum([seen[f] for f in self.fragments(text)])


@lru_cache(maxsize=2)
def counter(path: str) -> FragmentCounter:
    return FragmentCounter(path)


def content_digest(text: Column) -> Column:
    return F.unhex(F.sha2(F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"[\t\n\x0B\f\r ]+", " ")), 256))


def token_counts(docs: DataFrame, path: str, cache: str, limit: int = 2048) -> DataFrame:
    """docs(doc_id, text, ...) to (doc_id, n_bytes, n_tokens, over_limit), a row for each row of docs.

    path: a tokenizers file that drops white space.  cache: folder of the
    cache table, made if it is missing; entries of other tokenizers in it are
    left alone.  Null and empty texts have no bytes and no tokens.  A null
    doc_id, repeated ids and repeated rows keep their rows, and an empty table
    gives none.  Other columns are not read.
    """
    spark = session_ready(docs.sparkSession)
    version = hashlib.sha256(open(path, "rb").read()).hexdigest()
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("content_digest", content_digest(F.col("text")))
    row_key = F.coalesce("doc_id", F.lit(NULL_KEY)).alias("row_key")
    keys = written(rows.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), "content_digest"), "digests")

    def known() -> DataFrame:
        try:
            found = spark.read.schema(CACHE_SCHEMA).parquet(cache)
        except AnalysisException:
            found = spark.range(0).select(F.lit(b"").alias("content_digest"), F.lit("").alias("tokenizer_digest"), F.lit(0).cast("long").alias("n_tokens"))
        return found.where(F.col("tokenizer_digest") == version).select("content_digest", "n_tokens")

    distinct = written(keys.groupBy("content_digest").agg(F.min(row_key).alias("row_key"), F.count("*").alias("n")), "distinct")
    misses = distinct.drop("n").join(known(), "content_digest", "left_anti")

    def work(b):
        of = counter(path)
        n = [of.count(t or "") for t in b.column("text").to_pylist()]
        return pa.RecordBatch.from_arrays([b.column("content_digest"), pa.array(n, pa.int64())], ["content_digest", "n_tokens"])

    texts = rows.select("text", "content_digest", row_key)
    if misses.count() <= FEW:
        texts = texts.join(F.broadcast(misses.select("content_digest")), "content_digest", "left_semi")
    # equal rows, and rows without an id that share a text, are one row for each task before they are dealt out
    texts = texts.groupBy("row_key", "content_digest").agg(F.first("text").alias("text"))
    fresh = texts.join(misses.hint("merge"), ["row_key", "content_digest"], "left_semi")
    fresh = fresh.select("text", "content_digest").mapInArrow(per_batch(work), "content_digest binary, n_tokens long")
    fresh.withColumn("tokenizer_digest", F.lit(version)).write.mode("append").partitionBy("tokenizer_digest").parquet(cache)
    counts = known().groupBy("content_digest").agg(F.max("n_tokens").alias("n_tokens"))
    n_rows = distinct.agg(F.sum("n")).first()[0] or 0
    hot = F.broadcast(counts.join(F.broadcast(distinct.where(F.col("n") * HOT_SHARE > n_rows).select("content_digest")), "content_digest"))
    tagged = keys.join(hot, "content_digest", "left")
    cold = tagged.where("n_tokens is null").drop("n_tokens").join(counts, "content_digest")
    return tagged.where("n_tokens is not null").unionByName(cold).select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
