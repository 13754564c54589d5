"""Document fingerprints by one-permutation MinHash.

Every 5-word shingle is hashed once; the high bits of a hash choose one of
``BINS`` bins, and each bin keeps the least hash.  Optimal densification: an
empty bin walks its own fixed random order of the bins and copies the first
that is filled, mixed with its own number so that chance agreement stays independent
from bin to bin.  The low ``BITS`` bits of each bin are packed into the
fingerprint.  Chance agreement of so few bits is taken off by
J = (agreement - 2^-b) / (1 - 2^-b).
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import byte_words, session_ready, written

SHINGLE = 5
BINS = 512
BITS = 4
WORDS_KEPT = 200_000


@lru_cache(maxsize=1)
def _probe_order() -> np.ndarray:
    """rank[i, j]: at which step bin i, if empty, would try bin j."""
    rng = np.random.Generator(np.random.PCG64(20240229))
    return np.argsort(rng.random((BINS, BINS)), axis=1).argsort(axis=1).astype(np.uint16)


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh64_intdigest(word, 7)
        if len(self) >= WORDS_KEPT:
            self.clear()
        if len(word) <= 64:
            self[word] = h
        return h


_HASHES = _WordHashes()
_FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingle_hashes(text: bytes | None) -> np.ndarray:
    """A hash for each 5-word shingle, A-Z in lower case; fewer words make one shingle; no word, none."""
    words = byte_words(text)
    w = np.fromiter(map(_HASHES.__getitem__, words), np.uint64, len(words))
    if not len(w):
        return w
    if len(w) < SHINGLE:
        return _mix(np.array([(w * _FACTORS[: len(w)]).sum() + np.uint64(len(w))], np.uint64))
    n = len(w) - SHINGLE + 1
    return _mix(sum((w[i : i + n] * _FACTORS[i] for i in range(1, SHINGLE)), w[:n] * _FACTORS[0]))


def minhash(text: bytes | None) -> np.ndarray | None:
    """BINS values of BITS bits, or None for a text without words."""
    h = shingle_hashes(text)
    if not len(h):
        return None
    h.sort()
    bins = (h >> np.uint64(64 - BINS.bit_length() + 1)).astype(np.int64)
    first = np.concatenate([[True], bins[1:] != bins[:-1]])
    out, filled, least = np.zeros(BINS, np.uint8), bins[first], h[first]
    low = np.uint64((1 << BITS) - 1)
    out[filled] = least & low
    empty = np.ones(BINS, bool)
    empty[filled] = False
    if empty.any():
        at = np.nonzero(empty)[0]
        copied = least[_probe_order()[np.ix_(at, filled)].argmin(axis=1)]
        out[at] = _mix(copied + at.astype(np.uint64) * _FACTORS[0]) & low
    return out


def packed(values: np.ndarray | None) -> str:
    """Lowercase hex of two values a byte; a text without words has the empty string."""
    return "" if values is None else (values[0::2] << 4 | values[1::2]).tobytes().hex()


def unpacked(fingerprint: str) -> np.ndarray | None:
    if not fingerprint:
        return None
    b = np.frombuffer(bytes.fromhex(fingerprint), np.uint8)
    return np.stack([b >> 4, b & 15], axis=1).ravel()


def likeness(a: np.ndarray | None, b: np.ndarray | None) -> float:
    """Estimate of the Jaccard likeness of two texts' shingles; two texts without words are alike, one is unlike any other."""
    if a is None or b is None:
        return float(a is None and b is None)
    chance = 2.0**-BITS
    return min(1.0, max(0.0, (float((a == b).mean()) - chance) / (1 - chance)))


def fingerprints(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text, ...) to (doc_id, fingerprint), a row for each row. Null and empty texts: the empty string. No shuffle."""
    session_ready(docs.sparkSession)

    def run(batches):
        for b in batches:
            fps = [packed(minhash(t)) for t in b.column("text").cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(fps, pa.string())], ["doc_id", "fingerprint"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, fingerprint string")


def edited(text: str, following: str) -> str:
    """The last half of ``text`` (rounded down) replaced by as many characters from the start of ``following``, or all it has."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


OUT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
#: Copies of a row that one task puts out.
COPIES = 10_000


def _compared(doc_id, text: str, values, following: str, of_following) -> tuple:
    changed = edited(text, following).encode()
    of_changed = minhash(changed)
    return doc_id, len(text), hashlib.sha256(changed).hexdigest(), packed(values), packed(of_changed), likeness(values, of_changed), likeness(values, of_following)


def _batch(out: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [()] * 7, _TYPES)], _NAMES)


def _compare(batches):
    """Rows of a range in order, the first of the next range last (ghost): each against its successor."""
    held = None
    for b in batches:
        out: list[tuple] = []
        for doc_id, text, ghost in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), b.column("ghost").to_pylist()):
            if ghost and held is None:
                continue
            values = minhash(text.encode())
            if held is not None:
                out.append(_compared(*held, text, values))
            held = None if ghost else (doc_id, text, values)
        yield _batch(out)


def _with_itself(batches):
    """Rows that are followed by copies of themselves."""
    for b in batches:
        rows = [(i, t, minhash(t.encode())) for i, t in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist())]
        yield _batch([_compared(i, t, v, t, v) for i, t, v in rows]).append_column("n", b.column("n"))


_NAMES = [x.split()[0] for x in OUT.split(", ")]
_TYPES = [{"long": pa.int64(), "double": pa.float64(), "string": pa.string()}[x.split()[1]] for x in OUT.split(", ")]


def _place(doc_id: Column, h: Column) -> Column:
    """Rises with the order of rows: doc_id from high to low, null last, then the hash of the text."""
    return F.struct(doc_id.isNull().alias("no_id"), F.bitwise_not(F.coalesce(doc_id, F.lit(0))).alias("down"), h.alias("h"))


def _starts(ids: DataFrame, parts: int) -> list[tuple[int | None, int]]:
    """(doc_id, h) at which ranges begin, so that none but of equal rows has many more than its share; a few for each part.

    Ids are cut into about equal ranges.  An id of more rows than a range's share (null among them), of which
    there are fewer than ``parts``, is a range of its own, or several by the hash of the text.
    """
    n = ids.count()
    cuts = ids.where("doc_id is not null").approxQuantile("doc_id", [i / parts for i in range(1, parts)], 0.2 / parts) if parts > 1 else []
    low, found = -(2**63), {(int(x), -(2**63)) for x in cuts}
    for r in ids.groupBy("doc_id").count().where(F.col("count") * parts > n).collect():
        slices = -(-r["count"] * parts // max(1, n))
        found |= {(r["doc_id"], low + (i << 64) // slices) for i in range(slices)}
        if r["doc_id"] is not None and r["doc_id"] > low:
            found.add((r["doc_id"] - 1, low))
    return sorted(found, key=lambda x: (x[0] is None, -(x[0] or 0), x[1]))


def with_edited(docs: DataFrame, parts: int | None = None) -> DataFrame:
    """docs(doc_id, text, ...) to (doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next).

    Each text is compared with a copy whose last half comes from the next
    document in descending doc_id (after the last, the first).  Texts move
    once, into ranges of doc_id; the document that begins a range is also
    sent to the end of the range before it, so that every task finds its
    neighbours in order as it streams, with two texts in memory.  Ids of many
    rows are cut by a hash of the text; of many equal rows one is sent, the
    others follow each other.  The driver gets a few ids for each range.

    Null texts count as empty.  Rows with a null doc_id come after all
    others; rows of one doc_id are ordered by a hash of their text, then the
    text.  A single row is its own next document.  An empty table gives no
    rows.  Other columns are not read.
    """
    spark = session_ready(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).withColumn("h", F.xxhash64("text"))
    ids = written(rows.select("doc_id", "h"), "ids")
    parts = parts or max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    starts = _starts(ids, parts)
    at = _place(F.col("doc_id"), F.col("h"))
    bounds = [_place(F.lit(i).cast("long"), F.lit(h).cast("long")) for i, h in starts]
    part = F.size(F.filter(F.array(*bounds), lambda b: b <= at)) if bounds else F.lit(0)
    heads = {r["part"]: r["head"] for r in ids.groupBy(part.alias("part")).agg(F.min(at).alias("head")).collect()}
    if not heads:
        return spark.createDataFrame([], OUT)
    n = ids.count()
    many = [(r["doc_id"], r["h"]) for r in ids.groupBy("doc_id", "h").count().where((F.col("count") > COPIES) & (F.col("count") * parts > n)).select("doc_id", "h").collect()]
    copies = None
    if many:
        hot = F.exists(F.array(*(_place(F.lit(i).cast("long"), F.lit(h).cast("long")) for i, h in many)), lambda b: b == at)
        one = written(rows.where(hot).groupBy("doc_id", "h", "text").agg(F.count("*").alias("n")), "copies")
        rows = rows.where(~hot).unionByName(one.drop("n"))
        copies = one.where("n > 1").select("doc_id", "text", (F.col("n") - 1).alias("n")).mapInArrow(_with_itself, OUT + ", n long")
        chunk = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / COPIES)))
        copies = copies.withColumn("chunk", chunk).repartition(parts)
        copies = copies.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.least(F.lit(COPIES).cast("long"), F.col("n") - COPIES * F.col("chunk"))))).select(_NAMES)
    order = sorted(heads)
    ghosts = [F.struct(_literal(heads[p]).alias("head"), F.lit(order[i - 1]).alias("to")) for i, p in enumerate(order)]
    here = F.array(F.struct(F.lit(0).alias("head"), part.alias("to"), F.lit(False).alias("ghost")))
    there = F.transform(F.filter(F.array(*ghosts), lambda g: g["head"] == at), lambda g: F.struct(F.lit(0).alias("head"), g["to"].alias("to"), F.lit(True).alias("ghost")))
    sent = rows.select("doc_id", "text", "h", F.explode(F.concat(here, there)).alias("x")).select("doc_id", "text", "h", "x.to", "x.ghost")
    ranges = sent.repartitionById(len(starts) + 1, F.col("to")).sortWithinPartitions("ghost", at, "text")
    found = ranges.select("doc_id", "text", "ghost").mapInArrow(_compare, OUT)
    return found.unionByName(copies) if copies is not None else found


def _literal(place) -> Column:
    return F.struct(F.lit(place["no_id"]).alias("no_id"), F.lit(place["down"]).cast("long").alias("down"), F.lit(place["h"]).cast("long").alias("h"))
