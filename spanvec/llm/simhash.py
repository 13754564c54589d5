"""SimHash near-dedup: fingerprints, pigeonhole blocks, links, components.

Bits are cut into 4 + m blocks.  Two fingerprints that differ in 4 bits or
fewer agree in some m of the blocks, so a row for every choice of m blocks
brings each close pair together in at least one bucket.  m follows from the
number of distinct fingerprints, so that chance buckets stay small; every m
finds the same pairs.

Within a bucket a breadth-first search over exact Hamming distances returns a
spanning forest, at most one row for each member, never all pairs.  A bucket
holds distinct fingerprints only, and one above ``bucket_limit`` is not
gathered: its members are linked by shared midpoints instead (two fingerprints
are within 4 bits just if some value lies within 2 bits of both), which costs a
fixed number of rows for each member and is exact as well.

Texts whose sets of word shingles are alike lie farther apart than that, around
10 bits at a Jaccard similarity of 0.8.  With ``similarity`` they are linked
too: min-hash bands bring distinct texts together, the exact similarity of the
shingle sets decides.  A band does not give all its pairs.  First each text meets
the least one of its band, which joins most groups of copies.  Bands that still
hold several components are gathered, or if they are large, cut into blocks that
meet two by two, and there the texts outside the largest component meet all others.
"""

from __future__ import annotations

from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import HOT_SHARE, byte_words, session_ready, written
from .components import components

SHINGLE = 4
SEED = 42
CLOSE = 4
BUCKET_LIMIT = 65_536
#: Shingles whose bits are counted at a time; bounds memory for very long texts.
STEP = 1 << 16
#: Shingle and similarity of near copies where no contract names others.
LIKE_SHINGLE, LIKE = 5, 0.8
#: Min-hash bands and hashes in each; at a similarity of 0.8 all bands miss a pair with a probability of 3e-6.
BANDS, IN_BAND = 24, 4
#: Shingle hashes that a task gathers for one band at most (8 bytes each).
GATHERED = 1 << 20
#: Texts that meet one copy of the least text of their band.
SLICE = 256


def fingerprint(text: bytes | None, shingle: int = SHINGLE) -> int:
    """SimHash of a whole text given in UTF-8; 0 if it has no word."""
    words = byte_words(text)
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    ones = np.zeros(64, np.int64)
    digest = xxhash.xxh64_intdigest
    for at in range(0, n, STEP):
        part = words[at : at + STEP + shingle - 1]
        grams = map(b" ".join, zip(*(part[i:] for i in range(shingle)))) if len(words) >= shingle else [b" ".join(words)]
        h = np.fromiter((digest(g, SEED) for g in grams), ">u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def with_fingerprints(docs: DataFrame, shingle: int = SHINGLE, keys: dict[str, Column] | None = None, like: int | None = None) -> DataFrame:
    """(doc_id, fp long, keys...) for every row of docs; text null: fingerprint 0. No shuffle.

    like: a number of words; then also n and bands, the number of shingles of
    so many words and the min-hash bands of their set.
    """
    session_ready(docs.sparkSession)
    keys = keys or {}
    names = ["doc_id", "fp", *keys, *(["n", "bands"] if like else [])]

    def run(batches):
        for b in batches:
            texts = b.column("text").cast(pa.binary()).to_pylist()
            columns = [b.column("doc_id"), pa.array([_signed(fingerprint(t, shingle)) for t in texts], pa.int64()), *b.columns[2:]]
            if like:
                sets = [shingle_hashes(t, like) for t in texts]
                columns += [pa.array(map(len, sets), pa.int64()), pa.array(map(bands, sets), pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *(c.alias(k) for k, c in keys.items()))
    return rows.mapInArrow(run, ", ".join(f"{k} {'array<long>' if k == 'bands' else 'long'}" for k in names))


def agreeing(n: int) -> int:
    """Blocks that must agree: the least for which chance brings at most 16 pairs for each of n fingerprints."""
    for m in range(2, 9):
        if n * comb(4 + m, m) <= 32 * 2 ** (64 // (4 + m) * m):
            return m
    return 9


def block_masks(m: int) -> list[int]:
    """One mask for every choice of m of the 4 + m blocks."""
    k = 4 + m
    cuts = [64 * i // k for i in range(k + 1)]
    blocks = [((1 << (b - a)) - 1) << a for a, b in zip(cuts, cuts[1:])]
    return [sum(c) for c in combinations(blocks, m)]


def forest(fps: np.ndarray, close: int = CLOSE) -> list[tuple[int, int]]:
    """Links (member, found from) that join all of ``fps`` (distinct) that chains of close pairs join."""
    out, rest = [], fps
    while len(rest):
        queue, rest = [rest[0]], rest[1:]
        while queue and len(rest):
            x = queue.pop()
            near = np.bitwise_count(rest ^ x) <= close
            if near.any():
                got = rest[near]
                out.extend((int(y), int(x)) for y in got)
                queue.extend(got)
                rest = rest[~near]
    return out


def _bucket_links(batches):
    for b in batches:
        lists, links = b.column("fps"), []
        values, at = lists.values.to_numpy(zero_copy_only=False).view(np.uint64), lists.offsets.to_numpy()
        for i, j in zip(at[:-1], at[1:]):
            if j - i == 2:
                x, y = values[i], values[i + 1]
                if int(x ^ y).bit_count() <= CLOSE:
                    links.append((int(x), int(y)))
            else:
                links.extend(forest(values[i:j]))
        ab = np.array(links, np.uint64).reshape(-1, 2).view(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(ab[:, 0]), pa.array(ab[:, 1])], ["a", "b"])


def _midpoints(batches):
    one = np.uint64(1) << np.arange(64, dtype=np.uint64)
    i, j = np.triu_indices(64, 1)
    flips = np.concatenate([np.zeros(1, np.uint64), one, one[i] | one[j]])
    for b in batches:
        fps = b.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)
        for part in np.array_split(fps, max(1, len(fps) // 64)):
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(part, len(flips)).view(np.int64)), pa.array((part[:, None] ^ flips).ravel().view(np.int64))], ["fp", "mid"])


def fingerprint_links(distinct: DataFrame, bucket_limit: int = BUCKET_LIMIT, m: int | None = None) -> DataFrame:
    """distinct(fp): links (a, b) that connect just what pairs of at most 4 differing bits connect."""
    session_ready(distinct.sparkSession)
    masks = block_masks(m or agreeing(distinct.count()))
    keys = distinct.select("fp", F.posexplode(F.array(*(F.col("fp").bitwiseAND(F.lit(_signed(x))) for x in masks))).alias("c", "k"))
    sizes = keys.groupBy("c", "k").agg(F.count("*").alias("n")).where("n > 1")
    shared = keys.join(sizes, ["c", "k"])
    gathered = shared.where(F.col("n") <= bucket_limit).groupBy("c", "k").agg(F.collect_list("fp").alias("fps")).select("fps")
    links = gathered.mapInArrow(_bucket_links, "a long, b long")
    crowded = shared.where(F.col("n") > bucket_limit).select("fp").distinct()
    meet = crowded.mapInArrow(_midpoints, "fp long, mid long").groupBy("mid").agg(F.min("fp").alias("b"), F.collect_list("fp").alias("fps"))
    return links.unionByName(meet.where(F.size("fps") > 1).select(F.explode("fps").alias("a"), "b").where("a <> b"))


def shingle_hashes(text: bytes | None, shingle: int = LIKE_SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of the word shingles; a shorter text is one shingle, one without words has none."""
    words = byte_words(text)
    grams = map(b" ".join, zip(*(words[i:] for i in range(shingle)))) if len(words) >= shingle else [b" ".join(words)] if words else []
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(g, SEED) for g in grams), np.uint64))


_ODD = np.random.Generator(np.random.PCG64(1)).integers(0, 1 << 63, (BANDS * IN_BAND, 2), np.uint64) * np.uint64(2) + np.uint64(1)


def bands(grams: np.ndarray) -> list[int]:
    """A number for each band of a set of hashes; none for an empty set."""
    least = np.array([((grams ^ x) * y).min() for x, y in _ODD], np.uint64).reshape(BANDS, IN_BAND) if len(grams) else ()
    return [_signed(xxhash.xxh64_intdigest(np.append(np.uint64(i), m).tobytes())) for i, m in enumerate(least)]


def _sets(shingle: int):
    def run(batches):
        for b in batches:
            sets = [shingle_hashes(t, shingle).view(np.int64) for t in b.column("text").cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("of_text"), pa.array(sets, pa.list_(pa.int64()))], ["of_text", "grams"])

    return run


def _alike(similarity: float):
    def run(batches):
        for b in batches:
            keep = []
            for x, y in zip(b.column("x_grams"), b.column("y_grams")):
                x, y = (np.asarray(v.values) for v in (x, y))
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(both >= similarity * (len(x) + len(y) - both))
            yield b.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def across(fp: np.ndarray, component: np.ndarray, chunk: np.ndarray, grams: list[np.ndarray], similarity: float) -> list[tuple[int, int]]:
    """Links between the components of the given texts that pairs of the similarity or more make, a spanning forest of them.

    Each text outside the largest component meets all others; if there are two chunks, those of the other chunk.
    """
    sizes = np.fromiter(map(len, grams), np.int64, len(grams))
    ids = np.unique(np.concatenate(grams), return_inverse=True)[1]
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    _, own = np.unique(component, return_inverse=True)
    largest, two = np.bincount(own).argmax(), len(np.unique(chunk)) > 1
    mark, out = np.zeros(ids.max() + 1, np.int64), []
    for i in np.nonzero(own != largest)[0].tolist():
        mine = ids[starts[i] : starts[i] + sizes[i]]
        mark[mine] = 1
        both = np.add.reduceat(mark[ids], starts)
        mark[mine] = 0
        near = both >= similarity * (sizes + sizes[i] - both)
        if two:
            near &= chunk != chunk[i]
        for j in np.nonzero(near)[0].tolist():
            if own[j] != own[i]:
                out.append((int(fp[i]), int(fp[j])))
                own[own == own[j]] = own[i]
    return out


def _blocks(similarity: float):
    def run(batches):
        for b in batches:
            links = []
            for row in b.column("members"):
                m = row.values
                fp, component, chunk = (np.asarray(m.field(k)) for k in ("fp", "component", "chunk"))
                links += across(fp, component, chunk, [np.asarray(g.values) for g in m.field("grams")], similarity)
            ab = np.array(links, np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(ab[:, 0]), pa.array(ab[:, 1])], ["a", "b"])

    return run


def similar_links(docs: DataFrame, banded: DataFrame, links: DataFrame, similarity: float = LIKE, shingle: int = LIKE_SHINGLE, gathered: int = GATHERED) -> DataFrame:
    """links(a, b) of fingerprints, and more that connect those of texts of the given Jaccard similarity or more.

    banded(fp, of_text, n, bands): ``with_fingerprints`` of the rows of docs, of_text being xxhash64 of the text.
    Texts count as one if their digests are equal.
    """
    session_ready(docs.sparkSession)
    text = F.col("text").cast("string")
    texts = docs.where(text.isNotNull()).select(F.xxhash64(text).alias("of_text"), text.alias("text"))
    banded = banded.where("n > 0").select("fp", "of_text", "n", "bands").dropDuplicates(["of_text"])
    keys = banded.select("fp", "of_text", "n", F.explode("bands").alias("band"))
    least = keys.groupBy("band").agg(F.min("fp").alias("low"), F.max("fp").alias("high"), F.min("of_text").alias("y"), F.min_by("fp", "of_text").alias("b"), F.ceil(F.count("*") / SLICE).alias("slices")).where("low < high")
    shared = written(keys.join(least.select("band", "y", "b", "slices"), "band"), "shared")
    # copies become one row for each task before they are dealt out by their text
    distinct = texts.dropDuplicates(["of_text"]).join(shared.select("of_text").distinct().hint("merge"), "of_text", "left_semi")
    sets = written(distinct.mapInArrow(_sets(shingle), "of_text long, grams array<long>"), "shingles")

    far = F.bit_count(F.col("fp").bitwiseXOR(F.col("b"))) > CLOSE
    pairs = shared.where(far).groupBy(F.col("fp").alias("a"), "b", F.col("of_text").alias("x"), "y").agg(F.max("slices").alias("slices"))
    least_sets = pairs.select("y", "slices").distinct().join(sets.select(F.col("of_text").alias("y"), F.col("grams").alias("y_grams")), "y").withColumn("slice", F.explode(F.sequence(F.lit(0).cast("long"), F.col("slices") - 1)))
    pairs = pairs.withColumn("slice", F.pmod(F.xxhash64("x"), "slices")).join(sets.select(F.col("of_text").alias("x"), F.col("grams").alias("x_grams")), "x")
    both = pairs.join(least_sets, ["y", "slices", "slice"])
    links = links.unionByName(both.select("a", "b", "x_grams", "y_grams").mapInArrow(_alike(similarity), "a long, b long"))

    roots = written(components(links), "roots-of-least")
    own = shared.select("band", "fp", "of_text", "n").join(roots, F.col("fp") == F.col("node"), "left").withColumn("component", F.coalesce("root", "fp")).drop("node", "root")
    own = written(own, "members")
    mixed = own.groupBy("band").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.sum("n").alias("all")).where("low < high")
    mixed = mixed.select("band", F.when(F.col("all") <= gathered, F.lit(1)).otherwise(F.ceil(F.col("all") / F.lit(gathered // 2))).cast("int").alias("k"))
    own = own.join(mixed, "band").withColumn("chunk", F.pmod(F.xxhash64("of_text"), F.col("k")).cast("int"))
    own = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("k") - 1))).withColumns({"i": F.least("chunk", "other"), "j": F.greatest("chunk", "other")})
    members = own.join(sets, "of_text").groupBy("band", "i", "j").agg(F.collect_list(F.struct("fp", "component", "chunk", "grams")).alias("members")).select("members")
    found = members.mapInArrow(_blocks(similarity), "a long, b long")
    return roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(found)


def _roots(distinct: DataFrame, docs: DataFrame, rows: DataFrame, bucket_limit: int, m: int | None, similarity: float | None) -> DataFrame:
    """(node, root) of the fingerprints that have links; rows: ``_rows`` of docs."""
    links = fingerprint_links(distinct, bucket_limit, m)
    if similarity is not None:
        links = similar_links(docs, rows, links, similarity)
    return written(components(links), "roots")


def _rows(docs: DataFrame, shingle: int, keys: dict[str, Column], similarity: float | None) -> DataFrame:
    """Everything that is worked out from a text by itself, in one pass."""
    if similarity is None:
        return written(with_fingerprints(docs, shingle, keys), "fingerprints")
    return written(with_fingerprints(docs, shingle, keys | {"of_text": F.xxhash64(F.col("text").cast("string"))}, LIKE_SHINGLE), "fingerprints")


def near_duplicates(docs: DataFrame, bucket_limit: int = BUCKET_LIMIT, shingle: int = SHINGLE, m: int | None = None, similarity: float | None = LIKE) -> DataFrame:
    """docs(doc_id, text, ...) to (doc_id, fingerprint, component_id), a row for each row of docs.

    Fingerprints within 4 bits are linked; unless ``similarity`` is None, so are
    texts whose sets of 5-word shingles have that Jaccard similarity or more.

    Null texts count as empty and have fingerprint 0, which links like any
    other.  A null doc_id is linked too; component_id is the smallest id that
    is not null, or null if the component has none.  Repeated rows give
    repeated rows; an empty table gives none.  Other columns are not read.
    """
    fps = _rows(docs, shingle, {}, similarity)
    least = written(fps.groupBy("fp").agg(F.min("doc_id").alias("low"), F.count("*").alias("n")), "distinct")
    roots = _roots(least.select("fp"), docs, fps, bucket_limit, m, similarity)
    linked = least.join(roots, least.fp == roots.node).select("fp", "root", "low")
    lows = linked.groupBy("root").agg(F.min("low").alias("component"))
    of_fp = least.join(linked.select("fp", "root").join(lows, "root").select("fp", "component"), "fp", "left").select(
        "fp", "n", F.when(F.col("component").isNull(), F.col("low")).otherwise(F.col("component")).alias("component_id")
    )
    # a fingerprint with more than one row in HOT_SHARE is hot; there are fewer than HOT_SHARE of them, so these are broadcast
    rows = least.agg(F.sum("n")).first()[0] or 0
    hot = F.broadcast(of_fp.where(F.col("n") * HOT_SHARE > rows).select("fp", "component_id", F.lit(True).alias("hot")))
    tagged = fps.join(hot, "fp", "left")
    cold = tagged.where("hot is null").select("fp", "doc_id").join(of_fp.where(F.col("n") * HOT_SHARE <= rows).select("fp", "component_id"), "fp")
    out = tagged.where("hot").select("fp", "doc_id", "component_id").unionByName(cold)
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _row_keys() -> dict[str, Column]:
    """Two digests of (doc_id, text) that tell rows apart; rows equal in both are repeats."""
    text = F.col("text").cast("string")
    parts = [F.coalesce(F.col("doc_id").cast("long"), F.lit(0)), F.col("doc_id").isNull(), F.coalesce(text, F.lit("")), text.isNull()]
    return {f"k{i}": F.xxhash64(F.lit(i), *parts) for i in (1, 2)}


def drop_near_duplicates(docs: DataFrame, bucket_limit: int = BUCKET_LIMIT, similarity: float | None = LIKE) -> DataFrame:
    """One row of each component of ``near_duplicates``, with all its columns; every text is judged by itself.

    The row with the smallest doc_id stays; a null id stays only if the
    component has no other.  Different texts that share an id are separate
    documents: each stays unless its own component has a smaller id.  If the
    smallest id has several texts in a component, one of them stays, the same
    on every run.  Of rows that repeat id and text one stays (which, should
    their other columns differ, is not defined).  Null and empty texts are alike, so one of
    them stays.  An empty table gives no rows.
    """
    fps = _rows(docs, SHINGLE, _row_keys(), similarity)
    row = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "k1", "k2").alias("row")
    least = written(fps.select("fp", row).groupBy("fp").agg(F.min("row").alias("row")), "least")
    roots = _roots(least.select("fp"), docs, fps, bucket_limit, None, similarity)
    first = least.join(roots, least.fp == roots.node, "left").groupBy(F.coalesce("root", "fp")).agg(F.min("row").alias("row")).select("row.k1", "row.k2")
    rows = docs.select(F.struct(*docs.columns).alias("d"), *(c.alias(k) for k, c in _row_keys().items()))
    return rows.dropDuplicates(["k1", "k2"]).join(first, ["k1", "k2"], "left_semi").select("d.*")
