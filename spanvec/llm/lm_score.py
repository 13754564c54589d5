"""Language-model scores: word unigrams and a subword lattice.

The base is a smoothed unigram model over words.  The model proper is a unigram
model over the pieces of an existing vocabulary: the probability of a word sums
over all its segmentations into pieces, by a forward recursion in log space, and
a text's is the product over its words and an end piece.  Characters outside the
vocabulary go by their bytes.

The vocabulary file holds merge ranks in place of log probabilities, so piece
probabilities come from the training words: first from the uses of pieces in the
vocabulary's own segmentations, then from expected uses over all segmentations
(forward and backward recursions), a few passes, each word weighing as often as it occurs.

Shape: one pass counts all distinct words (combined in each task before the
shuffle), so that pieces and lattices are worked out once a distinct word, not
once an occurrence.  A second pass scores texts: words frequent enough are looked
up in a broadcast table, which cannot have more than ``frequent`` entries of
bounded length; the others, of which each is rare, are joined with the word table.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import byte_words, session_ready, written

FREQUENT = 150_000
ALPHA = 0.1
#: Passes that put expected uses of pieces in place of the uses before.
PASSES = 2
#: Distinct words that a task combines before it passes them on.
COMBINED = 300_000
KEPT_CHARS = 64
SPACE = "▁"
#: Words and bytes that a task's lattices are worked out for at once, and cells (words x characters) of one matrix.
TOGETHER, BYTES, CELLS = 50_000, 1 << 22, 1 << 15
#: Characters that a lattice spans; a longer word is spelled in stretches of as many, with no piece across their borders.
LONGEST = 1 << 16


@lru_cache(maxsize=2)
def processor(path: str) -> sentencepiece.SentencePieceProcessor:
    return sentencepiece.SentencePieceProcessor(model_file=path)


def _mixed(codes: np.ndarray) -> np.ndarray:
    x = (codes.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


class Lattice:
    """All segmentations of words into pieces, for many words of one length at a time.

    A piece is found by the hash of its characters, which for every part of a
    word follows from two hashes of its beginnings.
    """

    FACTOR, SPREAD, SLOTS = np.uint64(0xD6E8FEB86659FD93), np.uint64(0xC2B2AE3D27D4EB4F), 20

    def __init__(self, path: str):
        sp = processor(path)
        self.size = sp.get_piece_size()
        self.bytes = np.zeros(256, np.int64)
        pieces = []
        for i in range(self.size):
            if sp.is_byte(i):
                self.bytes[int(sp.id_to_piece(i)[1:-1], 16)] = i
            elif not (sp.is_control(i) or sp.is_unknown(i)):
                pieces.append((i, sp.id_to_piece(i)))
        self.longest = max(len(p) for _, p in pieces)
        self.hashes, self.ids, self.probes = np.zeros(1 << self.SLOTS, np.uint64), np.full(1 << self.SLOTS, -1, np.int32), 1
        for i, piece in pieces:
            h = self.beginnings(self.codes([piece]))[:, -1]
            at, probe = int(self.slot(h)[0]), 0
            while self.ids[at] >= 0:
                at, probe = (at + 1) & ((1 << self.SLOTS) - 1), probe + 1
            self.hashes[at], self.ids[at], self.probes = h[0], i, max(self.probes, probe + 1)

    @staticmethod
    def codes(words: list[str]) -> np.ndarray:
        """Code points, a row for each word; all words have one length."""
        return np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).reshape(len(words), -1)

    def slot(self, h):
        return (h * self.SPREAD >> np.uint64(64 - self.SLOTS)).astype(np.int64)

    def beginnings(self, codes: np.ndarray) -> np.ndarray:
        """Hash of the first k characters, for every k."""
        out, own = np.zeros((codes.shape[0], codes.shape[1] + 1), np.uint64), _mixed(codes)
        with np.errstate(over="ignore"):
            for k in range(codes.shape[1]):
                out[:, k + 1] = out[:, k] * self.FACTOR + own[:, k]
        return out

    def found(self, begin: np.ndarray, n: int) -> np.ndarray:
        """Piece of the n characters from each place on, or -1."""
        with np.errstate(over="ignore"):
            factor = np.uint64(1)
            for _ in range(n):
                factor = factor * self.FACTOR
            h = begin[:, n:] - begin[:, :-n] * factor
            at = self.slot(h)
        out = np.full(h.shape, -1, np.int32)
        for probe in range(self.probes):
            here = (at + probe) & ((1 << self.SLOTS) - 1)
            out = np.where((self.hashes[here] == h) & (self.ids[here] >= 0), self.ids[here], out)
        return out

    def groups(self, words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Places of words that have one length, and their codes; all words in turn, those above LONGEST in stretches."""
        marked = [(i, s[k : k + LONGEST]) for i, w in enumerate(words) for s in (SPACE + w,) for k in range(0, len(s), LONGEST)]
        sizes = np.fromiter((len(s) for _, s in marked), np.int64, len(marked))
        order = np.argsort(sizes, kind="stable")
        for same in np.split(order, np.nonzero(np.diff(sizes[order]))[0] + 1):
            if len(same):
                for part in np.array_split(same, min(len(same), -(-len(same) * int(sizes[same[0]]) // CELLS))):
                    yield np.array([marked[k][0] for k in part]), self.codes([marked[k][1] for k in part])

    def arcs(self, codes: np.ndarray, log_p: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
        """Piece ids by length and place, and log probabilities by (word, end, length); characters without a piece have their bytes'."""
        begin, (rows, n) = self.beginnings(codes), codes.shape
        most = min(n, self.longest)
        ids = [self.found(begin, k) for k in range(1, most + 1)]
        of = np.append(log_p, -np.inf)
        arcs = np.full((rows, n, most), -np.inf)
        for k, found in enumerate(ids):
            arcs[:, k:, k] = of[found]
        for c in np.unique(codes[ids[0] < 0]):
            arcs[:, :, 0][(codes == c) & (ids[0] < 0)] = log_p[self.bytes[list(chr(c).encode())]].sum()
        return ids, arcs

    @staticmethod
    def _sum(terms: np.ndarray) -> np.ndarray:
        top = terms.max(axis=1)
        return top + np.log(np.exp(terms - top[:, None]).sum(axis=1))

    def forward(self, arcs: np.ndarray) -> np.ndarray:
        """f[:, j]: log probability of all ways to spell the first j characters."""
        rows, n, most = arcs.shape
        f = np.zeros((rows, n + 1))
        for j in range(1, n + 1):
            m = min(j, most)
            f[:, j] = self._sum(arcs[:, j - 1, :m] + f[:, j - m : j][:, ::-1])
        return f

    def log10(self, words: list[str], log_p: np.ndarray) -> np.ndarray:
        """Log10 probability of each word, summed over all its segmentations."""
        out = np.zeros(len(words))
        for at, codes in self.groups(words):
            np.add.at(out, at, self.forward(self.arcs(codes, log_p)[1])[:, -1] / math.log(10))
        return out

    def expected(self, words: list[str], weights: np.ndarray, log_p: np.ndarray) -> np.ndarray:
        """Expected uses of each piece in the words, each taken ``weights`` times."""
        out = np.zeros(self.size)
        for at, codes in self.groups(words):
            ids, arcs = self.arcs(codes, log_p)
            rows, n, most = arcs.shape
            f, b, own = self.forward(arcs), np.zeros((rows, n + 1)), weights[at][:, None]
            for i in range(n - 1, -1, -1):
                m = min(n - i, most)
                b[:, i] = self._sum(np.stack([arcs[:, i + k, k] for k in range(m)], axis=1) + b[:, i + 1 : i + m + 1])
            for k, found in enumerate(ids):
                uses = np.exp(f[:, : n - k] + arcs[:, k:, k] + b[:, k + 1 :] - f[:, -1:]) * own
                known = found >= 0
                out += np.bincount(found[known], uses[known], self.size)
                if k == 0:
                    for c in np.unique(codes[~known]):
                        for byte in chr(c).encode():
                            out[self.bytes[byte]] += uses[~known & (codes == c)].sum()
        return out


@lru_cache(maxsize=2)
def lattice(path: str) -> Lattice:
    return Lattice(path)


def together(batches) -> Iterator[pa.Table]:
    """Batches put together to TOGETHER rows or BYTES bytes, about."""
    held, rows, size = [], 0, 0
    for b in batches:
        held.append(b)
        rows, size = rows + b.num_rows, size + b.nbytes
        if rows >= TOGETHER or size >= BYTES:
            yield pa.Table.from_batches(held)
            held, rows, size = [], 0, 0
    if rows:
        yield pa.Table.from_batches(held)


def _spelled(column) -> list[str]:
    return [w.decode("utf-8", "replace") for w in column.to_pylist()]


def _word_counts(batches):
    """(word, c, seen): occurrences in training texts and in all, combined within the task."""
    c, seen = Counter(), Counter()

    def flush():
        words = list(seen)
        out = pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), pa.array([c[w] for w in words], pa.int64()), pa.array(list(seen.values()), pa.int64())], ["word", "c", "seen"])
        c.clear()
        seen.clear()
        return out

    for b in batches:
        for text, held in zip(b.column("text").cast(pa.binary()).to_pylist(), b.column("held_out").to_pylist()):
            words = byte_words(text)
            seen.update(words)
            if not held:
                c.update(words)
        if len(seen) >= COMBINED:
            yield flush()
    yield flush()


def discount(once: int, twice: int) -> float:
    """What is taken off each seen word's count, from the numbers of words seen once and twice."""
    return min(0.9, max(0.1, once / (once + 2 * twice))) if once else 0.5


def normalised(uses: np.ndarray, n_ends: int) -> tuple[np.ndarray, float]:
    """Natural log probability of each piece and of the end piece, ALPHA added to each."""
    total = math.log(uses.sum() + n_ends + ALPHA * (len(uses) + 1))
    return np.log(uses + ALPHA) - total, math.log(n_ends + ALPHA) - total


def piece_log_probabilities(words: DataFrame, n_ends: int, path: str, passes: int = PASSES) -> tuple[np.ndarray, float]:
    """words(word, c): natural log probability of each piece of the vocabulary and of the end piece.

    Partition sums of piece uses are shuffled by piece; the driver gets one
    number for each piece of the vocabulary, and gives them out for the next pass.
    """
    spark, size = words.sparkSession, processor(path).get_piece_size()

    def gathered(sums) -> np.ndarray:
        out = np.zeros(size)
        for r in words.where("c > 0").select("word", "c").mapInArrow(sums, "piece int, n double").groupBy("piece").agg(F.sum("n").alias("n")).collect():
            out[r["piece"]] = r["n"]
        return out

    def first(batches):
        sp, total = processor(path), np.zeros(size)
        for b in together(batches):
            c = b.column("c").to_numpy()
            ids = sp.encode(_spelled(b.column("word")), num_threads=1)
            total += np.bincount(np.fromiter((i for x in ids for i in x), np.int64), np.repeat(c, [len(x) for x in ids]), size)
        yield from used(total)

    def used(total):
        at = np.nonzero(total)[0]
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at])], ["piece", "n"])

    log_p, log_end = normalised(gathered(first), n_ends)
    for _ in range(passes):
        shared = spark.sparkContext.broadcast(log_p)

        def again(batches, shared=shared):
            total = np.zeros(size)
            for b in together(batches):
                total += lattice(path).expected(_spelled(b.column("word")), b.column("c").to_numpy().astype(float), shared.value)
            yield from used(total)

        log_p, log_end = normalised(gathered(again), n_ends)
    return log_p, log_end


def _least_frequent(words: DataFrame, most: int) -> int:
    """The least power of two such that at most ``most`` words occur as often. Gets at most 64 rows."""
    by_size = words.groupBy(F.floor(F.log2("seen")).cast("int").alias("b")).count().orderBy(F.desc("b")).collect()
    total, least = 0, 62
    for r in by_size:
        total += r["count"]
        if total > most:
            break
        least = r["b"]
    return 1 << least


def lm_scores(docs: DataFrame, path: str, held_out: Column, frequent: int = FREQUENT, passes: int = PASSES) -> DataFrame:
    """docs(doc_id, text, ...) to (doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, word_score), a row for each row.

    held_out: boolean column; rows for which it is true (or null) are not
    learned from.  A-Z are lower-cased; tokens are words and one end for each
    text.  Scores are log10 probabilities.  score is the lattice's;
    word_score that of a word model which gives seen words their discounted
    share and leaves what is taken off to the lattice.  Null and empty texts
    have the end alone.  Repeated rows and ids keep their rows.  Without
    training rows every token is unknown, and scores stay finite.  An empty
    table gives no rows.  Other columns are not read.
    """
    spark = session_ready(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.coalesce(held_out, F.lit(True)).alias("held_out"))
    words = rows.select("text", "held_out").mapInArrow(_word_counts, "word binary, c long, seen long").groupBy("word").agg(F.sum("c").alias("c"), F.sum("seen").alias("seen"))
    words = written(words, "words")
    n_ends = rows.where(~F.col("held_out")).count()
    total = words.agg(F.sum("c").alias("n"), *(F.count_if(cond).alias(k) for k, cond in (("v", F.col("c") > 0), ("once", F.col("c") == 1), ("twice", F.col("c") == 2)))).first()
    n_words, off = total["n"] or 0, discount(total["once"], total["twice"])
    n, v = n_words + n_ends, total["v"] + (n_ends > 0)
    log_p, log_end = piece_log_probabilities(words, n_ends, path, passes)
    shared = spark.sparkContext.broadcast(log_p)

    def lattices(batches):
        for b in together(batches):
            yield from b.append_column("lattice", pa.array(lattice(path).log10(_spelled(b.column("word")), shared.value))).to_batches()

    base = lambda c: math.log10((c + ALPHA) / (n + ALPHA * (v + 1)))
    words = words.mapInArrow(lattices, "word binary, c long, seen long, lattice double")
    left = off * total["v"] / n_words if n_words else 1.0
    own = F.log10((F.col("c") - off) / max(1, n_words) + left * F.pow(F.lit(10.0), F.col("lattice")))
    words = written(words.withColumn("blend", F.when(F.col("c") > 0, own).otherwise(F.col("lattice") + math.log10(left))), "lattices")
    least = _least_frequent(words, frequent)
    hot = words.where((F.col("seen") >= least) & (F.length("word") <= KEPT_CHARS)).select("word", "c", "lattice", "blend").toLocalIterator()
    table = spark.sparkContext.broadcast({bytes(r["word"]): (base(r["c"]), r["c"] > 0, r["lattice"], r["blend"]) for r in hot})

    def scored(batches):
        get, row = table.value.get, TaskContext.get().partitionId() << 33
        for b in batches:
            out = []
            for text in b.column("text").cast(pa.binary()).to_pylist():
                s = byte_words(text)
                known, base_sum, lattice_sum, blend_sum, rare = 0, 0.0, 0.0, 0.0, Counter()
                for w in s:
                    hit = get(w)
                    if hit is None:
                        rare[w] += 1
                    else:
                        base_sum += hit[0]
                        known += hit[1]
                        lattice_sum += hit[2]
                        blend_sum += hit[3]
                out.append((row, len(s) + 1, known, base_sum, lattice_sum, blend_sum, list(rare), list(rare.values())))
                row += 1
            types = [pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.list_(pa.binary()), pa.list_(pa.int32())]
            cols = [pa.array(c, t) for c, t in zip(zip(*out) if out else [()] * 8, types)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), *cols], ["doc_id", "held_out", "row", "n_tokens", "known", "base", "lattice", "blend", "rare", "times"])

    texts = written(rows.mapInArrow(scored, "doc_id long, held_out boolean, row long, n_tokens long, known long, base double, lattice double, blend double, rare array<binary>, times array<int>"), "scored")
    rare = texts.where(F.size("rare") > 0).select("row", F.explode(F.arrays_zip("rare", "times")).alias("x")).select("row", F.col("x.rare").alias("word"), F.col("x.times").alias("times"))
    of_word = rare.join(words.select("word", "c", F.col("lattice").alias("l"), F.col("blend").alias("m")), "word")
    log_c = F.log10((F.col("c") + ALPHA) / F.lit(n + ALPHA * (v + 1)))
    of_times = lambda x, name: F.sum(x * F.col("times")).alias(name)
    sums = of_word.groupBy("row").agg(F.sum(F.when(F.col("c") > 0, F.col("times")).otherwise(F.lit(0))).alias("known2"), of_times(log_c, "base2"), of_times(F.col("l"), "lattice2"), of_times(F.col("m"), "blend2"))
    plus = lambda a, b, end: F.col(a) + F.coalesce(F.col(b), F.lit(0)) + F.lit(end)
    end = log_end / math.log(10)
    return texts.drop("rare", "times").join(sums, "row", "left").select(
        "doc_id", "held_out", "n_tokens", plus("known", "known2", int(n_ends > 0)).cast("long").alias("n_known"), F.lit(n).cast("long").alias("train_tokens"),
        plus("base", "base2", base(n_ends)).alias("base_score"), plus("lattice", "lattice2", end).alias("score"), plus("blend", "blend2", end).alias("word_score"),
    )
