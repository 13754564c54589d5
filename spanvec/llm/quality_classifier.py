"""Quality classifier: ridge regression on random Fourier features, calibrated.

A few statistics of each text are standardised and mapped to cosines of random
projections, whose inner products approximate a Gaussian kernel.  Partitions sum
the normal equations of their labelled rows, by fold; the driver adds the sums
and solves them.  Scores of rows by the model that was fitted without their fold
then give an isotonic (monotone) map from scores to the share of label 1.

The labels used are bounded by ``max_labels``; every document is scored.
"""

from __future__ import annotations

from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import session_ready, written

MAX_LABELS = 200_000
FEATURES = 192
GAMMA = 0.08
RIDGE = 1e-3
FOLDS = 5
SEED = 20240229
SUM_TASKS = 16

_CLASSES = ["lower", "upper", "digit", "blank", "newline", "stop", "comma", "shout", "symbol", "quote", "other", "wide"]
_CLASS = np.full(256, _CLASSES.index("other"), np.uint8)
for _name, _chars in (
    ("lower", b"abcdefghijklmnopqrstuvwxyz"), ("upper", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"), ("digit", b"0123456789"), ("blank", b" \t\x0b\x0c\r"),
    ("newline", b"\n"), ("stop", b"."), ("comma", b",;:"), ("shout", b"!?"), ("symbol", b"#*$%&|<>~^=_@{}\\/+"), ("quote", b"\"'()[]`-"),
):
    _CLASS[list(_chars)] = _CLASSES.index(_name)
_CLASS[128:] = _CLASSES.index("wide")
STATISTICS = ("log_words", "word_length", "upper", "digit", "symbol", "shout", "stop", "comma", "quote", "wide", "other", "line_words", "dup_lines", "distinct_words", "long_words", "marked_words", "repeats")
STEP = 1 << 20


def statistics(text: bytes | None) -> list[float]:
    """STATISTICS of a whole text in UTF-8; a text without words has zeros."""
    words = (text or b"").split()
    n = len(words)
    if not n:
        return [0.0] * len(STATISTICS)
    counts = np.zeros(len(_CLASSES))
    raw = np.frombuffer(text, np.uint8)
    for at in range(0, len(raw), STEP):
        counts += np.bincount(_CLASS[raw[at : at + STEP]], minlength=len(_CLASSES))
    c = dict(zip(_CLASSES, counts))
    lines = [x for x in text.split(b"\n") if x.strip()]
    sizes = np.fromiter(map(len, words), np.int64, n)
    letters = max(1.0, c["lower"] + c["upper"] + c["wide"] / 2)
    marked = sum([w[-1] in b"#*$%&|!?" for w in words])
    return [
        np.log1p(n), sizes.mean(), c["upper"] / letters, c["digit"] / n, min(4.0, c["symbol"] / n), min(4.0, c["shout"] / n), min(4.0, c["stop"] / n), min(4.0, c["comma"] / n), min(4.0, c["quote"] / n),
        c["wide"] / letters, min(4.0, c["other"] / n), np.log1p(n / len(lines)), 1 - len(set(lines)) / len(lines), len(set(words)) / n ** 0.9, float((sizes > 20).mean()), marked / n, sum(map(eq, words, words[1:])) / n,
    ]


def with_statistics(docs: DataFrame) -> DataFrame:
    """(doc_id, x array<float>) for each row of docs; the only columns read are doc_id and text."""
    session_ready(docs.sparkSession)

    def run(batches):
        for b in batches:
            x = [statistics(t) for t in b.column("text").cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(x, pa.list_(pa.float32()))], ["doc_id", "x"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, x array<float>")


def _matrix(column) -> np.ndarray:
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), float).reshape(len(column), -1)


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray | None
    knots: np.ndarray
    levels: np.ndarray

    def features(self, x: np.ndarray) -> np.ndarray:
        rng = np.random.Generator(np.random.PCG64(SEED))
        w = rng.normal(size=(len(STATISTICS), FEATURES)) * np.sqrt(2 * GAMMA)
        b = rng.uniform(0, 2 * np.pi, FEATURES)
        z = np.clip((x - self.mean) / self.scale, -6, 6)
        return np.hstack([np.sqrt(2 / FEATURES) * np.cos(z @ w + b), np.ones((len(x), 1))])

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.weights is None:
            return np.full(len(x), self.levels[0])
        return np.interp(self.features(x) @ self.weights, self.knots, self.levels)


def isotonic(score: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots and rising levels of the least-squares monotone fit, by pooling adjacent violators; equal scores are pooled first."""
    at, back = np.unique(score, return_inverse=True)
    weight = np.bincount(back).astype(float)
    mean = np.bincount(back, weights=label) / weight
    stack: list[list[float]] = []
    for x, m, w in zip(at, mean, weight):
        stack.append([m, w, x, x])
        while len(stack) > 1 and stack[-2][0] >= stack[-1][0]:
            m2, w2, _, high = stack.pop()
            m1, w1, low, _ = stack.pop()
            stack.append([(m1 * w1 + m2 * w2) / (w1 + w2), w1 + w2, low, high])
    knots = np.array([k for s in stack for k in (s[2], s[3])])
    levels = np.array([s[0] for s in stack for _ in (0, 1)])
    keep = np.concatenate([[True], np.diff(knots) > 0])
    return knots[keep], levels[keep]


def _solve(gram: np.ndarray, n: float) -> np.ndarray:
    a, b = gram[:-1, :-1], gram[:-1, -1]
    return np.linalg.solve(a + RIDGE * max(1.0, n) * np.eye(len(a)) / FEATURES, b)


def fit(labelled: DataFrame, max_labels: int = MAX_LABELS) -> Model:
    """labelled(doc_id, x, y), a stored table, as it is read several times: y is 0 or 1. At most about ``max_labels`` rows are used, chosen by a hash of doc_id."""
    n = labelled.count()
    if n > max_labels:
        labelled = labelled.where(F.pmod(F.xxhash64(F.lit(SEED), "doc_id"), F.lit(n)) < max_labels)
    rows = labelled.select("x", F.col("y").cast("double").alias("y"), F.pmod(F.xxhash64("doc_id"), F.lit(FOLDS)).cast("int").alias("fold")).coalesce(SUM_TASKS)
    stat = rows.select("y", F.posexplode("x").alias("i", "v")).groupBy("i").agg(F.avg("v").alias("m"), F.stddev_pop("v").alias("s"), F.avg("y").alias("y")).orderBy("i").collect()
    if not stat:
        return Model(np.zeros(len(STATISTICS)), np.ones(len(STATISTICS)), None, np.zeros(1), np.array([0.5]))
    model = Model(np.array([r["m"] for r in stat]), np.array([max(r["s"], 1e-6) for r in stat]), None, np.zeros(1), np.array([stat[0]["y"]]))

    def sums(batches):
        gram, count = np.zeros((FOLDS, FEATURES + 2, FEATURES + 2)), np.zeros(FOLDS)
        for b in batches:
            z = np.hstack([model.features(_matrix(b.column("x"))), b.column("y").to_numpy()[:, None]])
            fold = b.column("fold").to_numpy()
            for k in range(FOLDS):
                own = z[fold == k]
                gram[k] += own.T @ own
                count[k] += len(own)
        yield pa.RecordBatch.from_arrays([pa.array(range(FOLDS), pa.int32()), pa.array(count), pa.array(gram.reshape(FOLDS, -1).tolist(), pa.list_(pa.float64()))], ["fold", "n", "gram"])

    gram, count = np.zeros((FOLDS, FEATURES + 2, FEATURES + 2)), np.zeros(FOLDS)
    for r in rows.mapInArrow(sums, "fold int, n double, gram array<double>").toLocalIterator():
        gram[r["fold"]] += np.reshape(r["gram"], gram.shape[1:])
        count[r["fold"]] += r["n"]
    without = np.stack([_solve(gram.sum(0) - gram[k], count.sum() - count[k]) for k in range(FOLDS)])

    def apart(batches):
        for b in batches:
            z = model.features(_matrix(b.column("x")))
            yield pa.RecordBatch.from_arrays([pa.array((z * without[b.column("fold").to_numpy()]).sum(1)), b.column("y")], ["s", "y"])

    pairs = rows.mapInArrow(apart, "s double, y double").toPandas()
    model.weights = _solve(gram.sum(0), count.sum())
    model.knots, model.levels = isotonic(pairs["s"].to_numpy(), pairs["y"].to_numpy())
    return model


def train(x: DataFrame, labels: DataFrame, held_out=None, max_labels: int = MAX_LABELS) -> Model:
    """x(doc_id, x), labels(doc_id, quality, ...): the model of the labelled rows; those that are held out are not learned from."""
    known = labels.where("quality is not null and doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((F.avg("quality") >= 0.5).cast("int").alias("y"))
    if held_out is not None:
        known = known.where(~held_out)
    return fit(written(x.join(known, "doc_id"), "known"), max_labels)


def classify(docs: DataFrame, labels: DataFrame, held_out=None, max_labels: int = MAX_LABELS) -> DataFrame:
    """docs(doc_id, text, ...), labels(doc_id, quality, ...) to (doc_id, score), a row for each row of docs.

    score: estimated chance of quality 1, from the text alone.  held_out: a
    boolean column of doc_id; rows for which it is true are never learned from.
    Null labels are ignored; several labels of a document count as their
    rounded mean.  Null and empty texts are scored as texts without words.
    Without any label every score is 0.5.  Null ids are scored but not learned
    from; repeated rows have equal scores.
    """
    x = written(with_statistics(docs), "statistics")
    model = train(x, labels, held_out, max_labels)

    def run(batches):
        for b in batches:
            s = model.score(_matrix(b.column("x"))) if b.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(s)], ["doc_id", "score"])

    return x.mapInArrow(run, "doc_id long, score double")


def keep_good(docs: DataFrame, labels: DataFrame, least: float, held_out=None, max_labels: int = MAX_LABELS) -> DataFrame:
    """Rows of docs that score ``least`` or more, with all their columns; scores are those of ``classify``.

    Each row is judged by its own text where it is, whatever its id: texts
    pass twice through the workers but are not shuffled.
    """
    model = train(with_statistics(docs), labels, held_out, max_labels)

    def score(text: pa.Array) -> pa.Array:
        x = np.array([statistics(t) for t in text.cast(pa.binary()).to_pylist()], np.float32).astype(float)
        return pa.array(model.score(x.reshape(-1, len(STATISTICS))), pa.float64())

    return docs.where(F.arrow_udf(score, "double")(F.col("text").cast("string")) >= least)
