"""License scans: winnowed template fingerprints, an inverted index, banded alignment.

Long templates are winnowed: of every ``WINDOW`` neighbouring hashes of ``GRAM`` words
the least is kept, and an inverted index maps it to templates and positions.  A
text looks up all its word triples (not only winnowed ones, so no template passage
of GRAM + WINDOW - 1 words is missed); triples with a word that no template has
are passed over.  A local alignment within a band around a hit's diagonal gives a
passage; its words are masked and the hits left are aligned again, so that
notices that follow each other closely are all found.  Passages in the template's
order, with words inserted between them, are chained before coverage is judged.

The index has the size of the templates and travels with the code; texts are
scanned where they are, nothing is shuffled.
"""

from __future__ import annotations

import re
from collections import defaultdict
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import session_ready
from .license_texts import TEMPLATES

GRAM, WINDOW, BAND = 3, 4, 8
LEAST_COVERAGE = 0.8
#: Templates of at most so many words have all their triples in the index; those of PAIRED words also their
#: pairs, as one edit can break all three triples and leave LEAST_COVERAGE.
SHORT, PAIRED = 32, 5
WORD = re.compile(r"[a-z0-9]+")


def low_ascii(text: str) -> str:
    """A-Z in lower case, one character for each."""
    return text.translate(_LOW)


_LOW = {c: c + 32 for c in range(65, 91)}


class Index:
    def __init__(self, templates: dict[str, str]):
        self.names = sorted(templates)
        self.vocabulary: dict[str, int] = {}
        self.words = [[self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in WORD.findall(low_ascii(templates[n]))] for n in self.names]
        self.grams: dict[int, list[tuple[int, int]]] = defaultdict(list)
        self.pairs: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for t, words in enumerate(self.words):
            keys = self.keys(np.array(words, np.int64))
            if len(words) <= SHORT:
                for j, k in enumerate(keys.tolist()):
                    self.grams[k].append((t, j))
                if len(words) == PAIRED:
                    for j, (a, b) in enumerate(zip(words, words[1:])):
                        self.pairs[(a << 20) | b].append((t, j))
                continue
            mixed = [(k * 0x9E3779B97F4A7C15) & (2**64 - 1) for k in keys.tolist()]
            kept = {min(range(i, min(i + WINDOW, len(mixed))), key=lambda j: (mixed[j], -j)) for i in range(max(1, len(mixed) - WINDOW + 1))} if mixed else set()
            for j in sorted(kept):
                self.grams[int(keys[j])].append((t, j))
        self.known = np.array(sorted(self.grams), np.int64)
        self.known_pairs = np.array(sorted(self.pairs), np.int64)

    def keys(self, w: np.ndarray) -> np.ndarray:
        """A number for each word triple; 0 if a word is in no template."""
        if len(w) < GRAM:
            return np.zeros(0, np.int64)
        a, b, c = w[:-2], w[1:-1], w[2:]
        return np.where((a > 0) & (b > 0) & (c > 0), (a << 40) | (b << 20) | c, 0)

    def matches(self, text: str) -> list[tuple[str, float, int, int]]:
        """(template, coverage, start, end) by start, of coverage LEAST_COVERAGE or more; offsets in characters, end exclusive."""
        return [m for m in self.passages(text) if m[1] >= LEAST_COVERAGE]

    def passages(self, text: str) -> list[tuple[str, float, int, int]]:
        """As matches, of any coverage; a passage below LEAST_COVERAGE has GRAM or more matched words."""
        found = WORD.findall(low_ascii(text))
        w = np.fromiter((self.vocabulary.get(x, 0) for x in found), np.int64, len(found))
        hits: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
        keys = self.keys(w)
        for i in np.nonzero(np.isin(keys, self.known))[0].tolist():
            for t, j in self.grams[int(keys[i])]:
                hits[t].append((i, j, GRAM))
        keys = (w[:-1] << 20) | w[1:]
        for i in np.nonzero(np.isin(keys, self.known_pairs))[0].tolist():
            for t, j in self.pairs[int(keys[i])]:
                hits[t].append((i, j, 2))
        if not hits:
            return []
        offsets = [m.span() for m in WORD.finditer(low_ascii(text))]
        out, codes = [], w.tolist()
        for t, places in hits.items():
            n = len(self.words[t])
            for s, e, matched in chained(self.pieces(codes, t, places), n):
                if matched >= min(GRAM, n) or matched >= LEAST_COVERAGE * n:
                    out.append((self.names[t], matched / n, offsets[s][0], offsets[e][1]))
        return sorted(out, key=lambda x: (x[2], x[3], x[0]))

    def pieces(self, w: list[int], t: int, hits: list[tuple[int, int, int]]) -> list[tuple[int, int, int, int, int]]:
        """Disjoint passages of the text that align with template t, one or more for all hits (text word, template word, length).

        A passage is first and last word of the text, first and last word of the
        template, and number of matched words.  Its words are masked, and what
        is left of the hits is aligned again, so repeated notices are all found.
        Hits with most others in their band come first, so that chance hits take
        no words of a passage next to them.
        """
        out, taken = [], set()
        diagonal = np.array([i - j for i, j, _ in hits])
        line = np.sort(diagonal)
        others = np.searchsorted(line, diagonal + BAND, "right") - np.searchsorted(line, diagonal - BAND)
        for i, j, n in (hits[k] for k in np.argsort(-others, kind="stable").tolist()):
            while taken.isdisjoint(range(i, i + n)):
                s = self.align(w, t, i - j, taken)
                out.append(s)
                taken.update(range(s[0], s[1] + 1))
        return sorted(out)

    def align(self, w: list[int], t: int, diagonal: int, taken: set[int]) -> tuple[int, int, int, int, int]:
        """Local alignment of template t with the words on diagonals up to BAND from the given one; words in ``taken`` are walls.

        A match counts 2, a gap or a mismatch -1.  Returns first and last
        matched word of the text and of the template, and the matched words.
        """
        words, first, width = self.words[t], diagonal - BAND, 2 * BAND + 1
        none = (0, 0, -1, -1, -1, -1)
        row, best = [none] * (width + 1), none
        for j, word in enumerate(words):
            new, left = [none] * (width + 1), none
            for k in range(width):
                i = j + first + k
                if not 0 <= i < len(w) or i in taken:
                    left = none
                    continue
                s, m, a, b, c, d = row[k]
                cell = (s + 2, m + 1, i if a < 0 else a, i, j if c < 0 else c, j) if w[i] == word else (s - 1, m, a, b, c, d)
                up = row[k + 1]
                if up[0] - 1 > cell[0]:
                    cell = (up[0] - 1, *up[1:])
                if left[0] - 1 > cell[0]:
                    cell = (left[0] - 1, *left[1:])
                new[k] = left = cell if cell[0] > 0 else none
                if left[:2] > best[:2]:
                    best = left
            row = new
        return (*best[2:], best[1])


def chained(pieces: list[tuple[int, int, int, int, int]], n: int) -> list[tuple[int, int, int]]:
    """Passages (first word, last word, matched words) of pieces of a template of n words, by text position.

    Pieces join if they have the template's order, at most n words lie between
    them, and they have few template words in common, which count once.  Of
    chains that share a piece the one with most matched words takes it; every
    piece is in one passage.
    """
    best: list[tuple[int, int, int]] = []  # matched words, start of the chain, piece before
    for x, (s, _, c, d, m) in enumerate(pieces):
        best.append((m, s, -1))
        for y in range(x - 1, -1, -1):
            _, e, c0, d0, m0 = pieces[y]
            if s - e - 1 > n:
                break
            common = max(0, d0 - c + 1)
            if c > c0 and d > d0 and common <= min(BAND, m // 2, m0 // 2) and (best[y][0] + m - common, best[y][1]) > best[x][:2]:
                best[x] = (best[y][0] + m - common, best[y][1], y)
    out, used = [], set()
    for x in sorted(range(len(pieces)), key=lambda x: (-best[x][0], x)):
        at, last, matched = x, pieces[x][1], 0
        while at >= 0 and at not in used:
            used.add(at)
            start, before = pieces[at][0], best[at][2]
            joined = before >= 0 and before not in used
            matched += pieces[at][4] - (max(0, pieces[before][3] - pieces[at][2] + 1) if joined else 0)
            at = before
        if matched:
            out.append((start, last, matched))
    return sorted(out)


@lru_cache(maxsize=4)
def _index(templates: tuple[tuple[str, str], ...]) -> Index:
    return Index(dict(templates))


def scan(docs: DataFrame, templates: dict[str, str] | None = None) -> DataFrame:
    """docs(doc_id, text, ...) to (doc_id, matches, partial), a row for each row of docs.

    Both are arrays of (template, coverage, s, e); partial has the passages
    whose coverage is below LEAST_COVERAGE.
    Null, empty and unlicensed texts have empty arrays.  Repeated rows have
    equal matches; null ids keep their rows.  Other columns are not read.
    """
    session_ready(docs.sparkSession)
    given = tuple(sorted((templates or TEMPLATES).items()))
    fields = [("template", pa.string()), ("coverage", pa.float64()), ("s", pa.int32()), ("e", pa.int32())]
    names, spans = [n for n, _ in fields], "array<struct<template:string,coverage:double,s:int,e:int>>"

    def run(batches):
        index = _index(given)
        for b in batches:
            found = [index.passages(t or "") for t in b.column("text").to_pylist()]
            split = [[[dict(zip(names, m)) for m in ms if (m[1] >= LEAST_COVERAGE) == whole] for ms in found] for whole in (True, False)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(x, pa.list_(pa.struct(fields))) for x in split)], ["doc_id", "matches", "partial"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, f"doc_id long, matches {spans}, partial {spans}")
