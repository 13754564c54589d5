"""Byte-level BPE encoding and decoding by forced-boundary splitting.

A pair of bytes that stands side by side inside no vocabulary token can never
be merged over, so it marks a certain cut: the two sides are encoded apart and
their ids put one after the other.  The table of pairs is computed from the
vocabulary.

Cuts are used twice.  In the text, a cut before white space also leaves the
pre-tokenizer's splits alone (no pre-token has white space after anything
else, and its look-ahead only looks at what follows white space), so the text
falls into fragments of white space followed by other characters.  Within a
pre-token of a fragment, every forced pair is cut.  Fragments repeat, so each
worker keeps the ids of those it has seen in a table of bounded size; what it
forgets is encoded again.
"""

from __future__ import annotations

import hashlib
import json
import re
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from ._common import per_batch, session_ready

#: Unicode's White_Space, as the pre-tokenizer's pattern has it; for a character class.
SPACES = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Entries of one generation of a table of seen fragments; two are held.
GENERATION = 200_000
#: Fragments longer than this are not kept, so that entries have a bounded size.
KEPT_CHARS = 64
#: Below this all letters and numbers have long been assigned, so that any Unicode version classes them alike, and none combines.
SETTLED = "\u0250"


#: The byte-level pre-tokenizer's pattern.
PRE_TOKEN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+").findall


class Seen(dict):
    """A table that forgets: when it is full it becomes the old generation, from which hits are moved up."""

    def __init__(self, make):
        self.make, self.old = make, {}

    def __missing__(self, fragment: str):
        if (found := self.old.get(fragment)) is None:
            found = self.make(fragment)
            if len(fragment) > KEPT_CHARS:
                return found
        if len(self) >= GENERATION:
            self.old = dict(self)
            self.clear()
        self[fragment] = found
        return found


def byte_chars() -> dict[str, int]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class ForcedBoundaryBPE:
    """Encoder and decoder for a tokenizers file with a byte-level pre-tokenizer and a BPE model.

    Gives what the library gives with add_special_tokens=False; strings of
    added tokens in a text become their ids, as by its default.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        tokenizer = self.tokenizer = Tokenizer.from_file(path)
        self.tokenize, self.pre_tokenize = tokenizer.model.tokenize, tokenizer.pre_tokenizer.pre_tokenize_str
        of = self.of_char = byte_chars()
        self.to_chars = {b: c for c, b in of.items()}
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.by_id = {i: bytes(map(of.__getitem__, t)) for t, i in spec["model"]["vocab"].items()}
        inside = np.zeros((256, 256), bool)
        for t in self.by_id.values():
            inside[list(t[:-1]), list(t[1:])] = True
        #: Pairs of bytes, as characters of the vocabulary, that stand in no token.
        self.forced = {(self.to_chars[a], self.to_chars[b]) for a, b in zip(*np.nonzero(~inside))}
        self.by_id |= {i: t.encode() for t, i in self.special.items()}
        self.names = {i: str(i) for i in self.by_id}
        self.ids = {i: i for i in self.by_id}
        #: White space after another character is cut only if that stands in no token, so that the pair is forced there.
        #: (The vocabulary has pairs A0 20, but in runs of no-break spaces, which are white space and stay whole.)
        certain = not any(re.search(f"[^{SPACES}][\t\n\x0b\x0c\r ]", t.decode("utf-8", "replace")) for t in self.by_id.values())
        self.fragments = re.compile(f"[{SPACES}]*[^{SPACES}]+|[{SPACES}]+" if certain else r"(?s:.+)").findall
        self.specials = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")").split if self.special else None
        self.seen = Seen(self.encode_fragment)

    def pieces(self, pre_token: str) -> list[str]:
        """A pre-token, in the vocabulary's characters, cut at every forced pair."""
        if self.forced.isdisjoint(zip(pre_token, pre_token[1:])):
            return [pre_token]
        cuts = [i for i, pair in enumerate(zip(pre_token, pre_token[1:]), 1) if pair in self.forced]
        return [pre_token[i:j] for i, j in zip([0, *cuts], [*cuts, len(pre_token)])]

    def pre_tokens(self, fragment: str) -> list[str]:
        """The pre-tokenizer's pieces of a fragment, in the vocabulary's characters."""
        if fragment.isascii() and fragment[fragment[0] == " " :].isalpha():
            return [fragment.replace(" ", self.to_chars[32])]
        if max(fragment) < SETTLED:
            return [x.encode().decode("latin-1").translate(self.to_chars) for x in PRE_TOKEN(fragment)]
        return [x for x, _ in self.pre_tokenize(fragment)]

    def encode_fragment(self, fragment: str) -> tuple[int, ...]:
        tokenize, ids = self.tokenize, self.ids
        return tuple([ids[t.id] for p in self.pre_tokens(fragment) for x in self.pieces(p) for t in tokenize(x)])

    def encode(self, text: str) -> list[int]:
        seen = self.seen
        if not any([x in text for x in self.special]):
            return list(chain.from_iterable([seen[f] for f in self.fragments(text)]))
        out: list[int] = []
        for k, part in enumerate(self.specials(text)):
            if k % 2:
                out.append(self.special[part])
            else:
                out.extend(chain.from_iterable([seen[f] for f in self.fragments(part)]))
        return out

    def decode(self, ids) -> str:
        """Text of the ids, special tokens included; bytes that are no UTF-8 become U+FFFD."""
        return b"".join(map(self.by_id.__getitem__, ids)).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def encoder(path: str) -> ForcedBoundaryBPE:
    return ForcedBoundaryBPE(path)


def _id_text(docs: DataFrame) -> DataFrame:
    session_ready(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def encode(docs: DataFrame, path: str) -> DataFrame:
    """docs(doc_id, text, ...) to (doc_id, ids array<int>), a row for each row; null and empty texts have no ids.

    Map-only: nothing is shuffled, so hot sources and repeated rows cost nothing
    extra.  Other columns are not read.
    """

    def work(b):
        bpe = encoder(path)
        ids = [bpe.encode(t or "") for t in b.column("text").to_pylist()]
        return pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return _id_text(docs).mapInArrow(per_batch(work), "doc_id long, ids array<int>")


def encode_rows(docs: DataFrame, path: str, columns: list[str]) -> DataFrame:
    """docs(text, ...) to the given columns of it, n_tokens and ids, a row for each row; null and empty texts have no ids."""
    session_ready(docs.sparkSession)
    kept = docs.select(*columns, F.col("text").cast("string").alias("_text"))

    def work(b):
        bpe = encoder(path)
        ids = [bpe.encode(t or "") for t in b.column("_text").to_pylist()]
        made = [pa.array(list(map(len, ids)), pa.int64()), pa.array(ids, pa.list_(pa.int32()))]
        return pa.RecordBatch.from_arrays([*(b.column(c) for c in columns), *made], [*columns, "n_tokens", "ids"])

    schema = kept.select(*columns).schema.add("n_tokens", T.LongType()).add("ids", T.ArrayType(T.IntegerType()))
    return kept.mapInArrow(per_batch(work), schema)


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """encoded(doc_id, ids) to (doc_id, text); null ids give an empty text."""
    session_ready(encoded.sparkSession)

    def work(b):
        bpe = encoder(path)
        texts = [bpe.decode(x or ()) for x in b.column("ids").to_pylist()]
        return pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("ids").cast("array<int>").alias("ids")).mapInArrow(per_batch(work), "doc_id long, text string")


def round_trip_digests(docs: DataFrame, path: str) -> DataFrame:
    """docs(doc_id, text, ...) to (doc_id, n_tokens, ids_sha256, decoded_sha256): encode, then decode the ids.

    In one pass, as ids and decoded texts need not leave the worker.  Null
    and empty texts have no tokens and the digests of the empty string.
    """

    def work(b):
        bpe, sha = encoder(path), hashlib.sha256
        n, coded, decoded = [], [], []
        for t in b.column("text").to_pylist():
            ids = bpe.encode(t or "")
            n.append(len(ids))
            coded.append(sha(",".join(map(bpe.names.__getitem__, ids)).encode()).hexdigest())
            decoded.append(sha(bpe.decode(ids).encode()).hexdigest())
        return pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), pa.array(coded, pa.string()), pa.array(decoded, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return _id_text(docs).mapInArrow(per_batch(work), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
