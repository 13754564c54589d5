"""Secret scans with corpus-wide ownership frequency, in DataFrame functions only.

Patterns find assignments, access keys and hexadecimal runs; these base spans
always stay.  Values of base spans and other long runs of letters and digits
are candidates.  Their hashes are counted over the corpus by distinct
repositories and owners: a value that many owners have, or that is in many
repositories for each of its owners, is a copied example; one that few have and
that looks random is reported as live.

Texts are scanned once and do not move; only candidates are shuffled, by hash,
counts being pre-aggregated.  Offsets are in code points, ends exclusive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import let, session_ready, written

KINDS = ("assign", "access", "hex", "live")
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
#: Runs that may be keys of other kinds.
LONG_RUN = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}+"
PLACEHOLDER = r"(?i)example|sample|dummy|placeholder|changeme|your[_-]|xxxx|00000000|12345678"
LEAST_LIVE, LEAST_DISTINCT = 16, 8
MOST_OWNERS = 3
#: Distinct repositories for each owner of a value, on average, above which it counts as copied.
MOST_REPOSITORIES = 10
MASK = "[SECRET]"

_NONE = "cast(array() as array<struct<s:int,e:int,v:string>>)"
#: Characters that candidates consist of.
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-"
#: Steps of a scan over an array; 2 to their power is above any array's size.
SCAN_STEPS = 31
#: Characters of a block of text that is cut by position.
BLOCK = 64


def running(values: Column, join) -> Column:
    """Inclusive scan of an array: element i joins the first i.

    In step k each element joins the one 2^k before it, so n elements take
    n log n operations; an array that grows by one in each step takes n squared.
    """

    def step(acc, by):
        shifted = F.concat(F.slice(acc, 1, by), F.zip_with(F.slice(acc, by + 1, F.size(acc)), F.slice(acc, 1, F.size(acc) - by), join))
        return F.when(F.size(acc) > by, shifted).otherwise(acc)

    return F.aggregate(F.array(*(F.lit(1 << k) for k in range(SCAN_STEPS))), values, step)


def located(text: Column, pattern: str, possible: Column) -> Column:
    """Array of (s, e, v) of the leftmost non-overlapping matches; none where ``possible`` is false.

    The text between the matches gives the offsets.  Patterns must not match
    the empty string.
    """

    def place(found):
        lengths = F.zip_with(F.slice(F.split(text, pattern, -1), 1, F.size(found)), found, lambda g, v: F.char_length(g) + F.char_length(v))
        ends = F.arrays_zip(running(lengths, lambda a, b: a + b).alias("e"), found.alias("v"))
        spans = F.transform(ends, lambda x: F.struct((x["e"] - F.char_length(x["v"])).alias("s"), x["e"].alias("e"), x["v"].alias("v")))
        return F.when(F.size(found) > 0, spans).otherwise(F.expr(_NONE))

    return F.when(possible, let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), place)).otherwise(F.expr(_NONE))


def once(spans: Column) -> Column:
    """The spans in order, repeated ones once."""
    return let(F.sort_array(spans), lambda a: F.filter(a, lambda x, i: (i == 0) | (x != F.get(a, i - 1))))


def looks_live(value: Column) -> Column:
    """Long, of letters and digits, of many different characters, and no placeholder."""
    return (
        (F.char_length(value) >= LEAST_LIVE) & value.rlike("[0-9]") & value.rlike("[A-Za-z]") & ~value.rlike(PLACEHOLDER)
        & (F.size(F.filter(F.array(*map(F.lit, ALPHABET)), lambda c: F.contains(value, c))) >= LEAST_DISTINCT)
    )


def _scan(docs: DataFrame, owner: str, repository: str) -> DataFrame:
    """One row for each row of docs, without its text: base spans and candidates."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(owner).cast("string").alias("owner"), F.col(repository).cast("string").alias("repository"), text.alias("text"))
    t = F.col("text")
    value = lambda x: F.regexp_extract(x["v"], ASSIGN, 2)
    rows = rows.select(
        "doc_id", "owner", "repository", F.xxhash64("doc_id", "text").alias("of_text"),
        F.filter(located(t, ASSIGN, t.contains(":") | t.contains("=")), lambda x: F.char_length(value(x)) >= 6).alias("assign"),
        located(t, ACCESS, t.contains("AKIA")).alias("access"),
        located(t, HEX, F.lit(True)).alias("hex"),
        located(t, LONG_RUN, F.lit(True)).alias("run"),
    )
    rows = rows.withColumn("value", F.transform("assign", lambda x: let(value(x), lambda v: F.struct((x["e"] - F.char_length(v)).alias("s"), x["e"].alias("e"), v.alias("v")))))
    found = F.filter(once(F.concat("value", "access", "hex", "run")), lambda x: looks_live(x["v"]))
    spans = lambda k: F.transform(KINDS[k], lambda x: F.struct(x["s"].alias("s"), F.lit(k).alias("k"), x["e"].alias("e")))
    return rows.select(
        "doc_id", "owner", "repository", "of_text", F.sort_array(F.concat(*map(spans, range(3)))).alias("base"), *(F.size(k).cast("long").alias(f"n_{k}") for k in KINDS[:3]),
        F.transform(found, lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), F.xxhash64(x["v"]).alias("h"))).alias("found"),
    )


def spelled(spans: Column) -> Column:
    """kind:start:end, joined by commas."""
    kind = lambda x: F.element_at(F.array(*map(F.lit, KINDS)), x["k"] + 1)
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", kind(x), x["s"].cast("string"), x["e"].cast("string"))), ",")


def scan(docs: DataFrame, owner: str = "source", repository: str = "doc_id", most_owners: int = MOST_OWNERS, most_repositories: int = MOST_REPOSITORIES) -> DataFrame:
    """docs(doc_id, text, owner, repository, ...) to (doc_id, of_text, n_assign, n_access, n_hex, base, all_spans), a row for each row.

    Spans are arrays of (s, k, e) by start, then kind; k counts in KINDS.
    Null and empty texts have no spans.  A null owner or repository counts as
    one of its own.  of_text digests doc_id and text; rows that repeat both
    have the same spans.  A null doc_id keeps its row.
    """
    session_ready(docs.sparkSession)
    rows = written(_scan(docs, owner, repository), "secrets")
    found = rows.where(F.size("found") > 0).select("doc_id", "of_text", F.coalesce("owner", F.lit("\0")).alias("owner"), F.coalesce("repository", F.lit("\0")).alias("repository"), F.explode("found").alias("x")).select("*", "x.*").drop("x")
    owners = found.groupBy("h").agg(F.countDistinct("owner").alias("owners"), F.countDistinct("repository").alias("repositories"))
    few = (F.col("owners") <= most_owners) & (F.col("repositories") <= most_repositories * F.col("owners"))
    live = found.join(owners.where(few), "h").groupBy("doc_id", "of_text").agg(F.collect_set(F.struct("s", F.lit(3).alias("k"), "e")).alias("added"))
    rows, live = rows.alias("r"), live.alias("l")
    all_ = rows.join(live, F.col("r.doc_id").eqNullSafe(F.col("l.doc_id")) & (F.col("r.of_text") == F.col("l.of_text")), "left")
    spans = F.when(F.col("added").isNull(), F.col("base")).otherwise(F.sort_array(F.concat("base", "added")))
    return all_.select("r.doc_id", "r.of_text", "n_assign", "n_access", "n_hex", "base", spans.alias("all_spans"))


def masked(text: Column, spans: Column) -> Column:
    """The text with MASK for every span; spans that overlap share one. Spans are (s, k, e) in order, at least one.

    The text is cut into blocks of characters, so that a piece is found by its position without a walk from the start.
    """

    def cut(blocks):
        def piece(a, b):
            i = F.floor(a / BLOCK).cast("int")
            j = F.floor((b - 1) / BLOCK).cast("int")
            return F.when(b > a, F.substring(F.array_join(F.slice(blocks, i + 1, j - i + 1), ""), a - i * BLOCK + 1, b - a)).otherwise(F.lit(""))

        def joined(ends):
            before = F.transform(spans, lambda x, i: F.struct(F.when(i == 0, F.lit(0)).otherwise(F.get(ends, i - 1)).alias("at"), x["s"].alias("s"), (i == 0).alias("first")))
            parts = F.transform(F.filter(before, lambda x: x["first"] | (x["s"] >= x["at"])), lambda x: F.concat(piece(x["at"], x["s"]), F.lit(MASK)))
            return F.concat(F.array_join(parts, ""), piece(F.element_at(ends, -1), F.char_length(text)))

        return let(running(F.transform(spans, lambda x: x["e"]), lambda a, b: F.greatest(a, b)), joined)

    return let(F.regexp_extract_all(text, F.lit("(?s).{1,%d}" % BLOCK), F.lit(0)), cut)


def redact(docs: DataFrame, owner: str = "source", repository: str = "doc_id") -> DataFrame:
    """Rows of docs with every span masked, n_chars set anew; texts without spans are left alone.

    Null ids and texts pass, repeated rows are masked alike, other columns pass
    as they are.  An empty table gives no rows.
    """
    spans = scan(docs, owner, repository).where(F.size("all_spans") > 0).select("doc_id", "of_text", "all_spans").dropDuplicates(["doc_id", "of_text"])
    doc_id, text = F.col("doc_id").cast("long"), F.col("text").cast("string")
    rows = docs.select(F.struct(*docs.columns).alias("d"), doc_id.alias("doc_id"), F.xxhash64(doc_id, F.coalesce(text, F.lit(""))).alias("of_text")).alias("r")
    rows = rows.join(spans.alias("s"), F.col("r.doc_id").eqNullSafe(F.col("s.doc_id")) & (F.col("r.of_text") == F.col("s.of_text")), "left")
    rows = rows.select("d", F.when(F.col("all_spans").isNotNull(), masked(F.col("d.text").cast("string"), F.col("all_spans"))).otherwise(F.col("d.text")).alias("new"))
    own = {"text": F.col("new"), "n_chars": F.char_length("new").cast(docs.schema["n_chars"].dataType) if "n_chars" in docs.columns else None}
    return rows.select(*((own[c] if c in own else F.col("d")[c]).alias(c) for c in docs.columns))
