"""Mixing sources to target weights by Sainte-Lague apportionment of equal-token blocks.

1. Sizes in words are summed by source.  Sources in code-point order (null
   last) weigh 1, 2, 3, 1, 2, 3, ...; targets share out all words by weight, none
   above ``cap`` times its source's size, the excess going to the others by weight.
2. The blocks that all words make are allocated to sources one by one by the
   highest quotient target / (2 s + 1), s being the blocks a source has.
3. Each source's documents fall into shards by hash; a source's blocks go to its
   shards in the same way, by their sizes.  That gives an integer quota for each shard.
4. In a shard, documents stand in a seeded order, as one sequence of words.  A
   quota takes the whole sequence as often as it fits and, for the rest, a run of
   blocks from a seeded block on, around the end.

All of it is done in DataFrame functions.  Only (doc_id, source, size) is
shuffled, rows equal in these as one row with a count, so that no id or size can
make a hot shard.  A shard holds about ``shard_docs`` documents, however large
its source is.  The driver gets one row: the number of all words and the least target.
"""

from __future__ import annotations

from math import floor, log2

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import session_ready, word_array, written

WEIGHTS = (1, 2, 3)
CAP = 3
SEED = 17
SHARD_DOCS = 4_000
MOST_BLOCK = 4096
#: Equal rows that stand in a shard as one.
COPIES = 1_000


def _level(total: Column, most: Column, weight: Column, by: list[str]) -> Column:
    """The x at which least(most, x * weight) adds up to ``total`` in each group; null if even all of ``most`` does not reach it.

    Rows in order of most / weight fill up first.  Behind a row that is full,
    x is what is left over the weights that are left, and falls from the
    first row on that it does not fill.
    """
    ratio = F.when(weight > 0, most / weight).otherwise(F.lit(0.0))
    order = Window.partitionBy(*by).orderBy(ratio)
    full = F.sum(most).over(order.rowsBetween(Window.unboundedPreceding, 0)) - most
    rest = F.sum(weight).over(order.rowsBetween(0, Window.unboundedFollowing))
    return F.when(rest > 0, F.struct(ratio.alias("ratio"), ((total - full) / rest).alias("x")))


def with_levels(df: DataFrame, totals: dict[str, Column], most: Column, weight: Column, by: list[str]) -> DataFrame:
    """df with a column for each of ``totals``: the level that gives that total, infinite if none does."""
    df = df.withColumns({k: _level(t, most, weight, by) for k, t in totals.items()})
    group = Window.partitionBy(*by)
    return df.withColumns({k: F.coalesce(F.max(F.when(F.col(k)["x"] <= F.col(k)["ratio"], F.greatest(F.col(k)["x"], F.lit(0.0)))).over(group), F.lit(float("inf"))) for k in totals})


def targets(sources: DataFrame, weights=WEIGHTS, cap: float = CAP) -> DataFrame:
    """sources(source, source_size, ...) with ``at`` (its place in code-point order, null last) and ``target``."""
    place = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.col("source").asc_nulls_last())) - 1
    share = F.element_at(F.array(*map(F.lit, weights)), (F.col("at") % len(weights) + 1).cast("int"))
    most = cap * F.col("source_size")
    df = sources.withColumn("at", place).withColumn("weight", share.cast("double")).withColumn("all_words", F.sum("source_size").over(Window.partitionBy(F.lit(0))))
    df = df.withColumn("one", F.lit(0))
    df = with_levels(df, {"level": F.col("all_words")}, most.cast("double"), F.col("weight"), ["one"])
    return df.withColumn("target", F.least(most.cast("double"), F.col("level") * F.col("weight"))).drop("one", "level", "weight", "all_words")


def apportion(df: DataFrame, by: list[str], party: str, votes: str, seats: str, most: str, out: str) -> DataFrame:
    """df with ``out``: the seats of each row by highest quotients votes / (2 s + 1) in its group, none above ``most``.

    Ties go to the least ``party``.  Seats that no cap leaves room for, or that
    only zero votes could get, stay empty.  Rounding moves no row by more than
    half a seat from its even share, so only the quotients between the shares of
    n / 2 seats fewer and n / 2 more, about two for each of n rows, are ranked.
    """
    group, v, cap = Window.partitionBy(*by), F.col("_v"), F.col("_cap")
    df = df.withColumn("_v", F.greatest(F.col(votes).cast("double"), F.lit(0.0)))
    df = df.withColumn("_cap", F.when(v > 0, F.least(F.col(most), F.col(seats))).otherwise(F.lit(0)).cast("long"))
    df = df.withColumn("_n", F.sum((cap > 0).cast("long")).over(group)).withColumn("_seats", F.least(F.col(seats), F.sum("_cap").over(group)))
    shift = F.col("_n") / 2 + 1
    df = with_levels(df, {"_few": F.greatest(F.col("_seats") - shift, F.lit(0.0)), "_many": F.col("_seats") + shift}, cap.cast("double"), F.when(cap > 0, v).otherwise(F.lit(0.0)), by)

    def held(level: str) -> Column:
        x = F.col(level)
        return F.when(cap == 0, F.lit(0)).when(x == float("inf"), cap).otherwise(F.least(cap, F.floor(v * x + 0.5))).cast("long")

    df = df.withColumn("_base", held("_few")).withColumn("_top", held("_many")).withColumn("_open", F.col("_seats") - F.sum("_base").over(group))
    extra = df.where("_top > _base").select(*by, party, "_v", "_open", F.explode(F.sequence(F.col("_base"), F.col("_top") - 1)).alias("_s"))
    place = F.row_number().over(Window.partitionBy(*by).orderBy((v / (2 * F.col("_s") + 1)).desc(), party))
    won = extra.withColumn("_place", place).where("_place <= _open").groupBy(*by, party).agg(F.count("*").alias("_won"))
    keep = [c for c in df.columns if c[0] != "_"]
    return df.join(won, [*by, party], "left").select(*keep, (F.col("_base") + F.coalesce("_won", F.lit(0))).alias(out))


def block_size(least_target: float | None) -> int:
    """The largest power of two up to MOST_BLOCK that is at most 1/256 of the least target above zero."""
    return int(min(MOST_BLOCK, 2 ** floor(log2(max(1.0, (least_target or 1.0) / 256)))))


def word_count(text: Column) -> Column:
    return F.size(word_array(text)).cast("long")


def _sized(docs: DataFrame) -> list[Column]:
    return [F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), word_count(F.col("text").cast("string")).alias("size")]


def _shares(docs: DataFrame, weights, cap: float, seed: int, shard_docs: int) -> DataFrame:
    """(doc_id, source, size, source_size, target, n, begin, quota, block, words, start): what n equal documents take, from word ``begin`` of their shard on."""
    session_ready(docs.sparkSession)
    rows = written(docs.select(*_sized(docs)), "sizes")
    sources = written(targets(rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n")), weights, cap), "sources")
    total, least = sources.agg(F.sum("source_size"), F.min(F.when(F.col("target") > 0, F.col("target")))).first()
    block = block_size(least)
    plan = sources.withColumns({"one": F.lit(0), "seats": F.lit(round((total or 0) / block)).cast("long"), "most": F.floor(cap * F.col("source_size") / block)})
    plan = apportion(plan, ["one"], "at", "target", "seats", "most", "blocks")
    plan = written(plan.select("source", "at", "source_size", "target", "blocks", F.ceil(F.col("n") / shard_docs).cast("long").alias("shards")), "plan")

    same = rows.groupBy("doc_id", "source", "size").agg(F.count("*").alias("n"))
    part = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / COPIES)))
    same = same.withColumn("part", part).withColumn("n", F.least(F.lit(COPIES).cast("long"), F.col("n") - COPIES * F.col("part")))
    same = same.withColumn("h", F.xxhash64(F.lit(seed), "doc_id", "size", "part")).alias("s").join(plan.alias("p"), F.col("s.source").eqNullSafe(F.col("p.source")))
    same = written(same.select("doc_id", "s.source", "size", "source_size", "target", "n", "part", "h", "at", "blocks", F.pmod("h", "shards").alias("shard")), "sharded")
    shards = same.groupBy("at", "shard").agg(F.sum(F.col("size") * F.col("n")).alias("words"), F.first("blocks").alias("blocks"))
    quotas = apportion(shards.withColumn("most", F.floor(cap * F.col("words") / block)), ["at"], "shard", "words", "blocks", "most", "quota").select("at", "shard", "words", "quota")
    order = Window.partitionBy("at", "shard").orderBy("h", F.col("doc_id").asc_nulls_last(), "size", "part")
    same = same.withColumn("begin", F.sum(F.col("size") * F.col("n")).over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size") * F.col("n"))
    start = F.pmod(F.xxhash64(F.lit(seed + 1), "at", "shard"), F.greatest(F.lit(1), F.ceil(F.col("words") / block))) * block
    return same.join(quotas, ["at", "shard"]).select("doc_id", "source", "size", "source_size", "target", "n", "begin", "quota", F.lit(block).cast("long").alias("block"), "words", start.alias("start"))


def _taken(begin: Column) -> Column:
    """Words that a document takes whose first word is number ``begin`` of its shard."""
    words, size, start, stop = F.col("words"), F.col("size"), F.col("start"), F.col("start") + F.col("rest")
    inside = lambda a, b: F.greatest(F.lit(0), F.least(begin + size, b) - F.greatest(begin, a))
    return F.when(words > 0, F.col("whole") * size + inside(start, stop) + inside(F.lit(0), stop - words)).otherwise(F.lit(0)).cast("long")


def mix(docs: DataFrame, weights=WEIGHTS, cap: float = CAP, seed: int = SEED, shard_docs: int = SHARD_DOCS) -> DataFrame:
    """docs(doc_id, text, source, ...) to (doc_id, size, source, source_size, target, taken), a row for each row of docs.

    taken: words of the document that the mix takes, repeats counted, at most
    ``cap`` times its size.  Null and empty texts have size 0 and nothing is
    taken of them.  A null source is a source of its own.  Null ids, repeated
    ids and repeated rows are kept, each row being a document; rows equal in
    id, source and size may share out their words in either order.  Reruns
    agree.  An empty table gives no rows.  Other columns are not read.
    """
    rows = _shares(docs, weights, cap, seed, shard_docs)
    of_words = F.col("quota") * F.col("block")
    rows = rows.withColumn("whole", F.when(F.col("words") > 0, F.floor(of_words / F.col("words"))).otherwise(F.lit(0))).withColumn("rest", of_words - F.col("whole") * F.col("words"))
    rows = rows.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
    return rows.select("doc_id", "size", "source", "source_size", "target", _taken(F.col("begin") + F.col("copy") * F.col("size")).alias("taken"))


def apply_mix(docs: DataFrame, weights=WEIGHTS, cap: float = CAP, seed: int = SEED) -> DataFrame:
    """Rows of docs as the mix takes them: each as often as its words are taken, a started copy counting from its half on.

    A document without words is in no block and is not taken.  Rows that share
    id (or have none), source and size are taken alike, what is left of a copy
    being drawn by a seeded hash of the text.  Other columns pass as they are.
    An empty table gives no rows.
    """
    plan = mix(docs, weights, cap, seed).where("size > 0").groupBy("doc_id", "source", "size").agg(F.count("*").alias("n"), (F.sum("taken") / F.sum("size")).alias("mean")).where("mean > 0")
    rows = docs.select(F.struct(*docs.columns).alias("d"), *_sized(docs)).alias("r")
    same = [F.col(f"r.{c}").eqNullSafe(F.col(f"p.{c}")) for c in ("doc_id", "source", "size")]
    draw = F.pmod(F.xxhash64(F.lit(seed), "d.text"), F.lit(1 << 30)) / float(1 << 30)
    drawn = F.floor("mean") + (draw < F.col("mean") - F.floor("mean")).cast("long")
    copies = F.when(F.col("n") == 1, F.round("mean")).otherwise(drawn).cast("int")
    taken = rows.join(plan.alias("p"), same[0] & same[1] & same[2]).select("d", copies.alias("copies")).where("copies > 0")
    return taken.select("d", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("d.*")
