"""Mixing sources to target weights along a low-discrepancy schedule.

Every source's documents are laid end to end in hashed order and cut into blocks of equally many words (the last one
may be short). Slots of the mix come from the van der Corput sequence: a point falls into a source's share of the unit
interval, and the slots of a source are ranked in schedule order. Rank r takes the r-th of the source's shuffled
blocks and begins anew after the last. Slots beyond a source's need are dropped, slots that the sequence owes it
(a few, by its discrepancy) are added at the end, and the last slot takes only the words still missing: so the words
taken are the target rounded down, and no document is taken more often than its source is passed through.

No task holds a source: positions and ranks are running sums over hash chunks of about ``CHUNK`` rows.

Defined results: a null text has no words; rows of a null source form a source of their own, last in order; equal
rows may swap places (they are the same rows); a source without words has the target 0; an empty table gives an
empty mix; further columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.shared import words, written

BLOCK_WORDS = 1024
CHUNK = 4096
BITS = 50  # of a point; enough for 10^15 slots
PRIMES = (2147483647, 2147483629)  # the step of a shuffle is one that does not divide the number of blocks


@dataclass(frozen=True)
class Mix:
    sized: DataFrame  # doc_id, text_md5, source, size: every row of the input
    sources: DataFrame  # source, rank, source_size, weight, target, ...
    rows: DataFrame  # slot, source, doc_id, text_md5, at, size, start, n_words: runs of words in the order of slots


def targets(sized: DataFrame, weights=(5.0, 2.0, 1.0), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """Per source its size, rank, weight and target, from a summary of one row per source.

    A target stops at ``most`` times the source and the excess is shared among the others by weight until none is
    above. The end of that is min(most * size, level * weight) with one level for all. Sources are ordered by the level
    at which they stop; the level of the first that does not stop holds for it and all after it.
    """
    s = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    every, by_name = Window.partitionBy(F.lit(0)), Window.partitionBy(F.lit(0)).orderBy(F.col("source").asc_nulls_last())
    s = s.withColumn("rank", (F.row_number().over(by_name) - 1).cast("long"))
    s = s.withColumn("weight", F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.col("rank") % len(weights) + 1).cast("int")))
    s = s.withColumn("cap", most * F.col("source_size").cast("double")).withColumn("stops", F.col("cap") / F.col("weight"))
    before = Window.partitionBy(F.lit(0)).orderBy("stops", "rank").rowsBetween(Window.unboundedPreceding, -1)
    left = F.least(share * F.sum("source_size").over(every), F.sum("cap").over(every)) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    s = s.withColumn("level", left / (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))))
    s = s.withColumn("common", F.min(F.when(F.col("level") < F.col("stops"), F.struct("stops", "rank", "level"))).over(every)["level"])
    return s.select("source", "rank", "source_size", "weight", F.when(F.col("common").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("common") * F.col("weight"))).alias("target"))


def _running(df: DataFrame, key: str, chunk: Column, order: list, value: Column, out: str) -> DataFrame:
    """Sum of ``value`` over the earlier rows of a key in the order (chunk, order): chunk totals, then within a chunk."""
    d = df.withColumn("_chunk", chunk.cast("long")).withColumn("_value", value.cast("long"))
    ahead = Window.partitionBy("_k").orderBy("_c").rowsBetween(Window.unboundedPreceding, -1)
    sums = d.groupBy(F.col(key).alias("_k"), F.col("_chunk").alias("_c")).agg(F.sum("_value").alias("_sum"))
    sums = sums.select("_k", "_c", F.coalesce(F.sum("_sum").over(ahead), F.lit(0)).alias("_before"))
    inside = Window.partitionBy(key, "_chunk").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    d = d.withColumn("_inner", F.coalesce(F.sum("_value").over(inside), F.lit(0)))
    d = d.join(sums, (d[key] == sums["_k"]) & (d["_chunk"] == sums["_c"]))
    return d.withColumn(out, F.col("_before") + F.col("_inner")).drop("_chunk", "_value", "_k", "_c", "_before", "_inner")


def _schedule(spark, sources: DataFrame, n_slots: int, n_sources: int) -> DataFrame:
    """slot, rank, r: the source of each slot and which of its slots it is."""
    reversed_bits = F.conv(F.reverse(F.lpad(F.bin("id"), BITS, "0")), 2, 10).cast("long")
    width = BITS - max(10, (4 * n_sources).bit_length())  # of a cell of the unit interval; cells turn the search into an equi-join
    points = spark.range(n_slots).select(F.col("id").alias("slot"), reversed_bits.alias("x"))
    points = points.withColumn("cell", F.shiftright("x", width))
    shares = sources.where("hi > lo").select("rank", "lo", "hi", F.explode(F.sequence(F.shiftright("lo", width), F.shiftright(F.col("hi") - 1, width))).alias("cell"))
    placed = points.join(shares, "cell").where("x >= lo and x < hi").select("slot", "rank")
    ranked = _running(placed, "rank", F.floor(F.col("slot") / CHUNK), ["slot"], F.lit(1), "r")
    got = placed.groupBy("rank").agg(F.count(F.lit(1)).alias("got"))
    owed = sources.join(got, "rank", "left").select("rank", "need", F.coalesce("got", F.lit(0).cast("long")).alias("got")).where("need > got")
    owed = owed.select("rank", F.explode(F.sequence("got", F.col("need") - 1)).alias("r"))
    return ranked.select("slot", "rank", "r").unionByName(owed.select((F.col("r") + n_slots).alias("slot"), "rank", "r"))


def mix(docs: DataFrame, weights=(5.0, 2.0, 1.0), share: float = 1.5, most: float = 2.0, block_words: int = BLOCK_WORDS) -> Mix:
    """The mix of a table with doc_id, source and text."""
    spark = docs.sparkSession
    sized = written(docs.select("doc_id", F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("text_md5"), "source",
                                F.size(words(F.col("text"))).cast("long").alias("size")), "mix-sizes")
    s = targets(sized, weights, share, most)
    s = s.withColumn("wants", F.floor(F.col("target") + 1e-6).cast("long")).withColumn("full", F.expr(f"source_size div {block_words}L"))
    s = s.withColumn("blocks", F.ceil(F.col("source_size") / block_words)).withColumn("passes", F.expr("if(source_size = 0, 0L, wants div source_size)"))
    s = s.withColumn("need", F.col("passes") * F.col("blocks") + F.ceil((F.col("wants") - F.col("passes") * F.col("source_size")) / block_words))
    s = s.withColumn("step", F.when(F.col("full") % PRIMES[0] != 0, F.lit(PRIMES[0])).otherwise(F.lit(PRIMES[1])).cast("long"))
    upto, every = Window.partitionBy(F.lit(0)).orderBy("rank"), Window.partitionBy(F.lit(0))
    share_end = F.sum("need").over(upto) / F.greatest(F.sum("need").over(every), F.lit(1))
    s = s.withColumn("hi", F.when(F.col("rank") == F.max("rank").over(every), F.lit(1 << BITS)).otherwise((share_end * float(1 << BITS)).cast("long")))
    s = written(s.withColumn("lo", F.coalesce(F.lag("hi").over(upto), F.lit(0).cast("long"))), "mix-sources")
    total = s.agg(F.sum("need").alias("slots"), F.count(F.lit(1)).alias("sources"), F.sum("source_size").alias("words")).first()
    n_docs = sized.count()

    slots = _schedule(spark, s, total["slots"] or 0, total["sources"]).join(s.select("rank", "source_size", "wants", "full", "blocks", "need", "step"), "rank").where("r < need")
    slots = slots.withColumn("i", F.expr("r % blocks")).withColumn("pass", F.expr("r div blocks"))
    shuffled = F.expr("cast((cast(i as decimal(19,0)) * step + cast(pass as decimal(19,0)) * 7919) % greatest(full, 1L) as long)")
    slots = slots.select("slot", "rank", F.when(F.col("i") < F.col("full"), shuffled).otherwise(F.col("full")).alias("block"),
                         F.least(F.lit(block_words).cast("long"), F.expr(f"source_size - i * {block_words}L"), F.expr(f"wants - pass * source_size - i * {block_words}L")).alias("takes"))

    placed = sized.where("size > 0").join(s.select(F.col("source").alias("_source"), "rank"), F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    h = F.xxhash64("doc_id", "text_md5")
    placed = _running(placed.withColumn("h", h), "rank", F.pmod("h", F.lit(max(1, n_docs // CHUNK))), ["h", "doc_id", "text_md5", "size"], F.col("size"), "at")
    cut = placed.withColumn("block", F.explode(F.sequence(F.expr(f"at div {block_words}L"), F.expr(f"(at + size - 1) div {block_words}L"))))
    cut = cut.withColumn("start", F.greatest(F.lit(0).cast("long"), F.expr(f"block * {block_words}L - at")))
    cut = cut.withColumn("inside", F.expr(f"at + start - block * {block_words}L")).withColumn("run", F.least(F.col("size") - F.col("start"), F.lit(block_words) - F.col("inside")))
    rows = cut.join(slots, ["rank", "block"]).withColumn("n_words", F.least(F.col("run"), F.col("takes") - F.col("inside"))).where("n_words > 0")
    return Mix(sized, s, rows.select("slot", "source", "doc_id", "text_md5", "at", "size", "start", "n_words"))


def taken(m: Mix) -> DataFrame:
    """Every row of the input with its source's figures and the words that the mix takes of it."""
    got = m.rows.groupBy("doc_id", "source", "at", "size").agg(F.sum("n_words").alias("taken")).select("doc_id", "source", "size", "taken")
    # A row that the mix leaves out has no run: what is missing per (document, source, size) is added with 0.
    key = ["doc_id", "source", "size"]
    whole = m.sized.groupBy(*key).agg(F.count(F.lit(1)).alias("n"))
    some = got.groupBy(*key).agg(F.collect_list("taken").alias("list"))
    same = [whole[c].eqNullSafe(some[c]) for c in key]
    both = whole.join(some, same[0] & same[1] & same[2], "left").select(*(whole[c] for c in key), "n", F.coalesce("list", F.array().cast("array<bigint>")).alias("list"))
    both = both.select(*key, F.explode(F.concat("list", F.array_repeat(F.lit(0).cast("long"), (F.col("n") - F.size("list")).cast("int")))).alias("taken"))
    per = m.sources.select(F.col("source").alias("_source"), "source_size", "target")
    return both.join(per, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")


def texts(m: Mix, docs: DataFrame) -> DataFrame:
    """The mix with its words: slot, source, doc_id, start, n_words, text."""
    md5 = F.md5(F.coalesce("text", F.lit("")).cast("binary"))
    runs = m.rows.groupBy("doc_id", "text_md5").agg(F.collect_list(F.struct("slot", "source", "start", "n_words")).alias("runs"))
    own = docs.select(F.col("doc_id").alias("_id"), md5.alias("_md5"), "text").dropDuplicates(["_id", "_md5"])
    both = runs.join(own, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_md5") == F.col("_md5")))
    both = both.select("doc_id", words(F.col("text")).alias("w"), F.explode("runs").alias("r"))
    return both.select("r.slot", "r.source", "doc_id", "r.start", "r.n_words", F.array_join(F.slice("w", (F.col("r.start") + 1).cast("int"), F.col("r.n_words").cast("int")), " ").alias("text"))
