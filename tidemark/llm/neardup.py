"""Near-duplicate documents by ProbMinHash.

A document is the multiset of its five-word shingles, weighted by how often they occur. Each shingle is a Poisson
process with its weight as rate: its arrivals fall on random registers, a register keeps the earliest, and a shingle stops
at the first arrival later than all registers of its document. Two documents agree in a register with their
probability Jaccard similarity. Bands of registers propose pairs; each pair that counts is verified with the exact
similarity of the whole texts.

Texts that are equal are one node from the start. In a bucket every node is first compared with two of its members, the one
with most company in all its buckets and the first. Where that leaves a bucket in several components, its nodes
are searched exactly: prefixes of their shingles in order of rarity, as long as a link needs them, meet in an equi-join, and
only pairs of different components whose prefixes meet are compared. So a large group of copies costs a few
comparisons per member, copies below the similarity don't meet pair by pair, and no link of a bucket is lost. Components are found by alternating
large-star and small-star steps. With 40 bands of 6 registers a pair of similarity 0.8 is missed with
probability 5e-6.

Defined results: a text of one to four words is one shingle; equal texts are one class, null equals empty; a class is named
by its smallest doc_id (null only if all are null); repeated rows stay; an empty table gives no rows; further columns are
ignored by ``classes`` and kept by ``keep``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.hashing import MULTIPLIERS, hash_words, mixed, run_hashes, signed, split_words
from tidemark.llm.shared import slices, written

SHINGLE, SIMILARITY, BANDS, ROWS = 5, 0.8, 40, 6
SLICE_CHARS = 4_000_000  # of text that one step holds as arrays


def shingles(text: str | None, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes in order and their counts."""
    return np.unique(run_hashes(hash_words(split_words(text)), size), return_counts=True)


def prob_min_hash(doc: np.ndarray, key: np.ndarray, weight: np.ndarray, n_docs: int, registers: int) -> np.ndarray:
    """The key that arrives first at each register of each document; 0 where a document has none."""
    first, out = np.full(n_docs * registers, np.inf), np.zeros(n_docs * registers, np.uint64)
    live, at, done, step = np.arange(len(key)), np.zeros(len(key)), 0, 1
    while len(live):
        number = np.arange(done, done + step, dtype=np.uint64) * MULTIPLIERS[1]
        bits = mixed(key[live][:, None] + number)
        when = at[live][:, None] - np.cumsum(np.log1p(-((bits >> np.uint64(11)) * 2.0**-53)) / weight[live][:, None], axis=1)
        register = (mixed(bits ^ MULTIPLIERS[2]) >> np.uint64(32)) * np.uint64(registers) >> np.uint64(32)
        place = doc[live][:, None] * registers + register.astype(np.int64)
        better = when < first[place]
        place, value = place[better], when[better]
        np.minimum.at(first, place, value)
        won = first[place] == value
        out[place[won]] = np.broadcast_to(key[live][:, None], better.shape)[better][won]
        at[live] = when[:, -1]
        latest = first.reshape(n_docs, registers).max(axis=1)
        live = live[when[:, -1] < latest[doc[live]]]
        done, step = done + step, min(2 * step, 64)
    return out.reshape(n_docs, registers)


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Probability Jaccard similarity of two weighted sets; the Jaccard similarity where all weights are equal."""
    (ka, wa), (kb, wb) = a, b
    if not len(ka) or not len(kb):
        return float(len(ka) == len(kb))
    _, ia, ib = np.intersect1d(ka, kb, assume_unique=True, return_indices=True)
    va, vb = wa[ia].astype(float), wb[ib].astype(float)
    only_a, only_b, total = wa.sum() - va.sum(), wb.sum() - vb.sum(), 0.0
    for ratio in np.unique(vb / va):
        mine = va[vb / va == ratio].sum()
        total += mine / (only_a + only_b / ratio + np.maximum(va, vb / ratio).sum())
    return total


def signatures(docs: DataFrame, bands: int = BANDS, rows: int = ROWS, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, text_md5 and the hash of each band of every document (none without words)."""

    def run(batches):
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for i, j in slices([len(t or "") for t in texts], SLICE_CHARS):
                sets = [shingles(t, shingle) for t in texts[i:j]]
                count = np.array([len(k) for k, _ in sets])
                key = np.concatenate([k for k, _ in sets])
                sig = prob_min_hash(np.repeat(np.arange(j - i), count), key, np.concatenate([w for _, w in sets]).astype(float), j - i, bands * rows)
                band = (sig.reshape(j - i, bands, rows) * MULTIPLIERS[:rows]).sum(axis=2, dtype=np.uint64)
                band = signed(mixed(band + np.arange(bands, dtype=np.uint64) * MULTIPLIERS[7]))[count > 0]
                ends = np.concatenate([[0], np.cumsum((count > 0) * bands)]).astype(np.int32)
                part = batch.slice(i, j - i)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("text_md5"), pa.ListArray.from_arrays(pa.array(ends), pa.array(band.ravel()))], ["doc_id", "text_md5", "bands"])

    if rows > len(MULTIPLIERS):
        raise ValueError(f"at most {len(MULTIPLIERS)} rows")
    one = docs.select(F.col("doc_id").cast("long"), F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("text_md5"), "text")
    return one.mapInArrow(run, "doc_id long, text_md5 string, bands array<long>")


def verify(pairs: DataFrame, texts: DataFrame, least: float = SIMILARITY, shingle: int = SHINGLE) -> DataFrame:
    """Of pairs (a, b) of nodes those whose whole texts reach the similarity. ``texts``: node, text."""

    def run(batches):
        for batch in batches:
            kept, last = [], (None, None)
            for i, (a, ta, tb) in enumerate(zip(batch.column("a").to_pylist(), batch.column("ta").to_pylist(), batch.column("tb").to_pylist(), strict=True)):
                if last[0] != a:
                    last = (a, shingles(ta, shingle))
                if similarity(last[1], shingles(tb, shingle)) >= least - 1e-9:
                    kept.append(i)
            yield batch.select(["a", "b"]).take(pa.array(kept, pa.int64()))

    t = [texts.select(F.col("node").alias(x), F.col("text").alias(f"t{x}")) for x in "ab"]
    return pairs.join(t[0], "a").join(t[1], "b").select("a", "b", "ta", "tb").mapInArrow(run, "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """node, component (its smallest node) of the nodes in links (a, b), by alternating large-star and small-star steps."""

    def star(edges: DataFrame, large: bool) -> DataFrame:
        # u keeps its neighbours v and the smallest node m it sees; large: of all, for v > u; small: of those below u.
        seen = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select(F.col("b").alias("u"), F.col("a").alias("v"))) if large else edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        least = seen.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        both = seen.join(least, "u")
        out = both.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")) if large else both.select(F.col("v").alias("a"), F.col("m").alias("b")).union(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
        return out.where("a != b").distinct()

    edges, before = written(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a != b").distinct(), "links"), None
    while True:
        told = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if told == before:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(edges.select("b", "b").distinct())
        before, edges = told, written(star(star(edges, True), False), "links")


def prefix_pairs(texts: DataFrame, least: float = SIMILARITY, shingle: int = SHINGLE) -> DataFrame:
    """Pairs (a, b) of nodes of different components ``c`` that may be links; ``texts``: node, c, text.

    With similarity s, what two texts share weighs at least s of each, and where no shingle repeats in either, it
    counts s / (1 + s) of both sizes. In any one order of shingles, here by rarity, their first common shingle then comes
    before that much is left over in either text.
    """

    def run(batches):
        for batch in batches:
            for i, j in slices([len(t or "") for t in batch.column("text").to_pylist()], SLICE_CHARS):
                part = batch.slice(i, j - i)
                sets = [shingles(t, shingle) for t in part.column("text").to_pylist()]
                told = [pa.array([signed(k) for k, _ in sets], pa.list_(pa.int64())), pa.array([w for _, w in sets], pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays([part.column("node"), part.column("c"), *told], ["node", "c", "h", "w"])

    own = texts.select("node", "c", "text").mapInArrow(run, "node long, c long, h array<long>, w array<long>")
    own = own.withColumn("total", F.aggregate("w", F.lit(0).cast("long"), lambda s, x: s + x)).withColumn("flat", F.col("total") == F.size("h"))
    each = written(own.select("node", "c", "total", "flat", F.inline(F.arrays_zip("h", "w"))), "near-shingles")
    seen = each.groupBy("h").agg(F.count(F.lit(1)).alias("df"), F.min("c").alias("lo"), F.max("c").alias("hi")).where("df > 1")
    order = Window.partitionBy("node").orderBy(F.coalesce("df", F.lit(1)), "h").rowsBetween(Window.unboundedPreceding, -1)
    each = each.join(seen, "h", "left").withColumn("before", F.coalesce(F.sum("w").over(order), F.lit(0)))
    each = written(each.where(F.col("before") <= (1 - least) * F.col("total") + 1e-9).where("lo != hi").select("h", "node", "c", "total", "flat", "before"), "near-prefixes")
    p, q = each.alias("p"), each.alias("q")
    need = F.ceil((F.col("p.total") + F.col("q.total")) * (least / (1 + least)) - 1e-9)
    enough = ~(F.col("p.flat") & F.col("q.flat")) | ((F.col("p.before") <= F.col("p.total") - need) & (F.col("q.before") <= F.col("q.total") - need))
    met = p.join(q, (F.col("p.h") == F.col("q.h")) & (F.col("p.node") < F.col("q.node")) & (F.col("p.c") != F.col("q.c")) & enough)
    return met.select(F.col("p.node").alias("a"), F.col("q.node").alias("b")).distinct()


def classes(docs: DataFrame, least: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, text_md5, class_id and component of every row; a component is a class (ids may repeat, components don't)."""
    signed_ = written(signatures(docs, bands, rows, shingle), "near-signatures")
    nodes = signed_.groupBy("text_md5").agg(F.min("doc_id").alias("rep"), F.first("bands").alias("bands"))
    nodes = written(nodes.withColumn("node", F.monotonically_increasing_id()), "near-nodes")
    buckets = nodes.select("node", F.explode("bands").alias("key"))
    full = buckets.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    met = written(buckets.join(full, "key"), "near-buckets")
    company = met.groupBy("node").agg(F.sum("n").alias("company"))
    lead = met.join(company, "node").groupBy("key").agg(F.max_by("node", F.struct("company", -F.col("node"))).alias("x"), F.min("node").alias("y"))
    first = met.join(lead, "key").select("node", F.explode(F.array("x", "y")).alias("other")).where("node != other")
    first = written(first.select(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b")).distinct(), "near-pairs")
    wanted = met.select("node").distinct().join(nodes.select("node", "text_md5", "rep"), "node")
    own = docs.select(F.col("doc_id").cast("long").alias("_id"), F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("_md5"), "text")
    texts = own.join(wanted, (F.col("_md5") == F.col("text_md5")) & F.col("_id").eqNullSafe(F.col("rep"))).select("node", "text").dropDuplicates(["node"])
    texts = written(texts, "near-texts")
    links = written(verify(first, texts, least, shingle), "near-links")
    label = written(components(links), "near-components")
    # Buckets that the first links left in several components: the pairs of their nodes that can still be links.
    known = met.select("node", "key").join(label, "node", "left").select("key", "node", F.coalesce("component", "node").alias("c"))
    split = known.groupBy("key").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo != hi").select("key")
    open_ = written(known.join(split, "key").select("node", "c").distinct(), "near-open")
    across = prefix_pairs(open_.join(texts, "node"), least, shingle).join(first, ["a", "b"], "left_anti")
    more = written(verify(across, texts, least, shingle), "near-links")
    if not more.isEmpty():
        label = written(components(links.union(more)), "near-components")
    named = nodes.select("node", "text_md5", "rep").join(label, "node", "left").withColumn("component", F.coalesce("component", "node"))
    smallest = named.groupBy("component").agg(F.min("rep").alias("class_id"))
    named = named.join(smallest, "component").select(F.col("text_md5").alias("_md5"), "class_id", "component")
    return signed_.select("doc_id", "text_md5").join(named, F.col("text_md5") == F.col("_md5")).select("doc_id", "text_md5", "class_id", "component")


def keep(docs: DataFrame, **how) -> DataFrame:
    """One document of each class, that with the smallest doc_id, with all its columns."""
    c = classes(docs, **how)
    stay = c.where(F.col("doc_id").eqNullSafe(F.col("class_id"))).groupBy("component").agg(F.first("class_id").alias("stay_id"), F.min("text_md5").alias("stay_md5"))
    row = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("row"), F.col("doc_id").cast("long").alias("stay_id"), F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("stay_md5"))
    both = row.alias("l").join(stay.alias("r"), F.col("l.stay_id").eqNullSafe(F.col("r.stay_id")) & (F.col("l.stay_md5") == F.col("r.stay_md5")), "left_semi")
    return both.dropDuplicates(["stay_id", "stay_md5"]).select("row.*")
