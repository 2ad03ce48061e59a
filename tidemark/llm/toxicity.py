"""Toxicity of whole texts from their nearest labelled examples.

Texts are vectors over all words of the examples. A word weighs TF-IDF times the chi-square of its document counts in the two
classes: without it, neighbours are texts of the same language and subject, whatever their label. No word is left out, be it
rare, but one that tells nothing (chi-square 0). Examples are labelled texts; those with equal vectors are one example with their votes.
The nearest examples by cosine are found exactly: sums in single precision, over a table for the commonest terms and over
postings for the others, give each block of examples the largest cosine it could reach, and only in blocks that reach the
neighbours already found are examples scored again, in double precision from their own vectors. Neighbours vote by label, weighted by distance, shrunk towards the rate among all examples; so a score is an
estimate of the share of toxic texts among texts like it. Neighbours and terms are kept as evidence.

The fit reads at most ``EXAMPLES`` distinct labelled texts, chosen by hash of the text (all there are below that), so the
index it broadcasts is bounded; document frequencies are counted over all documents, and every text is scored whole.

Defined results: a text without any of the terms (also null or empty) gets the rate among such examples; without labels every
score is 0; labels that are null are ignored, of several labels of a document the largest counts; equal similarities
go to the smaller example (by heaviest term, then its words and counts; never by doc_id); repeated rows stay; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import re
from functools import cached_property
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shared import written

EXAMPLES, NEIGHBOURS, BLOCK = 20_000, 25, 64
COMMON, TOGETHER, SLACK = 192, 64, 1e-5  # terms in the table, texts that share a product with it, error of single precision
TERM = re.compile(r"[^\W\d_]+")


def held_out(doc_id: Column, folds: int = 5, fold: int = 0) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == fold, F.lit(False))


def _terms(batches, own=("doc_id", "text_md5")):
    for batch in batches:
        terms = [sorted(set(TERM.findall((t or "").lower()))) for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in own), pa.array(terms, pa.list_(pa.string()))], [*own, "terms"])


def _md5() -> Column:
    return F.md5(F.coalesce("text", F.lit("")).cast("binary"))


def labelled(docs: DataFrame, labels: DataFrame, most: int = EXAMPLES) -> DataFrame:
    """doc_id, text_md5, text, yes, no: distinct labelled texts with their votes, at most ``most``."""
    y = labels.where("toxic is not null").groupBy(F.col("doc_id").alias("_id")).agg(F.max("toxic").alias("y"))
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _md5().alias("text_md5"))
    votes = own.join(y, F.col("doc_id") == F.col("_id")).groupBy("text_md5")
    votes = votes.agg(F.min("doc_id").alias("first"), F.sum((F.col("y") > 0).cast("long")).alias("yes"), F.sum((F.col("y") <= 0).cast("long")).alias("no"))
    chosen = votes.orderBy(F.xxhash64("text_md5"), "text_md5").limit(most).withColumnRenamed("text_md5", "_md5")
    # At most ``most`` ids, so they go to the texts and not the texts to them.
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _md5().alias("text_md5"), "text").join(F.broadcast(chosen), (F.col("doc_id") == F.col("first")) & (F.col("text_md5") == F.col("_md5")))
    return texts.dropDuplicates(["text_md5"]).select("doc_id", "text_md5", "text", "yes", "no")


def weigh_terms(examples: DataFrame) -> tuple[list[str], np.ndarray]:
    """Every word of the examples whose counts differ between the classes, and its chi-square."""
    t = examples.select("doc_id", "text_md5", "text", (F.col("yes") >= F.col("no")).alias("toxic"))
    n = t.agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("toxic").cast("long")).alias("y")).first()
    if not n["n"] or not n["y"] or n["y"] == n["n"]:
        return [], np.zeros(0)
    df = t.mapInArrow(lambda b: _terms(b, ("toxic",)), "toxic boolean, terms array<string>").select("toxic", F.explode("terms").alias("term"))
    df = df.groupBy("term").agg(F.sum(F.col("toxic").cast("double")).alias("a"), F.sum((~F.col("toxic")).cast("double")).alias("b"))
    yes, no = float(n["y"]), float(n["n"] - n["y"])
    df = df.withColumn("c", yes - F.col("a")).withColumn("d", no - F.col("b"))
    spread = (F.col("a") + F.col("b")) * (F.col("c") + F.col("d")) * yes * no  # 0 for a term of all texts, which tells nothing
    chi2 = F.coalesce(F.try_divide((yes + no) * F.pow(F.col("a") * F.col("d") - F.col("b") * F.col("c"), F.lit(2)), spread), F.lit(0.0))
    told = df.select("term", chi2.alias("chi2")).where("chi2 > 0").toArrow().sort_by("term")
    return told["term"].to_pylist(), told["chi2"].to_numpy()


def profiles(docs: DataFrame, number: Broadcast, more: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, ``more`` (long columns), ids and counts in every text of the terms that ``number`` has."""

    def run(batches):
        get = number.value.get
        for batch in batches:
            ids, counts = [np.zeros(0, np.int32)], [np.zeros(0, np.int32)]
            for text in batch.column("text"):
                found = np.array([get(t, -1) for t in TERM.findall((text.as_py() or "").lower())], dtype=np.int32)
                found.sort()
                at = np.flatnonzero(np.diff(found, prepend=-1) > 0)  # -1, a word without a number, is no rise
                ids.append(found[at])
                counts.append(np.diff(at, append=len(found)).astype(np.int32))
            ends = pa.array(np.cumsum([len(x) for x in ids]), pa.int32())
            lists = [pa.ListArray.from_arrays(ends, pa.array(np.concatenate(x))) for x in (ids, counts)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in own), *lists], [*own, "ids", "counts"])

    own = ("doc_id", *more)
    return docs.select(F.col("doc_id").cast("long"), *more, "text").mapInArrow(run, ", ".join(f"{c} long" for c in own) + ", ids array<int>, counts array<int>")


def _ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The numbers of all runs start .. start + size - 1."""
    return np.repeat(start - np.cumsum(size) + size, size) + np.arange(size.sum())


class BlockMaxIndex:
    """Inverted index over unit vectors; exact nearest neighbours by cosine with block-max pruning."""

    def __init__(self, vectors: list[tuple[np.ndarray, np.ndarray]], n_terms: int, block: int = BLOCK):
        terms, weights = (np.concatenate(x) if vectors else np.zeros(0, int) for x in (([t for t, _ in vectors]), ([w for _, w in vectors])))
        self._build(np.array([len(t) for t, _ in vectors], dtype=np.int64), terms, weights, n_terms, block)

    @classmethod
    def flat(cls, sizes: np.ndarray, terms: np.ndarray, weights: np.ndarray, n_terms: int, block: int = BLOCK) -> BlockMaxIndex:
        """The same from the terms and weights of all vectors, one after another."""
        out = cls.__new__(cls)
        out._build(sizes, terms, weights, n_terms, block)
        return out

    def _build(self, sizes, terms, weights, n_terms, block):
        self.block, self.n, self.blocks, self.scored = block, len(sizes), -(-len(sizes) // block), 0
        self.sizes, self.terms, self.weights = sizes, terms.astype(np.int32, copy=False), weights
        self.start = np.cumsum(sizes) - sizes
        df = np.bincount(self.terms, minlength=n_terms)
        #: A row per common term, -1 for the others.
        self.row = np.full(n_terms, -1, np.int32)
        common = np.argsort(-df, kind="stable")[:COMMON]
        common = common[df[common] * 8 > self.n]
        self.row[common] = np.arange(len(common))
        self.table = np.zeros((len(common), self.blocks * block), np.float32)
        #: Postings (example, weight) in the order of term and example, each as eight bytes, and where those of each term begin.
        order = np.argsort(self.terms, kind="stable")
        both = np.empty((len(order), 2), np.int32)
        both[:, 0] = np.repeat(np.arange(self.n, dtype=np.int32), sizes)[order]
        both[:, 1] = weights[order].astype(np.float32).view(np.int32)
        self.postings = both.view(np.int64).ravel()
        self.cut = np.concatenate([[0], np.cumsum(df)])
        for i, t in enumerate(common):
            own = self.postings[self.cut[t] : self.cut[t + 1]]
            self.table[i, own.view(np.int32)[::2]] = own.view(np.float32)[1::2]
        self.asked = np.zeros(n_terms)

    def _exact(self, rows: np.ndarray) -> np.ndarray:
        """Cosines of the examples, none of them empty, with the query in ``asked``."""
        out = []
        for i in range(0, len(rows), 1024):
            size = self.sizes[rows[i : i + 1024]]
            at = _ranges(self.start[rows[i : i + 1024]], size)
            out.append(np.add.reduceat(self.asked[self.terms[at]] * self.weights[at], np.cumsum(size) - size))
        return np.round(np.concatenate(out), 12) if out else np.zeros(0)

    def _near(self, terms, weights, rough, k):
        """``rough``: sums over the common terms."""
        own = self.row[terms] < 0
        begin, end = self.cut[terms[own]], self.cut[terms[own] + 1]
        if len(begin):
            found = np.concatenate([self.postings[a:b] for a, b in zip(begin.tolist(), end.tolist(), strict=True)])
            add = np.repeat(weights[own].astype(np.float32), end - begin)
            add *= found.view(np.float32)[1::2]
            rough = rough + np.bincount(found.view(np.int32)[::2], add, len(rough))
        rough = rough.reshape(self.blocks, self.block)
        reach = rough.max(axis=1)
        # The most promising blocks give k cosines; of the other blocks those are looked into that could reach the last of them.
        some = rough[np.argpartition(reach, -k)[-k:] if self.blocks > k else slice(None)].ravel()
        floor = np.partition(some, -k)[-k] - 2 * SLACK if len(some) > k else 0.0
        inside = np.flatnonzero((reach > 0) & (reach >= floor))
        self.scored += len(inside)
        at, place = np.nonzero((rough[inside] > 0) & (rough[inside] >= floor))
        near = inside[at] * self.block + place
        self.asked[terms] = weights
        score = self._exact(near)
        self.asked[terms] = 0
        own = np.flatnonzero(score > 0)
        own = own[np.lexsort((near[own], -score[own]))[:k]]
        return list(zip(score[own].tolist(), near[own].tolist(), strict=True))

    def nearest_of(self, queries: list[tuple[np.ndarray, np.ndarray]], k: int):
        """For each query the k largest (cosine, example), equal cosines by the smaller example; only cosines above 0."""
        for i in range(0, len(queries), TOGETHER):
            own = [(np.asarray(t, dtype=np.int64), w) for t, w in queries[i : i + TOGETHER]]
            asked = np.zeros((len(own), len(self.table)), np.float32)
            for j, (terms, weights) in enumerate(own):
                row = self.row[terms]
                asked[j, row[row >= 0]] = weights[row >= 0]
            rough = asked @ self.table
            for j, (terms, weights) in enumerate(own):
                yield self._near(terms, weights, rough[j], k) if self.n else []

    def nearest(self, terms: np.ndarray, weights: np.ndarray, k: int) -> list[tuple[float, int]]:
        return next(self.nearest_of([(terms, weights)], k))


def unit(ids, counts, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    t = np.asarray(ids, dtype=np.int64)
    w = (1 + np.log(np.asarray(counts, dtype=float))) * idf[t] if len(t) else np.zeros(0)
    return t, w / math.sqrt((w * w).sum()) if len(t) else w


class Examples:
    """The examples as they are sent: counts of words one after another. Each Python process makes the index once."""

    def __init__(self, sizes: np.ndarray, ids: np.ndarray, counts: np.ndarray, weight: np.ndarray, votes: tuple, names: pa.Array):
        self.sizes, self.ids, self.counts, self.weight, self.votes, self.names = sizes, ids, counts, weight, votes, names

    @cached_property
    def index(self) -> BlockMaxIndex:
        w = (1 + np.log(self.counts)) * self.weight[self.ids]
        if len(w):
            w /= np.repeat(np.sqrt(np.add.reduceat(w * w, np.cumsum(self.sizes) - self.sizes)), self.sizes)
        return BlockMaxIndex.flat(self.sizes, self.ids, w, len(self.weight))


def score(docs: DataFrame, train: DataFrame, labels: DataFrame, neighbours: int = NEIGHBOURS) -> DataFrame:
    """doc_id, score, terms, neighbours (doc_id, cosine, yes, no) of every row of ``docs``; examples come from ``train``."""
    spark = docs.sparkSession
    examples = written(labelled(train, labels), "toxic-examples")
    terms, chi2 = weigh_terms(examples)
    number = spark.sparkContext.broadcast({t: i for i, t in enumerate(terms)})
    found = written(profiles(docs, number), "toxic-profiles")
    n_docs, df = found.count(), np.zeros(len(terms))
    told = found.select(F.explode("ids").alias("i")).groupBy("i").agg(F.count(F.lit(1)).alias("n")).toArrow()
    df[told["i"].to_numpy()] = told["n"].to_numpy()
    weight = (np.log((1 + n_docs) / (1 + df)) + 1) * chi2
    own = profiles(examples, number, ("yes", "no"))
    rows = own.groupBy("ids", "counts").agg(F.sum("yes").alias("yes"), F.sum("no").alias("no"), F.min("doc_id").alias("doc_id")).toArrow()  # at most EXAMPLES
    votes = list(zip(*(rows[c].to_pylist() for c in ("doc_id", "yes", "no")), strict=True))
    sizes = np.array([len(x) for x in rows["ids"]], dtype=np.int64)
    flat = [pa.chunked_array([x.flatten() for x in rows[c].chunks], pa.int32()).to_numpy() for c in ("ids", "counts")]
    start = np.cumsum(sizes) - sizes
    yes, total = sum(y for _, y, _ in votes), sum(y + n for _, y, n in votes)
    prior = yes / total if total else 0.0
    empty = [v for v, n in zip(votes, sizes, strict=True) if not n]
    none = (sum(y for _, y, _ in empty) + prior) / (sum(y + n for _, y, n in empty) + 1)

    def place(i):
        ids, counts = (x[start[i] : start[i] + sizes[i]] for x in flat)
        return ids[((1 + np.log(counts)) * weight[ids]).argmax()], ids.tobytes(), counts.tobytes()

    # Examples with the same heaviest term lie side by side, so that few blocks hold what a text could be near to.
    full = np.array(sorted(np.flatnonzero(sizes), key=place), dtype=np.int64)
    at = _ranges(start[full], sizes[full])
    names = pa.array(terms, pa.string())
    told = (pa.array([votes[i][0] for i in full], pa.int64()), *(np.array([votes[i][c] for i in full], dtype=np.int64) for c in (1, 2)))
    sent = spark.sparkContext.broadcast(Examples(sizes[full], flat[0][at], flat[1][at], weight, told, names))
    number.unpersist()

    def run(batches):
        search, (doc_ids, yes, no), weight = sent.value.index, sent.value.votes, sent.value.weight
        for batch in batches:
            lists = [batch.column(c) for c in ("ids", "counts")]
            ends = lists[0].offsets.to_numpy()
            ids, counts = (x.values.to_numpy() for x in lists)  # from the offsets' start, also of a slice
            of, which = {}, []
            for a, b in pairwise(ends.tolist()):
                key = hashlib.blake2b(ids[a:b].tobytes() + counts[a:b].tobytes(), digest_size=16).digest()
                which.append(of.setdefault(key, len(of)))
            which = np.array(which, dtype=np.int64)
            first = np.unique(which, return_index=True)[1]
            queries = [unit(ids[ends[i] : ends[i + 1]], counts[ends[i] : ends[i + 1]], weight) for i in first]
            known, found, cosines = np.empty(len(queries)), [], []
            for i, near in enumerate(search.nearest_of(queries, neighbours)):
                at, cosine = np.array([x for _, x in near], dtype=np.int64), np.array([x for x, _ in near])
                w = 1 / (1.05 - cosine)
                known[i] = (math.fsum(w * yes[at]) + prior) / (math.fsum(w * (yes[at] + no[at])) + 1) if near else none
                found.append(at)
                cosines.append(cosine)
            size = np.array([len(x) for x in found], dtype=np.int64)
            each = _ranges((np.cumsum(size) - size)[which], size[which]) if len(which) else np.zeros(0, np.int64)
            at, cosine = (np.concatenate(x)[each] if x else np.zeros(0, t) for x, t in ((found, np.int64), (cosines, float)))
            evidence = pa.StructArray.from_arrays([doc_ids.take(pa.array(at)), pa.array(cosine), pa.array(yes[at]), pa.array(no[at])], ["doc_id", "cosine", "yes", "no"])
            told = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size[which])]), pa.int32()), evidence)
            words = pa.ListArray.from_arrays(pa.array(ends - ends[0], pa.int32()), sent.value.names.take(lists[0].flatten()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(known[which]), words, told], ["doc_id", "score", "terms", "neighbours"])

    return found.mapInArrow(run, "doc_id long, score double, terms array<string>, neighbours array<struct<doc_id:long,cosine:double,yes:long,no:long>>")
