"""Substring dedup: words of passages that an earlier document has too are removed.

A window is ``window`` consecutive words; it is removed from a document if its words also start in a document with a smaller
id. Anchors find where that can be: every window has the same smallest 8-word hash wherever it occurs (winnowing), so equal
windows of two documents meet at one anchor. Only anchors that two different texts have are looked at further: the
words around them (contexts, which hold all their windows) are sent to the shard of their anchor. A shard builds the suffix
automaton of its distinct contexts, each state marked with the smallest id it occurs in, and streams them
for matching statistics: where the match is a window long, the state of that window tells the earliest document.

The automata are not broadcast to every document: with S shards that would stream the corpus S times. A document meets
the shards its anchors lead to and no others, which finds the same spans and grows in proportion to the input.

Equal texts count once, as the smallest id; in the others every window has an earlier start. An anchor with more distinct
contexts than a shard holds (the rim of a very common passage) is taken apart into single windows, grouped by digest
of their words. Defined results: a null text has no words; texts shorter than a window stay; a null doc_id is neither
smaller nor larger than another, so such rows stay whole; rows of the same id don't remove each other; an
empty table gives no rows; further columns are kept by ``dedup``.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.hashing import hash_words, run_hashes, signed, split_words
from tidemark.llm.shared import written

WINDOW, ANCHOR = 50, 8
SHARD_CONTEXTS = 2048


def anchors(words: list[bytes], window: int = WINDOW, size: int = ANCHOR) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash of the anchor and first and last window of each run of windows that share one."""
    if len(words) < window:
        return np.zeros(0, np.uint64), np.zeros(0, int), np.zeros(0, int)
    size = min(size, window)
    g = run_hashes(hash_words(words), size)
    at = np.arange(len(words) - window + 1)
    at = at + np.lib.stride_tricks.sliding_window_view(g, window - size + 1).argmin(axis=1)
    first = np.concatenate([[0], np.flatnonzero(np.diff(at)) + 1])
    return g[at[first]], first, np.concatenate([first[1:], [len(at)]]) - 1


class Automaton:
    """Suffix automaton over several word sequences; each state knows the smallest mark of the sequences it occurs in."""

    def __init__(self):
        self.next, self.link, self.length, self.mark = [{}], [-1], [0], [None]

    def _state(self, length, follow, link):
        self.next.append(follow)
        self.link.append(link)
        self.length.append(length)
        self.mark.append(None)
        return len(self.length) - 1

    def _split(self, p, word, q):
        """The state of the strings of q that end p + word, made apart from the longer ones."""
        if self.length[p] + 1 == self.length[q]:
            return q
        own = self._state(self.length[p] + 1, dict(self.next[q]), self.link[q])
        self.link[q] = own
        while p >= 0 and self.next[p].get(word) == q:
            self.next[p][word] = own
            p = self.link[p]
        return own

    def add(self, words, mark):
        at = 0
        for word in words:
            p, q = at, self.next[at].get(word)
            if q is not None:
                at = self._split(p, word, q)
            else:
                at = self._state(self.length[p] + 1, {}, 0)
                while p >= 0 and word not in self.next[p]:
                    self.next[p][word] = at
                    p = self.link[p]
                if p >= 0:
                    self.link[at] = self._split(p, word, self.next[p][word])
            if self.mark[at] is None or mark < self.mark[at]:
                self.mark[at] = mark

    def close(self):
        """What a string occurs in, its suffixes occur in."""
        for s in sorted(range(1, len(self.length)), key=self.length.__getitem__, reverse=True):
            up = self.link[s]
            if self.mark[up] is None or self.mark[s] < self.mark[up]:
                self.mark[up] = self.mark[s]

    def earliest(self, words, window):
        """Streams words; for each of their windows, the smallest mark of a sequence that holds it, else None."""
        at = matched = 0
        for i, word in enumerate(words):
            while at and word not in self.next[at]:
                at = self.link[at]
                matched = self.length[at]
            if word in self.next[at]:
                at, matched = self.next[at][word], matched + 1
            while matched >= window and self.length[self.link[at]] >= window:
                at = self.link[at]
            matched = min(matched, max(window, 0)) if matched >= window else matched
            if i >= window - 1:
                yield self.mark[at] if matched >= window else None


def _md5():
    return F.md5(F.coalesce("text", F.lit("")).cast("binary"))


def earliest_windows(docs: DataFrame, window: int = WINDOW, shard: int = SHARD_CONTEXTS) -> DataFrame:
    """doc_id, text_md5, whole, starts: the windows to remove of each document that loses any; ``whole`` is a later copy."""

    def runs(batches):
        for batch in batches:
            rows = []
            for text in batch.column("text").to_pylist():
                h, first, last = anchors(split_words(text), window)
                rows.append([{"h": a, "i": b, "j": c} for a, b, c in zip(signed(h).tolist(), first.tolist(), last.tolist(), strict=True)])
            kind = pa.list_(pa.struct([("h", pa.int64()), ("i", pa.int32()), ("j", pa.int32())]))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_md5"), pa.array(rows, kind)], ["doc_id", "text_md5", "runs"])

    def cut(batches):
        for batch in batches:
            out = {"doc_id": [], "text_md5": [], "h": [], "i": [], "context": []}
            for doc, md5, text, found in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text_md5", "text", "runs")), strict=True):
                w = split_words(text)
                for r in found:
                    for k, v in zip(out, (doc, md5, r["h"], r["i"], b" ".join(w[r["i"] : r["j"] + window])), strict=True):
                        out[k].append(v)
            yield pa.RecordBatch.from_arrays([pa.array(out["doc_id"], pa.int64()), pa.array(out["text_md5"], pa.string()), pa.array(out["h"], pa.int64()), pa.array(out["i"], pa.int32()), pa.array(out["context"], pa.binary())], list(out))

    def match(pdf: pd.DataFrame) -> pd.DataFrame:
        a, texts = Automaton(), [c.split() for c in pdf["context"]]
        for w, mark in zip(texts, pdf["mark"].tolist(), strict=True):
            a.add(w, mark)
        a.close()
        return pd.DataFrame({"h": pdf["h"], "c": pdf["c"], "marks": [list(a.earliest(w, window)) for w in texts]})

    own = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), _md5().alias("text_md5"), "text")
    found = written(own.mapInArrow(runs, "doc_id long, text_md5 string, runs array<struct<h:long,i:int,j:int>>").where(F.size("runs") > 0), "substring-runs")
    reps = found.groupBy("text_md5").agg(F.min_by(F.struct("doc_id", "runs"), "doc_id").alias("r"), F.max("doc_id").alias("last")).select("text_md5", "r.doc_id", "r.runs", "last")
    reps = written(reps, "substring-texts")
    common = reps.select(F.explode(F.array_distinct(F.transform("runs", lambda r: r["h"]))).alias("h")).groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("h")
    look = reps.select("doc_id", "text_md5", F.inline("runs")).join(common, "h").groupBy("doc_id", "text_md5").agg(F.collect_list(F.struct("h", "i", "j")).alias("runs"))
    look = own.dropDuplicates(["doc_id", "text_md5"]).join(look, ["doc_id", "text_md5"]).select("doc_id", "text_md5", "text", "runs")
    contexts = look.mapInArrow(cut, "doc_id long, text_md5 string, h long, i int, context binary").withColumn("c", F.md5("context"))
    contexts = written(contexts, "substring-contexts")

    distinct = contexts.groupBy("h", "c").agg(F.min("doc_id").alias("mark"), F.first("context").alias("context"))
    distinct = written(distinct, "substring-distinct")
    hot = distinct.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > shard).select("h")
    n_shards = max(1, distinct.count() // (shard // 2))
    cold = distinct.join(hot, "h", "left_anti").withColumn("shard", F.pmod(F.xxhash64("h"), F.lit(n_shards)))
    known = cold.groupBy("shard").applyInPandas(match, "h long, c string, marks array<long>")
    # Hot anchors: each window on its own, so that no group is larger than a count of equal windows.
    single = distinct.join(hot, "h", "left_semi").select("h", "c", "mark", F.split(F.decode("context", "UTF-8"), " ").alias("w"))
    single = single.select("h", "c", "mark", F.posexplode(F.transform(F.sequence(F.lit(1), F.size("w") - (window - 1)), lambda k: F.md5(F.array_join(F.slice("w", k, window), " ").cast("binary")))).alias("k", "digest"))
    first = single.groupBy("digest").agg(F.min("mark").alias("first"))
    rest = single.join(first, "digest").groupBy("h", "c").agg(F.array_sort(F.collect_list(F.struct("k", "first"))).alias("m")).select("h", "c", F.transform("m", lambda m: m["first"]).alias("marks"))
    known = written(known.union(rest), "substring-marks")

    starts = contexts.select("doc_id", "text_md5", "h", "c", "i").join(known, ["h", "c"])
    starts = starts.select("doc_id", "text_md5", F.filter(F.transform("marks", lambda m, k: F.when(m < F.col("doc_id"), F.col("i") + k)), lambda x: x.isNotNull()).alias("starts")).where(F.size("starts") > 0)
    starts = starts.groupBy("doc_id", "text_md5").agg(F.flatten(F.collect_list("starts")).alias("starts")).select("doc_id", "text_md5", F.lit(False).alias("whole"), "starts")
    again = reps.where("last > doc_id").select(F.col("text_md5").alias("_md5"), F.col("doc_id").alias("_first"))
    copies = found.select("doc_id", "text_md5").join(again, (F.col("text_md5") == F.col("_md5")) & (F.col("doc_id") > F.col("_first"))).select("doc_id", "text_md5").distinct()
    return starts.union(copies.select("doc_id", "text_md5", F.lit(True), F.array().cast("array<int>")))


def dedup(docs: DataFrame, window: int = WINDOW, shard: int = SHARD_CONTEXTS, keep_whole: bool = False) -> DataFrame:
    """``row`` (the columns other than text), n_words, n_removed, kept (the words that stay, joined by one space), of every row.

    ``keep_whole`` adds ``text`` as it came, for callers that leave documents without repeats untouched.
    """

    def strike(batches):
        for batch in batches:
            n, gone, kept = [], [], []
            for text, whole, starts in zip(*(batch.column(c).to_pylist() for c in ("text", "whole", "starts")), strict=True):
                w = split_words(text)
                cover = np.zeros(len(w) + 1, np.int64)
                if whole:
                    stay = []
                elif starts:
                    s = np.array(starts)
                    np.add.at(cover, s, 1)
                    np.add.at(cover, s + window, -1)
                    stay = [w[i] for i in np.flatnonzero(np.cumsum(cover)[:-1] == 0)]
                else:
                    stay = w
                n.append(len(w))
                gone.append(len(w) - len(stay))
                kept.append(b" ".join(stay).decode("utf-8", "surrogatepass"))
            whole_text = [batch.column("text")] if keep_whole else []
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.string()), *whole_text], ["row", "n_words", "n_removed", "kept", "text"][: 4 + len(whole_text)])

    hits = earliest_windows(docs, window, shard)
    others = F.struct(*(docs[c] for c in docs.columns if c != "text")).alias("row")
    rows = docs.select(others, F.col("doc_id").cast("long").alias("_id"), _md5().alias("_md5"), "text")
    both = rows.join(hits, (F.col("_id") == F.col("doc_id")) & (F.col("_md5") == F.col("text_md5")), "left").select("row", "text", "whole", "starts")
    kind = T.StructType([both.schema["row"], *(T.StructField(c, T.LongType()) for c in ("n_words", "n_removed")), *(T.StructField(c, T.StringType()) for c in ["kept", "text"][: 1 + keep_whole])])
    return both.mapInArrow(strike, kind)
