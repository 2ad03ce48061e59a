"""Jaccard join of word n-grams in prefix trees, down to its connected components.

A document is the set of its five-word shingles (64-bit hashes); equal sets are one node. All sets stand in one global order of
shingles, commonest first, and are stored in prefix trees: a stretch that sets share is one edge. A probe goes down a tree with the
overlap it has so far, which all sets below an edge share, and leaves a subtree when the overlap plus what can still follow (the shorter
of its own rest and the longest rest below) is too small for the smallest set there, when no size there is near enough, or when all sets there are in
its component already.

Who meets in which tree: two linked sets share one of their n - ceil(s n) + 1 rarest shingles (s: the similarity).
First, in hash order, a set stays open only if enough of its first shingles (three tenths of them) occur in another set.
Then the shingles of open sets are counted exactly, and their rarest ones tell groups. Each group follows its member with most company (its leader);
sets of one leader go to chunks of at most ``chunk`` sets, each joined with itself in a tree. Where groups still span components, each of their sets
probes the chunks of the other members, in blocks. So a pair of linked sets is either met in a tree or already in one component: no link
between components is lost, and neither pairs of a group nor whole groups are ever listed.

Defined results: fewer words than a shingle are one shingle; texts without words are empty sets, linked with nothing, their component their
own doc_id; a component is named by its smallest doc_id (null if all are null); repeated rows each get their row; an empty table gives no rows;
further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import md5

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.hashing import hash_words, run_hashes, signed, split_words
from tidemark.llm.neardup import components
from tidemark.llm.shared import row_key, slices, written

SHINGLE, PERCENT = 5, 80
SLICE_CHARS = 4_000_000  # of text that one step holds as arrays
WORDS = 1 << 20  # of the bitmap of open sets, 64 bits each
CHUNK, CODES = 256, 1_000_000  # sets and codes that a tree holds; probes come in blocks of four times as many


def shingle_set(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """Distinct shingle hashes in order, of words with A-Z in lower case."""
    return np.unique(signed(run_hashes(hash_words([w.lower() for w in split_words(text)]), size)))  # bytes.lower() knows A-Z only


def _head(n: int, percent: int) -> tuple[int, int]:
    """How many shingles of a set of n tell whether it is open, and how many of them must occur elsewhere.

    Two linked sets share at least ceil(s n) shingles of each, so the first k they share stand among the first n - ceil(s n) + k
    of both; k is a tenth of the smaller set at least, which has ceil(s n) shingles or more.
    """
    least = -(-percent * n // 100)
    return min(n, n - least + max(1, n // 10)), max(1, least // 10)


def sets(docs: DataFrame, percent: int = PERCENT, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, text_md5, key (digest of the set), n, head and need of every document.

    Heads hold 48 bits of each hash, which is less to move: where two hashes look alike, a set more stays open, and none is closed.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for i, j in slices([len(t or "") for t in texts], SLICE_CHARS):
                own = [shingle_set(t, shingle) for t in texts[i:j]]
                told = [_head(len(x), percent) if len(x) else (0, 0) for x in own]
                yield pa.RecordBatch.from_arrays([
                    batch.column("doc_id").slice(i, j - i), batch.column("text_md5").slice(i, j - i), pa.array([md5(x.tobytes()).digest() for x in own], pa.binary()), pa.array([len(x) for x in own], pa.int64()),
                    pa.array([x[:k] >> 16 for x, (k, _) in zip(own, told, strict=True)], pa.list_(pa.int64())), pa.array([k for _, k in told], pa.int64())], ["doc_id", "text_md5", "key", "n", "head", "need"])

    return docs.select(*row_key(F.col("doc_id").cast("long"), F.col("text")), "text").mapInArrow(run, "doc_id long, text_md5 string, key binary, n long, head array<long>, need long")


def open_sets(own: DataFrame, nodes: DataFrame) -> DataFrame:
    """Of nodes (node, key, pick), those whose sets can be linked at all, by their heads; a repeated row only makes its set stay."""
    there = (F.col("key") == F.col("_key")) & (F.col("text_md5") == F.col("pick.text_md5")) & F.col("doc_id").eqNullSafe(F.col("pick.doc_id"))
    heads = own.join(nodes.select("node", F.col("key").alias("_key"), "pick"), there)
    each = heads.select("node", F.explode("head").alias("h"))
    shared = each.groupBy("h").agg(F.count(F.lit(1)).alias("df")).where("df > 1").select("h")
    met = each.join(shared, "h").groupBy("node").agg(F.count(F.lit(1)).alias("k"))
    return nodes.join(met, "node").where("k >= need").select("node", "pick")


def coded(texts: DataFrame, percent: int = PERCENT, shingle: int = SHINGLE) -> DataFrame:
    """node, n, codes (shingles that another set has, commonest first), rare (how many of the last may be a first common one).

    A code is 63 less the binary logarithm of the number of sets, then 57 bits of the hash: the global order.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for i, j in slices([len(t or "") for t in texts], SLICE_CHARS):
                own = [shingle_set(t, shingle) for t in texts[i:j]]
                yield pa.RecordBatch.from_arrays([batch.column("node").slice(i, j - i), pa.array([len(x) for x in own], pa.int64()), pa.array(own, pa.list_(pa.int64()))], ["node", "n", "h"])

    own = written(texts.select("node", "text").mapInArrow(run, "node long, n long, h array<long>"), "prefixtree-open")
    each = own.select("node", F.explode("h").alias("h"))
    df = each.groupBy("h").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    code = (F.lit(63) - F.floor(F.log2("df"))) * F.lit(1 << 57) + F.shiftrightunsigned("h", 7)
    codes = each.join(df, "h").groupBy("node").agg(F.sort_array(F.collect_list(code)).alias("codes"))
    rare = F.floor(F.col("n") - F.ceil(F.col("n") * percent / 100)) + 1 - (F.col("n") - F.size("codes"))
    return own.select("node", "n").join(codes, "node").select("node", "n", "codes", F.least(rare.cast("int"), F.size("codes")).alias("rare")).where("rare > 0")


class PrefixTree:
    """Sets of codes (sorted arrays) in a tree whose edges are shared stretches; children of a tree node are ranges of the sorted sets."""

    def __init__(self, nodes: list[int], sizes: list[int], codes: list[np.ndarray]):
        order = sorted(range(len(nodes)), key=lambda k: codes[k].astype(">i8").tobytes())
        self.nodes, self.sizes, self.codes = [nodes[k] for k in order], np.array([sizes[k] for k in order], np.int64), [codes[k] for k in order]
        self.long = np.array([len(c) for c in self.codes], np.int64)
        shared = [0]
        for a, b in zip(self.codes, self.codes[1:], strict=False):
            k = min(len(a), len(b))
            differ = np.flatnonzero(a[:k] != b[:k])
            shared.append(int(differ[0]) if len(differ) else k)
        self.shared = np.array(shared, np.int64)  # codes that a set begins with as the one before
        self.below: dict[tuple[int, int], tuple] = {}

    def node(self, lo: int, hi: int) -> tuple:
        """Depth to which the sets lo .. hi - 1 are alike, their smallest and largest size, their longest, and the ranges of the children."""
        if (lo, hi) not in self.below:
            inner = self.shared[lo + 1 : hi]
            depth = int(inner.min()) if hi - lo > 1 else int(self.long[lo])
            cuts = [lo, *(np.flatnonzero(inner == depth) + lo + 1).tolist(), hi] if hi - lo > 1 else []
            size = self.sizes[lo:hi]
            self.below[lo, hi] = depth, int(size.min()), int(size.max()), int(self.long[lo:hi].max()), list(zip(cuts, cuts[1:], strict=False))
        return self.below[lo, hi]

    def links(self, size: int, codes: np.ndarray, percent: int, label: np.ndarray, own) -> Iterator[int]:
        """Sets linked with a probe, but none whose label is ``own()`` when its subtree is reached."""
        stack = [(0, len(self.nodes), 0, 0, 0)] if self.nodes else []
        while stack:
            lo, hi, depth, at, overlap = stack.pop()
            if (label[lo:hi] == own()).all():
                continue
            to, small, large, long, children = self.node(lo, hi)
            if 100 * min(size, large) < percent * size or 100 * size < percent * small:
                continue
            if to > depth:
                edge = self.codes[lo][depth:to]
                place = at + np.searchsorted(codes[at:], edge)
                found = place < len(codes)
                overlap += int((codes[place[found]] == edge[found]).sum())
                at += int(np.searchsorted(codes[at:], edge[-1], side="right"))
            if (100 + percent) * (overlap + min(len(codes) - at, long - to)) < percent * (size + small):
                continue
            if children:
                stack += [(a, b, to, at, overlap) for a, b in children]
            elif (100 + percent) * overlap >= percent * (size + int(self.sizes[lo])):
                yield lo


def tree_links(tree: pd.DataFrame, probes: pd.DataFrame, percent: int) -> list[tuple[int, int]]:
    """Components joined by links between the sets of a tree and probes (node, n, codes, c: component so far), as pairs with the smallest; a set may be both."""
    t = PrefixTree(tree["node"].tolist(), tree["n"].tolist(), [np.asarray(x) for x in tree["codes"]])
    component = dict(zip(tree["node"], tree["c"], strict=True)) | dict(zip(probes["node"], probes["c"], strict=True))
    label = np.array([component[n] for n in t.nodes], np.int64)
    up: dict[int, int] = {}

    def root(x):
        while x in up:
            x = up[x]
        return x

    met = set()
    for node, size, codes in zip(probes["node"], probes["n"], probes["codes"], strict=True):
        mine = component[node]
        for k in t.links(size, np.asarray(codes), percent, label, lambda mine=mine: root(mine)):
            a, b = sorted((root(mine), int(label[k])))
            if a != b:
                up[b] = a
                label[label == b] = a
                met |= {a, b}
    return [(x, root(x)) for x in met if root(x) != x]  # all to the smallest one, so that few rounds join them


def join(sets_: DataFrame, percent: int = PERCENT, chunk: int = CHUNK) -> DataFrame:
    """node, component of the linked sets among (node, n, codes, rare)."""
    sets_ = written(sets_, "prefixtree-sets")
    rare = sets_.select("node", "n", F.explode(F.slice("codes", F.size("codes") - F.col("rare") + 1, F.col("rare"))).alias("code"))
    count = rare.groupBy("code").agg(F.count(F.lit(1)).alias("m")).where("m > 1")
    met = written(rare.join(count, "code"), "prefixtree-groups")
    # The leader of a group is its member with most company, that of a set the leader of most of its groups.
    company = met.groupBy("node").agg(F.sum("m").alias("company"))
    lead = met.join(company, "node").groupBy("code").agg(F.max_by("node", F.struct("company", -F.col("node"))).alias("leader"))
    home = met.join(lead, "code").groupBy("node", "leader").agg(F.count(F.lit(1)).alias("k"), F.first("n").alias("n"))
    home = written(home.groupBy("node").agg(F.max_by("leader", F.struct("k", -F.col("leader"))).alias("leader"), F.first("n").alias("n")), "prefixtree-homes")
    parts = home.groupBy("leader").agg(F.greatest(F.ceil(F.count(F.lit(1)) / chunk), F.ceil(F.sum("n") / CODES)).alias("parts"))
    home = written(home.join(parts, "leader").select("node", "leader", F.pmod(F.xxhash64("node"), "parts").alias("part"), "parts"), "prefixtree-chunks")
    guests = home.select(F.col("leader").alias("node"), "leader", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part")).distinct()
    placed = home.select("node", "leader", "part").union(guests).distinct()  # a leader stands in each chunk of its own
    inside = sets_.select("node", "n", "codes", F.col("node").alias("c")).join(placed, "node")

    def own(x: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(tree_links(x, x, percent), columns=["a", "b"], dtype="int64")

    first = written(inside.groupBy("leader", "part").applyInPandas(own, "a long, b long"), "prefixtree-links")
    label = written(components(first), "prefixtree-components")
    # Groups that still span components: each set probes the chunks of the other members.
    # Of two components the smaller one (by sets, then number) probes, so outliers look into the chunks of a large one and not the other way round.
    weight = label.groupBy("component").agg(F.count(F.lit(1)).alias("sets"))
    label = label.join(weight, "component").select("node", "component", "sets")
    known = met.join(label, "node", "left").withColumn("c", F.struct(F.coalesce("sets", F.lit(1)).alias("sets"), F.coalesce("component", "node").alias("id")))
    known = written(known.join(home.select("node", "leader", "part"), "node").select("code", "node", "n", "c", "leader", "part"), "prefixtree-known")
    there = known.groupBy("code", "leader", "part").agg(F.max("c").alias("hi"), F.min("n").alias("n_lo"), F.max("n").alias("n_hi"))
    lowest = known.groupBy("code").agg(F.min("c").alias("least"), F.max("c").alias("most")).where("least != most").select("code", "least", "most")
    k, t = known.join(lowest, "code").where("c < most").alias("k"), there.join(lowest, "code").where("hi > least").alias("t")
    other = (F.col("k.c") < F.col("t.hi")) & ((F.col("k.leader") != F.col("t.leader")) | (F.col("k.part") != F.col("t.part")))
    near = (F.col("t.n_hi") * 100 >= F.col("k.n") * percent) & (F.col("k.n") * 100 >= F.col("t.n_lo") * percent)
    asks = written(k.join(t, (F.col("k.code") == F.col("t.code")) & other & near).select("k.node", "k.n", F.col("k.c.id").alias("c"), "t.leader", "t.part").distinct(), "prefixtree-asks")
    blocks = asks.groupBy("leader", "part").agg(F.greatest(F.ceil(F.count(F.lit(1)) / (4 * chunk)), F.ceil(F.sum("n") / (4 * CODES))).alias("blocks"))
    asks = asks.drop("n").join(blocks, ["leader", "part"]).withColumn("block", F.pmod(F.xxhash64("node"), "blocks"))
    probes = asks.join(sets_.select("node", "n", "codes"), "node").select("leader", "part", "block", "node", "n", "codes", "c")
    trees = home.join(blocks, ["leader", "part"]).withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    trees = trees.join(sets_.select("node", "n", "codes"), "node").join(label, "node", "left").select("leader", "part", "block", "node", "n", "codes", F.coalesce("component", "node").alias("c"))

    def across(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(tree_links(x, y, percent) if len(x) and len(y) else [], columns=["a", "b"], dtype="int64")

    by = ["leader", "part", "block"]
    trees, probes = trees.toDF(*trees.columns), probes.toDF(*probes.columns)  # columns of their own, though both come from the sets
    more = written(trees.groupBy(*by).cogroup(probes.groupBy(*by)).applyInPandas(across, "a long, b long"), "prefixtree-links")
    return label.select("node", "component") if more.isEmpty() else written(components(first.union(more)), "prefixtree-components")


def _place(df: DataFrame) -> DataFrame:
    h = F.xxhash64("doc_id", "text_md5")
    return df.withColumns({"_word": F.pmod(h, F.lit(WORDS)), "_bit": F.pmod(F.shiftright(h, 32), F.lit(64)).cast("int")})


def bitmap(rows: DataFrame) -> DataFrame:
    """A bit for each hash of (doc_id, text_md5), in words of 64: ``WORDS`` rows at most, whatever the input."""
    return _place(rows).groupBy("_word").agg(F.bit_or(F.expr("shiftleft(1L, _bit)")).alias("_bits"))


def marked(rows: DataFrame, bits: DataFrame) -> DataFrame:
    """The rows whose bit is set: all that the bitmap was made of, and few others as long as it is sparse. Saves shuffling the texts of closed sets."""
    x = _place(rows).join(F.broadcast(bits), "_word").where("(_bits & shiftleft(1L, _bit)) != 0")
    return x.select(*rows.columns)


def linked(docs: DataFrame, percent: int = PERCENT, shingle: int = SHINGLE, chunk: int = CHUNK) -> DataFrame:
    """doc_id, n_shingles, component_id of every row."""
    own = written(sets(docs, percent, shingle), "prefixtree-documents")
    nodes = own.where("n > 0").groupBy("key").agg(F.min("doc_id").alias("rep"), F.min(F.struct("doc_id", "text_md5")).alias("pick"), F.first("need").alias("need"))
    nodes = written(nodes.withColumn("node", F.monotonically_increasing_id()), "prefixtree-nodes")
    some = written(open_sets(own, nodes), "prefixtree-open-nodes")
    texts = docs.select(*row_key(F.col("doc_id").cast("long"), F.col("text")), "text")
    texts = marked(texts, bitmap(some.select("pick.*"))).join(some, (F.col("text_md5") == F.col("pick.text_md5")) & texts["doc_id"].eqNullSafe(F.col("pick.doc_id"))).select("node", "text").dropDuplicates(["node"])
    label = join(coded(texts, percent, shingle), percent, chunk)
    named = nodes.select("node", "key", "rep").join(label, "node", "left").withColumn("component", F.coalesce("component", "node"))
    named = named.join(named.groupBy("component").agg(F.min("rep").alias("component_id")), "component").select(F.col("key").alias("_key"), "component_id")
    return own.join(named, F.col("key") == F.col("_key"), "left").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))
