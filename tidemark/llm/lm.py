"""Log-likelihood of whole documents under a gated recurrent language model.

Tokens are words with A-Z in lower case, and one end per document. Counts of all learning tokens give the vocabulary. The
output is factored by class: frequent words ("head") share classes of about equal frequency and are told apart by a softmax
of their class; all other words are in tail classes by their first two bytes, where a word has its add-one
share of the class; the end is a class. So P(word) = P(class | state) P(word | class, state), and words never seen have
the share of one unseen word in their class. The network is a GRU whose input is the word, or its class if in the tail.

Fitting: rounds of truncated backpropagation in the tasks, each from the common weights over its own documents, state
carried from window to window; then the weights are averaged, block by block, in Spark. The output starts as the unigram
model. The rounds share out all learning documents by hash of id and text, so each is learned once, copies of a text under
other ids in other rounds. Scoring reads every text whole, carrying state across windows.

What is broadcast is bounded: the words of the largest counts, at most ``KNOWN`` of them. The counts of other
words are joined to the documents that hold them; no such word has more than 1 / ``KNOWN`` of all tokens.

Defined results: a null text is empty (one end token); a null doc_id belongs to no fold and learns; without any learning
document every token is unseen; repeated rows stay; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import heapq
import math
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shared import slices, written

HEAD, HEAD_CLASSES, TAIL_CLASSES, HIDDEN = 2048, 32, 32, 16
KNOWN = 1 << 18
ROUNDS, LANES, STEPS, RATE = 3, 96, 16, 0.1  # documents side by side, steps of a window
SIDE = 128  # documents side by side where nothing is learned
END = b""
SLICE_CHARS, PART, FLUSH = 24_000_000, 8192, 400_000


def split(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def held_out(doc_id: Column, folds: int = 7, fold: int = 2) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == fold, F.lit(False))


def tail_class(word: bytes) -> int:
    return zlib.crc32(word[:2]) % TAIL_CLASSES


def token_counts(docs: DataFrame) -> DataFrame:
    """word, c over all tokens of the documents; tasks add up their own words first."""

    def run(batches):
        seen = Counter()

        def flush():
            out = pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], ["word", "c"])
            seen.clear()
            return out

        for batch in batches:
            for text in batch.column("text"):
                seen.update(split(text.as_py()))
                seen[END] += 1
                if len(seen) >= FLUSH:
                    yield flush()
        if seen:
            yield flush()

    return docs.select("text").mapInArrow(run, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


class Vocabulary:
    """Numbers of the words that are broadcast. Inputs: head words, then tail classes, then the end. Classes likewise."""

    def __init__(self, words: list[tuple[bytes, int]], total: int, distinct: int, masses: dict[int, int]):
        self.total, self.distinct = total, distinct
        count = dict(words)
        head = sorted((w for w, c in words if w != END and c * HEAD >= total), key=lambda w: (-count[w], w))
        self.n_head = len(head)
        mass = np.array([count[w] for w in head], dtype=float)
        cut = np.minimum((np.cumsum(mass) - mass) / max(mass.sum(), 1) * HEAD_CLASSES, HEAD_CLASSES - 1).astype(int) if self.n_head else np.zeros(0, int)
        names = np.unique(cut)
        #: Of each head class the first word and the one after its last; head words are in the order of classes.
        self.first, self.last = np.searchsorted(cut, names), np.searchsorted(cut, names, side="right")
        self.head_class = np.searchsorted(names, cut)
        self.n_classes = len(names) + TAIL_CLASSES + 1
        sizes = self.last - self.first
        #: Whether a class is a head class of several words; the words of each head class, filled up to the largest class.
        self.shared = np.concatenate([sizes > 1, np.zeros(TAIL_CLASSES + 1, bool)])
        column = np.arange(sizes.max(initial=0))
        self.filled = column < sizes[:, None]
        self.members = self.first[:, None] + np.where(self.filled, column, 0)
        tails = np.array([masses.get(b, 0) for b in range(TAIL_CLASSES)], dtype=float)
        self.tail_log = -np.log10(tails + 1)
        inputs = {w: i for i, w in enumerate(head)} | {END: self.n_head + TAIL_CLASSES}
        #: The number of each word that is broadcast, and by number its input and the log10 of its count plus one.
        self.number = {w: i for i, (w, _) in enumerate(words)}
        self.input = np.array([i if (i := inputs.get(w)) is not None else self.n_head + tail_class(w) for w, _ in words], dtype=np.int32)
        self.log = np.log10(np.array([c for _, c in words], dtype=float) + 1)
        self.class_of = np.concatenate([self.head_class, len(names) + np.arange(TAIL_CLASSES + 1)])
        class_mass = np.concatenate([np.add.reduceat(mass, self.first) if self.n_head else mass, tails + 1, [count.get(END, 0) + 1]])
        self.class_bias = np.log(class_mass / class_mass.sum()).astype(np.float32)
        self.word_bias = np.log(mass / np.maximum(1, np.concatenate([[m] * (b - a) for m, a, b in zip(class_mass, self.first, self.last, strict=False)])) if self.n_head else mass).astype(np.float32)

    def numbers(self, words: list[bytes]) -> tuple[np.ndarray, list[bytes]]:
        """The numbers of the words, -1 for words that are not broadcast, and those words in order."""
        get = self.number.get
        own = [get(w, -1) for w in words]
        return np.array(own, dtype=np.int32), [w for w, i in zip(words, own, strict=True) if i < 0] if -1 in own else []

    def ids(self, numbers: np.ndarray, rare: list[bytes]) -> np.ndarray:
        """Inputs of a text with its end."""
        out = np.empty(len(numbers) + 1, np.int32)
        out[:-1] = self.input[numbers] if len(self.input) else 0
        if rare:
            out[:-1][numbers < 0] = [self.n_head + tail_class(w) for w in rare]
        out[-1] = self.n_head + TAIL_CLASSES
        return out

    def classes(self, ids: np.ndarray) -> np.ndarray:
        """The class of each input: that of a head word, or what follows the head classes."""
        return self.class_of[ids]


def initial(v: Vocabulary, hidden: int = HIDDEN) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(17)
    n = v.n_head + TAIL_CLASSES + 1
    small = lambda *s: (rng.standard_normal(s) * 0.1).astype(np.float32)
    return {"x": small(n, 3 * hidden), "u": small(hidden, 3 * hidden), "b": np.zeros(3 * hidden, np.float32), "c": np.zeros((hidden, v.n_classes), np.float32), "cb": v.class_bias.copy(),
            "o": np.zeros((v.n_head, hidden), np.float32), "ob": v.word_bias.copy()}


def forward(p, ids, live, h, keep=None):
    """Runs a window: ids (steps, lanes), of which the first ``live[t]`` lanes are alive at t.

    Where ``keep`` (steps, lanes) is 0, a lane starts its next document there, with an empty state. Inside, arrays have a
    row per unit and a column per lane. Returns the states before each step, what backward needs, and the state after the
    last for the lanes alive there.
    """
    n, width = h.shape[1], live[0]
    sign = np.concatenate([np.full(2 * n, -1), np.ones(n)]).astype(p["u"].dtype)  # a gate is 1 / (1 + exp(-input))
    u = np.ascontiguousarray((p["u"] * sign).T)
    x = np.ascontiguousarray(((p["x"] + p["b"]) * sign).take(ids[:, :width], axis=0).transpose(0, 2, 1))
    before, gates, news, inner = (np.empty((len(live), k, width), x.dtype) for k in (n, 2 * n, n, n))
    s = h[:width].T
    for t in range(len(live)):
        own, gate, new = before[t], gates[t], news[t]
        np.multiply(s, 1 if keep is None else keep[t, :width], out=own)
        a = u @ own
        np.add(x[t, : 2 * n], a[: 2 * n], out=gate)
        with np.errstate(over="ignore"):  # a closed gate is 0
            np.exp(gate, out=gate)
        gate += 1
        np.reciprocal(gate, out=gate)
        inner[t] = a[2 * n :]
        np.multiply(gate[:n], a[2 * n :], out=new)
        new += x[t, 2 * n :]
        np.tanh(new, out=new)
        s = own - new
        s *= gate[n:]
        s += new
    return _alive(before, live), (before, gates, news, inner, keep), s[:, : live[-1]].T


def _alive(x, live):
    """Rows of the live (step, lane) of an array (steps, units, lanes)."""
    x = x.transpose(0, 2, 1)
    if live[-1] == live[0]:
        return x.reshape(-1, x.shape[2])
    return x[np.arange(live[0]) < np.array(live)[:, None]]


def _exponentials(x, axis, own):
    """The log probabilities at ``own``, and exponentials, made in place, with their sums."""
    x -= x.max(axis=axis, keepdims=True)
    out = x[own]
    e = np.exp(x, out=x)
    total = e.sum(axis=axis, keepdims=True)
    return out, e, total


def output(p, v: Vocabulary, states, targets, grad=False):
    """Natural log of P(class) P(head word | class) of each target, and the gradient of minus their mean."""
    cls, n = v.classes(targets), len(targets)
    x, at = p["c"].T @ states.T, np.arange(n)
    x += p["cb"][:, None]
    out, e, total = _exponentials(x, 0, (cls, at))
    out = (out - np.log(total[0])).astype(np.float64)
    g, d = {}, None
    if grad:
        e *= 1 / (total * n)
        e[cls, at] -= e.dtype.type(1 / n)
        g["c"], g["cb"], d = (e @ states).T, e.sum(axis=1), (p["c"] @ e).T
        g["o"], g["ob"] = np.zeros_like(p["o"]), np.zeros_like(p["ob"])
    own = np.flatnonzero(v.shared[cls])
    if not len(own):
        return out, g, d
    # Head words of classes with others: a row of targets per class, filled up, and a column per word of the class.
    c = cls[own]
    order = np.argsort(c, kind="stable")
    own, c = own[order], c[order]
    names, first, sizes = np.unique(c, return_index=True, return_counts=True)
    row, place = np.repeat(np.arange(len(names)), sizes), np.arange(len(own)) - np.repeat(first, sizes)
    seen = np.zeros((len(names), sizes.max(), states.shape[1]), states.dtype)
    seen[row, place] = states[own]
    words = v.members[names]  # the first word again where a class has fewer, which the bias rules out
    weight, bias = p["o"][words], np.where(v.filled[names], p["ob"][words], np.asarray(-np.inf, p["ob"].dtype))
    x = seen @ weight.transpose(0, 2, 1) + bias[:, None, :]
    at = targets[own] - v.first[c]
    out_, e, total = _exponentials(x, 2, (row, place, at))
    out[own] += out_ - np.log(total[row, place, 0])
    if grad:
        told = np.zeros_like(e)
        told[row, place] = e[row, place] / total[row, place]
        told[row, place, at] -= 1
        told /= n
        full = v.filled[names]
        g["o"][words[full]] = (told.transpose(0, 2, 1) @ seen)[full]
        g["ob"][words[full]] = told.sum(axis=1)[full]
        d[own] += (told @ weight)[row, place]
    return out, g, d


def backward(p, ids, live, kept, d):
    """Gradients of the recurrent part by backpropagation through the window."""
    before, gates, news, inner, keep = kept
    n, width = p["u"].shape[0], live[0]
    if live[-1] == width:
        each = d.reshape(len(live), width, n)
    else:
        each = np.zeros((len(live), width, n), d.dtype)  # a lane that ended gets nothing
        each[np.arange(width) < np.array(live)[:, None]] = d
    each = np.ascontiguousarray(each.transpose(0, 2, 1))
    r, z = gates[:, :n], gates[:, n:]
    for_new = (1 - z) * (1 - news * news)
    for_z = (before - news) * z * (1 - z)
    for_r = inner * r * (1 - r)
    da, dn = np.empty((len(live), 3 * n, width), before.dtype), np.empty_like(before)
    u, g = p["u"], np.zeros((n, width), before.dtype)
    for t in range(len(live) - 1, -1, -1):
        np.multiply(g, for_new[t], out=dn[t])
        np.multiply(dn[t], for_r[t], out=da[t, :n])
        np.multiply(g, for_z[t], out=da[t, n : 2 * n])
        np.multiply(dn[t], r[t], out=da[t, 2 * n :])
        g *= z[t]
        g += u @ da[t]
        g += each[t]
        if keep is not None:
            g *= keep[t, :width]
    gu = (before @ da.transpose(0, 2, 1)).sum(axis=0)
    da[:, 2 * n :] = dn
    which, what = np.concatenate([ids[t, :k] for t, k in enumerate(live)]), _alive(da, live)
    order = np.argsort(which.astype(np.int16), kind="stable")  # at most HEAD + TAIL_CLASSES + 1 inputs
    rows, first = np.unique(which[order], return_index=True)
    gx = np.add.reduceat(what[order], first, axis=0)
    return gu, gx.sum(axis=0), rows, gx


def _lanes(docs: list[np.ndarray], lanes: int):
    """Documents dealt to lanes, longest first, each to the lane that is free first, one after another: (the number of the
    document at each place, ids, lengths), padded, longest lane first. So lanes run side by side until few are left."""
    if not docs:
        return
    free, dealt = [(0, i) for i in range(min(lanes, len(docs)))], [[] for _ in range(min(lanes, len(docs)))]
    for j in np.argsort([-len(x) for x in docs], kind="stable").tolist():
        used, lane = free[0]
        dealt[lane].append(j)
        heapq.heapreplace(free, (used + len(docs[j]), lane))
    free.sort(key=lambda f: (-f[0], f[1]))
    length = np.array([used for used, _ in free])
    own, ids = np.zeros((length[0], len(free)), np.int32), np.zeros((length[0], len(free)), np.int32)
    for i, (used, lane) in enumerate(free):
        own[:used, i] = np.repeat(dealt[lane], [len(docs[j]) for j in dealt[lane]])
        ids[:used, i] = np.concatenate([docs[j] for j in dealt[lane]])
    yield own, ids, length


def _windows(docs: list[np.ndarray], lanes: int, steps: int, dtype):
    """Of each window: the documents' numbers, ids, live lanes of each step, and where a lane goes on with its document.

    Windows get up to eight times longer where few lanes are left.
    """
    for own, ids, length in _lanes(docs, lanes):
        s = 0
        while s < len(ids):
            width = int((length > s).sum())
            e = s + steps * min(8, len(length) // width)
            last = np.vstack([own[max(s - 1, 0)][None], own[s : e - 1]])[: len(ids) - s]
            live = (length[None, :] > s + np.arange(len(last))[:, None]).sum(axis=1).tolist()
            yield own[s:e], ids[s:e], live, (own[s:e] == last).astype(dtype)
            s = e


def train(p, v: Vocabulary, docs: list[np.ndarray], memory, lanes=LANES, steps=STEPS, rate=RATE):
    """Adagrad over windows of the documents, in place."""

    def step(name, where, g):
        memory[name][where] += g * g
        p[name][where] -= rate * g / np.sqrt(memory[name][where] + 1e-8)

    width = min(lanes, len(docs))
    h = np.zeros((width, p["u"].shape[0]), np.float32)
    for _, window, live, keep in _windows(docs, lanes, steps, np.float32):
        states, kept, h = forward(p, window, live, h, keep)
        targets = np.concatenate([window[t, :k] for t, k in enumerate(live)])
        _, g, d = output(p, v, states, targets, True)
        gu, gb, rows, gx = backward(p, window, live, kept, d)
        weight = np.float32(len(targets) / (steps * width))  # where few lanes are left, a token counts no more than before
        # Lanes that ended have no state to carry: h has the lanes of the last step, and later windows no more than those.
        for name, value in (("u", gu), ("b", gb), *g.items()):
            step(name, slice(None), value * weight)
        step("x", rows, gx * weight)


def log_likelihood(p, v: Vocabulary, docs: list[np.ndarray], steps: int = STEPS) -> np.ndarray:
    """Sum per document of the natural logs of P(class) P(head word | class)."""
    out, h = np.zeros(len(docs)), np.zeros((min(SIDE, len(docs)), p["u"].shape[0]), p["u"].dtype)
    for own, window, live, keep in _windows(docs, SIDE, steps, p["u"].dtype):
        states, _, h = forward(p, window, live, h, keep)
        logs, _, _ = output(p, v, states, np.concatenate([window[t, :k] for t, k in enumerate(live)]))
        np.add.at(out, np.concatenate([own[t, :k] for t, k in enumerate(live)]), logs)
    return out


def vocabulary(counts: DataFrame) -> Vocabulary:
    n = counts.agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("v")).first()
    total = n["n"] or 0
    often = F.col("c") * KNOWN >= total  # at most KNOWN words
    left, least = KNOWN - counts.where(often).count(), -(-total // KNOWN)
    for r in sorted(counts.where(~often).groupBy("c").count().collect(), reverse=True):  # at most total / KNOWN rows
        left -= r["count"]
        if left < 0:
            break
        least = r["c"]
    known = counts.where(F.col("c") >= least).toArrow()
    head = F.col("c") * HEAD >= total
    tails = counts.where(~head & (F.length("word") > 0)).groupBy((F.crc32(F.substring("word", 1, 2)) % TAIL_CLASSES).cast("int").alias("b")).agg(F.sum(F.col("c") + 1).alias("m")).collect()
    return Vocabulary(list(zip(known["word"].to_pylist(), known["c"].to_pylist(), strict=True)), total, n["v"], {r["b"]: r["m"] for r in tails})


def fit(docs: DataFrame, v: Vocabulary, rounds: int = ROUNDS) -> dict[str, np.ndarray]:
    """The weights after some rounds that cover the documents once; of a fixed size, whatever the input."""
    p, sc = initial(v), docs.sparkSession.sparkContext
    shapes = [(k, x.shape, x.size) for k, x in p.items()]
    words = sc.broadcast(v)
    for number in range(rounds):
        start = sc.broadcast(p)

        def run(batches, start=start):
            own, tokens = {k: x.copy() for k, x in start.value.items()}, 0
            memory = {k: np.full_like(x, 1e-4) for k, x in own.items()}
            for batch in batches:
                texts = batch.column("text").to_pylist()
                for i, j in slices([len(t or "") for t in texts], SLICE_CHARS):
                    ids = [words.value.ids(*words.value.numbers(split(t))) for t in texts[i:j]]
                    train(own, words.value, ids, memory)
                    tokens += sum(map(len, ids))
            if tokens:
                flat = np.concatenate([x.ravel() for x in own.values()]).astype(np.float64)
                parts = [flat[i : i + PART] for i in range(0, len(flat), PART)]
                yield pa.RecordBatch.from_arrays([pa.array(range(len(parts)), pa.int32()), pa.array([tokens] * len(parts), pa.int64()), pa.array(parts, pa.list_(pa.float64()))], ["part", "tokens", "w"])

        def mean(pdf: pd.DataFrame) -> pd.DataFrame:
            return pd.DataFrame({"part": pdf["part"][:1], "w": [np.average(np.stack(pdf["w"]), axis=0, weights=pdf["tokens"])]})

        chosen = F.pmod(F.xxhash64("doc_id", "text"), F.lit(rounds)) == number
        rows = docs.where(chosen).select("text").mapInArrow(run, "part int, tokens long, w array<double>").groupBy("part").applyInPandas(mean, "part int, w array<double>").collect()
        if rows:
            flat, at, p = np.concatenate([r["w"] for r in sorted(rows, key=lambda r: r["part"])]).astype(np.float32), 0, {}
            for k, shape, size in shapes:
                p[k], at = flat[at : at + size].reshape(shape), at + size
    return p


def score(docs: DataFrame, learn: DataFrame) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score (log10) of every row of ``docs``, learning from ``learn``."""
    counts = written(token_counts(learn), "lm-counts")
    v = vocabulary(counts)
    shared = docs.sparkSession.sparkContext.broadcast((v, fit(learn, v)))

    def run(batches):
        v, p = shared.value
        n = v.n_head
        end = v.number.get(END)
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for i, j in slices([len(t or "") for t in texts], SLICE_CHARS):
                rows = {c: [] for c in ("n_tokens", "known", "base", "tail", "rare", "times")}
                ids = []
                for text in texts[i:j]:
                    words = split(text)
                    numbers, rare = v.numbers(words)
                    own = v.ids(numbers, rare)
                    ids.append(own)
                    # Words that are not broadcast are joined to their counts, and so is the end if it is not.
                    each = Counter(rare if end is not None else [*rare, END])
                    known = numbers[numbers >= 0]
                    logs = v.log[known]
                    base = logs.sum() + (v.log[end] if end is not None else 0)
                    in_tail = (own >= n) & (own < n + TAIL_CLASSES)
                    tail = logs[v.input[known] >= n].sum() + v.tail_log[own[in_tail] - n].sum()
                    for c, value in zip(rows, (len(words) + 1, len(known) + (end is not None), base, tail, list(each), list(each.values())), strict=True):
                        rows[c].append(value)
                own = log_likelihood(p, v, ids) / np.log(10)
                kinds = (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.list_(pa.binary()), pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(i, j - i), *(pa.array(x, t) for x, t in zip(rows.values(), kinds, strict=True)), pa.array(own)], ["doc_id", *rows, "own"])

    a = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_tokens long, known long, base double, tail double, rare array<binary>, times array<int>, own double")
    a = written(a.withColumn("row", F.monotonically_increasing_id()), "lm-scored")
    pairs = a.select("row", F.inline(F.arrays_zip(F.col("rare").alias("word"), F.col("times").alias("k"))))
    more = pairs.join(counts, "word", "left").groupBy("row").agg(F.sum(F.when(F.col("c").isNotNull(), F.col("k")).otherwise(0)).alias("more_known"), F.sum(F.col("k") * F.log10(F.coalesce("c", F.lit(0)) + 1.0)).alias("more"))
    both = a.drop("rare", "times").join(more, "row", "left")
    extra = F.coalesce("more", F.lit(0.0))
    return both.select("doc_id", "n_tokens", (F.col("known") + F.coalesce("more_known", F.lit(0))).cast("long").alias("n_known"), F.lit(v.total).cast("long").alias("train_tokens"),
                       (F.col("base") + extra - F.col("n_tokens") * float(np.log10(v.total + v.distinct + 1))).alias("base_score"), (F.col("own") + F.col("tail") + extra).alias("score"))
